import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import textkern as k

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB zé\t\n|9", max_size=60)), max_size=8)


def lowered(t):
    return t.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words(texts):
    buf, bounds = k.text_bytes(pa.array(texts, pa.string()))
    for classes, pattern in ((k.NON_SPACE, rb"[^\x20\x09-\x0D]+"), (k.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        words = k.Words(buf, bounds, classes)
        want = [re.findall(pattern, lowered(t or "")) for t in texts]
        got = [[bytes(k.LOWER[buf[a:b]]) for a, b in zip(words.start[x:y], words.end[x:y], strict=True)] for x, y in zip(words.first[:-1], words.first[1:], strict=True)]
        assert got == want
        h = words.hashes(lower=True).tolist()
        flat = [w for ws in want for w in ws]
        assert len(set(h)) == len(set(flat)) and len(set(zip(h, flat, strict=True))) == len(set(flat))
        at = words.window_starts(3)
        g = words.windows(words.hashes(lower=True), 3)[at].tolist() if len(at) else []
        runs = [tuple(ws[i : i + 3]) for ws in want for i in range(len(ws) - 2)]
        assert len(g) == len(runs) and len(set(zip(g, runs, strict=True))) == len(set(runs)) == len(set(g))


def test_hashes_do_not_depend_on_place():
    text = "lorem " * 300_000 + "end"
    buf, bounds = k.text_bytes(pa.array(["end", text]))
    h = k.Words(buf, bounds, k.NON_SPACE).hashes()
    assert h[0] == h[-1] and len(np.unique(h)) == 2


def test_packing():
    x = np.array([5, 5, -3, 2**60])
    assert (k.unpack_ids(k.pack_ids(x)) == x).all() and (k.unpack(k.pack(x), np.int64) == x).all()
    assert k.ranges(np.array([3, 9]), np.array([2, 1])).tolist() == [3, 4, 9]
