import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillon.llm import substring_dedup as m


def brute(rows):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - 49):
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = b" ".join(x for x, y in zip(w, gone, strict=True) if not y)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    base = [" ".join(word() for _ in range(r.choice((30, 120, 400)))) for _ in range(12)]
    passage = " ".join(word() for _ in range(80))
    rows = list(enumerate(base))
    for i in range(12, 40):
        a, b = r.choice(base).split(), r.choice(base).split()
        cut = r.randrange(1, len(a))
        rows.append((i, "\n".join([" ".join(a[cut:]), passage if i % 3 else " ".join(passage.split()[:49]), " ".join(b)])))
    rows += [(50, "same " * 500), (51, "same " * 120 + "other"), (52, None), (53, ""), (None, base[0]), (54, " \t\n"), (55, base[1]), (55, base[1]), (55, passage), (-7, passage), (56, "x" * 300_000 + " " + passage)]
    return rows


def test_against_brute_force(frame):
    rows = corpus()
    got = sorted((tuple(r) for r in m.digest(frame(rows)).collect()), key=str)
    assert got == brute(rows)


def test_ranges_in_two_steps(frame, monkeypatch):
    monkeypatch.setattr(m, "STEP_BITS", 1)
    monkeypatch.setattr(m, "range_bits", lambda *_: 5)
    rows = corpus()
    assert sorted((tuple(r) for r in m.digest(frame(rows)).collect()), key=str) == brute(rows)


def sent(rows):
    """The rows that leave for the index and the probes, in the order of a task."""
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    out = [r for b in m._anchors(0)([batch.slice(i, 6) for i in range(0, len(rows), 6)]) for r in b.to_pylist()]
    return sorted(out, key=lambda r: (r["part"], r["salt"], r["kind"]))


def test_rows_after_a_compaction_are_indexed(monkeypatch):
    late = " ".join(f"late{i}" for i in range(100))
    rows = sent([*sorted(x for x in corpus() if x[0] is not None), (60, late), (61, "other " + late)])
    hits = lambda: {p for b in m._matches([pa.RecordBatch.from_pylist(rows)]) for p in zip(*b.to_pydict().values(), strict=True)}
    want = hits()
    for bound in (1, *range(10, 200, 10)):
        monkeypatch.setattr(m, "INDEX_ROWS", bound)
        assert want and hits() == want


def test_blocks_of_copies_are_reduced():
    text = " ".join(f"w{i}" for i in range(100))
    rows = [r for r in sent([(i, text) for i in range(6)]) if r["kind"] == 0 and r["salt"] == 0]
    assert [m.unpack_ids(r["docs"]).tolist() for r in rows] == [[0, 5]] and m.unpack(rows[0]["counts"], np.uint32).tolist() == [4, 4]
    (one,) = (r for r in sent([(1, text)]) if r["kind"] == 0 and r["salt"] == 0)
    assert m.unpack(one["counts"], np.uint32).tolist() == [4]


def test_rewrite(frame):
    rows = [(1, " ".join(f"w{i}" for i in range(60))), (2, "own  words " + " ".join(f"w{i}" for i in range(60)) + " tail"), (3, " ".join(f"w{i}" for i in range(60))), (4, "kept  as it is"), (5, None)]
    out = m.remove_repeats(frame(rows))
    assert out.columns == frame(rows).columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: (rows[0][1], len(rows[0][1])), 2: ("own words tail", 14), 4: ("kept  as it is", 14), 5: (None, None)}


def test_empty(frame):
    assert m.digest(frame([])).count() == 0 and m.remove_repeats(frame([])).count() == 0


def test_clashing_names(frame):
    docs = frame([(1, " ".join(f"w{i}" for i in range(60))), (2, "own words " + " ".join(f"w{i}" for i in range(60)))])
    for c in ("repeated", "repeated_id", "repeated_key", "_rep_id", "_rep_key", "doc", "Repeated_"):
        docs = docs.withColumn(c, F.lit("kept"))
    out = m.remove_repeats(docs)
    assert out.columns == docs.columns and {(r.doc_id, len(r.text.split()), r.repeated, r["Repeated_"]) for r in out.collect()} == {(1, 60, "kept", "kept"), (2, 2, "kept", "kept")}
    assert m.digest(docs).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
