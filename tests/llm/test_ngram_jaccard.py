import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import ngram_jaccard as m


def brute(rows):
    fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for i, t in rows:
        w = (t or "").encode().translate(fold).split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return sorted(((i, len(a), root(i) if i is not None else None) for i, a in sets), key=str)


def corpus():
    r = random.Random(5)
    pool = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5))) for _ in range(400)]
    text = lambda n: [r.choice(pool) for _ in range(n)]
    original, other = text(150), text(90)
    rows = [(i, " ".join(text(r.choice((3, 5, 12, 60))))) for i in range(30)]
    for i in range(30, 110):  # a group of near copies: some reach the original, some only each other
        w = list(original)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(pool)
        if r.random() < 0.3:
            del w[r.randrange(len(w) - 3)]
        rows.append((i, " ".join(w)))
    twin = list(original)
    for k in range(0, 150, 22):
        twin[k] = "changed"
    rows += [(200 + i, " ".join(twin[: 150 - i])) for i in range(6)]
    rows += [(120 + i, " ".join(other)) for i in range(8)] + [(140 + i, " ".join(other[: 90 - i])) for i in range(20)]
    rows += [(300, None), (301, ""), (302, "one two"), (303, "ONE  two"), (None, " ".join(original)), (None, None), (304, "a b c d e"), (304, "a b c d e"), (305, " ".join(original)), (305, " ".join(other)), (-4, "x y z")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("star", "hot", "piece", "cell", "broadcast"), [(2, 14, 4096, 64, True), (12, 14, 4096, 64, True), (2, 3, 3, 0, True), (2, 3, 5, 4, False), (4, 1, 4096, 0, False)])
def test_against_brute_force(frame, monkeypatch, star, hot, piece, cell, broadcast):
    monkeypatch.setattr(m, "STAR", star)
    monkeypatch.setattr(m, "HOT_LEVEL", hot)
    monkeypatch.setattr(m, "HOT_SALTS", 5)
    monkeypatch.setattr(m, "PIECE_ROWS", piece)
    monkeypatch.setattr(m, "CELL_MEMBERS", cell)
    if not broadcast:  # what is small on a cluster is not always small
        monkeypatch.setattr(m, "small", lambda df, *_: df)
    rows = corpus()
    assert sorted((tuple(r) for r in m.linked_documents(frame(rows)).collect()), key=str) == brute(rows)


def test_ranges_in_two_steps(frame, monkeypatch):
    monkeypatch.setattr(m, "STEP_BITS", 2)
    monkeypatch.setattr(m, "range_bits", lambda *_: 5)
    monkeypatch.setattr(m, "HOT_LEVEL", 4)
    rows = corpus()
    assert sorted((tuple(r) for r in m.linked_documents(frame(rows)).collect()), key=str) == brute(rows)


def test_a_token_in_all_documents(frame, monkeypatch):
    monkeypatch.setattr(m, "STAR", 2)
    monkeypatch.setattr(m, "HOT_LEVEL", 2)
    r = random.Random(9)
    line = "this line stands in every one of the documents here"
    rows = [(i, line + " " + " ".join(r.choice("abcdefghij") for _ in range(r.choice((0, 1, 2, 3, 20))))) for i in range(150)]
    assert sorted((tuple(x) for x in m.linked_documents(frame(rows)).collect()), key=str) == brute(rows)


def test_histograms_bound_what_is_shared():
    r = np.random.default_rng(4)
    for _ in range(60):
        x = np.unique(r.integers(0, 1 << 63, r.integers(1, 400), dtype=np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([r.choice(x, r.integers(0, len(x) + 1), replace=False), r.integers(0, 1 << 63, r.integers(0, 300), dtype=np.uint64)]))
        if len(y):
            a, b = m.histograms(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
            assert m.most_shared(a, b) >= len(np.intersect1d(x, y)) and m.most_shared(a, a) == len(x)
    crowd = np.arange(600, dtype=np.uint64)
    assert m.histograms(crowd, np.array([0, 600])) == [b""] and m.most_shared(b"", m.pack(np.ones(4, dtype=np.uint8))) == np.inf


def test_one_of_each(frame):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    out = m.one_of_each(frame([(5, text), (3, text.upper()), (9, "other words stand here for good"), (3, text.upper()), (7, None), (None, text)]))
    assert sorted((r.doc_id for r in out.collect()), key=str) == [3, 7, 9, None]
    assert m.one_of_each(frame([])).count() == 0


def test_one_of_each_with_clashing_names_and_texts(spark, frame):
    docs = frame([(3, "one text that stands here for good"), (3, "another text that stands here for good"), (4, "one text that stands here for good"), (5, None), (5, "words")])
    for c in ("other", "_gone", "_twice", "component_id", "n"):
        docs = docs.withColumn(c, F.lit(1))
    out = m.one_of_each(docs)
    rows = sorted(out.select("doc_id", "text").collect())
    assert out.columns == docs.columns and [r.doc_id for r in rows] == [3, 5]
    assert sorted(m.one_of_each(docs.repartition(5)).select("doc_id", "text").collect()) == rows
