"""A very long document, a table of one row, and tables of empty texts through every operator on texts."""

import random

from quillon.llm import decontaminate, language_id, license_scan, ngram_jaccard, quality_cnn, substring_dedup

COUNT = 200_000


def long_words():
    r = random.Random(1)
    pool = ["".join(r.choice("bcdfgaeiou") for _ in range(r.randint(3, 7))) for _ in range(5000)]
    return [r.choice(pool) for _ in range(COUNT)]


def test_ends_of_long_texts_count(spark, frame):
    words = long_words()
    item = "Which of the planets is the third one from the sun? It is the earth of course."
    near = list(words)
    for k in range(0, COUNT, 100):  # 5 of 100 shingles differ
        near[k] = "changed"
    docs = frame([(1, " ".join(words) + " all rights reserved"), (2, " ".join(near) + " " + item), (3, "short text of a few words")])
    got = decontaminate.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(g.doc_id, g.item_id) for g in got] == [(2, 7)] and got[0].first_word > COUNT - 200
    scans = {g.doc_id: (g.n_words, g.n_base, g.last_word) for g in license_scan.scan(docs).collect()}
    assert scans[1] == (COUNT + 3, 1, COUNT) and scans[2][1] == 0
    links = {g.doc_id: g.component_id for g in ngram_jaccard.linked_documents(docs).collect()}
    assert links == {1: 1, 2: 1, 3: 3}
    gone = {g.doc_id: g.n_removed for g in substring_dedup.digest(docs).collect()}
    assert gone[1] == 0 and gone[2] == COUNT - COUNT // 100
    assert {g.doc_id for g in language_id.identify(docs).collect()} == {1, 2, 3}
    assert quality_cnn.score(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 3


def test_texts_without_words(spark, frame):
    docs = frame([(1, None), (2, ""), (3, " \t\n"), (3, " \t\n"), (None, None)])
    benchmark = spark.createDataFrame([(1, None), (2, ""), (None, " ")], "item_id long, text string")
    assert decontaminate.contaminated(docs, benchmark).count() == 0 and decontaminate.remove_contaminated(docs, benchmark).count() == 5
    assert {tuple(g) for g in ngram_jaccard.linked_documents(docs).collect()} == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 0, None)}
    assert [g.n_removed for g in substring_dedup.digest(docs).collect()] == [0] * 5
    assert {(g.n_words, g.labels, g.score) for g in license_scan.scan(docs).collect()} == {(0, "", 0.0)}
    assert {(g.lang_pred, g.score) for g in language_id.identify(docs).collect()} == {("und", 0.0)}
