"""The pipeline's stages against brute force over the stage before, and the whole run."""

import re

import corpus_pipeline
from quillon.llm.queries import ORACLE_SQL, QUERIES
from quillon.llm.store import cut

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(cut(stage(spark, kept[-1], FOLDER)))
    assert all(d.columns == columns for d in kept[:-1])
    text = [{r.doc_id: r.text for r in d.collect()} for d in kept[:-1]]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rejected = text[0].keys() - text[1].keys()
    assert sum(quality.get(i) == 0 for i in text[1]) <= 1 and sum(quality.get(i) == 1 for i in rejected) <= 1
    assert text[2].keys() <= text[1].keys() and len(set(text[2].values())) == len(text[2])
    for i, t in text[3].items():
        assert len(t.split()) <= len(text[2][i].split())
    norm = lambda t: f" {' '.join(re.findall(r'[0-9a-z\x80-\U0010ffff]+', t.lower()))} "
    items = [norm(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert text[4].keys() == {i for i, t in text[3].items() if not any(x in norm(t) for x in items)}
    mixed = kept[-1].collect()
    assert {r.doc_id for r in mixed} == text[4].keys() and sum(r["size"] for r in mixed) == sum(len(t.split()) for t in text[4].values())
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, mixed))


def test_edges(spark, tmp_path):
    """Nulls, empty tables, repeated rows, a long text and clashing names pass every stage."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, size int, taken string, repeated int, other int, key string, score double"
    long = " ".join(f"word{i % 5000}" for i in range(30_000))
    texts = [(1, "a fine text of some words stands here"), (1, "a fine text of some words stands here"), (1, None), (2, ""), (3, None), (None, "words without a number"), (4, long), (5, "start " + long), (6, "x")]
    docs = spark.createDataFrame([(i, t, None, None if i == 6 else "s", None, 1, "t", 2, 3, "k", 0.1) for i, t in texts], columns)
    labels, benchmark = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    for name, rows in (("full", docs), ("empty", docs.limit(0))):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        benchmark.write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder)
        assert got.columns == [*docs.columns, "size_", "source_size", "target", "taken_"]
        found = sorted(((r.doc_id, len((r.text or "").split())) for r in got.collect()), key=str)
        # document 4 holds 5 but for a word: one of both stays
        assert found == ([] if name == "empty" else sorted([(1, 8), (2, 0), (3, 0), (4, 30_000), (6, 1), (None, 4)], key=str)) or found == sorted([(1, 0), (2, 0), (3, 0), (4, 30_000), (6, 1), (None, 4)], key=str)


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11)) and ORACLE_SQL.keys() <= QUERIES.keys()
