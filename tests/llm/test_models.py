import zlib

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import language_id, quality_cnn
from quillon.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_quality(spark):
    got = QUERIES["op2_quality_cnn"](spark, FOLDER)
    assert got.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [(r.quality, rows[r.doc_id]) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert np.mean([x.predicted == q for q, x in held]) > 0.97


def test_quality_edges(spark, frame):
    docs = frame([(1, None), (2, ""), (None, "fine words"), (3, "x" * 100_000), (3, "x" * 100_000)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality_cnn.score(docs, none).collect()] == [0.5] * 5
    one = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_cnn.score(docs, one).collect()} == {1.0}
    assert quality_cnn.score(frame([]), none).count() == 0
    assert quality_cnn.keep_good(docs, one).columns == docs.columns


def brute_score(net, text):
    """The network's probability, straight from its definition."""
    n = -(-(len(text) + quality_cnn.WIDTH) // quality_cnn.SUB)
    padded = bytes(quality_cnn.WIDTH) + text + bytes(n * quality_cnn.SUB - len(text))
    at = [sum(net.filters[j][padded[i + j]] for j in range(quality_cnn.WIDTH)) for i in range(n * quality_cnn.SUB)]
    subs = [np.maximum(np.max(at[k * quality_cnn.SUB : (k + 1) * quality_cnn.SUB], axis=0) + net.bias, 0) for k in range(n)]
    starts = [0]
    while starts[-1] + quality_cnn.CHUNK < n:
        starts.append(starts[-1] + quality_cnn.HOP)
    chunks = [np.max(subs[k : k + quality_cnn.CHUNK], axis=0) for k in starts]
    z = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) @ net.out + net.out_bias
    return 1 / (1 + np.exp(-z))


def test_forward_pass_against_brute_force():
    net = quality_cnn.fit([b"good words stand here " * 20] * 8 + [b"BAD!! WORDS!! " * 30] * 8, np.array([1.0] * 8 + [0.0] * 8))
    r = np.random.default_rng(3)
    texts = [bytes(r.integers(32, 123, n).tolist()) for n in (0, 1, 59, 60, 61, 64, 190, 253, 256, 700, 1500)] + [b"x" * 60, b"good words " * 90]
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    got = quality_cnn.score_slice(net, buf, np.cumsum([0, *map(len, texts)]))
    assert np.allclose(got, [brute_score(net, t) for t in texts], atol=1e-5)


def test_sample_is_bounded_by_bytes(spark, frame, monkeypatch):
    docs = frame([(i, "good words stand here " * 10) for i in range(20)] + [(i, "BAD!! WORDS!! " * 15) for i in range(20, 40)] + [(40, "BAD!! " * 100_000), (1, "good words stand here " * 10)])
    labels = spark.createDataFrame([(i, int(i < 20), "x") for i in range(41)], "doc_id long, quality int, text string")
    seen = []
    monkeypatch.setattr(quality_cnn, "fit", lambda texts, y: seen.append((texts, y)))
    quality_cnn.train(docs, labels)
    monkeypatch.setattr(quality_cnn, "TRAIN_BYTES", 1000)
    quality_cnn.train(docs, labels)
    assert [(len(t), int(y.sum())) for t, y in seen] == [(41, 20), (8, 4)]


def test_score_reads_whole_texts():
    net = quality_cnn.fit([b"good words stand here " * 20] * 8 + [b"BAD!! WORDS!! " * 30] * 8, np.array([1.0] * 8 + [0.0] * 8))
    texts = [b"good words stand here " * 400, b"good words stand here " * 400 + b"BAD!! WORDS!! " * 60]
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    whole = quality_cnn.score_slice(net, buf, np.array([0, len(texts[0]), len(buf)]))
    alone = [quality_cnn.score_slice(net, np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(whole, alone) and whole[0] > whole[1]


def test_language(spark):
    got = QUERIES["op8_language_id"](spark, FOLDER).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_language_edges(spark, frame):
    docs = frame([(1, "the words of the text"), (2, None), (3, "123 !!"), (None, "the words"), (4, "é"), (5, "𝒳𝒴")])
    got = {r.doc_id: (r.lang_pred, r.score > 0) for r in language_id.identify(docs).collect()}
    assert got[2] == got[3] == ("und", False) and got[1] == got[None] == ("en", True) and got[4][0] == got[5][0] == "en"
    assert {r.lang_pred for r in language_id.identify(docs, F.lit(True)).collect()} == {"und"}
    assert language_id.identify(frame([])).count() == 0


def test_vectors_are_bundles():
    t = language_id.trigrams("abca")
    one, two, three = language_id.letter_vectors()
    numbers = [[0, 1, 2], [1, 2, 3], [2, 3, 1], [3, 1, 0]]  # gap, a, b, c, a, gap
    assert np.array_equal(language_id.text_vector(t), sum(one[a] * two[b] * three[c] for a, b, c in numbers))
    assert len(language_id.trigrams("")) == 0 and len(language_id.trigrams("--")) == 0


def test_predictions_against_brute_force(spark):
    """Cosines of dense vectors, written out; ties go to the smaller name."""
    texts = [(1, "the cat sat on the mat", "en"), (2, "der hund lag auf der matte", "de"), (3, "собака лежит на коврике", "ru"), (4, "кошка сидит на окне", "ru"), (5, "η γάτα κοιμάται", "el"), (6, "the dog lay on the rug", "en"), (7, "same words", "aa"), (8, "same words", "zz"), (9, None, "en"), (10, "nameless", None)]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, lang string, score int")
    asked = docs.unionByName(spark.createDataFrame([(20, "матте коврик", None, 0), (21, "same words", None, 0), (22, "the dogs", None, 0), (23, "γάτα", None, 0), (24, "12 34", None, 0)], docs.schema))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(asked).collect()}
    vector = lambda t: sum(language_id.trigram_vectors(np.array([x]))[0].astype(np.float64) for x in language_id.trigrams(t))
    profile = {}
    for _, t, lang in texts:
        if t and lang:
            profile[lang] = profile.get(lang, 0) + vector(t)
    for r in asked.collect():
        if r.text and len(language_id.trigrams(r.text)):
            v = vector(r.text)
            cosine = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for k, p in profile.items()}
            best = min(cosine, key=lambda k: (-round(cosine[k], 9), k))
            assert got[r.doc_id][0] == best and abs(got[r.doc_id][1] - min(1, max(0, cosine[best]))) < 1e-6
    assert got[7][0] == got[8][0] == got[21][0] == "aa" and got[20][0] == "ru" and got[23][0] == "el" and got[24] == ("und", 0.0)
