"""Quality classifier: a byte-level convolutional network in numpy.

Input symbols are the text's bytes and nothing else. FILTERS learned filters of WIDTH bytes run at every byte of the
whole text; each overlapping chunk of CHUNK sub-blocks (of SUB bytes, hop HOP sub-blocks) is max-pooled; the chunks'
mean and maximum go through a logistic unit to one probability.

The network is fitted with Adam on a bounded sample, the only bound there is: labelled rows of each class in the order
of a hash of doc_id, at most TRAIN_ROWS rows and TRAIN_BYTES bytes of text a class (rows that share doc_id and text
count once). Scoring reads whole texts of every row.

Edge cases: a null text is an empty one; empty texts get the score of padding alone; without labelled rows every
score is 0.5; with one class only, that class's rate; a doc_id with several labels teaches each of them; a null doc_id
is scored and not held out; repeated rows are scored one by one; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.store import bounded_batches, cut
from quillon.llm.textkern import ranges, seeded, slices

WIDTH, FILTERS = 4, 24
SUB, CHUNK, HOP = 64, 4, 3
TRAIN_ROWS, TRAIN_BYTES = 1500, 16 << 20
EPOCHS, BATCH, RATE, LEAST_STEPS = 8, 32, 0.02, 200
THRESHOLD = 0.3
#: Text bytes of one call, and of one step of it: a step's filter responses stay in the processor's cache.
SLICE, STEP = 1 << 19, 1 << 14


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    out_bias: float
    constant: float | None = None


def symbols(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents' bytes, each behind WIDTH zeros and padded with zeros to whole sub-blocks, so that no filter sees two
    documents; and the sub-block at which each begins."""
    lengths = np.diff(bounds)
    blocks = (lengths + WIDTH + SUB - 1) // SUB
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(int(first[-1]) * SUB + WIDTH, dtype=np.uint8)
    out[ranges(first[:-1] * SUB + WIDTH, lengths)] = buf
    return out, first


def responses(net: Network, sym: np.ndarray, blocks: int) -> np.ndarray:
    """Filter sums at each byte: blocks x SUB x FILTERS."""
    n = blocks * SUB
    sums = np.take(net.filters[0], sym[:n], axis=0)
    for j in range(1, WIDTH):
        sums += np.take(net.filters[j], sym[j : n + j], axis=0)
    return sums.reshape(blocks, SUB, FILTERS)


def chunk_table(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sub-blocks of each chunk (chunks x CHUNK, the last repeated), and where each document's chunks begin."""
    m = np.diff(first)
    count = np.maximum(1, -(-(m - (CHUNK - HOP)) // HOP))
    begin = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(first[:-1], count) + HOP * ranges(np.zeros(len(m), dtype=np.int64), count)
    return np.minimum(start[:, None] + np.arange(CHUNK), np.repeat(first[1:] - 1, count)[:, None]), begin


def score_slice(net: Network, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    if net.constant is not None:
        return np.full(len(bounds) - 1, net.constant)
    sym, first = symbols(buf, bounds)
    subs = np.concatenate([responses(net, sym[a * SUB : b * SUB + WIDTH], b - a).max(axis=1) for a, b in _steps(int(first[-1]))])
    subs = np.maximum(subs + net.bias, 0)
    table, begin = chunk_table(first)
    chunks = subs[table].max(axis=1)
    mean = np.add.reduceat(chunks, begin[:-1]) / np.diff(begin)[:, None]
    z = np.concatenate([mean, np.maximum.reduceat(chunks, begin[:-1])], axis=1) @ net.out + net.out_bias
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def _steps(blocks: int, most: int = STEP // SUB):
    return [(a, min(a + most, blocks)) for a in range(0, blocks, most)]


def fit(texts: list[bytes], labels: np.ndarray) -> Network:
    """Adam on the log loss with a falling rate; deterministic."""
    if len(labels) == 0 or labels.min() == labels.max():
        return Network(np.zeros(0), np.zeros(0), np.zeros(0), 0.0, constant=float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(int(seeded(21, 1)[0]) % (1 << 32))
    params = [(rng.standard_normal((WIDTH, 256, FILTERS)) * 0.1).astype(np.float32), np.zeros(FILTERS, dtype=np.float32), (rng.standard_normal(2 * FILTERS) * 0.3).astype(np.float32), np.zeros(1, dtype=np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    ready = []
    for t in texts:
        sym, first = symbols(np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)]))
        ready.append((sym, int(first[-1])))
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(texts)))
    steps = epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            grads = [np.zeros_like(p) for p in params]
            own = order[at : at + BATCH]
            for d in own:
                sym, blocks = ready[d]
                net = Network(*params[:3], float(params[3][0]))
                tops, places = [], []
                for a, b in _steps(blocks):
                    r = responses(net, sym[a * SUB : b * SUB + WIDTH], b - a)
                    place = r.argmax(axis=1)
                    tops.append(np.take_along_axis(r, place[:, None, :], axis=1)[:, 0])
                    places.append(place + np.arange(a, b)[:, None] * SUB)
                top, place = np.concatenate(tops), np.concatenate(places)
                table, _ = chunk_table(np.array([0, blocks]))
                pick = top[table].argmax(axis=1)
                value = np.maximum(np.take_along_axis(top[table], pick[:, None, :], axis=1)[:, 0] + params[1], 0)
                where = np.take_along_axis(place[table], pick[:, None, :], axis=1)[:, 0]
                best = value.argmax(axis=0)
                features = np.concatenate([value.mean(axis=0), value.max(axis=0)])
                p = 1 / (1 + np.exp(-np.clip(features @ params[2] + params[3][0], -30, 30)))
                delta = np.float32((p - labels[d]) * weight[d] / len(own))
                grads[2] += delta * features
                grads[3] += delta
                back = np.broadcast_to(delta * params[2][:FILTERS] / len(value), value.shape).copy()
                back[best, np.arange(FILTERS)] += delta * params[2][FILTERS:]
                back *= value > 0
                grads[1] += back.sum(axis=0)
                f = np.broadcast_to(np.arange(FILTERS), where.shape)
                for j in range(WIDTH):
                    np.add.at(grads[0][j], (sym[where + j], f), back)
            step += 1
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(*params[:3], float(params[3][0]))


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """Fits on the bounded sample of labelled rows of docs (doc_id, text) and labels (doc_id, quality)."""
    bounded_batches(docs.sparkSession)
    spread = lambda c: F.xxhash64(c, F.lit(7))
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("label_id"), (F.col("quality").cast("int") == 1).alias("good")).distinct()
    ids = known.where("good").orderBy(spread("label_id"), "label_id").limit(TRAIN_ROWS).union(known.where("not good").orderBy(spread("label_id"), "label_id").limit(TRAIN_ROWS))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    found = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("label_id"))
    # which rows, by their sizes alone: at most TRAIN_ROWS of each class, so that one task may sum them up
    sized = found.groupBy("doc_id", "mark", "good").agg(F.max(F.octet_length("text")).alias("n"))
    sized = sized.withColumn("place", F.row_number().over(W.partitionBy("good").orderBy(spread("doc_id"), "doc_id", "mark"))).where(F.col("place") <= TRAIN_ROWS)
    total = F.sum("n").over(W.partitionBy("good").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    chosen = cut(sized.where(F.col("n") <= TRAIN_BYTES).withColumn("total", total).where(F.col("total") <= TRAIN_BYTES).select("doc_id", "mark", "good", "place"))
    sample = rows.join(F.broadcast(chosen), ["doc_id", "mark"]).groupBy("doc_id", "mark", "good", "place").agg(F.first("text").alias("text")).collect()
    sample.sort(key=lambda r: (r["place"], r["good"]))
    return fit([r["text"].encode() for r in sample], np.array([float(r["good"]) for r in sample]))


def _scores(net):
    def run(batches):
        model = net.value
        for batch, buf, bounds in slices(batches, most=SLICE):
            score = score_slice(model, buf, bounds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, held_out=None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; rows where held_out is true teach nothing."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = held_out if held_out is not None else F.lit(False)
    net = docs.sparkSession.sparkContext.broadcast(train(docs.where(~held), labels.where(~held)))
    found = docs.mapInArrow(_scores(net), "doc_id long, score double")
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _keeps(net, least: float):
    def run(batches):
        model = net.value
        for batch, buf, bounds in slices(batches, most=SLICE):
            yield batch.filter(pa.array(score_slice(model, buf, bounds) >= least))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score below least."""
    net = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.mapInArrow(_keeps(net, least), docs.schema)


def remainder(divisor: int, doc_id: str = "doc_id"):
    """crc32 of doc_id as text, modulo divisor."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor
