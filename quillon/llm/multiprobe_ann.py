"""Approximate nearest neighbours by largest inner product with multiprobe p-stable hashing.

Vectors are scaled by the largest norm and lifted onto the unit sphere, where the largest inner product is the least
distance. TABLES tables hash a vector by several Gaussian projections, cut into slots of WIDTH; equal slots are one
bucket of a table, over all vectors. A query visits perturbed buckets in the order of their estimated success, that is
the probability that a neighbour at the cosine expected from a bounded sample falls into that bucket, until the visited
buckets hold TARGET of the probability in the table, or WIDE_TARGET if that finds fewer than `top`. Probes meet entries by bucket; candidates of all tables are merged
for each query and ranked by the exact double-precision product of the original vectors.

Equal vectors are one entry with its smallest ids (a query needs no more than the `top` + 1 smallest), pre-aggregated
before the shuffle. A bucket with many entries or many probes is dealt over cells of bounded entries and probes, every
piece of its entries with every piece of its probes; a cell passes on the best `top` of each query only. Every entry is
in every table; nothing is capped. No vector passes through the driver but the sample.

The fitted part is the sample: SAMPLE vectors for the expected cosine and the number of hashes, which is as large as
MOST_PROBES expected probes and BUCKET_ROWS entries a bucket allow.

Edge cases: vectors that are null, zero, of another length than the most frequent one (of equally frequent ones the
smaller) or with null or non-finite parts take no part, nor does a null vec_id; fewer candidates than `top` are all
returned (small tables have one bucket); ties go to the smaller vec_id; a repeated vec_id stands for each of its vectors and
is never its own neighbour; no vectors give an empty result; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.store import bounded_batches, cut, discard, small
from quillon.llm.textkern import mix, seeded

TABLES, TARGET, WIDTH = 3, 0.62, 1.2
#: For queries that find fewer than they should.
WIDE_TARGET = 0.9999
SAMPLE = 2000
#: Entries of a bucket and probes of a query and table that the number of hashes aims at.
BUCKET_ROWS, MOST_PROBES, MOST_HASHES = 16, 64, 8
#: Best partial choices of slots that go on to the next hash.
BEAM = 1024
#: A cell's entries (of CELL_BYTES at most) and probes.
CELL_ENTRIES, CELL_PROBES, CELL_BYTES = 16_384, 2048, 32 << 20
TOP, EVERY = 20, 20


def gaussian(seed: int, shape: tuple[int, ...]) -> np.ndarray:
    """Standard normal numbers from the fixed mixer."""
    n = math.prod(shape)
    u = (seeded(seed, 2 * n) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return (np.sqrt(-2 * np.log(1 - u[:n])) * np.cos(2 * np.pi * u[n:])).reshape(shape)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>) of the rows that take part."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where("vec_id is not null and embedding is not null")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return rows.where(F.coalesce(good, F.lit(False)))


def usual_length(rows: DataFrame) -> int | None:
    """The most frequent length of vectors; None without any."""
    found = rows.groupBy(F.size("embedding").alias("dimension")).count().orderBy(F.desc("count"), "dimension").first()
    return found["dimension"] if found else None


def entries(rows: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors with their `keep` smallest ids; a hot vector meets in two steps, never as one list."""
    least = lambda x: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(x)))), 1, keep)
    part = rows.mapInArrow(_local_entries(keep), "embedding array<double>, ids array<long>, salt int")
    return part.groupBy("embedding", "salt").agg(least("ids").alias("ids")).groupBy("embedding").agg(least("ids").alias("ids"))


def _local_entries(keep: int):
    def run(batches):
        for n, batch in enumerate(batches):
            flat = batch.column("embedding")
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            x = flat.values.to_numpy(zero_copy_only=False)[flat.offsets[0].as_py() : flat.offsets[-1].as_py()] if len(flat) else np.zeros(0)
            sizes = np.diff(flat.offsets.to_numpy())
            at = np.concatenate([[0], np.cumsum(sizes)])
            own: dict[bytes, list[int]] = {}
            for k in range(len(ids)):
                own.setdefault((x[at[k] : at[k + 1]] + 0.0).tobytes(), []).append(int(ids[k]))
            salt = int(ids[0]) % 64 if len(ids) else 0
            yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(v) for v in own], pa.list_(pa.float64())), pa.array([sorted(set(v))[:keep] for v in own.values()], pa.list_(pa.int64())), pa.array([salt] * len(own), pa.int32())], names=["embedding", "ids", "salt"])

    return run


class Hashing:
    """Projections of all tables, and the buckets that queries visit."""

    def __init__(self, dimension: int, radius: float, hashes: int, cosine: float):
        self.radius, self.hashes, self.cosine = radius, hashes, cosine
        self.planes = gaussian(41, (TABLES, hashes, dimension + 1))
        self.offsets = (seeded(42, TABLES * hashes) >> np.uint64(11)).astype(np.float64).reshape(TABLES, hashes) / float(1 << 53) * WIDTH

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.radius
        return np.concatenate([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))[:, None]], axis=1)

    @staticmethod
    def _code(code: np.ndarray, slot: np.ndarray) -> np.ndarray:
        return mix(code * np.uint64(0x100000001B3) + slot.astype(np.int64).view(np.uint64))

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        """The number of each vector's bucket."""
        slots = np.floor((self.lift(x) @ self.planes[table].T + self.offsets[table]) / WIDTH).astype(np.int64)
        code = np.full(len(x), table, dtype=np.uint64)
        for h in range(self.hashes):
            code = self._code(code, slots[:, h])
        return code.view(np.int64)

    def probes(self, queries: np.ndarray, table: int, target: float = TARGET) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of each query in the order of their estimated success, and their success; 0 where it visits none.

        On the sphere a neighbour's projection is normal around cosine times the query's, with variance
        1 - cosine**2: the slot probabilities of the hashes multiply.
        """
        unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        at = unit @ self.planes[table][:, :-1].T * self.cosine
        spread = math.sqrt(max(1e-6, 1 - self.cosine**2))
        reach = math.ceil(4 * spread / WIDTH)
        code = np.full((len(queries), 1), table, dtype=np.uint64)
        chance = np.ones((len(queries), 1))
        for h in range(self.hashes):
            slots = np.floor((at[:, h : h + 1] + self.offsets[table][h]) / WIDTH).astype(np.int64) + np.arange(-reach, reach + 1)
            low = (slots * WIDTH - self.offsets[table][h] - at[:, h : h + 1]) / spread
            mass = np.maximum(_normal(low + WIDTH / spread) - _normal(low), 0)
            chance = (chance[:, :, None] * mass[:, None, :]).reshape(len(queries), -1)
            best = np.argsort(-chance, axis=1, kind="stable")[:, :BEAM]
            chance = np.take_along_axis(chance, best, axis=1)
            code = self._code(np.take_along_axis(code, best // mass.shape[1], axis=1), np.take_along_axis(slots, best % mass.shape[1], axis=1))
        chance = np.where(np.cumsum(chance, axis=1) - chance < target, chance, 0)
        return code.view(np.int64), chance


def slot_choices(cosine: float) -> float:
    """Slots of one hash that a neighbour at this cosine lies in, as a perplexity averaged over offsets."""
    spread = math.sqrt(max(1e-6, 1 - cosine**2))
    low = (np.arange(-8, 9)[None, :] - np.linspace(0, 1, 16, endpoint=False)[:, None]) * WIDTH / spread
    p = np.maximum(_normal(low + WIDTH / spread) - _normal(low), 1e-12)
    return float(np.exp(-(p * np.log(p)).sum(axis=1).mean()))


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x >= 0, 1 - tail, tail)


def fit(vectors: DataFrame, total: int, top: int) -> Hashing | None:
    """Hashing from the bounded sample and the largest norm of all vectors, which have one length."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    facts = vectors.agg(F.max(norm).alias("radius")).first()
    if facts["radius"] is None:
        return None
    rows = vectors.orderBy(F.xxhash64("embedding")).limit(SAMPLE).select("embedding").collect()
    x = np.array([r["embedding"] for r in rows])
    # the cosine of a neighbour of rank `top` among all: the sample's quantile, its best where it is too small
    probe = x[: min(len(x), 256)]
    lifted = np.concatenate([x / facts["radius"], np.sqrt(np.maximum(0, 1 - ((x / facts["radius"]) ** 2).sum(axis=1)))[:, None]], axis=1)
    cosine = probe / np.linalg.norm(probe, axis=1, keepdims=True) @ lifted[:, :-1].T
    cosine[np.arange(len(probe)), np.arange(len(probe))] = -1
    rank = min(len(x) - 1, max(1, round(top / max(1, total) * len(x)))) if len(x) > 1 else 1
    best = -np.sort(-cosine, axis=1)[:, rank - 1]
    expected = float(np.clip(np.median(best), 0.05, 0.999))
    by_probes = math.log(MOST_PROBES) / max(1e-9, math.log(slot_choices(expected)))
    by_rows = math.log(max(1.0, total / BUCKET_ROWS)) / math.log(slot_choices(0.0))
    return Hashing(x.shape[1], float(facts["radius"]), int(np.clip(min(by_probes, by_rows), 0, MOST_HASHES)), expected)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _packed(x: np.ndarray) -> list[bytes]:
    """Each vector's bytes, in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    exact = (single == x).all(axis=1)
    return [a.tobytes() if e else b.tobytes() for a, b, e in zip(single, x, exact, strict=True)]


def _unpacked(column: pa.ChunkedArray, dimension: int) -> np.ndarray:
    raw = column.to_pylist()
    out = np.empty((len(raw), dimension))
    for i, x in enumerate(raw):
        out[i] = np.frombuffer(x, dtype=np.float32 if len(x) == 4 * dimension else np.float64)
    return out


ROWS = "bucket long, kind int, own long, ids binary, vector binary"
NAMES = ["bucket", "kind", "own", "ids", "vector"]


def _entry_rows(model, whole: bool):
    """A row for each entry and table: its bucket, and all of the entry if whole; own is a number to deal it by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column("embedding"))
            ids = [np.array(v, dtype=np.int64) for v in batch.column("ids").to_pylist()]
            own = pa.array([int(v[0]) for v in ids], pa.int64())
            packed = (pa.array([v.tobytes() for v in ids], pa.binary()), pa.array(_packed(x), pa.binary())) if whole else (pa.nulls(len(ids), pa.binary()),) * 2
            for table in range(TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(model.value.buckets(x, table)), pa.array(np.zeros(len(ids), dtype=np.int32)), own, *packed], names=NAMES)

    return run


def _probe_rows(model, whole: bool, target: float):
    """A row for each query, table and visited bucket; own is the query's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                x = _vectors(part.column("embedding"))
                ids = part.column("query_id").to_numpy()
                packed = pa.array(_packed(x), pa.binary()) if whole else None
                for table in range(TABLES):
                    code, chance = model.value.probes(x, table, target)
                    who, which = np.nonzero(chance)
                    vector = packed.take(pa.array(who)) if whole else pa.nulls(len(who), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(code[who, which]), pa.array(np.ones(len(who), dtype=np.int32)), pa.array(ids[who], pa.int64()), pa.nulls(len(who), pa.binary()), vector], names=NAMES)

    return run


def _best(dimension: int, top: int):
    """Best `top` of each query of a cell among the cell's entries."""

    def run(group: pa.Table) -> pa.Table:
        kind = group.column("kind").to_numpy()
        entry, probe = group.filter(pa.array(kind == 0)), group.filter(pa.array(kind == 1))
        found: list[tuple[np.ndarray, ...]] = []
        if entry.num_rows and probe.num_rows:
            x, q = _unpacked(entry.column("vector"), dimension), _unpacked(probe.column("vector"), dimension)
            asked = probe.column("own").to_numpy()
            ids = [np.frombuffer(v, dtype=np.int64) for v in entry.column("ids").to_pylist()]
            counts, flat = np.array([len(v) for v in ids]), np.concatenate(ids)
            first = np.cumsum(counts) - counts
            for a in range(0, len(q), 256):
                own = q[a : a + 256]
                score = own @ x.T
                if len(x) > top + 1:  # an entry may be the query itself; what ties with the last one stays
                    least = np.partition(score, len(x) - top - 1, axis=1)[:, len(x) - top - 1]
                    who, which = np.nonzero(score >= least[:, None] - 1e-9 * np.maximum(1, np.abs(least[:, None])))
                else:
                    who, which = (z.ravel() for z in np.indices(score.shape))
                n = counts[which]
                exact = np.repeat((x[which] * own[who]).sum(axis=1), n)
                vec = flat[np.repeat(first[which], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
                query = np.repeat(asked[a : a + 256][who], n)
                other = query != vec
                query, vec, exact = query[other], vec[other], exact[other]
                order = np.lexsort((vec, -exact, query))
                query, vec, exact = query[order], vec[order], exact[order]
                heads = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, dtype=np.int64)
                rank = np.arange(len(query)) - np.repeat(heads, np.diff(heads, append=len(query)))
                found.append((query[rank < top], vec[rank < top], exact[rank < top]))
        query, vec, exact = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(exact, pa.float64())})

    return run


def _found(index: DataFrame, asked: DataFrame, model, dimension: int, top: int, target: float) -> DataFrame:
    """query_id, vec_id, score: each query's nearest entries of every cell that it visits."""
    entry = lambda whole: index.mapInArrow(_entry_rows(model, whole), ROWS)
    probe = lambda whole: asked.mapInArrow(_probe_rows(model, whole, target), ROWS)
    held = entry(False).groupBy("bucket").agg(F.count("*").alias("entries"))
    most = max(1, min(CELL_ENTRIES, CELL_BYTES // (8 * dimension)))
    sizes = held.join(probe(False).groupBy("bucket").agg(F.count("*").alias("probes")), "bucket")
    sizes = small(cut(sizes.select("bucket", F.ceil(F.col("entries") / most).cast("int").alias("pieces"), F.ceil(F.col("probes") / CELL_PROBES).cast("int").alias("turns"))))
    piece = lambda n: F.pmod(F.xxhash64("own"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = entry(True).join(sizes, "bucket").select(*NAMES, piece("pieces").alias("piece"), every("turns").alias("turn"))
    right = probe(True).join(sizes, "bucket").select(*NAMES, every("pieces").alias("piece"), piece("turns").alias("turn"))
    return left.unionByName(right).groupBy("bucket", "piece", "turn").applyInArrow(_best(dimension, top), "query_id long, vec_id long, score double")


def neighbours(vectors: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows of vectors for each row of queries (both vec_id, embedding)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    dimension = usual_length(usable(vectors))
    index = cut(entries(usable(vectors).where(F.size("embedding") == F.lit(dimension)), top + 1))
    total = index.count()
    model = fit(index, total, top) if total else None
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = usable(queries).where(F.size("embedding") == dimension).withColumnRenamed("vec_id", "query_id")
    shared = spark.sparkContext.broadcast(model)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return cut(once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score"))

    out = ranked(_found(index, asked, shared, dimension, top, TARGET))
    # queries in sparse places find too few: these visit on
    full = out.where(F.col("rank") == top).select("query_id")
    short = cut(asked.join(full, "query_id", "left_anti"))
    if model.hashes and short.limit(1).count():
        more = ranked(_found(index, short, shared, dimension, top, WIDE_TARGET))
        out = out.join(full, "query_id", "left_semi").unionByName(more)
    discard(index, short)
    return out
