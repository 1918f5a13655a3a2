"""Composite structural sketches: histogram, interaction graph, bottom-k shingles; mergeable, with similarities."""

from __future__ import annotations

import heapq
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Shingle width and bottom-k size.
WIDTH, SIZE = 3, 128


def histogram(ops: DataFrame, key: str = "circuit") -> DataFrame:
    return ops.groupBy(key, "name").agg(F.count("*").alias("n"))


def distribution(ops: DataFrame, key: str = "circuit") -> DataFrame:
    """Share of each name in its circuit."""
    h = histogram(ops, key)
    return h.join(h.groupBy(key).agg(F.sum("n").alias("total")), key).select(key, "name", "n", (F.col("n") / F.col("total")).alias("share"))


def pairs_of(values: Column) -> Column:
    """All pairs a < b of the distinct values."""
    once = F.array_sort(F.array_distinct(values))
    return F.flatten(F.transform(once, lambda a: F.transform(F.filter(once, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def interactions(ops: DataFrame, key: str = "circuit") -> DataFrame:
    """key, a, b, weight: how often two operands occur in one operation."""
    return ops.select(key, F.explode(pairs_of(F.col("qubits"))).alias("p")).groupBy(key, F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("weight"))


def shingles(ops: DataFrame, token: str, key: str = "circuit", width: int = WIDTH, extra: tuple[str, ...] = (), hashed=lambda text: F.substring(F.sha2(text, 256), 1, 16)) -> DataFrame:
    """key, hash of each run of `width` tokens in idx order; 16 hex digits order like unsigned numbers.

    hashed is the JVM's sha256 unless sketches of another hash (canonical.blake2b64) are to be compared with.

    `extra` columns bound the runs too (sample windows or blocks): a run never crosses them.
    """
    w = W.partitionBy(key, *extra).orderBy("idx")
    tokens = [F.col(token), *(F.lead(token, i).over(w) for i in range(1, width))]
    rows = ops.select(key, *extra, F.when(tokens[-1].isNotNull(), F.concat(F.lit("["), F.concat_ws(",", *tokens), F.lit("]"))).alias("text"))
    return rows.where("text is not null").select(key, *extra, hashed(F.col("text")).alias("hash"))


def bottom_k(hashes: DataFrame, key: str = "circuit", size: int = SIZE) -> DataFrame:
    """key, hash of the `size` smallest distinct hashes."""
    at = F.row_number().over(W.partitionBy(key).orderBy("hash"))
    return hashes.select(key, "hash").distinct().withColumn("_at", at).where(F.col("_at") <= size).drop("_at")


def sampled(ops: DataFrame, stride: int, window: int) -> DataFrame:
    """Operations of the first `window` places of each `stride`, with their window's number."""
    return ops.where(F.pmod("idx", F.lit(stride)) < window).withColumn("block", F.floor(F.col("idx") / stride))


def blocks(ops: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """Operations with the blocks that hold them; a block begins `overlap` places before its own share."""
    own = F.floor(F.col("idx") / size)
    also = F.when(F.col("idx") >= (own + 1) * size - overlap, F.array(own, own + 1)).otherwise(F.array(own))
    last = ops.groupBy("circuit").agg(F.floor(F.max("idx") / size).alias("_last"))
    return ops.join(last, "circuit").withColumn("block", F.explode(also)).where("block <= _last").drop("_last")


def cosine(a: DataFrame, b: DataFrame, on: list[str], weight: str) -> DataFrame:
    """One row: cosine of two sparse vectors; two empty ones are alike, one empty one is not."""
    both = a.select(*on, F.col(weight).alias("_a")).join(b.select(*on, F.col(weight).alias("_b")), on, "full_outer").na.fill(0, ["_a", "_b"])
    sums = both.agg(*(F.coalesce(F.sum(F.col(x).cast("double") * F.col(y)), F.lit(0.0)).alias(n) for n, x, y in (("ab", "_a", "_b"), ("aa", "_a", "_a"), ("bb", "_b", "_b"))))
    return sums.select(F.when((F.col("aa") == 0) & (F.col("bb") == 0), 1.0).when((F.col("aa") == 0) | (F.col("bb") == 0), 0.0).otherwise(F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("similarity"))


def pair_similarities(a: DataFrame, pairs: DataFrame, key: str, item: list[str], weight: str) -> DataFrame:
    """cosine and weighted Jaccard for each pair (left, right) of keys."""
    x = pairs.join(a.select(F.col(key).alias("left"), *item, F.col(weight).alias("_a")), "left")
    y = pairs.join(a.select(F.col(key).alias("right"), *item, F.col(weight).alias("_b")), "right")
    both = x.join(y, ["left", "right", *item], "full_outer").na.fill(0, ["_a", "_b"])
    p, q = F.col("_a").cast("double"), F.col("_b").cast("double")
    return both.groupBy("left", "right").agg(F.try_divide(F.sum(p * q), F.sqrt(F.sum(p * p) * F.sum(q * q))).alias("cosine"), F.try_divide(F.sum(F.least(p, q)), F.sum(F.greatest(p, q))).alias("jaccard"))


def weighted_jaccard(a: DataFrame, b: DataFrame, on: list[str], weight: str) -> DataFrame:
    """One row: sum of minima by sum of maxima; two empty graphs are alike."""
    both = a.select(*on, F.col(weight).alias("_a")).join(b.select(*on, F.col(weight).alias("_b")), on, "full_outer").na.fill(0, ["_a", "_b"])
    sums = both.agg(F.sum(F.least("_a", "_b")).alias("low"), F.sum(F.greatest("_a", "_b")).alias("high"))
    return sums.select(F.when(F.coalesce(F.col("high"), F.lit(0)) == 0, 1.0).otherwise(F.col("low") / F.col("high")).alias("similarity"))


def kmv_jaccard(a: DataFrame, b: DataFrame, size: int = SIZE) -> DataFrame:
    """One row: share of the `size` smallest hashes of the union that both bottom-k sketches hold."""
    both = a.select("hash", F.lit(1).alias("s")).distinct().unionByName(b.select("hash", F.lit(2).alias("s")).distinct()).groupBy("hash").agg(F.count("*").alias("n"))
    least = both.orderBy("hash").limit(size)
    return least.agg(F.count("*").alias("k"), F.count_if(F.col("n") == 2).alias("m")).select(F.when(F.col("k") == 0, 1.0).otherwise(F.col("m") / F.col("k")).alias("similarity"))


def merge_histograms(parts: DataFrame, key: str = "circuit") -> DataFrame:
    """Merge of block histograms (key, block, name, n)."""
    return parts.groupBy(key, "name").agg(F.sum("n").alias("n"))


def heavy_hitters(weights: DataFrame, item: list[str], weight: str, k: int) -> DataFrame:
    """The k heaviest items, exactly: sums are partial before the shuffle and a top-k keeps k rows a task."""
    return weights.groupBy(*item).agg(F.sum(weight).alias("weight")).orderBy(F.desc("weight"), *item).limit(k)


def hash_sample(items: DataFrame, columns: list[str], k: int, seed: int = 0) -> DataFrame:
    """k distinct items drawn by hash order: a reservoir's uniform sample, the same in every run."""
    return items.select(*columns).distinct().orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), *columns), 256)).limit(k)


def shingle_frequencies(hashes: DataFrame) -> DataFrame:
    """circuit, shingles, distinct, singleton_share: how many different shingles there are and how many occur once."""
    n = hashes.groupBy("circuit", "hash").agg(F.count("*").alias("n"))
    return n.groupBy("circuit").agg(F.sum("n").alias("shingles"), F.count("*").alias("distinct"), (F.count_if(F.col("n") == 1) / F.count("*")).alias("singleton_share"))


def localize(blocks: DataFrame, pairs: DataFrame, tolerance: int) -> DataFrame:
    """left, right, block, similarity, best: for each block of a pair's left circuit the best of the right one's blocks at
    most `tolerance` places away, by weighted Jaccard of their histograms (circuit, block, name, n); nearer blocks first
    among equals."""
    total = blocks.groupBy("circuit", "block").agg(F.sum("n").alias("total"))
    near = F.explode(F.sequence(F.col("block") - tolerance, F.col("block") + tolerance))
    a = pairs.join(total.withColumnsRenamed({"circuit": "left", "total": "total_a"}), "left").withColumn("other", near)
    met = a.join(total.withColumnsRenamed({"circuit": "right", "block": "other", "total": "total_b"}), ["right", "other"])
    x = met.select("left", "right", "block", "other").join(blocks.withColumnsRenamed({"circuit": "left", "n": "n_a"}), ["left", "block"])
    x = x.join(blocks.withColumnsRenamed({"circuit": "right", "block": "other", "n": "n_b"}), ["right", "other", "name"])
    shared = x.groupBy("left", "right", "block", "other").agg(F.sum(F.least("n_a", "n_b")).alias("shared"))
    rows = met.join(shared, ["left", "right", "block", "other"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    rows = rows.withColumn("similarity", F.col("shared") / (F.col("total_a") + F.col("total_b") - F.col("shared")))
    first = F.struct(-F.col("similarity"), F.abs(F.col("block") - F.col("other")), F.col("other"))
    return rows.groupBy("left", "right", "block").agg(F.max("similarity").alias("similarity"), F.min_by("other", first).alias("best"))


def density(edges: Column, nodes: Column) -> Column:
    """Edges by possible edges."""
    return F.try_divide(edges * 2.0, nodes * (nodes - 1))


def _streamed(rows: DataFrame, key: str, start, add, finish, schema: str) -> DataFrame:
    """Runs sequential state over rows sorted by (key, idx), one key at a time, holding only the state."""
    import pyarrow as pa

    names = [x.strip().split()[0] for x in schema.split(",")]
    rows = rows.repartition(key).sortWithinPartitions(key, "idx")

    def run(batches):
        current, state, begun = None, None, False
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not begun or r[key] != current:
                    out += [(current, *x) for x in finish(state)] if begun else []
                    current, state, begun = r[key], start(), True
                add(state, r)
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)))
        if begun and (out := [(current, *x) for x in finish(state)]):
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)))

    return rows.mapInArrow(run, schema)


def space_saving(ops: DataFrame, item: str, capacity: int, key: str = "circuit") -> DataFrame:
    """key, item, weight, error of a Space-Saving summary: at most `capacity` counters; a new item takes the least one.

    True counts lie between weight - error and weight, and items above the total by capacity are all there.
    """
    kind = ops.schema[key].dataType.simpleString()

    def add(state, r):
        counters, heap = state  # the heap's counts may be old; one that is taken out is first brought up to date
        v = r[item]
        if v in counters:
            counters[v][0] += 1
            return
        n = 0
        if len(counters) >= capacity:
            while heap[0][0] < counters[heap[0][1]][0]:
                heapq.heapreplace(heap, (counters[heap[0][1]][0], heap[0][1]))
            n = counters.pop(heapq.heappop(heap)[1])[0]
        counters[v] = [n + 1, n]
        heapq.heappush(heap, (n + 1, v))

    finish = lambda state: [(v, n, e) for v, (n, e) in sorted(state[0].items())]
    rows = ops.select(key, "idx", F.col(item).cast("string").alias(item)).where(F.col(item).isNotNull())
    return _streamed(rows, key, lambda: ({}, []), add, finish, f"{key} {kind}, {item} string, weight long, error long")


def reservoir(ops: DataFrame, item: str, size: int, seed: int = 0, key: str = "circuit") -> DataFrame:
    """key, item: a uniform sample of the distinct items in the order of their first places (Algorithm R), seeded."""
    import random

    kind = ops.schema[key].dataType.simpleString()
    firsts = ops.groupBy(key, item).agg(F.min("idx").alias("idx")).select(key, "idx", F.col(item).cast("string").alias(item))

    def start():
        return {"random": random.Random(seed), "seen": 0, "kept": []}

    def add(state, r):
        state["seen"] += 1
        if len(state["kept"]) < size:
            state["kept"].append(r[item])
        elif (at := state["random"].randrange(state["seen"])) < size:
            state["kept"][at] = r[item]

    return _streamed(firsts, key, start, add, lambda state: [(x,) for x in state["kept"]], f"{key} {kind}, {item} string")


def require_compatible(a: dict, b: dict) -> None:
    """Sketches compare only if width, size and sampling are the same."""
    different = sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k))
    if different:
        raise ValueError(f"sketches differ in {', '.join(different)}")
