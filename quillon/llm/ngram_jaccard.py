"""Exact Jaccard self-join on word shingles with adaptive multi-match prefixes.

A document's set is its distinct lower-cased SHINGLE-word shingles (64-bit hashes). All sets share one token order:
shingles that a corpus-wide counter table calls frequent come last. A document's l-prefix holds its first
n - ceil(0.8 n) + l tokens; two sets at the threshold share at least l tokens of their l-prefixes, for every l.
Each document lengthens its prefix (1 to LONGEST) by the estimated cost of its candidates, and a pair must share as
many prefix tokens as the longer choice of the two. Pairs that do pass an upper bound of their overlap, by counts of
each set's hashes in BIN_TOKENS-wide bins, and are then verified on the whole sets.

Copies collapse into one class by a hash of the set before any pairing. In a bucket of many distinct sets only
stars around a few hubs are paired first; what that leaves apart is paired across components only: members of one hub
in one cell if they are few, else by their differences to the hub, which are few and rare; others by their prefixes. So a
group of near copies costs its size and not the square, and no link between components is lost. Components come from
minimum labels with pointer jumping, by joins of checkpointed tables.

A token that very many distinct sets hold is dealt over tasks by set: its entries are reduced by salt, its hubs found by
aggregation, and what is apart meets by token, band of sizes and piece of the bucket, each cell of bounded rows.

Edge cases: fewer than SHINGLE words are one shingle of the whole text; a text that is null or has no words has an
empty set and no links; a null doc_id has no links and a null component; rows that share a doc_id are one node; an empty
table gives an empty result; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.store import STEP_BITS, bounded_batches, cut, discard, fresh, input_bytes, range_bits, small
from quillon.llm.textkern import NON_SPACE, Words, give_back, mix, numbers, pack, pack_ids, ranges, slices, unpack, unpack_ids

SHINGLE = 5
#: Threshold in percent.
PERCENT = 80
LONGEST = 3
#: Buckets with more distinct sets than this pair with hubs first.
STAR = 12
#: Counters of shingle frequencies: 2**bits, one for each COUNTER_BYTES of input between these bounds.
COUNTER_BITS, MOST_COUNTER_BITS, COUNTER_BYTES = 20, 24, 1 << 10
COUNTER_CHUNK = 1 << 14
#: Tokens that at least about 2**HOT_LEVEL sets hold are dealt over HOT_SALTS tasks by set.
HOT_LEVEL, HOT_SALTS = 14, 64
#: Members of a hub that are compared in one cell, and tokens of their sets together.
CELL_MEMBERS, CELL_TOKENS = 64, 1 << 21
#: Entries of a token for each piece of it that meets another one.
PIECE_ROWS = 4096
#: Input bytes for each range of tokens.
RANGE_BYTES = 16 << 20

#: Tokens for each bin of a set's histogram, at most.
BIN_TOKENS = 2

INFO = "kind int, doc_id long, n int, signature long, chunk int, counts binary, bins binary"
ENTRIES = "part int, docs binary, sizes binary, signatures binary, levels binary, counts binary, tokens binary, places binary"
CANDIDATES = "kind int, a long, b long, matches int, want int, token long, size int"


def need(n):
    """ceil(0.8 n): tokens that a set of n shares with any partner."""
    return (n * PERCENT + 99) // 100


def shingle_sets(batch: pa.RecordBatch, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, and where they begin."""
    words = Words(buf, bounds, NON_SPACE)
    hashes = words.hashes(lower=True)
    at = words.window_starts(SHINGLE)
    doc, value = words.doc()[at], words.windows(hashes, SHINGLE)[at] if len(at) else np.zeros(0, dtype=np.uint64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    if len(short):
        whole = [functools.reduce(lambda x, y: (x * 0x100000001B3 + y) & (1 << 64) - 1, hashes[words.first[d] : words.first[d + 1]].tolist(), int(words.counts[d])) for d in short]
        doc, value = np.concatenate([doc, short]), np.concatenate([value, mix(np.array(whole, dtype=np.uint64))])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    if len(doc):
        fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])])
        doc, value = doc[fresh], value[fresh]
    return value, np.searchsorted(doc, np.arange(batch.num_rows + 1))


def signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    sums = np.zeros(len(value) + 1, dtype=np.uint64)
    np.cumsum(mix(value + np.uint64(0x9E3779B97F4A7C15)), out=sums[1:])
    return mix(sums[first[1:]] - sums[first[:-1]]).astype(np.int64)


def histograms(value: np.ndarray, first: np.ndarray) -> list[bytes]:
    """How many of each set's hashes lie in each of equal ranges, packed; empty if a range has more than 255."""
    sizes = np.diff(first)
    bits = np.ceil(np.log2(np.maximum(sizes / BIN_TOKENS, 1))).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(1 << bits)])
    own = np.repeat(bits, sizes).astype(np.uint64)
    at = np.where(own > 0, value >> (np.uint64(64) - np.maximum(own, 1)), 0).astype(np.int64) + np.repeat(start[:-1], sizes)
    counts = np.bincount(at, minlength=int(start[-1]))
    few = np.minimum(counts, 255).astype(np.uint8)
    return [pack(few[a:b]) if counts[a:b].max() <= 255 else b"" for a, b in zip(start[:-1], start[1:], strict=True)]


def most_shared(x: bytes, y: bytes) -> float:
    """No two sets with these histograms share more."""
    if not x or not y:
        return np.inf
    x, y = sorted((unpack(x, np.uint8), unpack(y, np.uint8)), key=len)
    return int(np.minimum(x, y.reshape(len(x), -1).sum(axis=1)).sum())


def _info(counter_bits: int):
    return lambda batches: _infos(batches, counter_bits)


def _infos(batches, counter_bits: int):
    total = np.zeros(1 << counter_bits, dtype=np.int32)
    names = ["kind", "doc_id", "n", "signature", "chunk", "counts", "bins"]
    for batch, buf, bounds in slices(batches):
        value, first = shingle_sets(batch, buf, bounds)
        sizes, marks = np.diff(first), signatures(value, first)
        known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        n = batch.num_rows
        zero = pa.nulls(n, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, dtype=np.int32)), batch.column("doc_id"), pa.array(sizes.astype(np.int32)), pa.array(marks), zero, pa.nulls(n, pa.binary()), pa.array(histograms(value, first), pa.binary())], names=names)
        # a slice counts a set once: copies are one class later
        _, lone = np.unique(marks, return_index=True)
        lone = lone[known[lone]]
        own = value[ranges(first[lone], sizes[lone])]
        at = (own >> np.uint64(64 - counter_bits)).astype(np.int64)
        if len(total) <= 8 * len(at):
            total += np.bincount(at, minlength=len(total)).astype(np.int32)
        else:
            kinds, n_each = np.unique(at, return_counts=True)
            total[kinds] += n_each.astype(np.int32)
    chunks = total.reshape(-1, COUNTER_CHUNK)
    some = np.flatnonzero(chunks.any(axis=1))
    k = len(some)
    if k:
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, dtype=np.int32)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.array(some.astype(np.int32)), pa.array([pack(chunks[i].astype(np.int64)) for i in some], pa.binary()), pa.nulls(k, pa.binary())], names=names)


def _add_counts(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    total = np.zeros(COUNTER_CHUNK, dtype=np.int64)
    for x in group.column("counts"):
        total += unpack(x.as_py(), np.int64)
    return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([pack(total)], pa.binary())], names=["chunk", "counts"])


def frequency_levels(info: DataFrame, counter_bits: int) -> np.ndarray:
    """For each counter: log2 of how often it is above the usual count, 0 for usual ones. A table of fixed size."""
    parts = info.where("kind = 1").select("chunk", "counts", F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("salt"))
    parts = parts.groupBy("chunk", "salt").applyInArrow(_add_counts, "chunk int, counts binary")
    rows = parts.groupBy("chunk").applyInArrow(_add_counts, "chunk int, counts binary").collect()
    total = np.zeros(1 << counter_bits, dtype=np.int64)
    for r in rows:
        total[r["chunk"] * COUNTER_CHUNK : (r["chunk"] + 1) * COUNTER_CHUNK] = unpack(bytes(r["counts"]), np.int64)
    usual = max(4.0, 2 * float(total.mean()) + 4 * float(np.sqrt(total.mean())))
    return np.where(total > usual, np.ceil(np.log2(np.maximum(total, 1) / usual)) + np.ceil(np.log2(usual)), 0).astype(np.uint8)


def _entries(bits: int, levels):
    def run(batches):
        level_of = levels.value
        counter_bits = len(level_of).bit_length() - 1
        for batch, buf, bounds in slices(batches):
            value, first = shingle_sets(batch, buf, bounds)
            sizes, marks = np.diff(first), signatures(value, first)
            ids = numbers(batch.column("doc_id"))
            order = np.lexsort((ids, sizes, marks))
            lone = order[np.concatenate([[True], marks[order][1:] != marks[order][:-1]])]
            lone = np.sort(lone[sizes[lone] > 0])
            lone = lone[np.argsort(ids[lone], kind="stable")]
            if not len(lone):
                continue
            sizes_l = sizes[lone]
            own = value[ranges(first[lone], sizes_l)]
            doc = np.repeat(np.arange(len(lone)), sizes_l)
            level = level_of[(own >> np.uint64(64 - counter_bits)).astype(np.int64)]
            order = np.lexsort((own, level, doc))
            own, level = own[order], level[order]
            base = sizes_l - need(sizes_l)
            starts = np.cumsum(sizes_l) - sizes_l
            # estimated candidates: documents that share a frequent token; rare ones count one in eight
            cost = np.where(level > 0, 2.0 ** np.minimum(level, 40), 0.125)
            sums = np.concatenate([[0.0], np.cumsum(cost)])
            best, want = None, np.ones(len(lone), dtype=np.int64)
            for l in range(1, LONGEST + 1):
                scan = sums[starts + np.minimum(base + l, sizes_l)] - sums[starts]
                price = np.where(l <= need(sizes_l), scan + 8 * scan / l**2, np.inf)
                if best is None:
                    best = price
                else:
                    want[price < best] = l
                    best = np.minimum(best, price)
            length = np.minimum(base + np.minimum(LONGEST, need(sizes_l)), sizes_l)
            at = ranges(starts, length)
            token, doc = own[at], doc[at]
            place = np.maximum(at - starts[doc] - base[doc] + 1, 1)
            rows = []
            # a hot token's entries go to 1 + salt of their set, beyond the ranges of the others
            salt = 1 + (marks[lone][doc].view(np.uint64) % np.uint64(HOT_SALTS)).astype(np.int64)
            who = lone[doc]
            yield _packed(_range(token, bits) + np.where(level[at] >= HOT_LEVEL, salt << bits, 0), ids[who], sizes[who].astype(np.int32), marks[who], want[doc].astype(np.uint8), token, place.astype(np.uint8))

    return run


def _range(token: np.ndarray, bits: int) -> np.ndarray:
    return (token >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(token), dtype=np.int64)


def _packed(part, doc, size, mark, want, token, place) -> pa.RecordBatch:
    """A row for each range of tokens."""
    order = np.lexsort((mark, doc, part))
    part, doc, size, mark, want, token, place = (x[order] for x in (part, doc, size, mark, want, token, place))
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    rows = []
    for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
        own = slice(a, b)
        heads = a + np.flatnonzero(np.concatenate([[True], (doc[own][1:] != doc[own][:-1]) | (mark[own][1:] != mark[own][:-1])]))
        rows.append((int(part[a]), pack_ids(doc[heads]), pack(size[heads]), mark[heads].tobytes(), pack(want[heads]), pack(np.diff(heads, append=b).astype(np.uint32)), token[own].tobytes(), pack(place[own])))
    columns = list(zip(*rows, strict=True)) or [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int32()) for i, c in enumerate(columns)], names=["part", "docs", "sizes", "signatures", "levels", "counts", "tokens", "places"])


def _unpacked(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    """part, document, size, signature, level, token and place of each entry of packed rows."""
    cols: list[list[np.ndarray]] = [[] for _ in range(7)]
    for row in rows.to_pylist():
        counts = unpack(row["counts"], np.uint32)
        own = (np.full(int(counts.sum()), row["part"], dtype=np.int64), np.repeat(unpack_ids(row["docs"]), counts), np.repeat(unpack(row["sizes"], np.int32), counts), np.repeat(np.frombuffer(row["signatures"], dtype=np.int64), counts), np.repeat(unpack(row["levels"], np.uint8), counts), np.frombuffer(row["tokens"], dtype=np.uint64), unpack(row["places"], np.uint8))
        for to, x in zip(cols, own, strict=True):
            to.append(x)
    return tuple(np.concatenate(x) for x in cols)


def _finer(coarse: int, bits: int):
    """Entries of ranges told apart by `coarse` bits, dealt by `bits` bits."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                part, doc, size, mark, want, token, place = _unpacked(batch)
                yield _packed((part >> coarse << bits) + _range(token, bits), doc, size, mark, want, token, place)

    return run


def _candidates(bits: int):
    return lambda group: _meet(group, group.column("part")[0].as_py() >> bits > 0)


def _meet(group: pa.Table, hot: bool) -> pa.Table:
    """Pairs of one range of tokens with their shared prefix tokens (kind 0), members of large buckets (kind 1) and
    the hubs that they were paired with (kind 2); of hot tokens the members only (kind 3)."""
    parts = [_unpacked(batch)[1:] for batch in group.to_batches() if batch.num_rows]
    doc, size, mark, want, token, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    # one entry for each class of equal sets: its smallest document
    order = np.lexsort((doc, size, mark, token))
    token, doc, size, mark, want, place = (x[order] for x in (token, doc, size, mark, want, place))
    fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (mark[1:] != mark[:-1]) | (size[1:] != size[:-1])])
    token, doc, size, want, place = (x[fresh] for x in (token, doc, size, want, place))
    if hot:
        give_back()
        return pa.Table.from_batches([_rows(3, doc, None, place, want, token.astype(np.int64), size)])
    cuts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    length = np.diff(cuts, append=len(token))
    out = [_rows(0, *[np.zeros(0, dtype=np.int64)] * 4, None, None)]
    left, right = [], []
    pairs_of = lambda a, b: (left.append(a), right.append(b))
    for m in range(2, STAR + 1):  # all pairs of small buckets, by bucket size
        at = cuts[length == m]
        if len(at):
            i, j = np.triu_indices(m, 1)
            pairs_of((at[:, None] + i).ravel(), (at[:, None] + j).ravel())
    big = np.flatnonzero(length > STAR)
    members = np.zeros(0, dtype=np.int64)
    if len(big):
        members = ranges(cuts[big], length[big])
        bucket = np.repeat(np.arange(len(big)), length[big])
        # hubs: the smallest document, and those with most entries in large buckets, as a group's original has
        who, where = np.unique(doc[members], return_inverse=True)
        weight = np.bincount(where)[where]
        for order in (np.lexsort((doc[members], bucket)), np.lexsort((doc[members], -weight, bucket))):
            heads = members[order][np.concatenate([[0], np.cumsum(length[big])[:-1]])]
            pairs_of(heads[bucket], members)
            star = np.unique(np.stack([doc[heads[bucket]], doc[members]]), axis=1)
            out.append(_rows(2, star[0], star[1], None, None, None, None))
    if left:
        left, right = np.concatenate(left), np.concatenate(right)
        l = np.minimum(np.maximum(want[left], want[right]), need(np.minimum(size[left], size[right]))).astype(np.int64)
        ok = (doc[left] != doc[right]) & (np.minimum(size[left], size[right]).astype(np.int64) * 100 >= PERCENT * np.maximum(size[left], size[right]).astype(np.int64)) & (place[left] <= l) & (place[right] <= l)
        left, right, l = left[ok], right[ok], l[ok]
    if len(left):
        t = token[left]
        a, b = np.minimum(doc[left], doc[right]), np.maximum(doc[left], doc[right])
        order = np.lexsort((t, b, a))
        a, b, t, l = a[order], b[order], t[order], l[order]
        once = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (t[1:] != t[:-1])])  # hubs can meet twice
        a, b, l = a[once], b[once], l[once]
        heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        out.append(_rows(0, a[heads], b[heads], np.diff(heads, append=len(a)), l[heads], None, None))
    if len(members):
        out.append(_rows(1, doc[members], None, place[members], want[members], token[members].astype(np.int64), size[members]))
    give_back()
    return pa.Table.from_batches(out)


def _rows(kind, a, b, matches, want, token, size):
    n = len(a)
    long = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x.astype(t.to_pandas_dtype()), t)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, dtype=np.int32)), long(a, pa.int64()), long(b, pa.int64()), long(matches, pa.int32()), long(want, pa.int32()), long(token, pa.int64()), long(size, pa.int32())], names=["kind", "a", "b", "matches", "want", "token", "size"])


def _sets(batches):
    for batch, buf, bounds in slices(batches):
        value, first = shingle_sets(batch, buf, bounds)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([value[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["doc_id", "tokens"])


def _linked(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            keep = []
            for x, y in zip(part.column("tokens_a"), part.column("tokens_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(both) and 100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def sets_of(ids: DataFrame, source: DataFrame) -> DataFrame:
    """set_id and packed set (tokens) of the documents set_id."""
    ids = small(cut(ids.select("set_id").distinct()), 4_000_000)
    return source.join(ids, F.col("doc_id") == F.col("set_id"), "left_semi").mapInArrow(_sets, "doc_id long, tokens binary").withColumnRenamed("doc_id", "set_id")


def _with_both(pairs: DataFrame, facts: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with the columns of facts (set_id, columns) for both."""
    a = facts.select(F.col("set_id").alias("a"), *(F.col(c).alias(f"{c}_a") for c in columns))
    b = facts.select(F.col("set_id").alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    return pairs.join(a, "a").join(b, "b").select("a", "b", *(f"{c}_{side}" for c in columns for side in "ab"))


def _with_sets(pairs: DataFrame, source: DataFrame) -> DataFrame:
    """Pairs (a, b) with the packed sets of both."""
    return _with_both(pairs, sets_of(pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")), source), "tokens")


def _plausible(batches):
    for batch in batches:
        keep = []
        for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "bins_a", "bins_b")), strict=True):
            both = min(n, m, most_shared(x, y))
            keep.append(100 * both >= PERCENT * (n + m - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, source: DataFrame, info: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    ids = small(cut(pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()), 4_000_000)
    facts = info.where("kind = 0").join(ids, F.col("doc_id") == F.col("set_id"), "left_semi").select(F.col("doc_id").alias("set_id"), "n", "bins")
    pairs = cut(_with_both(pairs, facts, "n", "bins").mapInArrow(_plausible, "a long, b long").distinct())
    return _with_sets(pairs, source).mapInArrow(_linked, "a long, b long").distinct()


def _cell_links(group: pa.Table) -> pa.Table:
    """Linked pairs of different components among one hub's members."""
    node, component = group.column("node").to_pylist(), group.column("component").to_pylist()
    sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column("tokens").to_pylist()]
    out = []
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if component[i] != component[j] and 100 * min(len(x), len(y)) >= PERCENT * max(len(x), len(y)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= PERCENT * (len(x) + len(y) - both):
                    out.append((min(node[i], node[j]), max(node[i], node[j])))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def in_cells(members: DataFrame, source: DataFrame) -> DataFrame:
    """Links (a, b) across components among the members (hub, node, component) of each hub, a cell for each hub."""
    sets = sets_of(members.select(F.col("node").alias("set_id")), source)
    rows = members.select("hub", F.col("node"), "component").join(sets, F.col("node") == F.col("set_id"))
    return rows.groupBy("hub").applyInArrow(_cell_links, "a long, b long")


DEVIATIONS = "hub long, node long, linked boolean, token long, prefix int, v int, n int"
#: Differences to a hub that two of its members must share in the shorter one's prefix.
HUB_MATCHES = 2


def _deviations(batches):
    """What tells each member's set from its hub's, and how long a prefix of it must share how much."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            columns: list[list[np.ndarray]] = [[] for _ in range(7)]
            for hub, node, x, y in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), part.column("tokens_a"), part.column("tokens_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                own = np.concatenate([np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)])
                v, n = len(own), len(y)
                # at 80 %: sets of n and m tokens are linked if they differ in (n + m) / 9 tokens at most
                linked = v * (100 + PERCENT) <= (100 - PERCENT) * (n + len(x))
                shared = (v - (n - len(x)) * (100 - PERCENT) / (100 + PERCENT)) / 2
                least = max(1, int(np.ceil(shared - 1e-9)))
                prefix = v - least + min(HUB_MATCHES, least)
                for to, value in zip(columns, (np.full(v, hub), np.full(v, node), np.full(v, linked), own.astype(np.int64), np.full(v, prefix), np.full(v, v), np.full(v, n)), strict=True):
                    to.append(value)
            arrays = [pa.array(np.concatenate(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["hub", "node", "linked", "token", "prefix", "v", "n"])


def around_hubs(members: DataFrame, source: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of members (hub, node, component) of one hub and two components, from their differences to the hub.

    Two sets differ exactly where their differences to the hub differ. Of two linked members in two components at
    most one is linked with the hub. With v tokens of difference, n and h tokens in member and hub, a member that has
    a link to one that is not linked with the hub shares more than (v - (n - h) / 9) / 2 differences with it; once both
    are known, at least s = (v + v' - (n + n') / 9) / 2. With the rarest differences of the group first, two such
    members share k of their first v - s + k and v' - s + k differences.
    """
    rows = cut(_with_sets(members.select(F.col("hub").alias("a"), F.col("node").alias("b")), source).mapInArrow(_deviations, DEVIATIONS))
    known = rows.join(small(members.select("node", "component")), "node")
    often = rows.groupBy("hub", "token").agg(F.count("*").alias("often")).where("often > 1")
    # a difference that no other member has takes its place in the prefix but meets nobody
    ranked = known.join(often, ["hub", "token"], "left").withColumn("often", F.coalesce("often", F.lit(1)))
    at = F.row_number().over(W.partitionBy("hub", "node").orderBy("often", "token"))
    ranked = ranked.withColumn("at", at).where("often > 1")
    x = ranked.where("at <= prefix").select("hub", "token", *(F.col(c).alias(f"{c}_x") for c in ("node", "component", "linked", "at", "v", "n")))
    y = ranked.where("not linked").select("hub", "token", *(F.col(c).alias(f"{c}_y") for c in ("node", "component", "at", "v", "n")))
    least = F.ceil(((F.col("v_x") + F.col("v_y")) * (100 + PERCENT) - (F.col("n_x") + F.col("n_y")) * (100 - PERCENT)) / (2 * (100 + PERCENT)) - 1e-9)
    least = F.greatest(F.lit(1), least)
    want = F.least(F.lit(HUB_MATCHES), least)
    apart = F.expr("node_x <> node_y and component_x <> component_y and (linked_x or node_x < node_y)")
    pairs = x.join(y, (x["hub"] == y["hub"]) & (x["token"] == y["token"]) & apart & (F.col("at_x") <= F.col("v_x") - least + want) & (F.col("at_y") <= F.col("v_y") - least + want))
    pairs = pairs.groupBy("node_x", "node_y").agg(F.count("*").alias("matches"), F.first(want).alias("want")).where("matches >= want")
    return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and its component (smallest node) for every node of the links (a, b): minimum labels, pointer jumping."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("other")).select("node", F.least("node", "other").alias("component")))
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "component": "other"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        lower = labels.join(near, "node", "left").select("node", F.least("component", "other").alias("component"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        fresh = cut(lower.join(jump, "component", "left").select("node", F.least("component", "up").alias("component"), "old"))
        changed = fresh.where("component < old").limit(1).count()
        discard(labels)
        labels = fresh
        if not changed:
            discard(both)
            return labels.select("node", "component")


def by_token(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows (token, node, ...) with the written table facts (token, ...), no task with all rows of a token."""
    few = small(facts)
    if few is not facts:
        return rows.join(few, "token")
    facts = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(HOT_SALTS)).cast("int")).join(facts, ["token", "salt"]).drop("salt")


ENTRY = ("node", "size", "place", "want")


def _match(x: str, y: str) -> tuple[Column, Column]:
    """How many prefix tokens a pair of entries must share, and whether a token that it shares counts."""
    least, most = F.least(f"size_{x}", f"size_{y}"), F.greatest(f"size_{x}", f"size_{y}")
    want = F.least(F.greatest(f"want_{x}", f"want_{y}"), F.floor((least * PERCENT + 99) / 100)).cast("int")
    return want, (least * 100 >= most * PERCENT) & (F.col(f"place_{x}") <= want) & (F.col(f"place_{y}") <= want)


def _hot_stars(hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the members (token, ENTRY) of hot tokens: pairs (a, b, matches, want) with the tokens' hubs, and who met which hub."""
    weight = hot.groupBy("node").agg(F.count("*").alias("weight"))
    entry = F.struct(*ENTRY)
    heads = hot.join(weight, "node").groupBy("token").agg(F.min_by(entry, F.col("node")).alias("x"), F.max_by(entry, F.struct(F.col("weight"), -F.col("node"))).alias("y"))
    heads = heads.select("token", F.explode(F.array_distinct(F.array("x", "y"))).alias("h")).select("token", *(F.col(f"h.{c}").alias(f"{c}_y") for c in ENTRY))
    want, counts = _match("x", "y")
    met = by_token(hot, cut(heads)).withColumnsRenamed({c: f"{c}_x" for c in ENTRY}).where("node_x <> node_y")
    pairs = met.where(counts).groupBy(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).agg(F.count("*").alias("matches"), F.max(want).alias("want"))
    return pairs, met.select(F.col("node_y").alias("hub"), F.col("node_x").alias("node")).distinct()


def _cross_pairs(split: DataFrame, shared: DataFrame) -> DataFrame:
    """Candidate pairs of large buckets across components, but for members of one hub.

    Entries meet by token and band of sizes (a partner's band is the same or a neighbour), those of many by pieces."""
    band = F.floor(F.log(F.col("size").cast("double")) / np.log(100 / PERCENT)).cast("int")
    pieces = F.ceil(F.col("entries") / PIECE_ROWS).cast("int")
    own, others = F.pmod(F.xxhash64("node"), pieces).cast("int"), F.explode(F.sequence(F.lit(0), pieces - 1))
    columns = (*ENTRY, "component", "hub")
    x = split.select("token", *(F.col(c).alias(f"{c}_x") for c in columns), band.alias("band"), own.alias("piece_x"), others.alias("piece_y"))
    y = split.select("token", *(F.col(c).alias(f"{c}_y") for c in columns), F.explode(F.array(band - 1, band, band + 1)).alias("band"), own.alias("piece_y"), pieces.alias("pieces"))
    y = y.withColumn("piece_x", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    want, counts = _match("x", "y")
    apart = F.expr("node_x < node_y and component_x <> component_y and coalesce(hub_x <> hub_y, true)")
    pairs = x.join(y, ["token", "band", "piece_x", "piece_y"]).where(apart & counts)
    pairs = pairs.groupBy(F.col("node_x").alias("a"), F.col("node_y").alias("b")).agg(F.count("*").alias("matches"), F.max(want).alias("want"))
    # tokens that a pair shares in small buckets count too
    pairs = pairs.union(shared.where("matches < want")).groupBy("a", "b").agg(F.sum("matches").alias("matches"), F.max("want").alias("want"))
    return pairs.where("matches >= want").select("a", "b")


def linked_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counter_bits = min(MOST_COUNTER_BITS, max(COUNTER_BITS, (input_bytes(docs) // COUNTER_BYTES).bit_length()))
    info = cut(source.mapInArrow(_info(counter_bits), INFO))
    known = source.where("doc_id is not null and text is not null")
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(info, counter_bits))
    bits = range_bits(docs, RANGE_BYTES)
    coarse = min(bits, STEP_BITS)
    entries = known.mapInArrow(_entries(coarse, levels), ENTRIES)
    if coarse < bits:
        entries = entries.repartition("part").sortWithinPartitions("part").mapInArrow(_finer(coarse, bits), ENTRIES)
    found = cut(entries.groupBy("part").applyInArrow(_candidates(bits), CANDIDATES))
    shared = found.where("kind = 0").select("a", "b", F.col("matches").cast("long").alias("matches"), "want")
    star = found.where("kind = 2").select(F.col("a").alias("hub"), F.col("b").alias("node"))
    members = found.where("kind in (1, 3)").select("token", F.col("a").alias("node"), "size", F.col("matches").alias("place"), "want")
    hot = found.where("kind = 3").select("token", F.col("a").alias("node"), "size", F.col("matches").alias("place"), "want")
    if hot.limit(1).count():
        more, met = _hot_stars(hot)
        shared, star = shared.union(more), star.union(met)
    shared = shared.groupBy("a", "b").agg(F.sum("matches").alias("matches"), F.max("want").alias("want"))
    pairs = cut(shared.where("matches >= want").select("a", "b"))
    links = cut(verified(pairs, known, info))
    near = components(links)
    members = members.join(near, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = members.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("entries"))
    split = cut(by_token(members, cut(apart.where("least < most").select("token", "entries"))))
    if split.limit(1).count():
        # each member's hub: of those whose sets it was compared with, the one with most members
        star = star.distinct().where("hub <> node")
        star = star.withColumns({"a": F.least("hub", "node"), "b": F.greatest("hub", "node")}).join(pairs, ["a", "b"], "left_semi").select("hub", "node")
        star = cut(star.join(split.select("node").distinct(), "node", "left_semi"))
        popular = star.groupBy("hub").agg(F.count("*").alias("members"))
        hubs = cut(star.join(popular, "hub").groupBy("node").agg(F.max_by("hub", F.struct("members", -F.col("hub"))).alias("hub")))
        cross_found = cut(_cross_pairs(split.join(hubs, "node", "left"), shared))
        # the members of hubs with more than one component
        own = hubs.join(split.select("node", "component", "size").distinct(), "node")
        sizes = own.groupBy("hub").agg(F.count("*").alias("members"), F.sum("size").alias("tokens"), F.min("component").alias("least"), F.max("component").alias("most"))
        sizes = small(cut(sizes.where("least < most").select("hub", ((F.col("members") <= CELL_MEMBERS) & (F.col("tokens") <= CELL_TOKENS)).alias("few"))))
        own = cut(own.join(sizes, "hub").select("hub", "node", "component", "few"))
        cross = cut(cross_found.union(around_hubs(own.where("not few"), known)).distinct())
        more = verified(cut(cross.join(pairs, ["a", "b"], "left_anti")), known, info).union(in_cells(own.where("few"), known))
        more = cut(more)
        if more.limit(1).count():
            near = components(links.union(more))
        discard(star, hubs, cross_found, cross, own, more)
    discard(found, pairs, links, split)
    rows = info.where("kind = 0").select("doc_id", "n", "signature")
    real = rows.where("n > 0 and doc_id is not null")
    classes = real.groupBy("n", "signature").agg(F.min("doc_id").alias("head"))
    # a doc_id with several rows is one node: its classes hang together
    several = cut(real.groupBy("doc_id").agg(F.count_distinct("signature", "n").alias("sets")).where("sets > 1").select("doc_id"))
    if several.limit(1).count():
        more = real.join(several, "doc_id", "left_semi").join(classes, ["n", "signature"]).where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
        near = components(near.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more))
    heads = classes.join(near.withColumnRenamed("node", "head"), "head", "left").select("n", "signature", F.coalesce("component", "head").alias("component"))
    heads = small(cut(heads.where("component is not null")), 4_000_000)
    alone = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("doc_id"))
    return rows.join(heads, ["n", "signature"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), alone.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the documents that link to a smaller one, directly or not; of rows that share a doc_id one stays,
    that of the smallest hash."""
    found = cut(linked_documents(docs))
    key = fresh(docs, "other")
    of = lambda rows: small(cut(rows.select(F.col("doc_id").alias(key)).distinct()), 4_000_000)
    kept = docs.join(of(found.where("component_id < doc_id")), F.col("doc_id") == F.col(key), "left_anti")
    several = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not several.limit(1).count():
        return kept
    twice = of(several)
    one = F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), F.xxhash64(*docs.columns)))
    same = kept.join(twice, F.col("doc_id") == F.col(key), "left_semi").groupBy("doc_id").agg(one.alias("row")).select("row.*")
    return kept.join(twice, F.col("doc_id") == F.col(key), "left_anti").unionByName(same)
