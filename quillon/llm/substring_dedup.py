"""Exact substring dedup with fixed-block anchors.

Non-overlapping blocks of BLOCK words of every document are the index; every rolling window of BLOCK words of
every document probes it. A run of WINDOW words contains a whole block of its own document as WINDOW >= 2 * BLOCK - 1,
so each repeat leaves an anchor hit on either side. Hits are extended: all windows of WINDOW words over a hit are
compared by 128-bit fingerprints with the smallest document that holds the same words, and adjoining repeated
windows make up the maximal exact repeats, which are removed from all documents but the smallest.

Hashes travel packed by hash range, so that a task's memory follows its range, not the size of a group of copies:
the index keeps the smallest and largest document of a block only, which a slice's blocks are reduced to before the
shuffle, probes stream past it, and fingerprints are reduced to a slice's smallest document before the shuffle.

Edge cases: a null or empty text has no words and stays as it is; a null doc_id takes no part; rows that share a
doc_id are one document for "smaller doc_id", each with its own text; repeats within one document stay; an empty
table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.store import STEP_BITS, bounded_batches, cut, discard, fresh, range_bits, small
from quillon.llm.textkern import NON_SPACE, Words, give_back, mix, numbers, pack, pack_ids, sha256_hex, slices, unpack, unpack_ids

WINDOW, BLOCK = 50, 25
#: Input bytes for each hash range: about a million probes.
RANGE_BYTES = 8 << 20
#: Tasks that share the probes of a hash range.
SALTS = 2
#: Block rows after which an index is compacted while it is built.
INDEX_ROWS = 4_000_000

ANCHORS = "part int, salt int, kind int, docs binary, counts binary, hashes binary"
HITS = "doc_id long, anchor long"
PRINTS = "part int, docs binary, texts binary, counts binary, at binary, low binary, high binary"
REPEATS = "bucket int, docs binary, texts binary, counts binary, at binary"
GATHERED = "doc_id long, text_key long, spans binary"


def _keys(g: np.ndarray, bits: int) -> np.ndarray:
    """The anchor that is sent: the range's bits and 32 more."""
    return (g >> np.uint64(32 - bits)).astype(np.int64)


def _by_part(part: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.lexsort((doc, part))
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=False):
        yield int(part[order[a]]), order[a:b]


def _docs(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a sorted array: values and lengths."""
    cuts = np.flatnonzero(np.diff(doc, prepend=-1))
    return doc[cuts], np.diff(cuts, append=len(doc)).astype(np.uint32)


def _anchors(bits: int):
    def run(batches):
        for n, (batch, buf, bounds) in enumerate(slices(batches)):
            ids, known = numbers(batch.column("doc_id")), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            words = Words(buf, bounds, NON_SPACE)
            g = words.windows(words.hashes(), BLOCK)
            at = words.window_starts(BLOCK)
            doc = words.doc()[at]
            keep = (words.counts[doc] >= WINDOW) & known[doc]
            at, doc = at[keep], doc[keep]
            if not len(at):
                continue
            keys = _keys(g[at], bits)
            # of more ranges than one step tells apart the hashes carry the rest of their number
            rest, kind_of = 32 + bits - min(bits, STEP_BITS), np.uint32 if bits <= STEP_BITS else np.uint64
            doc_rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # packed ids ascend
            sorted_ids = np.sort(ids, kind="stable")
            rows = []
            for kind, chosen in ((0, _outermost(keys, doc_rank[doc], np.flatnonzero((at - words.first[doc]) % BLOCK == 0))), (1, slice(None))):
                k, d = keys[chosen], doc_rank[doc[chosen]]
                for part, own in _by_part(k >> rest, d):
                    who, counts = _docs(d[own])
                    row = (pack_ids(sorted_ids[who]), pack(counts), (k[own] & ((1 << rest) - 1)).astype(kind_of).tobytes())
                    rows += [(part, salt, kind, *row) for salt in (range(SALTS) if kind == 0 else [(n + part) % SALTS])]
            yield _batch(rows, ("part", "salt", "kind", "docs", "counts", "hashes"), 3)

    return run


def _finer(bits: int):
    """Anchors of ranges told apart by STEP_BITS, dealt by `bits` bits."""
    extra = bits - STEP_BITS

    def run(batches):
        for batch in batches:
            groups: dict[tuple, list] = {}
            for r in batch.to_pylist():
                groups.setdefault((r["part"], r["salt"], r["kind"]), []).append(r)
            rows = []
            for (coarse, salt, kind), own in groups.items():
                h = np.concatenate([np.frombuffer(r["hashes"], dtype=np.uint64) for r in own]).astype(np.int64)
                doc = np.concatenate([np.repeat(unpack_ids(r["docs"]), unpack(r["counts"], np.uint32)) for r in own])
                for part, at in _by_part((coarse << extra) + (h >> 32), doc):
                    who, counts = _docs(doc[at])
                    rows.append((part, salt, kind, pack_ids(who), pack(counts), (h[at] & 0xFFFFFFFF).astype(np.uint32).tobytes()))
            if rows:
                yield _batch(rows, ("part", "salt", "kind", "docs", "counts", "hashes"), 3)

    return run


def _finer_prints(coarse: int, bits: int):
    """Fingerprints of ranges told apart by `coarse` bits, dealt by `bits` bits; rows without a range stay."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["part"] < 0:
                    rows.append(tuple(r.values()))
                    continue
                doc, text, at = _expand(r)
                low, high = np.frombuffer(r["low"], dtype=np.uint64), np.frombuffer(r["high"], dtype=np.uint64)
                for part, own in _parts(low, np.arange(len(low)), bits):
                    own = own[np.lexsort((at[own], text[own], doc[own]))]
                    heads = _heads(doc[own], text[own])
                    rows.append((part, pack(doc[own[heads]]), pack(text[own[heads]]), pack(np.diff(heads, append=len(own)).astype(np.uint32)), pack(at[own]), low[own].tobytes(), high[own].tobytes()))
            if rows:
                yield _batch(rows, ("part", "docs", "texts", "counts", "at", "low", "high"), 1)

    return run


def _outermost(keys: np.ndarray, rank: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of the places `own`: for each key one of its first and one of its last document."""
    own = own[np.lexsort((rank[own], keys[own]))]
    heads = _heads(keys[own])
    return own[np.unique(np.concatenate([heads, np.append(heads[1:], len(own)) - 1]))] if len(own) else own


def _batch(rows: list[tuple], names: tuple[str, ...], ints: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=pa.int32() if i < ints else pa.binary()) for i, x in enumerate(zip(*rows, strict=True))], names=names)


class _Index:
    """Of each block hash: its smallest and largest document, and whether another document than its only one probed it."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0
        self.h = None

    def add(self, h: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.parts.append((h, low, high))
        self.rows += len(h)
        self.h = None  # to be closed before it is probed
        if self.rows > INDEX_ROWS and len(self.parts) > 1:
            self.close()

    def close(self) -> None:
        h, low, high = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(h, kind="stable")
        h = h[order]
        cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        self.h, self.low, self.high = h[cuts], np.minimum.reduceat(low[order], cuts), np.maximum.reduceat(high[order], cuts)
        self.hit = np.zeros(len(self.h), dtype=bool)
        self.parts, self.rows = [(self.h, self.low, self.high)], 0


def _matches(batches):
    state: dict = {"group": None, "index": None}

    def out(doc, anchor):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(anchor)], names=["doc_id", "anchor"])

    def flush():
        index = state["index"]
        if index is not None and index.h is not None and index.hit.any():
            part = np.int64(state["group"][0])
            yield out(index.low[index.hit], (part << 32) | index.h[index.hit].astype(np.int64))

    for batch in batches:
        for row in batch.to_pylist():
            group = (row["part"], row["salt"])
            if group != state["group"]:
                yield from flush()
                state.update(group=group, index=_Index())
            index = state["index"]
            h = np.frombuffer(row["hashes"], dtype=np.uint32)
            docs = np.repeat(unpack_ids(row["docs"]), unpack(row["counts"], np.uint32))
            if row["kind"] == 0:
                index.add(h, docs, docs)
                continue
            if index.h is None:
                if not index.parts:
                    continue
                index.close()
            i = np.searchsorted(index.h, h)
            i[i == len(index.h)] = 0
            found = np.flatnonzero(index.h[i] == h)
            i, doc = i[found], docs[found]
            other = (index.low[i] != doc) | (index.high[i] != doc)
            i, doc = i[other], doc[other]
            index.hit[i[index.low[i] == index.high[i]]] = True
            if len(i):
                pairs = np.unique(np.stack([doc, i]), axis=1)
                yield out(pairs[0], (np.int64(group[0]) << 32) | index.h[pairs[1]].astype(np.int64))
    yield from flush()


def _prints(bits: int, print_bits: int):
    def run(batches):
        for batch, buf, bounds in slices(batches):
            ids, texts = numbers(batch.column("doc_id")), numbers(batch.column("text_key"))
            anchors = batch.column("anchors")
            words = Words(buf, bounds, NON_SPACE)
            hashes = words.hashes()
            g = words.windows(hashes, BLOCK)
            cover = np.zeros(len(words) + 2, dtype=np.int32)
            for d in range(batch.num_rows):
                a, n = int(words.first[d]), int(words.counts[d])
                if n >= WINDOW:
                    own = np.asarray(anchors[d].values.to_numpy(zero_copy_only=False), dtype=np.int64)
                    hit = np.flatnonzero(np.isin(_keys(g[a : a + n - BLOCK + 1], bits), own))
                    np.add.at(cover, a + np.maximum(hit - (WINDOW - BLOCK), 0), 1)
                    np.add.at(cover, a + np.minimum(hit, n - WINDOW) + 1, -1)
            at = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            if not len(at):
                continue
            doc = words.doc()[at]
            low, high = words.windows(hashes, WINDOW, 1)[at], words.windows(hashes, WINDOW, 2)[at]
            at = at - words.first[doc]
            # one slice sends its smallest document of each fingerprint; the slice's other documents repeat it
            order = np.lexsort((ids[doc], high, low))
            heads = np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])])
            least = np.empty(len(at), dtype=np.int64)
            least[order] = ids[doc[order]][np.flatnonzero(heads)][np.cumsum(heads) - 1]
            sent = least == ids[doc]
            rows = []
            for part, own in ((-1, np.flatnonzero(~sent)), *_parts(low, np.flatnonzero(sent), print_bits)):
                if len(own):
                    own = own[np.lexsort((at[own], doc[own]))]
                    who, counts = _docs(doc[own])
                    none = part < 0
                    rows.append((part, pack(ids[who]), pack(texts[who]), pack(counts), pack(at[own].astype(np.uint32)), b"" if none else low[own].tobytes(), b"" if none else high[own].tobytes()))
            yield _batch(rows, ("part", "docs", "texts", "counts", "at", "low", "high"), 1)

    return run


def _parts(low: np.ndarray, own: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    part = (low[own] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(own), dtype=np.int64)
    for p, x in _by_part(part, np.zeros(len(own), dtype=np.int64)):
        yield p, own[x]


def _by_bucket(doc, text, at, bits: int) -> pa.Table:
    """Repeated window starts, packed for each hash range of documents."""
    bucket = (mix(doc.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(doc), dtype=np.int64)
    order = np.lexsort((at, text, doc, bucket))
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    rows = []
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=False):
        own = order[a:b]
        heads = _heads(doc[own], text[own])
        rows.append((int(bucket[own[0]]), pack(doc[own[heads]]), pack(text[own[heads]]), pack(np.diff(heads, append=len(own)).astype(np.uint32)), pack(at[own].astype(np.uint32))))
    names = ["bucket", "docs", "texts", "counts", "at"]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.Table.from_arrays([pa.array(x, pa.binary() if i else pa.int32()) for i, x in enumerate(columns)], names=names)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin."""
    fresh = np.zeros(len(keys[0]), dtype=bool)
    fresh[:1] = True
    for x in keys:
        fresh[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(fresh)


def _gather(group: pa.Table) -> pa.Table:
    """A row for each document: the stretches of words that its repeated windows cover, packed (start, end, ...)."""
    doc, text, at = (np.concatenate(x) for x in zip(*map(_expand, group.to_pylist()), strict=True))
    order = np.lexsort((at, text, doc))
    doc, text, at = doc[order], text[order], at[order].astype(np.int64)
    apart = np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (at[1:] > at[:-1] + WINDOW)])
    first = np.flatnonzero(apart)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    spans = np.stack([at[first], at[last] + WINDOW], axis=1).astype(np.uint32)
    doc, text = doc[first], text[first]
    heads = _heads(doc, text)
    give_back()
    return pa.table({"doc_id": pa.array(doc[heads], pa.int64()), "text_key": pa.array(text[heads], pa.int64()), "spans": pa.array([spans[a:b].tobytes() for a, b in zip(heads, [*heads[1:], len(spans)], strict=False)], pa.binary())})


def _expand(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = unpack(row["counts"], np.uint32)
    return np.repeat(unpack(row["docs"], np.int64), counts), np.repeat(unpack(row["texts"], np.int64), counts), unpack(row["at"], np.uint32)


def _known_repeats(bits: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _by_bucket(*_expand(row), bits).to_batches()

    return run


def _found_repeats(group: pa.Table, bits: int) -> pa.Table:
    low, high, docs, texts, ats = [], [], [], [], []
    for row in group.to_pylist():
        doc, text, at = _expand(row)
        docs.append(doc), texts.append(text), ats.append(at)
        low.append(np.frombuffer(row["low"], dtype=np.uint64)), high.append(np.frombuffer(row["high"], dtype=np.uint64))
    low, high, doc, text, at = (np.concatenate(x) for x in (low, high, docs, texts, ats))
    order = np.lexsort((doc, high, low))
    heads = np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])])
    repeated = order[doc[order] > doc[order][np.flatnonzero(heads)][np.cumsum(heads) - 1]]
    return _by_bucket(doc[repeated], text[repeated], at[repeated], bits)


def _with(f, bits: int):
    def run(group: pa.Table) -> pa.Table:
        return f(group, bits)

    return run


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text) and spans (packed stretches of repeated words) of documents with any."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    bits = range_bits(docs, RANGE_BYTES)
    anchors = source.mapInArrow(_anchors(bits), ANCHORS)
    if bits > STEP_BITS:
        anchors = anchors.repartition("part", "salt").sortWithinPartitions("part", "salt", "kind").mapInArrow(_finer(bits), ANCHORS)
    hits = anchors.repartition("part", "salt").sortWithinPartitions("part", "salt", "kind").mapInArrow(_matches, HITS)
    hits = cut(hits.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")))
    near = source.join(small(hits.select(F.col("doc_id").alias("hit_id")), 4_000_000), F.col("doc_id") == F.col("hit_id"), "left_semi")
    near = near.join(hits, "doc_id").select("doc_id", F.xxhash64("text").alias("text_key"), "text", "anchors")
    fine = max(bits - 1, 0)
    coarse = min(fine, STEP_BITS)
    prints = cut(near.mapInArrow(_prints(bits, coarse), PRINTS))
    told = prints.where("part >= 0")
    if coarse < fine:
        told = told.repartition("part").sortWithinPartitions("part").mapInArrow(_finer_prints(coarse, fine), PRINTS)
    found = told.groupBy("part").applyInArrow(_with(_found_repeats, bits), REPEATS)
    known = prints.where("part < 0").mapInArrow(_known_repeats(bits), REPEATS)
    out = cut(found.unionByName(known).groupBy("bucket").applyInArrow(_gather, GATHERED))
    discard(hits, prints)
    return out


def with_repeats(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column of a name of its own (packed stretches of repeated words, null: none), and that name."""
    name, doc_id, key = (fresh(docs, x) for x in ("repeated", "repeated_id", "repeated_key"))
    found = repeats(docs).select(F.col("doc_id").alias(doc_id), F.col("text_key").alias(key), F.col("spans").alias(name))
    return docs.join(small(found), (F.col("doc_id") == F.col(doc_id)) & (F.xxhash64("text") == F.col(key)), "left").drop(doc_id, key), name


def kept_words(words: list[bytes], repeated: bytes | None) -> list[bytes]:
    if not repeated:
        return words
    kept, end = [], 0
    for a, b in np.frombuffer(repeated, dtype=np.uint32).reshape(-1, 2).tolist():
        kept += words[end:a]
        end = b
    return kept + words[end:]


def _digest(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            n, gone, sha = [], [], []
            for text, where in zip(part.column("text"), part.column("repeated"), strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                kept = kept_words(words, where.as_py())
                n.append(len(words)), gone.append(len(words) - len(kept)), sha.append(sha256_hex(b" ".join(kept)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
        give_back()


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_repeats(source)[0].mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _rewrite(name: str):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, stays = [], []
                for text, where in zip(part.column("text"), part.column(name), strict=True):
                    where = where.as_py()
                    texts.append(b" ".join(kept_words(text.as_buffer().to_pybytes().split(), where)).decode() if where else text.as_py())
                    stays.append(not where or bool(texts[-1]))
                names = [x for x in part.schema.names if x != name]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if x == "text" else part.column(x) for x in names], names=names).filter(pa.array(stays))
            give_back()

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated words cut out of text (other texts unchanged); documents of which nothing stays go."""
    out, name = with_repeats(docs)
    out = out.mapInArrow(_rewrite(name), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
