"""Benchmark decontamination: BM25 over test items with block-max WAND.

Items are indexed with BM25 impacts divided by the item's own score, so that an item's whole text scores 1 and one
threshold serves all. Documents are cut into overlapping passages of two half-passages, long enough to hold any item
of the index; every passage is a query. First a vectorised bound adds, for each half-passage and each block of
BLOCK items, the block-max impacts of its words, and the most that long lists of light words can add; passages whose
two halves stay below the threshold for every block can have no item above it. For the others WAND runs with list
maxima for the pivot and block maxima for the skips, and returns every item at or above the threshold. A hit counts if
the item's question (all sentences but the last) and its answer (the last one) both overlap the text around the passage
in at least OVERLAP of their word trigrams.

An index holds items of one length class (half-passages of HALF_WORDS words, twice that, and so on), so that a long
item widens the passages of items as long as itself only. Indexes of about SHARD_BYTES of item text are one broadcast;
larger classes go through in shards by hash of text, every passage against every shard. Item count, document frequencies and
mean length are those of the whole benchmark in every index, so that scores and hits are those of one index. A text
that several items share is one entry; its items are joined to what it finds.

Edge cases: null or empty texts and items without words give no row; a null item_id is an item; a null doc_id keeps its
rows, as null; repeated documents give their rows once each, repeated items once; an item of one sentence has it as
question and answer; an item longer than SHARD_BYTES is an index of its own; an empty benchmark or table gives an empty
result; other columns of either table, whatever their names, do not matter and stay where documents are filtered.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.store import bounded_batches, cut, small
from quillon.llm.textkern import ALNUM, Words, slices

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, GRAM = 0.5, 0.5, 3
BLOCK, SHARD_BYTES = 4, 2 << 20
#: Words of the shortest half-passages: those of items of at most so many words.
HALF_WORDS = 64
#: Long lists that the bound takes as given hold at most this share of any item's own score.
LIGHT_SHARE = 0.3
#: Cells of the bound's table (half-passages by blocks) and text bytes at once.
CELLS, SLICE = 1 << 20, 1 << 20

RESULT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long, passage_words long"


def _hashes(text: bytes) -> np.ndarray:
    return Words(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), ALNUM).hashes(lower=True)


def _grams(h) -> list[tuple]:
    h = h.tolist()
    n = min(GRAM, len(h))
    return [tuple(h[i : i + n]) for i in range(len(h) - n + 1)] if n else []


class Statistics(NamedTuple):
    """Of a whole benchmark: distinct texts with words, their words, and how many of them hold each term."""

    items: int
    words: int
    frequency: Mapping[int, int]


def half_words(longest: int) -> int:
    """Words of a half-passage for items of at most so many words: HALF_WORDS, doubled until it holds them."""
    return HALF_WORDS << max(0, math.ceil(math.log2(max(1, longest) / HALF_WORDS)))


class Index:
    """Posting lists by term, in item order, with list and block maxima; statistics are the items' own if not given."""

    def __init__(self, items: list[tuple[int | None, str]], whole: Statistics | None = None):
        items = [(i, t) for i, t in items if t and len(_hashes(t.encode()))]
        self.ids = [i for i, _ in items]
        self.parts = []
        words = []
        for _, t in items:
            words.append(_hashes(t.encode()))
            sentences = [s for s in re.split(r"(?<=[.?!])\s+", t.strip()) if len(_hashes(s.encode()))]
            question, answer = (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (t, t)
            self.parts.append((_grams(_hashes(question.encode())), _grams(_hashes(answer.encode()))))
        n = len(items)
        own_terms = Counter(int(x) for w in words for x in set(w.tolist()))
        whole = whole or Statistics(n, sum(map(len, words)), own_terms)
        self.half = half_words(max(map(len, words), default=0))
        mean = whole.words / whole.items if whole.items else 1
        idf = {t: math.log(1 + (whole.items - whole.frequency[t] + 0.5) / (whole.frequency[t] + 0.5)) for t in own_terms}
        self.terms = np.array(sorted(own_terms), dtype=np.uint64)
        number = {int(t): i for i, t in enumerate(self.terms)}
        postings: list[list[tuple[int, float]]] = [[] for _ in number]
        for d, w in enumerate(words):
            raw = {t: idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean)) for t, tf in Counter(w.tolist()).items()}
            own = sum(raw.values())
            for t, x in raw.items():
                postings[number[t]].append((d, x / own))
        self.docs = [[d for d, _ in p] for p in postings]
        self.impacts = [[x for _, x in p] for p in postings]
        self.most = [max(x) for x in self.impacts]
        self.blocks = -(-n // BLOCK)
        block_max = []
        for d, x in zip(self.docs, self.impacts, strict=True):
            best: dict[int, float] = {}
            for a, b in zip(d, x, strict=True):
                best[a // BLOCK] = max(best.get(a // BLOCK, 0.0), b)
            block_max.append(best)
        self.block_max = block_max
        # long lists that together can give no item more than LIGHT_SHARE: their most is added to every bound
        light_sum, self.light = np.zeros(n), np.zeros(len(postings), dtype=bool)
        for t in sorted(range(len(postings)), key=lambda t: -len(self.docs[t])):
            more = light_sum.copy()
            more[self.docs[t]] += self.impacts[t]
            if more.max() > LIGHT_SHARE:
                break
            light_sum, self.light[t] = more, True
        self.light_bound = np.array([light_sum[k * BLOCK : (k + 1) * BLOCK].max() for k in range(self.blocks)])
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in block_max])]).astype(np.int64)
        self.block_of = np.array([k for x in block_max for k in x], dtype=np.int64)
        self.bound_of = np.array([v for x in block_max for v in x.values()])

    def numbers(self, h: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.terms, h)
        i[i == len(self.terms)] = 0
        return np.where(self.terms[i] == h, i, -1)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: (item, score) of all items at or above the threshold for distinct terms."""
        end = len(self.ids)
        lists = [[self.docs[t][0], 0, t] for t in terms]  # current item, place, term
        found = []
        while lists:
            lists.sort()
            total, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(lists):
                total += self.most[t]
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.block_max[t].get(block, 0.0) for _, _, t in lists[: pivot + 1]) >= threshold:
                if lists[0][0] == item:
                    score = sum(self.impacts[t][p] for _, p, t in lists[: pivot + 1])
                    if score >= threshold:
                        found.append((item, score))
                    to = item + 1
                else:
                    to = item
            else:  # nothing of the block reaches the threshold without lists behind the pivot
                to = min((block + 1) * BLOCK, lists[pivot + 1][0] if pivot + 1 < len(lists) else end)
                to = max(to, item + 1) if lists[0][0] == item else max(to, item)
                if to == item:
                    to = item + 1
            for x in lists[: pivot + 1]:
                docs, p = self.docs[x[2]], x[1]
                while p < len(docs) and docs[p] < to:
                    p += 1
                x[0], x[1] = (docs[p] if p < len(docs) else end), p
            lists = [x for x in lists if x[0] < end]
        return found


def _retrieve(index: Index, words: Words, threshold: float) -> list[tuple[int, int, int, float]]:
    """(document, first word of passage in it, item, score) of all passages."""
    half = index.half
    term = index.numbers(words.hashes(lower=True))
    doc = words.doc()
    halves = np.maximum(1, -(-words.counts // half))
    first_half = np.concatenate([[0], np.cumsum(halves)])
    known = np.flatnonzero(term >= 0)
    if not len(known):
        return []
    at = first_half[doc[known]] + (known - words.first[doc[known]]) // half
    t = term[known]
    # a term counts once in a half-passage
    pairs = np.unique(at * len(index.terms) + t)
    at, t = pairs // len(index.terms), pairs % len(index.terms)
    heavy = ~index.light[t]
    heavy_at, heavy_t = at[heavy], t[heavy]
    found, step = [], max(2, CELLS // max(1, index.blocks))
    home = np.repeat(np.arange(len(halves)), halves)
    for a in range(0, int(first_half[-1]), step):
        b = min(a + step, int(first_half[-1]) - 1) + 1  # one half more: passages overlap
        i, j = np.searchsorted(heavy_at, (a, b))
        if i == j:
            continue
        own = heavy_t[i:j]
        n = index.start[own + 1] - index.start[own]
        where = np.repeat(index.start[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        cell = np.repeat((heavy_at[i:j] - a) * index.blocks, n) + index.block_of[where]
        bound = np.bincount(cell, weights=index.bound_of[where], minlength=(b - a) * index.blocks).reshape(b - a, index.blocks)
        both = bound + index.light_bound
        both[:-1] += np.where((home[a : b - 1] == home[a + 1 : b])[:, None], bound[1:], 0)
        for h in np.flatnonzero(both.max(axis=1) >= threshold - 1e-9).tolist():
            p = a + h
            if p >= a + step:
                continue
            last = p + 2 if p + 1 < len(home) and home[p + 1] == home[p] else p + 1
            x, y = np.searchsorted(at, (p, last))
            d = int(home[p])
            start = (p - int(first_half[d])) * half
            found.extend((d, start, item, score) for item, score in index.search(np.unique(t[x:y]).tolist(), threshold))
    return found


def _matches(indexes, threshold: float, overlap: float):
    """(document, item) with score, overlaps, first word and passage length of the best passage that counts."""

    def rows(batch, buf, bounds):
        words = Words(buf, bounds, ALNUM)
        best: dict[tuple[int, int], tuple] = {}
        for index in indexes.value:
            if not len(words) or not index.ids:
                continue
            hits = _retrieve(index, words, threshold)
            hashes = words.hashes(lower=True) if hits else None
            grams: dict[tuple[int, int], set] = {}
            for d, start, item, score in hits:
                if (d, start) not in grams:
                    a, n = int(words.first[d]), int(words.counts[d])
                    own = hashes[a + max(0, start - index.half) : a + min(n, start + 3 * index.half)]
                    grams[d, start] = {g for size in range(1, GRAM + 1) for g in zip(*(own[k:].tolist() for k in range(size)), strict=False)}
                near = grams[d, start]
                question, answer = (sum(g in near for g in part) / max(1, len(part)) for part in index.parts[item])
                key = d, index.ids[item]
                if question >= overlap and answer >= overlap and (score, -start) > best.get(key, (0.0,))[:2]:
                    best[key] = (score, -start, question, answer, 2 * index.half)
        return best

    return rows


def _pairs(indexes, threshold: float, overlap: float):
    rows = _matches(indexes, threshold, overlap)

    def run(batches):
        for batch, buf, bounds in slices(batches, most=SLICE):
            best = rows(batch, buf, bounds)
            if best:
                ids = batch.column("doc_id").to_pylist()
                out = [(ids[d], item, s, q, a, -start, n) for (d, item), (s, start, q, a, n) in sorted(best.items())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def _clean(indexes, threshold: float, overlap: float):
    rows = _matches(indexes, threshold, overlap)

    def run(batches):
        for batch, buf, bounds in slices(batches, most=SLICE):
            bad = {d for d, _ in rows(batch, buf, bounds)}
            yield batch.filter(pa.array([d not in bad for d in range(batch.num_rows)], pa.bool_()))

    return run


def _item_terms(batches):
    """A row for each text with words (its key, words and bytes), and one for each of its distinct terms."""
    for batch, buf, bounds in slices(batches, most=SLICE):
        words = Words(buf, bounds, ALNUM)
        h = words.hashes(lower=True).view(np.int64)
        doc = words.doc()
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        first = np.ones(len(h), dtype=bool)
        first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        some = np.flatnonzero(words.counts)
        key = batch.column("key").to_numpy(zero_copy_only=False)
        n = int(first.sum())
        none = lambda x, k: pa.array(x, mask=np.full(len(x), k))
        term = pa.concat_arrays([none(h[first], False), none(np.zeros(len(some), dtype=np.int64), True)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key[doc[first]], key[some]])), term, pa.array(np.concatenate([np.zeros(n, dtype=np.int64), words.counts[some]])), pa.array(np.concatenate([np.zeros(n, dtype=np.int64), np.diff(bounds)[some]]))], names=["key", "term", "words", "bytes"])


def _indexes(docs: DataFrame, items: DataFrame) -> list:
    """Broadcast lists of indexes over the distinct texts (key, text); an index is of one length class, and a list's
    texts have about SHARD_BYTES."""
    bounded_batches(docs.sparkSession)
    terms = cut(items.mapInArrow(_item_terms, "key long, term long, words long, bytes long"))
    doubled = F.greatest(F.lit(0), F.ceil(F.log2(F.col("words") / HALF_WORDS))).cast("int").alias("length")
    sizes = terms.where("term is null").select("key", "words", "bytes", doubled)
    classes = sizes.groupBy("length").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.sum("words").alias("words")).collect()  # one row for each doubling
    if not classes:
        return []
    shards = {r["length"]: -(-r["bytes"] // SHARD_BYTES) for r in classes}
    n, words = sum(r["n"] for r in classes), sum(r["words"] for r in classes)
    many = F.create_map(*(F.lit(x) for p in shards.items() for x in p))[F.col("length")]
    home = small(cut(sizes.select("key", "length", F.pmod(F.xxhash64("key"), many).cast("int").alias("shard"))))
    items = cut(items.join(home, "key"))
    terms = terms.where("term is not null")
    terms = cut(terms.join(home, "key").select("length", "shard", "term").distinct().join(terms.groupBy("term").agg(F.count("*").alias("n")), "term"))
    context = docs.sparkSession.sparkContext
    lists, waiting, room = [], [], SHARD_BYTES  # the driver holds one list's indexes at a time
    for r in sorted(classes, key=lambda r: r["length"]):
        for k in range(shards[r["length"]]):
            here = (F.col("length") == r["length"]) & (F.col("shard") == k)
            held = terms.where(here).select("term", "n").toArrow()
            counts = dict(zip(held.column("term").to_numpy().view(np.uint64).tolist(), held.column("n").to_numpy().tolist(), strict=True))
            index = Index([(x["key"], x["text"]) for x in items.where(here).select("key", "text").orderBy("key").collect()], Statistics(n, words, counts))
            size = r["bytes"] / shards[r["length"]]
            if waiting and room < size:
                lists.append(context.broadcast(waiting))
                waiting, room = [], SHARD_BYTES
            waiting.append(index)
            room -= size
    return [*lists, context.broadcast(waiting)]


def _texts(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables of the distinct texts (key, text) and of the items that have them (key, item_id)."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("key")).where("text is not null")
    return cut(rows.groupBy("key").agg(F.first("text").alias("text"))), cut(rows.select("key", "item_id").distinct())


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, first_word, passage_words: documents that hold items."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts, items = _texts(benchmark)
    out = docs.sparkSession.createDataFrame([], RESULT)
    for indexes in _indexes(docs, texts):
        out = out.union(source.mapInArrow(_pairs(indexes, threshold, overlap), RESULT))
    found = out.withColumnRenamed("item_id", "key").join(small(items), "key")
    return found.select(*(x.split()[0] for x in RESULT.split(", ")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """docs without the rows that hold an item."""
    for indexes in _indexes(docs, _texts(benchmark)[0]):
        docs = docs.mapInArrow(_clean(indexes, threshold, overlap), docs.schema)
    return docs
