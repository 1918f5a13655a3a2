"""Language identification with hyperdimensional profiles.

Every letter has a random vector of DIMENSIONS signs. The vector of a letter trigram binds (multiplies) its letters'
vectors, rotated by their place; a text's vector bundles (adds) the vectors of its trigrams, and a language's prototype
bundles all its training texts. A text gets the language with the largest cosine, ties to the smaller name.

Letters are Unicode letters, lower-cased: a to z, and all others dealt over further symbols by a fixed hash; runs of
anything else are one gap. Prototypes are sums of integers over all training rows, so they are the same in any order.

Edge cases: a text that is null or has no letter is `und` with score 0; without training rows every text is `und`;
a null doc_id is predicted and teaches nothing; repeated rows are predicted one by one.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.store import bounded_batches
from quillon.llm.textkern import seeded, slices

DIMENSIONS = 512
#: 0 is the gap, 1 to 26 are a to z, the rest stand for other letters.
SYMBOLS = 128
#: Text bytes of one call, trigrams that are bundled at once, and trigrams that wait for it in training.
SLICE, BUNDLE, WAITING = 1 << 20, 2048, 1 << 21


@functools.cache
def symbol_table() -> np.ndarray:
    """Of each code point below 0x20000: its symbol. Later code points are other letters by the same hash."""
    points = range(0x20000)
    letter = np.fromiter((chr(c).isalpha() for c in points), dtype=bool, count=len(points))
    lower = np.fromiter((ord(x[0]) if (x := chr(c).lower()) else c for c in points), dtype=np.int64, count=len(points))
    other = 27 + (seeded(31, 1)[0] + lower.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % (SYMBOLS - 27)
    return np.where(~letter, 0, np.where((lower >= 97) & (lower <= 122), lower - 96, other)).astype(np.uint8)


@functools.cache
def letter_vectors() -> np.ndarray:
    """For each place in a trigram and symbol its signs: the symbol's random vector, rotated by the place."""
    letters = 1 - 2 * (np.unpackbits(seeded(32, SYMBOLS * DIMENSIONS // 64).view(np.uint8)).reshape(SYMBOLS, DIMENSIONS).astype(np.int8))
    return np.stack([np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters])


def trigram_vectors(kinds: np.ndarray) -> np.ndarray:
    """The bound signs of each trigram."""
    one, two, three = letter_vectors()
    out = np.take(one, kinds // SYMBOLS**2, axis=0)
    out *= np.take(two, kinds // SYMBOLS % SYMBOLS, axis=0)
    out *= np.take(three, kinds % SYMBOLS, axis=0)
    return out


def bundled(kinds: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of n times each trigram's vector, exact: sums of whole numbers below 2**53."""
    total = np.zeros(DIMENSIONS)
    for a in range(0, len(kinds), BUNDLE):
        part = n[a : a + BUNDLE]
        wide = np.float32 if part.sum() < 1 << 24 else np.float64
        total += part.astype(wide) @ trigram_vectors(kinds[a : a + BUNDLE]).astype(wide)
    return total


def trigrams(text: str) -> np.ndarray:
    """Trigram numbers of a text, with a gap at either end; none if it has no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    table = symbol_table()
    sym = table[np.minimum(points, len(table) - 1)] if not len(points) or points.max() < len(table) else np.where(points < len(table), table[np.minimum(points, len(table) - 1)], 27)
    if not sym.any():
        return np.zeros(0, dtype=np.int64)
    sym = np.concatenate([[0], sym, [0]]).astype(np.int64)
    sym = sym[np.concatenate([[True], (sym[1:] != 0) | (sym[:-1] != 0)])]
    return (sym[:-2] * SYMBOLS + sym[1:-1]) * SYMBOLS + sym[2:]


def text_vector(tri: np.ndarray) -> np.ndarray:
    return bundled(*np.unique(tri, return_counts=True))


def _profiles(batches):
    """Bundles of the task's texts by language; trigrams wait until there are WAITING of all languages together."""
    total: dict[str, np.ndarray] = {}
    waiting: dict[str, list[np.ndarray]] = {}

    def bundle() -> None:
        for lang, lots in waiting.items():
            total[lang] = total.get(lang, 0) + bundled(*np.unique(np.concatenate(lots), return_counts=True))
        waiting.clear()

    held = 0
    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
            tri = trigrams(text.as_py())
            if len(tri):
                waiting.setdefault(lang.as_py(), []).append(tri)
                held += len(tri)
                if held >= WAITING:
                    bundle()
                    held = 0
    bundle()
    for lang, vector in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS, pa.string()), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(np.rint(vector).astype(np.int64))], names=["lang", "place", "value"])


def prototypes(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and unit prototypes from all rows (text, lang)."""
    sums = rows.where("text is not null and lang is not null").select("text", "lang").mapInArrow(_profiles, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    profiles: dict[str, np.ndarray] = {}
    for r in sums.collect():  # DIMENSIONS numbers for each language
        profiles.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["place"]] = r["value"]
    langs = sorted(profiles)
    vectors = np.array([profiles[x] for x in langs]).reshape(-1, DIMENSIONS)
    return langs, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def _predict(model):
    def run(batches):
        langs, vectors = model.value
        for batch, _, _ in slices(batches, most=SLICE):
            names, scores = [], []
            for text in batch.column("text"):
                tri = trigrams(text.as_py()) if text.is_valid else ()
                if len(tri) and langs:
                    v = text_vector(tri)
                    cosine = (vectors * v).sum(axis=1) / max(float(np.linalg.norm(v)), 1e-9)  # equal rows give equal sums
                    best = int(cosine.argmax())
                    names.append(langs[best]), scores.append(float(min(1.0, max(0.0, cosine[best]))))
                else:
                    names.append("und"), scores.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, held_out=None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang); held-out rows teach nothing."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held = held_out if held_out is not None else F.lit(False)
    model = docs.sparkSession.sparkContext.broadcast(prototypes(docs.where(~held)))
    found = docs.select("doc_id", "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
