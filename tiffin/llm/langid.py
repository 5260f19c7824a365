"""Language identification with bit-sliced Bloom filters of character n-grams.

One filter serves all languages: a slot is a bit mask with one bit per language,
so the AND of the slots an n-gram hashes to names every language that contains
it. A document's hits are popcounts per language over its n-grams, corrected
for each language's false-positive rate; the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Lengths of the n-grams (letters of one word and the white space or marks next to them).
ORDERS = (3, 4, 5)
#: Documents learned from, per language: the bound of the training sample (chosen by a hash of the id).
MAX_TRAIN_DOCS = 2000
#: (language, n-gram) pairs in the filter, an equal part for each language: of a language with more, those in fewest of
#: its documents are left out, within the last count by a hash.
MAX_GRAMS = 1_000_000
#: Languages with fewer learnable documents keep the n-grams of single documents.
FEW_DOCS = 20
#: Characters handled at once; a longer text is read in overlapping pieces.
PIECE = 1 << 20

_U = np.uint64


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter (Unicode category L), for all code points."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.where(_letters()[cp], cp, 0), [0]]).astype(_U)


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(_letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of a text, with repeats, piece by piece.

    A window counts if everything but its two ends is a letter, so ends may
    touch a word boundary and no window spans one.
    """
    codes = _codes(text)
    top = max(ORDERS)
    for lo in range(0, len(codes), PIECE):
        part = codes[lo:lo + PIECE + top - 1]
        out, h = [], part * _U(0x9E3779B97F4A7C15)
        inner = np.ones(len(part), bool)
        for n in range(2, top + 1):
            m = min(len(part) - n + 1, PIECE)
            if m <= 0:
                break
            h = (h[:m] ^ (h[:m] >> _U(29))) * _U(0xBF58476D1CE4E5B9) + part[n - 1:n - 1 + m] * _U(0x94D049BB133111EB)
            if n > 2:
                inner = inner[:m] & (part[n - 2:n - 2 + m] > 0)
                if n in ORDERS:
                    g = h[inner]
                    g = (g ^ (g >> _U(31))) * _U(0x94D049BB133111EB) + _U(n)
                    out.append(g ^ (g >> _U(32)))
        if out:
            yield np.concatenate(out)


@dataclass
class BitSlicedFilter:
    """Slots of ``ceil(languages / 8)`` bytes; bit l of a slot is set if an n-gram of language l hashes to it."""

    languages: list[str]
    slots: np.ndarray          # (slots, bytes) uint8
    false_rate: np.ndarray     # per language: chance that an n-gram outside it finds all its bits set

    HASHES = 2

    @classmethod
    def build(cls, languages: list[str], gram: np.ndarray, language: np.ndarray) -> "BitSlicedFilter":
        size = 1 << max(10, int(np.ceil(np.log2(8 * max(1, len(gram))))))
        slots = np.zeros((size, -(-max(1, len(languages)) // 8)), np.uint8)
        gram = gram.astype(np.int64).view(_U)
        for at in cls._places(gram, size):
            np.bitwise_or.at(slots, (at, language // 8), (1 << (language % 8)).astype(np.uint8))
        filled = np.array([((slots[:, i // 8] >> (i % 8)) & 1).mean() for i in range(len(languages))])
        return cls(languages, slots, filled ** cls.HASHES)

    @classmethod
    def _places(cls, gram: np.ndarray, size: int):
        for k in range(cls.HASHES):
            yield ((gram >> _U(32 * k)) & _U(size - 1)).astype(np.int64)

    def hits(self, gram: np.ndarray) -> np.ndarray:
        """n-grams found, per language: byte histograms of the masks, then popcounts by bit."""
        a, b = (self.slots[p] for p in self._places(gram, len(self.slots)))
        masks = a & b
        out = []
        for byte in range(masks.shape[1]):
            histogram = np.bincount(masks[:, byte], minlength=256)
            out += [histogram[_BIT[bit]].sum() for bit in range(8)]
        return np.array(out[:len(self.languages)], np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text):
            return "und", 0.0
        if not self.languages:
            return "und", 0.0
        total, hits = 0, np.zeros(len(self.languages), np.int64)
        for g in grams(text):
            total += len(g)
            hits += self.hits(g)
        if not total:
            return self.languages[0], 0.0
        share = (hits - total * self.false_rate) / (total * np.maximum(1 - self.false_rate, 1e-9))
        best = int(np.argmax(share))
        return self.languages[best], float(min(1.0, max(0.0, share[best])))


_BIT = [np.array([v for v in range(256) if v >> bit & 1]) for bit in range(8)]


def _count(batches):
    """(language, n-gram, documents), summed within each batch."""
    for b in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = [np.unique(g) for g in grams(text)]
            if found:
                by.setdefault(lang, []).append(found[0] if len(found) == 1 else np.unique(np.concatenate(found)))
        for lang, lists in by.items():
            g, n = np.unique(np.concatenate(lists), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n, pa.int64())],
                                             names=["lang", "gram", "docs"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          max_docs: int = MAX_TRAIN_DOCS, max_grams: int = MAX_GRAMS) -> BitSlicedFilter:
    """Fit a filter on at most about ``max_docs`` documents per language, picked by a hash of the id.

    Null texts and languages are not learned from. The n-grams that reach the
    driver are bounded by ``max_grams``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return BitSlicedFilter.build([], np.empty(0, np.int64), np.empty(0, np.int64))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, max_docs / n))).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).where("text IS NOT NULL").select("lang", "text")
    counts = picked.mapInArrow(_count, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    # An n-gram of one document says little, unless its language has few documents to show.
    few = [x for x, n in sizes.items() if n < FEW_DOCS]
    from .common import stage
    counts = stage(counts.where((F.col("docs") >= 2) | F.col("lang").isin(few)), "lang-grams")
    classes: dict[str, list[tuple[int, int]]] = {}
    for r in counts.groupBy("lang", "docs").count().collect():           # at most max_docs counts a language
        classes.setdefault(r["lang"], []).append((r["docs"], r["count"]))
    room, kept_rows = max_grams // len(sizes), F.lit(False)
    for lang, found in classes.items():
        least, part, left = 0, 0.0, room
        for docs_n, n in sorted(found, reverse=True):
            if n > left:
                least, part = docs_n, left / n
                break
            left -= n
        here = (F.col("docs") > least) | ((F.col("docs") == least) & (F.pmod(F.xxhash64("gram"), F.lit(1_000_000)) < part * 1_000_000))
        kept_rows = kept_rows | ((F.col("lang") == lang) & here)
    member = counts.where(kept_rows).select("gram", "lang")
    names = sorted(sizes)
    found = member.toArrow().to_pandas()
    number = {x: i for i, x in enumerate(names)}
    return BitSlicedFilter.build(names, found["gram"].to_numpy(np.int64), found["lang"].map(number).to_numpy(np.int64))


def identify(docs: DataFrame, model: BitSlicedFilter, text_col: str = "text",
             pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score (share of n-grams of that language, 0 to 1).

    Only the text decides. Null texts and texts without a letter get ``und`` and
    0; equal shares go to the first language by name. All other columns pass
    through; input columns named like the new ones are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in (pred_col.lower(), score_col.lower())])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        filt = shared.value
        for b in batches:
            said = [filt.predict(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(b.columns + [pa.array([x for x, _ in said], pa.string()), pa.array([y for _, y in said], pa.float64())],
                                             names=b.schema.names + [pred_col, score_col])

    from pyspark.sql import types as T
    schema = T.StructType(docs.schema.fields + [T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0; false for a null id (such rows are not learned from either)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(F.col(id_col).isNotNull() & ~held_out(id_col))
