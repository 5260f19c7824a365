"""HyperMinHash near-duplicate detection: compressed registers, banding, corrected estimate, exact check.

A document's set is its distinct word shingles. Every distinct set is sketched
once; sets that may be similar are found through bands of registers, thinned by
the collision-corrected Jaccard estimate and confirmed on the full sets. Groups
are found without listing their pairs:

1. every member of a band bucket is compared with one leader of the bucket;
2. the confirmed links are contracted to components;
3. in buckets that still hold several components, members outside the largest
   one look for components they resemble (registers only, in blocks), and each
   (member, component) found is checked on full sets, in blocks of the
   component, stopping at the first link.

A pair that could join two components is never skipped; pairs inside one
component are, because they cannot change it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tiffin.session import session_settings

from .common import batch_settings, connected_components, stage

#: Sketch layout: 2**P buckets, R mantissa bits. Banding: BANDS bands of ROWS registers.
#: A pair of Jaccard j misses every band with probability (1 - j**4)**24: 2e-8 at 0.85, 3e-6 at 0.8.
P, R = 7, 10
BUCKETS = 1 << P
BANDS, ROWS = 24, 4
#: A pair goes on to the exact check if its estimate is within this many standard errors of the threshold.
SIGMAS = 5.5
#: Rows of one block in the blockwise comparisons.
BLOCK = 1024
#: Words remembered by a worker before its memory is emptied.
REMEMBERED = 200_000

_U = np.uint64
_MIX = (_U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))


class _WordHash(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX[1]
    x = (x ^ (x >> _U(27))) * _MIX[2]
    return x ^ (x >> _U(31))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a UTF-8 text; ``bytes.split`` cuts exactly at [\\x20\\x09-\\x0D]."""
    words = text.lower().split() if text else []   # bytes.lower changes A-Z only
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(_HASHES.__getitem__, words), _U, len(words))
    k = min(width, len(h))
    acc = np.full(len(h) - k + 1, _U(k))
    for j in range(k):
        acc = _mix(acc * _MIX[0] + h[j:len(h) - k + 1 + j])
    return np.unique(acc)


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers: per bucket (leading zeros + 1) and R mantissa bits of the least hash; 0 if empty."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(hashes):
        bucket = (hashes >> _U(64 - P)).astype(np.int64)      # hashes are sorted, so a bucket's least comes first
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        rest = hashes[first] << _U(P)
        _, bits = np.frexp((rest >> _U(11)).astype(np.float64))   # 53 bits: exact in a double
        zeros = 53 - bits
        mantissa = (rest << (zeros + 1).astype(_U)) >> _U(64 - R)
        out[bucket[first]] = ((zeros + 1) << R) | mantissa.astype(np.int64)
    return out


_BORROW = np.stack([np.random.default_rng(17 + j).permutation(BUCKETS) for j in range(BUCKETS)])


def bands(regs: np.ndarray) -> np.ndarray:
    """Band keys. Empty registers borrow from the first full one in a fixed order of their own (densification)."""
    full = regs > 0
    if not full.all():
        regs = np.where(full, regs, regs[_BORROW[np.arange(BUCKETS), full[_BORROW].argmax(axis=1)]])
    rows = regs[:BANDS * ROWS].reshape(BANDS, ROWS).astype(_U)
    key = np.arange(BANDS, dtype=_U)
    for j in range(ROWS):
        key = _mix(key * _MIX[0] + rows[:, j])
    return key.view(np.int64)


def estimate(one: np.ndarray, n_one: int, many: np.ndarray, n_many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard of ``one`` with each row of ``many``, and the registers compared.

    Registers of disjoint sets agree by chance when both minima fall into one
    cell of the (exponent, mantissa) grid; with loads a and b that has
    probability 2**-R / (2 ln 2) * ab / (a + b)**2 per bucket.
    """
    used = ((many > 0) | (one > 0)).sum(axis=1)
    same = ((many == one) & (many > 0)).sum(axis=1)
    a, b = float(n_one), n_many.astype(float)
    chance = used * (a * b / (a + b) ** 2) * 2.0 ** -R / (2 * math.log(2))
    return (same - chance) / np.maximum(used - chance, 1e-9), used


def promising(one, n_one, many, n_many, percent: int) -> np.ndarray:
    """Rows of ``many`` that the sizes and the estimate leave as possible partners of ``one``."""
    sizes = 100 * np.minimum(n_one, n_many) >= percent * np.maximum(n_one, n_many)
    est, used = estimate(one, n_one, many, n_many)
    t = percent / 100
    return sizes & (est >= t - SIGMAS * np.sqrt(t * (1 - t) / np.maximum(used, 1)))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


# ------------------------------------------------------------------ tasks
def _forgetting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``; at their end the worker forgets its words, so it holds none while it does other work."""
    try:
        yield from batches
    finally:
        _HASHES.clear()


def _sketch(width):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _forgetting(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            n, digest, regs, keys = [], [], [], []
            for text in texts:
                s = shingles(text, width)
                n.append(len(s))
                if len(s):
                    r = registers(s)
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    regs.append(r.tobytes())
                    keys.append(bands(r).tolist())
                else:
                    digest.append(None), regs.append(None), keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "regs", "bands"])
    return run


def _sets(width):
    def run(batches):
        for batch in _forgetting(batches):
            sets = [shingles(t, width).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sets, pa.binary())], names=["id", "shingles"])
    return run


def _estimate_pairs(percent):
    def run(batches):
        for b in batches:
            keep = [bool(promising(np.frombuffer(ra, np.uint16), na, np.frombuffer(rb, np.uint16)[None], np.array([nb]), percent)[0])
                    for ra, na, rb, nb in zip(*(b.column(c).to_pylist() for c in ("ra", "na", "rb", "nb")))]
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], names=["a", "b"])
    return run


def _check_pairs(percent):
    def run(batches):
        for b in batches:
            sa, sb = b.column("sa").to_pylist(), b.column("sb").to_pylist()
            keep = pa.array([similar(np.frombuffer(x, _U), np.frombuffer(y, _U), percent) for x, y in zip(sa, sb)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])
    return run


def _matrix(col, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(col), dtype).reshape(len(col), -1)


def _components_near(percent):
    """One block of a bucket: (asking member, component) for every component with a promising row in the block.

    A pair is looked at in the first band that its two members share, and once:
    of two members that both ask, the one of the larger component does.
    """
    def run(pdf):
        import pandas as pd
        here, ask = pdf[~pdf["asks"]], pdf[pdf["asks"]]
        out = []
        if len(here):
            regs, n, comp = _matrix(here["regs"], np.uint16), here["n"].to_numpy(), here["comp"].to_numpy()
            keys, minor, band = np.stack(here["bands"].to_list()), here["minor"].to_numpy(), int(pdf["band"].iloc[0])
            for rid, c, r, k, own in zip(ask["id"], ask["comp"], ask["regs"], ask["n"], ask["bands"]):
                other = np.flatnonzero((comp != c) & (~minor | (comp < c)))
                other = other[(keys[other] == own).argmax(axis=1) == band]
                if len(other):
                    hit = other[promising(np.frombuffer(r, np.uint16), k, regs[other], n[other], percent)]
                    out += [(rid, c, x) for x in np.unique(comp[hit])]
        return pd.DataFrame(out, columns=["id", "own", "comp"]).astype("int64")
    return run


def _first_links(percent):
    """One block of a component: per asking document the first confirmed link into it, most promising row first."""
    def run(pdf):
        import pandas as pd
        here, ask = pdf[~pdf["asks"]], pdf[pdf["asks"]]
        out = []
        if len(here):
            regs, n = _matrix(here["regs"], np.uint16), here["n"].to_numpy()
            sets = [np.frombuffer(x, _U) for x in here["shingles"]]
            for own, comp, r, k, s in zip(ask["own"], ask["comp"], ask["regs"], ask["n"], ask["shingles"]):
                r, s = np.frombuffer(r, np.uint16), np.frombuffer(s, _U)
                rows = np.flatnonzero(promising(r, k, regs, n, percent))
                for j in rows[np.argsort(-estimate(r, k, regs[rows], n[rows])[0], kind="stable")]:
                    if similar(s, sets[j], percent):
                        out.append((own, comp))
                        break
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")
    return run


# ------------------------------------------------------------------ operator
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Links: 100 * intersection >= percent * union of the shingle sets (``width`` words)
    of the whole texts (A-Z lower-cased). Null, empty and blank texts have an empty
    set and link with nothing. Fewer words than ``width`` form one shingle. Rows without
    an id link with nothing, get a null component and stay. Rows that repeat an id
    share its vertex. Ids are integers. Columns other than the two named are not read.
    """
    # All Python work runs in here: what is returned only joins staged tables.
    with session_settings(docs.sparkSession, batch_settings(docs.sparkSession)):
        return _near_duplicates(docs, id_col, text_col, percent, width)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, percent: int, width: int) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    sketch = stage(docs.mapInArrow(_sketch(width), "doc_id long, n_shingles long, digest binary, regs binary, bands array<long>"), "mh-sketch")
    known = sketch.where("doc_id IS NOT NULL AND digest IS NOT NULL")

    # One representative per distinct set: copies never meet the comparisons below.
    classes = stage(known.groupBy("digest").agg(F.min("doc_id").alias("id")), "mh-classes")
    reps = stage(known.withColumnRenamed("doc_id", "id").join(classes, ["digest", "id"], "left_semi")
                 .dropDuplicates(["digest", "id"]).select("id", F.col("n_shingles").alias("n"), "regs", "bands"), "mh-reps")
    rows = reps.select("id", F.posexplode("bands").alias("band", "key"))
    leads = stage(rows.groupBy("band", "key").agg(F.min("id").alias("lead"), F.count("*").alias("size")).where("size > 1"), "mh-leads")
    member = stage(rows.join(leads, ["band", "key"]), "mh-members")   # only buckets that hold two sets or more

    # Full sets of the bucket members: the only sets any exact check below can ask for.
    sets = stage(_text_sets(docs, member.select("id").distinct(), width), "mh-sets")

    # 1. Members against the leader of their bucket.
    pairs = member.where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    slim = reps.select("id", "n", "regs")
    side = lambda x: slim.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    likely = stage(pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_estimate_pairs(percent), "a long, b long"), "mh-likely")
    first = stage(_verified(sets, likely, percent), "mh-links")

    # 2. Components of the confirmed links.
    comps = stage(connected_components(first).select(F.col("node").alias("id"), F.col("component").alias("comp")), "mh-comps")

    # 3. Buckets that still hold several components.
    placed = member.where("size > 2").select("band", "key", "id").join(comps, "id", "left") \
        .select("band", "key", "id", F.coalesce("comp", "id").alias("comp"))
    per = placed.groupBy("band", "key", "comp").agg(F.count("*").alias("c"))
    mixed = stage(per.groupBy("band", "key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("size"), F.count("*").alias("comps"))
                  .where("comps > 1").select("band", "key", F.col("top.comp").alias("major"), "size", (F.col("size") - F.col("top.c")).alias("asking")), "mh-mixed")
    found = _cross_links(sets, slim, reps.select("id", "bands"), stage(placed.join(mixed, ["band", "key"]), "mh-mixed-rows"), comps, percent)
    merged = connected_components(found).select(F.col("node").alias("comp"), F.col("component").alias("root"))

    comp_of = classes.join(comps, "id", "left").select("digest", F.coalesce("comp", "id").alias("comp")) \
        .join(merged, "comp", "left").select("digest", F.coalesce("root", "comp").alias("class_component"))
    out = sketch.select("doc_id", "n_shingles", "digest").join(stage(comp_of, "mh-class-components"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _text_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the documents whose id is in ``ids``, one row per id."""
    return docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_sets(width), "id long, shingles binary")


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_check_pairs(percent), "a long, b long")


def _cross_links(sets, slim, keys, placed, comps, percent) -> DataFrame:
    """(component, component) links between components that share a band bucket."""
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int")
    spread = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), blocks(n)).cast("int")
    rows = placed.join(slim.join(keys, "id"), "id").withColumn("minor", F.col("comp") != F.col("major"))
    here = rows.select("band", "key", spread("size", 1).alias("blk"), F.explode(F.sequence(F.lit(0), blocks("asking") - 1)).alias("chunk"),
                       "id", "comp", "n", "regs", "bands", "minor", F.lit(False).alias("asks"))
    ask = rows.where("minor").select("band", "key", F.explode(F.sequence(F.lit(0), blocks("size") - 1)).alias("blk"),
                                             spread("asking", 2).alias("chunk"), "id", "comp", "n", "regs", "bands", "minor", F.lit(True).alias("asks"))
    near = stage(here.unionAll(ask).groupBy("band", "key", "blk", "chunk")
                 .applyInPandas(_components_near(percent), "id long, own long, comp long").distinct(), "mh-near")

    # The components asked for, in blocks, with their full sets; each is sent once per chunk of askers.
    asked = near.groupBy("comp").agg(F.count("*").alias("asking"))
    members = slim.select("id").join(comps, "id", "left").select("id", F.coalesce("comp", "id").alias("comp")) \
        .join(asked, "comp")
    members = stage(members, "mh-asked")
    sizes = members.groupBy("comp").agg(F.count("*").alias("size"))
    needed = members.select("id").unionAll(near.select("id")).distinct()
    sets = stage(sets.join(needed, "id", "left_semi").join(slim, "id"), "mh-asked-sets")
    here = members.join(sizes, "comp").join(sets, "id").select(
        "comp", spread("size", 1).alias("blk"), F.explode(F.sequence(F.lit(0), blocks("asking") - 1)).alias("chunk"),
        F.col("comp").alias("own"), "n", "regs", "shingles", F.lit(False).alias("asks"))
    ask = near.join(asked, "comp").join(sizes, "comp").join(sets, "id").select(
        "comp", F.explode(F.sequence(F.lit(0), blocks("size") - 1)).alias("blk"), spread("asking", 2).alias("chunk"),
        "own", "n", "regs", "shingles", F.lit(True).alias("asks"))
    return here.unionAll(ask).groupBy("comp", "blk", "chunk").applyInPandas(_first_links(percent), "a long, b long").distinct()
