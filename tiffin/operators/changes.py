"""Change capture by content: which source rows are new, differ from the stored row of their key, or equal it.

A watermark never sees a row that changes under an unchanged timestamp (an order
whose status moves on). Here every stored row carries a digest of its columns;
source and target meet on key and digest alone, so the target side is two narrow
columns, read bucket by bucket where the table is bucketed by the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGEST = "_row_digest"


def row_digest(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> Column:
    """64-bit digest of the columns that are not keys, by name, nulls told apart from values (a change is missed with
    probability 2^-64)."""
    names = sorted(c for c in (columns or df.columns) if c not in keys and c != DIGEST)
    # A null column leaves a hash as it is, so each column is preceded by whether it is null, and by its name.
    return F.xxhash64(*[x for c in names for x in (F.lit(c), F.col(c).isNull(), F.col(c))]) if names else F.lit(0).cast("long")


def with_digest(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn(DIGEST, row_digest(df, keys))


def classify(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """``source`` with its digest and ``change``: insert (no row of the key), update (differs) or unchanged.

    ``target`` holds the digest column of an earlier run. A column new in the source makes every row differ once.
    Keys that left the source are not reported: a merge keeps their rows. A row with a null key has no
    counterpart by key; it is unchanged if the target holds an equal row with a null key, else an insert. A key that
    repeats in the target counts as unchanged if one of its rows is equal.
    """
    new = with_digest(source, keys)
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    # One row per (key, digest) of the target meets each source row; equal keys are in the same bucket.
    stored = target.where(~null_key).groupBy(*keys).agg(F.collect_set(DIGEST).alias("_stored"))
    by_key = new.where(~null_key).join(stored, keys, "left").select(
        *new.columns, F.when(F.col("_stored").isNull(), "insert").when(F.array_contains("_stored", F.col(DIGEST)), "unchanged")
        .otherwise("update").alias("change"))
    same = target.where(null_key).select(DIGEST, *[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_same", F.lit(True))
    on = F.col("n." + DIGEST) == F.col("t." + DIGEST)
    for k in keys:
        on = on & F.col(f"n.{k}").eqNullSafe(F.col(f"t._{k}"))
    without = new.where(null_key).alias("n").join(same.alias("t"), on, "left").select(
        *[F.col(f"n.{c}") for c in new.columns], F.when(F.col("_same"), "unchanged").otherwise("insert").alias("change"))
    return by_key.unionByName(without)
