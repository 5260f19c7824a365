"""Rows whose key is not in a table of finished keys, with a Bloom filter ahead of the anti join.

Most rows of a day are new. A filter over the finished keys, tested where a row is
read, lets a row that cannot be a repeat pass at once; only possible repeats are
shuffled, and the anti join decides among them, so the result is exact whatever the
filter says. The rows are computed and tested once, and staged with the answer. The filter never has more than ``max_bits`` bits (32 MiB): with ever
more finished keys it fills up and more rows go through the join, down to a plain
anti join, with no other path to switch to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: Bits a finished key (about 1 % of new rows take the join), and the greatest filter: what the driver holds and sends.
BITS_PER_KEY, MAX_BITS = 10, 1 << 28


class KeyFilter:
    """A Bloom filter of the non-null values of ``done``'s column ``key``, built from one count and one grouped job."""

    def __init__(self, done: DataFrame, key: str, max_bits: int = MAX_BITS):
        if max_bits < 64 or max_bits & (max_bits - 1):
            raise ValueError("max_bits: a power of two, 64 at least")
        keys = done.where(F.col(key).isNotNull()).select(key)
        n = keys.count()
        self.kind = done.schema[key].dataType
        self.bits = min(max_bits, 1 << max(6, math.ceil(math.log2(max(1, n * BITS_PER_KEY)))))
        self.hashes = max(2, min(8, round(self.bits / max(1, n) * math.log(2))))
        # Words of 64 bits, or-ed before the shuffle: at most bits / 64 rows leave a task or reach the driver.
        at = F.explode(F.array(*[self._place(F.col(key), i) for i in range(self.hashes)]))
        words = (keys.select(at.alias("at")).groupBy(F.expr("at div 64").alias("word"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask")))
        found = words.toArrow()
        filled = np.zeros(self.bits // 64, dtype=np.int64)
        filled[found["word"].to_numpy()] = found["mask"].to_numpy()
        self.shared = done.sparkSession.sparkContext.broadcast(filled.view(np.uint64))

    def _place(self, key: Column, i: int) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.kind), F.lit(i)), F.lit(self.bits))

    def maybe(self, key: Column) -> Column:
        """False: the key is surely not among the finished ones (a null never is)."""
        shared, hashes = self.shared, self.hashes

        @F.pandas_udf("boolean")
        def test(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            words = shared.value
            for places in batches:
                hit = np.ones(len(places[0]), dtype=bool)
                for p in places:
                    at = p.to_numpy(np.uint64)
                    hit &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
                yield pd.Series(hit)

        return test(*[self._place(key, i) for i in range(hashes)]) & key.isNotNull()


def rows_with_new_keys(rows: DataFrame, done: DataFrame, key: str, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows of ``rows`` whose ``key`` is not in ``done``; equal to a left anti join, repeated and null keys included.

    The keys of both sides are compared as the type they have in ``done``, so they should have one type.
    """
    if rows.schema[key].dataType != done.schema[key].dataType:
        raise TypeError(f"{key}: {rows.schema[key].dataType.simpleString()} against {done.schema[key].dataType.simpleString()}")
    # As a column of staged rows, the test runs once a row: a filter above a join would be inferred for
    # the rows of its other side too, and each half of the union would compute the rows anew.
    spark = rows.sparkSession
    staged = scratch_path(spark, "tested-keys")
    rows.withColumn("_maybe", KeyFilter(done, key, max_bits).maybe(F.col(key))).write.option("compression", "zstd").parquet(staged)
    tested = spark.read.parquet(staged)
    sure = tested.where(~F.col("_maybe")).drop("_maybe")
    possible = tested.where(F.col("_maybe")).drop("_maybe")
    return sure.unionByName(possible.join(done.select(key), key, "left_anti").select(*rows.columns))
