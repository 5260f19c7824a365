"""First n rows by an order, and fixed-size samples (L2-L4), by a threshold.

The order key is read as a sequence of 64-bit digits. Histograms of one digit,
refined around the place where the n-th row lies, give the exact value at which
the first n rows end; then the next digit decides among rows equal so far. The
result is the table under one filter: nothing is sorted, no task gathers rows,
and any n takes the same way. A round reads the key columns once and sends
``BINS`` counts to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: Bins of one histogram.
BINS = 4096
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


def _digits(name: str, kind: T.DataType, longest) -> Iterator[Column]:
    """Long columns whose order, one after the other, is the ascending order of the column, nulls last.

    ``longest()`` is asked for the longest string only if a string's first digits leave a tie.
    """
    c = F.col(name)
    yield c.isNull().cast("long")
    if isinstance(kind, _WHOLE):
        yield c.cast("long")
    elif isinstance(kind, T.DateType):
        yield F.unix_date(c).cast("long")
    elif isinstance(kind, T.TimestampType):
        yield F.unix_micros(c)
    elif isinstance(kind, T.TimestampNTZType):
        yield F.unix_micros(F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone()))
    elif isinstance(kind, T.DecimalType):
        whole = F.floor(c)
        yield whole.cast("long")
        yield ((c - whole) * 10 ** kind.scale).cast("long")
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        at, end = 0, None
        while at == 0 or at < end:
            # Six bytes at a time, short strings filled up; the byte count decides between "a" and "a\\0".
            part = F.rpad(F.hex(F.substring(c.cast("binary"), at + 1, 6)), 12, "0")
            yield F.conv(part, 16, 10).cast("long")
            end = longest(c) if end is None else end
            at += 6
        yield F.octet_length(c).cast("long")
    else:
        raise TypeError(f"no order by digits for {kind.simpleString()}")


def first_n(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows by ``order`` (ascending, nulls last), exactly, for any ``n``.

    ``order`` holds integers, dates, timestamps, decimals of up to 18 digits, booleans, strings (by bytes) or
    binaries; negate a number for the other direction. Of rows equal in all of ``order`` at the cut, any may be taken.
    """
    if n <= 0:
        return df.limit(0)
    names = [f"_o{k}" for k in range(len(order))]
    keyed = df.withColumns(dict(zip(names, order)))
    path = scratch_path(df.sparkSession, "order-keys")
    keyed.select(*names).write.parquet(path)                        # the rounds read the keys alone
    keys = df.sparkSession.read.parquet(path)
    kinds = {f.name: f.dataType for f in keys.schema.fields}

    before: list[Column] = []                                       # rows surely among the first n
    equal: list[Column] = []                                        # value of each digit at the cut
    need = n

    def all_of(conditions: list[Column]) -> Column:
        out = F.lit(True)
        for c in conditions:
            out = out & c
        return out

    def longest(c: Column) -> int:
        return keys.where(all_of(equal)).agg(F.max(F.octet_length(c))).first()[0] or 0

    def cut(digit: Column) -> bool:
        """Fix the value of the digit at the cut; True if all rows equal so far are taken."""
        nonlocal need
        left = keys.where(all_of(equal)).select(digit.alias("d"))
        lo, hi, rows = left.agg(F.min("d"), F.max("d"), F.count("*")).first()
        if rows <= need:
            before.append(all_of(equal))
            return True
        while lo is not None and lo < hi:
            width = -(-(hi - lo + 1) // BINS)
            # The span of two longs may not fit one: decimals there.
            place = F.expr(f"(d - {lo}L) div {width}L") if hi - lo < 1 << 62 else \
                F.floor((F.col("d").cast("decimal(20,0)") - F.lit(lo)) / F.lit(width))
            counts = left.where(F.col("d").between(lo, hi)).groupBy(place.cast("long").alias("b")).agg(F.count("*").alias("n")).collect()
            for b, m in sorted((r["b"], r["n"]) for r in counts):
                if m >= need:
                    lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                    break
                need -= m
            before.append(all_of(equal) & (digit < F.lit(lo)))
        if lo is not None:
            equal.append(digit == F.lit(lo))
        return False

    done = False
    for name in names:
        for digit in _digits(name, kinds[name], longest):
            if cut(digit):
                done = True
                break
        if done:
            break
    first = F.lit(False)
    for c in before:
        first = first | c
    out = keyed.where(first)
    if not done:
        out = out.unionAll(keyed.where(all_of(equal) & ~first).limit(need))      # equal in all of ``order``
    return out.drop(*names)


def sample_rows(df: DataFrame, n: int, key: str | list[str], seed: int = 17) -> DataFrame:
    """The n rows with the smallest ``md5('<seed>:<key>')``, ties by key.

    MD5 spreads keys uniformly and is the same function in SQL engines, so the
    sample can be restated exactly in SQL and checked."""
    keys = [key] if isinstance(key, str) else key
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    # The hex digits as numbers spread evenly over the bins of a histogram.
    parts = [F.conv(F.substring(h, at, 15), 16, 10).cast("long") for at in (1, 16, 31)]
    return first_n(df, n, parts + [F.col(k) for k in keys])
