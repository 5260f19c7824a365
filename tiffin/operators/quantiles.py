"""Exact interpolated percentiles per group of a measure with any number of distinct values.

``percentile`` keeps every distinct value of a group in memory. Here each group's
histogram (``BINS`` counts with least and greatest value) finds the bin in which a
rank lies, and the next round looks at the rows of that bin alone. Once a bin holds
at most ``LEAF`` rows they are sorted and the value is read off. State is bounded by
``BINS`` counts a group in a round, counted map-side first, so a group holding a
third of all rows sends no more than that from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: Bins of one group's histogram, and rows of a bin that are sorted at once.
BINS, LEAF = 4096, 1024


def _bin(first: bool) -> Column:
    """Bin of ``v`` in lo .. hi: never falls as ``v`` grows, puts ``lo`` in the first and ``hi`` in the last one."""
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    if first:                                       # magnitudes far apart: logarithmic bins
        v, lo, hi = (F.signum(x) * F.log1p(F.abs(x)) for x in (v, lo, hi))
    # A difference of doubles can overflow; halves cannot.
    wide = (hi - lo) == F.lit(float("inf"))
    share = F.when(wide, F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2)).otherwise(F.try_divide(v - lo, hi - lo))
    return F.least(F.lit(BINS - 1), F.floor(F.coalesce(share, F.lit(0.0)) * BINS).cast("int"))


def exact_percentiles(df: DataFrame, keys: list[str], value: Column, fractions: dict[str, float]) -> DataFrame:
    """One row per group of ``keys`` (null is a group) with a double for each name in ``fractions``.

    The value at rank fraction * (n - 1) of the n values in ascending order, between two ranks on the line through both,
    as ``percentile`` and SQL's ``percentile_cont`` define it. Nulls, NaN and infinities are no values; a group without
    values has nulls. Three narrow reads of the staged values for most data; values of one group that differ by many
    orders of magnitude below 1 take further rounds.
    """
    spark = df.sparkSession

    def staged(part: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, f"quantiles-{name}")
        part.write.parquet(path)
        return spark.read.parquet(path)

    number = value.cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    # + 0.0 makes one zero of both.
    rows = staged(df.select(F.struct(*keys).alias("g"), F.when(finite, number + F.lit(0.0)).alias("v")), "values")
    groups = staged(rows.groupBy("g").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "groups")
    values = rows.where(F.col("v").isNotNull())

    place = F.col("f") * (F.col("n") - 1)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(f)).alias("f")) for name, f in fractions.items()])
    asked = (groups.where("n > 0").select("*", F.inline(wanted))
             .select("g", "lo", "hi", "n", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("rank"))
             .select("g", "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("c")).distinct())
    open_, found = staged(asked, "asked"), []
    first = True
    while True:
        found.append(open_.where("lo = hi").select("g", "rank", F.col("lo").alias("v")))
        leaf = open_.where(f"lo < hi AND c <= {LEAF}")
        found.append(_read_off(values, leaf))
        open_ = open_.where(f"lo < hi AND c > {LEAF}")
        if open_.isEmpty():
            break
        open_ = staged(_narrowed(values, open_, first), "open")
        first = False
    ranks = found[0]
    for part in found[1:]:
        ranks = ranks.unionByName(part)
    ranks = staged(ranks, "ranks")

    # Back to the fractions: both ranks of each, and the point between them.
    want = groups.where("n > 0").select("g", "n", F.inline(wanted)).select("g", "name", place.alias("p"))
    near = want.join(ranks, want["g"].eqNullSafe(ranks["g"]) & ranks["rank"].between(F.floor("p"), F.ceil("p"))) \
        .groupBy(want["g"], "name", "p").agg(F.min("v").alias("a"), F.max("v").alias("b")) \
        .withColumn("at", F.col("a") + (F.col("b") - F.col("a")) * (F.col("p") - F.floor("p")))
    wide = near.groupBy("g").agg(*[F.max(F.when(F.col("name") == name, F.col("at"))).alias(name) for name in fractions])
    out = groups.select(F.col("g").alias("_g")).join(wide, F.col("_g").eqNullSafe(F.col("g")), "left")
    return out.select(*[F.col("_g")[k].alias(k) for k in keys], *fractions)


def _spans(open_: DataFrame) -> DataFrame:
    """The distinct value ranges still looked at: of one group they never overlap."""
    return open_.select(F.col("g").alias("sg"), "lo", "hi").distinct()


def _inside(values: DataFrame, open_: DataFrame) -> DataFrame:
    spans = _spans(open_)
    return values.join(spans, values["g"].eqNullSafe(spans["sg"]) & values["v"].between(spans["lo"], spans["hi"])).drop("sg")


def _narrowed(values: DataFrame, open_: DataFrame, first: bool) -> DataFrame:
    """Each open rank with the bin of its range in which it lies, as its new range."""
    bins = (_inside(values, open_).groupBy("g", "lo", _bin(first).alias("bin"))
            .agg(F.count("*").alias("bc"), F.min("v").alias("blo"), F.max("v").alias("bhi")))
    before = Window.partitionBy("g", "lo").orderBy("bin")
    bins = bins.withColumn("start", F.sum("bc").over(before) - F.col("bc")).withColumnRenamed("g", "bg").withColumnRenamed("lo", "from")
    inner = F.col("rank") - F.col("below")
    return open_.join(bins, F.col("g").eqNullSafe(F.col("bg")) & (F.col("lo") == F.col("from"))
                      & (inner >= F.col("start")) & (inner < F.col("start") + F.col("bc"))) \
        .select("g", "rank", F.col("blo").alias("lo"), F.col("bhi").alias("hi"),
                (F.col("below") + F.col("start")).alias("below"), F.col("bc").alias("c"))


def _read_off(values: DataFrame, leaf: DataFrame) -> DataFrame:
    """Ranks in ranges of at most ``LEAF`` rows: the rows sorted, the value taken."""
    lists = _inside(values, leaf).groupBy(F.col("g").alias("lg"), F.col("lo").alias("from")).agg(F.sort_array(F.collect_list("v")).alias("vs"))
    return leaf.join(lists, F.col("g").eqNullSafe(F.col("lg")) & (F.col("lo") == F.col("from"))) \
        .select("g", "rank", F.element_at("vs", (F.col("rank") - F.col("below") + 1).cast("int")).alias("v"))
