"""Helpers shared by the operators of this subpackage: table access, staged tables, connected components."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tiffin.session import scratch_path

#: White space that separates words in every contract of this subpackage (fixed value).
SPACE = r"\x20\x09-\x0D"
#: Bytes of one Arrow batch of whole texts (a longer text is a batch alone). Spark's default fills a batch with 10,000 rows
#: whatever their size, and executor and worker each hold a batch several times over while it is handed across.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan ends there.

    Later jobs read files that any executor can reach, so a lost executor costs
    the tasks it was running and nothing that was finished before.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batch_settings(spark: SparkSession) -> dict[str, str]:
    """The session setting that bounds Arrow batches by ``BATCH``; none if the caller has set it."""
    key, size = BATCH
    return {key: size} if spark.conf.get(key, None) in (None, "") else {}


def small_batches(spark: SparkSession) -> None:
    """``batch_settings`` hold from here on: for frames whose Python work runs when the caller writes them."""
    for key, size in batch_settings(spark).items():
        spark.conf.set(key, size)


def free_name(taken: Iterable[str], base: str) -> str:
    """``base``, or the first of ``base_1``, ``base_2``, ... that is not a column yet."""
    taken = {c.lower() for c in taken}
    name, k = base, 0
    while name.lower() in taken:
        k += 1
        name = f"{base}_{k}"
    return name


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest vertex reachable from every vertex of ``edges``: columns (node, component).

    Large-star / small-star contraction: each round hangs the neighbours of a
    vertex under the smallest of them, until the edge list is a set of stars
    whose centres are the component minima. The minima are staged before they
    are joined, so both join sides are plain exchanges and AQE can split a hub.
    Self loops, repeated edges and null ends are allowed (null ends are ignored).
    Only one row count per round reaches the driver.
    """
    lo, hi = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    cur = stage(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
                .select(hi.alias("u"), lo.alias("v")).distinct(), "cc-edges")
    for _ in range(max_rounds):
        # Large star: every larger neighbour of u hangs under the smallest of u and its neighbours.
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m"))
                    .select("u", F.least("u", "m").alias("m")), "cc-min")
        large = stage(both.where(F.col("v") > F.col("u")).join(low, "u")
                      .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        # Small star: u and its smaller neighbours hang under the smallest of them.
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "cc-min")
        hung = large.join(low, "u")
        small = stage(hung.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "cc-small")
        cur = small
        # Stars: no vertex has two parents and no parent has a parent itself.
        n, kids = small.agg(F.count("u"), F.countDistinct("u")).first()
        if n == kids and small.join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("connected components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a bound variable.

    Spark substitutes column expressions textually; inside higher-order functions
    a substituted ``split(text)`` would run once per element.
    """
    return F.transform(F.array(value), body)[0]
