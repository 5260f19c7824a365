"""One-pass word matching, exact percentiles by rounds, key filter ahead of the anti join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiffin.functions.matching import WordMatcher
from tiffin.operators import enrich as E
from tiffin.operators import newkeys, quantiles


# ------------------------------------------------------------------ words
def test_long_texts_classified_like_short_ones(spark):
    texts = ["delivery was not on time", "i was unhappy", "chocolate plate", "eco-friendly, late and LATE", "", None, "okay",
             "good bad good", "x" * 100_000 + "terrible", "ſlow İ late", "on time", "disappointed: worst delay"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    assert sorted(E.classify_long_texts(df, "t").collect()) == sorted(E.classify(df, "t").collect())


def test_matcher_beyond_one_mask(spark):
    words = [f"w{i:03d}" for i in range(150)]
    rows = [(i, " ".join(words[i:i + 3])) for i in range(150)] + [(-1, None), (-2, "")]
    m = WordMatcher(words)
    df = spark.createDataFrame(rows, "k int, t string")
    got = df.withColumns(m.masks(F.col("t"))).select("k", m.count(words).alias("n"), m.any(words[100:]).alias("late"))
    for r in got.collect():
        if r.k == -1:
            assert r.n is None and r.late is None
        elif r.k == -2:
            assert (r.n, r.late) == (0, False)
        else:
            assert r.n == min(3, 150 - r.k) and r.late == (r.k + 2 >= 100)
    with pytest.raises(ValueError):
        WordMatcher(["a", ""])


# ------------------------------------------------------------------ percentiles
FRACTIONS = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p100": 1.0}


def _check(spark, groups: dict):
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in quantiles.exact_percentiles(df, ["g"], F.col("x"), FRACTIONS).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs = np.sort(np.array([v for v in vs if np.isfinite(v)], dtype=float))
        for name, f in FRACTIONS.items():
            if not len(vs):
                assert got[g][name] is None
                continue
            at = f * (len(vs) - 1)
            a, b = vs[int(np.floor(at))], vs[int(np.ceil(at))]
            assert got[g][name] == a + (b - a) * (at - np.floor(at)), (g, name)


def test_percentiles_of_odd_groups(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BINS", 64)
    monkeypatch.setattr(quantiles, "LEAF", 8)
    rng = np.random.default_rng(3)
    _check(spark, {"hot": rng.normal(size=3000), "same": [7.0] * 500, None: [1, 2, 3, 4], "one": [5],
                   "ties": [1.0] * 200 + [2.0] * 300 + [3.0], "far": [-1e308, 1e308, 0.0, 1.0, 2.0, 1e-300] * 4,
                   "none": [float("nan"), float("inf")], "some": [float("nan"), 4.0, float("-inf"), 8.0],
                   "skewed": np.exp(rng.normal(size=800) * 20), "zeros": [0.0, -0.0] * 30})


def test_percentiles_with_production_bins(spark):
    rng = np.random.default_rng(4)
    _check(spark, {"a": rng.random(20_000), "b": np.exp(rng.normal(size=9_000) * 3), "c": rng.integers(0, 5, 6_000)})


def test_percentiles_of_nothing_and_of_clashing_names(spark):
    empty = spark.createDataFrame([], "g string, x double")
    assert quantiles.exact_percentiles(empty, ["g"], F.col("x"), FRACTIONS).count() == 0
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 4.0), (2, None, 1.0)], "lo int, v string, bin double")
    got = quantiles.exact_percentiles(df, ["lo", "v"], F.col("bin"), {"mid": 0.5}).collect()
    assert sorted((r.lo, r.v or "", r.mid) for r in got) == [(1, "a", 3.0), (2, "", 1.0)]


# ------------------------------------------------------------------ key filter
@pytest.mark.parametrize("max_bits", [64, 1 << 12, newkeys.MAX_BITS])
def test_new_keys_like_an_anti_join(spark, max_bits):
    done = spark.range(0, 3000, 3).unionByName(spark.range(0, 300, 3)).unionByName(spark.createDataFrame([(None,)], "id long"))
    rows = spark.range(2000).unionByName(spark.range(100)).unionByName(spark.createDataFrame([(None,), (None,)], "id long")) \
        .withColumn("x", F.col("id") * 2)
    got = newkeys.rows_with_new_keys(rows, done, "id", max_bits)
    assert got.columns == ["id", "x"]
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(done, "id", "left_anti").collect()))


def test_filter_passes_new_text_keys_without_the_join(spark):
    done = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("id"))
    f = newkeys.KeyFilter(done, "id")
    assert f.bits == 1 << 16 and 2 <= f.hashes <= 8
    assert done.where(~f.maybe(F.col("id"))).isEmpty()                                          # no finished key is called new
    new = spark.range(5000, 25000).select(F.concat(F.lit("k"), "id").alias("id"))
    assert new.where(f.maybe(F.col("id"))).count() < 0.02 * 20000


def test_new_keys_of_empty_tables_and_other_types(spark):
    none, some = spark.createDataFrame([], "id long"), spark.range(3)
    assert newkeys.rows_with_new_keys(some, none, "id").count() == 3
    assert newkeys.rows_with_new_keys(none, some, "id").count() == 0
    with pytest.raises(TypeError):
        newkeys.rows_with_new_keys(some, some.select(F.col("id").cast("string")), "id")


def test_rows_with_new_keys_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def noted(k):
        seen.add(1)
        return k + 1

    rows = spark.range(0, 3000, 1, 4).withColumn("x", noted(F.col("id")))
    assert newkeys.rows_with_new_keys(rows, spark.range(0, 3000, 3), "id").count() == 2000
    assert seen.value == 3000
