from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tiffin.operators.quality import DataQualityError
from tiffin.operators.incremental import IncrementalTable
from tiffin.plans.pipeline import latest_table, run_daily
from tiffin.sources.fixtures import raw_from_driver

SF = "/root/testdata/sf0.001"


def test_daily_run_gate_and_idempotent_rerun(spark, tmp_dir):
    raw = raw_from_driver(spark, SF)
    with pytest.raises(DataQualityError):          # the adapter carries failing rows on purpose
        run_daily(spark, raw, f"{tmp_dir}/strict")
    for fact in ("fct_orders", "fct_order_items"):  # a failed gate publishes nothing
        assert not IncrementalTable(spark, f"{tmp_dir}/strict/{fact}", "k", "t").exists()
        assert not (Path(tmp_dir) / "strict" / fact).exists()
    assert not (Path(tmp_dir) / "strict" / "_runs").exists() and not (Path(tmp_dir) / "strict" / "dim_customers").exists()
    out = f"{tmp_dir}/wh"
    first = run_daily(spark, raw, out, tests_severity="warn")
    enriched = spark.read.parquet(f"{out}/review_ai_enriched").count()
    assert enriched == raw.reviews.where("comment is not null").count()
    second = run_daily(spark, raw, out, tests_severity="warn")
    assert spark.read.parquet(f"{out}/review_ai_enriched").count() == enriched   # nothing appended twice
    assert first.run_id != second.run_id
    mart = latest_table(spark, out, "mart_review_insights")
    assert mart.agg(F.sum("reviews")).first()[0] == enriched
    failing = {r.test_name for r in second.report.where("failures > 0").collect()}
    assert "relationships_fct_orders_customer_id" in failing
    # facts keep one row per key after the rerun
    table = IncrementalTable(spark, f"{out}/fct_orders", "order_id", "order_timestamp")
    assert table.current_version() == 1            # nothing new: nothing written
    fct = table.read()
    assert fct.count() == fct.select("order_id").distinct().count() == raw.orders.count()


def test_daily_runs_merge_partitioned_facts(spark, tmp_dir):
    from tiffin.operators.incremental import IncrementalTable
    from tiffin.sources.raw import RawTables
    lazy = raw_from_driver(spark, SF)
    raw = RawTables(**{n: lazy.get(n) for n in lazy.names()})
    cutoff = F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")
    day1 = RawTables(**{n: raw.get(n) for n in raw.names()})
    day1.orders = raw.orders.where(F.col("order_timestamp") < cutoff)
    out = f"{tmp_dir}/whp"
    run_daily(spark, day1, out, tests_severity="warn", partition_facts_by=["city"])
    run_daily(spark, raw, out, tests_severity="warn", partition_facts_by=["city"], keys_keep_partition=True)
    fo = IncrementalTable(spark, f"{out}/fct_orders", "order_id", "order_timestamp", partition_by=["city"])
    fct = fo.read()
    assert fct.count() == fct.select("order_id").distinct().count() == raw.orders.count()
    assert fo.current_version() == 2 and fo.partitions_rewritten() > 0
    fi = IncrementalTable(spark, f"{out}/fct_order_items", "order_item_id", "order_ts", partition_by=["city"]).read()
    items = raw.order_items.join(raw.orders.select(F.col("order_id")), "order_id").count()
    assert fi.count() == fi.select("order_item_id").distinct().count() == items


def test_daily_run_from_landing_files(spark, tmp_dir):
    from tiffin.plans.pipeline import TOLERANT, land, run_daily_from_landing
    from tiffin.registry import _landing
    landing, out = _landing(spark, SF), f"{tmp_dir}/wh"
    raw = land(spark, landing, f"{out}/raw")
    given = raw_from_driver(spark, SF)
    for name in raw.names():
        assert raw.get(name).count() == given.get(name).count()
        if name in TOLERANT:
            rejects = spark.read.parquet(f"{out}/raw/_rejects/{name}").collect()
            assert [r.raw_line.startswith("bad,bad") for r in rejects] == [True]
    again = land(spark, landing, f"{out}/raw")                     # every file is loaded once
    assert all(again.get(n).count() == given.get(n).count() for n in raw.names())
    # a bad row in a strict table stops the run before anything is published
    spark.createDataFrame([("order_item_id,order_id,r_id,f_id,price,quantity,line_amount",), ("x,not a number,1,f,1,1,1",)], "value string") \
        .coalesce(1).write.mode("append").text(f"{landing}/order_items")
    with pytest.raises(Exception):
        run_daily_from_landing(spark, landing, out, tests_severity="warn")
    assert not (Path(out) / "fct_orders").exists() and not (Path(out) / "_runs").exists()


def test_daily_run_with_a_model_keeps_its_name_and_rejects(spark, tmp_dir):
    from tiffin.operators import enrich as E

    def picky(texts):
        if texts.str.contains("awesome").any():
            raise ValueError("no superlatives, please: " + "x" * 600)
        return E.keyword_model(texts)

    raw = raw_from_driver(spark, SF)
    out = f"{tmp_dir}/wh"
    run_daily(spark, raw, out, tests_severity="warn", model=picky, model_name="picky-1")
    enriched = spark.read.parquet(f"{out}/review_ai_enriched")
    rejects = spark.read.parquet(f"{out}/review_ai_enriched_rejects")
    awesome = raw.reviews.where("comment LIKE '%awesome%'").count()
    assert awesome and rejects.count() == awesome and enriched.count() == raw.reviews.where("comment IS NOT NULL").count() - awesome
    assert {r.model for r in enriched.select("model").distinct().collect()} == {"picky-1"}
    assert len(rejects.first().error) > 600                       # the whole error text is kept
    assert latest_table(spark, out, "mart_review_insights").agg(F.sum("reviews")).first()[0] == enriched.count()


def test_landing_and_raw_files_are_compressed(spark, tmp_dir):
    from tiffin.plans.pipeline import TOLERANT, land
    from tiffin.registry import _landing
    landing = _landing(spark, SF)
    for name in ("orders", "order_items", "reviews", "menu"):
        assert list(Path(landing, name).glob("*.csv.gz")) and not list(Path(landing, name).glob("*.csv"))
    land(spark, landing, f"{tmp_dir}/raw")
    for name in ("orders", "order_items", *TOLERANT):
        files = list(Path(tmp_dir, "raw", name).rglob("*.parquet"))
        assert files and all(".zstd." in f.name for f in files)


def test_a_first_daily_run_writes_each_fact_once(spark, tmp_dir):
    raw = raw_from_driver(spark, SF)
    run_daily(spark, raw, f"{tmp_dir}/once", tests_severity="warn")
    for fact in ("fct_orders", "fct_order_items"):
        assert not list(Path(tmp_dir, "once", "_staging").glob(f"{fact}-*"))
        assert len(list(Path(tmp_dir, "once").glob(f"{fact}__v*"))) == 1
    with pytest.raises(DataQualityError):
        run_daily(spark, raw, f"{tmp_dir}/refused")
    assert not list(Path(tmp_dir, "refused").glob("fct_*"))        # a refused first build leaves no table
