import datetime as dt

import pytest
from pyspark.sql import functions as F

from tiffin.operators import quality as Q
from tiffin.operators.incremental import DuplicateKeyError, IncrementalTable, watermark_filter


class _M:
    def __init__(self, tables):
        self.tables = tables

    def table(self, name):
        return self.tables[name]


def test_quality_failures_and_gate(spark):
    orders = spark.createDataFrame(
        [(1, 10, 5, "Delivered"), (1, 11, 5, "Cancelled"), (None, 12, None, "Lost"), (3, 99, 6, None)],
        "order_id long, customer_id long, restaurant_id long, order_status string")
    custs = spark.createDataFrame([(10,), (11,), (12,)], "customer_id long")
    assert [r.order_id for r in Q.unique_failures(orders, "order_id").collect()] == [1]
    assert Q.not_null_failures(orders, "restaurant_id").count() == 1
    assert [r.customer_id for r in Q.relationship_failures(orders, "customer_id", custs, "customer_id").collect()] == [99]
    assert [r.order_status for r in Q.accepted_values_failures(
        orders, "order_status", ["Delivered", "Cancelled", "Refunded"]).collect()] == ["Lost"]
    models = _M({"stg_orders": orders, "fct_orders": orders, "dim_customers": custs,
                 "stg_order_items": spark.createDataFrame([("a",), ("a",)], "order_item_id string"),
                 "stg_users": custs})
    report = {r.test_name: r.failures for r in Q.dq_report(models).collect()}
    assert report["unique_fct_orders_order_id"] == 1
    assert report["not_null_stg_orders_order_id"] == 1
    assert report["relationships_fct_orders_customer_id"] == 1
    assert report["accepted_values_fct_orders_order_status"] == 1
    assert report["unique_stg_order_items_order_item_id"] == 1
    with pytest.raises(Q.DataQualityError):
        Q.gate(models)


SCHEMA = "order_id long, ts timestamp_ntz, v string"


def _t(h):
    return dt.datetime(2024, 1, 1, h)


def test_merge_updates_inserts_and_keeps(spark, tmp_dir):
    t = IncrementalTable(spark, f"{tmp_dir}/fct", "order_id", "ts")
    assert t.current_version() is None
    t.run(spark.createDataFrame([(1, _t(1), "a"), (2, _t(2), "b")], SCHEMA))
    # order 2 updated with a newer timestamp, order 3 new, order 1 untouched
    src = spark.createDataFrame([(1, _t(1), "a"), (2, _t(5), "B"), (3, _t(6), "c")], SCHEMA)
    t.run(src)
    assert t.current_version() == 2
    assert sorted(tuple(r) for r in t.read().select("order_id", "v").collect()) == [(1, "a"), (2, "B"), (3, "c")]
    assert t.read(1).count() == 2   # the previous version is intact


def test_late_rows_dropped_unless_lookback(spark, tmp_dir):
    t = IncrementalTable(spark, f"{tmp_dir}/late", "order_id", "ts")
    t.run(spark.createDataFrame([(1, _t(5), "a")], SCHEMA))
    late = spark.createDataFrame([(2, _t(3), "late"), (3, _t(5), "same-ts")], SCHEMA)
    t.run(late)
    assert [r.order_id for r in t.read().collect()] == [1]          # ts <= watermark: missed
    t.run(late, lookback=dt.timedelta(hours=3))
    assert sorted(r.order_id for r in t.read().collect()) == [1, 2, 3]


def test_schema_evolution_appends_columns(spark, tmp_dir):
    t = IncrementalTable(spark, f"{tmp_dir}/evo", "order_id", "ts")
    t.run(spark.createDataFrame([(1, _t(1), "a")], SCHEMA))
    t.run(spark.createDataFrame([(2, _t(2), "b", 7)], SCHEMA + ", extra long"))
    out = t.read()
    assert out.columns == ["order_id", "ts", "v", "extra"]
    assert sorted((r.order_id, r.extra) for r in out.collect()) == [(1, None), (2, 7)]


def test_duplicate_keys(spark, tmp_dir):
    t = IncrementalTable(spark, f"{tmp_dir}/dup", "order_id", "ts")
    t.run(spark.createDataFrame([(1, _t(1), "a")], SCHEMA))
    dups = spark.createDataFrame([(1, _t(2), "x"), (1, _t(3), "y")], SCHEMA)
    with pytest.raises(DuplicateKeyError):
        t.merge(dups)
    new_dups = spark.createDataFrame([(5, _t(2), "x"), (5, _t(3), "y")], SCHEMA)
    t.merge(new_dups)                       # unmatched repeated keys are all inserted
    assert t.read().where("order_id = 5").count() == 2
    t.merge(dups, on_duplicates="latest")
    assert t.read().where("order_id = 1").first().v == "y"


def test_watermark_literal_reaches_parquet_scan(spark, tmp_dir):
    path = f"{tmp_dir}/src"
    spark.createDataFrame([(1, _t(1), "a"), (2, _t(9), "b")], SCHEMA).write.parquet(path)
    df = watermark_filter(spark.read.parquet(path), "ts", _t(4))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(ts," in plan
    assert [r.order_id for r in df.collect()] == [2]


def test_partitioned_versions_prune(spark, tmp_dir):
    schema = "order_id long, ts timestamp_ntz, d date"
    rows = [(i, _t(i % 20), dt.date(2024, 1, 1 + i % 3)) for i in range(30)]
    t = IncrementalTable(spark, f"{tmp_dir}/part", "order_id", "ts", partition_by=["d"])
    t.run(spark.createDataFrame(rows[:10], schema))
    t.run(spark.createDataFrame(rows, schema))
    df = t.read().where(F.col("d") == dt.date(2024, 1, 2))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(d" in plan
    assert df.count() == sum(1 for r in rows if r[2] == dt.date(2024, 1, 2) and (r in rows[:10] or r[1] > _t(9)))


PSCHEMA = "order_id long, ts timestamp_ntz, v string, d date"


def _files(root, part):
    import os
    p = f"{root}/{part}"
    return sorted(f for f in os.listdir(p) if f.endswith(".parquet"))


def test_partitioned_merge_rewrites_only_touched_partitions(spark, tmp_dir):
    d1, d2, d3 = dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 3)
    t = IncrementalTable(spark, f"{tmp_dir}/pm", "order_id", "ts", partition_by=["d"])
    t.run(spark.createDataFrame([(1, _t(1), "a", d1), (2, _t(2), "b", d2), (3, _t(3), "c", d3)], PSCHEMA))
    loc = spark.sql(f"DESCRIBE EXTENDED {t._tables()[-1]}").where("col_name = 'Location'").first().data_type.replace("file:", "")
    before = {p: _files(loc, p) for p in ("d=2024-01-01", "d=2024-01-03")}
    # order 2 updated, order 4 new: only 2024-01-02 is touched
    t.run(spark.createDataFrame([(2, _t(5), "B", d2), (4, _t(6), "d", d2)], PSCHEMA))
    assert {p: _files(loc, p) for p in before} == before
    assert t.partitions_rewritten() == 1
    assert t.watermark() == _t(6)
    out = sorted((r.order_id, r.v, r.d) for r in t.read().collect())
    assert out == [(1, "a", d1), (2, "B", d2), (3, "c", d3), (4, "d", d2)]
    assert t.read().columns == ["order_id", "ts", "v", "d"]


def test_partitioned_merge_key_moving_partition(spark, tmp_dir):
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    t = IncrementalTable(spark, f"{tmp_dir}/pmv", "order_id", "ts", partition_by=["d"])
    t.run(spark.createDataFrame([(1, _t(1), "a", d1), (2, _t(2), "b", d2)], PSCHEMA))
    t.run(spark.createDataFrame([(1, _t(5), "moved", d2)], PSCHEMA))   # d1 empties out
    assert sorted((r.order_id, r.v, r.d) for r in t.read().collect()) == [(1, "moved", d2), (2, "b", d2)]


def test_partitioned_merge_schema_evolution(spark, tmp_dir):
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    t = IncrementalTable(spark, f"{tmp_dir}/pme", "order_id", "ts", partition_by=["d"], keys_keep_partition=True)
    t.run(spark.createDataFrame([(1, _t(1), "a", d1), (2, _t(2), "b", d2)], PSCHEMA))
    t.run(spark.createDataFrame([(3, _t(5), "c", d2, 7)], "order_id long, ts timestamp_ntz, v string, d date, "
                                                          "extra long"))
    out = t.read()
    assert out.columns == ["order_id", "ts", "v", "extra", "d"]
    assert sorted((r.order_id, r.extra) for r in out.collect()) == [(1, None), (2, None), (3, 7)]


def test_relationship_count_matches_rows_with_a_hot_orphan_key(spark):
    from tiffin.operators.quality import relationship_failure_count, relationship_failures
    child = spark.createDataFrame([(i, 7 if i % 3 == 0 else i % 5) for i in range(300)] + [(999, None)],
                                  "order_id long, customer_id long")      # key 7: a third of the rows, no parent
    parent = spark.createDataFrame([(1,), (2,), (3,)], "customer_id long")
    rows = relationship_failures(child, "customer_id", parent, "customer_id").count()
    assert relationship_failure_count(child, "customer_id", parent, "customer_id").first().failures == rows
    assert rows == sum(1 for i in range(300) if i % 3 == 0 or i % 5 in (0, 4))


def test_partitioned_merge_on_two_partition_columns(spark, tmp_dir):
    schema = "order_id long, ts timestamp_ntz, v string, d date, c string"
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    t = IncrementalTable(spark, f"{tmp_dir}/p2", "order_id", "ts", partition_by=["d", "c"])
    t.run(spark.createDataFrame([(1, _t(1), "a", d1, "x"), (2, _t(2), "b", d1, "y"), (3, _t(3), "c", d2, "x")],
                                schema))
    t.run(spark.createDataFrame([(2, _t(5), "B", d1, "y"), (4, _t(6), "d", d2, "x")], schema))
    assert t.partitions_rewritten() == 2
    out = sorted((r.order_id, r.v) for r in t.read().collect())
    assert out == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]


def test_latest_row_with_maps_and_ties(spark, tmp_dir):
    import datetime as dt
    from tiffin.operators.incremental import IncrementalTable
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    table = IncrementalTable(spark, f"{tmp_dir}/t", "k", "ts")
    schema = "k long, ts timestamp_ntz, v string, m map<string,int>"
    table.full_refresh(spark.createDataFrame([(1, t0, "a", {"x": 1})], schema))
    table.merge(spark.createDataFrame([(1, t1, "b", {"x": 2}), (1, t1, "c", {"x": 3}), (1, t0, "z", None), (2, t0, None, None)], schema), on_duplicates="latest")
    assert sorted((r.k, r.v) for r in table.read().collect()) == [(1, "c"), (2, None)]


def test_two_writers_of_one_version_are_noticed(spark, tmp_dir, monkeypatch):
    from tiffin.operators.incremental import ConcurrentWriteError
    rows = [spark.createDataFrame([(1, dt.datetime(2024, 1, d))], "k long, ts timestamp_ntz") for d in (1, 2, 3)]
    one, two = (IncrementalTable(spark, f"{tmp_dir}/t", "k", "ts") for _ in range(2))
    one.full_refresh(rows[0])
    dedupe = two._dedupe
    monkeypatch.setattr(two, "_dedupe", lambda *a: (one.merge(rows[1]), dedupe(*a))[1])    # the other run ends first
    with pytest.raises(ConcurrentWriteError):
        two.merge(rows[2])
    assert [r.ts.day for r in one.read().collect()] == [2]


def test_older_tables_are_dropped_by_the_catalogue(spark, tmp_dir):
    import os
    table = IncrementalTable(spark, f"{tmp_dir}/t", "k", "ts")
    for day in range(1, 5):
        row = spark.createDataFrame([(day, dt.datetime(2024, 1, day))], "k long, ts timestamp_ntz")
        table.full_refresh(row) if day == 1 else table.merge(row)
    assert [n.split(".")[1][:10] for n in table.drop_older(2)] == ["t__v000001", "t__v000002"] and table.drop_older(2) == []
    assert table.read().count() == 4 and spark.table(table.name).count() == 4 and table.read(3).count() == 3
    assert len([d for d in os.listdir(tmp_dir) if d.startswith("t__")]) == 2             # batches are gone as well
    table.merge(spark.createDataFrame([(9, dt.datetime(2024, 2, 1))], "k long, ts timestamp_ntz"))
    assert table.read().count() == 5 and table.current_version() == 5


# ------------------------------------------------------------------ bucketed merge, change capture
def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_merge_does_not_shuffle_the_target(spark, tmp_dir, broadcast):
    t = IncrementalTable(spark, f"{tmp_dir}/b", "order_id", "ts", buckets=4)
    t.full_refresh(spark.createDataFrame([(i, _t(i % 20), "a") for i in range(200)], SCHEMA))
    batch = spark.createDataFrame([(i, _t(22), "b") for i in range(150, 260)], SCHEMA)
    place = f"{tmp_dir}/batch"
    batch.write.parquet(place)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        plan = _plan(t.not_replaced(spark.read.parquet(place)))
        # Every line above the target's scan up to the join is free of exchanges: one at most, the batch's.
        assert plan.count("Exchange hashpartitioning") <= (1 if broadcast == "-1" else 0)
        scan = next(line for line in plan.splitlines() if "b__v000001" in line or "Bucketed: true" in line)
        assert ("Bucketed: true" in scan) == (broadcast == "-1")
        t.merge(batch)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.order_id, r.v) for r in t.read().collect()) == [(i, "a" if i < 150 else "b") for i in range(260)]
    stored = spark.sql(f"DESCRIBE EXTENDED {t._tables()[-1]}").where("col_name = 'Num Buckets'").first()
    assert stored.data_type == "4"


@pytest.mark.parametrize("most, join", [(None, "ShuffledHashJoin"), (10, "SortMergeJoin")])
def test_merge_shuffles_the_batch_once(spark, tmp_dir, monkeypatch, most, join):
    from tiffin.operators import incremental
    if most is not None:
        monkeypatch.setattr(incremental, "HASHED_KEYS", most)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans, write = [], IncrementalTable._written

    def noted(self, df, *args, **more):
        plans.append(_plan(df))
        return write(self, df, *args, **more)

    monkeypatch.setattr(IncrementalTable, "_written", noted)
    try:
        t = IncrementalTable(spark, f"{tmp_dir}/once", "order_id", "ts", buckets=4)
        t.full_refresh(spark.createDataFrame([(i, _t(i % 20), "a") for i in range(200)] + [(None, _t(1), "n"), (7, _t(2), "twice")], SCHEMA))
        t.merge(spark.createDataFrame([(i, _t(22), "b") for i in range(150, 260)] + [(None, _t(23), "m"), (300, _t(22), "c"), (300, _t(22), "d")], SCHEMA))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 3 and join in plans[2] and "Exchange" not in plans[2]
    assert "spark.sql.maxConcurrentOutputFileWriters" not in {r.key for r in spark.sql("SET").collect()}     # settings of the write are gone
    want = [(i, "a" if i < 150 else "b") for i in range(260)] + [(None, "n"), (None, "m"), (7, "twice"), (300, "c"), (300, "d")]
    assert sorted(map(str, ((r.order_id, r.v) for r in t.read().collect()))) == sorted(map(str, want))
    assert t.watermark() == _t(23)


@pytest.mark.parametrize("partition_by, tracked", [(None, False), (["v"], False), (None, True)])
def test_a_staged_first_build_is_published_as_it_was_written(spark, tmp_dir, partition_by, tracked):
    make = lambda: IncrementalTable(spark, f"{tmp_dir}/st", "order_id", "ts", partition_by=partition_by, buckets=4, track_changes=tracked)
    rows = spark.createDataFrame([(i, _t(i % 20), "ab"[i % 2]) for i in range(200)] + [(None, _t(1), "a"), (7, _t(2), "b")], SCHEMA)
    tables = lambda: {r.tableName for r in spark.sql(f"SHOW TABLES IN {make().database}").collect()}
    t = make()
    batch, whole = t.staged_batch(rows, f"{tmp_dir}/unused")
    assert not t.exists() and whole.count() == 202 and set(whole.columns) == set(rows.columns)
    staged = tables()
    t.discard()
    assert len(staged) == 1 and not tables()
    t.discard()                                                    # nothing is staged any more
    batch, _ = t.staged_batch(rows, f"{tmp_dir}/unused")
    staged = tables()
    assert t.publish(batch) == 1 and t.watermark() == _t(19)
    assert tables() == staged | {"st"} and make().read().count() == 202         # shown, not written again
    t = make()
    batch, whole = t.staged_batch(spark.createDataFrame([(i, _t(22), "a") for i in range(150, 260)], SCHEMA), f"{tmp_dir}/day2")
    assert t.publish(batch) == 2
    got = sorted(map(str, ((r.order_id, r.v) for r in make().read().collect())))
    assert got == sorted(map(str, [(i, "ab"[i % 2] if i < 150 else "a") for i in range(260)] + [(None, "a"), (7, "b")]))
    assert got == sorted(map(str, ((r.order_id, r.v) for r in whole.collect())))
    assert t._in_buckets() == (partition_by is None)               # the first merge deals it


@pytest.mark.parametrize("partition_by", [None, ["d"]])
def test_changes_without_a_newer_timestamp_are_merged(spark, tmp_dir, partition_by):
    schema = "order_id long, ts timestamp_ntz, status string, note string, d date"
    d = dt.date(2024, 1, 1)
    t = IncrementalTable(spark, f"{tmp_dir}/cc", "order_id", "ts", partition_by=partition_by, track_changes=True)
    t.run_changes(spark.createDataFrame([(1, _t(1), "Placed", None, d), (2, _t(2), "Placed", "x", d), (None, _t(3), "Odd", None, d)], schema))
    # 1: the status moves on, the timestamp stays; 2: null and value change places; 3: new and old; null key: as it was, and a new one.
    later = spark.createDataFrame([(1, _t(1), "Delivered", None, d), (2, _t(2), None, "Placed", d), (3, _t(0), "Placed", None, d),
                                   (None, _t(3), "Odd", None, d), (None, _t(3), "Odder", None, d)], schema)
    got = {(r.order_id, r.status): r.change for r in t.changes(later).collect()}
    assert got == {(1, "Delivered"): "update", (2, None): "update", (3, "Placed"): "insert", (None, "Odd"): "unchanged", (None, "Odder"): "insert"}
    t.run_changes(later)
    want = [(None, "Odd"), (None, "Odder"), (1, "Delivered"), (2, None), (3, "Placed")]
    key = lambda r: (r[0] or 0, r[1] or "")
    assert sorted(((r.order_id, r.status) for r in t.read().collect()), key=key) == want
    assert t.read().columns == ["order_id", "ts", "status", "note", "d"]
    v = t.current_version()
    t.run_changes(later)                                   # nothing differs: nothing is written
    assert t.current_version() == v
    t.run(later.withColumn("ts", F.col("ts")))             # by watermark, none of them is seen
    assert t.current_version() == v
    assert t.changes(later.limit(0)).count() == 0
    with pytest.raises(ValueError):
        IncrementalTable(spark, f"{tmp_dir}/plain", "order_id", "ts").changes(later)


def test_change_capture_reads_two_columns_of_a_bucketed_target(spark, tmp_dir):
    t = IncrementalTable(spark, f"{tmp_dir}/two", "order_id", "ts", buckets=4, track_changes=True)
    rows = spark.createDataFrame([(i, _t(i % 20), "a") for i in range(50)], SCHEMA)
    t.run_changes(rows)
    plan = _plan(t.changes(rows))
    assert "ReadSchema: struct<order_id:bigint,_row_digest:bigint>" in plan


# ------------------------------------------------------------------ disk of a write
def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def test_shuffle_files_go_when_a_fact_is_written(spark, tmp_dir):
    import time
    rows = spark.range(400).selectExpr("id AS order_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, id % 20) AS ts", "'a' AS v")
    later = spark.range(300, 500).selectExpr("id AS order_id", "timestamp_ntz'2024-01-02' AS ts", "'b' AS v")
    t = IncrementalTable(spark, f"{tmp_dir}/gone", "order_id", "ts", buckets=4)
    for write in (lambda: t.run(rows), lambda: t.run(later)):
        before = _shuffle_files(spark)
        write()
        until = time.time() + 10                       # the files are removed by messages
        while (left := _shuffle_files(spark) - before) and time.time() < until:
            time.sleep(0.1)
        assert not left
    assert sorted((r.order_id, r.v) for r in t.read().collect()) == [(i, "a" if i < 300 else "b") for i in range(500)]
    assert t.watermark() == dt.datetime(2024, 1, 2)


def test_a_write_that_fails_leaves_no_table(spark, tmp_dir):
    t = IncrementalTable(spark, f"{tmp_dir}/broken", "order_id", "ts", buckets=4)
    bad = spark.range(9).selectExpr("id AS order_id", "timestamp_ntz'2024-01-01' AS ts", "raise_error('broken') AS v").withColumn("v", F.col("v").cast("string"))
    with pytest.raises(Exception, match="broken"):
        t.run(bad)
    assert not t.exists() and not spark.sql(f"SHOW TABLES IN {t.database}").collect()
    t.run(spark.createDataFrame([(1, _t(1), "a")], SCHEMA))
    assert t.read().count() == 1


def test_order_lines_without_a_row_of_the_run_are_not_shuffled(spark, tmp_dir, monkeypatch):
    from tiffin.operators import incremental
    from tiffin.plans.models import Models
    from tiffin.registry import QUERIES, comparable
    from tiffin.session import session_settings
    made = {"nation": "SELECT 1 AS n_nationkey, 'Spain' AS n_name",
            "customer": "SELECT id AS c_custkey, 1 AS c_nationkey, 'AUTO' AS c_mktsegment FROM range(20)",
            "part": "SELECT id AS p_partkey, CAST(id AS DOUBLE) AS p_retailprice FROM range(50)",
            "orders": "SELECT if(id = 7, NULL, id) AS o_orderkey, id % 25 AS o_custkey, 'F' AS o_orderstatus, 1.5D AS o_totalprice, '5-LOW' AS o_orderpriority, "
                      "timestamp_ntz'1998-01-01' + make_dt_interval(CAST(id % 300 AS INT)) AS o_orderdate FROM range(600)",
            "lineitem": "SELECT if(id % 90 = 1, NULL, id % 650) AS l_orderkey, id % 60 AS l_partkey, id % 9 AS l_suppkey, CAST(id % 4 AS INT) AS l_linenumber, 2D AS l_quantity, "
                        "3.25D AS l_extendedprice, 0.1D AS l_discount, 0.1D AS l_tax, timestamp_ntz'1998-03-01' AS l_shipdate FROM range(2000)"}
    for name, text in made.items():
        spark.sql(text).write.parquet(f"{tmp_dir}/{name}.parquet")
    fct = Models.from_driver(spark, tmp_dir).fct_order_items
    want = sorted(map(str, comparable(fct).collect()))
    monkeypatch.setitem(incremental._WRITING, "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    monkeypatch.setitem(incremental._WRITING, "spark.sql.optimizer.runtime.bloomFilter.numBits", str(1 << 20))
    with session_settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        for part in (fct.where(F.col("order_ts") < incremental.ntz_literal(dt.datetime(1998, 6, 1))),
                     incremental.watermark_filter(fct, "order_ts", dt.datetime(1998, 6, 1))):
            with session_settings(spark, incremental._WRITING):
                assert any("might_contain" in line and "xxhash64(l_orderkey" in line for line in _plan(part.select("*")).splitlines())
        got = QUERIES["fct_order_items_incremental"](spark, tmp_dir)
    assert len(want) > 1000 and sorted(map(str, got.collect())) == want
