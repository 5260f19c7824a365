import pytest
from pyspark.sql import types as T

from tiffin.sources.files import copy_into, load_rejects, load_strict, load_tolerant
from tiffin.streaming.ingest import ingest_new_files

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("amount", T.DecimalType(10, 2)),
                       T.StructField("name", T.StringType())])


def _write(path, name, text):
    import os
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w") as fh:
        fh.write(text)


def test_tolerant_skips_bad_rows_and_strict_fails(spark, tmp_dir):
    land = f"{tmp_dir}/land"
    _write(land, "a.csv", "id,amount,name\n1,10.50,x\n2,abc,y\n3,7,\"a, b\"\n")
    table = f"{tmp_dir}/table"
    copy_into(spark, land, SCHEMA, table, tolerant=True)
    rows = sorted(tuple(r) for r in spark.read.parquet(table).collect())
    assert [r[0] for r in rows] == [1, 3] and rows[1][2] == "a, b"
    bad = load_rejects(spark, land, SCHEMA).collect()
    assert len(bad) == 1 and "abc" in bad[0].raw_line
    assert len(load_tolerant(spark, land, SCHEMA).collect()) == 2   # all fields parsed
    with pytest.raises(Exception):
        load_strict(spark, land, SCHEMA).collect()


def test_streaming_ledger_loads_each_file_once(spark, tmp_dir):
    land, table, ckpt = f"{tmp_dir}/land", f"{tmp_dir}/raw", f"{tmp_dir}/ckpt"
    _write(land, "d1.csv", "id,amount,name\n1,1.00,a\n2,2.00,b\n3,3.00,c\n")
    ingest_new_files(spark, land, SCHEMA, table, ckpt)
    assert spark.read.parquet(table).count() == 3
    ingest_new_files(spark, land, SCHEMA, table, ckpt)           # no new file: nothing appended
    assert spark.read.parquet(table).count() == 3
    _write(land, "d2.csv", "id,amount,name\n1,1.00,a\n")         # same row again, new file: appended
    ingest_new_files(spark, land, SCHEMA, table, ckpt)
    assert spark.read.parquet(table).count() == 4


def test_streaming_upsert_merges_each_new_file(spark, tmp_dir):
    from tiffin.operators.incremental import IncrementalTable
    from tiffin.streaming.ingest import upsert_new_files
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
                           T.StructField("status", T.StringType())])
    land, ckpt = f"{tmp_dir}/land", f"{tmp_dir}/ckpt"
    table = IncrementalTable(spark, f"{tmp_dir}/fct", "id", "ts")
    _write(land, "d1.csv", "id,ts,status\n1,2024-01-01T10:00:00,Placed\n2,2024-01-01T11:00:00,Placed\n")
    upsert_new_files(spark, land, schema, table, ckpt)
    _write(land, "d2.csv", "id,ts,status\n2,2024-01-02T09:00:00,Delivered\n3,2024-01-02T10:00:00,Placed\n")
    upsert_new_files(spark, land, schema, table, ckpt)
    upsert_new_files(spark, land, schema, table, ckpt)       # no new files: no new version
    assert sorted((r.id, r.status) for r in table.read().collect()) == [(1, "Placed"), (2, "Delivered"),
                                                                      (3, "Placed")]
    assert table.current_version() == 2


def test_copy_into_with_rejects_parses_once(spark, tmp_dir):
    land = f"{tmp_dir}/land2"
    _write(land, "a.csv", "id,amount,name\n1,10.50,x\n2,abc,y\n3,7,\"a, b\"\nz,1.00,q\n")
    table, rejects = f"{tmp_dir}/table2", f"{tmp_dir}/rejects2"
    copy_into(spark, land, SCHEMA, table, tolerant=True, rejects_path=rejects)
    good = sorted(tuple(r) for r in spark.read.parquet(table).collect())
    assert [r[0] for r in good] == [1, 3] and good[1][2] == "a, b"
    bad = sorted(r.raw_line for r in spark.read.parquet(f"{rejects}/rows").collect())
    assert len(bad) == 2 and "abc" in bad[0] and bad[1].startswith("z,")
    assert spark.read.parquet(table).columns == ["id", "amount", "name"]


def test_rows_and_rejects_come_from_one_stream(spark, tmp_dir, monkeypatch):
    from tiffin.streaming import ingest
    land, table, rejects, ckpt = (f"{tmp_dir}/{d}" for d in ("land", "table", "rejects", "ckpt"))
    _write(land, "d1.csv", "id,amount,name\n1,1.00,a\nx,2.00,b\n3,3.00,\"c, d\"\n")
    load = lambda **o: ingest.ingest_with_rejects(spark, land, SCHEMA, table, rejects, ckpt, **o)
    assert load() == 1 and load() == 0
    _write(land, "d2.csv", "id,amount,name\n4,4.00,e\n")
    _write(land, "d3.csv", "id,amount,name\n5,oops,f\n")
    # The second batch breaks off between rows and rejects.
    from pyspark.sql import DataFrameWriter
    parquet = DataFrameWriter.parquet

    def broken(self, path, *a, **k):
        if path.startswith(rejects):
            raise RuntimeError("killed")
        return parquet(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", broken)
    with pytest.raises(Exception):
        load()
    monkeypatch.undo()
    assert load() == 1                                       # done again, as a whole
    rows = spark.read.schema(SCHEMA).parquet(table)
    assert sorted(tuple(r) for r in rows.select("id", "name").collect()) == [(1, "a"), (3, "c, d"), (4, "e")]
    bad = spark.read.parquet(rejects)
    assert sorted((r.raw_line, r.file.rsplit("/", 1)[1]) for r in bad.collect()) == [("5,oops,f", "d3.csv"), ("x,2.00,b", "d1.csv")]
