"""Landing files into RAW tables.

* tolerant load: rows that do not parse into the declared schema are skipped and
  the good ones kept (``ON_ERROR = CONTINUE``); the skipped lines can be read back
  as a rejects table;
* strict load: the first bad row aborts the load (the warehouse default).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV_OPTIONS = {"header": "true", "escape": '"', "multiLine": "false"}


def _reader(spark: SparkSession, schema: T.StructType, fmt: str, options: dict | None):
    r = spark.read.format(fmt).schema(schema)
    for k, v in {**(CSV_OPTIONS if fmt == "csv" else {}), **(options or {})}.items():
        r = r.option(k, v)
    return r


def load_tolerant(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv",
                  options: dict | None = None) -> DataFrame:
    """Rows that parse into ``schema``.

    The CSV reader only parses the columns a query references, so a narrow
    projection (or a bare ``count()``) does not see bad fields elsewhere in the
    row; ``copy_into`` writes every column and is the way to land data.
    """
    return _reader(spark, schema, fmt, options).option("mode", "DROPMALFORMED").load(path)


def load_rejects(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv",
                 options: dict | None = None) -> DataFrame:
    """The lines a tolerant load skips: their raw text, file, and the fields that did parse.

    Every declared column stays in the output on purpose: the CSV reader only
    parses referenced columns, so a narrower projection would miss bad fields
    (and Spark refuses a scan that references only the corrupt-record column).
    """
    with_corrupt = T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())])
    df = (_reader(spark, with_corrupt, fmt, options).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").load(path))
    return df.where(F.col("_corrupt_record").isNotNull()).select(
        F.col("_corrupt_record").alias("raw_line"), F.input_file_name().alias("file"), *schema.fieldNames())


def load_strict(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv",
                options: dict | None = None) -> DataFrame:
    return _reader(spark, schema, fmt, options).option("mode", "FAILFAST").load(path)


def write_landing(df: DataFrame, path: str, fmt: str = "csv", mode: str = "append", compression: str | None = None) -> None:
    """Write a DataFrame as landing files (text formats keep every value as written), plain or e.g. as ``.csv.gz``."""
    w = df.write.mode(mode).format(fmt)
    if compression:
        w = w.option("compression", compression)
    if fmt == "csv":
        w = w.option("header", "true").option("escape", '"')
    w.save(path)


def copy_into(spark: SparkSession, landing: str, schema: T.StructType, table_path: str, tolerant: bool = True,
              fmt: str = "csv", options: dict | None = None, mode: str = "append",
              rejects_path: str | None = None) -> None:
    """Load landing files into a Parquet RAW table.

    Every column is written, so every field of every row is parsed: a row with one
    bad field is dropped (tolerant) or fails the load (strict), as in a COPY.

    With ``rejects_path`` (tolerant loads) the files are parsed once: every row,
    with its corrupt-record text, is staged as Parquet next to the rejects, then
    split into the table (rows that parsed) and the rejects (raw line and file).
    """
    if rejects_path is None or not tolerant:
        load = load_tolerant if tolerant else load_strict
        load(spark, landing, schema, fmt, options).write.mode(mode).parquet(table_path)
        return
    with_corrupt = T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())])
    parsed = (_reader(spark, with_corrupt, fmt, options).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", "_corrupt_record").load(landing)
              .withColumn("_file", F.input_file_name()))
    staged = f"{rejects_path.rstrip('/')}/_staged-{uuid.uuid4().hex[:12]}"
    parsed.write.parquet(staged)
    rows = spark.read.parquet(staged)
    bad = F.col("_corrupt_record").isNotNull()
    rows.where(~bad).select(*schema.fieldNames()).write.mode(mode).parquet(table_path)
    rows.where(bad).select(F.col("_corrupt_record").alias("raw_line"), F.col("_file").alias("file"),
                           *schema.fieldNames()).write.mode(mode).parquet(f"{rejects_path.rstrip('/')}/rows")
