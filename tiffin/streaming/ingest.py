"""Load-once file ingestion with Structured Streaming (S3) and streaming upserts.

A file stream with ``trigger(availableNow=True)`` and a checkpoint behaves like a
daily COPY with load history: each run takes every file not seen before, then
stops; files already loaded are never read again, and rows are appended as they
are (no row de-duplication). The checkpoint lives in the shared folder, so a
restarted driver or a lost executor resumes from the last committed batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.incremental import IncrementalTable


def ingest_new_files(spark: SparkSession, landing: str, schema: T.StructType, table_path: str,
                     checkpoint: str, fmt: str = "csv", tolerant: bool = True,
                     options: dict | None = None, max_files_per_trigger: int | None = None) -> int:
    """Append every not-yet-loaded file under ``landing`` to the Parquet table at ``table_path``.

    Returns the number of micro-batches run. Bad rows are dropped in tolerant mode and
    fail the batch otherwise.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    opts = {"header": "true", "escape": '"'} if fmt == "csv" else {}
    opts.update(options or {})
    opts["mode"] = "DROPMALFORMED" if tolerant else "FAILFAST"
    if max_files_per_trigger:
        opts["maxFilesPerTrigger"] = str(max_files_per_trigger)
    for k, v in opts.items():
        reader = reader.option(k, v)
    stream = reader.load(landing)
    q = (stream.writeStream.format("parquet").option("path", table_path).option("compression", "zstd")
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    # Spark keeps the progress of the last hundred batches, by default.
    return len({p["batchId"] for p in q.recentProgress if p["numInputRows"] > 0})


def ingest_with_rejects(spark: SparkSession, landing: str, schema: T.StructType, table_path: str, rejects_path: str,
                        checkpoint: str, max_files_per_trigger: int | None = None) -> int:
    """Tolerant load of new CSV files in one stream: rows that parse go to ``table_path``, the others to ``rejects_path``.

    Rejects keep the raw line, the file and the fields that did parse. Each file is read and
    parsed once: a micro-batch is staged, then split. Both parts are the partition
    ``batch=<id>`` of their table, so a batch that broke off between the two is done again by
    the next run and replaces what it had written; rows and rejects never part ways.
    Returns the number of micro-batches run.
    """
    from ..session import scratch_path
    corrupt = T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())])
    reader = (spark.readStream.format("csv").schema(corrupt).option("header", "true").option("escape", '"')
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = reader.load(landing).withColumn("file", F.col("_metadata.file_path"))
    ran = []

    def split(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged = scratch_path(spark, "parsed")
        batch.write.parquet(staged)
        rows = spark.read.schema(T.StructType([*corrupt.fields, T.StructField("file", T.StringType())])).parquet(staged)
        bad = F.col("_corrupt_record").isNotNull()
        for part, path in ((rows.where(~bad).select(*schema.fieldNames()), table_path),
                           (rows.where(bad).select(F.col("_corrupt_record").alias("raw_line"), "file", *schema.fieldNames()), rejects_path)):
            # A batch without rows of a kind still leaves its (empty) partition, so the table can be read.
            part.write.mode("overwrite").option("compression", "zstd").parquet(f"{path.rstrip('/')}/batch={batch_id}")
        ran.append(batch_id)

    q = (lines.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return len(ran)


def upsert_new_files(spark: SparkSession, landing: str, schema: T.StructType, table: IncrementalTable,
                     checkpoint: str, fmt: str = "csv", options: dict | None = None) -> None:
    """Stream new files into an incremental table, merging each micro-batch on the key."""
    reader = spark.readStream.format(fmt).schema(schema)
    opts = {"header": "true", "escape": '"', "mode": "FAILFAST"} if fmt == "csv" else {}
    opts.update(options or {})
    for k, v in opts.items():
        reader = reader.option(k, v)

    def merge_batch(batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():
            return
        if table.exists():
            table.merge(batch)
        else:
            table.full_refresh(batch)

    q = (reader.load(landing).writeStream.foreachBatch(merge_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
