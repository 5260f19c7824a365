"""The daily run: RAW -> facts (incremental merge) -> dimensions and marts (full
rebuild) -> data tests -> review enrichment (append) -> review insight mart.

Every output is a Parquet table under ``out_root`` (on a cluster: a shared
folder). Facts are catalogue tables (see ``IncrementalTable``); dimensions and marts
are rebuilt into a new folder per run and a run-log row points readers at it,
so a mart folder that is being read is never overwritten. Enrichment appends
only reviews not present yet, so re-running a failed day adds nothing twice.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import enrich, quality
from ..operators.incremental import IncrementalTable
from ..sources.raw import RAW_SCHEMAS, RawTables, scan_raw
from ..session import scratch_path, session_settings
from ..streaming.ingest import ingest_new_files, ingest_with_rejects
from .models import Models

TABLE_MARTS = ["dim_customers", "dim_restaurants", "dim_food", "mart_daily_city_revenue", "mart_delivery_sla",
               "mart_restaurant_performance"]

#: While reviews are classified: see ``session._DEFAULTS``; the caller's session may not have it.
_CLASSIFYING = {"spark.sql.codegen.hugeMethodLimit": "8000"}


@dataclass
class RunResult:
    run_id: str
    tables: dict[str, str]
    report: DataFrame


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, None if there is none (or nothing in it yet); any other error is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_new_enrichment(spark: SparkSession, reviews: DataFrame, table_path: str,
                          batch_size: int | None = None, model: enrich.BatchModel | None = None,
                          model_name: str | None = None, batch_id: str | None = None) -> DataFrame:
    """Classify reviews that are not in the enriched table yet and append them, with the model's name.

    A run's rows are the partition ``batch=<batch_id>`` (a new id if none is given), which
    Spark's committer puts in place as a whole. A run with an id that is there already does
    that batch anew and replaces it: two runs of one batch, or a run after one that broke
    off, leave one copy. Give each scheduled run an id of its own, such as its date.

    With ``model`` (a batch classifier) each new review is sent to it once; rows it fails on
    go to ``<table_path>_rejects`` with the error, in the same way, and are tried again by the next run.
    """
    mine = F.lit(f"run-{batch_id or uuid.uuid4().hex[:12]}")
    done = read_or_none(spark, table_path)
    todo = enrich.reviews_to_enrich(reviews, None if done is None else done.where(F.col("batch") != mine), batch_size,
                                    key_filter=True)

    def put(df: DataFrame, path: str) -> None:
        with session_settings(spark, _CLASSIFYING):
            df.withColumn("batch", mine).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    if model is None:
        new = enrich.enrich_reviews(todo)
    else:
        staged = scratch_path(spark, "answers")                        # the model answers once for both outputs
        enrich.enrich_with_model(todo, model).write.parquet(staged)
        good, bad = enrich.split_rejects(spark.read.parquet(staged))
        put(bad, f"{table_path}_rejects")
        new = todo.select(*enrich.REVIEW_COLUMNS).join(good.select("review_id", "sentiment", "category", "confidence"), "review_id") \
            .select(*enrich.REVIEW_COLUMNS, "sentiment", "category", "confidence")
    name = model_name or (enrich.KEYWORD_MODEL if model is None else getattr(model, "__name__", "model"))
    put(new.withColumn("model", F.lit(name)), table_path)
    return read_or_none(spark, table_path)


def order_items_source(spark: SparkSession, m: Models, items: IncrementalTable, stage_path: str) -> DataFrame:
    """Source rows for the order-items fact.

    On an incremental run only orders past the watermark can contribute, so they
    are filtered first and written to ``stage_path``; the join then sees their real
    (small) size and broadcasts them, streaming the items without a shuffle.
    """
    if not items.exists():
        return m.fct_order_items
    from ..operators.incremental import watermark_filter
    from . import marts
    new_orders = watermark_filter(m.stg_orders, "order_timestamp", items.watermark())
    new_orders.write.mode("overwrite").parquet(stage_path)
    return marts.fct_order_items(m.stg_order_items, spark.read.parquet(stage_path))


#: Tables whose bad rows are skipped and kept as rejects; a bad row of any other stops the run.
TOLERANT = ("restaurants", "users", "food", "menu")


def land(spark: SparkSession, landing: str, root: str) -> RawTables:
    """Load every new file of the seven landing folders into RAW tables under ``root``, each file once.

    Strict tables go first: a bad row in one of them stops the run before anything
    else is loaded, and its files are read again once they are mended.
    """
    landing, root = landing.rstrip("/"), root.rstrip("/")
    for name in sorted(RAW_SCHEMAS, key=lambda n: (n in TOLERANT, n)):
        new_files, ledger = f"{landing}/{name}", f"{root}/_loaded/{name}"
        if name in TOLERANT:
            ingest_with_rejects(spark, new_files, RAW_SCHEMAS[name], f"{root}/{name}", f"{root}/_rejects/{name}", ledger)
        else:
            ingest_new_files(spark, new_files, RAW_SCHEMAS[name], f"{root}/{name}", ledger, tolerant=False)
    return scan_raw(spark, root)


def run_daily_from_landing(spark: SparkSession, landing: str, out_root: str, **options) -> RunResult:
    """Land what is new, then the daily run over the RAW tables (under ``out_root``/raw)."""
    return run_daily(spark, land(spark, landing, f"{out_root.rstrip('/')}/raw"), out_root, **options)


def run_daily(spark: SparkSession, raw: RawTables, out_root: str, tests_severity: str = "error",
              enrich_batch: int | None = None, partition_facts_by: list[str] | None = None,
              keys_keep_partition: bool = False, model: enrich.BatchModel | None = None,
              model_name: str | None = None, batch_id: str | None = None) -> RunResult:
    """One daily run (``batch_id``: its name, such as the date, under which a second run of the same day
    replaces the first one's enrichment). ``partition_facts_by`` (e.g. ``["order_date"]`` on a large warehouse)
    writes facts in folders per value, and a merge rewrites only the partitions its
    batch touches; each task writes its own files, so a hot day never funnels into
    one task. Leave it unset for small data. ``keys_keep_partition``: an order never
    changes its partition value (its date), so merges skip the scan of the facts'
    key column that looks for older rows elsewhere."""
    out = out_root.rstrip("/")
    run_id = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:6]
    m = Models(spark, raw)
    tables: dict[str, str] = {}

    # Facts: first run builds, later runs merge rows past the high watermark. Both are staged first; a first build is not written again.
    fo = IncrementalTable(spark, f"{out}/fct_orders", "order_id", "order_timestamp", partition_by=partition_facts_by,
                          keys_keep_partition=keys_keep_partition)
    new_orders, all_orders = fo.staged_batch(m.fct_orders, f"{out}/_staging/fct_orders-{run_id}")
    fi = IncrementalTable(spark, f"{out}/fct_order_items", "order_item_id", "order_ts", partition_by=partition_facts_by,
                          keys_keep_partition=keys_keep_partition)
    new_items, all_items = fi.staged_batch(order_items_source(spark, m, fi, f"{out}/_staging/orders-{run_id}"), f"{out}/_staging/fct_order_items-{run_id}")

    # Data tests on the facts as they would be; with severity "error" a failure stops
    # the run before anything is published: no version, no log entry, no moved watermark.
    m.pin("fct_orders", all_orders)
    m.pin("fct_order_items", all_items)
    report_path = f"{out}/dq_report/run={run_id}"
    quality.dq_report(m).write.mode("overwrite").parquet(report_path)
    report = spark.read.parquet(report_path)
    failed = [r.test_name for r in report.where("failures > 0").select("test_name").collect()]
    if tests_severity == "error" and failed:
        fo.discard()
        fi.discard()
        raise quality.DataQualityError(f"data tests failed: {failed}")

    fo.publish(new_orders)
    fi.publish(new_items)
    m.pin("fct_orders", fo.read())
    m.pin("fct_order_items", fi.read())

    # Dimensions and marts: full rebuild into this run's folder.
    for name in TABLE_MARTS:
        path = f"{out}/{name}/run={run_id}"
        m.table(name).write.mode("overwrite").parquet(path)
        tables[name] = path
        m.pin(name, spark.read.parquet(path))

    # Enrichment (active shape, appended) and the insight mart over its bridged rows.
    enriched = append_new_enrichment(spark, m.raw.reviews, f"{out}/review_ai_enriched", enrich_batch, model, model_name, batch_id or run_id)
    m.pin("review_enriched", enrich.active_to_mart_shape(enriched))
    path = f"{out}/mart_review_insights/run={run_id}"
    m.mart_review_insights.write.mode("overwrite").parquet(path)
    tables["mart_review_insights"] = path

    log = spark.createDataFrame([(run_id, name, p) for name, p in tables.items()],
                                "run_id string, table_name string, path string")
    log.coalesce(1).write.mode("append").json(f"{out}/_runs")
    return RunResult(run_id, tables, report)


def latest_table(spark: SparkSession, out_root: str, name: str) -> DataFrame:
    """The table a reader should use: the newest run that logged it."""
    runs = spark.read.schema("run_id string, table_name string, path string").json(f"{out_root.rstrip('/')}/_runs")
    row = runs.where(F.col("table_name") == name).orderBy(F.col("run_id").desc()).select("path").first()
    if row is None:
        raise FileNotFoundError(name)
    return spark.read.parquet(row.path)
