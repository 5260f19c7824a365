"""Incremental fact tables: high-watermark filter, merge on a unique key and
``append_new_columns`` schema evolution (I1-I5, P8, G8, J7).

Facts are tables of the session catalogue, written and committed by Spark:

* unpartitioned facts are bucketed by their key. A merge writes the next table,
  then the view that readers use is replaced in one catalogue call. The target
  meets the batch bucket by bucket, so only the batch is shuffled, once. A first build
  that was staged for tests is published as it was written, and its first merge deals it;
* partitioned facts stay one table behind their view, and a merge overwrites the
  partitions it touches (dynamic partition overwrite, committed by Spark after all tasks).

Watermark and version are properties of the view. Runs in different sessions
need a catalogue that outlives a session, such as a metastore.

A merge first writes its batch to a table of its own, in the buckets of the fact,
dropped afterwards. That computes the source once, cuts the lineage, and the search
for repeated keys, the join and the write all go bucket by bucket.

Disk: the shuffle files of a bucketed write go when it is done, and of a join with a filtered side
only rows that may find a partner are shuffled (``_WRITING``).
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
import zlib

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import session_settings
from .changes import DIGEST, classify, with_digest

EPOCH_FLOOR = dt.datetime(1900, 1, 1)

#: Shuffle files go when the query that wrote them is done.
_CLEANING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: While a fact is written. A task holds one bucket: its file is open from the start, instead of
#: sorting the rows by bucket first. Buckets are read one per task, whether a join asks for it or not. A join of
#: the source whose smaller side turns out small per task is hashed instead of sorting both sides. Shuffle files go
#: when their write is done, instead of staying beside those of the next one.
_WRITING = {"spark.sql.maxConcurrentOutputFileWriters": "8", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
            "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m", **_CLEANING}
#: While a fact is written, a join of its source whose one side is filtered (orders past the watermark) tests the keys of the
#: other side (order lines) with Spark's runtime Bloom filter where they are read, so rows that find no partner are not shuffled.
#: Only for scans above the threshold. 16 MiB of bits hold 28 million keys with some 10 % false positives; with more keys more rows
#: pass, never fewer. A task that makes or tests a filter holds a few copies of it (32 MiB were too much for 4 tasks in a heap of 1 GB).
_BLOOM = "spark.sql.optimizer.runtime.bloomFilter"
BLOOM_SCAN, BLOOM_BITS, BLOOM_KEYS = "128m", 1 << 27, 1 << 25
_WRITING |= {f"{_BLOOM}.enabled": "true", f"{_BLOOM}.applicationSideScanSizeThreshold": BLOOM_SCAN, f"{_BLOOM}.creationSideThreshold": "1t",
             f"{_BLOOM}.numBits": str(BLOOM_BITS), f"{_BLOOM}.maxNumBits": str(BLOOM_BITS),
             f"{_BLOOM}.expectedNumItems": str(BLOOM_KEYS), f"{_BLOOM}.maxNumItems": str(BLOOM_KEYS)}
#: Batch keys a bucket that are hashed to look for replaced rows (some 100 bytes each, in a task's memory); more are sorted.
HASHED_KEYS = 1_000_000


class DuplicateKeyError(RuntimeError):
    pass


def ntz_literal(value: dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal, so the bound compares without casting the column and
    can reach the Parquet scan as a pushed filter."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def watermark_filter(source: DataFrame, ts_col: str, watermark: dt.datetime | None,
                     lookback: dt.timedelta | None = None) -> DataFrame:
    """Rows strictly newer than the target's high watermark (``coalesce(max, 1900-01-01)``).

    ``lookback`` re-reads a window before the watermark so late rows are merged
    instead of silently dropped (the default, 0, keeps the strict ``>``).
    """
    bound = watermark or EPOCH_FLOOR
    if lookback:
        bound = bound - lookback
    return source.where(F.col(ts_col) > ntz_literal(bound))


class ConcurrentWriteError(RuntimeError):
    """The table was changed by another run since this one began; one writer at a time is supported."""


class IncrementalTable:
    """A fact table of the session catalogue, merged on its key.

    ``path`` names the table and its place: the last part is its name, the rest the
    location of the catalogue database that holds its files.

    ``partition_by`` (e.g. ``["order_date"]``): folders per value, so date-bounded
    readers prune them and a merge rewrites only those it touches.
    ``keys_keep_partition``: a key's partition value never changes (an order keeps its
    date), so a merge need not look for older rows of batch keys elsewhere.
    ``buckets``: buckets of an unpartitioned fact (default: the session's shuffle
    partitions, so a batch is dealt to them by one plain exchange).
    ``track_changes``: keep a digest of every row, so ``run_changes`` finds rows
    that changed without a newer timestamp.
    """

    def __init__(self, spark: SparkSession, path: str, unique_key: str | list[str], ts_col: str,
                 partition_by: list[str] | None = None, keys_keep_partition: bool = False, buckets: int | None = None,
                 track_changes: bool = False):
        self.spark = spark
        self.path = path.rstrip("/")
        self.keys = [unique_key] if isinstance(unique_key, str) else list(unique_key)
        self.ts_col = ts_col
        self.partition_by = list(partition_by or [])
        self.keys_keep_partition = keys_keep_partition
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.track_changes = track_changes
        self.staged: tuple[DataFrame, str, dt.datetime | None] | None = None    # a first build's frame, table and watermark
        root, _, name = self.path.rpartition("/")
        self.database = f"tiffin_{zlib.crc32(root.encode()):08x}"
        self.root = root
        self.name = f"{self.database}.{re.sub('[^A-Za-z0-9_]', '_', name).lower()}"

    # -- what the catalogue knows
    def _properties(self) -> dict[str, str]:
        """The table's properties in the catalogue; empty if there is no table."""
        if not self.spark.catalog.tableExists(self.name):
            return {}
        return {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.name}").collect()}

    def current_version(self) -> int | None:
        v = self._properties().get("tiffin.version")
        return None if v is None else int(v)

    def exists(self) -> bool:
        return self.current_version() is not None

    def watermark(self) -> dt.datetime | None:
        w = self._properties().get("tiffin.watermark")
        return dt.datetime.fromisoformat(w) if w else None

    def partitions_rewritten(self) -> int | None:
        """Partitions that the last merge wrote (None: the whole table)."""
        n = self._properties().get("tiffin.partitions_rewritten")
        return int(n) if n else None

    def _tables(self) -> list[str]:
        """The tables behind the view, oldest first, the current one last."""
        found = self._properties().get("tiffin.tables")
        return found.split(",") if found else []

    def _stored(self, version: int | None = None) -> DataFrame:
        """The rows as stored: the bucketed table itself, so a join sees its buckets."""
        now = self.current_version()
        if now is None:
            raise FileNotFoundError(f"no table {self.name} at {self.path}")
        if self.partition_by and version not in (None, now):
            raise ValueError("partitioned tables are merged in place; only the current version can be read")
        tables, back = self._tables(), now - (now if version is None else version)
        if not 0 <= back < len(tables):
            raise FileNotFoundError(f"version {version} of {self.name} is not kept")
        return self.spark.table(tables[-1 - back])

    def read(self, version: int | None = None) -> DataFrame:
        """The current rows, or those of an older version that is still kept."""
        return self._stored(version).drop(DIGEST)

    # -- writes
    def _measured(self, df: DataFrame) -> tuple[DataFrame, Observation]:
        """``df`` with max(ts) measured while it is written."""
        obs = Observation(f"wm_{uuid.uuid4().hex[:8]}")
        return df.observe(obs, F.max(self.ts_col).alias("wm"), F.count(F.lit(1)).alias("n")), obs

    def _written(self, df: DataFrame, name: str, dealt: bool = False) -> Observation:
        """Write ``df`` as a table of the fact's database, laid out like the fact; max(ts) and the number of rows.

        ``dealt``: each task of ``df`` holds rows of one bucket already.
        """
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database} LOCATION '{self.root}'")
        if self.partition_by:
            df, obs = self._measured(self._ordered(df))
            df.write.format("parquet").partitionBy(*self.partition_by).saveAsTable(name)
        else:
            # Made empty, then filled: Spark removes the shuffle files of an insert, not those under CREATE TABLE AS SELECT.
            df.where(F.lit(False)).write.format("parquet").bucketBy(self.buckets, *self.keys).saveAsTable(name)
            df, obs = self._measured(df if dealt else df.repartition(self.buckets, *self.keys))
            try:
                with session_settings(self.spark, _WRITING):
                    df.write.insertInto(name)
            except BaseException:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                raise
        return obs

    def _next_table(self, version: int) -> str:
        return f"{self.name}__v{version:06d}_{uuid.uuid4().hex[:6]}"

    def _in_buckets(self) -> bool:
        """The current table is bucketed: not one that was staged and has seen no merge."""
        return self.spark.sql(f"DESCRIBE EXTENDED {self._tables()[-1]}").where("col_name = 'Num Buckets'").first() is not None

    @staticmethod
    def _clause(version: int, watermark, **more) -> str:
        known = {"version": version, "watermark": "" if watermark is None else watermark.isoformat(sep=" "), **more}
        return ", ".join(f"'tiffin.{k}' = '{v}'" for k, v in known.items())

    def _unchanged_since(self, version: int | None) -> None:
        now = self.current_version()
        if now != version:
            raise ConcurrentWriteError(f"{self.name} went from version {version} to {now} under this run")

    def _replace(self, df: DataFrame, version: int | None, dealt: bool = False) -> int:
        """Make ``df`` the whole table. ``dealt``: each task of ``df`` holds rows of one bucket already."""
        new = 1 if version is None else version + 1
        table = self._next_table(new)
        obs = self._written(df, table, dealt)
        self._unchanged_since(version)
        self._show(new, obs.get.get("wm"), [*self._tables(), table])
        return new

    def _show(self, version: int, watermark, tables: list[str], rewritten: int | str = "") -> None:
        """Point the view at the last of ``tables``: one catalogue call, readers see the old table or the new one."""
        columns = ", ".join(f"`{c}`" for c in self.spark.table(tables[-1]).columns if c != DIGEST)
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name} TBLPROPERTIES ({self._clause(version, watermark, tables=','.join(tables), partitions_rewritten=rewritten)}) "
                       f"AS SELECT {columns} FROM {tables[-1]}")

    def _ordered(self, df: DataFrame) -> DataFrame:
        """Partition columns last: the order of a partitioned table."""
        return df.select(*[c for c in df.columns if c not in self.partition_by], *self.partition_by)

    def full_refresh(self, df: DataFrame) -> int:
        return self._replace(with_digest(df, self.keys) if self.track_changes else df, self.current_version())

    def _dedupe(self, batch: DataFrame, target: DataFrame, on_duplicates: str) -> DataFrame:
        if on_duplicates == "latest":
            # row_number() = 1 is planned with a partial group limit: each task keeps one row of
            # a key, so a key repeated across a third of the batch does not land in one task.
            # Ties on ts resolve by the row; map columns have no order and do not take part.
            rest = [f.name for f in batch.schema.fields if f.name not in (*self.keys, self.ts_col) and not isinstance(f.dataType, T.MapType)]
            w = Window.partitionBy(*self.keys).orderBy(F.col(self.ts_col).desc(), *[F.col(c).desc() for c in rest])
            return batch.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
        if on_duplicates == "error":
            # Only the batch is aggregated; the target is consulted only if a key repeats.
            dups = batch.groupBy(*self.keys).count().where("count > 1").select(*self.keys)
            with session_settings(self.spark, _CLEANING):
                # Not isEmpty(): the cleaning does not know the shuffle it makes.
                if dups.limit(1).count() and dups.join(target.select(*self.keys), self.keys, "left_semi").limit(1).count():
                    raise DuplicateKeyError(f"batch repeats keys present in {self.path}")
            return batch
        raise ValueError(on_duplicates)

    def staged_batch(self, source: DataFrame, stage_path: str) -> tuple[DataFrame, DataFrame]:
        """(rows of ``source`` past the watermark, written to ``stage_path``; the table as it would be with them).

        Nothing of the table changes: tests can run on the second frame before ``publish``. A first
        build is written once, as the table that ``publish`` will show (or ``discard`` drops), without a shuffle.
        """
        if not self.exists():
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database} LOCATION '{self.root}'")
            table = self._next_table(1)
            df, obs = self._measured(self._ordered(with_digest(source, self.keys) if self.track_changes else source))
            with session_settings(self.spark, _WRITING):
                df.write.format("parquet").option("compression", "zstd").partitionBy(*self.partition_by).saveAsTable(table)
            batch = self.spark.table(table).drop(DIGEST)
            self.staged = (batch, table, obs.get.get("wm"))
            return batch, batch
        batch = watermark_filter(source, self.ts_col, self.watermark())
        batch.write.mode("overwrite").parquet(stage_path)
        batch = self.spark.read.parquet(stage_path)
        kept = self.read().join(batch.select(*self.keys), self.keys, "left_anti")
        return batch, kept.unionByName(batch, allowMissingColumns=True)

    def publish(self, batch: DataFrame, on_duplicates: str = "error") -> int:
        """Make a staged batch part of the table: its first version, or a merge."""
        if self.staged is not None and batch is self.staged[0]:
            self._unchanged_since(None)
            self._show(1, self.staged[2], [self.staged[1]])
            self.staged = None
            return 1
        return self.merge(batch, on_duplicates, staged=True) if self.exists() else self.full_refresh(batch)

    def discard(self) -> None:
        """Drop a staged first build that is not to be published."""
        if self.staged is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.staged[1]}")
            self.staged = None

    def merge(self, batch: DataFrame, on_duplicates: str = "error", staged: bool = False) -> int:
        """Upsert ``batch`` on the unique key; new source columns are appended.

        ``on_duplicates``: ``"error"`` (a key repeated in the batch that also exists in the
        target is ambiguous and raises; repeated new keys are all inserted) or
        ``"latest"`` (keep the newest row per key by ``ts_col``). ``staged``: the batch is
        read from files already. An empty batch writes nothing.
        """
        version, watermark, target = self.current_version(), self.watermark(), self._stored()
        batch_table = f"{self.name}__batch_{uuid.uuid4().hex[:12]}"
        try:
            rows = None
            if not staged:
                rows = self._written(batch, batch_table).get["n"]
                batch = self.spark.table(batch_table)
            if batch.isEmpty() if rows is None else not rows:
                return version
            batch = self._dedupe(batch, target, on_duplicates)
            if self.track_changes:
                batch = with_digest(batch.drop(DIGEST), self.keys)
            # append_new_columns: the target's columns first, new ones after.
            cols = target.columns + [c for c in batch.columns if c not in target.columns]
            if self.partition_by:
                return self._merge_partitions(batch, target, cols, version, watermark)
            dealt = batch.repartition(self.buckets, *self.keys) if staged else batch
            if not self._in_buckets():
                target = target.repartition(self.buckets, *self.keys)
            hashed = rows is not None and rows <= HASHED_KEYS * self.buckets
            merged = self.not_replaced(batch, target, hashed).unionByName(dealt, allowMissingColumns=True)
            return self._replace(merged.select(*cols), version, dealt=True)
        finally:
            if not staged:
                self.spark.sql(f"DROP TABLE IF EXISTS {batch_table}")

    def not_replaced(self, batch: DataFrame, target: DataFrame | None = None, hashed: bool = False) -> DataFrame:
        """Rows of the target that the batch does not replace: no exchange of the target, whatever the size of the batch.

        ``hashed``: the batch's keys of a bucket fit into a task's memory (repeated ones count once), so the target's rows are not sorted.
        """
        target = self._stored() if target is None else target
        keys = batch.select(*self.keys)
        return target.join(keys.hint("shuffle_hash") if hashed else keys, self.keys, "left_anti")

    def _among(self, values: list) -> Column:
        """Partition filter: one flat IN, nulls apart."""
        pc = self.partition_by
        if len(pc) == 1:
            some = F.col(pc[0]).isin([r[pc[0]] for r in values])
            return some | F.col(pc[0]).isNull() if any(r[pc[0]] is None for r in values) else some
        return F.struct(*pc).isin([F.struct(*[F.lit(r[c]).alias(c) for c in pc]) for r in values])

    def _merge_partitions(self, batch: DataFrame, target: DataFrame, cols: list[str], version: int, watermark) -> int:
        """Overwrite the partitions that the batch writes to and those that hold older rows of its keys."""
        pc, table = self.partition_by, self._tables()[-1]
        touched = {tuple(r): r for r in batch.select(*pc).distinct().collect()}       # one value per folder written
        if not self.keys_keep_partition:
            # Only the key and partition columns of the target are scanned.
            older = target.select(*self.keys, *pc).join(batch.select(*self.keys), self.keys, "left_semi").select(*pc).distinct().collect()
            moved = [r for r in older if tuple(r) not in touched]
        else:
            moved = []
        # Partition filter: only the touched folders of the target are read.
        kept = target.where(self._among([*touched.values(), *moved])).join(batch.select(*self.keys), self.keys, "left_anti")
        merged, obs = self._measured(self._ordered(kept.unionByName(batch, allowMissingColumns=True).select(*cols)))
        # A partition whose last rows moved away is dropped: an overwrite by what is there would leave it.
        left = {tuple(r) for r in kept.select(*pc).distinct().collect()} if moved else set()
        new = [c for c in cols if c not in target.columns]
        if new:
            types = {f.name: f.dataType.simpleString() for f in merged.schema.fields}
            self.spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'`{c}` {types[c]}' for c in new)})")
            merged = merged.select(*self.spark.table(table).columns)
        self._unchanged_since(version)
        # Spark writes beside the table and moves the partitions in when all tasks are done, so the table may be read here.
        mode = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            merged.write.mode("overwrite").insertInto(table)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
        for r in moved:
            if tuple(r) not in left:
                spec = ", ".join(f"{c} = " + ("NULL" if r[c] is None else f"'{r[c]}'") for c in pc)
                self.spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({spec})")
        now = max([w for w in (watermark, obs.get.get("wm")) if w is not None], default=None)
        self._show(version + 1, now, self._tables(), len(touched) + len(moved))
        return version + 1

    def drop_older(self, versions: int = 1) -> list[str]:
        """Drop all but the newest ``versions`` tables behind the view; Spark removes their files.

        Nothing calls this by itself: run it when no reader holds an older version and no merge is under way.
        """
        if versions < 1:
            raise ValueError("keep at least one version")
        tables = self._tables()
        gone, kept = tables[:-versions], tables[-versions:]
        if gone:
            self._show(self.current_version(), self.watermark(), kept)
        for t in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        return gone

    def run(self, source: DataFrame, source_ts_col: str | None = None,
            lookback: dt.timedelta | None = None, on_duplicates: str = "error") -> int:
        """One model run: full build the first time, else filter by watermark and merge."""
        if not self.exists():
            return self.full_refresh(source)
        return self.merge(watermark_filter(source, source_ts_col or self.ts_col, self.watermark(), lookback), on_duplicates)

    def changes(self, source: DataFrame) -> DataFrame:
        """Rows of ``source`` with ``change``: insert, update or unchanged against the table (``changes.classify``)."""
        if not self.track_changes:
            raise ValueError("the table keeps no digests; build it with track_changes=True")
        return classify(source, self._stored(), self.keys)

    def run_changes(self, source: DataFrame, on_duplicates: str = "error") -> int:
        """One model run by content, not by time: rows that are new or differ from the table are merged, however old they are."""
        if not self.exists():
            return self.full_refresh(source)
        return self.merge(self.changes(source).where("change <> 'unchanged'").drop("change", DIGEST), on_duplicates)
