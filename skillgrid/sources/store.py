"""The stored tables: postings, their demand, and Parquet snapshots of both."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from skillgrid.operators.dedupe import latest_postings, merge_newest, replaced_postings, union_all, with_replaced
from skillgrid.operators.deltas import added, changed_segments, signed_rollup
from skillgrid.operators.demand import cube_segments, demand_rollup
from skillgrid.session import stored
from skillgrid.sources.layout import clustered, typed_postings

POSTINGS_SCHEMA = StructType(
    [StructField("job_uid", StringType(), False)]
    + [StructField(name, StringType(), True)
       for name in ("source", "title", "company", "location", "role", "description", "url", "scraped_at")]
    + [StructField("skills", ArrayType(StringType()), True)]
)


TABLES = ("job_postings", "skill_demand", "demand_segments")
LAYOUT = "postings_by_month"
# Stands while a batch is being merged: tables made from the postings may then be behind them.
PENDING = "pending_batch"


class MarketStore:
    """Managed tables in one database of the session catalog.

    Postings are bucketed by key. A new batch is merged by a join that reads the stored buckets in place, so the
    shuffle grows with the batch, not with the table. Demand follows by signed changes, and ``by_month`` keeps the
    postings with typed columns by month as well, of which only the months are rewritten that a batch touches. A swap that was cut short is
    finished or taken back when the store is opened again, and a batch that was cut short has everything rebuilt from the
    postings, so one writer at a time loses nothing in a crash.
    """

    def __init__(self, spark: SparkSession, database: str = "skill_market", buckets: int | None = None,
                 snapshot_root: str | None = None, location: str | None = None, by_month: bool = False):
        self.spark, self.database, self.snapshot_root = spark, database, snapshot_root
        # At least as many buckets as shuffle partitions, or a join would shuffle the stored side after all.
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = max(buckets or least, least)
        place = f" LOCATION '{location}'" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{place}")
        for table in TABLES:
            self._recover(table)
        self.by_month = by_month or self.exists(LAYOUT)
        if self.exists(PENDING) or (self.by_month and not self.exists(LAYOUT)):
            self.rebuild()

    def name(self, table: str) -> str:
        return f"{self.database}.{table}"

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(table))

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def _swap_in(self, df: DataFrame, table: str, bucket_by: str | None = None) -> None:
        """Write beside the current table, then take its place: a table may be rebuilt from itself."""
        self._recover(table)
        # A name of its own: files of a write that was cut short are in nobody's way.
        staging, retired = f"{table}_staging_{uuid.uuid4().hex[:8]}", f"{table}_retired"
        writer = df.write.format("parquet")
        if bucket_by:
            writer = writer.bucketBy(self.buckets, bucket_by).sortBy(bucket_by)
        writer.saveAsTable(self.name(staging))
        if self.exists(table):
            self.spark.sql(f"ALTER TABLE {self.name(table)} RENAME TO {self.name(retired)}")
        self.spark.sql(f"ALTER TABLE {self.name(staging)} RENAME TO {self.name(table)}")
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(retired)}")

    def _recover(self, table: str) -> None:
        """Bring a table back to one complete state after a swap that was cut short.

        A table is retired only once its successor is written in full. So if it is missing, the successor takes its
        place, and the retired one comes back if there is none. Leftovers go only when a current table exists.
        """
        retired = f"{table}_retired"
        staged = [t.name for t in self.spark.catalog.listTables(self.database) if t.name.startswith(f"{table}_staging_")]
        if not self.exists(table) and self.exists(retired):
            successor = staged[0] if len(staged) == 1 else retired
            self.spark.sql(f"ALTER TABLE {self.name(successor)} RENAME TO {self.name(table)}")
            staged = [t for t in staged if t != successor]
        for leftover in [*staged, *([retired] if self.exists(table) else [])]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name(leftover)}")

    def upsert_postings(self, incoming: DataFrame) -> int:
        """Keep the newest copy of every posting, refresh demand and snapshots, return the stored row count."""
        shaped = union_all([self.spark.createDataFrame([], POSTINGS_SCHEMA), incoming]).select(
            *POSTINGS_SCHEMA.fieldNames())
        if all(self.exists(t) for t in TABLES):
            self._merge(shaped)
        else:
            # One task per bucket, so one file per bucket; a merge runs bucket by bucket as it is.
            merged = merge_newest(self.table("job_postings"), shaped) if self.exists("job_postings") else \
                latest_postings(shaped).repartition(self.buckets, "job_uid")
            self._swap_in(merged, "job_postings", bucket_by="job_uid")
            self.rebuild()
        self.export_snapshots()
        return self.table("job_postings").count()

    def _merge(self, batch: DataFrame) -> None:
        """Merge a batch and carry its changes into demand and layout."""
        changes = stored(replaced_postings(self.table("job_postings"), batch), "changed_postings")
        rollup = stored(signed_rollup(changes), "demand_change")
        new = changes.select("_new.*")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name(PENDING)} (batch string) USING parquet")
        self._swap_in(with_replaced(self.table("job_postings"), new), "job_postings", bucket_by="job_uid")
        self._swap_in(added(self.table("skill_demand"), rollup), "skill_demand")
        self._swap_in(changed_segments(self.table("demand_segments"), rollup), "demand_segments")
        if self.by_month:
            self._relay(changes.where("_old IS NOT NULL").select("_old.*"), new)
        self.spark.sql(f"DROP TABLE {self.name(PENDING)}")

    def _relay(self, before: DataFrame, after: DataFrame) -> None:
        """Rewrite the months of the layout that the batch touches."""
        before, after = typed_postings(before), typed_postings(after)
        # One row per month of the calendar; undated postings have a folder of their own.
        touched = [r[0] for r in before.select("month").union(after.select("month")).distinct().collect()]
        in_touched = F.col("month").isin([m for m in touched if m]) | (F.col("month").isNull() & F.lit(None in touched))
        kept = self.table(LAYOUT).where(in_touched).join(after.select("job_uid"), "job_uid", "left_anti")
        fresh = stored(kept.unionByName(after), "touched_months")
        filled = {r[0] for r in fresh.select("month").distinct().collect()}
        target, names = self.name(LAYOUT), self.table(LAYOUT).columns
        # A write into a table takes this setting from the session only.
        mode, usual = "spark.sql.sources.partitionOverwriteMode", self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set(mode, "dynamic")
        try:
            clustered(fresh).select(*names).write.insertInto(target, overwrite=True)
        finally:
            self.spark.conf.set(mode, usual)
        for month in set(touched) - filled:
            value = "null" if month is None else f"'{month}'"
            self.spark.sql(f"ALTER TABLE {target} DROP IF EXISTS PARTITION (month = {value})")

    def rebuild(self) -> None:
        """Everything that is made from the stored postings, from zero."""
        self.rebuild_demand()
        if self.by_month and self.exists("job_postings"):
            # Partitions keep their own places, so this table is made where it stays, in a folder of its own.
            root = self.spark.catalog.getDatabase(self.database).locationUri
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name(LAYOUT)}")
            clustered(typed_postings(self.table("job_postings"))).write.partitionBy("month").option(
                "path", f"{root}/{LAYOUT}-{uuid.uuid4().hex[:8]}").saveAsTable(self.name(LAYOUT))
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(PENDING)}")

    def rebuild_demand(self) -> None:
        """Demand rollup from the stored postings, then segments from the stored rollup: each computed once."""
        if not self.exists("job_postings"):
            return
        self._swap_in(demand_rollup(self.table("job_postings")), "skill_demand")
        self._swap_in(cube_segments(self.table("skill_demand")), "demand_segments")

    def export_snapshots(self) -> None:
        if self.snapshot_root is None:
            return
        for table in ("job_postings", "skill_demand"):
            self.table(table).write.mode("overwrite").parquet(f"{self.snapshot_root}/{table}.parquet")
