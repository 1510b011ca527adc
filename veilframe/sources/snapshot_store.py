"""A store of usage events with snapshots: deletion and retention that change what is stored.

Events lie in folders ``data/event_date=<day>/part=<id>``, written once and never changed. A snapshot is a small
manifest that lists the folders in use; the newest complete manifest is the store. Appending adds folders,
deleting rewrites only the folders that hold rows to go, and both end with the write of the next manifest. A run
that dies before that leaves unlisted folders and an unchanged store; ``vacuum`` removes such folders and
those of old snapshots.

Manifests have one row per day and part. Reading lists the folders of the snapshot, of the days asked for if any, so
other days are not even listed. A writer that finds another snapshot than the one it began with fails and can be
run again.

Defined results: events without a time are kept in a folder of their own day (null) and never purged by age; deleting a
tenant that has no events writes nothing; an empty batch writes nothing; an empty store reads as no events.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.sources.usage_store import DAY, RETENTION_DAYS, USAGE_SCHEMA, upgrade_events

_MANIFEST = "version long, day string, part string"
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


class SnapshotStore:
    """Usage events below a path of the shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ── snapshots ──

    def _manifests(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifests")
        except AnalysisException:
            return None

    def version(self) -> int:
        """The newest complete snapshot, 0 before the first."""
        found = self._manifests()
        newest = found.agg(F.max("version")).first()[0] if found is not None else None
        return newest or 0

    def parts(self, version: int | None = None) -> list[tuple[str | None, str]]:
        """(day, part) of the folders of a snapshot; days of a calendar, so few."""
        version = self.version() if version is None else version
        found = self._manifests()
        if found is None:
            return []
        rows = found.where((F.col("version") == version) & F.col("part").isNotNull()).select("day", "part").collect()
        return sorted(((r.day, r.part) for r in rows), key=lambda p: (p[0] or "", p[1]))

    def _switch(self, before: int, parts: Sequence[tuple[str | None, str]]) -> None:
        """Make the parts the store. The file appears as a whole when its write is committed."""
        if self.version() != before:
            raise RuntimeError(f"the store was changed by another writer (snapshot {self.version()}, begun with {before})")
        rows = [(before + 1, day, part) for day, part in parts] or [(before + 1, None, None)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/at={before + 1}")

    def _folder(self, day: str | None, part: str) -> str:
        return f"{self.path}/data/{DAY}={_NO_DAY if day is None else day}/part={part}"

    # ── reading and writing ──

    def _read(self, parts: Sequence[tuple[str | None, str]]) -> DataFrame:
        fields = [*USAGE_SCHEMA.fields, T.StructField(DAY, T.DateType()), T.StructField("part", T.StringType())]
        schema = T.StructType(fields)
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*[self._folder(d, p) for d, p in parts])

    def read(self, since: str | None = None, version: int | None = None) -> DataFrame:
        """Events of a snapshot (the newest), with their day; of the days since a date only, if given."""
        listed = [(d, p) for d, p in self.parts(version) if since is None or (d is not None and d >= since)]
        return self._read(listed).drop("part")

    def _write(self, events: DataFrame) -> list[tuple[str | None, str]]:
        """Write events as one more part of each of their days."""
        part = uuid.uuid4().hex
        rows = events.withColumn("part", F.lit(part))
        rows.write.mode("append").partitionBy(DAY, "part").parquet(f"{self.path}/data")
        try:
            written = self.spark.read.option("basePath", f"{self.path}/data").parquet(f"{self.path}/data/*/part={part}")
        except AnalysisException:
            return []
        return [(None if r.day is None else str(r.day), part) for r in written.select(F.col(DAY).alias("day")).distinct().collect()]

    def append(self, events: DataFrame) -> int:
        """Add events; gives the version of the new snapshot."""
        before = self.version()
        full = upgrade_events(events.drop(DAY)).withColumn(DAY, F.to_date("event_ts"))
        parts = self._write(full)
        if parts:
            self._switch(before, [*self.parts(before), *parts])
        return self.version()

    # ── changing ──

    def _drop_rows(self, goes: Column, may_hold: Callable[[str | None], bool]) -> int:
        """Rewrite the parts that hold rows to go; gives the number of rows gone."""
        before = self.version()
        listed = self.parts(before)
        looked_at = [p for p in listed if may_hold(p[0])]
        gone = F.coalesce(goes, F.lit(False))
        held = self._read(looked_at).where(gone).groupBy(F.col(DAY).alias("day"), "part").agg(F.count("*").alias("n")).collect()
        touched = {(None if r.day is None else str(r.day), r.part) for r in held}
        if not touched:
            return 0
        kept = self._write(self._read(sorted(touched, key=lambda p: (p[0] or "", p[1]))).where(~gone).drop("part"))
        self._switch(before, [*[p for p in listed if p not in touched], *kept])
        return sum(r.n for r in held)

    def delete_tenant(self, tenant: str) -> int:
        """Remove a tenant's events; days without any keep their files. Gives the number of events removed."""
        return self._drop_rows(F.col("tenant_id") == tenant, lambda day: True)

    def purge_older_than(self, as_of: str, days: int = RETENTION_DAYS) -> int:
        """Remove events older than the retention time; only days up to the border are looked at."""
        cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(days)} days")
        border = str(self.spark.range(1).select(F.to_date(cutoff)).first()[0])
        return self._drop_rows(F.col("event_ts") < cutoff, lambda day: day is not None and day <= border)

    def vacuum(self, keep: int = 1) -> int:
        """Delete folders that none of the newest ``keep`` snapshots lists; gives their number."""
        newest = self.version()
        used = {self._folder(d, p) for v in range(max(1, newest - keep + 1), newest + 1) for d, p in self.parts(v)}
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/*/part=*")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        count = 0
        for found in files.globStatus(root) or []:
            name = found.getPath().toString()
            if not any(name.endswith(folder.split("://", 1)[-1].lstrip("/")) for folder in used):
                files.delete(found.getPath(), True)
                count += 1
        return count
