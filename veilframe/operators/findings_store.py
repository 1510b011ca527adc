"""A store of detection results by content: what was detected before is not detected again.

Contents are known by their SHA-256. A run looks its hashes up in the store, detects one text of each content that
the store does not hold (or holds longer than the life time), adds the results and hands them to all copies.
Only hashes, keys and spans move: contents are grouped by hash, not by text; a text is read where it lies and
detected there if its row is the one chosen for its hash.

The store is a folder of runs, each a Parquet folder of (content_hash, spans, detected_at) of the settings' own, so
results of other recognizers are not mixed up. ``compact`` evicts what is too old and what is beyond the capacity
(the oldest runs first, whole runs) and writes one folder in place of many.

Defined results: null texts have no findings and are not stored; the copies of a content share one result; a run that
is repeated at the same time finds its contents stored; empty tables and stores are fine.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.spans import SPANS, no_spans
from veilframe.operators.detect import detect
from veilframe.session import lookup_join, stored

LIFE_SECONDS, CAPACITY = 300, 1_000_000_000
_ENTRY = f"content_hash string, spans {SPANS}, detected_at timestamp"


class FindingsStore:
    """Results of one set of detection settings below a path of the shared folder."""

    def __init__(self, spark: SparkSession, path: str, life_seconds: int = LIFE_SECONDS, capacity: int = CAPACITY, **layers):
        self.spark, self.path, self.life, self.capacity, self.layers = spark, path.rstrip("/"), life_seconds, capacity, layers

    def entries(self) -> DataFrame:
        """All stored results, also those past their life."""
        try:
            return self.spark.read.schema(_ENTRY).option("recursiveFileLookup", "true").parquet(f"{self.path}/runs")
        except AnalysisException:
            return self.spark.createDataFrame([], _ENTRY)

    def alive(self, as_of: str) -> DataFrame:
        """The newest result of each content within its life time."""
        since = F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(self.life)} seconds")
        rows = self.entries().where((F.col("detected_at") > since) & (F.col("detected_at") <= F.lit(as_of).cast("timestamp")))
        return rows.groupBy("content_hash").agg(F.max_by("spans", "detected_at").alias("spans"))

    def _add(self, found: DataFrame, as_of: str) -> None:
        rows = found.withColumn("detected_at", F.lit(as_of).cast("timestamp"))
        rows.select("content_hash", "spans", "detected_at").write.parquet(f"{self.path}/runs/{uuid.uuid4().hex}")

    def detect(self, df: DataFrame, key: str, as_of: str, text_col: str = "text", out: str = "spans") -> DataFrame:
        """(key, content_hash, was_stored, spans) of every row; ``key`` is unique."""
        hashes = stored(df.select(F.col(key).alias("k"), F.sha2(F.col(text_col), 256).alias("content_hash")), "content-hashes")
        chosen = hashes.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min("k").alias("k"))
        known = stored(self.alive(as_of), "known-results")
        unseen = chosen.join(known.select("content_hash"), "content_hash", "left_anti")
        fresh = lookup_join(df.select(F.col(key).alias("k"), F.col(text_col).alias("__text")), unseen.select("k"), ["k"], "inner", unique=True)
        # The hash is taken anew where the text is, rather than moved.
        fresh = fresh.withColumn("content_hash", F.sha2("__text", 256))
        found = stored(detect(fresh, "__text", out="spans", **self.layers).select("content_hash", "spans"), "new-results")
        self._add(found, as_of)
        results = known.withColumn("was_stored", F.lit(True)).unionByName(found.withColumn("was_stored", F.lit(False)))
        joined = hashes.join(results, "content_hash", "left")
        return joined.select(F.col("k").alias(key), "content_hash", F.coalesce("was_stored", F.lit(False)).alias("was_stored"), F.coalesce("spans", no_spans()).alias(out))

    def compact(self, as_of: str) -> dict[str, int]:
        """Evict results past their life, then the oldest beyond the capacity; gives the numbers evicted and kept."""
        since = F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(self.life)} seconds")
        all_ = stored(self.entries(), "all-results")
        newest = stored(all_.groupBy("content_hash").agg(F.max_by("spans", "detected_at").alias("spans"), F.max("detected_at").alias("detected_at")), "newest-results")
        valid = newest.where(F.col("detected_at") > since)
        # The time from which results fit into the capacity, from counts per time.
        times = valid.groupBy("detected_at").agg(F.count("*").alias("n")).orderBy(F.desc("detected_at")).collect()
        fits, border = 0, None
        for t in times:
            if fits + t.n > self.capacity:
                break
            fits, border = fits + t.n, t.detected_at
        kept = valid.where(F.col("detected_at") >= F.lit(border)) if border is not None else valid.where("false")
        before = [p.getPath() for p in self._runs()]
        total, size = newest.count(), kept.count()
        kept.write.parquet(f"{self.path}/runs/{uuid.uuid4().hex}")
        files = self._root().getFileSystem(self.spark._jsc.hadoopConfiguration())
        for run in before:
            files.delete(run, True)
        return {"kept": size, "evicted": total - size}

    def _root(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs/*")

    def _runs(self) -> list:
        return list(self._root().getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(self._root()) or [])


def store_counts(found: DataFrame) -> DataFrame:
    """Of a run: distinct contents that were stored (hits) and that had to be detected (misses)."""
    contents = found.where(F.col("content_hash").isNotNull()).select("content_hash", "was_stored").distinct()
    return contents.agg(
        F.count(F.when(F.col("was_stored"), 1)).alias("hits"), F.count(F.when(~F.col("was_stored"), 1)).alias("misses"))
