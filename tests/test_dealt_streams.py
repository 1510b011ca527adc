"""A micro-batch is worked on by all cores, however few files it has."""

from pyspark.sql import functions as F

from veilframe.session import work_path
from veilframe.streaming import jobs as J


def test_one_file_is_dealt_over_many_tasks(spark):
    """One file used to be one task."""
    base = work_path(spark, "dealt")
    spark.range(400).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).coalesce(1).write.parquet(f"{base}/in")
    rows = spark.readStream.schema("doc_id long, text string").parquet(f"{base}/in")
    J.run_to_parquet(J.dealt(rows, "doc_id"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    per_task = [r["count"] for r in out.groupBy(F.input_file_name()).count().collect()]
    assert sum(per_task) == 400 == out.distinct().count() and len(per_task) >= 8 and max(per_task) <= 100
