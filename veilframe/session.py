"""Session helpers: reading the given tables and finding the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, zone-free timestamps read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zone_free = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    for name_ in zone_free:
        df = df.withColumn(name_, F.col(name_).cast("timestamp"))
    return df


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy work on an input of few splits.

    A large table has more splits than cores and is left alone; a table in one small file
    would otherwise be scanned by one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests on one
    machine) a local folder is used.
    """
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if configured:
        return configured
    configured = spark.sparkContext.getConf().get(CHECKPOINT_SETTING, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a shared folder")
    local = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(CHECKPOINT_SETTING, local)
    return local


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: A looked-up side is broadcast only when it is known to have at most so many (narrow) rows.
BROADCAST_ROWS = 100_000
#: Copies of a larger looked-up side, so that a frequent value is not one task's work.
REPLICAS = 32


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: evaluated once, survives lost executors."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup_join(facts: DataFrame, dim: DataFrame, on: list[str], how: str = "left", most: int = BROADCAST_ROWS, unique: bool = False) -> DataFrame:
    """Facts with the columns of a table of one row per key (few columns, its size not known beforehand).

    The table is written and counted. Up to ``most`` rows it is broadcast and the facts stay in place. A larger
    one is repeated ``REPLICAS`` times, so that the facts of a frequent key are dealt over as many tasks; with ``unique``
    (each key is in one row of the facts) there is no frequent key, and it is joined as it is.
    """
    small = stored(dim, "lookup")
    if small.limit(most + 1).count() <= most:
        return facts.join(F.broadcast(small), on, how)
    if unique:
        return facts.join(small, on, how)
    copies = small.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(REPLICAS - 1))))
    dealt = facts.withColumn("__copy", F.pmod(F.monotonically_increasing_id(), F.lit(REPLICAS)).cast("int"))
    return dealt.join(copies, [*on, "__copy"], how).drop("__copy")
