"""The corpus pipeline: quality rules, exact and near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import fresh_name, placed, sized_join, written
from veilframe.llm.exact_dedup import drop_duplicates
from veilframe.llm.mixing import mix
from veilframe.llm.packing import pack
from veilframe.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_SHARE, MIX_WEIGHTS, mix_levels
from veilframe.llm.repetition import keep_varied
from veilframe.llm.similar import keep_one_of_similar
from veilframe.session import table

#: Packing cuts by a tokenizer, which SQL cannot express; the stages are tested one by one.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    return keep_varied(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingle sets of similarity 0.8 the document with the smallest id stays.

    SimHash fingerprints met by Golay keys link the closest copies, MinHash keys the others.
    """
    return keep_one_of_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents are taken as often as their leaf's budget says."""
    marked, places = placed(docs)
    times, copy = fresh_name(marked, "times"), fresh_name(marked, "copy")
    mixed = mix(marked, mix_levels(), MIX_SHARE, MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED, id_cols=places, key_cols=("doc_id",))
    taken = mixed.where("n_copies > 0").select(*[F.col(f"id_{i}").alias(p) for i, p in enumerate(places)], F.col("n_copies").cast("int").alias(times))
    rows = sized_join(marked, written(taken, "copies"), places, "inner")
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(times)))).select([f"`{c}`" for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids."""
    pieces, _ = pack(docs)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
