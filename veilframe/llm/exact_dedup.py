"""Exact duplicates through a persistent digest index, bucketed and sorted by hash.

The index is a Parquet table of one row per distinct text (digest, the batch that brought it, the row that
stays, how many rows had it then), stored in buckets by digest. New data comes in batches: its digests are
grouped (map-side combined, so a group of any size is one row), looked up by a sort-merge anti-join that never moves
the index, and those that no other batch has brought are appended, one sorted file per bucket. After
``COMPACT_AFTER`` batches the files of each bucket are merged into one.

A batch has a name. If it is run again, after a lost driver say, its own entries do not count as known and nothing is
appended twice: it gets the decisions of its first run. The layout (buckets, id type, folder in use) is
stored beside the data and wins over what a later caller asks for.

Texts are equal if they are identical without the characters 9 to 13 and 32. Of equal texts in a batch the
row with most characters in the original stays, then the smallest id; of repeated rows that tie
in both, one (which one is fixed when the digests are written). Null counts as empty; an id of
null comes last. Other columns are kept; nothing is dropped but duplicates.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import discard, placed, sized_join, written
from veilframe.session import work_path

_BLANK = " \t\n\x0b\x0c\r"
_INDEX = "digest STRING, batch STRING, keep_chars BIGINT, keep_id {id}, keep_row BIGINT, group_size BIGINT"
_LAYOUT = "version long, buckets int, id_type string, folder string, batches long"
#: Batches after which the files of a bucket are merged.
COMPACT_AFTER = 16
#: Batches in which ``duplicate_groups`` takes a table.
BATCHES = 2


def digest(text: str | Column) -> Column:
    """SHA-256 (lower-case hex) of a text without white space; null as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.translate(F.coalesce(column, F.lit("")), _BLANK, ""), 256)


class DigestIndex:
    """A digest index at a path of the shared folder; it can be opened again by a later session."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, id_type: str = "bigint"):
        self.spark, self.path = spark, path.rstrip("/")
        stored = self._stored_layout()
        if stored is None:
            stored = {"version": 0, "buckets": buckets, "id_type": id_type, "folder": "data-0", "batches": 0}
            self._store_layout(stored)
        self._use(stored)

    def _stored_layout(self) -> dict | None:
        try:
            rows = self.spark.read.schema(_LAYOUT).json(f"{self.path}/layout").orderBy(F.desc("version")).limit(1).collect()
        except AnalysisException:
            return None
        return rows[0].asDict() if rows else None

    def _store_layout(self, layout: dict) -> None:
        self.spark.createDataFrame([layout], _LAYOUT).coalesce(1).write.mode("append").json(f"{self.path}/layout")

    def _use(self, layout: dict) -> None:
        self.layout, self.buckets = layout, layout["buckets"]
        self.name = "digests_" + f"{self.path.rsplit('/', 1)[-1]}_{layout['folder']}".replace("-", "_")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({_INDEX.format(id=layout['id_type'])}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{layout['folder']}'"
        )
        self.spark.catalog.refreshTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unknown(self, groups: DataFrame, batch: str) -> DataFrame:
        """The groups whose digest no other batch has brought: sort-merge anti-join, the index stays in place."""
        others = self.table().where(F.col("batch") != batch).select("digest")
        return groups.join(others.hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add the groups as a batch, unless that batch is there already."""
        if self.table().where(F.col("batch") == batch).limit(1).count():
            return
        rows = groups.withColumn("batch", F.lit(batch)).select(self.table().columns)
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)
        layout = self.layout | {"version": self.layout["version"] + 1, "batches": self.layout["batches"] + 1}
        self._store_layout(layout)
        self._use(layout)
        if layout["batches"] % COMPACT_AFTER == 0:
            self.compact()

    def compact(self) -> None:
        """Merge the files of each bucket into a new folder, then let the layout name that one."""
        layout = self.layout | {"version": self.layout["version"] + 1}
        layout["folder"] = f"data-{layout['version']}"
        rows = self.rows()  # the plain files: a bucketed scan counts as dealt already
        self._use(layout)
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)
        self._store_layout(layout)
        self.spark.catalog.refreshTable(self.name)

    def rows(self) -> DataFrame:
        """The index without its layout, for joins that must be free to split groups."""
        return self.spark.read.schema(self.table().schema).parquet(f"{self.path}/{self.layout['folder']}")


def _groups(digests: DataFrame) -> DataFrame:
    """One row per digest: characters, id and place of the row that stays, and the number of rows."""
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("none"), "id", "row")
    groups = digests.groupBy("digest").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    return groups.select("digest", (-F.col("best.n")).alias("keep_chars"), F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")


def take(digests: DataFrame, index: DigestIndex, batch: str) -> tuple[DataFrame, DataFrame]:
    """Look up the groups of a batch and append the unknown ones; gives the groups brought and those known before."""
    groups = written(_groups(digests), "groups")
    fresh = written(index.unknown(groups, batch), "new-digests")
    index.append(fresh, batch)
    known = groups.join(fresh.select("digest"), "digest", "left_anti")
    return fresh, known


def _digests(docs: DataFrame, id_col: str, text_col: str, places: list[str], batches: int = 1) -> DataFrame:
    ident = F.col(f"`{id_col}`")
    return written(docs.select(
        ident.alias("id"), F.monotonically_increasing_id().alias("row"), *[F.col(c).alias(f"place_{i}") for i, c in enumerate(places)],
        digest(F.col(f"`{text_col}`")).alias("digest"), F.length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("long").alias("n_chars"),
        F.pmod(F.xxhash64(ident), F.lit(batches)).cast("int").alias("batch_no"),
    ), "digests")


def new_index(docs: DataFrame, id_col: str, path: str | None = None) -> DigestIndex:
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, path or work_path(spark, "digest-index"), buckets, docs.schema[id_col].dataType.simpleString())


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batch: str | None = None, batches: int = BATCHES
) -> DataFrame:
    """One row (id, digest, keep_id, group_size, kept) per row of ``docs``.

    With an index, the rows are one more batch: texts that it knew keep its decision, and their group size counts the
    rows that came with the first of them. Without one, the rows come to a new index in batches by a hash of
    their id, and the row that stays of each text is resolved over all batches: over what the index holds of
    the text and what later batches brought of it.
    """
    if index is not None:
        digests = _digests(docs, id_col, text_col, [])
        fresh, _ = take(digests, index, batch or uuid.uuid4().hex)
        mine = fresh.select("digest", F.lit(True).alias("fresh"))
        joined = digests.join(index.rows().select("digest", "keep_id", "keep_row", "group_size"), "digest").join(mine, "digest", "left")
        best = joined.join(fresh.select(F.col("keep_row").alias("row"), F.lit(True).alias("best")), "row", "left")
        return best.select("id", "digest", "keep_id", "group_size", (F.coalesce("fresh", F.lit(False)) & F.coalesce("best", F.lit(False))).alias("kept"))
    index = new_index(docs, id_col)
    digests = _digests(docs, id_col, text_col, [], batches)
    seen = None
    for i in range(batches):
        _, known = take(digests.where(F.col("batch_no") == i), index, f"batch-{i}")
        seen = known if seen is None else seen.unionByName(known)
    entries = index.rows().drop("batch").unionByName(seen)
    order = F.struct((-F.col("keep_chars")).alias("n"), F.col("keep_id").isNull().alias("none"), "keep_id", "keep_row")
    final = entries.groupBy("digest").agg(F.min(order).alias("best"), F.sum("group_size").alias("group_size"))
    final = written(final.select("digest", "best.keep_id", "best.keep_row", "group_size"), "decided-groups")
    return digests.join(final, "digest").select("id", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows that stay, with their own columns: of each text that the index does not know from another batch, one.

    A run that may have to be repeated names its batch, to get the same rows again.
    """
    index = index or new_index(docs, id_col)
    marked, places = placed(docs)
    digests = _digests(marked, id_col, text_col, places)
    fresh, _ = take(digests, index, batch or uuid.uuid4().hex)
    names = [f"place_{i}" for i in range(len(places))]
    stays = fresh.select("keep_row")
    dropped = written(digests.join(stays, F.col("row") == F.col("keep_row"), "left_anti").select(*[F.col(n).alias(p) for n, p in zip(names, places, strict=True)]), "dropped")
    discard(digests)
    return sized_join(marked, dropped, places, "left_anti").select([f"`{c}`" for c in docs.columns])
