"""Digest index: batches that are run again, stored layout, compaction; rows told apart without a copy."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from tests.llm import brute
from veilframe.llm import common, exact_dedup
from veilframe.session import work_path

SCHEMA = "doc_id long, text string"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_batch_that_is_run_again_gets_its_rows_again(spark):
    index = exact_dedup.DigestIndex(spark, work_path(spark, "index"), 4)
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], SCHEMA)
    second = spark.createDataFrame([(5, "a"), (6, "c"), (7, " c")], SCHEMA)
    run = lambda docs, name: exact_dedup.drop_duplicates(docs, index=index, batch=name)
    once = _rows(run(first, "one"))
    assert [r[0] for r in once] == [1, 3, 4]
    assert _rows(run(first, "one")) == once
    assert [r[0] for r in _rows(run(second, "two"))] == [7]
    assert _rows(run(first, "one")) == once and [r[0] for r in _rows(run(second, "two"))] == [7]
    assert index.table().count() == 4
    assert _rows(run(first, "three")) == []


def test_the_stored_layout_wins_and_buckets_are_merged(spark):
    path = work_path(spark, "index")
    index = exact_dedup.DigestIndex(spark, path, 4)
    for i in range(5):
        exact_dedup.drop_duplicates(spark.createDataFrame([(i * 100 + k, f"text {i} {k}") for k in range(50)], SCHEMA), index=index, batch=str(i))
    again = exact_dedup.DigestIndex(spark, path, 8)
    assert again.buckets == 4 and again.table().count() == 250
    files = len(again.rows().inputFiles())
    again.compact()
    assert len(again.rows().inputFiles()) == 4 < files
    assert exact_dedup.DigestIndex(spark, path, 8).table().count() == 250
    assert exact_dedup.drop_duplicates(spark.createDataFrame([(1, "text 0 0"), (2, "new")], SCHEMA), index=exact_dedup.DigestIndex(spark, path, 8)).collect() == [(2, "new")]


def test_groups_over_several_batches(spark):
    texts = [*brute.HARD, *[f"t {i % 7}" + " " * (i % 5) for i in range(60)], None]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    strip = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups: dict[str, list] = {}
    for i, t in enumerate(texts):
        groups.setdefault(strip(t), []).append((-len(t or ""), i))
    want = {i: (min(groups[strip(t)])[1], len(groups[strip(t)])) for i, t in enumerate(texts)}
    for batches in (1, 2, 5):
        got = exact_dedup.duplicate_groups(docs, batches=batches).collect()
        assert {r.id: (r.keep_id, r.group_size) for r in got} == want
        assert {r.id for r in got if r.kept} == {k for k, _ in want.values()}


def test_the_query_looks_up_by_anti_join(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    index = exact_dedup.new_index(docs, "doc_id")
    groups = exact_dedup._groups(exact_dedup._digests(docs, "doc_id", "text", []))
    plan = index.unknown(groups, "x")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange hashpartitioning") == 1


def test_rows_are_told_apart(spark):
    path = work_path(spark, "docs")
    spark.createDataFrame([(1, "a")] * 50 + [(2, None)] * 7, SCHEMA).repartition(6).write.parquet(path)
    stored = spark.read.parquet(path)
    for docs in (stored, stored.where("doc_id = 1"), stored.withColumn("OF_FILE", F.lit(1)), stored.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("in_file"))):
        marked, places = common.placed(docs)
        seen = Counter(map(tuple, marked.select(*places).collect()))
        assert len(seen) == docs.count() and max(seen.values()) == 1
        assert marked.drop(*places).columns == docs.columns
