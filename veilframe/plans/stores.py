"""Registered queries: stores that are changed in place by snapshots, results kept over runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.operators.findings_store import FindingsStore
from veilframe.plans import oracle_detection as O
from veilframe.plans import oracle_usage as U
from veilframe.plans.fixtures import AS_OF, text_table, usage
from veilframe.plans.registry import register
from veilframe.session import work_path
from veilframe.sources.snapshot_store import SnapshotStore

_ALL = "with " + U.USAGE_CTES
_COLUMNS = "event_id", "tenant_id", "tokens_out", "event_date"


def _filled(spark, sf_dir) -> SnapshotStore:
    store = SnapshotStore(spark, work_path(spark, "usage-store"))
    store.append(usage(spark, sf_dir))
    return store


@register("tenant_deleted_in_store", _ALL + " select event_id, tenant_id, tokens_out, cast(event_ts as date) as event_date from u where tenant_id <> 'globex'")
def tenant_deleted_in_store(spark, sf_dir):
    store = _filled(spark, sf_dir)
    store.delete_tenant("globex")
    return store.read().select(*_COLUMNS)


@register("retention_applied_in_store", _ALL + f"""
select event_id, tenant_id, tokens_out, cast(event_ts as date) as event_date from u where event_ts >= timestamp '{AS_OF}' - interval 14 day""")
def retention_applied_in_store(spark, sf_dir):
    store = _filled(spark, sf_dir)
    store.purge_older_than(AS_OF, 14)
    return store.read().select(*_COLUMNS)


@register("store_read_at_a_snapshot", _ALL + " select event_id, tenant_id, tokens_out, cast(event_ts as date) as event_date from u")
def store_read_at_a_snapshot(spark, sf_dir):
    store = _filled(spark, sf_dir)
    before = store.version()
    store.delete_tenant("acme")
    return store.read(version=before).select(*_COLUMNS)


@register("detection_from_store", "with " + ",\n".join([
    "docs_raw as (select doc_id, text from documents)", O.found_cte("docs_raw"), O.resolved_cte()]) + """
select d.doc_id, d.text in (select text from documents where doc_id % 2 = 0) as was_stored, cast(count(r.doc_id) as int) as n_spans
from documents d left join resolved r using (doc_id) group by d.doc_id, d.text""")
def detection_from_store(spark, sf_dir):
    """One half of the documents is detected first; then all are asked for, and its contents are known."""
    docs = text_table(spark, sf_dir, "documents").select("doc_id", "text")
    store = FindingsStore(spark, work_path(spark, "findings"))
    store.detect(docs.where("doc_id % 2 = 0"), "doc_id", "2024-01-30 12:00:00")
    found = store.detect(docs, "doc_id", "2024-01-30 12:01:00")
    return found.select("doc_id", "was_stored", F.size("spans").alias("n_spans"))
