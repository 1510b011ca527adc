"""Statistics of audit entries hold the totals of each type besides the number of entries and entities."""

from veilframe.sources import audit_store as A


def test_statistics_hold_the_totals_of_each_type(spark):
    rows = [("1", 3, [("URL", 2), ("US_SSN", 1)]), ("2", 1, [("URL", 1)]), ("3", 0, []), ("4", None, None), ("5", 5, [("IBAN", 4), ("IBAN", 1)])]
    entries = spark.createDataFrame(rows, f"id string, total_entities bigint, entity_types {A.ENTITY_TYPES}")
    (got,) = A.audit_stats(entries).collect()
    assert (got.total_requests, got.total_entities) == (5, 9)
    assert [tuple(e) for e in got.entity_breakdown] == [("IBAN", 5), ("URL", 3), ("US_SSN", 1)]
    (none,) = A.audit_stats(entries.where("false")).collect()
    assert tuple(none) == (0, 0, [])


def test_the_query_names_each_type(spark, sf_dir):
    from veilframe.plans import REGISTRY

    (row,) = REGISTRY["audit_stats"].run(spark, sf_dir).collect()
    totals = {r.entity_type: r.n for r in REGISTRY["audit_entity_totals"].run(spark, sf_dir).collect()}
    assert row.entity_breakdown == ";".join(f"{t}:{n}" for t, n in sorted(totals.items())) and row.total_entities == sum(totals.values()) > 0
