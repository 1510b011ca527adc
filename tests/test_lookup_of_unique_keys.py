"""A looked-up side beyond the broadcast bound is not repeated where the facts have each key once."""

from veilframe.session import REPLICAS, lookup_join


def test_unique_keys_are_joined_without_copies(spark):
    facts = spark.range(500).selectExpr("id as k", "concat('t', id) as text")
    dim = spark.range(0, 500, 2).selectExpr("id as k")
    plain = lookup_join(facts, dim, ["k"], "inner", most=10, unique=True)
    assert {(r.k, r.text) for r in plain.collect()} == {(i, f"t{i}") for i in range(0, 500, 2)}
    assert "__copy" not in plain._jdf.queryExecution().optimizedPlan().toString()
    dealt = lookup_join(facts, dim, ["k"], "inner", most=10)
    assert REPLICAS > 1 and "__copy" in dealt._jdf.queryExecution().optimizedPlan().toString()
    assert dealt.count() == plain.count()
