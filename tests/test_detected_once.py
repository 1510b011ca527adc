"""Queries that read sanitized texts twice detect once."""

import pytest

from veilframe.plans import REGISTRY


@pytest.mark.parametrize("name", ["roundtrip_check", "raw_leak_audit"])
def test_plan_holds_no_second_detection(spark, sf_dir, name):
    """The detection ran into a stored table; what is left to run holds none of its patterns (there were two of each)."""
    plan = REGISTRY[name].run(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and "regexp_extract_all(text" not in plan
