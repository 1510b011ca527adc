"""A pattern runs over a text once, and texts that hold the mark are cut all the same."""

from veilframe.functions.spans import MARK
from veilframe.operators import detect as D


def test_texts_are_cut_at_marks_and_not_matched_twice(spark):
    lines = [f"mail alice{i}@example.com now, ü 10.0.0.{i} and 123-45-6789" for i in range(4)]
    texts = ["; ".join(lines), f"{MARK} " + "; ".join(lines), lines[0] + MARK, lines[1] + " $x \\", "", None, "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = D.detect(docs)
    for row in found.collect():
        for s in row.spans:
            assert s.text == row.text[s.start : s.end]
            assert s.text.encode() == row.text.encode()[s.byte_start : s.byte_end]
    sizes = {r.id: len(r.spans) for r in found.collect()}
    assert sizes[0] == sizes[1] and sizes[0] >= 12 and sizes[2] == sizes[3] == 3
    assert sizes[4] == sizes[5] == sizes[6] == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # The plain cut, once, for texts with the mark; every rule marks its matches in one pass.
    assert plan.count("regexp_extract_all(") <= 4 and "regexp_replace(" in plan
