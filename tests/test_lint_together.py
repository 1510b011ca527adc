"""Rules of a table that go to the texts together give what joins give, and no text moves."""

import random

import pytest

from veilframe.operators import policy as P


def _tables(spark):
    rng = random.Random(5)
    words = ["api", "Key", "é", "É", "ab", "aba", "A", " ", " ", "ſ", "K", "İ", "ς", "\U0001F600", "straße", "ÿ", "本", "\\E", "long phrase of many words"]
    some = lambda n: "".join(rng.choice(words) for _ in range(n))
    docs = spark.createDataFrame([(i, some(rng.randrange(40))) for i in range(150)] + [(900, None), (901, "")], "id int, text string")
    texts = sorted({some(rng.randrange(1, 4)) for _ in range(150)} | {"aba", "ABA", "aa", " ", "k", "s"})
    rules = spark.createDataFrame([(i, t, rng.choice(["block", "warn"])) for i, t in enumerate(texts)] + [(9000, None, "warn"), (9001, "not there", "warn")], "rule_index int, rule_text string, action string")
    return docs, rules


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("together", [P.TOGETHER, 60, 3])
def test_rules_together_give_what_joins_give(spark, monkeypatch, together):
    docs, rules = _tables(spark)
    texts = docs.selectExpr("id as __key", "text as __text").where("text is not null")
    want = _rows(P._joined(texts, rules.where("rule_text rlike '\\\\S'"), "id"))
    monkeypatch.setattr(P, "TOGETHER", together)
    if together == 60:
        # More rules than may go together, but few of them in the texts.
        more = spark.range(5000).selectExpr("cast(id + 20000 as int) as rule_index", "concat('no such rule ', id) as rule_text", "'warn' as action")
        rules, docs = rules.where("rule_index < 50").unionByName(more), docs
        want = [r for r in want if r[1] < 50]
    got = _rows(P.lint_with_table(docs, rules, "id", "text"))
    assert got == want and len(want) > 500


def test_no_text_moves(spark):
    docs = spark.range(100).selectExpr("id", "concat('Rule ', id % 7, ' and more, rule ', id) as text").repartition(4)
    rules = spark.range(300).selectExpr("cast(id as int) as rule_index", "concat('rule ', id) as rule_text", "'warn' as action")
    found = P.lint_with_table(docs, rules, "id", "text")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "strategy=broadcast" in plan and "Window" not in plan
    assert found.count() > 200


def test_all_rules_that_occur_are_present(spark):
    docs = spark.range(400).selectExpr("id as __key", "concat('x', id * 7919, ' Phrase', id, 'é') as __text")
    rules = spark.range(3000).selectExpr("cast(id as int) as rule_index", "if(id % 2 = 0, concat('phrase', id, 'é'), concat(id * 7919, ' ')) as rule_text", "'warn' as action")
    present = {r.rule_index for r in P._present(docs, P._anchored(rules)).collect()}
    wanted = {i for i in range(400)}
    assert wanted <= present and len(present) < 2000
