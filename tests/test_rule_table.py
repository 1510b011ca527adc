"""Rules as a table on the detection path: literals of patterns, candidates, equality with plan constants."""

from __future__ import annotations

import random
import re

import pytest

from veilframe.functions.literals import required_literals
from veilframe.operators import rule_table as R
from veilframe.operators.detect import detect, explode_spans


@pytest.mark.parametrize("pattern,want", [
    (r"foo(?:bar|baz)\d+", ["foobar", "foobaz"]),
    (r"(?i)Pass(?:word)?: x", ["pass: x", "password: x"]),
    (r"\d{3}-\d{4}", ["-"]),
    (r"(?:ab)+c", ["ab"]),
    (r"a{2}b{1,}", ["aab"]),
    (r"[ab]c", ["ac", "bc"]),
    (r"foo.*barbaz", ["barbaz"]),
    (r"\Qa.b\E+", ["a.b"]),
    (r"(?=foo)bar", ["bar"]),
    (r"\d+|foo", None),
    (r"(?x) a b", None),
    (r"(unclosed", None),
    ("é", None),
    (None, None),
])
def test_required_literals(pattern, want):
    assert required_literals(pattern) == want


def test_a_match_contains_a_literal():
    rng = random.Random(5)
    parts = ["a", "b", "Ab", "ba+", "(?:ab|ba)", "(?:a|)", "[ab]", "[^a]", ".", "b?", "a*", "(?:ab){2}", "(?:b|aab)+", "c{1,2}", r"\bab", "^", "$", "(?=a)", "(?i:B)"]
    hits = 0
    for _ in range(4000):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 6)))
        if rng.random() < 0.3:
            pattern = f"{pattern}|{rng.choice(parts)}{rng.choice(parts)}"
        text = "".join(rng.choice("abcAB ") for _ in range(rng.randrange(12)))
        literals = required_literals(pattern)
        for m in re.finditer(pattern, text):
            hits += 1
            assert literals is None or any(x in m.group(0).lower() for x in literals), (pattern, text)
    assert hits > 2000


DENY = [r"\bproject-(?:x|y)\b", r"[A-Z]{3}\d{6}", r"(?i)SECRET", r"İs", "é+", r"(", r"a{2,}"]
ALLOW = [r"example\.com$", r"^10\.", r"7{3}"]
TEXTS = [
    "mail bob@example.com or bob@other.org about project-x", "host 10.1.2.3 and 11.2.3.4 ABC123456", "this ſecret", "caaar", "", None,
    "card 4111 1111 1111 1111 and 777-777-7777, call 555-123-4567", "éé İs project-y", "call 555-123-4567 " * 50,
]


def _rules(spark):
    rows = [("deny", f"d{i}", p, True) for i, p in enumerate(DENY)] + [("allow", f"a{i}", p, True) for i, p in enumerate(ALLOW)]
    rows += [("deny", "off", "call", False), ("deny", "null", None, True), ("deny", "blank", "", True), ("deny", "d1", DENY[1], True)]
    return spark.createDataFrame(rows, "list string, id string, pattern string, enabled boolean")


def _found(df):
    return sorted(tuple(r) for r in explode_spans(df, "k").collect())


def test_a_table_finds_what_plan_constants_find(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string")
    good = [p for p in DENY if p != "("]
    want = _found(detect(texts, deny=good, allow=ALLOW))
    assert _found(R.detect_with_rule_table(texts, _rules(spark), "k")) == want
    assert any(r[1] == "API_KEY" for r in want)


def test_owners_see_their_own_rules(spark):
    texts = spark.createDataFrame([(1, "ann", "project-x"), (2, "bob", "project-x"), (3, None, "project-x")], "k int, owner string, text string")
    rules = spark.createDataFrame([("deny", "1", "project-x", "ann"), ("deny", "2", "nothing", "bob"), ("deny", "3", "proj", None)], "list string, id string, pattern string, owner string")
    found = explode_spans(R.detect_with_rule_table(texts, rules, "k", scope="owner"), "k").collect()
    assert [(r.k, r.text) for r in found if r.pii_type == "API_KEY"] == [(1, "project-x")]


def test_refused_patterns_are_named(spark):
    bad = R.checked_patterns(_rules(spark)).where("not pattern_ok and pattern is not null").collect()
    assert [r.id for r in bad] == ["d5"]


def test_empty_tables(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string")
    none = _rules(spark).where("false")
    assert _found(R.detect_with_rule_table(texts, none, "k")) == _found(detect(texts))
    assert R.detect_with_rule_table(texts.where("false"), _rules(spark), "k").count() == 0


def test_the_plan_does_not_grow_with_the_rules(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string")

    def plan_size(n):
        rules = spark.range(n).selectExpr("'deny' as list", "cast(id as string) as id", "concat('word', id, '[0-9]') as pattern")
        plan = R.candidate_rules(texts, rules, "k")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan and "CartesianProduct" not in plan
        return len(plan.splitlines())

    assert plan_size(10) == plan_size(10_000)


def test_many_rules_give_few_candidates(spark):
    texts = spark.createDataFrame([(1, "see word77 and word9999."), (2, "no such thing")], "k int, text string")
    rules = spark.range(10_000).selectExpr("'deny' as list", "cast(id as string) as id", "concat('word', id, '[ .]') as pattern")
    met = R.candidate_rules(texts, rules, "k").collect()
    assert [(r.k, sorted(x.pattern for x in r.rules)) for r in met] == [(1, ["(?U)word77[ .]", "(?U)word9999[ .]"])]
