"""Work that must not grow faster than the rows: window frames, state calls, joins on grams."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from veilframe.operators import limits as L
from veilframe.operators import policy as P
from veilframe.operators import rule_table as T
from veilframe.streaming import state as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trailing_counts_use_growing_frames_only(spark):
    rng = random.Random(4)
    rows = [(i, "k", rng.randrange(3 * 3600)) for i in range(400)]
    rows += [(400 + i, "k", t) for i, t in enumerate([60, 60, 120, 3600, 3660, 7200])]
    df = spark.createDataFrame(rows, "event_id long, client_id string, s long").withColumn("ts", F.timestamp_seconds("s"))
    used = L.rate_limit_usage(df)
    frames = plan(used).split("RangeFrame, ")[1:]
    assert frames and all(f.startswith("unboundedpreceding") for f in frames)
    times = [t for _, _, t in rows]
    want = {i: (sum(t - 60 < x <= t for x in times), sum(t - 3600 < x <= t for x in times)) for i, _, t in rows}
    assert {r.event_id: (r.last_minute, r.last_hour) for r in used.collect()} == want


class _Cell:
    """Value, list and map state in memory; every access is counted."""

    def __init__(self, calls):
        self.calls, self.map, self.value = calls, {}, None

    def __getattr__(self, name):
        done = {
            "containsKey": lambda k: k in self.map, "getValue": lambda k: self.map[k], "updateValue": self.map.__setitem__,
            "removeKey": lambda k: self.map.pop(k), "iterator": lambda: iter(list(self.map.items())), "keys": lambda: iter(list(self.map)),
            "values": lambda: iter(list(self.map.values())), "exists": lambda: self.value is not None, "get": lambda: self.value or (),
            "update": lambda v: setattr(self, "value", v), "put": lambda v: setattr(self, "value", v), "clear": lambda: setattr(self, "value", None),
        }[name]
        self.calls.append(name)
        return done


class _Handle:
    def __init__(self):
        self.calls, self.timers = [], []
        self.getMapState = self.getValueState = self.getListState = lambda *_: _Cell(self.calls)
        self.listTimers = lambda: list(self.timers)
        self.deleteTimer, self.registerTimer = self.timers.remove, self.timers.append


class _Watermark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def _lifetimes(minutes, watermarks):
    """Results of one row a minute, after each watermark; and the calls of the state."""
    token, handle = S.TokenLifetime(30 * L.MINUTE), _Handle()
    token.init(handle)
    rows = pd.DataFrame({"us": [m * L.MINUTE for m in minutes], "row_id": list(minutes), "value": ["a" if m == 0 else None for m in minutes]})
    list(token.handleInputRows(("s", "t"), iter([rows]), None))
    out = [pd.concat([*token.handleExpiredTimer(("s", "t"), _Watermark(w * 60_000), None), pd.DataFrame()]) for w in watermarks]
    return [dict(zip(o.get("row_id", []), o.get("found", []))) for o in out], handle


def test_state_calls_follow_hours_not_minutes():
    (found,), handle = _lifetimes(range(240), [300])
    assert found == {m: "a" for m in range(240)}
    assert len(handle.calls) < 60


def test_minutes_are_decided_when_they_are_over():
    (first, second, third), handle = _lifetimes([0, 10, 20, 51, 52, 70], [21, 52, 90])
    assert first == {0: "a", 10: "a", 20: "a"}
    assert second == {51: None}
    assert third == {52: None, 70: None}
    assert handle.timers == []


def test_equal_patterns_are_one_rule_and_only_numbers_move(spark):
    texts = spark.createDataFrame([(1, "see word7 here"), (2, "nothing")], "k int, text string")
    rules = spark.range(500).selectExpr("'deny' as list", "lpad(cast(id as string), 4, '0') as id", "concat('word', id % 10) as pattern")
    met = T.candidate_rules(texts, rules, "k")
    assert [(r.k, [(x.place.split("\x01")[0], x.pattern) for x in r.rules]) for r in met.collect()] == [(1, [("0007", "(?U)word7")])]
    exploded = [line for line in plan(met).splitlines() if "Generate explode(grams" in line]
    assert exploded and not any("text#" in line.split("],")[0] for line in exploded)


def test_anchors_of_many_numbered_rules_are_shared_by_few(spark):
    rules = spark.range(20_000).selectExpr("id as rule_index", "concat('Brand#', id % 7, ' ', id) as rule_text", "'warn' as action")
    shared = P._anchored(rules).groupBy("gram").count()
    assert shared.agg(F.max("count"), F.sum("count")).first()[:] == (1, 20_000)
    texts = spark.createDataFrame([(1, "of BRAND#3 10 and brand#5 19997, 12345 123"), (2, "brand# 3 10")], "k int, text string")
    blank = spark.createDataFrame([(-1, "  ", "warn")], "rule_index long, rule_text string, action string")
    found = P.lint_with_table(texts, rules.unionByName(blank), "k", "text").collect()
    want = [(t, 3) for t in ("Brand#3 10",)] + [(f"Brand#5 {n}", 18) for n in (19, 19997) if n % 7 == 5]
    assert sorted((r.rule_text, r.start) for r in found) == sorted(want)
