"""Allow and deny rules as a table on the detection path: texts and rules meet on grams.

Pattern rules that live in a table cannot become part of the plan, and trying every rule on every text is a
cross join. A rule's pattern is read once for the literals that a match must contain; of each literal one gram of
up to ``GRAM`` characters, the one that fewest rules have, goes into an index. A text meets the rules that own one of its
grams; the literals are checked in the text, and only then the pattern runs. Rules without a literal meet every
text under the empty gram: for them the pattern itself is all there is to test.

Equal patterns of a list and owner are one rule, that of the first of them: their matches are the same. Up to ``TOGETHER``
distinct rules go to the texts: the literals of all of them are found in a batch of texts at once (``phrases``), nothing
moves. Of the rules that a text has literals for, those that Python reads as the engine does (``agreed``) are
matched in the same pass, where matches begin with a literal only at its places; the others are tried by the engine. Of more rules than that grams of texts are dropped in place
unless some rule owns them, only (text key, rule number) pairs move, and the rules met come back to a text as one array;
literals, matching, positions and overlaps are computed next to the text as for patterns in the plan. The plan
is the same for any number of rules within either.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.agreed import BLIND, agreed
from veilframe.functions.arrays import bound
from veilframe.functions.columns import pinned
from veilframe.functions.literals import folded, leading_literals, required_literals
from veilframe.functions.phrases import Phrases
from veilframe.functions.spans import DENY_CONFIDENCE, DENY_TYPE, layer_rank, resolve_overlaps, span_struct
from veilframe.functions.taxonomy import DEFAULT_SPECIFICITY, SPECIFICITY
from veilframe.operators.detect import find_spans
from veilframe.session import BROADCAST_ROWS, stored

GRAM = 3
#: So many distinct rules are searched together.
TOGETHER = 10_000
#: So many texts are searched at a time.
TEXTS = 256
#: Rules tried together on one text, with what the engine needs to run them.
RULE = "struct<list:string,place:string,pattern:string>"


def checked_patterns(rules: DataFrame) -> DataFrame:
    """Add ``pattern_ok``: whether the engine that runs the patterns accepts them. One pass over the table."""
    tried = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.concat(F.lit("(?U)"), F.col("pattern")))
    return rules.withColumn("pattern_ok", tried.isNotNull())


def _place(rules: DataFrame) -> Column:
    """Sort key of a rule: age, then id, then pattern, as far as the table has them."""
    return F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("created_at", "id", "pattern") if c in rules.columns])


def listed_rules(rules: DataFrame, scope: str | None = None) -> DataFrame:
    """(scope, rule, literals) of the enabled rules with a valid pattern, one row per scope, list and pattern.

    ``rules``: list ('allow' or 'deny'), pattern, and if there are any: enabled, created_at, id and the scope.
    """
    read = F.udf(required_literals, "array<string>", useArrow=True)
    usable = checked_patterns(rules.where(F.coalesce(F.col("pattern"), F.lit("")) != "")).where("pattern_ok")
    if "enabled" in rules.columns:
        usable = usable.where(F.coalesce(F.col("enabled"), F.lit(True)))
    own = F.lit("") if scope is None else F.col(scope).cast("string")
    first = usable.groupBy(own.alias("scope"), "list", "pattern").agg(F.min(_place(rules)).alias("place"))
    rule = F.struct("list", "place", F.concat(F.lit("(?U)"), F.col("pattern")).alias("pattern")).cast(RULE)
    return first.select("scope", rule.alias("rule"), read("pattern").alias("literals"))


def rule_index(numbered: DataFrame) -> DataFrame:
    """(scope, gram, number) of the rules (number, scope, literals); see the module's text."""
    literal = numbered.select("scope", "number", F.explode_outer("literals").alias("literal"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("literal") - GRAM + 1, F.lit(1)))
    grams = F.when(F.col("literal").isNull(), F.array(F.lit(""))).otherwise(
        F.array_distinct(F.transform(starts, lambda i: F.substring("literal", i, F.lit(GRAM)))))
    offered = literal.withColumn("gram", F.explode(grams))
    shared = offered.groupBy(F.col("scope").alias("s"), F.col("gram").alias("g")).agg(F.count("*").alias("rules"))
    scored = offered.join(shared, F.col("scope").eqNullSafe(F.col("s")) & (F.col("gram") == F.col("g")))
    best = scored.groupBy("scope", "number", "literal").agg(F.min(F.struct("rules", "gram")).alias("best"))
    return best.select("scope", F.col("best.gram").alias("gram"), "number").distinct()


def _sized(df: DataFrame) -> DataFrame:
    """A stored table, broadcast if it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def text_grams(text: Column) -> Column:
    """All distinct grams of 1 to ``GRAM`` characters of a folded text, and the empty one."""
    ahead = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{GRAM}}}))"), F.lit(1)))
    first = lambda n: F.transform(ahead, lambda g: F.substring(g, F.lit(1), F.lit(n)))
    return F.array_distinct(F.concat(F.array(F.lit("")), ahead, *[first(n) for n in range(1, GRAM)]))


def _has_literal(text: Column, rule: Column) -> Column:
    """Whether a folded text has a literal of a (rule, literals); always where the rule needs none."""
    return rule["literals"].isNull() | F.exists(rule["literals"], lambda x: F.contains(text, x))


def _with_many_rules(df: DataFrame, listed: DataFrame, key: str, text_col: str, scope: str | None) -> DataFrame:
    """Add ``__rules``: for each text the (rule, literals) it has the literals for, in order; the rules come by a join."""
    numbered = stored(listed.withColumn("number", F.monotonically_increasing_id()), "numbered-rules")
    index = stored(rule_index(numbered), "rule-index")
    anchors = stored(index.select("gram").distinct(), "anchors")

    text = folded(F.coalesce(F.col(text_col), F.lit("")))
    read = df.select(F.col(key).alias("__rule_key"), _own(scope).alias("text_scope"), text_grams(text).alias("grams"))
    held = read.select("__rule_key", "text_scope", F.explode("grams").alias("gram")).join(_sized(anchors), "gram", "left_semi")
    pairs = held.withColumnRenamed("gram", "text_gram").join(_sized(index), (F.col("text_scope") == F.col("scope")) & (F.col("text_gram") == F.col("gram")))
    met = pairs.select("__rule_key", "number").distinct().join(numbered.select("number", F.struct("rule", "literals").alias("r")), "number")
    met = met.groupBy("__rule_key").agg(F.array_sort(F.collect_list("r")).alias("__met"))
    step = df.join(met, F.col(key) == F.col("__rule_key"), "left")
    entry = lambda r: F.struct(r["rule"].alias("rule"), r["literals"].alias("literals"))
    found = bound(text, lambda t: F.transform(F.filter("__met", lambda r: _has_literal(t, r)), entry))
    return pinned(step, {"__rules": F.coalesce(found, F.array().cast(f"array<struct<rule:{RULE},literals:array<string>>>"))}).drop("__rule_key", "__met")


def _own(scope: str | None) -> Column:
    return F.lit("") if scope is None else F.col(scope).cast("string")


class Together:
    """Rules (scope, list, place, pattern, literals) in order, to be met by batches of texts."""

    #: The last rules used in this process.
    built: dict[str, Together] = {}

    def __init__(self, rules: list[tuple]):
        self.rules = rules
        patterns = [r[3].removeprefix("(?U)") for r in rules]
        self.match = [agreed(p) for p in patterns]
        # Where matches of a rule begin with a literal that is not too common, its places are all there is to try.
        leads = [leading_literals(p) if how else None for p, how in zip(patterns, self.match)]
        self.led = [lead is not None and (lead == r[4] or min(map(len, lead)) >= GRAM) for lead, r in zip(leads, rules)]
        sought = [lead if led else r[4] for lead, led, r in zip(leads, self.led, rules)]
        literals = sorted({x for some in sought for x in some or ()})
        place = {x: i for i, x in enumerate(literals)}
        pairs = sorted((place[x], i) for i, some in enumerate(sought) for x in some or ())
        self.phrases = Phrases(literals)
        self.rule = np.array([i for _, i in pairs], np.int64)
        self.begin = np.searchsorted(np.array([p for p, _ in pairs], np.int64), np.arange(len(literals) + 1))
        self.always = np.array([i for i, some in enumerate(sought) if some is None], np.int64)
        scopes = {x: i for i, x in enumerate(sorted({r[0] for r in rules if r[0] is not None}))}
        self.scopes, self.scope = scopes, np.array([scopes.get(r[0], -1) for r in rules], np.int64)

    @classmethod
    def of(cls, name: str, rules: list[tuple]) -> Together:
        if name not in cls.built:
            if len(cls.built) >= 4:
                cls.built.clear()
            cls.built[name] = cls(rules)
        return cls.built[name]

    def places(self, texts: pa.Array, scopes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, rule, place) in order: where a text has a literal of a rule of its scope; 0 for rules that need none."""
        low = texts
        for c, plain in zip(BLIND, "iisk"):
            if pc.any(pc.match_substring(low, c)).as_py():
                low = pc.replace_substring(low, c, plain)
        row, literal, place = self.phrases.find(pc.utf8_lower(low))
        many = self.begin[literal + 1] - self.begin[literal]
        rule = self.rule[np.repeat(self.begin[literal], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        n = len(self.always)
        row = np.concatenate([np.repeat(row, many), np.repeat(np.arange(len(texts)), n)])
        rule = np.concatenate([rule, np.tile(self.always, len(texts))])
        place = np.concatenate([np.repeat(place, many), np.zeros(n * len(texts), np.int64)])
        if len(self.scopes) != 1 or pc.any(pc.not_equal(pc.fill_null(scopes, "\0"), next(iter(self.scopes)))).as_py():
            mine = np.array([self.scopes.get(s, -2) for s in scopes.to_pylist()], np.int64)[row] == self.scope[rule]
            row, rule, place = row[mine], rule[mine], place[mine]
        order = np.lexsort((place, row * max(1, len(self.rules)) + rule))
        return row[order], rule[order], place[order]

    def met(self, texts: pa.Array, scopes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, rule) in order: the rules of a text's scope that it has a literal of, or that need none."""
        row, rule, _ = self.places(texts, scopes)
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (rule[1:] != rule[:-1])
        return row[first], rule[first]


def _lists(row: list | np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """Values in the order of their rows as one list a row."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(np.asarray(row, np.int64), minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


def _collected(listed: DataFrame, *lists: str) -> tuple[str, list[tuple]]:
    """The rules in order under a name of their own; at most ``TOGETHER``."""
    rows = [r for r in listed.collect() if not lists or r["rule"]["list"] in lists]
    rules = [(r["scope"], r["rule"]["list"], r["rule"]["place"], r["rule"]["pattern"], r["literals"]) for r in rows]
    return uuid.uuid4().hex, sorted(rules, key=lambda r: ([x.encode("utf-8", "replace") for x in r[1:4]], r[0] or ""))


def _met_rules(listed: DataFrame, text: Column, scope: str | None) -> Column:
    """The rules that a text has the literals for, in order."""
    name, rules = _collected(listed)

    @F.arrow_udf(f"array<{RULE}>")
    def met(texts: pa.Array, scopes: pa.Array) -> pa.Array:
        row, rule = Together.of(name, rules).met(texts, scopes)
        part = lambda k: pa.array([rules[i][k] for i in rule.tolist()], pa.string())
        return _lists(row, len(texts), pa.StructArray.from_arrays([part(1), part(2), part(3)], ["list", "place", "pattern"]))

    return met(F.make_valid_utf8(F.coalesce(text, F.lit(""))), _own(scope))


#: Spans of deny rules, and the rules that the engine has to try.
_DENIED = "struct<spans:array<struct<number:int,start:int,end:int,byte_start:int,byte_end:int,text:string>>,open:array<struct<number:int,pattern:string>>>"


def _denied(listed: DataFrame, text: Column, scope: str | None) -> Column:
    """``_DENIED`` of a text."""
    name, rules = _collected(listed, "deny")

    @F.arrow_udf(_DENIED)
    def denied(texts: pa.Array, whole: pa.Array, scopes: pa.Array) -> pa.Array:
        known, blind = Together.of(name, rules), pc.match_substring_regex(texts, f"[{BLIND}]").to_pylist()
        whole, strings = whole.to_pylist(), texts.to_pylist()
        open_row, open_rule, counts, number, ends, found = [], [], np.zeros(len(texts), np.int64), [], [], []
        byte_ends, done = [np.zeros((0, 2), np.int64)], 0
        for first in range(0, len(texts), TEXTS):
            rows, numbers, places = known.places(texts[first : first + TEXTS], scopes[first : first + TEXTS])
            cuts = np.append(np.flatnonzero((rows[1:] != rows[:-1]) | (numbers[1:] != numbers[:-1])) + 1, len(rows)).tolist() if len(rows) else []
            at, rows, numbers, places = 0, (rows + first).tolist(), numbers.tolist(), places.tolist()
            for k, cut in enumerate(cuts):
                row, rule = rows[at], numbers[at]
                s, how = strings[row], known.match[rule]
                if how is None or not whole[row] or (how[1] and blind[row]):
                    open_row.append(row)
                    open_rule.append(rule)
                elif known.led[rule]:
                    match, last = how[0].match, 0
                    for place in places[at:cut]:
                        if place >= last and (m := match(s, place)):
                            last = m.end()
                            number.append(rule)
                            ends.append((place, last))
                            found.append(m[0])
                else:
                    for m in how[0].finditer(s):
                        number.append(rule)
                        ends.append(m.span())
                        found.append(m[0])
                at = cut
                if k + 1 == len(cuts) or rows[cut] != row:
                    if len(ends) > done:
                        bytes_at = np.array(ends[done:], np.int64)
                        done = len(ends)
                        if not s.isascii():
                            raw = np.frombuffer(s.encode(), np.uint8)
                            bytes_at = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))[bytes_at]
                        byte_ends.append(bytes_at)
                        counts[row] = len(bytes_at)
        at, bytes_at = np.array(ends, np.int32).reshape(-1, 2), np.concatenate(byte_ends).astype(np.int32)
        spans = pa.StructArray.from_arrays(
            [pa.array(number, pa.int32()), *[pa.array(np.ascontiguousarray(x[:, k])) for x in (at, bytes_at) for k in (0, 1)], pa.array(found, pa.string())],
            ["number", "start", "end", "byte_start", "byte_end", "text"])
        tried = pa.StructArray.from_arrays([pa.array(open_rule, pa.int32()), pa.array([rules[i][3] for i in open_rule], pa.string())], ["number", "pattern"])
        return pa.StructArray.from_arrays([_lists(np.repeat(np.arange(len(texts)), counts), len(texts), spans), _lists(open_row, len(texts), tried)], ["spans", "open"])

    return denied(F.make_valid_utf8(F.coalesce(text, F.lit(""))), F.coalesce(F.is_valid_utf8(text), F.lit(False)), _own(scope))


#: Whether an allow rule takes a finding away, and the patterns that the engine has to try.
_ALLOWED = "array<struct<allowed:boolean,open:array<string>>>"


def _allowed(listed: DataFrame, spans: Column, scope: str | None) -> Column:
    """``_ALLOWED`` of the texts of spans. Equal texts of a batch are looked at once."""
    name, rules = _collected(listed, "allow")

    @F.arrow_udf(_ALLOWED)
    def allowed(texts: pa.Array, whole: pa.Array, scopes: pa.Array) -> pa.Array:
        known, n = Together.of(name, rules), len(texts)
        flat, valid = texts.flatten(), whole.flatten().to_pylist()
        owner = pc.list_parent_indices(texts).to_numpy()
        own = scopes.to_pylist()
        seen: dict[tuple, int] = {}
        which = [seen.setdefault(k, len(seen)) for k in zip(flat.to_pylist(), valid, [own[i] for i in owner.tolist()])]
        keys = list(seen)
        rows, numbers = known.met(pa.array([k[0] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()))
        away, tried = [False] * len(keys), [[] for _ in keys]
        for key, rule in zip(rows.tolist(), numbers.tolist()):
            s, how = keys[key][0], known.match[rule]
            if away[key]:
                continue
            if how is None or not keys[key][1] or (how[1] and any(c in s for c in BLIND)):
                tried[key].append(rules[rule][3])
            elif how[0].search(s):
                away[key] = True
        out = pa.StructArray.from_arrays([pa.array(away, pa.bool_()), pa.array(tried, pa.list_(pa.string()))], ["allowed", "open"])
        return _lists(owner, n, out.take(pa.array(which, pa.int64())))

    valid = F.transform(spans, lambda s: F.is_valid_utf8(s["text"]))
    return allowed(F.transform(spans, lambda s: F.make_valid_utf8(s["text"])), valid, _own(scope))


def candidate_rules(texts: DataFrame, rules: DataFrame, key: str, text_col: str = "text", scope: str | None = None) -> DataFrame:
    """(key, rules): for each text the rules it has the literals for, in order; texts without any are left out.

    ``key`` is unique. With a ``scope`` column (the owner, say) in texts and rules, a rule sees its own texts only.
    """
    listed = stored(listed_rules(rules, scope), "rules")
    if listed.limit(TOGETHER + 1).count() <= TOGETHER:
        return texts.select(key, _met_rules(listed, F.col(text_col), scope).alias("rules")).where(F.size("rules") > 0)
    return _with_many_rules(texts, listed, key, text_col, scope).where(F.size("__rules") > 0).select(key, F.col("__rules.rule").alias("rules"))


def detect_with_rule_table(df: DataFrame, rules: DataFrame, key: str, text_col: str = "text", scope: str | None = None, out: str = "spans", **layers) -> DataFrame:
    """``detect`` with the allow and deny rules of a table besides the layers given.

    A deny rule's matches are findings; an allow rule takes away findings (of any layer) that it matches in. Null
    texts have no findings; rules with a pattern the engine refuses are passed over (``checked_patterns`` names them).
    """
    listed = stored(listed_rules(rules, scope), "rules")
    if listed.limit(TOGETHER + 1).count() <= TOGETHER:
        return _detect_together(df, listed, text_col, scope, out, layers)
    part = lambda name: F.filter("__rules", lambda r: r["rule"]["list"] == name)
    deny = F.transform(part("deny"), lambda r: r["rule"]["pattern"])
    step = pinned(_with_many_rules(df, listed, key, text_col, scope), {"__deny": deny, "__allow": part("allow")}).drop("__rules")
    found = find_spans(step, text_col, out="__all", deny_col="__deny", **layers)

    # A pattern is only compiled for a finding that has one of its literals.
    def allowed(s: Column) -> Column:
        return bound(folded(s["text"]), lambda t: F.exists("__allow", lambda r: _has_literal(t, r) & F.rlike(s["text"], r["rule"]["pattern"])))

    kept = F.filter("__all", lambda s: ~allowed(s))
    return pinned(found, {out: resolve_overlaps(kept)}).drop("__all", "__deny", "__allow")


def _detect_together(df: DataFrame, listed: DataFrame, text_col: str, scope: str | None, out: str, layers: dict) -> DataFrame:
    """``detect_with_rule_table`` with all rules next to the texts."""
    first, spec = layer_rank("denylist") + len(layers.get("deny", ())), SPECIFICITY.get(DENY_TYPE, DEFAULT_SPECIFICITY)
    step = df.withColumn("__denied", _denied(listed, F.col(text_col), scope))
    spans = F.transform("__denied.spans", lambda s: span_struct(
        s["start"], s["end"], F.lit(DENY_TYPE), s["text"], F.lit(DENY_CONFIDENCE), F.lit(first) + s["number"], F.lit(spec), s["byte_start"], s["byte_end"]))
    found = find_spans(step.withColumns({"__spans": spans, "__open": F.col("__denied.open")}).drop("__denied"), text_col, out="__all", deny_col="__open", deny_spans="__spans", **layers)
    step = pinned(found, {"__all": F.col("__all")}).withColumn("__allowed", _allowed(listed, F.col("__all"), scope))

    both = F.zip_with("__all", "__allowed", lambda s, a: F.struct(s.alias("s"), a.alias("a")))
    away = lambda x: x["a"]["allowed"] | F.exists(x["a"]["open"], lambda p: F.rlike(x["s"]["text"], p))
    kept = F.transform(F.filter(both, lambda x: ~away(x)), lambda x: x["s"])
    return pinned(step, {out: resolve_overlaps(kept)}).drop("__all", "__open", "__spans", "__allowed")
