"""Span expressions: finding matches with positions, byte offsets, overlap resolution.

A document's findings live in one array column next to its text, so detection is a
map-only projection: no shuffle, no Python worker, memory bounded by one document.
Offsets are characters inside the engine; byte offsets (UTF-8) travel along.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from string import ascii_lowercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.arrays import bound, running_max, running_sum
from veilframe.functions.recognizers import Recognizer
from veilframe.functions.taxonomy import DEFAULT_SPECIFICITY, SPECIFICITY, type_specificity

# Field order is the sort order of overlap resolution: start, end, falling confidence, rank.
SPAN = (
    "struct<start:int,end:int,neg_conf:double,rank:int,spec:int,pii_type:string,"
    "text:string,confidence:double,byte_start:int,byte_end:int>"
)
SPANS = f"array<{SPAN}>"

# Layers in detection order; a layer's rank base keeps ties in this order.
LAYERS = ("encoder", "ner", "pattern", "denylist", "external")
# The step leaves room for as many findings of one text in a layer as an array can hold at all.
LAYER_STEP = 400_000_000
DENY_TYPE, DENY_CONFIDENCE = "API_KEY", 0.95


def layer_rank(layer: str) -> int:
    return LAYERS.index(layer) * LAYER_STEP


def no_spans() -> Column:
    return F.array().cast(SPANS)


def all_of(conditions: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def any_of(conditions: list[Column]) -> Column | None:
    return reduce(lambda a, b: a | b, conditions) if conditions else None


def fold_case(text: Column) -> Column:
    """Text for case-blind substring checks; the long s folds to s as in the patterns."""
    return F.replace(F.lower(text), F.lit("\u017f"), F.lit("s"))


# A number run: digits with the separators that any number-shaped pattern allows inside, a plus sign before and the
# first letter of a unit behind.
NUMBER_RUN = r"(?U)[\d+][\d\s.,/()+-]*[mgu]?"


def number_runs(text: Column) -> Column:
    """All number runs of a text in one short string."""
    return F.array_join(F.regexp_extract_all(text, F.lit(NUMBER_RUN), F.lit(0)), "|")


def key_words(folded: Column, rules: Sequence[Rule]) -> Column:
    """All words of the rules that begin in a folded text where no letter stands before, in one short string.

    A word boundary before a letter is such a place. Of words that begin at one place the longest is cut out, which
    holds the others; words consist of letters and digits alone, so none hides the place before another. Letters are
    listed one by one in the classes, because the engine looks those up in a table.
    """
    by_first: dict[str, list[str]] = {}
    for word in sorted({w for r in rules for w in r.rec.words}, key=lambda w: (-len(w), w)):
        by_first.setdefault(word[0], []).append(word[1:])
    if not by_first:
        return F.lit("")
    branches = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by_first.items()))
    found = F.regexp_extract_all(F.concat(F.lit(" "), folded), F.lit(f"[^{ascii_lowercase}](?=[{''.join(by_first)}])({branches})"), F.lit(1))
    return F.array_join(found, "|")


def could_match(rec: Recognizer, text: Column, folded: Column, words: Column, runs: Column) -> Column | None:
    """Necessary condition for a recognizer, cheapest parts first; None if there is none."""
    parts: list[Column] = []
    named = [F.contains(words, F.lit(w)) for w in rec.words] + [F.contains(folded, F.lit(h)) for h in rec.folded]
    shaped = [runs.rlike("(?U)" + rec.digits)] if rec.digits else []
    if rec.digits_alone:
        parts.append(any_of([*named, *shaped]))
    else:
        parts += [any_of(named)] if named else []
        parts += shaped
    if rec.hints:
        parts.append(any_of([F.contains(text, F.lit(h)) for h in rec.hints]))
    for token, least in rec.counts:
        seen = F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))
        parts.append(seen >= least * len(token))
    if rec.guard:
        parts.append(text.rlike("(?U)" + rec.guard))
    return all_of(parts)


@dataclass(frozen=True)
class Rule:
    """A recognizer with its place in the tie order."""

    rec: Recognizer
    rank: int


def ranked(recognizers: Sequence[Recognizer], layer: str) -> list[Rule]:
    base = LAYERS.index(layer) * LAYER_STEP
    return [Rule(r, base + i) for i, r in enumerate(recognizers)]


#: Stands before and behind each match while a text is cut; texts that hold it themselves are cut another way.
MARK = "\ue000"


def cut_by(text: Column, pattern: Column) -> Column:
    """The texts between and in the matches of a pattern in turn, beginning with what is before the first match."""
    return F.flatten(F.zip_with(F.split(text, pattern, F.lit(-1)), F.regexp_extract_all(text, pattern, F.lit(0)), lambda g, m: F.array(g, m)))


def match_lists(text: Column, checks: Sequence[Column | None], rules: Sequence[Rule]) -> Column:
    """``array<array<string>>``: the text as ``cut_by`` each rule, null where its cheap check fails.

    A pattern runs over a text once: its matches are marked, and the text is cut at the marks.
    """
    lists = []
    for rule, cond in zip(rules, checks, strict=True):
        marked = F.regexp_replace(text, F.lit(rule.rec.spark_pattern()), F.lit(f"{MARK}$0{MARK}"))
        cut = F.split(marked, MARK, -1)
        lists.append(cut if cond is None else F.when(cond, cut))
    patterns = F.array(*[F.lit(r.rec.spark_pattern()) for r in rules]).cast("array<string>")
    other = F.transform(patterns, lambda p: cut_by(text, p))
    return F.when(F.contains(text, F.lit(MARK)), other).otherwise(F.array(*lists).cast("array<array<string>>"))


def match_count(cut: Column) -> Column:
    return F.floor((F.size(cut) - 1) / 2).cast("int")


def locate_hit(hit: Column) -> Column:
    """Spans of one rule (pattern, pii_type, confidence, rank, spec) from the text ``cut`` by it, in text order.

    Spark returns match texts but no positions. The texts between matches supply them: a running sum of the lengths
    of both is the position.
    """

    def piece(i: Column) -> Column:
        g, m = F.get(hit["cut"], 2 * i), F.get(hit["cut"], 2 * i + 1)
        return F.struct(m.alias("m"), (F.length(g) + F.length(m)).alias("chars"), (F.octet_length(g) + F.octet_length(m)).alias("bytes"))

    pieces = F.transform(F.sequence(F.lit(0), match_count(hit["cut"]) - 1), piece)
    rule = hit["rule"]

    def spans(found: Column) -> Column:
        ends = F.struct(
            running_sum(F.transform(found, lambda p: p["chars"])).alias("chars"), running_sum(F.transform(found, lambda p: p["bytes"])).alias("bytes"))

        def span(end: Column, p: Column, i: Column) -> Column:
            e, be = F.get(end["chars"], i), F.get(end["bytes"], i)
            return span_struct(e - F.length(p["m"]), e, rule["pii_type"], p["m"], rule["confidence"], rule["rank"], rule["spec"], be - F.octet_length(p["m"]), be)

        return bound(ends, lambda end: F.transform(found, lambda p, i: span(end, p, i)))

    return bound(pieces, spans)


def locate_matches(lists: Column, rules: Sequence[Rule], allow: Sequence[str] = ()) -> Column:
    """Spans of all rules from the texts cut by them. Rules without a match are dropped before anything is located."""
    facts = F.array(*[
        F.struct(
            F.lit(r.rec.spark_pattern()).alias("pattern"),
            F.lit(r.rec.pii_type).alias("pii_type"),
            F.lit(float(r.rec.confidence)).alias("confidence"),
            F.lit(r.rank).alias("rank"),
            F.lit(SPECIFICITY.get(r.rec.pii_type, DEFAULT_SPECIFICITY)).alias("spec"),
        )
        for r in rules
    ])
    hits = F.filter(
        F.transform(lists, lambda cut, i: F.struct(cut.alias("cut"), F.get(facts, i).alias("rule"))),
        lambda h: match_count(h["cut"]) > 0,
    )

    spans = F.flatten(F.transform(hits, locate_hit))
    keep = []
    for r in rules:
        if r.rec.validator is not None:
            keep.append(lambda s, r=r: F.when(s["rank"] == r.rank, r.rec.validator(s["text"])).otherwise(True))
    if allow:
        keep.append(lambda s: ~is_allowed(s["text"], allow))
    return F.filter(spans, lambda s: all_of([k(s) for k in keep])) if keep else spans


def listed_spans(text: Column, patterns: Column, first_rank: int = 0, numbered: bool = False) -> Column:
    """Denylist spans of the patterns in an array column, ranked in the array's order after ``first_rank`` others.

    With ``numbered`` the array holds (number, pattern), and the numbers rank them.
    """
    def hit(p: Column, place: Column) -> Column:
        return F.struct(
            cut_by(text, p).alias("cut"),
            F.struct(
                p.alias("pattern"), F.lit(DENY_TYPE).alias("pii_type"), F.lit(DENY_CONFIDENCE).alias("confidence"),
                (F.lit(layer_rank("denylist") + first_rank) + place).alias("rank"), F.lit(SPECIFICITY.get(DENY_TYPE, DEFAULT_SPECIFICITY)).alias("spec"),
            ).alias("rule"),
        )

    hits = F.transform(patterns, (lambda p: hit(p["pattern"], p["number"])) if numbered else hit)
    return F.flatten(F.transform(F.filter(hits, lambda h: match_count(h["cut"]) > 0), locate_hit))


def is_allowed(text: Column, allow: Sequence[str]) -> Column:
    return any_of([text.rlike("(?U)" + a) for a in allow])


def drop_repeated_ranges(spans: Column) -> Column:
    """Denylist and external spans give way to an earlier span with exactly their range.

    Sorted by range and rank, a span follows the earlier one directly.
    """
    ruled = layer_rank("denylist")
    entries = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s.alias("span"))))

    def kept(all_: Column) -> Column:
        def first(e: Column, i: Column) -> Column:
            before = F.get(all_, i - 1)
            same = (before["start"] == e["start"]) & (before["end"] == e["end"])
            return (e["rank"] < ruled) | ~F.coalesce(same, F.lit(False))

        return F.transform(F.filter(all_, first), lambda e: e["span"])

    return bound(entries, kept)


def span_struct(start, end, pii_type, text, confidence, rank, spec, byte_start, byte_end) -> Column:
    return F.struct(
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        (-confidence).cast("double").alias("neg_conf"),
        rank.cast("int").alias("rank"),
        spec.cast("int").alias("spec"),
        pii_type.alias("pii_type"),
        text.alias("text"),
        confidence.cast("double").alias("confidence"),
        byte_start.cast("int").alias("byte_start"),
        byte_end.cast("int").alias("byte_end"),
    ).cast(SPAN)


def char_to_byte(text: Column, pos: Column) -> Column:
    """Byte offset of a character offset; past the end it is the byte length."""
    return F.octet_length(F.substring(text, F.lit(1), pos.cast("int")))


def safe_slice(text: Column, start: Column, end: Column) -> Column:
    """Text between two character offsets, null for an impossible range."""
    ok = (start >= 0) & (start <= end) & (end <= F.length(text))
    return F.when(ok, F.substring(text, (start + 1).cast("int"), (end - start).cast("int")))


def external_span(text, start, end, pii_type, confidence, rank) -> Column:
    """Span struct from offsets reported by another tool (character offsets)."""
    return span_struct(start, end, pii_type, safe_slice(text, start, end), confidence, rank,
                       type_specificity(pii_type), char_to_byte(text, start), char_to_byte(text, end))


def resolve_overlaps(spans: Column) -> Column:
    """Sorted, disjoint spans.

    A left fold over spans ordered by (start, end, falling confidence, rank). Each span
    meets only the last kept one: without overlap it is appended, otherwise exactly one of
    the two survives. A span that starts where all before it have ended meets none of them, so
    the fold runs over each stretch of overlapping spans alone.
    """

    def wins(m: Column, e: Column) -> Column:
        finer = m["spec"] > e["spec"]
        finer_or_surer = finer | (
            (m["spec"] == e["spec"]) & (m["confidence"] > e["confidence"])
        )
        same = (m["start"] == e["start"]) & (m["end"] == e["end"])
        inside = (m["start"] >= e["start"]) & (m["end"] <= e["end"])
        around = (e["start"] >= m["start"]) & (e["end"] <= m["end"])
        return (
            F.when(same, finer_or_surer)
            .when(inside, finer)
            .when(around, e["spec"] <= m["spec"])
            .otherwise(finer_or_surer)
        )

    def step(acc: Column, m: Column) -> Column:
        e = F.get(acc, F.size(acc) - 1)
        return (
            F.when((F.size(acc) == 0) | (m["start"] >= e["end"]), F.concat(acc, F.array(m)))
            .when(wins(m, e), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(m)))
            .otherwise(acc)
        )

    def stretches(all_: Column) -> Column:
        def by_reach(reach: Column) -> Column:
            apart = F.transform(all_, lambda s, i: F.when((i == 0) | (s["start"] >= F.get(reach, i - 1)), i))
            return bound(F.filter(apart, lambda i: i.isNotNull()), folded)

        def folded(begins: Column) -> Column:
            return F.flatten(F.transform(begins, lambda at, k: F.aggregate(
                F.slice(all_, at + 1, F.coalesce(F.get(begins, k + 1), F.size(all_)) - at), no_spans(), step)))

        return bound(running_max(F.transform(all_, lambda s: s["end"])), by_reach)

    return bound(F.sort_array(spans), lambda all_: F.when(F.size(all_) <= 1, all_).otherwise(stretches(all_)))


def type_counts(spans: Column) -> Column:
    """``array<struct<entity_type,count>>`` sorted by type."""
    types = F.transform(spans, lambda s: s["pii_type"])
    return F.transform(
        F.array_sort(F.array_distinct(types)),
        lambda t: F.struct(
            t.alias("entity_type"),
            F.size(F.filter(types, lambda x: x == t)).cast("long").alias("count"),
        ),
    )
