"""Policy rules: phrase linting, enforcement and policy events."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.functions.columns import count_where, pinned
from veilframe.functions.phrases import LENGTHS, Phrases, apart, hashes, pieces
from veilframe.session import BROADCAST_ROWS, stored

SCORE_FLOOR = 0.5

# The starter rules, all disabled until loaded.
STARTER_RULES = (
    ("api key", "block"),
    ("bearer token", "block"),
    ("client secret", "block"),
    ("private key", "block"),
    ("BEGIN PRIVATE KEY", "block"),
    ("connection string", "block"),
    ("password", "block"),
    ("social security number", "warn"),
    ("credit card number", "warn"),
    ("bank account number", "warn"),
    ("passport number", "warn"),
    ("national id", "warn"),
    ("customer data", "warn"),
    ("phone numbers", "warn"),
    ("medical history", "warn"),
    ("diagnosis", "warn"),
    ("prescription", "warn"),
    ("medication", "warn"),
    ("mental health", "warn"),
)
RULE_SCHEMA = "rule_text string, action string, enabled boolean"


@dataclass(frozen=True)
class Rule:
    index: int
    text: str
    action: str


def starter_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, a, False) for t, a in STARTER_RULES], RULE_SCHEMA)


def parse_action(action: Column) -> Column:
    return F.when(F.lower(action) == "block", "block").otherwise("warn")


def enabled_rules(rules: DataFrame) -> DataFrame:
    return rules.where(F.coalesce(F.col("enabled"), F.lit(True))).withColumn("action", parse_action(F.col("action")))


def add_missing_defaults(rules: DataFrame, defaults: DataFrame) -> DataFrame:
    """The rules plus every default not yet there by text (case-blind); added ones are enabled."""
    have = rules.select(F.lower("rule_text").alias("k"))
    missing = defaults.withColumn("k", F.lower("rule_text")).join(have, "k", "left_anti")
    return rules.unionByName(missing.drop("k").withColumn("enabled", F.lit(True)))


def load_rules(rules: DataFrame) -> list[Rule]:
    """Enabled rules as plan constants, by ``rule_index`` where the table has it, else by text.

    For tables that grow there is ``lint_with_table``.
    """
    order = [c for c in ("rule_index", "rule_text", "action") if c in rules.columns]
    rows = enabled_rules(rules).orderBy(*order).collect()
    return [Rule(i, r["rule_text"], r["action"]) for i, r in enumerate(rows)]


VIOLATION = "struct<rule_index:int,rule_text:string,action:string,token_text:string,start:int,end:int,score:double>"


def _rule_hits(text: Column, lowered: Column, rule: Rule) -> Column:
    """All case-blind occurrences of the phrase with positions; nothing is scanned without one."""
    pattern = "(?iu)\\Q" + rule.text.replace("\\E", "\\E\\\\E\\Q") + "\\E"

    def located(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        pieces = F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{VIOLATION}>").alias("out"))

        def step(acc: Column, p: Column) -> Column:
            s = acc["pos"] + F.length(p["g"])
            e = s + F.length(p["m"])
            hit = F.struct(
                F.lit(rule.index).alias("rule_index"), F.lit(rule.text).alias("rule_text"),
                F.lit(rule.action).alias("action"), p["m"].alias("token_text"),
                s.alias("start"), e.alias("end"), F.lit(1.0).alias("score"),
            ).cast(VIOLATION)
            return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(hit)).alias("out"))

        return F.aggregate(pieces, start, step, lambda acc: acc["out"])

    none = F.array().cast(f"array<{VIOLATION}>")
    found = F.aggregate(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), none, lambda _, m: located(m))
    return F.when(F.contains(lowered, F.lit(rule.text.lower())), found).otherwise(none)


def lint(df: DataFrame, rules: Sequence[Rule], text_col: str = "user_text", scorer=None) -> DataFrame:
    """Add ``violations``; texts stay in place, so no rules-times-texts join is needed.

    ``scorer`` (score hook) maps (text Column, rule) to an array of violations instead of the
    phrase match. Only scores above the floor count.
    """
    text = F.col(text_col)
    step = df.withColumn("__lower", F.lower(text))
    hits = [scorer(text, r) if scorer else _rule_hits(text, F.col("__lower"), r) for r in rules]
    none = F.array().cast(f"array<{VIOLATION}>")
    all_hits = F.concat(*hits) if hits else none
    kept = F.filter(F.coalesce(all_hits, none), lambda v: v["score"] > SCORE_FLOOR)
    return pinned(step, {"violations": kept}).drop("__lower")


#: Grams are first looked up by so many characters.
_HEAD = 4
#: So many rules with so many characters in all go to the texts.
TOGETHER, TOGETHER_CHARS = BROADCAST_ROWS, 1 << 24
#: So many texts are searched at a time.
_TEXTS = 256
#: Bits of the table of all anchors' hashes, as a power of two; it is sent to the texts whole.
TABLE_BITS = 27
#: Characters whose folding without case is lower-casing one by one, in the engine's patterns too. Texts of these alone are searched lower-cased.
_PLAIN = (r"\x00-\u00B4\u00B6-\u012F\u0132-\u0148\u014A-\u017E\u0400-\u045F\u2010-\u2027\u2030-\u205E\u20A0-\u20BF"
          r"\u3000-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uAC00-\uD7A3")


def _literal(text: Column) -> Column:
    """Pattern that finds a text case-blind."""
    return F.concat(F.lit("(?iu)\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _anchored(rules: DataFrame) -> DataFrame:
    """Each rule that is not blank with its anchor: of its parts of the longest length, spaces included, the one that fewest rules have."""
    lowered = rules.where(F.rlike("rule_text", F.lit(r"\S"))).select("rule_index", F.lower("rule_text").alias("t"))
    size = F.coalesce(*[F.when(F.length("t") >= n, n) for n in LENGTHS])
    parts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - size + 1), lambda i: F.substring("t", i, size)))
    grams = lowered.select("rule_index", F.explode(parts).alias("gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("n"))
    best = grams.join(shared, "gram").groupBy("rule_index").agg(F.min(F.struct("n", "gram")).alias("best"))
    return rules.join(best.select("rule_index", F.col("best.gram").alias("gram")), "rule_index")


def _sized(df: DataFrame) -> DataFrame:
    """A stored table, broadcast if it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _is_plain(text: Column) -> Column:
    # Most texts hold Latin letters alone, which takes two short classes; the engine is slow at long ones.
    latin = ~F.rlike(text, F.lit(r"[^\x00-\u017E]"))
    return F.is_valid_utf8(text) & F.when(latin, ~F.rlike(text, F.lit(r"[\u00B5\u0130\u0131\u0149]"))).otherwise(~F.rlike(text, F.lit(f"[^{_PLAIN}]")))


#: The last rules used in this process.
_BUILT: dict[str, Phrases] = {}


def _built(name: str, phrases: list[str]) -> Phrases:
    if name not in _BUILT:
        if len(_BUILT) >= 4:
            _BUILT.clear()
        _BUILT[name] = Phrases(phrases)
    return _BUILT[name]


def _places(text: Column, phrases: list[str]) -> Column:
    """``array<struct<number,start,m>>``: where a text has the phrases without case, each from the left without overlaps."""
    name = uuid.uuid4().hex

    @F.arrow_udf("array<struct<number:int,start:int,m:string>>")
    def places(texts: pa.Array) -> pa.Array:
        known, many, numbers, starts, m = _built(name, phrases), [], [], [], []
        for first in range(0, len(texts), _TEXTS):
            some = texts[first : first + _TEXTS]
            row, number, start = known.find(pc.utf8_lower(some))
            kept = apart(row, number, start, known.sizes)
            row, number, start = row[kept], number[kept], start[kept]
            strings = {i: some[i].as_py() for i in np.unique(row).tolist()}
            m += [strings[r][s:e] for r, s, e in zip(row.tolist(), start.tolist(), (start + known.sizes[number]).tolist())]
            many.append(np.bincount(row, minlength=len(some)))
            numbers.append(number.astype(np.int32))
            starts.append(start.astype(np.int32))
        whole = lambda parts: pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32))
        ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *many]))]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([whole(numbers), whole(starts), pa.array(m, pa.string())], ["number", "start", "m"]))

    return places(text)


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the table for each hash."""
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64), (h & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)


def _present(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """The rules whose anchor occurs in any of the texts: a table of two bits per anchor goes over the texts, what it lets through is joined."""
    @F.arrow_udf("array<bigint>")
    def bits(grams: pa.Array) -> pa.Array:
        out = np.zeros((len(grams), 2), np.int64)
        for first, chars, at in pieces(grams):
            sizes = np.diff(at)
            for n, h in hashes(chars, LENGTHS).items():
                some = np.flatnonzero(sizes == n)
                out[some + first, 0], out[some + first, 1] = _bits(h[at[some]])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(grams) + 1, dtype=np.int32) * 2), pa.array(out.ravel()))

    placed = anchors.select(F.explode(bits("gram")).alias("bit")).select((F.col("bit") + 1).alias("bit"))
    rows = placed.groupBy(F.bitmap_bucket_number("bit").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    sizes = [r[0] for r in anchors.select(F.length("gram")).distinct().collect()]
    maps = {r["b"] - 1: bytes(r["bits"]) for r in rows}

    @F.arrow_udf("array<string>")
    def grams(texts: pa.Array) -> pa.Array:
        table = np.zeros(1 << TABLE_BITS >> 3, np.uint8)
        for k, one in maps.items():
            table[k * len(one) : (k + 1) * len(one)] = np.frombuffer(one, np.uint8)
        low, found = pc.utf8_lower(texts), {}
        for _, chars, at in pieces(low):
            for n, h in (hashes(chars, sizes) if len(chars) else {}).items():
                left = np.arange(len(h))
                for k in (0, 1):
                    bit = _bits(h[left])[k]
                    left = left[(table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
                left = left[np.unique(h[left], return_index=True)[1]]
                for p in left.tolist():
                    found["".join(map(chr, chars[p : p + n].tolist()))] = True
        ends = np.full(len(texts) + 1, len(found), np.int32)
        ends[0] = 0
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(list(found), pa.string()))

    met = texts.select(F.explode(grams("__text")).alias("gram")).distinct()
    return anchors.join(met, "gram", "left_semi")


def lint_with_table(df: DataFrame, rules: DataFrame, key: str, text_col: str = "user_text") -> DataFrame:
    """Violation rows of texts against a table of rules; the plan is the same for any number of rules up to ``TOGETHER`` and beyond.

    ``rules``: rule_index, rule_text, action (enabled ones; blank texts match nothing); ``key`` is
    unique. Null texts have no violations. Up to ``TOGETHER`` rules go to the texts and are found there at once, no text moves. Of more
    rules those go whose anchor occurs in the texts at all, which a first pass over the texts tells. Where even those are too many, and
    for texts with characters that fold in other ways than to lower case, texts and rules meet by joins (``_joined``).
    """
    rules = rules.select("rule_index", "rule_text", "action").where(F.rlike("rule_text", F.lit(r"\S")) & F.col("rule_index").isNotNull()).distinct()
    texts = df.select(F.col(key).alias("__key"), F.col(text_col).alias("__text")).where(F.col("__text").isNotNull())
    plain, odd = texts.where(_is_plain(F.col("__text"))), texts.where(~_is_plain(F.col("__text")))
    few = rules = stored(rules, "rules")
    if not _fit(rules):
        few = stored(_present(plain, stored(_anchored(rules), "rule-anchors")).drop("gram"), "present-rules")
    if not _fit(few):
        return _joined(texts, rules, key)
    shipped = few.select("rule_index", "rule_text", "action", F.lower("rule_text").alias("t")).collect()
    numbers = {}
    for r in shipped:
        numbers.setdefault(r["t"], len(numbers))
    hits = plain.select("__key", F.explode(_places(F.col("__text"), list(numbers))).alias("h")).select("__key", "h.*")
    place = stored(df.sparkSession.createDataFrame([(numbers[r["t"]], r["rule_index"], r["rule_text"], r["action"]) for r in shipped], "number int, " + _typed(few)), "numbered-rules")
    found = hits.join(F.broadcast(place), "number").select(
        F.col("__key").alias(key), "rule_index", "rule_text", "action", F.col("m").alias("token_text"),
        "start", (F.col("start") + F.length("m")).alias("end"), F.lit(1.0).alias("score"))
    return found if odd.limit(1).count() == 0 else found.unionByName(_joined(odd, rules, key))


def _typed(rules: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in rules.select("rule_index", "rule_text", "action").dtypes)


def _fit(rules: DataFrame) -> bool:
    """Whether rules may go to the texts."""
    n, chars = rules.agg(F.count("*"), F.coalesce(F.sum(F.length("rule_text")), F.lit(0))).first()
    return n <= TOGETHER and chars <= TOGETHER_CHARS


def _joined(texts: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Violation rows by joins.

    A phrase can only stand in a text that has its anchor, up to 8 characters of it, so texts and
    rules meet on those. The beginnings of all anchors are few, whatever the number of rules, so what no rule begins with
    goes before anything moves. Only the (key, rule) pairs found travel to the texts, where the phrase is verified and
    located.
    """
    anchors = stored(_anchored(rules), "rule-anchors")
    heads = stored(anchors.select(F.substring("gram", 1, _HEAD).alias("head")).distinct(), "anchor-heads")
    # The characters from every place on, read in one pass, and their beginnings.
    ahead = F.array_distinct(F.regexp_extract_all(F.lower("__text"), F.lit(rf"(?s)(?=(.{{1,{max(LENGTHS)}}}))"), F.lit(1)))
    started = lambda n: F.array_distinct(F.transform("a", lambda g: F.substring(g, F.lit(1), F.lit(n))))
    grams = F.array_distinct(F.concat(*[started(n) for n in LENGTHS]))
    held = texts.select("__key", ahead.alias("a")).select("__key", grams.alias("grams")).select("__key", F.explode("grams").alias("gram"))
    held = held.withColumn("head", F.substring("gram", 1, _HEAD)).join(_sized(heads), "head", "left_semi")
    pairs = held.select("__key", "gram").join(anchors, "gram").select("__key", "rule_index", "rule_text", "action").distinct()
    met = texts.join(pairs, "__key").where(F.contains(F.lower("__text"), F.lower("rule_text")))
    pattern = _literal(F.col("rule_text"))
    pieces = F.arrays_zip(
        F.regexp_extract_all("__text", pattern, F.lit(0)).alias("m"), F.split(F.col("__text"), pattern, -1).alias("g"))
    row = met.select("__key", "rule_index", "rule_text", "action", F.posexplode(pieces).alias("i", "p"))
    # Of the texts between the matches only the lengths move.
    row = row.select("__key", "rule_index", "rule_text", "action", "i", F.col("p.m").alias("m"), F.length("p.g").alias("gap"))
    # Running lengths inside one text and rule give the places.
    done = Window.partitionBy("__key", "rule_index").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce(F.length("m"), F.lit(0))).over(done).cast("int")
    found = row.withColumn("end", end).where(F.col("m").isNotNull())
    return found.select(
        F.col("__key").alias(key), "rule_index", "rule_text", "action", F.col("m").alias("token_text"),
        (F.col("end") - F.length("m")).alias("start"), "end", F.lit(1.0).alias("score"))


def violation_rows(df: DataFrame, *keys: str) -> DataFrame:
    rows = df.select(*keys, F.explode_outer("violations").alias("v")).where(F.col("v.rule_index").isNotNull())
    return rows.select(*keys, "v.*")


def enforce(df: DataFrame) -> DataFrame:
    """Decision per request: any block blocks, with the first one as the reason; warnings pass."""
    blocks = F.filter("violations", lambda v: v["action"] == "block")
    first = F.get(blocks, 0)
    reason = F.concat(first["rule_text"], F.lit(" (matched `"), first["token_text"], F.lit("`)"))
    return df.withColumns({
        "blocked": F.size(blocks) > 0,
        "warnings": F.size("violations") - F.size(blocks),
        "reason": reason,
    })


def policy_events(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Violation rows as policy events."""
    return rows.select(
        F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in rows.columns]), 256).alias("id"),
        F.col(ts).alias("timestamp"), "session_id", "rule_text", "action", "token_text", "start", "end", "score",
        (F.col("action") == "block").alias("blocked"),
    )


def count_blocked(events: DataFrame) -> DataFrame:
    return events.agg(count_where(F.col("blocked")).alias("blocked"))
