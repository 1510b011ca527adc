"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them.

Candidates. Strict patterns give the base spans. Wider patterns (written-out addresses, local phone
numbers, shorter card numbers, identity numbers, secrets, titled names) give more candidates. Each
candidate gets votes (1 yes, -1 no, 0 none) of five labelers: the strict shape, a checksum or range,
a gazetteer (domain endings, card issuers, calling codes, key names, given names), a cue word before
it, and a word or sign that speaks against it.

Model. Votes and shape features are counted over all candidates of all texts, by pattern; patterns
are combinations of a few small values, so their number is bounded whatever the corpus. On those
counts, expectation-maximisation estimates for each kind how often it is true and how reliable each
labeler is (Dawid and Skene's model with abstention), and a logistic regression over votes and
shapes is fitted to its posteriors: the final span classifier. It is applied to every candidate as
a column expression.

All base spans stay. A candidate is added if the classifier gives it ``THRESHOLD`` or more and it
overlaps no base span and no earlier candidate. Texts are scanned once and whole; only spans and
votes are written. No shuffle but for the counts of patterns.

Defined results: null and empty texts have no spans; kinds do not compete with each other among
base spans; repeated rows get equal spans; other columns are ignored; an empty table fits no model.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import written
from veilframe.llm.spans import let, matches

BASE = ("email", "ip", "card", "phone")
#: All kinds, in the order of their spans.
KINDS = (*BASE, "identity", "secret", "person")
LABELERS = ("shape", "check", "gazetteer", "cue", "against")
THRESHOLD = 0.9
CONTEXT = 24
_ROUNDS, _STEPS = 40, 400
_PRIOR = {1: 8.0, 0: 4.0, -1: 1.0}

# Gazetteers and cue words.
TOP_DOMAINS = "com org net edu gov io de fr es uk eu info ch at it nl".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420 421".split()
GIVEN_NAMES = "anna john maria peter james mary thomas laura michael sarah paul julia jean pierre carlos sofia hans jürgen andrea david".split()
CUES = {
    "email": "mail|e-mail|email|contact|kontakt|contacto|courriel|correo|write to|reach",
    "ip": "ip|host|server|address|adresse|client|node|ping|login from",
    "card": "card|visa|mastercard|amex|karte|carte|tarjeta|credit|debit|payment",
    "phone": "tel|phone|call|fax|mobile|cell|telefon|téléphone|teléfono|anruf|appel|llame|whatsapp",
    "identity": "ssn|social security|tax|steuer|nif|dni|insurance|id no|identity",
    "secret": "password|passwd|pwd|token|secret|key|credential",
    "person": "dear|from|to|by|signed|contact|attn|sincerely",
}
AGAINST = "version|ver|v|isbn|issn|doi|page|line|section|chapter|figure|table|row|invoice|order|ticket|build|release"

# The base patterns, in possessive form (same matches, no backtracking).
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Wider candidates; each begins only where its first class begins, so scans stay linear.
_WRITTEN_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[]\x20?(?:at|AT)\x20?[)\]]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:[(\[]\x20?(?:dot|DOT)\x20?[)\]]|\.)\x20?[A-Za-z0-9-]{2,63}+){1,4}+"
_LOCAL_PHONE = r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z-]|\.[0-9])"
_IDENTITY = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
_SECRET = r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|token|secret|api[_-]?key)[\x20]{0,3}[=:][\x20]{0,3}\"?[^\s\"]{6,}+"
_PERSON = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-Z][a-z]{1,30}+(?:\x20[A-Z][a-z]{1,30}+)?+"

_FLAGS = "struct<kind:string,first:int,last:int,base:boolean,votes:array<int>,shape:array<int>>"


def _digits(text: Column) -> Column:
    return F.translate(text, " -().+", "")


def luhn(digits: Column) -> Column:
    """The checksum of a string of digits (at most a few dozen)."""
    spots = F.sequence(F.lit(1), F.length(digits))

    def value(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(spots, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _short_parts(text: Column) -> Column:
    """Numbers of an address are at most 255 (leading zeros allowed)."""
    return F.forall(F.split(text, r"\.", -1), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: (F.length(q) <= 3) & (F.lpad(q, 3, "0") <= "255")))


def _card_ok(text: Column) -> Column:
    return let(_digits(text), lambda d: F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))


def base_spans(text: Column) -> dict[str, Column]:
    """Kind -> array of (first, last, text, before, after) that pass the kind's test; failing matches are dropped."""
    none = matches(F.lit(""), _IP, CONTEXT)

    def scan(guard: Column, pattern: str, test) -> Column:
        return F.when(guard, F.filter(matches(text, pattern, CONTEXT), test)).otherwise(none)

    return {
        "email": scan(F.contains(text, F.lit("@")), _EMAIL, lambda m: F.lit(True)),
        "ip": scan(text.rlike(r"[0-9]\.[0-9]"), _IP, lambda m: _short_parts(m["text"])),
        "card": scan(text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), _CARD, lambda m: _card_ok(m["text"])),
        "phone": scan(text.rlike(r"\+[0-9]"), _PHONE, lambda m: F.length(_digits(m["text"])).between(8, 15)),
    }


def _wide_spans(text: Column) -> dict[str, Column]:
    none = matches(F.lit(""), _IP, CONTEXT)

    def scan(guard: Column, pattern: str) -> Column:
        return F.when(guard, matches(text, pattern, CONTEXT)).otherwise(none)

    return {
        "email": scan(text.rlike(r"[(\[]\x20?(?:at|AT)\x20?[)\]]"), _WRITTEN_EMAIL),
        "card": F.when(
            text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
            F.filter(matches(text, _CARD, CONTEXT), lambda m: F.length(_digits(m["text"])).between(13, 19)),
        ).otherwise(none),
        "phone": scan(text.rlike(r"[0-9][\x20.)-]\x20?[0-9]{3}"), _LOCAL_PHONE),
        "identity": scan(text.rlike(r"[0-9]{3}-[0-9]{2}-"), _IDENTITY),
        "secret": scan(text.rlike(r"(?i:password|passwd|pwd|token|secret|api[_-]?key)[\x20]{0,3}[=:]"), _SECRET),
        "person": scan(text.rlike(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\b"), _PERSON),
    }


def _vote(test: Column, yes: int, no: int) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.lit(yes)).otherwise(F.lit(no))


def _judged(kind: str, spans: Column, base: bool) -> Column:
    """Candidates of one kind with the votes of all labelers and their shape."""
    cue, against = rf"(?i)(?<![\p{{L}}])(?:{CUES[kind]})[^\p{{L}}]{{0,12}}$", rf"(?i)(?<![\p{{L}}])(?:{AGAINST})[\x20.:#-]{{0,3}}$|#$"

    def one(m: Column) -> Column:
        text, digits = m["text"], _digits(m["text"])
        strict = {
            "email": F.lit(base), "ip": F.lit(base), "phone": F.lit(base) | text.rlike(r"^\([0-9]{3}\)"), "card": F.lit(base),
            "identity": text.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), "secret": text.rlike(r"^[^=:]*+[=:]\x20*\"?(?=[^\s]*[0-9])(?=[^\s]*[A-Za-z])[^\s\"]{8,}"), "person": text.rlike(r"\x20[A-Z][a-z]+\x20"),
        }[kind]
        check = {
            "card": _vote(luhn(digits), 1, -1), "ip": _vote(~text.rlike(r"^(?:0|127|255)\."), 1, 0),
            "phone": _vote(F.length(digits).between(9, 13), 1, -1), "email": _vote(F.length(text) <= 254, 1, -1),
        }.get(kind, F.lit(0))
        listed = {
            "email": text.rlike(rf"(?i)[.\]) ](?:{'|'.join(TOP_DOMAINS)})$"), "ip": text.rlike(r"^(?:10|172|192)\."),
            "card": digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"), "phone": text.rlike(rf"^\+(?:{'|'.join(CALLING_CODES)})[^0-9]?"),
            "identity": F.lit(False), "secret": text.rlike(r"(?i)^(?:password|token|api[_-]?key)"), "person": text.rlike(rf"(?i)\x20(?:{'|'.join(GIVEN_NAMES)})(?:\x20|$)"),
        }[kind]
        votes = F.array(
            _vote(strict, 1, -1), check, _vote(listed, 1, 0), _vote(m["before"].rlike(cue), 1, 0),
            _vote(m["before"].rlike(against) | m["after"].rlike(r"^[A-Za-z0-9_]"), -1, 0),
        )
        shape = F.array(
            _vote(F.length(text) >= 20, 1, 0), _vote(2 * F.length(digits) >= F.length(text), 1, 0), _vote(text.rlike(r"[\x20()-]"), 1, 0),
        )
        return F.struct(F.lit(kind).alias("kind"), m["first"].alias("first"), m["last"].alias("last"), F.lit(base).alias("base"), votes.alias("votes"), shape.alias("shape"))

    return F.transform(spans, one).cast(f"array<{_FLAGS}>")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table (id, found): all candidates of each row with their votes, base spans first by kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base, wide = base_spans(text), _wide_spans(text)
    found = [_judged(k, base[k], True) for k in BASE] + [_judged(k, wide[k], False) for k in KINDS if k in wide]
    return written(docs.select(F.col(id_col).alias("id"), F.flatten(F.array(*found)).alias("found")), "candidates")


# ---- the model, on counts of patterns --------------------------------------------------------


def reliabilities(patterns: list[tuple[str, tuple, tuple, int]]) -> list[float]:
    """Posterior of each pattern (kind, votes, shape, count), by expectation-maximisation per kind."""
    out = [0.5] * len(patterns)
    for kind in {p[0] for p in patterns}:
        mine = [i for i, p in enumerate(patterns) if p[0] == kind]
        for i in mine:
            lean = sum(patterns[i][1])
            out[i] = 1 / (1 + math.exp(-1.5 * lean))
        for _ in range(_ROUNDS):
            weight = [0.0, 0.0]
            seen = {}
            for i in mine:
                n = patterns[i][3]
                for true, p in ((1, out[i]), (0, 1 - out[i])):
                    weight[true] += n * p
                    for labeler, vote in enumerate(patterns[i][1]):
                        seen[labeler, vote, true] = seen.get((labeler, vote, true), 0.0) + n * p
            total = weight[0] + weight[1]
            prior = [(weight[t] + 1) / (total + 2) for t in (0, 1)]
            change = 0.0
            for i in mine:
                logs = []
                for true in (0, 1):
                    logs.append(math.log(prior[true]) + sum(
                        # Votes are believed before data: pseudo-counts for agreeing, abstaining and opposing.
                        math.log((seen.get((x, v, true), 0.0) + _PRIOR[v * (2 * true - 1)]) / (weight[true] + sum(_PRIOR.values())))
                        for x, v in enumerate(patterns[i][1])
                    ))
                new = 1 / (1 + math.exp(min(50.0, max(-50.0, logs[0] - logs[1]))))
                change = max(change, abs(new - out[i]))
                out[i] = new
            if change < 1e-6:
                break
    return out


def _inputs(kind: str, votes: tuple, shape: tuple) -> list[float]:
    return [*(1.0 if kind == k else 0.0 for k in KINDS), *(float(v > 0) for v in votes), *(float(v < 0) for v in votes), *map(float, shape)]


def fit(patterns: list[tuple[str, tuple, tuple, int]]) -> list[float]:
    """Weights of the span classifier: logistic regression on the posteriors of all patterns."""
    size = len(_inputs(KINDS[0], (0,) * len(LABELERS), (0, 0, 0)))
    weights = [0.0] * size
    if not patterns:
        return weights
    target = reliabilities(patterns)
    rows = [(_inputs(k, v, s), t, math.sqrt(n)) for (k, v, s, n), t in zip(patterns, target, strict=True)]
    total = sum(n for *_, n in rows)
    for _ in range(_STEPS):
        slope = [1e-3 * w for w in weights]
        for x, t, n in rows:
            z = sum(w * v for w, v in zip(weights, x, strict=True) if v)
            gap = (1 / (1 + math.exp(min(50.0, max(-50.0, -z)))) - t) * n / total
            for j, v in enumerate(x):
                if v:
                    slope[j] += gap * v
        weights = [w - 2.0 * g for w, g in zip(weights, slope, strict=True)]
    return weights


def model(found: DataFrame) -> list[float]:
    """Fit on every candidate of a written table; only counts of patterns come to the driver."""
    rows = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.shape").count().collect()
    return fit(sorted((r["kind"], tuple(r["votes"]), tuple(r["shape"]), r["count"]) for r in rows))


def probability(candidate: Column, weights: list[float]) -> Column:
    """The classifier as a column expression."""
    parts, at = [], 0
    for k in KINDS:
        parts.append(F.when(candidate["kind"] == k, F.lit(weights[at])).otherwise(F.lit(0.0)))
        at += 1
    for sign in (1, -1):
        for i in range(len(LABELERS)):
            parts.append(F.when(candidate["votes"][i] == sign, F.lit(weights[at])).otherwise(F.lit(0.0)))
            at += 1
    for i in range(3):
        parts.append(candidate["shape"][i] * F.lit(weights[at + i]))
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, parts)))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row (id, base, spans) per row: arrays of struct(kind, first, last), by kind, then place."""
    found = candidates(docs, id_col, text_col)
    weights = model(found)
    place = lambda c: F.struct(F.array_position(F.lit(list(KINDS)), c["kind"]).cast("int").alias("k"), c["first"].alias("first"), c["last"].alias("last"), c["kind"].alias("kind"))
    base = F.transform(F.filter("found", lambda c: c["base"]), place)
    likely = F.filter("found", lambda c: ~c["base"] & (probability(c, weights) >= threshold))
    split = found.select("id", base.alias("base"), F.transform(likely, place).alias("more"))

    def apart(more: Column, base: Column) -> Column:
        free = F.filter(more, lambda m: ~F.exists(base, lambda b: (b["first"] < m["last"]) & (b["last"] > m["first"])))
        return F.filter(free, lambda m: ~F.exists(free, lambda o: (o["first"] < m["last"]) & (o["last"] > m["first"]) & ((o["first"] < m["first"]) | ((o["first"] == m["first"]) & (o["k"] < m["k"])))))

    added = F.when(F.size("more") > 0, apart(F.col("more"), F.col("base"))).otherwise(F.col("more"))
    return split.select("id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", added)).alias("spans"))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_text(spans: Column) -> Column:
    """``kind:first:last``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ",")
