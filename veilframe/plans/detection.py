"""Registered queries: recognizers, lists, layers, overlap resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.functions.recognizers import RECOGNIZERS, custom_recognizer, recognizer_for
from veilframe.functions.spans import layer_rank
from veilframe.functions.taxonomy import SPECIFICITY
from veilframe.operators import detect as D
from veilframe.operators.rule_table import detect_with_rule_table
from veilframe.plans import oracle_detection as O
from veilframe.plans.fixtures import docs_pii, text_table
from veilframe.plans.registry import register
from veilframe.session import table

# Shared by queries and their SQL: what the callers would configure.
DENY = (r"\bexample-(?:user|pass)\b", r"[A-Z]{3}\d{6}", r"4111 1111 1111 1111")
ALLOW = (r"example\.com", r"^10\.20\.")
EXTERNAL = (
    custom_recognizer("EMPLOYEE_NO", r"\b[A-Z]\d{8}\b", 0.65),
    custom_recognizer("DATE_TIME", r"\d{2}/\d{2}/\d{4}", 0.9),
    custom_recognizer("TOO_WEAK", r"[a-z]+", 0.4),
)


def _with(*ctes: str) -> str:
    return "with " + ",\n".join(ctes)


_SPAN_COLS = "pii_type, text, start, \"end\", confidence"


def _register_recognizers() -> None:
    for rec in RECOGNIZERS:
        oracle = (
            _with(O.docs_pii_cte(), O.found_cte(layers=(("pattern", (rec,)),)))
            + f' select doc_id, pii_type, text, cast(start as int) as start, cast("end" as int) as "end", confidence from found'
        )

        def run(spark, sf_dir, rec=rec):
            spans = D.scan_one(docs_pii(spark, sf_dir), rec)
            return D.explode_spans(spans, "doc_id").drop("byte_start", "byte_end")

        register(f"scan_{rec.pii_type.lower()}", oracle)(run)


_register_recognizers()

_RESOLVED = _with(O.docs_pii_cte(), O.found_cte(), O.resolved_cte())


@register(
    "findings_by_type_and_lang",
    _RESOLVED + """
select d.lang, r.pii_type, count(*) as n, count(distinct r.doc_id) as docs
from resolved r join docs_pii d using (doc_id) group by all""",
)
def findings_by_type_and_lang(spark, sf_dir):
    counts = D.explode_counts(D.entity_counts(D.detect(docs_pii(spark, sf_dir))), "lang")
    return counts.groupBy("lang", "pii_type").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@register(
    "resolved_spans",
    _RESOLVED + f"""
select r.doc_id, r.pii_type, r.text, cast(r.start as int) as start, cast(r."end" as int) as "end",
  cast({O.byte_offset('d.text', 'r.start')} as int) as byte_start,
  cast({O.byte_offset('d.text', 'r."end"')} as int) as byte_end, r.confidence
from resolved r join docs_pii d using (doc_id)""",
)
def resolved_spans(spark, sf_dir):
    return D.explode_spans(D.detect(docs_pii(spark, sf_dir)), "doc_id")


@register(
    "contains_pii",
    _with("docs_found as (select doc_id, text from documents)", O.found_cte("docs_found"))
    + """
select d.doc_id, exists (select 1 from found f where f.doc_id = d.doc_id) as has_pii from documents d""",
)
def contains_pii(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents").select("doc_id", "text")
    return D.contains_pii(docs).select("doc_id", "has_pii")


@register(
    "summary_by_type",
    _RESOLVED + " select doc_id, pii_type, count(*) as n from resolved group by all",
)
def summary_by_type(spark, sf_dir):
    return D.explode_counts(D.entity_counts(D.detect(docs_pii(spark, sf_dir))), "doc_id")


@register(
    "min_confidence_and_enabled_types",
    _with(
        O.docs_pii_cte(),
        O.found_cte(layers=(("pattern", tuple(
            r for r in RECOGNIZERS if r.confidence >= 0.7 and not r.pii_type.startswith("IDENTITY")
        )),)),
        O.resolved_cte(),
    ) + f" select doc_id, pii_type, text from resolved",
)
def min_confidence_and_enabled_types(spark, sf_dir):
    enabled = [t for t in SPECIFICITY if not t.startswith("IDENTITY")]
    out = D.detect(docs_pii(spark, sf_dir), min_confidence=0.7, enabled_types=enabled)
    return D.explode_spans(out, "doc_id").select("doc_id", "pii_type", "text")


def _denied(recs=RECOGNIZERS, external=(), allow=()):
    from veilframe.functions.recognizers import Recognizer, active_recognizers

    deny = tuple(Recognizer("API_KEY", 0.95, p) for p in DENY)
    layers = (("pattern", recs), ("denylist", deny), ("external", tuple(active_recognizers(external))))
    return O.found_cte(layers=layers, allow=allow)


@register(
    "denylist_spans",
    _with(O.docs_pii_cte(), _denied())
    + ' select doc_id, pii_type, text, cast(start as int) as start, cast("end" as int) as "end" from found where rank >= ' + str(layer_rank("denylist")),
)
def denylist_spans(spark, sf_dir):
    found = D.find_spans(docs_pii(spark, sf_dir), deny=DENY, out="spans")
    only = found.withColumn("spans", F.filter("spans", lambda s: s["rank"] >= layer_rank("denylist")))
    return D.explode_spans(only, "doc_id").select("doc_id", "pii_type", "text", "start", "end")


@register(
    "allowlist_filtered_spans",
    _with(O.docs_pii_cte(), O.found_cte(allow=ALLOW), O.resolved_cte())
    + ' select doc_id, pii_type, text, cast(start as int) as start from resolved',
)
def allowlist_filtered_spans(spark, sf_dir):
    out = D.detect(docs_pii(spark, sf_dir), allow=ALLOW)
    return D.explode_spans(out, "doc_id").select("doc_id", "pii_type", "text", "start")


@register(
    "layered_detection",
    _with(O.docs_pii_cte(), _denied(external=EXTERNAL, allow=ALLOW), O.resolved_cte())
    + ' select doc_id, pii_type, text, cast(start as int) as start, confidence from resolved',
)
def layered_detection(spark, sf_dir):
    out = D.detect(docs_pii(spark, sf_dir), deny=DENY, external=EXTERNAL, allow=ALLOW)
    return D.explode_spans(out, "doc_id").select("doc_id", "pii_type", "text", "start", "confidence")


@register(
    "detect_distinct_contents",
    _with(
        O.sentences_cte(),
        """shared as (select d.doc_id, d.text || '. ' || sentence as text
             from documents d join sentences on length(d.text) % 37 = n)""",
        O.found_cte("shared"), O.resolved_cte(),
    ) + " select doc_id, pii_type, count(*) as n from resolved group by all",
)
def detect_distinct_contents(spark, sf_dir):
    from veilframe.plans.fixtures import sentence_for
    from veilframe.session import table

    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat("text", F.lit(". "), sentence_for(F.length("text"))).alias("text")
    )
    spans = D.explode_spans(D.detect_distinct(docs, "doc_id"), "doc_id")
    return D.summarize_by_type(spans, "doc_id")


@register(
    "luhn_check",
    _with(f"numbers as (select l_orderkey, l_linenumber, cast(l_orderkey * 1000000007 + l_partkey * 97 + l_suppkey as varchar) || cast(1000 + l_linenumber as varchar) as text from lineitem)")
    + f" select l_orderkey, l_linenumber, {O.LUHN} as ok from numbers",
)
def luhn_check(spark, sf_dir):
    from veilframe.functions.checks import luhn_ok
    from veilframe.session import table

    number = F.concat(
        (F.col("l_orderkey") * 1000000007 + F.col("l_partkey") * 97 + F.col("l_suppkey")).cast("string"),
        (F.lit(1000) + F.col("l_linenumber")).cast("string"),
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", luhn_ok(number).alias("ok"))


@register(
    "iban_check",
    _with("""accounts as (select o_orderkey, case when o_orderkey % 2 = 0 then 'GB' else 'DE' end
       || lpad(cast(o_orderkey % 97 + 2 as varchar), 2, '0') || 'WEST' || lpad(cast(o_custkey as varchar), 14, '0') as text from orders)""")
    + f" select o_orderkey, text, {O.IBAN} as ok from accounts",
)
def iban_check(spark, sf_dir):
    from veilframe.functions.checks import iban_ok
    from veilframe.session import table

    account = F.concat(
        F.when(F.col("o_orderkey") % 2 == 0, "GB").otherwise("DE"),
        F.lpad((F.col("o_orderkey") % 97 + 2).cast("string"), 2, "0"),
        F.lit("WEST"),
        F.lpad(F.col("o_custkey").cast("string"), 14, "0"),
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", account.alias("text"), iban_ok(account).alias("ok")
    )


@register(
    "custom_recognizer_with_validator",
    _with(O.docs_pii_cte(), O.found_cte(layers=(("pattern", (custom_recognizer("EVEN_RUN", r"\b\d{4,9}\b", 0.6),)),)))
    + ' select doc_id, text, cast(start as int) as start from found where cast(text as bigint) % 2 = 0',
)
def custom_recognizer_with_validator(spark, sf_dir):
    rec = custom_recognizer("EVEN_RUN", r"\b\d{4,9}\b", 0.6,
                            validator=lambda t: t.try_cast("bigint") % 2 == 0)
    out = D.scan_one(docs_pii(spark, sf_dir), rec)
    return D.explode_spans(out, "doc_id").select("doc_id", "text", "start")


def flagship(spark, sf_dir):
    """Findings per type and language, the query behind ``entry``."""
    return findings_by_type_and_lang(spark, sf_dir)


__all__ = ["flagship", "recognizer_for"]


#: One rule per part: words of the invented prose with a variable middle, either-or, case-blind, counted and class-only
#: patterns; every tenth rule is an allow rule.
_PART_RULES = r"""part_rules as (
  select p_partkey as k, case when p_partkey % 10 = 9 then 'allow' else 'deny' end as list,
    case when p_partkey % 100 = 50 then '[' || a || b || ']{5}'
      when p_partkey % 10 = 9 then a || '[a-z]*@' || b || '|^' || (p_partkey % 90 + 10) || '[0-9]-|example[.]' || b
      when p_partkey % 4 = 0 then 'th' || a || '[a-z]{2,9}' || b || ' '
      when p_partkey % 4 = 1 then '(?:tion' || a || '|sch' || b || ')[a-z]'
      when p_partkey % 4 = 2 then '(?i)' || a || b || 'e[rn]{2}'
      else b || 'a{2,}' || a || '?' end as pattern
  from (select p_partkey, chr(97 + cast(p_partkey * 7 % 26 as int)) as a, chr(97 + cast((p_partkey // 26) * 11 % 26 as int)) as b from part))"""


def part_rules(spark, sf_dir):
    letter = lambda n: F.char(F.lit(97) + n % 26)
    k = F.col("p_partkey")
    a, b = letter(k * 7), letter(F.expr("p_partkey div 26") * 11)
    allow = F.concat(a, F.lit("[a-z]*@"), b, F.lit("|^"), (k % 90 + 10).cast("string"), F.lit("[0-9]-|example[.]"), b)
    pattern = (
        F.when(k % 100 == 50, F.concat(F.lit("["), a, b, F.lit("]{5}")))
        .when(k % 10 == 9, allow)
        .when(k % 4 == 0, F.concat(F.lit("th"), a, F.lit("[a-z]{2,9}"), b, F.lit(" ")))
        .when(k % 4 == 1, F.concat(F.lit("(?:tion"), a, F.lit("|sch"), b, F.lit(")[a-z]")))
        .when(k % 4 == 2, F.concat(F.lit("(?i)"), a, b, F.lit("e[rn]{2}")))
        .otherwise(F.concat(b, F.lit("a{2,}"), a, F.lit("?")))
    )
    part = table(spark, sf_dir, "part")
    return part.select(F.lpad(k.cast("string"), 12, "0").alias("id"), F.when(k % 10 == 9, "allow").otherwise("deny").alias("list"), pattern.alias("pattern"))


_LISTED = f"""
listed as (
  select d.doc_id, {layer_rank("denylist")} + r.k as rank, regexp_extract_all(d.text, r.pattern) as m, string_split_regex(d.text, r.pattern) as g
  from docs_pii d join part_rules r on r.list = 'deny' and regexp_matches(d.text, r.pattern)),
listed_spans as (
  select doc_id, s as start, s + length(text) as "end", rank, {SPECIFICITY["API_KEY"]} as spec, 'API_KEY' as pii_type, text, cast(0.95 as double) as confidence
  from (select doc_id, rank, m[i] as text, list_sum(list_transform(g[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as s
    from (select *, unnest(range(1, len(m) + 1)) as i from listed))),
every_all as (
  select * from (select * from pat_all union all by name select * from listed_spans) f
  where not exists (select 1 from part_rules a where a.list = 'allow' and regexp_matches(f.text, a.pattern))),
every as (
  select * from every_all f where rank < {layer_rank("denylist")} or not exists (
    select 1 from every_all t where t.doc_id = f.doc_id and t.start = f.start and t."end" = f."end" and t.rank < f.rank))"""


@register(
    "detection_with_rule_table",
    _with(O.docs_pii_cte(), _PART_RULES, O.found_cte(name="pat"), _LISTED.strip(), O.resolved_cte("every"))
    + ' select doc_id, pii_type, text, cast(start as int) as start, cast("end" as int) as "end" from resolved',
)
def detection_with_rule_table(spark, sf_dir):
    found = detect_with_rule_table(docs_pii(spark, sf_dir), part_rules(spark, sf_dir), "doc_id")
    return D.explode_spans(found, "doc_id").select("doc_id", "pii_type", "text", "start", "end")
