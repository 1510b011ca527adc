"""DuckDB SQL for detection, overlap resolution and pseudonymization."""

from __future__ import annotations

from collections.abc import Sequence

from veilframe.functions.recognizers import RECOGNIZERS, Recognizer
from veilframe.functions.spans import LAYER_STEP, LAYERS
from veilframe.functions.taxonomy import DEFAULT_SPECIFICITY, SPECIFICITY
from veilframe.plans.fixtures import SENTENCES

# The stack-safe patterns in the form other regex engines read.
_PLAIN_PATTERN = {
    "URL": r"(?i)(?:(?:https?://)|(?:\b))(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?:/[^\s]*)?",
    "CREDENTIAL_CONNECTION_STRING": r"(?i)(?:[a-z_ ]+\s*=\s*[^;]+;\s*){3,}",
}


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sentences_cte() -> str:
    rows = ", ".join(f"({i}, {quote(s)})" for i, s in enumerate(SENTENCES))
    return f"sentences(n, sentence) as (values {rows})"


def docs_pii_cte() -> str:
    return (
        sentences_cte()
        + f""",
docs_pii as (
  select doc_id, lang, text || '. ' || sentence as text
  from documents join sentences on doc_id % {len(SENTENCES)} = n)"""
    )


_DIGITS = "regexp_replace(text, '[^0-9]', '', 'g')"
LUHN = f"""(length({_DIGITS}) between 13 and 19 and
 list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
   case when i % 2 = 0 then
     case when cast(substr(reverse({_DIGITS}), i, 1) as int) * 2 > 9
          then cast(substr(reverse({_DIGITS}), i, 1) as int) * 2 - 9
          else cast(substr(reverse({_DIGITS}), i, 1) as int) * 2 end
   else cast(substr(reverse({_DIGITS}), i, 1) as int) end)) % 10 = 0)"""

_ALNUM = "regexp_replace(text, '[^0-9A-Za-z]', '', 'g')"
_ROTATED = f"(substr({_ALNUM}, 5) || substr({_ALNUM}, 1, 4))"
_NUMERIC = f"""list_aggregate(list_transform(string_split({_ROTATED}, ''), lambda c:
   case when regexp_full_match(c, '[0-9]') then c else cast(ascii(c) - 55 as varchar) end), 'string_agg', '')"""
IBAN = f"""(length({_ALNUM}) >= 5 and try_cast({_NUMERIC} as uhugeint) is not null
 and try_cast({_NUMERIC} as uhugeint) % 97 = 1)"""
_VALIDATORS = {"CREDIT_CARD": LUHN, "IBAN_CODE": IBAN}


def found_cte(
    docs: str = "docs_pii",
    key: str = "doc_id",
    layers: Sequence[tuple[str, Sequence[Recognizer]]] = (("pattern", RECOGNIZERS),),
    allow: Sequence[str] = (),
    name: str = "found",
) -> str:
    """Every match of every rule: key, start, end, rank, spec, pii_type, text, confidence."""
    branches = []
    for layer, recs in layers:
        for i, rec in enumerate(recs):
            pattern = quote(_PLAIN_PATTERN.get(rec.pii_type, rec.pattern))
            rank = LAYERS.index(layer) * LAYER_STEP + i
            spec = SPECIFICITY.get(rec.pii_type, DEFAULT_SPECIFICITY)
            check = _VALIDATORS.get(rec.pii_type, "true") if layer == "pattern" else "true"
            branches.append(f"""
  select {key}, s as start, s + length(text) as "end", {rank} as rank, {spec} as spec,
    {quote(rec.pii_type)} as pii_type, text, cast({rec.confidence} as double) as confidence
  from (
    select {key}, m[i] as text,
      list_sum(list_transform(g[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as s
    from (select {key}, m, g, unnest(range(1, len(m) + 1)) as i
          from (select {key}, regexp_extract_all(text, {pattern}) as m,
                  string_split_regex(text, {pattern}) as g from {docs})))
  where {check}""")
    body = "\n  union all".join(branches)
    allowed = "".join(f" and not regexp_matches(text, {quote(a)})" for a in allow)
    ruled = LAYERS.index("denylist") * LAYER_STEP
    cte = f"{name}_all as (select * from ({body}) where true{allowed})"
    return cte + f""",
{name} as (
  select * from {name}_all f where rank < {ruled} or not exists (
    select 1 from {name}_all t where t.{key} = f.{key} and t.start = f.start and t."end" = f."end"
      and t.rank < f.rank))"""


def resolved_cte(found: str = "found", key: str = "doc_id", name: str = "resolved") -> str:
    """Disjoint spans per key by the ordered fold."""
    m, e = "x[1]", "acc[-1]"
    finer = f"{m}.spec > {e}.spec"
    surer = f"({finer} or ({m}.spec = {e}.spec and {m}.confidence > {e}.confidence))"
    wins = f"""case
      when {m}.start = {e}.start and {m}."end" = {e}."end" then {surer}
      when {m}.start >= {e}.start and {m}."end" <= {e}."end" then {finer}
      when {e}.start >= {m}.start and {e}."end" <= {m}."end" then {e}.spec <= {m}.spec
      else {surer} end"""
    return f"""{name} as (
  select {key}, unnest(kept, recursive := true) from (
    select {key}, list_reduce(list_transform(spans, lambda s: [s]), lambda acc, x:
      case when {m}.start >= {e}."end" then list_concat(acc, x)
           when {wins} then list_concat(acc[1:len(acc)-1], x)
           else acc end) as kept
    from (
      select {key}, list({{'start': start, 'end': "end", 'rank': rank, 'spec': spec, 'pii_type': pii_type,
          'text': text, 'confidence': confidence}} order by start, "end", confidence desc, rank) as spans
      from {found} group by {key})))"""


def token_ctes(resolved: str = "resolved", docs: str = "docs_pii", key: str = "doc_id",
               prefix: str = "", carry: str = "") -> str:
    """token_map and sanitized texts: tokens numbered per type from the last span backwards."""
    carried = f", {carry}" if carry else ""
    return f"""{prefix}token_map as (
  select {key}, '[' || pii_type || '_' || row_number() over (partition by {key}, pii_type order by start desc) || ']' as token,
    text as original, pii_type, confidence
  from (select *, row_number() over (partition by {key}, text order by start desc) as seen from {resolved})
  where seen = 1),
{prefix}pieces as (
  select r.{key}, r.start,
    substr(d.text, cast(coalesce(lag(r."end") over w, 0) as bigint) + 1,
           cast(r.start - coalesce(lag(r."end") over w, 0) as bigint)) || t.token as piece
  from {resolved} r join {prefix}token_map t on t.{key} = r.{key} and t.original = r.text
  join {docs} d on d.{key} = r.{key}
  window w as (partition by r.{key} order by r.start)),
{prefix}sanitized as (
  select d.{key}{carried}, coalesce(p.joined, '') || substr(d.text, cast(coalesce(l.last_end, 0) as bigint) + 1) as sanitized
  from {docs} d
  left join (select {key}, string_agg(piece, '' order by start) as joined from {prefix}pieces group by {key}) p on p.{key} = d.{key}
  left join (select {key}, max("end") as last_end from {resolved} group by {key}) l on l.{key} = d.{key})"""


def byte_offset(text: str, pos: str) -> str:
    return f"strlen(substr({text}, 1, cast({pos} as bigint)))"
