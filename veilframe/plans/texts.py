"""Registered queries: tokens, round trips, chat bodies, responses, streams' chunks, span feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.functions import bodies as B
from veilframe.functions.recognizers import RECOGNIZERS
from veilframe.functions.spans import char_to_byte, layer_rank, safe_slice
from veilframe.functions.taxonomy import (
    GENERATIVE_FALLBACK,
    GENERATIVE_LABELS,
    SPECIFICITY,
    alias_table,
    generative_label,
    normalize_label,
    type_specificity,
)
from veilframe.operators import detect as D
from veilframe.operators import evaluate as E
from veilframe.operators import pseudonymize as Z
from veilframe.operators import rehydrate as H
from veilframe.operators import responses as P
from veilframe.plans import oracle_detection as O
from veilframe.plans import oracle_usage as U
from veilframe.plans.fixtures import SENTENCES, docs_pii, requests, responses, sse_chunks
from veilframe.plans.registry import register
from veilframe.session import stored, table
from veilframe.sources import span_feeds as S

_q = O.quote
_DETECT = "with " + ",\n".join([O.docs_pii_cte(), O.found_cte(), O.resolved_cte()])
_TOKENS = _DETECT + ",\n" + O.token_ctes()


# ── tokens ──────────────────────────────────────────────────────────────────


@register("token_map_per_document", _TOKENS + " select doc_id, token, original, pii_type, confidence from token_map")
def token_map_per_document(spark, sf_dir):
    return Z.token_rows(Z.assign_tokens(D.detect(docs_pii(spark, sf_dir))), "doc_id")


@register("sanitized_documents", _TOKENS + " select doc_id, sanitized from sanitized")
def sanitized_documents(spark, sf_dir):
    return Z.sanitize(docs_pii(spark, sf_dir)).select("doc_id", "sanitized")


@register("scan_reports", _TOKENS + """,
counts as (select doc_id, string_agg(pii_type || ':' || n, ';' order by pii_type) as entities from (select doc_id, pii_type, count(*) as n from resolved group by all) group by doc_id)
select s.doc_id, c.doc_id is not null as has_pii, coalesce(entities, '') as entities, case when c.doc_id is not null then sanitized end as sanitized_content
from sanitized s left join counts c using (doc_id)""")
def scan_reports(spark, sf_dir):
    out = Z.scan_report(docs_pii(spark, sf_dir))
    entities = F.array_join(F.transform("entity_types", lambda e: F.concat_ws(":", e["entity_type"], e["count"].cast("string"))), ";")
    return out.select("doc_id", "has_pii", entities.alias("entities"), "sanitized_content")


def _session_docs(spark, sf_dir):
    return docs_pii(spark, sf_dir).withColumns({
        "session_id": F.concat(F.lit("s-"), (F.col("doc_id") % 10).cast("string")),
        "ts": F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60),
    })


_SESSION_TOKENS = _TOKENS + """,
rows as (select 's-' || (doc_id % 10) as session_id, doc_id, timestamp '2024-01-01' + doc_id * interval 1 minute as ts, token, original from token_map)"""


@register("latest_token_per_session", _SESSION_TOKENS + " select session_id, token, arg_max(original, doc_id) as original from rows group by all")
def latest_token_per_session(spark, sf_dir):
    rows = Z.token_rows(Z.assign_tokens(D.detect(_session_docs(spark, sf_dir))), "session_id", "doc_id", "ts")
    return Z.latest_tokens(rows, tie="doc_id").select("session_id", "token", "original")


@register("live_token_mappings", _SESSION_TOKENS + """
select session_id, token from rows group by all having max(ts) >= timestamp '2024-01-01 12:00:00' - interval 30 minute""")
def live_token_mappings(spark, sf_dir):
    rows = Z.token_rows(Z.assign_tokens(D.detect(_session_docs(spark, sf_dir))), "session_id", "ts")
    return Z.live_mappings(rows.withColumnRenamed("ts", "access_ts"), "2024-01-01 12:00:00").select("session_id", "token")


@register("session_scoped_tokens", _DETECT + """,
vals as (select 's-' || (doc_id % 10) as session_id, text as original, min(pii_type) as pii_type from resolved group by all)
select session_id, original, pii_type,
 '[' || pii_type || '_' || row_number() over (partition by session_id, pii_type order by substr(sha256(original), 1, 2), original) || ']' as token from vals""")
def session_scoped_tokens(spark, sf_dir):
    spans = D.explode_spans(D.detect(_session_docs(spark, sf_dir)), "session_id", "doc_id")
    return Z.session_tokens(spans).select("session_id", "original", "pii_type", "token")


@register("rehydrated_documents", "with " + O.docs_pii_cte() + " select doc_id, text as rehydrated from docs_pii")
def rehydrated_documents(spark, sf_dir):
    # Read twice below: the texts and their token map; detection runs once.
    done = stored(Z.sanitize(docs_pii(spark, sf_dir)).select("doc_id", "sanitized", "mappings"), "sanitized")
    rows = Z.token_rows(done, "doc_id")
    wire = done.select("doc_id", F.col("sanitized").alias("text"))
    return H.rehydrate(wire, rows, "doc_id", scope="doc_id").select("doc_id", "rehydrated")


@register("roundtrip_check", _TOKENS + """,
on_wire as (select s.doc_id, len(regexp_extract_all(s.sanitized, '\\[[A-Za-z][A-Za-z0-9_]*_\\d+\\]')) as tokens_on_wire,
  (select count(*) from token_map t where t.doc_id = s.doc_id and contains(s.sanitized, t.original)) as originals_on_wire from sanitized s)
select doc_id, true as restored_ok, cast(tokens_on_wire as int) as tokens_on_wire, 0 as tokens_left, cast(originals_on_wire as int) as originals_on_wire from on_wire""")
def roundtrip_check(spark, sf_dir):
    done = stored(Z.sanitize(docs_pii(spark, sf_dir)).select("doc_id", "text", "sanitized", "mappings"), "sanitized")
    back = H.rehydrate(done.withColumn("scope", F.col("doc_id")), Z.token_rows(done, "doc_id").withColumnRenamed("doc_id", "scope"),
                       "doc_id", text_col="sanitized", scope="scope")
    checked = H.roundtrip_check(back)
    return checked.select("doc_id", "restored_ok", "tokens_on_wire", "tokens_left", "originals_on_wire")


# ── bodies ──────────────────────────────────────────────────────────────────

_CHATS = O.sentences_cte() + f""",
chats as (
 select c.conv_id, c.turn, c.role, c.text || case when c.turn = f.first_user then ' ' || sentence else '' end as text
 from conversations c left join (select conv_id, min(turn) as first_user from conversations where role = 'user' group by conv_id) f using (conv_id)
 join sentences on c.conv_id % {len(SENTENCES)} = n),
parts as (
 select conv_id, turn, 0 as part, role, text from chats
 union all select conv_id, turn, 1, role, 'part of turn ' || turn from chats where conv_id % 5 = 0
 union all select distinct conv_id, 1000000, 0, '', 'mail bob' || conv_id || '@example.com' from chats where conv_id % 11 = 0),
joined as (select conv_id as doc_id, string_agg(text || chr(10), '' order by turn, part) as text from parts group by conv_id)"""


@register("request_texts", "with " + _CHATS + " select doc_id as request_id, text from joined")
def request_texts(spark, sf_dir):
    return Z.with_texts(requests(spark, sf_dir)).select("request_id", "text")


@register("request_user_texts", "with " + _CHATS + """
select conv_id as request_id, string_agg(text, chr(10) order by turn, part) filter (role = 'user') as user_text from parts group by conv_id""")
def request_user_texts(spark, sf_dir):
    df = Z.with_texts(requests(spark, sf_dir))
    return df.select("request_id", B.extract_user_text(F.col("body"), F.col("parts")).alias("user_text"))


@register("request_parts", "with " + _CHATS + f"""
select conv_id as request_id, case when turn = 1000000 then -1 else turn end as message, role, text, {U.model_case('conv_id')} as model from parts""")
def request_parts(spark, sf_dir):
    df = Z.with_texts(requests(spark, sf_dir)).select("request_id", B.model_of(F.col("body")).alias("model"), F.explode("parts").alias("p"))
    return df.select("request_id", F.col("p.message").cast("bigint").alias("message"), "p.role", "p.text", "model")


# Findings are cut at part borders.
_CLIPPED = """ranges as (
 select conv_id as doc_id, hi - len as lo, hi from (
  select conv_id, length(text) as len,
   cast(sum(length(text) + 1) over (partition by conv_id order by turn, part) as bigint) - 1 as hi from parts)),
clipped as (
 select r.doc_id, greatest(r.start, g.lo) as start, least(r."end", g.hi) as "end", r.pii_type, r.confidence,
  substr(d.text, cast(greatest(r.start, g.lo) as bigint) + 1, cast(least(r."end", g.hi) - greatest(r.start, g.lo) as bigint)) as text
 from resolved r join ranges g on r.doc_id = g.doc_id and r.start < g.hi and r."end" > g.lo join joined d on d.doc_id = r.doc_id)"""
_BODY_TOKENS = "with " + ",\n".join([_CHATS, O.found_cte("joined"), O.resolved_cte(), _CLIPPED, O.token_ctes("clipped", docs="joined")])


@register("sanitized_request_texts", _BODY_TOKENS + " select doc_id as request_id, sanitized as text from sanitized")
def sanitized_request_texts(spark, sf_dir):
    done = Z.sanitize_bodies(requests(spark, sf_dir))
    again = done.select("request_id", B.text_parts(F.col("sanitized_body")).alias("parts"))
    return again.select("request_id", B.extract_text(F.col("parts")).alias("text"))


@register("sanitized_bodies_keep_other_fields", "with " + _CHATS + f"""
select conv_id as request_id, {U.model_case('conv_id')} as model, conv_id % 2 = 0 as stream, '0.5' as temperature, count(*) as messages,
 string_agg(role, ',' order by turn) as roles from conversations group by conv_id""")
def sanitized_bodies_keep_other_fields(spark, sf_dir):
    body = F.col("sanitized_body")
    done = Z.sanitize_bodies(requests(spark, sf_dir))
    messages = F.from_json(F.get_json_object(body, "$.messages"), "array<struct<role:string>>")
    return done.select(
        "request_id", B.model_of(body).alias("model"), B.is_stream(body).alias("stream"),
        F.get_json_object(body, "$.temperature").alias("temperature"), F.size(messages).cast("bigint").alias("messages"),
        F.array_join(F.transform(messages, lambda m: m["role"]), ",").alias("roles"))


@register("passthrough_bodies", _BODY_TOKENS + " select doc_id as request_id, sanitized as text from sanitized")
def passthrough_bodies(spark, sf_dir):
    done = Z.sanitize_passthrough(requests(spark, sf_dir))
    return done.select("request_id", B.extract_text(B.text_parts(F.col("body"))).alias("text"))


@register("raw_detections", "with " + ",\n".join([_CHATS, O.found_cte("joined"), O.resolved_cte()]) + f"""
select r.doc_id as request_id, r.pii_type, r.text, cast({O.byte_offset('d.text', 'r.start')} as int) as start,
 cast({O.byte_offset('d.text', 'r."end"')} as int) as "end", r.confidence as score from resolved r join joined d using (doc_id)""")
def raw_detections(spark, sf_dir):
    found = D.detect(Z.with_texts(requests(spark, sf_dir)), "text")
    rows = D.explode_spans(found, "request_id")
    return rows.select("request_id", "pii_type", "text", F.col("byte_start").alias("start"), F.col("byte_end").alias("end"),
                       F.col("confidence").alias("score"))


@register("rehydrated_bodies", "with " + _CHATS + " select doc_id as request_id, text from joined")
def rehydrated_bodies(spark, sf_dir):
    done = Z.sanitize_bodies(requests(spark, sf_dir))
    rows = Z.token_rows(done, "request_id").withColumnRenamed("request_id", "scope")
    wire = done.select("request_id", F.col("request_id").alias("scope"), F.col("sanitized_body").alias("body"))
    back = H.rehydrate_json(wire, rows, "request_id", scope="scope")
    return back.select("request_id", B.extract_text(B.text_parts(F.col("rehydrated"))).alias("text"))


def _stream_tokens(spark, sf_dir):
    """Per session an e-mail and a phone original, some with quotes."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 50).alias("k")).distinct()
    k = F.col("k").cast("string")
    pairs = F.array(
        F.struct(F.lit("[EMAIL_ADDRESS_1]").alias("token"), F.concat(F.lit('"user'), k, F.lit('"@example.com')).alias("original")),
        F.struct(F.lit("[PHONE_NUMBER_1]").alias("token"), F.concat(F.lit("555-100-"), F.lpad(k, 4, "0")).alias("original")),
    )
    return c.select(F.concat(F.lit("s-"), k).alias("session_id"), F.explode(pairs).alias("p")).select("session_id", "p.*")


_FILLED = """'write to \\"user' || (conv_id % 50) || '\\"@example.com or 555-100-' || lpad(cast(conv_id % 50 as varchar), 4, '0')"""
_DELTA = lambda t: f"""'data: {{"choices":[{{"delta":{{"content":"' || {t} || '"}}}}]}}' || chr(10) || chr(10)"""
SSE_ORACLE = f"""with c as (select distinct conv_id from conversations)
select conv_id as stream_id, 0 as seq, {_DELTA("'Hello ' || conv_id")} as rehydrated from c
union all select conv_id, 1, {_DELTA(_FILLED)} from c where conv_id % 7 <> 0
union all select conv_id, 2, {_DELTA("'and [NO_SUCH_9]'")} from c where conv_id % 7 <> 0
union all select conv_id, 3, 'data: {{"note":"tail"}}' || chr(10) || 'data: {{"usage":{{"prompt_tokens":' || (conv_id * 37 % 2000) || ',"completion_tokens":' || (conv_id * 11 % 300) || '}}}}' || chr(10) || chr(10) from c where conv_id % 9 <> 0
union all select conv_id, 4, 'data: [DONE]' || chr(10) || chr(10) from c where conv_id % 10 <> 0"""


@register("rehydrated_stream_chunks", SSE_ORACLE)
def rehydrated_stream_chunks(spark, sf_dir):
    out = H.rehydrate_sse(sse_chunks(spark, sf_dir), _stream_tokens(spark, sf_dir), ["stream_id", "seq"])
    return out.select("stream_id", "seq", "rehydrated")


# ── offsets ─────────────────────────────────────────────────────────────────


@register("char_to_byte_offsets", """
select doc_id, strlen(substr(text, 1, doc_id % 700)) as byte_offset, strlen(text) as past_end,
 case when doc_id % 700 + 12 <= length(text) then substr(text, doc_id % 700 + 1, 12) end as slice from documents""")
def char_to_byte_offsets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text, pos = F.col("text"), F.col("doc_id") % 700
    return docs.select(
        "doc_id", char_to_byte(text, pos).cast("bigint").alias("byte_offset"),
        char_to_byte(text, F.length("text") + 5).cast("bigint").alias("past_end"), safe_slice(text, pos, pos + 12).alias("slice"))


# ── labels ──────────────────────────────────────────────────────────────────

_ALIASES = ", ".join(f"({_q(a)}, {_q(t)})" for a, t in alias_table().items())
_GENERATED = ", ".join(f"({_q(a)}, {_q(t)})" for a, t in GENERATIVE_LABELS.items())
_SPECS = ", ".join(f"({_q(t)}, {s})" for t, s in SPECIFICITY.items())
_LABELS = tuple(alias_table()) + tuple(GENERATIVE_LABELS) + ("EMPLOYEE_NO", "identity.unknown")


@register("normalized_labels", f"""with labels(i, label) as (values {', '.join(f"({i}, {_q(x)})" for i, x in enumerate(_LABELS))}),
aliases(label, pii_type) as (values {_ALIASES}), generated(label, pii_type) as (values {_GENERATED}), specs(pii_type, spec) as (values {_SPECS})
select event_id, l.label, coalesce(a.pii_type, l.label) as pii_type, coalesce(g.pii_type, '{GENERATIVE_FALLBACK}') as generative_type, coalesce(spec, 1) as specificity
from events join labels l on event_id % {len(_LABELS)} = i left join aliases a using (label) left join generated g on g.label = l.label
left join specs on specs.pii_type = coalesce(a.pii_type, l.label)""")
def normalized_labels(spark, sf_dir):
    labels = F.array(*[F.lit(x) for x in _LABELS])
    rows = table(spark, sf_dir, "events").select("event_id", F.get(labels, (F.col("event_id") % len(_LABELS)).cast("int")).alias("label"))
    rows = rows.withColumns({"pii_type": normalize_label(F.col("label")), "generative_type": generative_label(F.col("label"))})
    return rows.withColumn("specificity", type_specificity(F.col("pii_type")))


# ── span feeds ──────────────────────────────────────────────────────────────


def _replies(spark, sf_dir):
    """Analyzer replies over document starts: a person, an unknown label, a range past the end."""
    docs = docs_pii(spark, sf_dir)
    k = (F.col("doc_id") % 30).cast("string")
    reply = F.concat(
        F.lit('{"result":[{"entity_type":"PER","start":0,"end":'), (F.col("doc_id") % 9 + 3).cast("string"), F.lit(',"score":0.'),
        (F.col("doc_id") % 9 + 1).cast("string"), F.lit('},{"entity_type":"NICKNAME","start":'), k, F.lit(',"end":'),
        (F.col("doc_id") % 30 + 4).cast("string"), F.lit(',"score":0.0},{"entity_type":"identity.ssn","start":5,"end":99999999,"score":0.9}]}'))
    return docs.withColumn("reply", reply)


_FEED = """feed_{0} as (
 select doc_id, 'PERSON' as pii_type, substr(text, 1, cast(doc_id % 9 + 3 as bigint)) as text, 0 as start, doc_id % 9 + 3 as "end", (doc_id % 9 + 1) / 10.0 as confidence, 1 as spec, 0 as i from docs_pii where length(text) >= doc_id % 9 + 3
 union all select doc_id, 'NICKNAME', substr(text, cast(doc_id % 30 + 1 as bigint), 4), doc_id % 30, doc_id % 30 + 4, {1}, 1, 1 from docs_pii where length(text) >= doc_id % 30 + 4)"""


@register("ingested_encoder_spans", "with " + O.docs_pii_cte() + ", " + _FEED.format("e", 0.85) +
          ' select doc_id, pii_type, text, cast(start as int) as start, cast("end" as int) as "end", cast(confidence as double) as confidence from feed_e')
def ingested_encoder_spans(spark, sf_dir):
    fed = S.ingest_external_spans(_replies(spark, sf_dir), "encoder")
    return D.explode_spans(fed, "doc_id", spans="feed").drop("byte_start", "byte_end")


@register("detection_with_model_layers", "with " + ",\n".join([O.docs_pii_cte(), _FEED.format("n", 0.0), O.found_cte(), f"""
every as (select doc_id, start, "end", rank, spec, pii_type, text, confidence from found
 union all select doc_id, start, "end", {layer_rank("ner")} + i, spec, pii_type, text, cast(confidence as double) from feed_n where confidence >= 0.5)""", O.resolved_cte("every")]) +
          ' select doc_id, pii_type, text, cast(start as int) as start from resolved')
def detection_with_model_layers(spark, sf_dir):
    fed = S.ingest_external_spans(_replies(spark, sf_dir), "ner")
    return D.explode_spans(D.detect(fed, feeds=["feed"]), "doc_id").select("doc_id", "pii_type", "text", "start")


@register("generated_spans", """
select doc_id, 'PERSON' as pii_type, substr(regexp_replace(text, '["\\\\\\n]', '_', 'g'), 1, 5) as text, doc_id % 50 as start,
 doc_id % 50 + least(doc_id % 8, strlen(substr(regexp_replace(text, '["\\\\\\n]', '_', 'g'), 1, 5))) as "end", 0.85::double as confidence from documents
union all select doc_id, 'API_KEY', 'zz', 9, 9, 0.85::double from documents""")
def generated_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    clean = F.substring(F.regexp_replace("text", r'["\\\n]', "_"), 1, 5)
    start = F.col("doc_id") % 50
    reply = F.concat(
        F.lit('Sure, here: [{"text":"'), clean, F.lit('","start":'), start.cast("string"), F.lit(',"end":'),
        (start + F.col("doc_id") % 8).cast("string"),
        F.lit(',"label":"first_name"},{"text":"no end","start":1,"label":"city"},{"text":"zz","start":9,"end":2,"label":"galaxy"}] [done]'))
    out = S.parse_generated_spans(docs.select("doc_id", reply.alias("reply")))
    return out.select("doc_id", F.explode("items").alias("i")).select("doc_id", "i.*")


@register("model_catalog_rows", """with m as (select s_suppkey, s_nationkey, 'model-' || s_suppkey as a, 'model-' || s_nationkey as b from supplier)
select s_suppkey, a as model from m union all select s_suppkey, b from m""")
def model_catalog_rows(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    a = F.concat(F.lit('"model-'), F.col("s_suppkey").cast("string"), F.lit('"'))
    b = F.concat(F.lit('"model-'), F.col("s_nationkey").cast("string"), F.lit('"'))
    k = F.col("s_suppkey") % 3
    body = (
        F.when(k == 0, F.concat(F.lit('{"data":[{"id":'), a, F.lit('},{"id":'), b, F.lit('},{"id":5},{"name":"x"}]}')))
        .when(k == 1, F.concat(F.lit("["), a, F.lit(","), b, F.lit(",7]")))
        .otherwise(F.concat(F.lit('{"models":['), a, F.lit(","), b, F.lit("]}")))
    )
    return S.read_model_catalogs(s.select("s_suppkey", body.alias("body")), "body", "s_suppkey").drop("position")


# ── responses ───────────────────────────────────────────────────────────────

_R = "with " + ",\n".join([
    U.USAGE_RAW, U.PRICES_CTE, U.priced_models_cte(),
    """e as (select distinct event_id, cast(substr(event_id, 4) as bigint) as n, event_ts, session_id, model_id, starts_with(model_id, 'claude') as is_anthropic,
  tokens_in_user as i, tokens_out as o, tokens_in_cached as c, tokens_in_cache_write as w from usage_raw)""",
    """r as (select e.*, n % 17 = 0 as silent, (n % 17 = 0 or (i = 0 and o = 0)) as absent, coalesce(m.price.system_tokens, 0) as sys, m.price as price
  from e left join priced_models m using (model_id))""",
])


@register("openai_usage", _R + """ select event_id, case when silent then 0 else i end as prompt_tokens, case when silent then 0 else o end as completion_tokens,
 case when silent then 0 else c end as cached_tokens, case when silent then 0 else i + o end as total_tokens from r where not is_anthropic""")
def openai_usage(spark, sf_dir):
    df = responses(spark, sf_dir).where(~F.col("is_anthropic"))
    usage = P.parse_response(F.col("response"))["usage"]
    return df.select("event_id", *[v.alias(k) for k, v in P.openai_usage(usage).items()])


@register("anthropic_usage", _R + """ select event_id, case when silent then 0 else i end as input_tokens, case when silent then 0 else o end as output_tokens,
 case when silent then 0 else w end as cache_creation_input_tokens, case when silent then 0 else c end as cache_read_input_tokens from r where is_anthropic""")
def anthropic_usage(spark, sf_dir):
    df = responses(spark, sf_dir).where(F.col("is_anthropic"))
    usage = P.parse_response(F.col("response"))["usage"]
    return df.select("event_id", *[v.alias(k) for k, v in P.anthropic_usage(usage).items()])


@register("provider_cost_cents", _R + " select event_id, case when n % 13 = 0 then cast(round((n % 500 + 0.126) * 100) as bigint) end as actual_cost_cents from r")
def provider_cost_cents(spark, sf_dir):
    parsed = P.parse_response(F.col("response"))
    return responses(spark, sf_dir).select("event_id", P.provider_cost_cents(parsed, F.col("is_anthropic")).alias("actual_cost_cents"))


_SPLIT = """case when absent then 0 when i > sys then i - sys else i end"""


@register("system_user_split", _R + f" select event_id, cast(sys as bigint) as tokens_in_system, cast({_SPLIT} as bigint) as tokens_in_user, case when absent then 'unavailable' else 'api_reported' end as token_count_source from r")
def system_user_split(spark, sf_dir):
    events = P.usage_events_from_responses(responses(spark, sf_dir))
    return events.select("event_id", "tokens_in_system", "tokens_in_user", "token_count_source")


@register("usage_events_from_responses", _R + f""", s as (select *, {_SPLIT} as usr, case when absent then 0 else c end as cc, case when absent then 0 else o end as oo from r)
select event_id, cast(oo as bigint) as tokens_out, cast(cc as bigint) as tokens_in_cached, cast(case when absent or not is_anthropic then 0 else w end as bigint) as tokens_in_cache_write,
 cast(coalesce((sys + usr) * price.input_cents // 1000000 + cc * price.cached_cents // 1000000 + oo * price.output_cents // 1000000, 0) as bigint) as cost_estimate_cents,
 case when n % 13 = 0 then cast(round((n % 500 + 0.126) * 100) as bigint) end as actual_cost_cents, price is null as cost_unavailable, true as success from s""")
def usage_events_from_responses(spark, sf_dir):
    events = P.usage_events_from_responses(responses(spark, sf_dir))
    return events.select("event_id", "tokens_out", "tokens_in_cached", "tokens_in_cache_write", "cost_estimate_cents",
                         "actual_cost_cents", "cost_unavailable", "success")


_STREAMS = "with " + U.PRICES_CTE + f""",
c as (select distinct conv_id as n, {U.model_case('conv_id')} as model_id from conversations),
closed as (select n, model_id, n % 9 <> 0 as has_usage, n % 10 <> 0 as ended, 1 + case when n % 7 <> 0 then 2 else 0 end + (n % 9 <> 0)::int + (n % 10 <> 0)::int as chunks from c),
pm as (select model_id, arg_max(p, length(p.model)) as price from (select distinct model_id from c) join prices p on starts_with(model_id, p.model) group by model_id),
z as (select *, coalesce(price.system_tokens, 0) as sys, (has_usage and not starts_with(model_id, 'claude') and (n * 37 % 2000 > 0 or n * 11 % 300 > 0)) as known from closed left join pm using (model_id))"""


@register("closed_streams", _STREAMS + " select n as stream_id, has_usage, chunks as chunk_count, ended, (not has_usage and (not ended or chunks < 3)) as was_partial from z")
def closed_streams(spark, sf_dir):
    closed = P.close_streams(sse_chunks(spark, sf_dir), ["stream_id"])
    return closed.select("stream_id", F.col("last_usage").isNotNull().alias("has_usage"), "chunk_count", "ended",
                         P.partial_flag(F.col("last_usage"), F.col("ended"), F.col("chunk_count")).alias("was_partial"))


@register("usage_events_from_streams", _STREAMS + """ select 's' || n as event_id, cast(sys as bigint) as tokens_in_system,
 cast(case when not known then 0 when n * 37 % 2000 > sys then n * 37 % 2000 - sys else n * 37 % 2000 end as bigint) as tokens_in_user,
 cast(case when known then n * 11 % 300 else 0 end as bigint) as tokens_out, case when known then 'api_reported' else 'estimated' end as token_count_source,
 (not has_usage and (not ended or chunks < 3)) as was_partial, (known and n * 11 % 300 > 0) as success from z""")
def usage_events_from_streams(spark, sf_dir):
    closed = P.close_streams(sse_chunks(spark, sf_dir), ["stream_id", "session_id", "model_id", "ts"])
    events = P.usage_events_from_streams(closed.withColumns({
        "event_id": F.concat(F.lit("s"), F.col("stream_id").cast("string")), "event_ts": F.col("ts"), "duration_ms": F.lit(0)}))
    return events.select("event_id", "tokens_in_system", "tokens_in_user", "tokens_out", "token_count_source", "was_partial", "success")


# ── evaluation ──────────────────────────────────────────────────────────────


def _labelled(spark, sf_dir):
    """Documents with the known sentence's value as gold: its recognizer and range."""
    docs = table(spark, sf_dir, "documents")
    types = F.array(*[F.lit(r.pii_type) for r in RECOGNIZERS])
    return docs.select(
        "doc_id", F.get(types, (F.col("doc_id") % len(SENTENCES)).cast("int")).alias("pii_type"),
        (F.length("text") + 2).alias("start"), "text")


_GOLD_TYPES = "types(n, pii_type) as (values " + ", ".join(
    f"({i}, {_q(t)})" for i, t in enumerate(r.pii_type for r in RECOGNIZERS)) + ")"


@register("raw_leak_audit", _TOKENS + """
select s.doc_id, t.original as term from sanitized s join token_map t using (doc_id) where contains(s.sanitized, t.original)
union all select doc_id, 'wörd' as term from documents where contains(lower(text), 'ä')""")
def raw_leak_audit(spark, sf_dir):
    done = stored(Z.sanitize(docs_pii(spark, sf_dir)).select("doc_id", "sanitized", "mappings"), "sanitized")
    terms = Z.token_rows(done, "doc_id").select("doc_id", F.col("original").alias("term"))
    # A wire that leaks one escaped term for texts with an umlaut.
    umlauts = F.contains(F.lower("text"), F.lit("ä"))
    docs = table(spark, sf_dir, "documents").select("doc_id", umlauts.alias("bad"))
    wire = done.join(docs, "doc_id").select("doc_id", F.concat("sanitized", F.when(F.col("bad"), F.lit(" w\\u00f6rd")).otherwise("")).alias("wire"))
    extra = table(spark, sf_dir, "documents").select("doc_id", F.lit("wörd").alias("term"))
    return E.raw_leaks(wire, terms.unionByName(extra), "doc_id")


@register("corpus_coverage", _TOKENS + ", " + _GOLD_TYPES + """,
toks as (select doc_id, unnest(regexp_extract_all(sanitized, '\\[\\s*([A-Z][A-Z0-9_]*)\\s*_\\d+\\s*\\]', 1)) as t from sanitized),
seen as (select doc_id, string_agg(distinct t, ',' order by t) as seen from toks group by doc_id)
select d.doc_id, y.pii_type as label, exists (select 1 from toks where toks.doc_id = d.doc_id and toks.t = y.pii_type) as ok,
 case when exists (select 1 from toks where toks.doc_id = d.doc_id and toks.t = y.pii_type) then y.pii_type else '' end as matched, coalesce(seen, '') as seen
from docs_pii d join types y on d.doc_id % 37 = y.n left join seen using (doc_id)""")
def corpus_coverage(spark, sf_dir):
    wire = Z.sanitize(docs_pii(spark, sf_dir)).select("doc_id", F.col("sanitized").alias("wire"))
    expected = _labelled(spark, sf_dir).select("doc_id", F.col("pii_type").alias("label"))
    accepted = expected.select("label", F.col("label").alias("pii_type")).distinct()
    return E.corpus_coverage(expected, wire, accepted, "doc_id")


@register("corpus_coverage_totals", _TOKENS + ", " + _GOLD_TYPES + """,
ok as (select d.doc_id, contains(s.sanitized, '[' || y.pii_type || '_') as ok from docs_pii d join types y on d.doc_id % 37 = y.n join sanitized s using (doc_id))
select count(*) as total, count(*) filter (ok) as ok, count(*) filter (not ok) as miss from ok""")
def corpus_coverage_totals(spark, sf_dir):
    return E.coverage_totals(corpus_coverage(spark, sf_dir))


@register("span_scores", _DETECT + ", " + _GOLD_TYPES + """,
gold as (select doc_id, y.pii_type, length(d.text) + 2 as start from documents d join types y on d.doc_id % 37 = y.n),
pred as (select distinct doc_id, pii_type, start from resolved),
b as (select coalesce(p.pii_type, g.pii_type) as pii_type, p.doc_id is not null as p, g.doc_id is not null as g from pred p full join gold g on p.doc_id = g.doc_id and p.pii_type = g.pii_type and p.start = g.start),
s as (select pii_type, count(*) filter (p and g) as tp, count(*) filter (not g) as fp, count(*) filter (not p) as fn from b group by pii_type),
m as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as pr, case when tp + fn > 0 then tp / (tp + fn) else 0 end as re from s)
select pii_type, tp, fp, fn, round(pr, 6) as precision, round(re, 6) as recall,
 round(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end, 6) as f1, round(case when 4 * pr + re > 0 then 5 * pr * re / (4 * pr + re) else 0 end, 6) as f2 from m""")
def span_scores(spark, sf_dir):
    gold = _labelled(spark, sf_dir)
    pred = D.explode_spans(D.detect(docs_pii(spark, sf_dir)), "doc_id")
    out = E.span_scores(pred, gold, ("doc_id", "start"))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "f2")})
