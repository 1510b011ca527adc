"""Registered queries: lists, policy, routing, sessions, audit, keys, clipboard, latency, limits, hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.functions import bodies as B
from veilframe.operators import clipboard as C
from veilframe.operators import detect as D
from veilframe.operators import hooks, keys, latency, policy
from veilframe.operators import limits as L
from veilframe.operators import pseudonymize as Z
from veilframe.operators import rollups as R
from veilframe.operators import routing as G
from veilframe.operators import sessions as N
from veilframe.plans import oracle_detection as O
from veilframe.plans import oracle_usage as U
from veilframe.plans.fixtures import (
    AS_OF,
    SENTENCES,
    clipboard_log,
    docs_pii,
    key_events,
    latencies,
    model_for,
    request_headers,
    request_log,
    requests,
    usage,
    usage_raw,
)
from veilframe.plans.registry import register
from veilframe.plans.texts import _BODY_TOKENS, _CHATS
from veilframe.plans.usage import ts_text
from veilframe.session import table, work_path
from veilframe.sources import audit_store as A
from veilframe.sources import rule_lists as W

_q = O.quote
_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S') as {1}"


# ── lists ───────────────────────────────────────────────────────────────────


def _rule_docs(spark, sf_dir):
    """One rule document per part: an allow rule and a deny rule, some unusable."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pattern = F.when(k % 5 == 0, "   ").when(k % 7 == 0, F.repeat(F.lit("a"), 501)).otherwise(F.concat(F.lit("  item-"), k.cast("string"), F.lit("  ")))
    rule = lambda kind, label: F.to_json(F.struct(
        F.concat(F.lit(kind), k.cast("string")).alias("id"), pattern.alias("pattern"), label.alias("label"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at"), (k % 3 != 0).alias("enabled")))
    label = F.when(k % 2 == 0, "").otherwise(F.concat(F.lit(" label "), k.cast("string")))
    body = F.concat(F.lit('{"allowlist":['), rule("a", label), F.lit('],"denylist":['), rule("d", label), F.lit("]}"))
    return p.select("p_partkey", body.alias("body"))


_RULES = """with r as (select p_partkey as k, case when p_partkey % 5 = 0 then '   ' when p_partkey % 7 = 0 then repeat('a', 501) else '  item-' || p_partkey || '  ' end as pattern,
  case when p_partkey % 2 = 0 then '' else ' label ' || p_partkey end as label, p_partkey % 3 <> 0 as enabled from part),
rules as (select k, 'allow' as list, 'a' || k as id, pattern, label, enabled from r union all select k, 'deny', 'd' || k, pattern, label, enabled from r)"""


def _rules(spark, sf_dir):
    docs = _rule_docs(spark, sf_dir).select(F.from_json("body", W.LISTS_SCHEMA).alias("l")).select("l.*")
    return W.explode_lists(docs)


@register("rule_list_rows", _RULES + " select list, id, pattern, enabled from rules")
def rule_list_rows(spark, sf_dir):
    return _rules(spark, sf_dir).select("list", "id", "pattern", "enabled")


@register("rule_lists_written_and_read", _RULES + " select cast(k // 10 as varchar) as owner, list, id, pattern, enabled from rules")
def rule_lists_written_and_read(spark, sf_dir):
    path = work_path(spark, "rule-lists")
    owner = F.floor(F.substring("id", 2, 20).cast("bigint") / 10).cast("string")
    W.write_rule_lists(_rules(spark, sf_dir).withColumn("owner", owner), path)
    return W.read_rule_lists(spark, path).select("owner", "list", "id", "pattern", "enabled")


@register("validated_rules", _RULES + """ select list, id, trim(pattern) as pattern, coalesce(nullif(trim(label), ''), trim(pattern)) as label, enabled from rules
 where trim(pattern) <> '' and strlen(trim(pattern)) <= 500 and strlen(coalesce(nullif(trim(label), ''), trim(pattern))) <= 200""")
def validated_rules(spark, sf_dir):
    return W.validate_rules(_rules(spark, sf_dir)).select("list", "id", "pattern", "label", "enabled")


# ── policy ──────────────────────────────────────────────────────────────────

RULES = [policy.Rule(i, t, a) for i, (t, a) in enumerate((*policy.STARTER_RULES, ("the the", "warn"), ("card", "block")))]
_RULE_ROWS = "rules(i, rule_text, action) as (values " + ", ".join(f"({r.index}, {_q(r.text)}, {_q(r.action)})" for r in RULES) + ")"


@register("policy_rule_table", f"""with starter(rule_text, action) as (values {', '.join(f"({_q(t)}, {_q(a)})" for t, a in policy.STARTER_RULES)}),
own as (select distinct upper(p_brand) as rule_text, case when p_size > 25 then 'BLOCK' else 'other' end as action from part union all select 'API Key', 'Block'),
act as (select rule_text, case when lower(action) = 'block' then 'block' else 'warn' end as action, true as enabled from own)
select rule_text, action, enabled from act union all select rule_text, action, true from starter where lower(rule_text) not in (select lower(rule_text) from act)""")
def policy_rule_table(spark, sf_dir):
    own = table(spark, sf_dir, "part").select(
        F.upper("p_brand").alias("rule_text"), F.when(F.col("p_size") > 25, "BLOCK").otherwise("other").alias("action")).distinct()
    extra = spark.createDataFrame([("API Key", "Block")], "rule_text string, action string")
    rules = policy.enabled_rules(own.unionByName(extra).withColumn("enabled", F.lit(True)))
    return policy.add_missing_defaults(rules, policy.starter_rules(spark))


_LINT = """hits as (
 select d.doc_id, d.text, r.*, regexp_extract_all(d.text, '(?i)' || regexp_escape(r.rule_text)) as m, string_split_regex(d.text, '(?i)' || regexp_escape(r.rule_text)) as g
 from {docs} d join rules r on contains(lower(d.text), lower(r.rule_text))),
violations as (
 select doc_id, i as rule_index, rule_text, action, m[k] as token_text,
  cast(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) as int) as start
 from (select *, unnest(range(1, len(m) + 1)) as k from hits))"""


def _linted(spark, sf_dir):
    return policy.lint(docs_pii(spark, sf_dir), RULES, "text")


@register("policy_violations", "with " + ",\n".join([O.docs_pii_cte(), _RULE_ROWS, _LINT.format(docs="docs_pii")]) +
          " select doc_id, rule_index, rule_text, action, token_text, start, cast(start + length(token_text) as int) as \"end\", 1.0::double as score from violations")
def policy_violations(spark, sf_dir):
    return policy.violation_rows(_linted(spark, sf_dir), "doc_id")


# Every twentieth part gives the end of its name with the start of its type, the others a rule of their own.
_PART_RULES = """rules(i, rule_text, action) as (select min(p_partkey), t, case when min(p_partkey) % 3 = 0 then 'block' else 'warn' end from (
 select p_partkey, case when p_partkey % 20 = 0 then right(p_name, 2) || ' ' || substr(p_type, 1, 1 + cast(p_partkey // 20 % 2 as int)) else p_brand || ' ' || p_partkey end as t from part) group by t)"""


@register("lint_from_table", "with " + ",\n".join([O.docs_pii_cte(), _PART_RULES, _LINT.format(docs="docs_pii")]) +
          " select doc_id, rule_index, rule_text, action, token_text, start, cast(start + length(token_text) as int) as \"end\", 1.0::double as score from violations")
def lint_from_table(spark, sf_dir):
    text = F.expr("""if(p_partkey % 20 = 0, concat(right(p_name, 2), ' ', substring(p_type, 1, cast(1 + floor(p_partkey / 20) % 2 as int))),
        concat(p_brand, ' ', p_partkey))""")
    rules = table(spark, sf_dir, "part").groupBy(text.alias("rule_text")).agg(F.min("p_partkey").alias("rule_index"))
    rules = rules.withColumn("action", F.when(F.col("rule_index") % 3 == 0, "block").otherwise("warn"))
    return policy.lint_with_table(docs_pii(spark, sf_dir), rules, "doc_id", "text")


_REQUEST_LINT = _BODY_TOKENS + ",\n" + """user_sanitized as (
 select p.conv_id as doc_id, string_agg(t.sanitized, chr(10) order by p.turn, p.part) as text from (select distinct conv_id from conversations) c
 join parts p using (conv_id) join part_tokens t using (conv_id, turn, part) where p.role = 'user' and t.sanitized <> '' group by p.conv_id)"""
# Sanitized text of every part: its own pieces and tail.
_PART_TOKENS = """part_ranges as (
 select conv_id, turn, part, text, cast(sum(length(text) + 1) over (partition by conv_id order by turn, part) as bigint) - 1 - length(text) as lo from parts),
part_pieces as (
 select p.conv_id, p.turn, p.part, c.start, substr(p.text, cast(coalesce(lag(c."end") over w, p.lo) - p.lo as bigint) + 1, cast(c.start - coalesce(lag(c."end") over w, p.lo) as bigint)) || k.token as piece,
  c."end" - p.lo as done
 from part_ranges p join clipped c on c.doc_id = p.conv_id and c.start >= p.lo and c."end" <= p.lo + length(p.text)
 join token_map k on k.doc_id = p.conv_id and k.original = c.text window w as (partition by p.conv_id, p.turn, p.part order by c.start)),
part_tokens as (
 select p.conv_id, p.turn, p.part, coalesce(string_agg(x.piece, '' order by x.start), '') || substr(p.text, cast(coalesce(max(x.done), 0) as bigint) + 1) as sanitized
 from part_ranges p left join part_pieces x using (conv_id, turn, part) group by p.conv_id, p.turn, p.part, p.text)"""
_REQUEST_VIOLATIONS = ",\n".join([
    _BODY_TOKENS, _PART_TOKENS, _REQUEST_LINT[len(_BODY_TOKENS) + 2:], _RULE_ROWS, _LINT.format(docs="user_sanitized")])


def _enforced(spark, sf_dir):
    done = Z.sanitize_bodies(requests(spark, sf_dir))
    body = F.col("sanitized_body")
    texts = done.select("request_id", "session_id", "ts", B.extract_user_text(body, B.text_parts(body)).alias("user_text"))
    return policy.enforce(policy.lint(texts, RULES))


@register("policy_decisions", _REQUEST_VIOLATIONS + """
select c.conv_id as request_id, coalesce(bool_or(action = 'block'), false) as blocked, count(*) filter (action = 'warn') as warnings,
 arg_min(rule_text || ' (matched `' || token_text || '`)', rule_index * 100000 + start) filter (action = 'block') as reason
from (select distinct conv_id from conversations) c left join violations v on v.doc_id = c.conv_id group by c.conv_id""")
def policy_decisions(spark, sf_dir):
    return _enforced(spark, sf_dir).select(
        "request_id", "blocked", F.greatest(F.col("warnings"), F.lit(0)).cast("bigint").alias("warnings"), "reason")


_EVENTS = "with " + ",\n".join([O.docs_pii_cte(), _RULE_ROWS, _LINT.format(docs="docs_pii")])


def _policy_events(spark, sf_dir):
    linted = _linted(spark, sf_dir).withColumns({
        "session_id": F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit('s "'), F.col("doc_id").cast("string"), F.lit('"'))),
        "ts": F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)})
    return policy.policy_events(policy.violation_rows(linted, "doc_id", "session_id", "ts"))


@register("policy_events", _EVENTS + """ select strftime(timestamp '2024-01-01' + doc_id * interval 1 minute, '%Y-%m-%d %H:%M:%S') as timestamp, rule_text, token_text, start, action = 'block' as blocked from violations""")
def policy_events(spark, sf_dir):
    path = work_path(spark, "policy-events")
    A.write_policy_events(_policy_events(spark, sf_dir), path)
    return spark.read.parquet(path).select(ts_text("timestamp"), "rule_text", "token_text", "start", "blocked")


@register("policy_blocked_count", _EVENTS + " select count(*) filter (action = 'block') as blocked from violations")
def policy_blocked_count(spark, sf_dir):
    return policy.count_blocked(_policy_events(spark, sf_dir))


@register("recent_policy_events", _EVENTS + """, t as (select distinct timestamp '2024-01-01' + doc_id * interval 1 minute as ts from violations)
select strftime(timestamp '2024-01-01' + doc_id * interval 1 minute, '%Y-%m-%d %H:%M:%S') as timestamp from violations order by 1 desc limit 50""")
def recent_policy_events(spark, sf_dir):
    return A.recent_policy_events(_policy_events(spark, sf_dir), 50).select(ts_text("timestamp"))


@register("policy_events_csv", _EVENTS + """ select strftime(timestamp '2024-01-01' + doc_id * interval 1 minute, '%Y-%m-%dT%H:%M:%SZ') as timestamp,
 case when doc_id % 3 <> 0 then 's "' || doc_id || '"' else '' end as session_id, rule_text, action, token_text, cast(start as varchar) as start, cast(start + length(token_text) as varchar) as "end", '1.0' as score, cast(action = 'block' as varchar) as blocked from violations""")
def policy_events_csv(spark, sf_dir):
    path = work_path(spark, "policy-csv")
    A.export_policy_csv(_policy_events(spark, sf_dir), path)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return back.select("timestamp", F.coalesce("session_id", F.lit("")).alias("session_id"), "rule_text", "action", "token_text", "start", "end", "score", "blocked")


# ── routing ─────────────────────────────────────────────────────────────────

_PROVIDERS = "providers(position, provider, prefix) as (values " + ", ".join(
    f"({i}, {_q(name)}, {_q(m)})" for i, (_, name, _u, models) in enumerate(G.DEFAULT_PROVIDERS) for m in models) + ")"
# A later provider that also serves some models, for failover.
EXTRA_PROVIDERS = (*G.DEFAULT_PROVIDERS, ("mirror", "Mirror", "https://mirror.example.org/v1", ("gpt-4o", "claude-3", "gemini")))
_EXTRA = _PROVIDERS.replace("providers(", "all_providers(", 1)[:-1] + ", (2, 'Mirror', 'gpt-4o'), (2, 'Mirror', 'claude-3'), (2, 'Mirror', 'gemini'))"
_ROUTE = """route as (select model_id, arg_min(provider, position) as provider from (select distinct model_id from usage_raw) join {0} on starts_with(model_id, prefix) group by model_id)"""


@register("resolved_providers", "with " + ",\n".join([U.USAGE_RAW, _PROVIDERS, _ROUTE.format("providers")]) + """
select distinct event_id, provider, case when provider is null then 'No provider configured for model: ' || model_id end as route_error from usage_raw left join route using (model_id)""")
def resolved_providers(spark, sf_dir):
    events = usage_raw(spark, sf_dir).select("event_id", "model_id").distinct()
    return G.resolve_provider(events, G.provider_dim(spark)).select("event_id", "provider", "route_error")


@register("failover_providers", "with " + ",\n".join([U.USAGE_RAW, _EXTRA, _ROUTE.format("all_providers")]) + """,
fo as (select r.model_id, arg_min(p.provider, p.position) as failover from route r join all_providers p on starts_with(r.model_id, p.prefix) and p.provider <> r.provider group by r.model_id)
select distinct event_id, provider, failover from usage_raw left join route using (model_id) left join fo using (model_id)""")
def failover_providers(spark, sf_dir):
    dim = G.provider_dim(spark, EXTRA_PROVIDERS)
    events = usage_raw(spark, sf_dir).select("event_id", "model_id").distinct()
    routed = G.resolve_provider(events, dim).drop("route_error")
    return G.failover_provider(routed, dim).select("event_id", "provider", "failover")


@register("passthrough_providers", "with " + ",\n".join([U.USAGE_RAW, _PROVIDERS, _ROUTE.format("providers")]) + """
select distinct event_id, coalesce(provider, 'OpenAI') as provider from usage_raw left join route using (model_id)""")
def passthrough_providers(spark, sf_dir):
    events = usage_raw(spark, sf_dir).select("event_id", "model_id").distinct()
    return G.passthrough_provider(events, G.provider_dim(spark)).select("event_id", "provider")


@register("provider_dimension_use", "with " + ",\n".join([U.USAGE_RAW, _PROVIDERS]) + """,
n as (select model_id, count(*) as events from usage_raw group by model_id)
select provider, prefix as model_prefix, cast(coalesce(sum(events), 0) as bigint) as events from providers left join n on model_id = prefix group by all""")
def provider_dimension_use(spark, sf_dir):
    used = usage_raw(spark, sf_dir).groupBy(F.col("model_id").alias("model_prefix")).agg(F.count("*").alias("events"))
    dim = G.provider_dim(spark).select("provider", "model_prefix")
    return dim.join(used, "model_prefix", "left").withColumn("events", F.coalesce("events", F.lit(0).cast("bigint")))


# ── identity and sessions ───────────────────────────────────────────────────

_HEADERS = """h as (select event_id, case when event_id % 4 = 0 then 'sess-' || user_id when event_id % 4 = 1 then '' end as x,
 case when event_id % 3 <> 0 then 'Bearer ' || user_id end as a, case when event_id % 5 <> 0 then 'agent/1.0' end as ua,
 case when event_id % 7 = 0 then 'https://app.example.com' end as o, case when event_id % 2 = 0 then 'https://ref.example.com' end as r, '10.0.0.9' as xff from events)"""


@register("session_ids", "with " + _HEADERS + """ select event_id, coalesce(nullif(x, ''), substr(sha256(concat(
  coalesce('auth:' || a, ''), coalesce('ua:' || ua, ''), coalesce('origin:' || o, 'referer:' || r, ''), 'xff:' || xff)), 1, 24)) as session_id from h""")
def session_ids(spark, sf_dir):
    h = request_headers(spark, sf_dir)
    sid = N.session_id(F.col("x_session_id"), F.col("authorization"), F.col("user_agent"), F.col("origin"), F.col("referer"), F.col("x_forwarded_for"))
    return h.select("event_id", sid.alias("session_id"))


@register("client_ids", "with " + _HEADERS + " select event_id, substr(sha256(coalesce(a, 'anonymous')), 1, 16) as client_id from h")
def client_ids(spark, sf_dir):
    return request_headers(spark, sf_dir).select("event_id", N.client_id(F.col("authorization")).alias("client_id"))


def _session_requests(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select(
        n.alias("request_id"), F.concat(F.lit("s-"), F.col("user_id").cast("string")).alias("session_id"), "ts",
        F.floor("value").cast("bigint").alias("entities"),
        F.when(n % 3 == 0, "OpenAI").when(n % 3 == 1, "Anthropic").alias("provider"), F.when(n % 2 == 0, model_for(n)).alias("model"))


_SESSION_TABLE = f"""r as (select event_id, 's-' || user_id as session_id, ts, cast(floor(value) as bigint) as entities,
  case when event_id % 3 = 0 then 'OpenAI' when event_id % 3 = 1 then 'Anthropic' end as provider, case when event_id % 2 = 0 then {U.model_case('event_id')} end as model from events),
s as (select session_id, min(ts) as created_at, max(ts) as last_activity, count(*) as request_count, cast(sum(entities) as bigint) as entities_detected,
  arg_max(provider, epoch_us(ts)) filter (provider is not null) as provider, arg_max(model, epoch_us(ts)) filter (model is not null) as model from r group by session_id)"""


@register("session_table", "with " + _SESSION_TABLE + f" select session_id, {_STAMP.format('created_at', 'created_at')}, {_STAMP.format('last_activity', 'last_activity')}, request_count, entities_detected, provider, model from s")
def session_table(spark, sf_dir):
    s = N.sessions(_session_requests(spark, sf_dir))
    return s.select("session_id", ts_text("created_at"), ts_text("last_activity"), "request_count", "entities_detected", "provider", "model")


@register("expired_sessions", "with " + _SESSION_TABLE + f" select session_id from s where last_activity <= timestamp '2024-01-30 20:00:00' - interval 30 minute")
def expired_sessions(spark, sf_dir):
    return N.expired_sessions(N.sessions(_session_requests(spark, sf_dir)), "2024-01-30 20:00:00").select("session_id")


@register("mappings_of_live_sessions", "with " + _SESSION_TABLE + """ select o_orderkey, 's-' || (o_custkey % 150) as session_id from orders
 where 's-' || (o_custkey % 150) not in (select session_id from s where last_activity <= timestamp '2024-01-30 20:00:00' - interval 30 minute)""")
def mappings_of_live_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("s-"), (F.col("o_custkey") % 150).cast("string")).alias("session_id"))
    return N.surviving_mappings(rows, N.sessions(_session_requests(spark, sf_dir)), "2024-01-30 20:00:00").select("o_orderkey", "session_id")


@register("active_sessions", "with " + _SESSION_TABLE + f" select session_id, {_STAMP.format('last_activity', 'last_activity')} from s where last_activity > timestamp '2024-01-30 20:00:00' - interval 30 minute")
def active_sessions(spark, sf_dir):
    return N.active_sessions(N.sessions(_session_requests(spark, sf_dir)), "2024-01-30 20:00:00").select("session_id", ts_text("last_activity"))


@register("active_session_count", "with " + _SESSION_TABLE + " select count(*) filter (last_activity > timestamp '2024-01-30 20:00:00' - interval 30 minute) as active from s")
def active_session_count(spark, sf_dir):
    return N.active_count(N.sessions(_session_requests(spark, sf_dir)), "2024-01-30 20:00:00")


SESSIONIZE_SQL = """with g as (select user_id, ts, case when lag(ts) over (partition by user_id order by ts) + interval 30 minute > ts then 0 else 1 end as fresh from events),
n as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as session_last, count(*) as events from n group by user_id, k"""


@register("inactivity_sessions", SESSIONIZE_SQL)
def inactivity_sessions(spark, sf_dir):
    out = N.sessionize(table(spark, sf_dir, "events"), "user_id")
    return out.select("user_id", ts_text("session_start"), ts_text("session_last"), "events")


# ── audit ───────────────────────────────────────────────────────────────────


def _audit(spark, sf_dir):
    done = Z.assign_tokens(D.detect(docs_pii(spark, sf_dir)))
    n = F.col("doc_id")
    return A.audit_entries(done.select(
        n.alias("request_id"), F.timestamp_seconds(F.lit(1704067200) + n * 60).alias("ts"),
        F.concat(F.lit("s-"), (n % 50).cast("string")).alias("session_id"),
        F.when(n % 3 == 0, "OpenAI").otherwise("Anthropic").alias("provider"), model_for(n).alias("model"),
        "spans", "mappings", (n % 2 == 0).alias("streaming")))


_AUDIT = "with " + ",\n".join([O.docs_pii_cte(), O.found_cte(), O.resolved_cte(), O.token_ctes(), f"""
counts as (select doc_id, pii_type, count(*) as n from resolved group by all),
audit as (select cast(d.doc_id as varchar) as id, timestamp '2024-01-01' + d.doc_id * interval 1 minute as ts, 's-' || (d.doc_id % 50) as session_id,
  case when d.doc_id % 3 = 0 then 'OpenAI' else 'Anthropic' end as provider, {U.model_case('d.doc_id')} as model, d.doc_id % 2 = 0 as streaming,
  coalesce((select string_agg(pii_type || ':' || n, ';' order by pii_type) from counts c where c.doc_id = d.doc_id), '') as entity_types,
  cast(coalesce((select sum(n) from counts c where c.doc_id = d.doc_id), 0) as bigint) as total_entities,
  (select list_sort(list(token)) from token_map t where t.doc_id = d.doc_id) as tokens from docs_pii d)"""])


def _flat(entries):
    return entries.select(
        "id", ts_text("timestamp"), "session_id", "provider", "model", "streaming", "total_entities",
        F.array_join(F.transform("entity_types", lambda e: F.concat_ws(":", e["entity_type"], e["count"].cast("string"))), ";").alias("entity_types"),
        F.array_join(F.array_sort("tokens_generated"), ";").alias("tokens"))


_FLAT = f"select id, {_STAMP.format('ts', 'timestamp')}, session_id, provider, model, streaming, total_entities, entity_types, coalesce(array_to_string(tokens, ';'), '') as tokens from audit"


@register("audit_entries", _AUDIT + _FLAT)
def audit_entries(spark, sf_dir):
    return _flat(_audit(spark, sf_dir))


@register("audit_entries_stored_and_read", _AUDIT + _FLAT)
def audit_entries_stored_and_read(spark, sf_dir):
    path = work_path(spark, "audit")
    A.write_audit_entries(_audit(spark, sf_dir), path)
    return _flat(A.read_audit_entries(spark, path))


@register("audit_rows_decoded", """select event_id, case when event_id % 9 = 0 then '' else 'URL:' || (event_id % 5) || ';US_SSN:1' end as entity_types, case when event_id % 10 = 0 then '' else '[URL_1]' end as tokens from events""")
def audit_rows_decoded(spark, sf_dir):
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(n % 9 == 0, "not json").otherwise(F.concat(F.lit('[["URL",'), (n % 5).cast("string"), F.lit('],["US_SSN",1]]'))).alias("entity_types"),
        F.when(n % 10 == 0, "[broken").otherwise('["[URL_1]"]').alias("tokens_generated"))
    out = A.decode_audit_rows(rows)
    return out.select(
        "event_id", F.array_join(F.transform("entity_types", lambda e: F.concat_ws(":", e["entity_type"], e["count"].cast("string"))), ";").alias("entity_types"),
        F.array_join("tokens_generated", ";").alias("tokens"))


@register("audit_csv", _AUDIT + """select id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as timestamp, session_id, provider, model, cast(total_entities as varchar) as total_entities, cast(streaming as varchar) as streaming, entity_types, coalesce(array_to_string(tokens, ';'), '') as tokens from audit""")
def audit_csv(spark, sf_dir):
    path = work_path(spark, "audit-csv")
    A.export_audit_csv(_audit(spark, sf_dir), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    tokens = F.array_join(F.array_sort(F.split("tokens", ";")), ";")
    return back.withColumns({"entity_types": F.coalesce("entity_types", F.lit("")), "tokens": F.coalesce(tokens, F.lit(""))})


@register("audit_json", _AUDIT + _FLAT)
def audit_json(spark, sf_dir):
    path = work_path(spark, "audit-json")
    entries = _audit(spark, sf_dir)
    A.export_audit_json(entries, path)
    return _flat(spark.read.schema(entries.schema).json(path))


@register("audit_stats", _AUDIT + """select count(*) as total_requests, cast(coalesce(sum(total_entities), 0) as bigint) as total_entities,
 coalesce((select string_agg(pii_type || ':' || n, ';' order by pii_type) from (select pii_type, cast(sum(n) as bigint) as n from counts group by pii_type)), '') as entity_breakdown from audit""")
def audit_stats(spark, sf_dir):
    flat = F.transform("entity_breakdown", lambda e: F.concat_ws(":", e["entity_type"], e["count"].cast("string")))
    return A.audit_stats(_audit(spark, sf_dir)).withColumn("entity_breakdown", F.array_join(flat, ";"))


@register("audit_entity_totals", _AUDIT + "select pii_type as entity_type, cast(sum(n) as bigint) as n from counts group by pii_type")
def audit_entity_totals(spark, sf_dir):
    return A.entity_totals(_audit(spark, sf_dir))


@register("entity_breakdown", _AUDIT + """, t as (select pii_type as entity_type, cast(sum(n) as bigint) as n from counts group by pii_type)
select entity_type, n, round(100.0 * n / greatest(max(n) over (), 1), 6) as pct from t""")
def entity_breakdown(spark, sf_dir):
    out = A.entity_breakdown(_audit(spark, sf_dir))
    return out.withColumn("pct", F.round("pct", 6))


@register("recent_activity", _AUDIT + f"select id, {_STAMP.format('ts', 'timestamp')} from audit order by ts desc limit 6")
def recent_activity(spark, sf_dir):
    return A.recent_activity(_audit(spark, sf_dir)).select("id", ts_text("timestamp"))


def _summary(spark, sf_dir):
    events = usage(spark, sf_dir)
    tokens = R.global_stats(events, AS_OF).select(
        F.col("total_tokens_in").alias("tokens_in"), F.col("total_tokens_out").alias("tokens_out"),
        F.col("total_cost_cents").alias("cost_cents"), F.col("total_cost_unavailable").alias("cost_unavailable"))
    return N.gateway_summary({
        "audit": A.audit_stats(_audit(spark, sf_dir)).drop("entity_breakdown"),
        "sessions": N.active_count(N.sessions(_session_requests(spark, sf_dir)), "2024-01-30 20:00:00").withColumnRenamed("active", "active_sessions"),
        "providers": G.provider_dim(spark).agg(F.count_distinct("provider_id").alias("provider_count")),
        "tokens": tokens,
    })


_SUMMARY = (_AUDIT + ",\n" + U.USAGE_CTES + ",\n" + _SESSION_TABLE + """,
summary as (select (select count(*) from audit) as total_requests, (select cast(sum(total_entities) as bigint) from audit) as total_entities,
 (select count(*) filter (last_activity > timestamp '2024-01-30 20:00:00' - interval 30 minute) from s) as active_sessions, 2::bigint as provider_count,
 (select cast(sum(tokens_in_system + tokens_in_user + tokens_in_cached) as bigint) from u) as tokens_in, (select cast(sum(tokens_out) as bigint) from u) as tokens_out,
 (select cast(sum(cost_estimate_cents) as bigint) from u) as cost_cents, (select bool_or(cost_unavailable) from u) as cost_unavailable)""")


@register("gateway_summary", _SUMMARY + " select * from summary")
def gateway_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


@register("dashboard_cards", _SUMMARY + """ select 'Total Requests' as card, total_requests as value from summary union all select 'Entities Caught', total_entities from summary
 union all select 'Active Sessions', active_sessions from summary union all select 'Providers', provider_count from summary
 union all select 'Tokens In', tokens_in from summary where tokens_in > 0 or tokens_out > 0 union all select 'Tokens Out', tokens_out from summary where tokens_in > 0 or tokens_out > 0
 union all select 'Est. Cost', cost_cents from summary where (tokens_in > 0 or tokens_out > 0) and not cost_unavailable""")
def dashboard_cards(spark, sf_dir):
    return N.dashboard_cards(_summary(spark, sf_dir))


# ── keys ────────────────────────────────────────────────────────────────────

_KEYS = """k as (select event_id, ts as timestamp, 'k-' || (user_id % 40) as key_id, event_type as action,
 case when event_id % 101 = 0 then 'sk-demo-key' when event_id % 307 = 0 then repeat('é', 51) else 'rotated' end as detail from events)"""


@register("key_event_log", "with " + _KEYS + " select event_id, key_id, action from k")
def key_event_log(spark, sf_dir):
    return keys.key_log(key_events(spark, sf_dir)).select("event_id", "key_id", "action")


@register("key_events_of_one_key", "with " + _KEYS + " select event_id, action from k where key_id = 'k-7'")
def key_events_of_one_key(spark, sf_dir):
    return keys.events_for_key(key_events(spark, sf_dir), "k-7").select("event_id", "action")


@register("key_safety_audit", "with " + _KEYS + """ select key_id, count(*) as suspicious_events, 'Potential key leak in audit log for key ''' || key_id || ''': detail too long or contains key prefix' as finding
 from k where starts_with(detail, 'sk-') or strlen(detail) > 100 group by key_id""")
def key_safety_audit(spark, sf_dir):
    return keys.key_safety_audit(key_events(spark, sf_dir))


# ── clipboard ───────────────────────────────────────────────────────────────

_CLIP = O.sentences_cte() + f""",
clip as (select event_id, user_id as client, ts, case when event_id % 11 = 0 then 'same card 4111 1111 1111 1111 é'
  when (event_id // 2) % 3 = 0 then 'plain words ' || (event_id // 2) else sentence end as text from events join sentences on (event_id // 2) % {len(SENTENCES)} = n),
changed as (select * from (select *, lag(text) over (partition by client order by ts, event_id) as before from clip) where text is distinct from before)"""
_CLIP_SCAN = "with " + ",\n".join([_CLIP, "changed_docs as (select event_id, text from changed)", O.found_cte("changed_docs", "event_id"), O.resolved_cte(key="event_id"), """
pending as (select c.event_id, client, ts, strlen(c.text) as content_length, (select string_agg(t || ':' || n, ';' order by t) from (select pii_type as t, count(*) as n from resolved r where r.event_id = c.event_id group by pii_type)) as entities
 from changed c where exists (select 1 from resolved r where r.event_id = c.event_id))"""])


@register("clipboard_scans", _CLIP_SCAN + " select event_id, client, content_length, entities, 'pending' as action from pending")
def clipboard_scans(spark, sf_dir):
    out = C.clipboard_scan(clipboard_log(spark, sf_dir))
    entities = F.array_join(F.transform("detected_entities", lambda e: F.concat_ws(":", e["entity_type"], e["count"].cast("string"))), ";")
    return out.select("event_id", "client", F.col("content_length").cast("bigint").alias("content_length"), entities.alias("entities"), "action")


def _answers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("user_id").alias("client"), (F.col("ts") + F.expr("interval 20 minutes")).alias("ts"),
        F.when(kind == "click", "sanitize").when(kind == "view", "allow").when(kind == "error", "block").otherwise("later").alias("response"))


_ANSWERS = """answers as (select user_id as client, ts + interval 20 minute as ts, case event_type when 'click' then 'sanitize' when 'view' then 'allow' when 'error' then 'block' else 'later' end as response from events)"""


@register("clipboard_answers", _CLIP_SCAN + ", " + _ANSWERS + """,
b as (select client, ts, 0 as kind, event_id, null as response from pending union all select client, ts, 1, null, response from answers where response <> 'later'),
l as (select *, lag(kind) over w as k, lag(event_id) over w as p from b window w as (partition by client order by ts, kind))
select client, p as event_id, case response when 'sanitize' then 'Sanitized' when 'allow' then 'Allowed' else 'Blocked' end as action from l where kind = 1 and k = 0""")
def clipboard_answers(spark, sf_dir):
    pending = C.clipboard_scan(clipboard_log(spark, sf_dir))
    return C.clipboard_respond(pending, _answers(spark, sf_dir)).select("client", "event_id", "action")


@register("clipboard_invalid_answers", "with " + _ANSWERS + " select client, 'Invalid response. Use: sanitize, allow, or block' as error from answers where response = 'later'")
def clipboard_invalid_answers(spark, sf_dir):
    return C.invalid_responses(_answers(spark, sf_dir)).select("client", "error")


@register("clipboard_sanitized", "with " + ",\n".join([_CLIP, O.found_cte("clip", "event_id"), O.resolved_cte(key="event_id"), O.token_ctes(docs="clip", key="event_id")]) + " select event_id, sanitized from sanitized")
def clipboard_sanitized(spark, sf_dir):
    return C.clipboard_sanitize(clipboard_log(spark, sf_dir)).select("event_id", "sanitized")


# ── latency and limits ──────────────────────────────────────────────────────

_STAGES = {"auth_ms": "value * 0.125", "pii_detect_ms": "value * 2", "pseudonymize_ms": "value * 0.5", "upstream_ms": "value * 16", "rehydrate_ms": "value * 0.25", "total_ms": "value * 18.875"}


@register("latency_stats", f"""with n as (select {', '.join(f'{e} as {k}' for k, e in _STAGES.items())} from events),
a as (select count(*) as sample_count, {', '.join(f'avg({k}) as avg_{k}' for k in _STAGES)}, min(total_ms) as min_total_ms, max(total_ms) as max_total_ms, list_sort(list(total_ms)) as t from n)
select sample_count, {', '.join(f'round(avg_{k}, 6) as avg_{k}' for k in _STAGES)}, round(min_total_ms, 6) as min_total_ms, round(max_total_ms, 6) as max_total_ms,
 round(t[cast(ceil(0.95 * (sample_count - 1)) as int) + 1], 6) as p95_total_ms, round(t[cast(ceil(0.99 * (sample_count - 1)) as int) + 1], 6) as p99_total_ms, avg_total_ms < 500 as within_budget from a""")
def latency_stats(spark, sf_dir):
    out = latency.latency_stats(latencies(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("_ms")})


_LOG = """log as (select event_id, 'c-' || (user_id % 20) as client_id, 1704067200000000 + (epoch_us(ts) - 1704067200000000) // 60 as us,
 1704067200000000 + (epoch_us(ts) - 1704067200000000) // 60 + cast(floor(value * 1000000) as bigint) as end_us from events)"""


@register("rate_limit_usage", "with " + _LOG + """ select event_id, client_id,
 count(*) over (partition by client_id order by us range between 59999999 preceding and current row) as last_minute,
 count(*) over (partition by client_id order by us range between 3599999999 preceding and current row) as last_hour from log""")
def rate_limit_usage(spark, sf_dir):
    return L.rate_limit_usage(request_log(spark, sf_dir)).select("event_id", "client_id", "last_minute", "last_hour")


def _walk_sql(key: str, log: str, per_minute: int, per_hour: int) -> str:
    return f"""with recursive {log}, o as (select *, row_number() over (partition by {key} order by us, event_id) as rn from log),
walk as (
 select {key}, event_id, rn, 'Allowed' as decision, [us] as acc from o where rn = 1
 union all
 select o.{key}, o.event_id, o.rn,
  case when len(list_filter(w.acc, lambda t: t > o.us - 60000000)) >= {per_minute} then 'DeniedMinuteLimit'
   when len(list_filter(w.acc, lambda t: t > o.us - 3600000000)) >= {per_hour} then 'DeniedHourLimit' else 'Allowed' end,
  case when len(list_filter(w.acc, lambda t: t > o.us - 60000000)) >= {per_minute} or len(list_filter(w.acc, lambda t: t > o.us - 3600000000)) >= {per_hour}
   then list_filter(w.acc, lambda t: t > o.us - 3600000000) else list_append(list_filter(w.acc, lambda t: t > o.us - 3600000000), o.us) end
 from walk w join o on o.{key} = w.{key} and o.rn = w.rn + 1)
select event_id, {key}, decision from walk"""


@register("rate_limit_decisions", _walk_sql("client_id", _LOG, 2, 38))
def rate_limit_decisions(spark, sf_dir):
    return L.rate_limit_decisions(request_log(spark, sf_dir), L.Limits(2, 38)).select("event_id", "client_id", "decision")


@register("command_limit_decisions", _walk_sql("command", _LOG.replace("'c-' || (user_id % 20) as client_id", "event_type as command"), 4, 160))
def command_limit_decisions(spark, sf_dir):
    log = request_log(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("command")), "event_id")
    return L.command_limits(log, L.Limits(4, 160)).select("event_id", "command", "decision")


@register("concurrency_decisions", "with " + _LOG + """, p as (
 select event_id, us, 1 as delta, 1 as kind from log union all select event_id, end_us, -1, 0 from log),
a as (select event_id, kind, coalesce(sum(delta) over (order by us, kind, event_id rows between unbounded preceding and 1 preceding), 0) as active from p)
select event_id, cast(active as bigint) as active, case when active >= 6 then 'DeniedConcurrentLimit' else 'Allowed' end as decision from a where kind = 1""")
def concurrency_decisions(spark, sf_dir):
    return L.concurrency_decisions(request_log(spark, sf_dir), limit=6)


# ── hooks ───────────────────────────────────────────────────────────────────


def _capitalized(texts):
    """A stand-in finder: the first capitalized word of every text is a person."""
    import re

    found = []
    for t in texts:
        m = re.search(r"\b[A-Z][a-z]+", t, re.ASCII)
        found.append([("PER", m.start(), m.end(), 0.9)] if m else [])
    return found


@register("model_hook_spans", "with " + ",\n".join([O.docs_pii_cte(), O.found_cte(), """
fed as (select doc_id, regexp_extract(text, '\\b[A-Z][a-z]+') as w, string_split_regex(text, '\\b[A-Z][a-z]+')[1] as g from docs_pii),
every as (select doc_id, start, "end", rank, spec, pii_type, text, confidence from found
 union all select doc_id, length(g), length(g) + length(w), 100000, 1, 'PERSON', w, 0.9 from fed where w <> '')""", O.resolved_cte("every")]) +
          " select doc_id, pii_type, text, cast(start as int) as start from resolved")
def model_hook_spans(spark, sf_dir):
    fed = hooks.model_spans(docs_pii(spark, sf_dir), _capitalized)
    return D.explode_spans(D.detect(fed, feeds=["feed"]), "doc_id").select("doc_id", "pii_type", "text", "start")


def _word_share(texts, rule):
    """A stand-in scorer: share of the rule's words that a text contains."""
    words = rule.lower().split()
    return texts.str.lower().map(lambda t: sum(w in t for w in words) / len(words))


@register("model_hook_scores", "with " + ",\n".join([O.docs_pii_cte(), _RULE_ROWS]) + """,
w as (select doc_id, i, rule_text, action, list_transform(string_split(lower(rule_text), ' '), lambda x: contains(lower(text), x)::int) as hits from docs_pii, rules)
select doc_id, i as rule_index, rule_text, action, round(list_sum(hits) / len(hits), 6) as score from w where list_sum(hits) / len(hits) > 0.5""")
def model_hook_scores(spark, sf_dir):
    scored = hooks.model_scores(docs_pii(spark, sf_dir), _word_share, RULES, "text")
    rows = policy.violation_rows(scored, "doc_id")
    return rows.select("doc_id", "rule_index", "rule_text", "action", F.round("score", 6).alias("score"))


__all__ = ["SESSIONIZE_SQL", "_CHATS"]
