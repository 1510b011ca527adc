"""Registered queries: usage-event store, cost, statistics at all grains, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.functions import pricing as P
from veilframe.operators import alerts as A
from veilframe.operators import rollups as R
from veilframe.operators import usage as U
from veilframe.plans import oracle_usage as O
from veilframe.plans.fixtures import AS_OF, usage, usage_raw
from veilframe.plans.registry import register
from veilframe.sources import usage_store as S

RAW = "with " + O.USAGE_RAW
ALL = "with " + O.USAGE_CTES
_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') as {1}"


def ts_text(col: str, name: str | None = None):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(name or col)


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


# ── store ───────────────────────────────────────────────────────────────────


@register("usage_events_upgraded", RAW + """
select event_id, schema_version, tokens_in_user, actual_cost_cents, tokens_in_cache_write from (
 select event_id, schema_version, tokens_in_user, actual_cost_cents, tokens_in_cache_write from usage_raw where schema_version > 2
 union all
 select event_id, schema_version, tokens_in_user, null, 0 from usage_raw where schema_version = 2)""")
def usage_events_upgraded(spark, sf_dir):
    raw = usage_raw(spark, sf_dir)
    old = raw.where("schema_version = 2").drop("actual_cost_cents", "tokens_in_cache_write")
    new = raw.where("schema_version > 2")
    both = S.upgrade_events(old).unionByName(S.upgrade_events(new))
    return both.select("event_id", "schema_version", "tokens_in_user", "actual_cost_cents", "tokens_in_cache_write")


@register("schema_version_guard", RAW + " select event_id, schema_version from usage_raw where schema_version <= 2")
def schema_version_guard(spark, sf_dir):
    return S.guard_schema_version(usage_raw(spark, sf_dir)).select("event_id", "schema_version")


@register("dedup_events", RAW + " select event_id, count(*) - count(*) + 1 as kept, min(tokens_in_user) as tokens_in_user from usage_raw group by event_id")
def dedup_events(spark, sf_dir):
    kept = S.dedup_events(usage_raw(spark, sf_dir))
    return kept.select("event_id", F.lit(1).cast("bigint").alias("kept"), "tokens_in_user")


@register("retention_kept", RAW + f" select event_id from usage_raw where event_ts >= timestamp '{AS_OF}' - interval 10 day")
def retention_kept(spark, sf_dir):
    return S.purge_older_than(usage_raw(spark, sf_dir), AS_OF, 10).select("event_id")


@register("retention_purged_count", RAW + f" select count(*) as purged from usage_raw where event_ts < timestamp '{AS_OF}' - interval 10 day")
def retention_purged_count(spark, sf_dir):
    return S.purged_count(usage_raw(spark, sf_dir), AS_OF, 10)


@register("recent_events", ALL + " select event_id, tenant_id from u order by event_ts desc, event_id desc limit 25")
def recent_events(spark, sf_dir):
    return S.recent(usage(spark, sf_dir), 25).select("event_id", "tenant_id")


@register("recent_events_for_tenant", ALL + " select event_id, tenant_id from u where tenant_id = 'acme' order by event_ts desc, event_id desc limit 25")
def recent_events_for_tenant(spark, sf_dir):
    return S.recent(usage(spark, sf_dir), 25, "acme").select("event_id", "tenant_id")


@register("events_exported_as_json", ALL + f" select event_id, model_id, tokens_out from u where tenant_id = 'acme'")
def events_exported_as_json(spark, sf_dir):
    from veilframe.session import work_path

    path = work_path(spark, "events-json")
    S.export_events(usage(spark, sf_dir), path, "acme")
    return spark.read.schema(S.USAGE_SCHEMA).json(path).select("event_id", "model_id", "tokens_out")


@register("events_stored_and_read", ALL + " select event_id, tokens_out, cast(date as varchar) as day from u")
def events_stored_and_read(spark, sf_dir):
    from veilframe.session import work_path

    path = work_path(spark, "usage-events")
    S.write_usage_events(usage(spark, sf_dir), path)
    back = S.read_usage_events(spark, path)
    return back.select("event_id", "tokens_out", F.to_date("event_ts").cast("string").alias("day"))


@register("tenant_deleted", RAW + " select event_id, tenant_id from usage_raw where tenant_id <> 'globex'")
def tenant_deleted(spark, sf_dir):
    return S.delete_tenant(usage_raw(spark, sf_dir), "globex").select("event_id", "tenant_id")


@register("tenant_deleted_count", RAW + " select count(*) as deleted from usage_raw where tenant_id = 'globex'")
def tenant_deleted_count(spark, sf_dir):
    return S.tenant_count(usage_raw(spark, sf_dir), "globex")


@register("event_count", ALL + " select count(*) as n from u")
def event_count(spark, sf_dir):
    return S.count_rows(usage(spark, sf_dir))


# ── cost ────────────────────────────────────────────────────────────────────


@register("price_table", "with " + O.PRICES_CTE + f""",
counts as (select m, count(*) as events from (select {O.model_case('event_id')} as m from events) group by m)
select model, cast(input_cents as bigint) as input_cents, cast(cached_cents as bigint) as cached_cents,
 cast(cache_write_cents as bigint) as cache_write_cents, cast(output_cents as bigint) as output_cents,
 cast(system_tokens as bigint) as system_tokens, '{P.PRICING_AS_OF}' as pricing_as_of, coalesce(events, 0) as events
from prices left join counts on m = model""")
def price_table(spark, sf_dir):
    used = usage_raw(spark, sf_dir).groupBy("model_id").agg(F.count_distinct("event_id").alias("events"))
    table = P.price_table(spark)
    joined = table.join(used, table.model == used.model_id, "left").drop("model_id")
    return joined.withColumn("events", F.coalesce("events", F.lit(0).cast("bigint")))


@register("event_cost_cents", "with " + ",\n".join([O.USAGE_RAW, O.PRICES_CTE, O.priced_models_cte(), O.priced_cte()]) +
          " select distinct event_id, cost_estimate_cents, pricing_as_of, cost_unavailable from priced")
def event_cost_cents(spark, sf_dir):
    return U.with_cost(S.dedup_events(usage_raw(spark, sf_dir))).select(
        "event_id", "cost_estimate_cents", "pricing_as_of", "cost_unavailable")


@register("event_cost_cents_with_cache_write", "with " + ",\n".join([O.USAGE_RAW, O.PRICES_CTE, O.priced_models_cte(), O.priced_cte(True)]) +
          " select distinct event_id, cost_estimate_cents, cost_unavailable from priced")
def event_cost_cents_with_cache_write(spark, sf_dir):
    return U.with_cost(S.dedup_events(usage_raw(spark, sf_dir)), cache_write=True).select(
        "event_id", "cost_estimate_cents", "cost_unavailable")


# USD per token of a dynamic price file: exact, family and shorter-family entries, an empty one.
DYNAMIC_PRICES = (
    '{"gpt-4": {"input_cost_per_token": 0.00003, "output_cost_per_token": 0.00006},'
    ' "gpt-4o-mini": {"input_cost_per_token": 0.00000015, "cache_read_input_token_cost": 0.000000075},'
    ' "claude-3": {"output_cost_per_token": 0.00002, "cache_creation_input_token_cost": 0.00000375},'
    ' "local-llama": {"max_tokens": 8192}, "sample_spec": "text"}'
)
_DYNAMIC_CTE = f"""file as (select '{DYNAMIC_PRICES}'::json as body),
rates as (
 select k as model, try_cast(((body->k)->>'input_cost_per_token') as double) as i, try_cast((body->k)->>'output_cost_per_token' as double) as o,
  try_cast((body->k)->>'cache_read_input_token_cost' as double) as cr, try_cast((body->k)->>'cache_creation_input_token_cost' as double) as cw
 from (select body, unnest(json_keys(body)) as k from file)
 where json_type(body->k) = 'OBJECT' and (((body->k)->>'input_cost_per_token') is not null or ((body->k)->>'output_cost_per_token') is not null)),
rated as (select m.model_id, arg_max(r, length(r.model)) as r from (select distinct model_id from usage_raw) m
 join rates r on starts_with(m.model_id, r.model) group by m.model_id)"""


def _dynamic_rates(spark, sf_dir):
    from veilframe.sources.price_files import read_pricing_json

    return read_pricing_json(spark.createDataFrame([(DYNAMIC_PRICES,)], "body string"))


@register("price_file_rows", """select 'm-' || p_partkey as model, case when p_partkey % 4 <> 0 then round(p_size / 1000000.0, 9)::double end as input_cost_per_token,
 case when p_partkey % 6 <> 0 then round(p_size / 250000.0, 9)::double end as output_cost_per_token from part where p_partkey % 4 <> 0 or p_partkey % 6 <> 0""")
def price_file_rows(spark, sf_dir):
    """Price files of one entry per part, ten entries per file."""
    from veilframe.session import table
    from veilframe.sources.price_files import read_pricing_json

    k, size = F.col("p_partkey"), F.col("p_size")
    price = lambda name, value, cond: F.when(cond, F.concat(F.lit(f'"{name}":'), value.cast("string"), F.lit(",")) ).otherwise("")
    entry = F.concat(
        F.lit('"m-'), k.cast("string"), F.lit('":{'), price("input_cost_per_token", size / 1000000.0, k % 4 != 0),
        price("output_cost_per_token", size / 250000.0, k % 6 != 0), F.lit('"mode":"chat"}'))
    files = table(spark, sf_dir, "part").groupBy(F.floor(k / 10).alias("f")).agg(F.array_join(F.collect_list(entry), ",").alias("b"))
    rows = read_pricing_json(files.select(F.concat(F.lit("{"), F.col("b"), F.lit("}")).alias("body")))
    return rows.select("model", *[F.round(c, 9).alias(c) for c in ("input_cost_per_token", "output_cost_per_token")])


@register("event_cost_dynamic", "with " + ",\n".join([O.USAGE_RAW, O.PRICES_CTE, O.priced_models_cte(), O.priced_cte(True), _DYNAMIC_CTE]) + f"""
select distinct event_id,
 case when t.r is null then cost_estimate_cents else cast(round(100 * (
   (tokens_in_system + tokens_in_user) * coalesce(t.r.i, {P.FALLBACK_INPUT_USD}) + tokens_in_cached * coalesce(t.r.cr, 0)
   + tokens_in_cache_write * coalesce(t.r.cw, 0) + tokens_out * coalesce(t.r.o, {P.FALLBACK_OUTPUT_USD}))) as bigint) end as cost_estimate_cents,
 case when t.r is null then pricing_as_of else 'litellm:2025-03-01' end as pricing_as_of,
 (t.r is null and cost_unavailable) as cost_unavailable
from priced left join rated t using (model_id)""")
def event_cost_dynamic(spark, sf_dir):
    events = S.dedup_events(usage_raw(spark, sf_dir))
    return U.with_dynamic_cost(events, _dynamic_rates(spark, sf_dir), "2025-03-01").select(
        "event_id", "cost_estimate_cents", "pricing_as_of", "cost_unavailable")


@register("pricing_coverage", "with " + ",\n".join([O.USAGE_RAW, O.PRICES_CTE, O.priced_models_cte()]) + """
select model_id, price is not null as has_pricing, cast(coalesce(price.system_tokens, 0) as bigint) as system_tokens
from (select distinct model_id from usage_raw) left join priced_models using (model_id)""")
def pricing_coverage(spark, sf_dir):
    return U.pricing_coverage(usage_raw(spark, sf_dir))


@register("error_events", RAW + """
select distinct event_id, session_id, model_id, 0 as tokens_in_user, 'unavailable' as token_count_source, '' as pricing_as_of,
 true as cost_unavailable, false as success from usage_raw where not success""")
def error_events(spark, sf_dir):
    failed = S.dedup_events(usage_raw(spark, sf_dir)).where(~F.col("success"))
    events = U.error_events(failed.select("event_id", "event_ts", "session_id", "model_id", "tool_name", "duration_ms"))
    return events.select("event_id", "session_id", "model_id", F.col("tokens_in_user").cast("int").alias("tokens_in_user"),
                         "token_count_source", "pricing_as_of", "cost_unavailable", "success")


@register("built_events", ALL + """
select event_id, 2 as schema_version, 'default' as tenant_id, cost_estimate_cents, cost_unavailable, success from u""")
def built_events(spark, sf_dir):
    counts = usage(spark, sf_dir).select(
        "event_id", "event_ts", "session_id", "tool_name", "model_id", "tokens_in_system", "tokens_in_user",
        "tokens_in_cached", "tokens_out", "token_count_source", "duration_ms", "success")
    return U.build_events(counts).select(
        "event_id", "schema_version", "tenant_id", "cost_estimate_cents", "cost_unavailable", "success")


# ── statistics ──────────────────────────────────────────────────────────────


@register("minute_timestamps", RAW + f" select distinct event_id, {_TS.format('date_trunc($$minute$$, event_ts)', 'minute_ts')} from usage_raw".replace("$$", "'"))
def minute_timestamps(spark, sf_dir):
    rows = R.minute_truncate(S.dedup_events(usage_raw(spark, sf_dir)))
    return rows.select("event_id", ts_text("event_ts", "minute_ts"))


_RATES = """case when call_count > 0 then success_count / call_count else 1.0 end as success_rate,
 case when call_count > 0 then retry_count / call_count else 0.0 end as retry_rate,
 case when call_count > 0 then partial_count / call_count else 0.0 end as partial_rate,
 case when call_count > 0 then truncation_count / call_count else 0.0 end as truncation_rate"""

_TOTALS = f"""totals as (select {O.aggs()}, count(distinct session_id) as total_sessions, count(distinct date) as active_days from u),
active as (select count(*) filter (last_event > {O.CUTOFF}) as active_sessions from (select session_id, max(event_ts) as last_event from u group by session_id)),
rates as (select *, {_RATES}, tokens_in_system + tokens_in_user + tokens_in_cached as total_in,
  100.0 * tokens_in_system / (tokens_in_system + tokens_in_user + tokens_in_cached) as system_pct,
  100.0 * tokens_in_cached / (tokens_in_system + tokens_in_user + tokens_in_cached) as saved_pct from totals, active)"""

_TIP1 = "case when truncation_rate > 0.05 then format('You hit context limits on {:.0f}% of calls. Consider breaking your task into smaller steps.', truncation_rate * 100) end"
_TIP2 = "case when system_pct > 30 then format('{:.0f}% of input tokens are system prompt. Consider optimizing your system prompt.', system_pct) end"
_TIP3 = "case when tokens_in_cached > 0 and call_count > 0 then format('{:.0f}% of input tokens were served from cache, saving cost.', saved_pct) end"
_SAVED = "format('Token caching saved {:.1f}% of input tokens. Good efficiency!', saved_pct)"


@register("global_stats", ALL + "," + _TOTALS + f"""
select total_in as total_tokens_in, tokens_out as total_tokens_out, tokens_in_cached as total_tokens_cached,
 tokens_truncated as total_tokens_truncated, tokens_in_cache_write as total_tokens_in_cache_write,
 actual_cost_cents as total_actual_cost_cents, cost_estimate_cents as total_cost_cents, unpriced_count > 0 as total_cost_unavailable,
 call_count as total_calls, total_sessions, active_sessions,
 (select round(avg(duration_ms), 6) from u) as avg_duration_ms,
 round(success_rate, 6) as success_rate, round(truncation_rate, 6) as truncation_rate,
 format('${{:.2f}}', cost_estimate_cents / 100) as cost_estimate_usd, 'full_file_read' as baseline_method,
 coalesce(nullif(concat_ws(' ', {_TIP1}, {_TIP2}), ''), case when saved_pct > 0 then {_SAVED} else 'Token usage is within normal parameters.' end) as suggestion
from rates""")
def global_stats(spark, sf_dir):
    return rounded(R.global_stats(usage(spark, sf_dir), AS_OF), "avg_duration_ms", "success_rate", "truncation_rate")


_SESSION_COLS = (
    "session_id", "tenant_id", "status", "duration_seconds", *R.SUMS, "call_count", "success_count", "retry_count",
    "partial_count", "truncation_count", "cost_unavailable", "tokens_saved_vs_full_file_read",
)
_SESSIONS = f"""sessions as (
 select session_id, tenant_id, 'active' as status, cast(epoch(max(event_ts)) - epoch(min(event_ts)) as bigint) as duration_seconds,
  {O.aggs()}, sum(cost_estimate_cents) = 0 as cost_unavailable, cast(sum(tokens_in_cached) as bigint) as tokens_saved_vs_full_file_read,
  min(event_ts) as first_event, max(event_ts) as last_event
 from u group by session_id, tenant_id)"""
_SESSIONS_FULL = _SESSIONS + "," + O.duration_cte("session_id, tenant_id")


@register("session_stats", ALL + "," + _SESSIONS_FULL + f"""
select {', '.join(_SESSION_COLS)}, {_TS.format('first_event', 'first_event')}, {_TS.format('last_event', 'last_event')},
 {O.rounded('avg_duration_ms', 'p50_duration_ms', 'p99_duration_ms')}
from sessions join durations using (session_id, tenant_id)""")
def session_stats(spark, sf_dir):
    out = rounded(R.session_stats(usage(spark, sf_dir)), "avg_duration_ms", "p50_duration_ms", "p99_duration_ms")
    return out.select(*_SESSION_COLS, ts_text("first_event"), ts_text("last_event"),
                      "avg_duration_ms", "p50_duration_ms", "p99_duration_ms")


@register("session_stats_or_default", ALL + "," + _SESSIONS + """
select w.session_id, coalesce(tenant_id, 'default') as tenant_id, coalesce(call_count, 0) as call_count,
 coalesce(cost_estimate_cents, 0) as cost_estimate_cents, actual_cost_cents, coalesce(cost_unavailable, true) as cost_unavailable
from (select distinct 's-' || cast(c_custkey as varchar) || '-2024-01-15' as session_id from customer) w left join sessions using (session_id)""")
def session_stats_or_default(spark, sf_dir):
    from veilframe.session import table

    wanted = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("s-"), F.col("c_custkey").cast("string"), F.lit("-2024-01-15")).alias("session_id"))
    out = R.session_stats_or_default(R.session_stats(usage(spark, sf_dir)), wanted)
    return out.select("session_id", "tenant_id", "call_count", "cost_estimate_cents", "actual_cost_cents", "cost_unavailable")


@register("session_stats_per_tenant", ALL + "," + _SESSIONS + """
select w.session_id, w.tenant_id, coalesce(call_count, 0) as call_count, coalesce(cost_estimate_cents, 0) as cost_estimate_cents
from (select distinct 's-' || cast(c_custkey as varchar) || '-2024-01-15' as session_id, unnest(['default', 'acme', 'globex']) as tenant_id from customer) w
left join sessions using (session_id, tenant_id)""")
def session_stats_per_tenant(spark, sf_dir):
    from veilframe.session import table

    wanted = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("s-"), F.col("c_custkey").cast("string"), F.lit("-2024-01-15")).alias("session_id"),
        F.explode(F.array(*[F.lit(t) for t in ("default", "acme", "globex")])).alias("tenant_id"))
    out = R.session_stats_or_default(R.session_stats(usage(spark, sf_dir)), wanted)
    return out.select("session_id", "tenant_id", "call_count", "cost_estimate_cents")


@register("tool_stats", ALL + f""", t as (select tool_name as tool, {O.aggs()} from u group by tool_name),
{O.duration_cte('tool_name')}
select tool, {', '.join(R.SUMS)}, call_count, {', '.join(f'round({r}, 6) as {r}' for r in ('success_rate', 'retry_rate', 'partial_rate'))},
 round(100.0 * tokens_out / sum(tokens_out) over (), 6) as pct_of_total, {O.rounded('avg_duration_ms', 'p50_duration_ms', 'p99_duration_ms')}
from (select *, {_RATES} from t) join durations on tool_name = tool""")
def tool_stats(spark, sf_dir):
    return rounded(R.tool_stats(usage(spark, sf_dir)), "success_rate", "retry_rate", "partial_rate", "pct_of_total",
                   "avg_duration_ms", "p50_duration_ms", "p99_duration_ms")


_MODEL_SUMS = [c for c in R.SUMS if c != "tokens_truncated"]


@register("model_stats", ALL + f""", t as (select model_id, {O.aggs()} from u group by model_id), {O.duration_cte('model_id')}
select model_id, {', '.join(_MODEL_SUMS)}, call_count, unpriced_count > 0 as cost_unavailable, '{P.PRICING_AS_OF}' as pricing_as_of,
 {O.rounded('avg_duration_ms', 'p50_duration_ms', 'p99_duration_ms')} from t join durations using (model_id)""")
def model_stats(spark, sf_dir):
    return rounded(R.model_stats(usage(spark, sf_dir)), "avg_duration_ms", "p50_duration_ms", "p99_duration_ms")


@register("daily_trends", ALL + f""", t as (select date, {O.aggs()} from u group by date), {O.duration_cte('date')}
select cast(date as varchar) as date, {', '.join(R.SUMS)}, call_count, success_count, retry_count, partial_count,
 round(truncation_rate, 6) as truncation_rate, round(avg_duration_ms, 6) as avg_duration_ms
from (select *, {_RATES} from t) join durations using (date)""")
def daily_trends(spark, sf_dir):
    out = rounded(R.daily_trends(usage(spark, sf_dir)), "truncation_rate", "avg_duration_ms")
    return out.withColumn("date", F.col("date").cast("string"))


_TOKENS_IN = "tokens_in_system + tokens_in_user + tokens_in_cached as tokens_in"


@register("tool_trends", ALL + f""", t as (select date, tool_name, {O.aggs()} from u group by date, tool_name), {O.duration_cte('date, tool_name')}
select cast(date as varchar) as date, tool_name as tool, {_TOKENS_IN}, tokens_out, cost_estimate_cents, call_count,
 round(success_rate, 6) as success_rate, round(avg_duration_ms, 6) as avg_duration_ms
from (select *, {_RATES} from t) join durations using (date, tool_name)""")
def tool_trends(spark, sf_dir):
    out = rounded(R.tool_trends(usage(spark, sf_dir)), "success_rate", "avg_duration_ms")
    return out.withColumn("date", F.col("date").cast("string"))


@register("model_trends", ALL + f""", t as (select date, model_id, {O.aggs()} from u group by date, model_id), {O.duration_cte('date, model_id')}
select cast(date as varchar) as date, model_id, {_TOKENS_IN}, tokens_out, tokens_in_cached, tokens_in_cache_write, actual_cost_cents,
 cost_estimate_cents, call_count, round(success_rate, 6) as success_rate, round(avg_duration_ms, 6) as avg_duration_ms
from (select *, {_RATES} from t) join durations using (date, model_id)""")
def model_trends(spark, sf_dir):
    out = rounded(R.model_trends(usage(spark, sf_dir)), "success_rate", "avg_duration_ms")
    return out.withColumn("date", F.col("date").cast("string"))


@register("all_grains_rollup", ALL + "".join(f"""
{'union all ' if i else ''}select '{g}' as grain, {k} as key, {O.aggs()} from u {'group by ' + c if c else ''}"""
          for i, (g, k, c) in enumerate([
              ("global", "''", ""), ("session", "session_id", "session_id"), ("tool", "tool_name", "tool_name"),
              ("model", "model_id", "model_id"), ("day", "cast(date as varchar)", "date")])))
def all_grains_rollup(spark, sf_dir):
    return R.all_grains(usage(spark, sf_dir))


@register("count_source_breakdown", ALL + """ select count(*) filter (token_count_source = 'api_reported') as api_reported,
 count(*) filter (token_count_source = 'estimated') as estimated, count(*) filter (token_count_source = 'unavailable') as unavailable from u""")
def count_source_breakdown(spark, sf_dir):
    return R.source_breakdown(usage(spark, sf_dir))


@register("duration_percentiles_by_user_session", ALL + ", " + O.duration_cte("session_id") +
          f" select session_id, {O.rounded('avg_duration_ms', 'p50_duration_ms', 'p99_duration_ms')} from durations")
def duration_percentiles_by_user_session(spark, sf_dir):
    out = R.duration_percentiles(usage(spark, sf_dir), ["session_id"])
    return rounded(out, "avg_duration_ms", "p50_duration_ms", "p99_duration_ms")


@register("duration_percentiles_global", ALL + ", " + O.duration_cte("true") +
          f" select {O.rounded('avg_duration_ms', 'p50_duration_ms', 'p99_duration_ms')} from durations")
def duration_percentiles_global(spark, sf_dir):
    out = R.global_duration_percentiles(usage(spark, sf_dir))
    return rounded(out, "avg_duration_ms", "p50_duration_ms", "p99_duration_ms")


@register("efficiency_metrics", ALL + "," + _TOTALS + f"""
select round((tokens_in_user + tokens_in_cached) / tokens_out, 6) as context_to_output_ratio, round(system_pct, 6) as system_overhead_pct,
 cost_estimate_cents // success_count as cost_per_successful_task_cents, round(saved_pct, 6) as tokens_saved_pct,
 'full_file_read' as baseline_method, round(truncation_rate, 6) as truncation_rate,
 coalesce(nullif(concat_ws(' ', {_TIP1}, {_TIP2}, {_TIP3}), ''), 'Token usage is within normal parameters.') as suggestion,
 round((total_in + tokens_out) / active_days, 6) as tokens_per_active_day, cost_estimate_cents // active_days as cost_per_active_day_cents,
 round(success_rate * 0.6 + case when success_rate > 0 then (1 - least(retry_rate, 1)) * 0.2 + (1 - least(truncation_rate, 1)) * 0.2 else 0 end, 6) as quality_score
from rates""")
def efficiency_metrics(spark, sf_dir):
    return rounded(R.efficiency(usage(spark, sf_dir)), "context_to_output_ratio", "system_overhead_pct", "tokens_saved_pct",
                   "truncation_rate", "tokens_per_active_day", "quality_score")


@register("suggestions_by_tenant", ALL + f""", tot as (select tenant_id, {O.aggs()} from u group by tenant_id),
r as (select *, {_RATES}, 100.0 * tokens_in_system / (tokens_in_system + tokens_in_user + tokens_in_cached) as system_pct,
 100.0 * tokens_in_cached / (tokens_in_system + tokens_in_user + tokens_in_cached) as saved_pct from tot)
select tenant_id, coalesce(nullif(concat_ws(' ', {_TIP1}, {_TIP2}), ''), case when saved_pct > 0 then {_SAVED} else 'Token usage is within normal parameters.' end) as global_suggestion,
 coalesce(nullif(concat_ws(' ', {_TIP1}, {_TIP2}, {_TIP3}), ''), 'Token usage is within normal parameters.') as efficiency_suggestion from r""")
def suggestions_by_tenant(spark, sf_dir):
    return R.suggestions(R.tenant_totals(usage(spark, sf_dir)), "tenant_id")


@register("full_report_parts", ALL + f"""
select 'session' as part, count(*) as n from (select distinct session_id, tenant_id from u)
union all select 'by_tool', count(distinct tool_name) from u union all select 'by_model', count(distinct model_id) from u
union all select 'daily_trends', count(distinct date) from u union all select 'efficiency', 1 union all select 'meta', 1 union all select 'global', 1""")
def full_report_parts(spark, sf_dir):
    parts = R.full_stats(usage(spark, sf_dir), AS_OF)
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@register("redacted_tools", ALL + """ select case when tool_name in ('chat_completions', 'chat') then 'llm'
 when tool_name = 'passthrough' then 'passthrough' else 'tool' end as tool, cast(sum(tokens_out) as bigint) as tokens_out from u group by tool_name""")
def redacted_tools(spark, sf_dir):
    return R.redact_tools(R.tool_stats(usage(spark, sf_dir)), "redacted").select("tool", "tokens_out")


@register("redacted_models", ALL + """ select model_id, cast(null as bigint) as actual_cost_cents, cast(0 as bigint) as cost_estimate_cents,
 true as cost_unavailable, count(*) as call_count from u group by model_id""")
def redacted_models(spark, sf_dir):
    out = R.redact_models(R.model_stats(usage(spark, sf_dir)), "redacted")
    return out.select("model_id", "actual_cost_cents", "cost_estimate_cents", "cost_unavailable", "call_count")


@register("stats_meta", ALL + """, c as (select count(*) filter (token_count_source = 'api_reported') as api_reported,
 count(*) filter (token_count_source = 'estimated') as estimated, count(*) filter (token_count_source = 'unavailable') as unavailable from u)
select *, (estimated + unavailable) / (api_reported + estimated + unavailable) > 0.5 as token_count_reconciliation_issue,
 false as incomplete_data, 'full' as access_level from c""")
def stats_meta(spark, sf_dir):
    return R.stats_meta(usage(spark, sf_dir))


@register("trend_gaps", ALL + """, d as (select distinct date from u where event_ts < timestamp '2024-01-08' or event_ts >= timestamp '2024-01-11'),
w as (select date, lead(date) over (order by date) as next_date from d)
select cast(date as varchar) as prev_date, cast(next_date as varchar) as next_date,
 'Gap between ' || date || ' and ' || next_date || ' (expected ' || cast(date + 1 as date) || ')' as message
from w where next_date <> date + 1""")
def trend_gaps(spark, sf_dir):
    # A collection outage of three days.
    events = usage(spark, sf_dir).where("event_ts < timestamp'2024-01-08' or event_ts >= timestamp'2024-01-11'")
    gaps = R.trend_gaps(events.select(F.to_date("event_ts").alias("date")))
    return gaps.withColumns({c: F.col(c).cast("string") for c in ("prev_date", "next_date")})


@register("reconcile_sessions", ALL + "," + _SESSIONS + """,
shown as (select session_id, tokens_out + case when call_count > 3 then 5000 else 0 end as shown_out, tokens_out, call_count as calls, call_count from sessions)
select session_id, 'tokens_out' as measure, shown_out as actual, tokens_out as expected,
 case when tokens_out = 0 then format('tokens_out: expected 0, got {}', shown_out)
  else format('tokens_out: expected {}, got {} (delta {:.2f}%)', tokens_out, shown_out, abs(shown_out - tokens_out) / tokens_out * 100) end as issue
from shown where case when tokens_out = 0 then shown_out <> 0 else abs(shown_out - tokens_out) / tokens_out > 0.01 end""")
def reconcile_sessions(spark, sf_dir):
    events = usage(spark, sf_dir)
    drifted = R.session_counters(events).withColumn(
        "tokens_out", F.col("tokens_out") + F.when(F.col("call_count") > 3, 5000).otherwise(0))
    return R.reconcile(drifted, events)


@register("orphaned_sessions", ALL + f" select session_id from u group by session_id having max(event_ts) < {O.CUTOFF}")
def orphaned_sessions(spark, sf_dir):
    return R.orphaned_sessions(usage(spark, sf_dir), AS_OF).select("session_id")


@register("session_orphan_check", ALL + f"""
select w.session_id, coalesce(last_event < {O.CUTOFF}, true) as orphaned
from (select distinct 's-' || cast(c_custkey as varchar) || '-2024-01-30' as session_id from customer) w
left join (select session_id, max(event_ts) as last_event from u group by session_id) using (session_id)""")
def session_orphan_check(spark, sf_dir):
    from veilframe.session import table

    wanted = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("s-"), F.col("c_custkey").cast("string"), F.lit("-2024-01-30")).alias("session_id"))
    return R.is_orphaned(usage(spark, sf_dir), wanted, AS_OF)


@register("event_cap_per_session", ALL + """ select event_id, session_id from (select *, row_number() over (partition by session_id
 order by event_ts desc, event_id desc) as r from u) where r <= 3""")
def event_cap_per_session(spark, sf_dir):
    return R.event_cap(usage(spark, sf_dir), 3).select("event_id", "session_id")


@register("trimmed_session_count", ALL + " select count(*) as trimmed from (select session_id from u group by session_id having count(*) > 3)")
def trimmed_session_count(spark, sf_dir):
    return R.trimmed_sessions(usage(spark, sf_dir), 3)


@register("tenant_isolation", ALL + """ select 'acme' as viewer, event_id from u where tenant_id = 'acme'
 union all select 'default' as viewer, event_id from u""")
def tenant_isolation(spark, sf_dir):
    events = usage(spark, sf_dir)
    views = [R.for_tenant(events, t).select(F.lit(t).alias("viewer"), "event_id") for t in ("acme", "default")]
    return views[0].unionByName(views[1])


@register("tenant_totals", ALL + f" select tenant_id, {O.aggs()}, count(distinct session_id) as sessions from u group by tenant_id")
def tenant_totals(spark, sf_dir):
    return R.tenant_totals(usage(spark, sf_dir))


# ── alerts ──────────────────────────────────────────────────────────────────

_T = A.Thresholds(cost_spike_multiplier=3.0, runaway_session_cents=40, abnormal_retry_rate=0.2,
                  daily_cost_spike_cents=250, high_truncation_rate=0.01)
_DAILY = f"daily as (select date, cast(sum(cost_estimate_cents) as bigint) as cost from u group by date)"
_BASE = "base as (select (select avg(cost) from daily) / (select count(*) from sessions) as b)"
_J1 = f"""select 'critical' as severity, 'runaway_session' as alert_type,
 format('Session {{}} has exceeded ${{:.2f}} in estimated cost. This may indicate a runaway agent or misconfigured prompt.', session_id, cost_estimate_cents / 100) as message,
 session_id, cast(cost_estimate_cents as double) as current_value, cast({_T.runaway_session_cents} as double) as threshold
 from sessions where cost_estimate_cents > {_T.runaway_session_cents}"""
_J2 = f"""select 'warning' as severity, 'abnormal_retry_rate' as alert_type,
 format('Session {{}} has a {{:.0f}}% retry rate ({{}}/{{}} calls). This may indicate an unstable upstream provider.', session_id, round(retry_count / call_count * 100, 9), retry_count, call_count) as message,
 session_id, round(retry_count / call_count, 6) as current_value, cast({_T.abnormal_retry_rate} as double) as threshold
 from sessions where retry_count / call_count > {_T.abnormal_retry_rate}"""
_J3 = f"""select 'warning' as severity, 'cost_spike' as alert_type,
 format('Session {{}} cost (${{:.2f}}) is {{:.1f}}× the per-session daily average (${{:.4f}}). This may indicate an unusually expensive operation.',
  session_id, cost_estimate_cents / 100, cost_estimate_cents / b, b / 100) as message,
 session_id, round(cost_estimate_cents / b, 6) as current_value, cast({_T.cost_spike_multiplier} as double) as threshold
 from sessions, base where b > 0 and cost_estimate_cents > b * {_T.cost_spike_multiplier}"""
_J4 = f"""select 'warning' as severity, 'daily_cost_spike' as alert_type,
 format('Daily cost on {{}} was ${{:.2f}}, exceeding the ${{:.2f}} threshold.', cast(date as varchar), cost / 100, {_T.daily_cost_spike_cents} / 100) as message,
 cast(null as varchar) as session_id, cast(cost as double) as current_value, cast({_T.daily_cost_spike_cents} as double) as threshold
 from daily where cost > {_T.daily_cost_spike_cents}"""
_J5 = f"""select 'info' as severity, 'high_truncation_rate' as alert_type,
 format('Global truncation rate is {{:.0f}}% — users may be hitting context limits frequently. Consider reducing prompt size or breaking tasks into smaller steps.', rate * 100) as message,
 cast(null as varchar) as session_id, round(rate, 6) as current_value, cast({_T.high_truncation_rate} as double) as threshold
 from (select count(*) filter (tokens_truncated > 0) / count(*) as rate from u) where rate > {_T.high_truncation_rate}"""
_ALERT_CTES = ALL + ",\n" + ",\n".join([_SESSIONS, _DAILY, _BASE]) + "\n"


def _tidy(alerts):
    return alerts.withColumn("current_value", F.round("current_value", 6))


@register("alert_runaway_session", _ALERT_CTES + _J1)
def alert_runaway_session(spark, sf_dir):
    return _tidy(A.runaway_sessions(R.session_counters(usage(spark, sf_dir)), _T))


@register("alert_abnormal_retry_rate", _ALERT_CTES + _J2)
def alert_abnormal_retry_rate(spark, sf_dir):
    return _tidy(A.abnormal_retry_rates(R.session_counters(usage(spark, sf_dir)), _T))


@register("alert_cost_spike", _ALERT_CTES + _J3)
def alert_cost_spike(spark, sf_dir):
    events = usage(spark, sf_dir)
    return _tidy(A.cost_spikes(R.session_counters(events), A.daily_costs(events), _T))


@register("alert_daily_cost_spike", _ALERT_CTES + _J4)
def alert_daily_cost_spike(spark, sf_dir):
    return _tidy(A.daily_cost_spikes(A.daily_costs(usage(spark, sf_dir)), _T))


@register("alert_high_truncation_rate", _ALERT_CTES + _J5)
def alert_high_truncation_rate(spark, sf_dir):
    return _tidy(A.high_truncation_rate(A.daily_costs(usage(spark, sf_dir)), _T))


@register("all_alerts", _ALERT_CTES + " union all ".join(f"select * from ({j})" for j in (_J1, _J2, _J3, _J4, _J5)))
def all_alerts(spark, sf_dir):
    return _tidy(A.all_alerts(usage(spark, sf_dir), _T))
