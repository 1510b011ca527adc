"""DuckDB SQL for the usage-event input and its prices."""

from __future__ import annotations

from veilframe.functions.pricing import PRICES, PRICING_AS_OF
from veilframe.plans.fixtures import AS_OF


def model_case(n: str) -> str:
    return (
        f"case when {n} % 7 = 0 then 'gpt-4o' when {n} % 7 = 1 then 'gpt-4o-mini-2024-07-18' "
        f"when {n} % 7 = 2 then 'claude-3-5-sonnet-20241022' when {n} % 7 = 3 then 'claude-3-opus' "
        f"when {n} % 7 = 4 then 'gemini-2.5-pro' when {n} % 7 = 5 then 'o1-mini' else 'local-llama' end"
    )


USAGE_RAW = f"""usage_raw as (
 select case when event_id % 997 = 0 then 3 else 2 end as schema_version,
  concat('ev-', cast(event_id as varchar)) as event_id, ts as event_ts,
  concat('s-', cast(user_id as varchar), '-', cast(cast(ts as date) as varchar)) as session_id,
  case when user_id % 3 = 0 then 'default' when user_id % 3 = 1 then 'acme' else 'globex' end as tenant_id,
  case when event_type = 'view' then 'passthrough' else 'chat_completions' end as tool_name,
  {model_case('event_id')} as model_id,
  cast(case when event_type = 'error' then event_id % 3 else 0 end as int) as retry_attempt,
  cast(case when event_id % 7 = 6 then 0 else 500 end as bigint) as tokens_in_system,
  cast(floor(value * 100) as bigint) as tokens_in_user,
  cast(case when event_id % 4 = 0 then floor(value * 20) else 0 end as bigint) as tokens_in_cached,
  cast(case when event_type = 'error' then 0 else floor(value * 30) end as bigint) as tokens_out,
  cast(case when event_id % 23 = 0 then 128 else 0 end as bigint) as tokens_truncated,
  cast(case when event_id % 7 in (2, 3) then floor(value * 5) else 0 end as bigint) as tokens_in_cache_write,
  case when event_id % 7 = 6 then 'unavailable' when event_id % 11 = 0 then 'estimated' else 'api_reported' end as token_count_source,
  event_id % 2 = 0 as was_streamed,
  (event_id % 2 = 0 and event_type = 'error') as was_partial,
  cast(floor(value * 37) as bigint) + event_id % 50 as duration_ms,
  case when event_id % 7 = 3 then cast(floor(value) as bigint) end as actual_cost_cents,
  event_type <> 'error' as success
 from (select *, unnest(case when event_id % 500 = 0 then [0, 1] else [0] end) as copy from events))"""

_PRICE_ROWS = ", ".join(f"('{m}', {', '.join(str(v) for v in p)})" for m, p in PRICES.items())
PRICES_CTE = f"prices(model, input_cents, cached_cents, cache_write_cents, output_cents, system_tokens) as (values {_PRICE_ROWS})"


def priced_models_cte(source: str = "usage_raw") -> str:
    return f"""priced_models as (
 select m.model_id, arg_max(p, length(p.model)) as price
 from (select distinct model_id from {source}) m join prices p on starts_with(m.model_id, p.model)
 group by m.model_id)"""


def cost_expr(cache_write: bool, e: str = "e", p: str = "m.price") -> str:
    parts = [
        f"({e}.tokens_in_system + {e}.tokens_in_user) * {p}.input_cents // 1000000",
        f"{e}.tokens_in_cached * {p}.cached_cents // 1000000",
        f"{e}.tokens_out * {p}.output_cents // 1000000",
    ]
    if cache_write:
        rate = f"case when {p}.cache_write_cents > 0 then {p}.cache_write_cents else {p}.input_cents end"
        parts.append(f"{e}.tokens_in_cache_write * ({rate}) // 1000000")
    return "coalesce(" + " + ".join(f"({x})" for x in parts) + ", 0)"


def priced_cte(cache_write: bool = False, name: str = "priced") -> str:
    return f"""{name} as (
 select e.*, cast({cost_expr(cache_write)} as bigint) as cost_estimate_cents, '{PRICING_AS_OF}' as pricing_as_of,
  m.price is null as cost_unavailable
 from usage_raw e left join priced_models m using (model_id))"""


USAGE_CTES = ",\n".join([
    USAGE_RAW, PRICES_CTE, priced_models_cte(), priced_cte(),
    """u as (
 select * exclude (event_ts, n), date_trunc('minute', event_ts) as event_ts, cast(event_ts as date) as date
 from (select *, row_number() over (partition by event_id order by event_ts) as n from priced where schema_version <= 2)
 where n = 1)""",
])

SUMS = {
    "tokens_in_system": "sum(tokens_in_system)", "tokens_in_user": "sum(tokens_in_user)",
    "tokens_in_cached": "sum(tokens_in_cached)", "tokens_out": "sum(tokens_out)",
    "tokens_truncated": "sum(tokens_truncated)", "tokens_in_cache_write": "sum(tokens_in_cache_write)",
    "cost_estimate_cents": "sum(cost_estimate_cents)", "actual_cost_cents": "sum(actual_cost_cents)",
}
COUNTS = {
    "call_count": "count(*)", "success_count": "count(*) filter (success)",
    "retry_count": "count(*) filter (retry_attempt > 0)", "partial_count": "count(*) filter (was_partial)",
    "truncation_count": "count(*) filter (tokens_truncated > 0)",
    "unpriced_count": "count(*) filter (cost_unavailable)",
}


def aggs(*names: str) -> str:
    both = {**SUMS, **COUNTS}
    picked = names or tuple(both)
    return ", ".join(f"cast({both[n]} as bigint) as {n}" for n in picked)


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


def duration_cte(keys: str, name: str = "durations", source: str = "u") -> str:
    """avg, p50, p99 per key."""
    return f"""{name} as (
 select {keys}, avg(duration_ms) as avg_duration_ms,
  cast(list_sort(list(duration_ms))[cast(round((count(*) - 1) * 0.5) as int) + 1] as double) as p50_duration_ms,
  cast(list_sort(list(duration_ms))[cast(round((count(*) - 1) * 0.99) as int) + 1] as double) as p99_duration_ms
 from {source} group by {keys})"""


CUTOFF = f"(timestamp '{AS_OF}' - interval 30 minute)"
