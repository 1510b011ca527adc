"""Registered queries: streaming jobs run over the given tables, compared with their batch results."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from veilframe.operators import detect as D
from veilframe.operators import limits as L
from veilframe.operators import pseudonymize as Z
from veilframe.operators import rehydrate as H
from veilframe.operators.rollups import minute_truncate
from veilframe.operators.usage import with_cost
from veilframe.plans import gateway as GW
from veilframe.plans import oracle_detection as O
from veilframe.plans import oracle_usage as U
from veilframe.plans import usage as UQ
from veilframe.plans.fixtures import docs_pii, model_for, request_log, usage_raw
from veilframe.plans.registry import register
from veilframe.plans.usage import ts_text
from veilframe.session import table, work_path
from veilframe.streaming import jobs as J
from veilframe.streaming import state as S


_SLICES = 3
# Column that orders each table in time, and how far behind its end the closing row lies.
_ORDER = {"events": ("unix_micros(ts)", 2 * 86_400_000_000), "conversations": ("conv_id", 24), "documents": ("doc_id", 0)}


def _slices(spark, sf_dir, name: str, close: bool):
    """A table cut into slices by time; then, if asked for, one late row that lets all windows close.

    The closing row opens a window of its own, which never ends, so it is in no result.
    """
    rows = table(spark, sf_dir, name)
    order, after = _ORDER[name]
    low, high = rows.select(F.coalesce(F.min(F.expr(order)), F.lit(0)), F.coalesce(F.max(F.expr(order)), F.lit(0))).first()
    # Rows without a time come first.
    number = F.coalesce(F.floor((F.expr(order) - F.lit(low)) * _SLICES / F.lit(high - low + 1)), F.lit(0))
    yield from (rows.where(number == i) for i in range(_SLICES))
    if close:
        late = {"ts": F.timestamp_micros(F.lit(high + after))} if name == "events" else {"conv_id": F.lit(high + after), "turn": F.lit(0)}
        yield spark.range(1).select(*[late.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])


def _replay(spark, sf_dir, name: str, start, label: str, close: bool = False) -> str:
    """Feed a table slice by slice to a stream that is started anew, from its checkpoint, for each.

    ``start(source, base)`` starts the stream; ``source`` takes the place of ``table``.
    """
    base = work_path(spark, label)
    for part in _slices(spark, sf_dir, name, close):
        part.write.mode("append").parquet(f"{base}/in")
        start(lambda *_, schema=part.schema: spark.readStream.schema(schema).parquet(f"{base}/in"), base).awaitTermination()
    return base


def _run(spark, sf_dir, name: str, build, label: str, close: bool = False):
    """Replay into a parquet sink and read what it wrote."""
    schemas = []

    def start(source, base):
        out = build(source)
        schemas.append(out.schema)
        return J.run_to_parquet(out, f"{base}/out", f"{base}/checkpoint")

    base = _replay(spark, sf_dir, name, start, label, close)
    return spark.read.schema(schemas[0]).parquet(f"{base}/out")


@contextmanager
def _rocksdb(spark):
    """State with lifetimes needs the RocksDB store; the former setting comes back afterwards."""
    before = spark.conf.get(S.PROVIDER_SETTING)
    spark.conf.set(S.PROVIDER_SETTING, S.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(S.PROVIDER_SETTING, before)


@register("stream_ingested_events", UQ.RAW + " select distinct event_id, tokens_out from usage_raw where schema_version <= 2")
def stream_ingested_events(spark, sf_dir):
    out = _run(spark, sf_dir, "events", lambda source: J.ingest_events(usage_raw(spark, sf_dir, source)), "ingest")
    return out.select("event_id", "tokens_out")


@register("stream_daily_counters", "with " + ",\n".join([U.USAGE_RAW, U.PRICES_CTE, U.priced_models_cte(), U.priced_cte()]) + """
select strftime(date_trunc('day', event_ts), '%Y-%m-%d %H:%M:%S') as window_start, tool_name, model_id, count(*) as call_count, cast(sum(tokens_out) as bigint) as tokens_out,
 cast(sum(cost_estimate_cents) as bigint) as cost_estimate_cents, count(*) filter (success) as success_count
from priced group by all""")
def stream_daily_counters(spark, sf_dir):
    build = lambda source: J.running_counters(with_cost(usage_raw(spark, sf_dir, source)), "tool_name", "model_id")
    return _run(spark, sf_dir, "events", build, "counters", close=True).withColumn("window_start", ts_text("window_start"))


@register("stream_closed_sessions", GW.SESSIONIZE_SQL)
def stream_closed_sessions(spark, sf_dir):
    build = lambda source: J.closing_sessions(source(spark, sf_dir, "events"), "user_id")
    out = _run(spark, sf_dir, "events", build, "sessions", close=True)
    return out.select("user_id", ts_text("session_start"), ts_text("session_last"), "events")


@register("stream_sliding_usage", """with s as (select user_id % 20 as client, unnest(range(4)) as k, date_trunc('minute', ts) as m from events),
w as (select client, time_bucket(interval 15 minute, m) - k * interval 15 minute as window_start from s)
select client, strftime(window_start, '%Y-%m-%d %H:%M:%S') as window_start, count(*) as requests from w group by all""")
def stream_sliding_usage(spark, sf_dir):
    def build(source):
        events = source(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("client"), "ts")
        return J.sliding_usage(events, "client", slide="15 minutes")

    out = _run(spark, sf_dir, "events", build, "sliding", close=True)
    return out.select("client", ts_text("window_start"), "requests")


@register("stream_document_scan", "with " + ",\n".join([O.docs_pii_cte(), O.found_cte(), O.resolved_cte(), O.token_ctes()]) + """
select doc_id, pii_type, count(*) as n, sanitized from resolved join sanitized using (doc_id) group by all""")
def stream_document_scan(spark, sf_dir):
    build = lambda source: D.entity_counts(Z.sanitize(J.dealt(docs_pii(spark, sf_dir, source), "doc_id"))).select("doc_id", "sanitized", "entity_types")
    out = _run(spark, sf_dir, "documents", build, "scan")
    return D.explode_counts(out, "doc_id", "sanitized")


def _chunk_stream(c):
    """One chunk per conversation turn: text, usage every third turn, an end marker."""
    t = F.col("turn")
    data = (
        F.when(t % 3 == 2, F.concat(F.lit('data: {"usage":{"prompt_tokens":'), t.cast("string"), F.lit("}}")))
        .when(t == 4, "data: [DONE]")
        .otherwise(F.concat(F.lit("data: {\"t\":\"[EMAIL_ADDRESS_1] of turn "), t.cast("string"), F.lit('"}')))
    )
    return c.select(
        F.col("conv_id").alias("stream_id"), t.alias("seq"), F.concat(F.lit("s-"), (F.col("conv_id") % 50).cast("string")).alias("session_id"),
        model_for(F.col("conv_id")).alias("model_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + t).alias("ts"), data.alias("data"))


@register("stream_closed_responses", """select conv_id as stream_id, max(turn) filter (turn % 3 = 2) as last_usage_turn, count(*) as chunk_count, coalesce(bool_or(turn = 4), false) as ended
from conversations group by conv_id""")
def stream_closed_responses(spark, sf_dir):
    build = lambda source: J.closing_streams(_chunk_stream(source(spark, sf_dir, "conversations")))
    out = _run(spark, sf_dir, "conversations", build, "responses", close=True)
    turn = F.regexp_extract("last_usage", r'prompt_tokens":(\d+)', 1)
    return out.select("stream_id", turn.try_cast("bigint").alias("last_usage_turn"), "chunk_count", "ended")


@register("stream_rehydrated_chunks", """select conv_id as stream_id, turn as seq, case when turn % 3 = 2 then 'data: {"usage":{"prompt_tokens":' || turn || '}}' when turn = 4 then 'data: [DONE]'
 else 'data: {"t":"\\"user' || (conv_id % 50) || '\\"@example.com of turn ' || turn || '"}' end || chr(10) || chr(10) as rehydrated from conversations""")
def stream_rehydrated_chunks(spark, sf_dir):
    from veilframe.plans.texts import _stream_tokens

    tokens = _stream_tokens(spark, sf_dir)
    fill = lambda batch: H.rehydrate_sse(batch, tokens, ["stream_id", "seq"]).select("stream_id", "seq", "rehydrated")
    start = lambda source, base: J.run_each_batch(
        _chunk_stream(source(spark, sf_dir, "conversations")), fill, f"{base}/out", f"{base}/checkpoint")
    base = _replay(spark, sf_dir, "conversations", start, "chunks")
    return spark.read.schema("stream_id bigint, seq bigint, rehydrated string").parquet(f"{base}/out").drop("batch")


@register("stream_alerts", UQ._ALERT_CTES + " union all ".join(f"select * from ({j})" for j in (UQ._J1, UQ._J2, UQ._J3, UQ._J4, UQ._J5)))
def stream_alerts(spark, sf_dir):
    def start(source, base):
        events = minute_truncate(J.ingest_events(with_cost(usage_raw(spark, sf_dir, source))))
        return J.run_alerts(events, f"{base}/out", f"{base}/checkpoint", UQ._T)

    base = _replay(spark, sf_dir, "events", start, "alerts")
    return J.latest_alerts(spark, f"{base}/out").withColumn("current_value", F.round("current_value", 6))


@register("stream_token_lifetime", """with a as (select event_id as row_id, 's-' || (user_id % 40) as session_id, '[EMAIL_ADDRESS_' || (user_id % 3) || ']' as token, ts, event_type = 'click' as adds from events),
l as (select *, sum(case when adds then 1 else 0 end) over w as adds_so_far, last_value(case when adds then row_id end ignore nulls) over w as last_add,
  ts - lag(ts) over (partition by session_id, token order by ts, row_id) <= interval 30 minute as near from a window w as (partition by session_id, token order by ts, row_id rows unbounded preceding)),
g as (select *, sum(case when near then 0 else 1 end) over (partition by session_id, token order by ts, row_id rows unbounded preceding) as run from l),
h as (select *, last_value(case when adds then row_id end ignore nulls) over (partition by session_id, token, run order by ts, row_id rows unbounded preceding) as live from g)
select row_id, session_id, token, case when live is not null then 'user' || live || '@example.com' end as found from h""")
def stream_token_lifetime(spark, sf_dir):
    def build(source):
        e = source(spark, sf_dir, "events")
        return S.token_lookups(e.select(
            F.concat(F.lit("s-"), (F.col("user_id") % 40).cast("string")).alias("session_id"),
            F.concat(F.lit("[EMAIL_ADDRESS_"), (F.col("user_id") % 3).cast("string"), F.lit("]")).alias("token"),
            F.when(F.col("event_type") == "click", F.concat(F.lit("user"), F.col("event_id").cast("string"), F.lit("@example.com"))).alias("original"),
            "ts", F.col("event_id").alias("row_id")))

    with _rocksdb(spark):
        return _run(spark, sf_dir, "events", build, "lifetime", close=True)


@register("stream_rate_limit_decisions", GW._walk_sql("client_id", GW._LOG, 2, 38).replace("select event_id, client_id, decision from walk", "select event_id as row_id, client_id, decision from walk"))
def stream_rate_limit_decisions(spark, sf_dir):
    build = lambda source: S.rate_limit_stream(request_log(spark, sf_dir, source), L.Limits(2, 38))
    with _rocksdb(spark):
        return _run(spark, sf_dir, "events", build, "limits", close=True)


_MAP_MINUTES = "case when conv_id % 7 = 0 then 40 else 10 end"


def _token_stream(c):
    """The map row of each conversation: its e-mail address, some minutes before the first chunk; every seventh too early."""
    first = c.groupBy("conv_id").agg(F.min("turn").alias("turn")) if not c.isStreaming else c
    return first.select(
        F.concat(F.lit("s-"), (F.col("conv_id") % 50).cast("string")).alias("session_id"), F.lit("[EMAIL_ADDRESS_1]").alias("token"),
        F.concat(F.lit('"user'), F.col("conv_id").cast("string"), F.lit('"@example.com')).alias("original"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 - F.expr(_MAP_MINUTES) * 60).alias("ts"))


@register("stream_joined_rehydration", """select conv_id as stream_id, turn as seq, case when turn % 3 = 2 then 'data: {"usage":{"prompt_tokens":' || turn || '}}' when turn = 4 then 'data: [DONE]'
 when conv_id % 7 = 0 then 'data: {"t":"[EMAIL_ADDRESS_1] of turn ' || turn || '"}'
 else 'data: {"t":"\\"user' || conv_id || '\\"@example.com of turn ' || turn || '"}' end || chr(10) || chr(10) as rehydrated from conversations""")
def stream_joined_rehydration(spark, sf_dir):
    """Chunks and their token map are both streams; the map comes a slice later than the chunks."""
    base = work_path(spark, "joined")
    *slices, last = _slices(spark, sf_dir, "conversations", close=True)
    schemas = []
    for chunks, maps in zip([*slices, None, last], [None, *slices, last], strict=True):
        for part, name in ((chunks, "chunks"), (maps, "tokens")):
            made = _chunk_stream(slices[0]) if name == "chunks" else _token_stream(slices[0])
            if part is not None:
                made = _chunk_stream(part) if name == "chunks" else _token_stream(part)
            else:
                made = made.where("false")
            made.write.mode("append").parquet(f"{base}/{name}")
            schemas.append(made.schema)
        source = lambda name, schema: spark.readStream.schema(schema).parquet(f"{base}/{name}")
        out = J.rehydrate_stream(source("chunks", schemas[0]), source("tokens", schemas[1]))
        J.run_to_parquet(out, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    found = spark.read.schema(out.schema).parquet(f"{base}/out")
    return found
