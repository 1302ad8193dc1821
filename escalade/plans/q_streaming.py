"""Registered queries: chunk assembly, windowed routing metrics and the cascade on a stream (ST1-ST3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from escalade.plans.catalog import REGISTRY, register, rounded
from escalade.plans.oracle_views import with_views
from escalade.session import scratch_path
from escalade.sources import fixtures as fx
from escalade.sources.tables import load
from escalade.streaming import chunks as C
from escalade.streaming import completions as A
from escalade.streaming import monitor as W
from escalade.streaming import runner as S

_FMT = "yyyy-MM-dd HH:mm:ss"


@register("ST1_assemble_chunks", with_views(["chunks"], """
select id, string_agg(content, '' order by seq) as content, count(*)::bigint as n_chunks,
       arg_min(role, seq) filter (where role is not null) as role
from chunks group by id"""))
def st1(spark, sf):
    return C.assemble_chunks(fx.chunks(spark, sf), "id", None, finish=None).select("id", "content", "n_chunks", "role")


@register("ST2_window_cost_by_model", with_views(["routing_results"], """
select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, model_used, count(*)::bigint as n,
       round(sum(cost_usd), 9) as cost_usd
from routing_results group by all"""))
def st2(spark, sf):
    w = W.window_cost_by_model(fx.routing_results(spark, sf), "1 day")
    return rounded(w.select(F.date_format("window_start", _FMT).alias("window_start"), "model_used", "n", "cost_usd"),
                   ("cost_usd",))


@register("ST2_window_metrics", with_views(["routing_results"], """
select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, count(*)::bigint as n,
       round(count(*) filter (where model_used in ('strong', 'weak_then_strong')) * 1e2 / count(*), 6) as strong_pct,
       round(count(*) filter (where model_used = 'weak_then_strong') * 1e2 / count(*), 6) as trigger_rate,
       round(avg(latency_ms), 6) as avg_latency_ms, round(quantile_cont(latency_ms, 95e-2), 6) as p95_latency_ms,
       round(sum(cost_usd), 9) as cost_usd
from routing_results group by all"""))
def st2_metrics(spark, sf):
    w = W.window_metrics(fx.routing_results(spark, sf), "1 day", exact=True)
    return rounded(w.select(F.date_format("window_start", _FMT).alias("window_start"), "n", "strong_pct",
                            "trigger_rate", "avg_latency_ms", "p95_latency_ms", "cost_usd"), ("cost_usd",))


@register("ST2_window_cost_by_model_stream", with_views(["routing_results"], """
select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, model_used, count(*)::bigint as n,
       round(sum(cost_usd), 9) as cost_usd
from routing_results group by all"""))
def st2_stream(spark, sf):
    """Complete mode over the file stream: every window is in the result, closed by a watermark or not."""
    events = S.table_stream(spark, sf, "events")
    rr = fx.routing_results_from(events)
    out = S.run_available_now(W.window_cost_by_model(rr, "1 day"), "st2", "complete")
    return rounded(out.select(F.date_format("window_start", _FMT).alias("window_start"), "model_used", "n",
                              "cost_usd"), ("cost_usd",))


def _st3(spark, sf):
    conv = S.table_stream(spark, sf, "conversations")
    req = conv.where(F.col("role") == "user").select((F.col("conv_id") * 4294967296 + F.col("turn")).alias("request_id"))
    from escalade.plans.q_routing import _cascade_input, _cascade_out, _containment_scorer
    responses = _cascade_input(spark, sf)
    d = S.cascade_stream(req, responses, "request_id", _containment_scorer, threshold=0.6)
    return _cascade_out(S.run_available_now(d, "st3"))


def _register_st3():
    from escalade.plans import q_routing  # noqa: F401  (R8 oracle text)
    register("ST3_cascade_stream", REGISTRY["R8_cascade"].oracle)(_st3)


_register_st3()


@register("ST1_assemble_chunks_stream", """
with w as (select conv_id * 4294967296 + turn as id, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t != '') as t
  from conversations where role = 'assistant')
select id, array_to_string(t, ' ') || ' ' as content, len(t)::bigint as n_chunks, 'assistant' as role from w where len(t) > 0""")
def st1_stream(spark, sf):
    """Chunk assembly on a stream in complete mode: assistant turns of the conversations file arrive as word chunks;
    every completion is in the result."""
    conv = S.table_stream(spark, sf, "conversations").where(F.col("role") == "assistant")
    words = conv.select((F.col("conv_id") * 4294967296 + F.col("turn")).alias("id"),
                        F.posexplode(F.array_remove(F.split("text", r"\s+"), "")).alias("seq", "w"))
    chunks = words.select("id", F.col("seq").cast("bigint").alias("seq"), F.concat("w", F.lit(" ")).alias("content"),
                          F.when(F.col("seq") == 0, F.lit("assistant")).alias("role"))
    out = C.assemble_chunks(chunks, "id", None, finish=None)
    return S.run_available_now(out.select("id", "content", "n_chunks", "role"), "st1", "complete")


@register("ST1_completions_append_stream", """
with w as (select conv_id * 4294967296 + turn as id, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t != '') as t
  from conversations where role = 'assistant'),
sent as (select *, id % 13 = 0 as cut from w where len(t) - case when id % 13 = 0 then 1 else 0 end > 0)
select id, 0::bigint as index, array_to_string(case when cut then list_slice(t, 1, len(t) - 1) else t end, ' ') || ' ' as content,
       (len(t) - case when cut then 1 else 0 end)::bigint as n_chunks, 'assistant' as role, case when not cut then 'stop' end as finish_reason
from sent""")
def st1_append(spark, sf):
    """Completions that leave as they end: the words of assistant turns arrive as chunks, every seventh twice, and some completions
    never get their last chunk. Those leave when their time is over."""
    conv = load(spark, sf, "conversations").where(F.col("role") == "assistant")
    words = conv.select((F.col("conv_id") * 4294967296 + F.col("turn")).alias("id"),
                        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn") * 5).alias("created"),
                        F.array_remove(F.split("text", r"\s+"), "").alias("words"))
    words = words.select("id", "created", F.size("words").alias("n"), F.posexplode("words").alias("seq", "w"))
    words = words.where(~((F.col("id") % 13 == 0) & (F.col("seq") == F.col("n") - 1)))
    sent = words.select("id", F.lit(0).alias("index"), F.col("seq").cast("bigint").alias("seq"), "created",
                        F.when(F.col("seq") == 0, F.lit("assistant")).alias("role"), F.concat("w", F.lit(" ")).alias("content"),
                        F.when(F.col("seq") == F.col("n") - 1, F.lit("stop")).alias("finish_reason"))
    twice = sent.withColumn("again", F.explode(F.when(F.col("seq") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("again")
    folder = scratch_path(spark, "chunks")
    twice.write.parquet(folder)
    out = S.run_to_close(lambda: A.assemble_completions(S.file_stream(spark, folder, "*.parquet")), "st1-append", [(folder, "created")], "id")
    return out.select("id", F.col("index").cast("bigint").alias("index"), "content", "n_chunks", "role", "finish_reason")


@register("ST2_window_metrics_stream", with_views(["routing_results"], """
select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, count(*)::bigint as n,
       round(count(*) filter (where model_used in ('strong', 'weak_then_strong')) * 1e2 / count(*), 6) as strong_pct,
       round(count(*) filter (where model_used = 'weak_then_strong') * 1e2 / count(*), 6) as trigger_rate,
       round(avg(latency_ms), 6) as avg_latency_ms, true as p95_within_rank_error, round(sum(cost_usd), 9) as cost_usd
from routing_results group by all"""))
def st2_metrics_stream(spark, sf):
    """All window metrics from a stream in append mode, each window once, when the watermark has passed it. The P95 comes from a sketch:
    its rank among the window's rows, counted exactly here, must be within half a percent (and a row) of 95 %."""
    folder = scratch_path(spark, "results")
    rr = fx.routing_results(spark, sf)
    rr.select("request_id", "ts", "model_used", "latency_ms", "cost_usd").write.parquet(folder)
    out = S.run_to_close(lambda: W.window_sketches(S.file_stream(spark, folder, "*.parquet"), "1 day", "1 hour"), "st2-metrics", [(folder, "ts")])
    m = W.sketch_metrics(out)
    lat = rr.where("latency_ms is not null").select(F.window("ts", "1 day").start.alias("window_start"), "latency_ms")
    rank = lat.join(m.select("window_start", "p95_latency_ms"), "window_start").groupBy("window_start").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("latency_ms") < F.col("p95_latency_ms")).alias("below"),
        F.count_if(F.col("latency_ms") <= F.col("p95_latency_ms")).alias("up_to"))
    slack = 0.005 * F.col("rows") + 1
    near = (F.col("below") - slack <= 0.95 * F.col("rows")) & (F.col("up_to") + slack >= 0.95 * F.col("rows"))
    told = m.join(rank.select("window_start", near.alias("p95_within_rank_error")), "window_start", "left")
    return rounded(told.select(F.date_format("window_start", _FMT).alias("window_start"), "n", "strong_pct", "trigger_rate", "avg_latency_ms",
                               "p95_within_rank_error", "cost_usd"), ("cost_usd",))
