"""Registered queries: the whole chain from requests to reports, with an outcome for every request (R8, U1, ST3, A1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from escalade.functions.hashing import hash32_sql
from escalade.functions.text import last_user_message_flat
from escalade.operators import datasets as D
from escalade.operators import metrics as M
from escalade.operators import outcomes as O
from escalade.operators import requests as Q
from escalade.operators import training as T
from escalade.plans.catalog import register, rounded
from escalade.plans.oracle_views import with_views
from escalade.plans.q_routing import _containment_scorer, _toks, _wset
from escalade.schemas import routing_config
from escalade.session import scratch_path
from escalade.sources import fixtures as fx
from escalade.sources.tables import load
from escalade.streaming import runner as S

# ---------------------------------------------------------------- stand-in input


def _requests(spark, sf):
    """A request per conversation: its parameters, its last user message, and an arrival time from ``events``."""
    conv = load(spark, sf, "conversations")
    r = Q.validate_requests_flat(fx.chat_requests(spark, sf), conv)
    asked = last_user_message_flat(conv).select(F.col("conv_id").alias("request_id"), "prompt")
    times = load(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"))
    return r.join(asked, "request_id", "left").join(times, "request_id", "left")


def _responses(spark, sf):
    """What both models answered to the last user turn, with errors of some calls and latencies from ``events``."""
    conv = load(spark, sf, "conversations").where(F.col("role") == "user")
    last = conv.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    last = last.select(F.col("conv_id").alias("request_id"), (F.col("conv_id") * 4294967296 + F.col("turn")).alias("pair_id"))
    took = load(spark, sf, "events").select(F.col("event_id").alias("request_id"), (F.col("value") * 20.0).alias("weak_latency_ms"),
                                            (F.col("value") * 50.0).alias("strong_latency_ms"))
    c = fx.collected(spark, sf).select("pair_id", "weak_response", "strong_response", F.col("error").alias("weak_error"),
                                       F.when(F.col("pair_id") % 19 == 0, "overloaded").alias("strong_error"))
    return c.join(last, "pair_id").drop("pair_id").join(took, "request_id", "left")


def _outcomes(spark, sf):
    return O.settle(O.with_responses(_requests(spark, sf), _responses(spark, sf)), _containment_scorer)


_ASKED = ("asked", """
select conv_id, max(turn) filter (where role = 'user') as lt, arg_max(text, turn) filter (where role = 'user') as prompt, count(*) as n,
       count(*) filter (where role is null or role not in ('system', 'user', 'assistant')) as bad
from conversations group by conv_id""")
_TABLE = ("rq", """
select c.request_id, a.prompt, c.force_model, c.disable_evaluator, e.ts, e.value * 2e1 as wl, e.value * 5e1 as sl,
       p.pair_id is not null as answered, p.weak_response, p.strong_response, p.error as weak_error,
       case when p.pair_id % 19 = 0 then 'overloaded' end as strong_error,
       case when a.n < 1 then 'messages' when a.bad > 0 then 'messages.role' when not (c.temperature between 0 and 2) then 'temperature'
            when not (c.top_p between 0 and 1) then 'top_p' when c.max_tokens < 1 then 'max_tokens'
            when c.force_model not in ('weak', 'strong') then 'force_model' end as invalid
from chat_requests c join asked a on a.conv_id = c.request_id
left join collected p on p.pair_id = c.request_id * 4294967296 + a.lt left join events e on e.event_id = c.request_id""")


def _settled(table: str) -> list[tuple[str, str]]:
    """CTEs from ``table`` to ``out``: the outcome rules again, in SQL."""
    return [
        ("o1", f"""
select *, case when invalid is null and coalesce(length(prompt), 0) > 0 and answered and weak_error is null and force_model is null
                and not coalesce(disable_evaluator, false) and len({_wset('weak_response')}) > 0
               then len(list_intersect({_wset('weak_response')}, {_wset('strong_response')})) / len({_wset('weak_response')}) end as score
from {table}"""),
        ("o2", """
select *, case when force_model in ('weak', 'strong') then force_model when score < 6e-1 then 'weak_then_strong' else 'weak' end as mu
from o1"""),
        ("o3", """
select *, mu in ('weak', 'weak_then_strong') as wc, mu in ('strong', 'weak_then_strong') as sc,
       coalesce(case when mu in ('weak', 'weak_then_strong') then weak_error end, case when mu in ('strong', 'weak_then_strong') then strong_error end) as fault
from o2"""),
        ("o4", """
select *, case when invalid is not null then 'invalid' when coalesce(length(prompt), 0) = 0 then 'no_user_message'
               when not answered then 'no_response' when fault is not null then 'failed' else 'served' end as status
from o3"""),
        ("out", f"""
select request_id, ts, status, case status when 'invalid' then invalid when 'failed' then fault when 'served' then null else status end as error,
       case when status in ('served', 'failed') then mu end as model_used,
       case when status in ('served', 'failed') then 0e0 end as routing_score,
       case when status in ('served', 'failed') then score end as weak_quality_score,
       status = 'served' and mu = 'weak_then_strong' as evaluator_triggered,
       case when status = 'served' then (w_in * 5e-1 + w_out * 15e-1 + s_in * 1e1 + s_out * 3e1) / 1e6 else 0e0 end as cost_usd,
       case when status in ('served', 'failed') then case when wc then coalesce(wl, 0) else 0 end + case when sc then coalesce(sl, 0) else 0 end end as latency_ms,
       case when status = 'served' then response end as response, w_in, w_out, s_in, s_out
from (select *, case when wc then {_toks('prompt')} else 0 end as w_in, case when wc then {_toks('weak_response')} else 0 end as w_out,
             case when sc then {_toks('prompt')} else 0 end as s_in, case when sc then {_toks('strong_response')} else 0 end as s_out,
             case when sc then strong_response else weak_response end as response from o4) x"""),
    ]


_FLAT = ("w_in", "weak_input"), ("w_out", "weak_output"), ("s_in", "strong_input"), ("s_out", "strong_output")
_OUT_SQL = ("select request_id, epoch_us(ts)::bigint as ts_us, status, error, model_used, round(weak_quality_score, 6) as weak_quality_score, "
            "evaluator_triggered, round(cost_usd, 9) as cost_usd, round(latency_ms, 6) as latency_ms, response, "
            + ", ".join(f"case when status = 'served' then {a} end::bigint as {b}" for a, b in _FLAT) + " from out")


def _flat(d):
    return rounded(d.select("request_id", F.unix_micros("ts").alias("ts_us"), "status", "error", "model_used", "weak_quality_score",
                            "evaluator_triggered", "cost_usd", "latency_ms", "response",
                            *[F.col(f"tokens_used.{b}").alias(b) for _, b in _FLAT]), ("cost_usd",))


@register("R8_outcomes", with_views(["chat_requests", "collected"], _OUT_SQL, extra=[_ASKED, _TABLE, *_settled("rq")]))
def r8_outcomes(spark, sf):
    """As many outcomes as requests: invalid, without a message or an answer, failed, or served with its text and cost."""
    return _flat(_outcomes(spark, sf))


@register("R8_outcomes_by_config", with_views(["chat_requests", "collected"], """
select model_used, count(*)::bigint as requests, round(sum(case when status = 'served' then (w_in * 1e0 + w_out * 15e-1 + s_in * 1e1 + s_out * 3e1) / 1e6
       else 0 end), 9) as cost_usd from out group by model_used""", extra=[_ASKED, _TABLE, *[
    (name, sql.replace("score < 6e-1", "score < 9e-1")) for name, sql in _settled("rq")]]))
def r8_by_config(spark, sf):
    """Thresholds and prices from settings instead of the defaults."""
    config = routing_config({"evaluator_threshold": "0.9", "weak_input": 1.0})
    out = O.settle_by(config, O.with_responses(_requests(spark, sf), _responses(spark, sf)), _containment_scorer)
    return rounded(out.groupBy("model_used").agg(F.count(F.lit(1)).alias("requests"), F.sum("cost_usd").alias("cost_usd")), ("cost_usd",))


@register("R8_outcome_counts", with_views(["chat_requests", "collected"], """
select status, error, count(*)::bigint as requests, round(count(*) * 1e2 / sum(count(*)) over (), 6) as pct
from out group by status, error""", extra=[_ASKED, _TABLE, *_settled("rq")]))
def r8_outcome_counts(spark, sf):
    return rounded(O.outcome_counts(_outcomes(spark, sf)))


@register("A1_metrics_of_outcomes", with_views(["chat_requests", "collected"], """
select count(*)::bigint as total_requests, count(*) filter (where model_used = 'weak')::bigint as weak_only,
       count(*) filter (where model_used = 'strong')::bigint as strong_only,
       count(*) filter (where model_used = 'weak_then_strong')::bigint as weak_then_strong,
       round(sum(cost_usd), 9) as total_cost_usd,
       round(sum((w_in + s_in + w_out + s_out) * 1e1 / 1e6), 9) as baseline_cost_usd,
       round(avg(latency_ms), 6) as avg_latency_ms, round(quantile_cont(latency_ms, 95e-2), 6) as p95_latency_ms,
       round(count(*) filter (where model_used = 'weak_then_strong') * 1e2 / count(*), 6) as evaluator_trigger_rate
from out where status = 'served'""", extra=[_ASKED, _TABLE, *_settled("rq")]))
def a1_of_outcomes(spark, sf):
    """The report of what the chain itself served, with its own times, latencies and tokens."""
    m = M.routing_metrics(O.served_results(_outcomes(spark, sf)))
    return rounded(m.select("total_requests", "weak_only", "strong_only", "weak_then_strong", "total_cost_usd", "baseline_cost_usd",
                            "avg_latency_ms", "p95_latency_ms", "evaluator_trigger_rate"), ("total_cost_usd", "baseline_cost_usd"))


# ---------------------------------------------------------------- the trained evaluator in the cascade

@register("R8_trained_cascade", with_views(["response_pairs", "chat_requests"], """
select pair_id as request_id, force_model,
       case when force_model in ('weak', 'strong') then 'forced' when disable_evaluator then 'off'
            when force_model is not null then 'off' else 'judged' end as path,
       true as decided_by_written_score, true as pays_for_what_it_calls
from v""", extra=[("n", "select count(*) as n from response_pairs"), ("v", """
select r.pair_id, c.force_model, coalesce(c.disable_evaluator, false) as disable_evaluator
from (select *, row_number() over (order by """ + hash32_sql("pair_id", 42) + """, pair_id) - 1 as ord
      from response_pairs) r
join chat_requests c on c.request_id = r.pair_id // 4294967296, n where ord >= trunc(n.n * 8e-1)""")]))
def r8_trained(spark, sf):
    """M1 is fitted on the training rows (D2), scores the others, and the cascade decides on them. The scores are written first; the
    decision of each row is then held against them."""
    pairs = fx.response_pairs(spark, sf)
    samples = D.to_adequacy_samples(D.adequacy_dataset(pairs, keep=("pair_id",)), keep=("pair_id",))
    split = D.random_split_exact(samples, "pair_id", 0.8, seed=42).checkpoint()
    model = T.train_adequacy(split.where("split = 'train'"))
    val = split.where("split = 'val'").select(F.col("pair_id").alias("request_id"))
    asked = pairs.select(F.col("pair_id").alias("request_id"), "prompt", "weak_response", "strong_response")
    params = fx.chat_requests(spark, sf).select(F.col("request_id").alias("conv"), "force_model", "disable_evaluator")
    rows = (asked.join(val, "request_id").withColumn("conv", F.shiftright("request_id", 32)).join(params, "conv").drop("conv"))
    path = scratch_path(spark, "scores")
    scorer = O.ModelScorer(model)
    scorer.add(rows, F.lit(True), "written").select("request_id", "written").write.parquet(path)
    done = O.settle(rows.withColumn("answered", F.lit(True)), scorer, keep=("force_model", "disable_evaluator"))
    held = done.join(spark.read.parquet(path), "request_id")
    judged = F.col("force_model").isNull() & ~F.col("disable_evaluator")
    strong = F.col("written") < 0.6
    expected = F.when(F.col("force_model").isin("weak", "strong"), F.col("force_model")).when(judged & strong, "weak_then_strong").otherwise("weak")
    same_score = F.when(judged, F.abs(F.col("weak_quality_score") - F.col("written")) < 1e-12).otherwise(F.col("weak_quality_score").isNull())
    paid = (F.col("tokens_used.strong_input") > 0) == expected.isin("strong", "weak_then_strong")
    return held.select("request_id", "force_model",
                       F.when(F.col("force_model").isin("weak", "strong"), "forced").when(judged, "judged").otherwise("off").alias("path"),
                       ((F.col("model_used") == expected) & same_score).alias("decided_by_written_score"),
                       F.coalesce(paid, F.lit(False)).alias("pays_for_what_it_calls"))


# ---------------------------------------------------------------- requests and responses as streams

_WAIT, _DELAY = "10 minutes", "1 minute"


def _arrivals(spark, sf):
    """Each user turn as a request at some second; the turn behind it as its responses, of which some come too late."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn") * 5)
    conv = load(spark, sf, "conversations").where(F.col("role") == "user")
    params = fx.chat_requests(spark, sf).select(F.col("request_id").alias("conv_id"), "force_model", "disable_evaluator")
    asked = conv.join(params, "conv_id").select(
        (F.col("conv_id") * 4294967296 + F.col("turn")).alias("request_id"), F.col("text").alias("prompt"), "force_model",
        "disable_evaluator", (F.coalesce(F.col("force_model") != "medium", F.lit(True))).alias("is_valid"), at.alias("ts"))
    c = fx.collected(spark, sf).withColumns({"conv_id": F.shiftright("pair_id", 32), "turn": F.col("pair_id") % 4294967296})
    late = F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, 3600).otherwise(3)
    answered = c.select(F.col("pair_id").alias("request_id"), "weak_response", "strong_response", F.col("error").alias("weak_error"),
                        F.timestamp_seconds(F.unix_seconds(at) + late).alias("responded_at"))
    return asked, answered


_STREAM = ("sq", """
select u.conv_id * 4294967296 + u.turn as request_id, u.text as prompt, c.force_model, c.disable_evaluator,
       make_timestamp((1704067200 + u.conv_id * 60 + u.turn * 5) * 1000000) as ts, 0e0 as wl, 0e0 as sl,
       p.pair_id is not null as answered, p.weak_response, p.strong_response, p.error as weak_error, null as strong_error,
       case when c.force_model = 'medium' then 'request' end as invalid
from conversations u join chat_requests c on c.request_id = u.conv_id
left join collected p on p.pair_id = u.conv_id * 4294967296 + u.turn and (u.conv_id + u.turn) % 11 <> 0
where u.role = 'user'""")


@register("ST3_outcomes_stream", with_views(["chat_requests", "collected"], _OUT_SQL, extra=[_STREAM, *_settled("sq")]))
def st3_outcomes(spark, sf):
    """Requests and responses as two streams: a request whose responses don't come within ten minutes leaves as ``no_response``."""
    folders = []
    for rows, name in zip(_arrivals(spark, sf), ("requests", "responses")):
        folders.append(scratch_path(spark, name))
        rows.write.parquet(folders[-1])
    joined = lambda: S.awaited_responses(*[S.file_stream(spark, f, "*.parquet") for f in folders], _WAIT, _DELAY)
    out = S.run_to_close(lambda: O.settle(joined(), _containment_scorer), "st3-outcomes", list(zip(folders, ("ts", "responded_at"))))
    return _flat(out)
