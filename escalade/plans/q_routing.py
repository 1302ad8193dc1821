"""Registered queries: requests, routers, cascade, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from escalade.functions.hashing import unit_uniform_sql
from escalade.functions.text import word_containment
from escalade.operators import metrics as M
from escalade.operators import requests as Q
from escalade.operators import routing as R
from escalade.operators.rounds import fit_bilinear
from escalade.plans.catalog import register, rounded
from escalade.plans.oracle_views import with_views
from escalade.sources import fixtures as fx
from escalade.sources.tables import load


def _toks(x: str) -> str:
    return rf"len(list_filter(regexp_split_to_array(coalesce({x}, ''), '\s+'), lambda t: t <> ''))"


def _wset(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '\s+'), lambda t: t <> ''))"


@register("P8_validate_requests", with_views(["chat_requests"], """
select request_id, n_errors = 0 as is_valid, n_errors::bigint as n_errors, error_fields
from (select r.request_id,
             (case when coalesce(m.n, 0) < 1 then 1 else 0 end + case when coalesce(m.bad, 0) > 0 then 1 else 0 end
              + case when not (temperature between 0 and 2) then 1 else 0 end
              + case when not (top_p between 0 and 1) then 1 else 0 end
              + case when max_tokens < 1 then 1 else 0 end
              + case when force_model is not null and force_model not in ('weak', 'strong') then 1 else 0 end) as n_errors,
             concat_ws(',', case when coalesce(m.n, 0) < 1 then 'messages' end,
                       case when coalesce(m.bad, 0) > 0 then 'messages.role' end,
                       case when not (temperature between 0 and 2) then 'temperature' end,
                       case when not (top_p between 0 and 1) then 'top_p' end,
                       case when max_tokens < 1 then 'max_tokens' end,
                       case when force_model is not null and force_model not in ('weak', 'strong') then 'force_model' end)
               as error_fields
      from chat_requests r
      left join (select conv_id, count(*) as n,
                        count(*) filter (where role is null or role not in ('system', 'user', 'assistant')) as bad
                 from conversations group by conv_id) m on m.conv_id = r.request_id) v"""))
def p8(spark, sf):
    v = Q.validate_requests(fx.chat_requests(spark, sf, with_messages=True))
    return _p8_out(v)


def _p8_out(v):
    return v.select("request_id", "is_valid", F.size("errors").cast("bigint").alias("n_errors"),
                    F.array_join(F.transform("errors", lambda e: e["field"]), ",").alias("error_fields"))


_P8_SQL = with_views(["chat_requests"], """
select request_id, n_errors = 0 as is_valid, n_errors::bigint as n_errors, error_fields
from (select r.request_id,
             (case when coalesce(m.n, 0) < 1 then 1 else 0 end + case when coalesce(m.bad, 0) > 0 then 1 else 0 end
              + case when not (temperature between 0 and 2) then 1 else 0 end
              + case when not (top_p between 0 and 1) then 1 else 0 end
              + case when max_tokens < 1 then 1 else 0 end
              + case when force_model is not null and force_model not in ('weak', 'strong') then 1 else 0 end) as n_errors,
             concat_ws(',', case when coalesce(m.n, 0) < 1 then 'messages' end,
                       case when coalesce(m.bad, 0) > 0 then 'messages.role' end,
                       case when not (temperature between 0 and 2) then 'temperature' end,
                       case when not (top_p between 0 and 1) then 'top_p' end,
                       case when max_tokens < 1 then 'max_tokens' end,
                       case when force_model is not null and force_model not in ('weak', 'strong') then 'force_model' end)
               as error_fields
      from chat_requests r
      left join (select conv_id, count(*) as n,
                        count(*) filter (where role is null or role not in ('system', 'user', 'assistant')) as bad
                 from conversations group by conv_id) m on m.conv_id = r.request_id) v""")


@register("P8_validate_requests_flat", _P8_SQL)
def p8_flat(spark, sf):
    """Same checks with the messages kept one row per message (aggregated per request, skew-safe)."""
    v = Q.validate_requests_flat(fx.chat_requests(spark, sf), load(spark, sf, "conversations"))
    return _p8_out(v)


@register("P9_evaluable", with_views(["chat_requests"], """
select request_id, not coalesce(disable_evaluator, false) and force_model is null as evaluable from chat_requests"""))
def p9(spark, sf):
    return fx.chat_requests(spark, sf).select("request_id", Q.evaluable(True).alias("evaluable"))


@register("R1_route", with_views(["routing_results"], """
select request_id, case when routing_score >= 5e-1 then 'strong' else 'weak' end as decision from routing_results"""))
def r1(spark, sf):
    return fx.routing_results(spark, sf).select("request_id", R.route("routing_score", 0.5).alias("decision"))


@register("R2_random_win_rate", f"""
select doc_id, round({unit_uniform_sql('doc_id', 11)}, 6) as win_rate,
       case when {unit_uniform_sql('doc_id', 11)} >= 5e-1 then 'strong' else 'weak' end as decision
from documents""")
def r2(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", R.random_win_rate("doc_id", 11).alias("win_rate"))
    return rounded(d.withColumn("decision", R.route("win_rate", 0.5)))


@register("R3_mf_win_rate", with_views(["battles", "queries"], """
select q.query_id, round(1e0 / (1e0 + exp(-sum(e.v * a.d))), 6) as win_rate
from (select query_id, unnest(range(len(embedding))) as dim, unnest(embedding)::double as v from queries) e
join queries q using (query_id)
join (select dim, avg(v) filter (where strong_wins = 1) - avg(v) filter (where strong_wins = 0) as d
      from (select strong_wins, unnest(range(len(embedding))) as dim, unnest(embedding)::double as v from battles) b
      group by dim) a using (dim)
group by q.query_id"""))
def r3(spark, sf):
    params = R.mf_params_from_battles(fx.battles(spark, sf))
    return rounded(R.mf_win_rate_from_params(fx.queries(spark, sf), params).select("query_id", "win_rate"))


@register("R3_mf_learned", """
select vec_id as query_id, true as folding_is_exact, true as beats_mean_vectors, true as beats_guessing from embeddings where vec_id % 10 = 0""")
def r3_learned(spark, sf):
    """The router learned from past battles (bilinear, W of rank 16): the folded score equals the written-out one, and on the queries
    (which it hasn't seen) its loss is below that of the mean-vector version and of guessing."""
    known = fx.directed_battles(spark, sf)
    past = known.where(F.col("battle_id") % 10 != 0)
    model = fit_bilinear(past)
    held = known.where(F.col("battle_id") % 10 == 0).select(F.col("battle_id").alias("query_id"), "embedding", F.col("strong_wins").cast("double").alias("y"))
    learned = R.mf_win_rate(held, model)
    seen = F.transform(F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in model.W]), lambda row: F.aggregate(
        F.zip_with("embedding", row, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x))
    delta = lambda v: F.aggregate(F.zip_with(
        F.zip_with(seen, F.array(*[F.lit(float(x)) for x in model.b]), lambda x, y: x + y),
        F.array(*[F.lit(float(x)) for x in v * model.w]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    whole = 1.0 / (1.0 + F.exp(delta(model.v_weak) - delta(model.v_strong)))
    means = R.mf_win_rate_from_params(held, R.mf_params_from_battles(past)).select("query_id", F.col("win_rate").alias("mean_rate"))
    p = lambda c: F.greatest(F.least(F.col(c), F.lit(1 - 1e-9)), F.lit(1e-9))
    loss = lambda c: F.avg(-(F.col("y") * F.log(p(c)) + (1 - F.col("y")) * F.log(1 - p(c))))
    rows = learned.withColumn("whole", whole).join(means, "query_id")
    told = rows.agg(loss("win_rate").alias("l"), loss("mean_rate").alias("m"))
    return rows.crossJoin(F.broadcast(told)).select("query_id", (F.abs(F.col("win_rate") - F.col("whole")) < 1e-9).alias("folding_is_exact"),
                                                    (F.col("l") < F.col("m")).alias("beats_mean_vectors"),
                                                    (F.col("l") < F.log(F.lit(2.0))).alias("beats_guessing"))


_R4_SQL = with_views(["battles", "queries"], """
select query_id, round(sum(w * strong_wins) / sum(w), 6) as win_rate, round(any_value(mx), 6) as max_cos
from (select query_id, strong_wins, mx, pow(1e1, 1e0 + cs / mx) as w
      from (select q.query_id, b.strong_wins,
                   list_cosine_similarity(q.embedding::double[], b.embedding::double[]) as cs,
                   max(list_cosine_similarity(q.embedding::double[], b.embedding::double[])) over (partition by q.query_id) as mx
            from queries q cross join battles b) s) t
group by query_id""")


@register("R4_sw_win_rate", _R4_SQL)
def r4(spark, sf):
    return rounded(R.sw_win_rate(fx.queries(spark, sf), fx.battles(spark, sf), gamma=10.0))


@register("R4_sw_win_rate_blocked", _R4_SQL)
def r4_blocked(spark, sf):
    """The same router over a grid of many small cells."""
    return rounded(R.sw_win_rate(fx.queries(spark, sf), fx.battles(spark, sf), gamma=10.0, query_rows=100, battle_rows=64))


_LOGITS_SQL = "list_transform(embedding[1:5], lambda x: x::double)"


@register("R6_causal_win_rate", f"""
select vec_id, round(1e0 - (exp(l[4] - m) + exp(l[5] - m)) / list_sum(list_transform(l, lambda x: exp(x - m))), 6) as win_rate,
       case when 1e0 - (exp(l[4] - m) + exp(l[5] - m)) / list_sum(list_transform(l, lambda x: exp(x - m))) >= 5e-1
            then 'strong' else 'weak' end as decision
from (select vec_id, l, list_max(l) as m from (select vec_id, {_LOGITS_SQL} as l from embeddings) a) b""")
def r6(spark, sf):
    e = load(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 5).alias("score_logits"))
    return rounded(R.causal_win_rate(e, "score_logits", 4, 0.5).select("vec_id", "win_rate", "decision"))


@register("F15_score_parse", """
select conv_id, turn, try_cast(nullif(regexp_extract(text, '([1-5])', 1), '') as integer)::bigint as score
from conversations""")
def f15(spark, sf):
    c = load(spark, sf, "conversations")
    return c.select("conv_id", "turn", R.score_parse("text").cast("bigint").alias("score"))


@register("R7_route_only", with_views(["routing_results"], """
select request_id, case when weak_quality_score >= 5e-1 then 'strong' else 'weak' end as decision
from routing_results"""))
def r7(spark, sf):
    rr = fx.routing_results(spark, sf).select("request_id", F.col("weak_quality_score").alias("win_rate"))
    return R.route_only(rr, "win_rate", 0.5).select("request_id", "decision")


# ---------------------------------------------------------------- cascade

def _cascade_input(spark, sf):
    rp = fx.response_pairs(spark, sf)
    cr = fx.chat_requests(spark, sf).select(F.col("request_id").alias("conv_id"), "force_model", "disable_evaluator")
    return (rp.withColumn("conv_id", F.shiftright("pair_id", 32)).join(cr, "conv_id")
            .select(F.col("pair_id").alias("request_id"), "prompt", "weak_response", "strong_response",
                    "force_model", "disable_evaluator"))


def _containment_scorer(prompt, response):
    return word_containment(response, F.col("strong_response"))


def _cascade_sql(routed: bool, body: str | None = None) -> str:
    wr = unit_uniform_sql("request_id", 7) if routed else "0e0"
    routed_strong = f"({wr} >= 5e-1)" if routed else "false"
    base = """
select request_id, model_used, round(win_rate, 6) as routing_score, round(score, 6) as weak_quality_score,
       model_used = 'weak_then_strong' as evaluator_triggered, response,
       pt::bigint as prompt_tokens, ct::bigint as completion_tokens, (pt + ct)::bigint as total_tokens,
       wi::bigint as weak_input, wo::bigint as weak_output, si::bigint as strong_input, so::bigint as strong_output,
       round((wi * 5e-1 + wo * 15e-1 + si * 1e1 + so * 3e1) / 1e6, 9) as cost_usd
from x"""
    ctes = [
        ("cin", """
select p.pair_id as request_id, p.prompt, p.weak_response, p.strong_response, c.force_model, c.disable_evaluator
from response_pairs p join chat_requests c on c.request_id = p.pair_id // 4294967296"""),
        ("c1", f"""
select *, {routed_strong} as routed, {wr} as win_rate, {_toks('prompt')} as pt,
       {_toks('weak_response')} as wot, {_toks('strong_response')} as sot,
       case when len({_wset('weak_response')}) = 0 then null
            else len(list_intersect({_wset('weak_response')}, {_wset('strong_response')})) / len({_wset('weak_response')}) end as raw
from cin"""),
        ("c2", """
select *, case when force_model is null and not coalesce(disable_evaluator, false) and not routed
                and raw is not null and not isnan(raw) then raw end as score
from c1"""),
        ("c3", """
select *, case when force_model in ('weak', 'strong') then force_model when routed then 'strong'
               when score < 6e-1 then 'weak_then_strong' else 'weak' end as model_used
from c2"""),
        ("x", f"""
select *, {_toks('response')} as ct,
       case when model_used in ('weak', 'weak_then_strong') then pt else 0 end as wi,
       case when model_used in ('weak', 'weak_then_strong') then wot else 0 end as wo,
       case when model_used in ('strong', 'weak_then_strong') then pt else 0 end as si,
       case when model_used in ('strong', 'weak_then_strong') then sot else 0 end as so
from (select *, case when model_used in ('strong', 'weak_then_strong') then strong_response
                     else weak_response end as response from c3) r"""),
    ]
    if body is not None and "pre" in body:
        ctes.append(("xp", f"select *, {unit_uniform_sql('request_id', 7)} >= 5e-1 as pre, "
                           "model_used in ('strong', 'weak_then_strong') as casc from x"))
    return with_views(["response_pairs", "chat_requests"], body or base, extra=ctes)


def _cascade_out(d):
    return rounded(d.select("request_id", "model_used", "routing_score", "weak_quality_score", "evaluator_triggered",
                            "response", "prompt_tokens",
                            "completion_tokens", "total_tokens", "weak_input", "weak_output", "strong_input",
                            "strong_output", "cost_usd"), ("cost_usd",))


@register("R8_cascade", _cascade_sql(False))
def r8(spark, sf):
    return _cascade_out(R.cascade(_cascade_input(spark, sf), _containment_scorer, None, threshold=0.6))


@register("R8_cascade_routed", _cascade_sql(True))
def r8_routed(spark, sf):
    inp = _cascade_input(spark, sf).withColumn("win_rate", R.random_win_rate("request_id", 7))
    return _cascade_out(R.cascade(inp, _containment_scorer, "win_rate", threshold=0.6, router_threshold=0.5))


@register("F10_response_envelope", _cascade_sql(False, body="""
select 'chatcmpl-' || request_id as id, 'chat.completion' as object, model_used as model,
       0::bigint as choice_index, 'assistant' as choice_role, 'stop' as finish_reason, model_used,
       round(win_rate, 6) as routing_score, round(score, 6) as weak_quality_score,
       model_used = 'weak_then_strong' as evaluator_triggered, response as content,
       (1704067200 + (request_id // 4294967296) * 60 + (2000 + length(response)) // 1000)::bigint as created, 2000e0 + length(response) as latency_ms,
       pt::bigint as prompt_tokens, ct::bigint as completion_tokens, (pt + ct)::bigint as total_tokens,
       round((wi * 5e-1 + wo * 15e-1 + si * 1e1 + so * 3e1) / 1e6, 9) as cost_usd
from x"""))
def f10(spark, sf):
    d = R.cascade(_cascade_input(spark, sf), _containment_scorer, None, threshold=0.6)
    # stand-in times: a request each minute, answered two seconds and a millisecond for each character later
    asked = F.timestamp_seconds(F.lit(1704067200) + F.shiftright("request_id", 32) * 60)
    told = d.withColumns({"asked_at": asked, "told_at": F.timestamp_millis(F.unix_millis(asked) + 2000 + F.length("response"))})
    env = Q.response_envelope(told, "asked_at", "told_at")
    c0 = F.element_at("choices", 1)
    return rounded(env.select(
        "id", "object", "model", c0["index"].cast("bigint").alias("choice_index"),
        c0["message"]["role"].alias("choice_role"), c0["finish_reason"].alias("finish_reason"),
        F.col("routing_metadata.model_used").alias("model_used"),
        F.col("routing_metadata.routing_score").alias("routing_score"),
        F.col("routing_metadata.weak_quality_score").alias("weak_quality_score"),
        F.col("routing_metadata.evaluator_triggered").alias("evaluator_triggered"),
        c0["message"]["content"].alias("content"), F.col("created"), F.col("routing_metadata.latency_ms").alias("latency_ms"),
        F.col("usage.prompt_tokens").alias("prompt_tokens"), F.col("usage.completion_tokens").alias("completion_tokens"),
        F.col("usage.total_tokens").alias("total_tokens"), F.col("routing_metadata.cost_usd").alias("cost_usd")),
        ("cost_usd",))


@register("R9_preroute_vs_evaluator", _cascade_sql(False, body="""
select strategy, count(*)::bigint as requests, round(count(*) filter (where strong) * 1e2 / count(*), 6) as strong_pct,
       round(sum(cost), 9) as total_cost, round(avg(case when not strong then q end), 6) as avg_quality_weak_served,
       round(count(*) filter (where agree) * 1e2 / count(*), 6) as agreement_pct
from (select 'preroute' as strategy, pre as strong,
             case when pre then (pt * 1e1 + sot * 3e1) / 1e6 else (pt * 5e-1 + wot * 15e-1) / 1e6 end as cost,
             pre = casc as agree, score as q from xp
      union all
      select 'evaluator', casc, (wi * 5e-1 + wo * 15e-1 + si * 1e1 + so * 3e1) / 1e6, pre = casc, score from xp) u
group by strategy"""))
def r9(spark, sf):
    inp = _cascade_input(spark, sf).withColumn("pre_rate", R.random_win_rate("request_id", 7))
    d = R.cascade(inp, _containment_scorer, None, threshold=0.6,
                  keep=("pre_rate", "weak_response", "strong_response"))
    return rounded(R.preroute_vs_evaluator(d, "pre_rate", 0.5), ("total_cost",))


@register("J1_pair_responses", with_views(["response_pairs"], """
select p.pair_id, p.prompt, p.weak_response, s.text as strong_response
from response_pairs p join (select conv_id * 4294967296 + turn - 1 as pair_id, text from conversations where role = 'assistant') s
  using (pair_id)"""))
def j1(spark, sf):
    weak = fx.response_pairs(spark, sf).select("pair_id", "prompt", "weak_response")
    conv = load(spark, sf, "conversations").where(F.col("role") == "assistant")
    strong = conv.select((F.col("conv_id") * 4294967296 + F.col("turn") - 1).alias("pair_id"), F.col("text").alias("strong_response"))
    return R.pair_responses(weak, strong)[0]


@register("J1_missing_weak", with_views(["response_pairs"], """
select s.pair_id from (select conv_id * 4294967296 + turn - 1 as pair_id from conversations where role = 'assistant') s
anti join response_pairs p using (pair_id)"""))
def j1_missing(spark, sf):
    weak = fx.response_pairs(spark, sf).select("pair_id", "weak_response")
    conv = load(spark, sf, "conversations").where(F.col("role") == "assistant")
    strong = conv.select((F.col("conv_id") * 4294967296 + F.col("turn") - 1).alias("pair_id"))
    _, _, missing_weak = R.pair_responses(weak, strong)
    return missing_weak.select("pair_id")


@register("J2_price_lookup", with_views(["routing_results", "prices"], """
select model_used, round(sum((weak_input * w.input_per_m + weak_output * w.output_per_m
                             + strong_input * s.input_per_m + strong_output * s.output_per_m) / 1e6), 9) as request_cost_usd
from routing_results, (select * from prices where model = 'weak') w, (select * from prices where model = 'strong') s
group by model_used"""))
def j2(spark, sf):
    j = M.request_cost_joined(fx.routing_results(spark, sf), fx.prices_df(spark))
    return rounded(j.groupBy("model_used").agg(F.sum("request_cost_usd").alias("request_cost_usd")),
                   ("request_cost_usd",))




@register("J4_query_model_similarity", with_views(["battles", "queries"], """
select q.query_id,
       round(list_cosine_similarity(q.embedding::double[], m.vs), 6) as cos_strong,
       round(list_cosine_similarity(q.embedding::double[], m.vw), 6) as cos_weak
from queries q,
     (select list(vs order by dim) as vs, list(vw order by dim) as vw
      from (select dim, avg(v) filter (where strong_wins = 1) as vs, avg(v) filter (where strong_wins = 0) as vw
            from (select strong_wins, unnest(range(len(embedding))) as dim, unnest(embedding)::double as v
                  from battles) b group by dim) a) m"""))
def j4(spark, sf):
    models = R.model_vectors_from_battles(fx.battles(spark, sf))
    return rounded(R.query_model_similarity(fx.queries(spark, sf), models).select("query_id", "cos_strong", "cos_weak"))


def _model_requests(spark, sf):
    conv = load(spark, sf, "conversations").where(F.col("role") == "user")
    cr = fx.chat_requests(spark, sf).select(F.col("request_id").alias("conv_id"), "force_model", "disable_evaluator")
    return conv.join(cr, "conv_id").select((F.col("conv_id") * 4294967296 + F.col("turn")).alias("request_id"),
                                           F.col("text").alias("prompt"), "force_model", "disable_evaluator")


def _weak_stand_in(prompt: str) -> str:
    if len(prompt) % 13 == 0:
        raise TimeoutError("simulated timeout")
    return prompt[:40]


def _strong_stand_in(prompt: str) -> str:
    return prompt + " " + prompt


@register("R8_cascade_with_models", with_views(["chat_requests"], f"""
select request_id, model_used, round(score, 6) as weak_quality_score, strong_called, werr as weak_failed,
       pt::bigint as prompt_tokens, {_toks('resp')}::bigint as completion_tokens,
       (case when model_used in ('weak', 'weak_then_strong') then pt else 0 end)::bigint as weak_input,
       (case when model_used in ('weak', 'weak_then_strong') then {_toks('wr')} else 0 end)::bigint as weak_output,
       (case when strong_called then pt else 0 end)::bigint as strong_input,
       (case when strong_called then {_toks('sr')} else 0 end)::bigint as strong_output,
       round(((case when model_used in ('weak', 'weak_then_strong') then pt else 0 end) * 5e-1
              + (case when model_used in ('weak', 'weak_then_strong') then {_toks('wr')} else 0 end) * 15e-1
              + (case when strong_called then pt else 0 end) * 1e1
              + (case when strong_called then {_toks('sr')} else 0 end) * 3e1) / 1e6, 9) as cost_usd
from (select *, case when strong_called then prompt || ' ' || prompt end as sr,
             case when strong_called then prompt || ' ' || prompt else wr end as resp
      from (select *, model_used in ('strong', 'weak_then_strong') as strong_called
            from (select *, case when force_model in ('weak', 'strong') then force_model
                                 when score < 6e-1 then 'weak_then_strong' else 'weak' end as model_used
                  from (select *, case when force_model is null and not coalesce(disable_evaluator, false) and not werr
                                       then case when len({_wset('prompt')}) = 0 then null
                                                 else len(list_intersect({_wset('prompt')}, {_wset('wr')})) / len({_wset('prompt')}) end
                                  end as score
                        from (select *, {_toks('prompt')} as pt,
                                     case when need_weak and length(prompt) % 13 <> 0 then substr(prompt, 1, 40) else '' end as wr,
                                     coalesce(need_weak and length(prompt) % 13 = 0, false) as werr
                              from (select *, not coalesce(force_model = 'strong', false) as need_weak from r) a) b) c) d) e) f""",
                                                     extra=[("r", """
select u.conv_id * 4294967296 + u.turn as request_id, u.text as prompt, c.force_model, c.disable_evaluator
from conversations u join chat_requests c on c.request_id = u.conv_id where u.role = 'user'""")]))
def r8_models(spark, sf):
    """The cascade calling injected models: weak only where the weak path is taken, strong only where needed."""
    d = R.cascade_with_models(_model_requests(spark, sf), _weak_stand_in, _strong_stand_in,
                              lambda p, r: word_containment(p, r), None, threshold=0.6)
    return rounded(d.select("request_id", "model_used", "weak_quality_score", "strong_called",
                            F.col("weak_response_error").isNotNull().alias("weak_failed"), "prompt_tokens",
                            "completion_tokens", "weak_input", "weak_output", "strong_input", "strong_output",
                            "cost_usd"), ("cost_usd",))


_Q_CHECKS = (
    ("messages", "coalesce(n, 0) < 1"),
    ("messages.role", "coalesce(bad, 0) > 0"),
    ("temperature", "not (temperature between 0 and 2)"),
    ("top_p", "not (top_p between 0 and 1)"),
    ("max_tokens", "max_tokens < 1"),
    ("force_model", "force_model is not null and force_model not in ('weak', 'strong')"),
)


@register("P8_quarantine_reasons", with_views(["chat_requests"], " union all ".join(
    f"select '{f}' as field, count(*)::bigint as requests from r where {c} having count(*) > 0" for f, c in _Q_CHECKS),
    extra=[("r", """
select c.*, m.n, m.bad from chat_requests c
left join (select conv_id, count(*) as n,
                  count(*) filter (where role is null or role not in ('system', 'user', 'assistant')) as bad
           from conversations group by conv_id) m on m.conv_id = c.request_id""")]))
def p8_quarantine(spark, sf):
    """The quarantine side of P8: requests per failed check (one request can fail several)."""
    _, bad = Q.split_valid(fx.chat_requests(spark, sf, with_messages=True))
    return (bad.select(F.explode("errors").alias("e")).groupBy(F.col("e.field").alias("field"))
            .agg(F.count(F.lit(1)).alias("requests")))
