"""Registered queries: notebook analytics (A5-A16, L2) over the routing results."""

from __future__ import annotations

from pyspark.sql import functions as F

from escalade.operators import reports as R
from escalade.plans.catalog import register, rounded
from escalade.plans.oracle_views import with_views
from escalade.sources import fixtures as fx

RR = ["routing_results"]
_VALID_Q = "weak_quality_score is not null and not isnan(weak_quality_score)"


@register("A5_routing_distribution", with_views(RR, """
select model_used, count(*)::bigint as count, round(count(*) * 1e2 / sum(count(*)) over (), 6) as pct
from routing_results group by model_used"""))
def a5(spark, sf):
    return rounded(R.routing_distribution(fx.routing_results(spark, sf)))


_A6 = with_views(RR, """
select 'Smart Router' as strategy, round(t, 9) as total_cost, round(m, 9) as avg_cost,
       round(t * 25e-1 - t, 9) as savings_usd, round((t * 25e-1 - t) * 1e2 / (t * 25e-1), 6) as savings_pct from a
union all
select 'Always Strong (Baseline)', round(t * 25e-1, 9), round(t * 25e-1 / n, 9),
       round(t * 25e-1 - t, 9), round((t * 25e-1 - t) * 1e2 / (t * 25e-1), 6) from a""",
                 extra=[("a", "select sum(cost_usd) as t, avg(cost_usd) as m, count(*) as n from routing_results")])


@register("A6_cost_comparison", _A6)
def a6(spark, sf):
    return rounded(R.cost_comparison(fx.routing_results(spark, sf)), ("total_cost", "avg_cost", "savings_usd"))


@register("A7_cost_by_decision", with_views(RR, """
select model_used, round(sum(cost_usd), 9) as sum_cost, round(avg(cost_usd), 9) as mean_cost, count(*)::bigint as count,
       round(sum(cost_usd) * 1e2 / sum(sum(cost_usd)) over (), 6) as total_contribution
from routing_results group by model_used"""))
def a7(spark, sf):
    return rounded(R.cost_by_decision(fx.routing_results(spark, sf)), ("sum_cost", "mean_cost"))


@register("A8_quality_summary", with_views(RR, f"""
select count(*)::bigint as evaluated, round(avg(weak_quality_score), 6) as mean_score,
       round(quantile_cont(weak_quality_score, 5e-1), 6) as median_score
from routing_results where {_VALID_Q}"""))
def a8(spark, sf):
    return rounded(R.quality_summary(fx.routing_results(spark, sf)))


def _hist_sql(col: str, bins: int, group: str | None, density: bool = False) -> str:
    gsel = f"{group} as g, " if group else ""
    gby = "g, " if group else ""
    gjoin = "using (g)" if group else "on true"
    out_g = f"r.g as {group}, " if group else ""
    cond = "and c.g = r.g" if group else ""
    if density:
        tail = ("coalesce(c.cnt, 0)::bigint as count, "
                "round(case when r.w > 0 then coalesce(c.cnt, 0) / (r.n * r.w) end, 6) as density")
    else:
        tail = "coalesce(c.cnt, 0)::bigint as count, r.n::bigint as n, round(r.w, 6) as width"
    return with_views(RR, f"""
select {out_g}cast(s.bin as bigint) as bin, round(r.lo + s.bin * r.w, 6) as bin_lo,
       round(r.lo + (s.bin + 1) * r.w, 6) as bin_hi, {tail}
from r cross join range({bins}) s(bin)
left join c on c.bin = s.bin {cond}""", extra=[
        ("v", f"select {gsel}{col} as x from routing_results where {col} is not null and not isnan({col})"),
        ("r", f"select {gby}min(x) as lo, max(x) as hi, count(*) as n, (max(x) - min(x)) / {bins}e0 as w "
              f"from v {'group by g' if group else ''}"),
        ("c", f"select {gby}case when w = 0 then 0 else least(cast(floor((x - lo) / w) as bigint), {bins - 1}) end "
              f"as bin, count(*) as cnt from v join r {gjoin} group by all"),
    ])


@register("A9_histogram_quality", _hist_sql("weak_quality_score", 50, None))
def a9(spark, sf):
    return rounded(R.histogram(fx.routing_results(spark, sf), "weak_quality_score", 50))


@register("A9_threshold_counts", with_views(RR, f"""
select count(*) filter (where weak_quality_score < 7e-1)::bigint as below,
       count(*) filter (where weak_quality_score >= 7e-1)::bigint as at_or_above
from routing_results where {_VALID_Q}"""))
def a9b(spark, sf):
    return R.threshold_counts(fx.routing_results(spark, sf), "weak_quality_score", 0.7)


def _box_sql(col: str) -> str:
    return with_views(RR, """
select v.g as model_used, count(*)::bigint as n, round(min(x), 6) as min, round(any_value(q1), 6) as q1,
       round(any_value(median), 6) as median, round(any_value(q3), 6) as q3, round(max(x), 6) as max,
       round(any_value(iqr), 6) as iqr, round(any_value(lf), 6) as lower_fence, round(any_value(uf), 6) as upper_fence,
       round(min(x) filter (where x >= lf and x <= uf), 6) as whisker_low,
       round(max(x) filter (where x >= lf and x <= uf), 6) as whisker_high,
       count(*) filter (where not (x >= lf and x <= uf))::bigint as outliers
from v join f using (g) group by v.g""", extra=[
        ("v", f"select model_used as g, {col}::double as x from routing_results where {col} is not null and not isnan({col})"),
        ("q", "select g, quantile_cont(x, 25e-2) as q1, quantile_cont(x, 5e-1) as median, quantile_cont(x, 75e-2) as q3 "
              "from v group by g"),
        ("f", "select *, q3 - q1 as iqr, q1 - 15e-1 * (q3 - q1) as lf, q3 + 15e-1 * (q3 - q1) as uf from q"),
    ])


@register("A10_box_stats_quality", _box_sql("weak_quality_score"))
def a10(spark, sf):
    return rounded(R.box_stats(fx.routing_results(spark, sf), "model_used", "weak_quality_score"))


@register("A10_box_stats_latency", _box_sql("latency_ms"))
def a10b(spark, sf):
    return rounded(R.box_stats(fx.routing_results(spark, sf), "model_used", "latency_ms"))


@register("A10_box_stats_latency_rank", _box_sql("latency_ms"))
def a10c(spark, sf):
    return rounded(R.box_stats(fx.routing_results(spark, sf), "model_used", "latency_ms", percentile_method="counts"))


@register("A11_latency_stats", with_views(RR, """
select model_used, round_even(avg(latency_ms), 0) as mean, round_even(quantile_cont(latency_ms, 5e-1), 0) as median,
       round_even(quantile_cont(latency_ms, 95e-2), 0) as p95, round_even(quantile_cont(latency_ms, 99e-2), 0) as p99
from routing_results where latency_ms is not null and not isnan(latency_ms) group by model_used"""))
def a11(spark, sf):
    return rounded(R.latency_stats(fx.routing_results(spark, sf)))


@register("A12_distribution_by_group", _hist_sql("latency_ms", 50, "model_used", density=True))
def a12(spark, sf):
    return rounded(R.distribution_by_group(fx.routing_results(spark, sf), "latency_ms", "model_used", 50))


def _sweep_sql(on: str) -> str:
    strong = ("(model_used = 'strong' or (ok and weak_quality_score < threshold))" if on == "weak_quality_score"
              else "(routing_score is not null and not isnan(routing_score) and routing_score >= threshold)")
    trig = "strong and ok and model_used <> 'strong'" if on == "weak_quality_score" else "false"
    return with_views(RR, f"""
select threshold, count(*) filter (where strong)::bigint as strong_n,
       round(count(*) filter (where strong) * 1e2 / count(*), 6) as strong_pct,
       round(sum(case when strong then (tin * 1e1 + tout * 3e1) / 1e6 else (tin * 5e-1 + tout * 15e-1) / 1e6 end), 9) as est_cost_usd,
       round(avg(case when not strong and ok then weak_quality_score end), 6) as avg_quality,
       round(count(*) filter (where {trig}) * 1e2 / count(*), 6) as trigger_rate
from x group by threshold""", extra=[
        ("t", "select i / 1e1 as threshold from range(1, 10) r(i)"),
        ("rr", f"select *, weak_input + strong_input as tin, weak_output + strong_output as tout, "
               f"coalesce({_VALID_Q}, false) as ok from routing_results"),
        ("x", f"select t.threshold, rr.*, coalesce({strong}, false) as strong from t cross join rr"),
    ])


@register("A13_threshold_sweep_quality", _sweep_sql("weak_quality_score"))
def a13(spark, sf):
    return rounded(R.threshold_sweep(fx.routing_results(spark, sf), on="weak_quality_score"), ("est_cost_usd",))


@register("A13_threshold_sweep_router", _sweep_sql("routing_score"))
def a13b(spark, sf):
    return rounded(R.threshold_sweep(fx.routing_results(spark, sf), on="routing_score"), ("est_cost_usd",))


@register("A14_operating_point", _sweep_sql("weak_quality_score").replace(
    "from x group by threshold", "from x group by threshold order by abs(threshold - 7e-1), threshold limit 1"))
def a14(spark, sf):
    sweep = R.threshold_sweep(fx.routing_results(spark, sf), on="weak_quality_score")
    return rounded(R.operating_point(sweep, 0.7), ("est_cost_usd",))


@register("A15_score_cost_correlation", with_views(RR, """
select round(corr(routing_score, cost_usd), 6) as corr, count(*)::bigint as n from routing_results
where routing_score is not null and not isnan(routing_score) and cost_usd is not null and not isnan(cost_usd)"""))
def a15(spark, sf):
    return rounded(R.score_cost_correlation(fx.routing_results(spark, sf)))


@register("A15_cost_by_score_bin", with_views(RR, """
select cast(least(floor(routing_score * 10), 9) as bigint) as score_bin, model_used, count(*)::bigint as n,
       round(round(sum(cost_usd), 9) / count(*), 9) as mean_cost
from routing_results where routing_score is not null and not isnan(routing_score) group by all"""))
def a15b(spark, sf):
    return rounded(R.cost_by_score_bin(fx.routing_results(spark, sf)), ("mean_cost",))


@register("A15_decision_matrix", with_views(RR, """
select routing_score >= 5e-1 as above_threshold, model_used, count(*)::bigint as n
from routing_results where routing_score is not null and not isnan(routing_score) group by all"""))
def a15c(spark, sf):
    return R.decision_matrix(fx.routing_results(spark, sf), 0.5)


@register("A16_kpi_summary", with_views(RR, """
select kpi, case when kpi in ('avg_cost_per_request', 'total_cost_usd') then round(value, 9) else round(value, 6) end as value
from (unpivot k on columns(*) into name kpi value value) u""", extra=[("k", """
select count(*)::double as total_requests, avg(cost_usd) as avg_cost_per_request, avg(latency_ms) as avg_latency_ms,
       count(*) filter (where model_used in ('strong', 'weak_then_strong')) * 1e2 / count(*) as strong_usage_pct,
       count(*) filter (where model_used = 'weak_then_strong') * 1e2 / count(*) as evaluator_trigger_rate,
       sum(cost_usd) as total_cost_usd,
       (avg(cost_usd) - avg(cost_usd) * 2) / (avg(cost_usd) * 2) as avg_cost_delta_vs_2x
from routing_results""")]))
def a16(spark, sf):
    k = R.kpi_summary(fx.routing_results(spark, sf))
    v = F.when(F.col("kpi").isin("avg_cost_per_request", "total_cost_usd"), F.round("value", 9)) \
        .otherwise(F.round("value", 6))
    return k.select("kpi", v.alias("value"))


@register("P10_evaluated_only", with_views(RR, f"""
select request_id, round(weak_quality_score, 6) as weak_quality_score from routing_results where {_VALID_Q}"""))
def p10(spark, sf):
    return rounded(R.evaluated_only(fx.routing_results(spark, sf)).select("request_id", "weak_quality_score"))


@register("L2_value_counts_order", with_views(RR, """
select model_used, count(*)::bigint as count, row_number() over (order by count(*) desc, model_used)::bigint as rank
from routing_results group by model_used"""))
def l2(spark, sf):
    return rounded(R.ranked_value_counts(fx.routing_results(spark, sf), "model_used"))


_J3_T = [i / 20 for i in range(1, 20)]


@register("J3_threshold_grid", with_views(RR, """
select threshold, count(*) filter (where strong)::bigint as strong_n,
       round(count(*) filter (where strong) * 1e2 / count(*), 6) as strong_pct,
       round(sum(case when strong then (tin * 1e1 + tout * 3e1) / 1e6 else (tin * 5e-1 + tout * 15e-1) / 1e6 end), 9) as est_cost_usd,
       round(avg(case when not strong and ok then weak_quality_score end), 6) as avg_quality,
       0e0 as trigger_rate
from x group by threshold""", extra=[
    ("t", "select i / 2e1 as threshold from range(1, 20) r(i)"),
    ("rr", "select *, weak_input + strong_input as tin, weak_output + strong_output as tout, "
           f"coalesce({_VALID_Q}, false) as ok from routing_results"),
    ("x", "select t.threshold, rr.*, coalesce(routing_score is not null and not isnan(routing_score) "
          "and routing_score >= threshold, false) as strong from t cross join rr"),
]))
def j3(spark, sf):
    """Rows x a 19-point threshold grid, evaluated without materialising the product (see A13)."""
    return rounded(R.threshold_sweep(fx.routing_results(spark, sf), _J3_T, on="routing_score"), ("est_cost_usd",))
