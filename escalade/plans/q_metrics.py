"""Registered queries: routing metrics, quality metrics, report, cost functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from escalade.operators import metrics as M
from escalade.plans.catalog import register, rounded
from escalade.plans.oracle_views import with_views
from escalade.sources import fixtures as fx

MONEY = ("total_cost_usd", "avg_cost_per_request", "baseline_cost_usd", "cost_usd", "request_cost_usd",
         "baseline_cost", "total_cost", "avg_cost", "sum_cost", "mean_cost", "savings_usd")

_A1_SQL = with_views(["routing_results"], """
select count(*)::bigint as total_requests,
       count(*) filter (where model_used = 'weak')::bigint as weak_only,
       count(*) filter (where model_used = 'strong')::bigint as strong_only,
       count(*) filter (where model_used = 'weak_then_strong')::bigint as weak_then_strong,
       round((count(*) filter (where model_used = 'strong') + count(*) filter (where model_used = 'weak_then_strong')) * 1e2 / count(*), 6) as strong_percentage,
       round(sum(cost_usd), 9) as total_cost_usd,
       round(sum(cost_usd) / count(*), 9) as avg_cost_per_request,
       round(sum((weak_input + strong_input) * 1e1 / 1e6 + (weak_output + strong_output) * 1e1 / 1e6), 9) as baseline_cost_usd,
       round((sum((weak_input + strong_input) * 1e1 / 1e6 + (weak_output + strong_output) * 1e1 / 1e6) - sum(cost_usd)) * 1e2
             / sum((weak_input + strong_input) * 1e1 / 1e6 + (weak_output + strong_output) * 1e1 / 1e6), 6) as cost_savings_pct,
       round(avg(latency_ms), 6) as avg_latency_ms,
       round(quantile_cont(latency_ms, 95e-2), 6) as p95_latency_ms,
       round(count(*) filter (where model_used = 'weak_then_strong') * 1e2 / count(*), 6) as evaluator_trigger_rate
from routing_results""")


@register("A1_routing_metrics", _A1_SQL)
def a1_routing_metrics(spark, sf):
    return rounded(M.routing_metrics(fx.routing_results(spark, sf)), MONEY)


@register("A1_routing_metrics_split_baseline", _A1_SQL.replace(
    "(weak_output + strong_output) * 1e1 / 1e6", "(weak_output + strong_output) * 3e1 / 1e6"))
def a1_split(spark, sf):
    return rounded(M.routing_metrics(fx.routing_results(spark, sf), baseline="split"), MONEY)


@register("A1_routing_metrics_rank_percentile", _A1_SQL)
def a1_rank(spark, sf):
    """Same metrics through the distributed rank-based exact percentile (the path used for huge groups)."""
    return rounded(M.routing_metrics(fx.routing_results(spark, sf), percentile_method="counts"), MONEY)


_A2_SQL = with_views(["routing_results"], """
select round(avg(weak_quality_score), 6) as avg_weak_quality_score,
       round(quantile_cont(weak_quality_score, 5e-1), 6) as median_weak_quality_score,
       round(min(weak_quality_score), 6) as min_weak_quality_score,
       round(max(weak_quality_score), 6) as max_weak_quality_score,
       round(avg(length(response)), 6) as avg_response_length,
       round(quantile_cont(length(response), 5e-1), 6) as median_response_length
from routing_results""")


@register("A2_quality_metrics", _A2_SQL)
def a2_quality_metrics(spark, sf):
    return rounded(M.quality_metrics(fx.routing_results(spark, sf)))


_METRICS_ROW = """
  select count(*)::double as total_requests,
         (count(*) filter (where model_used = 'weak'))::double as weak_only,
         (count(*) filter (where model_used = 'strong'))::double as strong_only,
         (count(*) filter (where model_used = 'weak_then_strong'))::double as weak_then_strong,
         (count(*) filter (where model_used = 'strong') + count(*) filter (where model_used = 'weak_then_strong')) * 1e2 / count(*) as strong_percentage,
         sum(cost_usd) as total_cost_usd,
         sum(cost_usd) / count(*) as avg_cost_per_request,
         sum((weak_input + strong_input) * 1e1 / 1e6 + (weak_output + strong_output) * 1e1 / 1e6) as baseline_cost_usd,
         (sum((weak_input + strong_input) * 1e1 / 1e6 + (weak_output + strong_output) * 1e1 / 1e6) - sum(cost_usd)) * 1e2
             / sum((weak_input + strong_input) * 1e1 / 1e6 + (weak_output + strong_output) * 1e1 / 1e6) as cost_savings_pct,
         avg(latency_ms) as avg_latency_ms,
         quantile_cont(latency_ms, 95e-2) as p95_latency_ms,
         (count(*) filter (where model_used = 'weak_then_strong')) * 1e2 / count(*) as evaluator_trigger_rate,
         avg(weak_quality_score) as avg_weak_quality_score,
         quantile_cont(weak_quality_score, 5e-1) as median_weak_quality_score,
         min(weak_quality_score) as min_weak_quality_score,
         max(weak_quality_score) as max_weak_quality_score,
         avg(length(response)) as avg_response_length,
         quantile_cont(length(response), 5e-1)::double as median_response_length
  from routing_results"""

_A3_SQL = with_views(["routing_results"], """
select case when metric in ('total_requests', 'weak_only', 'strong_only', 'weak_then_strong', 'strong_percentage', 'evaluator_trigger_rate') then 'routing'
            when metric in ('total_cost_usd', 'avg_cost_per_request', 'baseline_cost_usd', 'cost_savings_pct') then 'cost'
            when metric in ('avg_latency_ms', 'p95_latency_ms') then 'performance'
            else 'quality' end as section,
       metric,
       case when metric in ('total_cost_usd', 'avg_cost_per_request', 'baseline_cost_usd') then round(value, 9) else round(value, 6) end as value
from (unpivot m on columns(*) into name metric value value) u""", extra=[("m", _METRICS_ROW)])


@register("A3_metrics_report", _A3_SQL)
def a3_metrics_report(spark, sf):
    r = M.metrics_report(fx.routing_results(spark, sf))
    value = (F.when(F.col("metric").isin("total_cost_usd", "avg_cost_per_request", "baseline_cost_usd"),
                    F.round("value", 9)).otherwise(F.round("value", 6)))
    return r.select("section", "metric", value.alias("value"))


@register("F8_request_cost", with_views(["routing_results", "prices"], """
select request_id,
       round((weak_input * (select input_per_m from prices where model = 'weak')
            + weak_output * (select output_per_m from prices where model = 'weak')
            + strong_input * (select input_per_m from prices where model = 'strong')
            + strong_output * (select output_per_m from prices where model = 'strong')) / 1e6, 9) as request_cost_usd,
       round(cost_usd, 9) as cost_usd
from routing_results"""))
def f8_request_cost(spark, sf):
    rr = fx.routing_results(spark, sf)
    j = M.request_cost_joined(rr, fx.prices_df(spark))
    return rounded(j.select("request_id", "request_cost_usd", "cost_usd"), MONEY)


@register("F9_baseline_cost", with_views(["routing_results"], """
select model_used, count(*)::bigint as n,
       round(sum((weak_input + strong_input) * 1e1 / 1e6 + (weak_output + strong_output) * 1e1 / 1e6), 9) as baseline_blended,
       round(sum((weak_input + strong_input) * 1e1 / 1e6 + (weak_output + strong_output) * 3e1 / 1e6), 9) as baseline_split
from routing_results group by model_used"""))
def f9_baseline_cost(spark, sf):
    rr = fx.routing_results(spark, sf)
    out = rr.groupBy("model_used").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(M.baseline_cost(rr, "blended")).alias("baseline_blended"),
        F.sum(M.baseline_cost(rr, "split")).alias("baseline_split"))
    return rounded(out, ("baseline_blended", "baseline_split"))


@register("F14_format_report_fields", with_views(["routing_results"], """
select count(*)::bigint as total_requests,
       format('{:,}', count(*)::bigint) as total_requests_fmt,
       printf('$%.2f', sum(cost_usd)) as total_cost_fmt,
       printf('%.0fms', round(avg(latency_ms), 6)) as avg_latency_fmt
from routing_results"""))
def f14_format(spark, sf):
    a = M.routing_metrics(fx.routing_results(spark, sf))
    return a.select(
        "total_requests",
        M.format_value(F.lit("total_requests"), F.col("total_requests").cast("double")).alias("total_requests_fmt"),
        M.format_value(F.lit("total_cost_usd"), F.col("total_cost_usd")).alias("total_cost_fmt"),
        M.format_value(F.lit("avg_latency_ms"), F.round("avg_latency_ms", 6)).alias("avg_latency_fmt"))


@register("A3_metrics_wide", with_views(["routing_results"], """
select total_requests::bigint as total_requests, weak_only::bigint as weak_only, strong_only::bigint as strong_only,
       weak_then_strong::bigint as weak_then_strong, round(strong_percentage, 6) as strong_percentage,
       round(total_cost_usd, 9) as total_cost_usd, round(avg_cost_per_request, 9) as avg_cost_per_request,
       round(baseline_cost_usd, 9) as baseline_cost_usd, round(cost_savings_pct, 6) as cost_savings_pct,
       round(avg_latency_ms, 6) as avg_latency_ms, round(p95_latency_ms, 6) as p95_latency_ms,
       round(evaluator_trigger_rate, 6) as evaluator_trigger_rate,
       round(avg_weak_quality_score, 6) as avg_weak_quality_score,
       round(median_weak_quality_score, 6) as median_weak_quality_score,
       round(min_weak_quality_score, 6) as min_weak_quality_score,
       round(max_weak_quality_score, 6) as max_weak_quality_score,
       round(avg_response_length, 6) as avg_response_length, round(median_response_length, 6) as median_response_length
from m""", extra=[("m", _METRICS_ROW)]))
def a3_wide(spark, sf):
    """A1 and A2 as the one-row metrics record the reference saves (one scan of the results)."""
    return rounded(M.combined_metrics(fx.routing_results(spark, sf)), MONEY)
