"""Routing cost/quality metrics (A1-A3) and cost functions.

Every metric group is two passes over the results table, whatever the number of metrics: one aggregation (partial on each partition, a
single tiny final merge), and one for all exact percentiles together (one stacked layout of value counts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escalade.functions.joins import attach_row
from escalade.functions.quantiles import percentile_columns, stacked_percentiles, valid
from escalade.schemas import BLENDED_STRONG_PER_M, Prices

TOKEN_FIELDS = ("weak_input", "weak_output", "strong_input", "strong_output")

COUNT_METRICS = ("total_requests", "weak_only", "strong_only", "weak_then_strong")
COST_METRICS = ("total_requests", "weak_only", "strong_only", "weak_then_strong", "strong_percentage",
                "total_cost_usd", "avg_cost_per_request", "baseline_cost_usd", "cost_savings_pct",
                "avg_latency_ms", "p95_latency_ms", "evaluator_trigger_rate")


def token(df: DataFrame, name: str) -> Column:
    """A token count from a ``tokens_used`` struct or from a flat column; missing counts are 0."""
    if "tokens_used" in df.columns:
        return F.coalesce(F.col(f"tokens_used.{name}").cast("bigint"), F.lit(0))
    return F.coalesce(F.col(name).cast("bigint"), F.lit(0))


def request_cost(df: DataFrame, prices: Prices = Prices()) -> Column:
    """F8: sum of tokens x price / 1e6 over weak/strong x input/output."""
    return (token(df, "weak_input") * prices.weak_input + token(df, "weak_output") * prices.weak_output
            + token(df, "strong_input") * prices.strong_input
            + token(df, "strong_output") * prices.strong_output) / F.lit(1e6)


def request_cost_joined(df: DataFrame, prices_df: DataFrame) -> DataFrame:
    """F8 through J2: per-request cost from a (model, input_per_m, output_per_m) price table.

    The price table holds one row per model tier; it is broadcast (its size is the number of tiers).
    """
    p = prices_df.select("model", "input_per_m", "output_per_m")
    tiers = F.broadcast(p.groupBy().pivot("model", ["weak", "strong"])
                        .agg(F.first("input_per_m").alias("in"), F.first("output_per_m").alias("out")))
    j = df.withColumn("_one", F.lit(1)).join(tiers.withColumn("_one", F.lit(1)), "_one", "left")
    cost = (token(df, "weak_input") * F.col("weak_in") + token(df, "weak_output") * F.col("weak_out")
            + token(df, "strong_input") * F.col("strong_in")
            + token(df, "strong_output") * F.col("strong_out")) / F.lit(1e6)
    return j.withColumn("request_cost_usd", cost).drop("weak_in", "weak_out", "strong_in", "strong_out", "_one")


def baseline_cost(df: DataFrame, mode: str = "blended", strong_cost: float = BLENDED_STRONG_PER_M,
                  prices: Prices = Prices()) -> Column:
    """what the request would cost on the strong model alone.

    ``blended`` (the reference's analysis, default): every token at one blended strong price.
    ``split``: input and output tokens at the strong tier's own prices.
    """
    tin = token(df, "weak_input") + token(df, "strong_input")
    tout = token(df, "weak_output") + token(df, "strong_output")
    if mode == "blended":
        return tin * F.lit(strong_cost) / F.lit(1e6) + tout * F.lit(strong_cost) / F.lit(1e6)
    if mode == "split":
        return tin * F.lit(prices.strong_input) / F.lit(1e6) + tout * F.lit(prices.strong_output) / F.lit(1e6)
    raise ValueError(f"unknown baseline mode {mode!r}")


def _pct(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double") * F.lit(100.0), den.cast("double"))


QUALITY_SCORE_METRICS = ("avg_weak_quality_score", "median_weak_quality_score", "min_weak_quality_score",
                         "max_weak_quality_score")
LENGTH_METRICS = ("avg_response_length", "median_response_length")


def _metric_pass(results: DataFrame, routing: bool, quality: bool, strong_cost: float = BLENDED_STRONG_PER_M,
                 baseline: str = "blended", prices: Prices = Prices(), percentile_method: str = "counts") -> DataFrame:
    """The routing metrics (A1) and/or the quality metrics (A2) in one ``agg``.

    The inputs of every metric are projected once (``_lat``, ``_s``, ``_rl``, ``_base``). Exact percentiles of all columns come from one
    second pass, stacked as (column, value) and laid out once, and are attached as one row.
    """
    has_score = quality and "weak_quality_score" in results.columns
    has_resp = quality and "response" in results.columns
    cols = []
    if routing:
        cols += [F.col("model_used"), F.col("cost_usd"),
                 baseline_cost(results, baseline, strong_cost, prices).alias("_base"),
                 F.when(valid("latency_ms"), F.col("latency_ms")).alias("_lat")]
    if has_score:
        cols.append(F.when(valid("weak_quality_score"), F.col("weak_quality_score")).alias("_s"))
    if has_resp:
        cols.append(F.length("response").cast("double").alias("_rl"))
    if not cols:
        return results.sparkSession.range(1).select()
    src = results.select(*cols)
    aggs, pct = [], {}
    if routing:
        mu = F.col("model_used")
        aggs += [F.count(F.lit(1)).alias("total_requests"), F.count_if(mu == "weak").alias("weak_only"),
                 F.count_if(mu == "strong").alias("strong_only"),
                 F.count_if(mu == "weak_then_strong").alias("weak_then_strong"),
                 F.sum("cost_usd").alias("total_cost_usd"), F.sum("_base").alias("baseline_cost_usd"),
                 F.avg("_lat").alias("avg_latency_ms")]
        pct["_lat"] = ("p95_latency_ms", 0.95)
    if has_score:
        aggs += [F.avg("_s").alias("avg_weak_quality_score"), F.min("_s").alias("min_weak_quality_score"),
                 F.max("_s").alias("max_weak_quality_score")]
        pct["_s"] = ("median_weak_quality_score", 0.5)
    if has_resp:
        aggs.append(F.avg("_rl").alias("avg_response_length"))
        pct["_rl"] = ("median_response_length", 0.5)
    if percentile_method != "counts":
        for c, (name, p) in pct.items():
            aggs += percentile_columns(c, {name: p}, percentile_method)
    out = src.agg(*aggs)
    if pct and percentile_method == "counts":
        out = attach_row(out, stacked_percentiles(src, {c: {name: p} for c, (name, p) in pct.items()}))
    return out


def _routing_columns() -> list[Column]:
    n = F.col("total_requests")
    return [
        "total_requests", "weak_only", "strong_only", "weak_then_strong",
        _pct(F.col("strong_only") + F.col("weak_then_strong"), n).alias("strong_percentage"),
        "total_cost_usd",
        F.try_divide(F.col("total_cost_usd"), n.cast("double")).alias("avg_cost_per_request"),
        "baseline_cost_usd",
        F.try_divide((F.col("baseline_cost_usd") - F.col("total_cost_usd")) * F.lit(100.0),
                     F.col("baseline_cost_usd")).alias("cost_savings_pct"),
        "avg_latency_ms", "p95_latency_ms",
        _pct(F.col("weak_then_strong"), n).alias("evaluator_trigger_rate"),
    ]


def _quality_columns(df: DataFrame) -> list[str]:
    return [m for m in (*QUALITY_SCORE_METRICS, *LENGTH_METRICS) if m in df.columns]


def routing_metrics(results: DataFrame, strong_cost: float = BLENDED_STRONG_PER_M, baseline: str = "blended",
                    prices: Prices = Prices(), percentile_method: str = "counts") -> DataFrame:
    """A1: twelve routing metrics in one row. Unknown ``model_used`` values count in the total only."""
    out = _metric_pass(results, True, False, strong_cost, baseline, prices, percentile_method)
    return out.select(*_routing_columns())


def quality_metrics(results: DataFrame, percentile_method: str = "counts") -> DataFrame:
    """A2: score statistics over evaluated rows and response-length statistics; absent columns are skipped."""
    out = _metric_pass(results, False, True, percentile_method=percentile_method)
    return out.select(*_quality_columns(out))


def combined_metrics(results: DataFrame, **kw) -> DataFrame:
    """A1 and A2 side by side in one wide row (the saved metrics file), from the same two passes."""
    out = _metric_pass(results, True, True, **kw)
    return out.select(*_routing_columns(), *_quality_columns(out))


# Fixed display formats of the text report.
_FORMATS = {
    "total_requests": "count", "weak_only": "count", "strong_only": "count", "weak_then_strong": "count",
    "strong_percentage": "pct1", "evaluator_trigger_rate": "pct1", "cost_savings_pct": "pct1",
    "total_cost_usd": "usd2", "baseline_cost_usd": "usd2", "avg_cost_per_request": "usd4",
    "avg_latency_ms": "ms0", "p95_latency_ms": "ms0",
}


def format_value(metric: Column, value: Column) -> Column:
    """count with thousands separator, % with one decimal, $ with 2 or 4, ms with 0, quality with 3; ties go to the
    even digit (Java's formatter alone would round them up)."""
    expr = F.format_string("%.3f", F.bround(value, 3))
    for kind, fmt, digits in (("count", None, 0), ("pct1", "%.1f%%", 1), ("usd2", "$%.2f", 2), ("usd4", "$%.4f", 4),
                              ("ms0", "%.0fms", 0)):
        names = [m for m, k in _FORMATS.items() if k == kind]
        shown = F.format_number(value, 0) if fmt is None else F.format_string(fmt, F.bround(value, digits))
        expr = F.when(metric.isin(*names), shown).otherwise(expr)
    return F.when(value.isNull(), F.lit(None)).otherwise(expr)


def metrics_report(results: DataFrame, **kw) -> DataFrame:
    """A3: long report table ``(section, metric, value, formatted)``; the quality section is absent when empty."""
    wide = combined_metrics(results, **kw)
    cols = [c for c in wide.columns]
    long = wide.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], cols, "metric", "value")
    section = (F.when(F.col("metric").isin(*COUNT_METRICS, "strong_percentage", "evaluator_trigger_rate"), "routing")
               .when(F.col("metric").isin("total_cost_usd", "avg_cost_per_request", "baseline_cost_usd",
                                          "cost_savings_pct"), "cost")
               .when(F.col("metric").isin("avg_latency_ms", "p95_latency_ms"), "performance")
               .otherwise("quality"))
    return long.select(section.alias("section"), "metric", "value",
                       format_value(F.col("metric"), F.col("value")).alias("formatted"))
