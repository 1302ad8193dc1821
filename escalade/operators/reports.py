"""Dashboard data behind every chart of the analysis notebook.

Shares of a total are computed on the *aggregated* table (one row per group), never with a window over raw
rows. Group statistics are joined back to rows by plain joins (AQE broadcasts small sides and splits skewed keys),
so a hot group (one decision holding a third of all requests) never becomes one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escalade.functions.joins import attach_row
from escalade.functions.ordinals import global_ordinals
from escalade.functions.quantiles import percentile_columns, percentiles, percentiles_by_counts, valid
from escalade.operators.metrics import baseline_cost, token
from escalade.schemas import Prices

DEFAULT_THRESHOLDS = tuple(i / 10 for i in range(1, 10))  # integer tenths: 0.7 is exactly 7/10


def _share(count_col: str, total: Column) -> Column:
    return F.try_divide(F.col(count_col).cast("double") * F.lit(100.0), total.cast("double"))


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """L2: count per key, ordered by count descending then key (value_counts order)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.col(key))


def ranked_value_counts(df: DataFrame, key: str) -> DataFrame:
    """L2 with the order made explicit: ``rank`` 1 = most frequent (ties by key); ranked by range on the aggregated table."""
    c = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    return global_ordinals(c, [F.desc("count"), F.col(key)], "_at").select(key, "count", (F.col("_at") + 1).alias("rank"))


def evaluated_only(results: DataFrame, score: str = "weak_quality_score") -> DataFrame:
    """P10: rows whose quality score is present (not NULL, not NaN)."""
    return results.where(valid(score))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """A4: rows per label."""
    return value_counts(df, label)


def routing_distribution(results: DataFrame) -> DataFrame:
    """A5: count and share (%) per routing decision, descending."""
    c = results.groupBy("model_used").agg(F.count(F.lit(1)).alias("count"))
    tot = Window.partitionBy()  # over the aggregated table: one row per decision
    return (c.withColumn("pct", _share("count", F.sum("count").over(tot)))
            .orderBy(F.desc("count"), F.col("model_used")))


def cost_comparison(results: DataFrame, multiplier: float = 2.5) -> DataFrame:
    """Router versus the notebook's "always strong" placeholder (total x multiplier)."""
    a = results.agg(F.sum("cost_usd").alias("t"), F.avg("cost_usd").alias("m"), F.count(F.lit(1)).alias("n"))
    base = F.col("t") * F.lit(multiplier)
    rows = F.array(
        F.struct(F.lit("Smart Router").alias("strategy"), F.col("t").alias("total_cost"),
                 F.col("m").alias("avg_cost")),
        F.struct(F.lit("Always Strong (Baseline)").alias("strategy"), base.alias("total_cost"),
                 F.try_divide(base, F.col("n").cast("double")).alias("avg_cost")))
    out = a.select(F.inline(rows), (base - F.col("t")).alias("savings_usd"),
                   F.try_divide((base - F.col("t")) * F.lit(100.0), base).alias("savings_pct"))
    return out


def cost_by_decision(results: DataFrame) -> DataFrame:
    """Sum, mean, count and % contribution of cost per decision."""
    g = results.groupBy("model_used").agg(F.sum("cost_usd").alias("sum_cost"), F.avg("cost_usd").alias("mean_cost"),
                                          F.count(F.lit(1)).alias("count"))
    return g.withColumn("total_contribution", _share("sum_cost", F.sum("sum_cost").over(Window.partitionBy())))


def quality_summary(results: DataFrame, percentile_method: str = "counts") -> DataFrame:
    """Evaluated rows, mean and median quality score."""
    ev = results.select(F.when(valid("weak_quality_score"), F.col("weak_quality_score")).alias("weak_quality_score"))
    aggs = [F.count("weak_quality_score").alias("evaluated"), F.avg("weak_quality_score").alias("mean_score")]
    if percentile_method == "counts":
        return attach_row(ev.agg(*aggs), percentiles_by_counts(ev, "weak_quality_score", {"median_score": 0.5}))
    return ev.agg(*aggs, *percentile_columns("weak_quality_score", {"median_score": 0.5}, percentile_method))


def histogram(df: DataFrame, col: str, bins: int = 50, by: list[str] | tuple[str, ...] = (),
              include_empty: bool = True) -> DataFrame:
    """Equal-width bins over [min, max] (per group when ``by`` is given); the top edge falls in the last bin.

    Two passes: min/max per group (partial aggregation), then a bin id per row and a count per (group, bin).
    Output: by..., bin, bin_lo, bin_hi, count, n (group size), width.
    """
    by = list(by)
    # invalid values become NULL instead of being filtered: no predicate is pushed below the projection that
    # computes the column (which would evaluate its expression twice); NULLs drop out of min/max/count and bins
    v = df.select(*by, F.when(valid(col), F.col(col).cast("double")).alias("_x"))
    rng = (v.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("_x").alias("n"))
           .where(F.col("n") > 0))
    rng = rng.withColumn("width", (F.col("_hi") - F.col("_lo")) / F.lit(float(bins)))
    j = v.join(rng, by, "inner") if by else attach_row(v, rng)
    b = (F.when(F.col("_x").isNull(), F.lit(None)).when(F.col("width") == 0, F.lit(0))
         .otherwise(F.least(F.floor((F.col("_x") - F.col("_lo")) / F.col("width")), F.lit(bins - 1))).cast("int"))
    counts = j.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("count")).where(F.col("bin").isNotNull())
    if include_empty:
        grid = rng.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        counts = grid.join(counts, [*by, "bin"], "left").fillna(0, ["count"])
    counts = counts.join(rng, by) if by else attach_row(counts, rng)
    return counts.select(*by, "bin",
                         (F.col("_lo") + F.col("bin") * F.col("width")).alias("bin_lo"),
                         (F.col("_lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_hi"),
                         F.col("count").cast("bigint").alias("count"), "n", "width")


def threshold_counts(df: DataFrame, col: str, threshold: float) -> DataFrame:
    """A9 companion: rows below / at-or-above the threshold line (escalation is strictly below)."""
    x = F.when(valid(col), F.col(col))
    return df.agg(F.count_if(x < threshold).alias("below"), F.count_if(x >= threshold).alias("at_or_above"))


def box_stats(df: DataFrame, group: str, col: str, percentile_method: str = "counts") -> DataFrame:
    """A10: five-number summary, IQR, 1.5*IQR fences, whiskers and outlier count per group."""
    v = df.where(valid(col)).select(group, F.col(col).cast("double").alias("_x"))
    q = percentiles(v, "_x", {"q1": 0.25, "median": 0.5, "q3": 0.75}, [group], percentile_method)
    q = q.select(group, "q1", "median", "q3", (F.col("q3") - F.col("q1")).alias("iqr"))
    q = q.select("*", (F.col("q1") - 1.5 * F.col("iqr")).alias("lower_fence"),
                 (F.col("q3") + 1.5 * F.col("iqr")).alias("upper_fence"))
    j = v.join(q, group)
    inside = (F.col("_x") >= F.col("lower_fence")) & (F.col("_x") <= F.col("upper_fence"))
    agg = j.groupBy(group).agg(
        F.min("_x").alias("min"), F.max("_x").alias("max"), F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))
    return agg.join(q, group).select(group, "n", "min", "q1", "median", "q3", "max", "iqr", "lower_fence",
                                     "upper_fence", "whisker_low", "whisker_high", "outliers")


def latency_stats(results: DataFrame, percentile_method: str = "counts") -> DataFrame:
    """Mean, median, P95, P99 latency per decision, rounded half-to-even to whole ms (pandas ``round``)."""
    m = results.where(valid("latency_ms")).groupBy("model_used").agg(F.avg("latency_ms").alias("mean"))
    p = percentiles(results, "latency_ms", {"median": 0.5, "p95": 0.95, "p99": 0.99}, ["model_used"],
                    percentile_method)
    j = m.join(p, "model_used")
    return j.select("model_used", *[F.bround(c, 0).alias(c) for c in ("mean", "median", "p95", "p99")])


def distribution_by_group(results: DataFrame, col: str = "latency_ms", group: str = "model_used",
                          bins: int = 50) -> DataFrame:
    """Per-group binned density (the violin's data): count / (n * width)."""
    h = histogram(results, col, bins, [group])
    dens = F.when(F.col("width") > 0, F.col("count") / (F.col("n") * F.col("width")))
    return h.select(group, "bin", "bin_lo", "bin_hi", "count", dens.alias("density"))


def threshold_sweep(results: DataFrame, thresholds=DEFAULT_THRESHOLDS, on: str = "weak_quality_score",
                    prices: Prices = Prices()) -> DataFrame:
    """The cost/quality trade-off measured on real rows for every threshold.

    ``on='weak_quality_score'`` (cascade): an evaluated row escalates when score < t; rows routed strong stay
    strong. ``on='routing_score'`` (router): a row goes strong when score >= t.
    Counterfactual cost per row: all its tokens at the strong tier's prices if strong, at the weak tier's if not.

    No rows x thresholds product: each row gets the index ``j0`` of the first threshold where its decision flips
    (``size(filter(thresholds, t -> t <= score))``), rows are aggregated per ``j0`` (at most m+1 groups), and the
    sweep is a cumulative sum over that tiny table.
    """
    ts = sorted(float(t) for t in thresholds)
    m = len(ts)
    if m == 0:
        raise ValueError("at least one threshold is required")
    arr = F.array(*[F.lit(t) for t in ts])
    s = F.col(on)
    ok = valid(on)
    n_le = F.size(F.filter(arr, lambda t: t <= s))
    if on == "weak_quality_score":
        # escalated for threshold index j >= j0
        j0 = (F.when(F.col("model_used") == "strong", F.lit(0)).when(ok, n_le).otherwise(F.lit(m)))
        evaluator = ok & (F.col("model_used") != "strong")
    elif on == "routing_score":
        # strong for j < n_le: store as "strong at j <= j0 - 1"; flip to escalation index by negation below
        j0 = F.when(ok, n_le).otherwise(F.lit(0))
        evaluator = F.lit(False)
    else:
        raise ValueError(f"threshold_sweep on {on!r} is not supported")
    tin = token(results, "weak_input") + token(results, "strong_input")
    tout = token(results, "weak_output") + token(results, "strong_output")
    strong_cost = (tin * prices.strong_input + tout * prices.strong_output) / F.lit(1e6)
    weak_cost = (tin * prices.weak_input + tout * prices.weak_output) / F.lit(1e6)
    q = F.when(valid("weak_quality_score"), F.col("weak_quality_score")) if "weak_quality_score" in results.columns \
        else F.lit(None).cast("double")
    per = results.select(j0.alias("j0"), strong_cost.alias("sc"), weak_cost.alias("wc"),
                         q.alias("score"), evaluator.alias("ev"))
    g = per.groupBy("j0").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sc").alias("sc"), F.sum("wc").alias("wc"),
        F.sum("score").alias("ssum"), F.count("score").alias("scnt"), F.count_if("ev").alias("nev"))
    # each of the <= m+1 aggregated rows is expanded to the m threshold indexes: the conditional sums below
    # are the cumulative sums over j0
    pairs = g.select("*", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    pairs = pairs.withColumn("threshold", F.element_at(arr, F.col("j") + 1))
    if on == "weak_quality_score":
        strong = F.col("j0") <= F.col("j")
    else:
        strong = F.col("j") < F.col("j0")
    tot = pairs.groupBy("j", "threshold").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(strong, F.col("n")).otherwise(0)).alias("strong_n"),
        F.sum(F.when(strong, F.col("sc")).otherwise(F.col("wc"))).alias("est_cost_usd"),
        F.sum(F.when(~strong, F.col("ssum"))).alias("_ks"),
        F.sum(F.when(~strong, F.col("scnt"))).alias("_kc"),
        F.sum(F.when(strong, F.col("nev")).otherwise(0)).alias("_trig"))
    return tot.select(
        "threshold", F.col("strong_n").cast("bigint").alias("strong_n"),
        F.try_divide(F.col("strong_n") * F.lit(100.0), F.col("total").cast("double")).alias("strong_pct"),
        "est_cost_usd",
        F.try_divide(F.col("_ks"), F.col("_kc").cast("double")).alias("avg_quality"),
        F.try_divide(F.col("_trig") * F.lit(100.0), F.col("total").cast("double")).alias("trigger_rate"))


def operating_point(sweep: DataFrame, current: float = 0.7) -> DataFrame:
    """The sweep row nearest to the current threshold (ties: lower threshold)."""
    cols = sweep.columns
    key = F.struct(F.abs(F.col("threshold") - F.lit(current)).alias("d"), F.col("threshold").alias("t"))
    best = sweep.agg(F.min_by(F.struct(*cols), key).alias("r"))
    return best.select("r.*")


def score_cost_correlation(results: DataFrame) -> DataFrame:
    """Pearson correlation of routing score and cost, with the row count used."""
    ok = valid("routing_score") & valid("cost_usd")
    return results.agg(F.corr(F.when(ok, F.col("routing_score")), F.when(ok, F.col("cost_usd"))).alias("corr"),
                       F.count_if(ok).alias("n"))


def cost_by_score_bin(results: DataFrame, bins: int = 10) -> DataFrame:
    """Mean cost per routing-score bin (width 1/bins over [0, 1]) and decision."""
    b = F.when(valid("routing_score"), F.least(F.floor(F.col("routing_score") * bins), F.lit(bins - 1))).cast("int")
    return (results.groupBy(b.alias("score_bin"), "model_used")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("cost_usd").alias("sum_cost"))
            .where(F.col("score_bin").isNotNull())
            # money sums are rounded to 9 places before dividing, so the mean does not depend on summation order
            .select("score_bin", "model_used", "n", (F.round("sum_cost", 9) / F.col("n")).alias("mean_cost")))


def decision_matrix(results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Router side of the threshold (score >= t) against the final decision."""
    side = F.when(valid("routing_score"), F.col("routing_score") >= threshold)
    return (results.groupBy(side.alias("above_threshold"), "model_used").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("above_threshold").isNotNull()))


def kpi_summary(results: DataFrame) -> DataFrame:
    """Six dashboard KPIs plus the average-cost delta relative to 2 x average, as (kpi, value)."""
    mu = F.col("model_used")
    a = results.agg(
        F.count(F.lit(1)).cast("double").alias("total_requests"),
        F.avg("cost_usd").alias("avg_cost_per_request"),
        F.avg(F.when(valid("latency_ms"), F.col("latency_ms"))).alias("avg_latency_ms"),
        F.try_divide(F.count_if(mu.isin("strong", "weak_then_strong")) * F.lit(100.0),
                     F.count(F.lit(1)).cast("double")).alias("strong_usage_pct"),
        F.try_divide(F.count_if(mu == "weak_then_strong") * F.lit(100.0),
                     F.count(F.lit(1)).cast("double")).alias("evaluator_trigger_rate"),
        F.sum("cost_usd").alias("total_cost_usd"))
    a = a.withColumn("avg_cost_delta_vs_2x", F.try_divide(
        F.col("avg_cost_per_request") - F.col("avg_cost_per_request") * 2, F.col("avg_cost_per_request") * 2))
    cols = [c for c in a.columns]
    return a.unpivot([], cols, "kpi", "value")


def baseline_split_cost(results: DataFrame) -> Column:
    return baseline_cost(results, "split")
