"""Exact linear-interpolated percentiles (= pandas ``quantile``, DuckDB ``quantile_cont``) that scale.

One way at every size, from value counts:

* count each (group, value): hot values are combined before the shuffle;
* lay the distinct values out by range of (group, value), so that no value and no group fills a task alone, and pin the
  layout with a reliable checkpoint (range bounds come from a sample);
* running counts inside each range plus the counts of the ranges before it give every value its span of ranks;
* per group, the values whose span holds the ranks ``floor/ceil(p * (n - 1))`` are picked by a partial aggregate and
  interpolated.

``method='approx'`` gives ``percentile_approx`` (bounded memory, for dashboards and streams), ``method='builtin'`` Spark's
exact ``percentile``, which merges a map of all distinct values of a group in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("counts", "builtin", "approx")


def valid(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c)


def percentile_columns(value: str, probs: dict[str, float], method: str = "builtin") -> list[Column]:
    """Aggregate expressions for use inside a larger ``agg`` (one pass)."""
    v = F.when(valid(value), F.col(value))
    if method == "approx":
        return [F.percentile_approx(v, p, 100000).alias(n) for n, p in probs.items()]
    return [F.percentile(v, F.lit(p)).alias(n) for n, p in probs.items()]


def value_spans(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., _v, _start, _end): the global ranks of each distinct (group, value), end exclusive."""
    counted = (df.where(valid(value)).select(*by, F.col(value).cast("double").alias("_v"))
               .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")))
    laid = counted.repartitionByRange(*by, "_v").withColumn("_pid", F.spark_partition_id()).checkpoint()
    inside = F.sum("_c").over(Window.partitionBy("_pid").orderBy(*by, "_v").rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum("_c").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))  # one row per range
    offsets = laid.groupBy("_pid").agg(F.sum("_c").alias("_c")).select("_pid", F.coalesce(before, F.lit(0)).alias("_off"))
    spans = laid.withColumn("_in", inside).join(F.broadcast(offsets), "_pid")
    return spans.select(*by, "_v", (F.col("_off") + F.col("_in") - F.col("_c")).alias("_start"),
                        (F.col("_off") + F.col("_in")).alias("_end"))


def percentiles_by_counts(df: DataFrame, value: str, probs: dict[str, float],
                          by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    by = list(by)
    spans = value_spans(df, value, by)
    groups = spans.groupBy(*by).agg(F.min("_start").alias("_g0"), (F.max("_end") - F.min("_start")).alias("_n"))
    groups = groups.select(*[F.col(b).alias(f"_by_{b}") for b in by], "_g0", "_n")
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    joined = spans.join(groups if by else F.broadcast(groups), same)  # without groups: one row
    aggs, picks = [], []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = F.col("_g0") + rank
            aggs.append(F.max(F.when((F.col("_start") <= here) & (here < F.col("_end")), F.col("_v"))).alias(f"_{side}_{name}"))
        at = F.lit(float(p)) * (F.col("_m") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        picks.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return joined.groupBy(*by).agg(F.max("_n").alias("_m"), *aggs).select(*by, *picks)


def percentiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str] | tuple[str, ...] = (),
                method: str = "counts") -> DataFrame:
    """One row per group: ``by`` columns + one DOUBLE column per entry of ``probs`` (name -> probability)."""
    if method not in METHODS:
        raise ValueError(f"unknown percentile method {method!r}")
    if method == "counts":
        return percentiles_by_counts(df, value, probs, by)
    return df.groupBy(*by).agg(*percentile_columns(value, probs, method))


def stacked_percentiles(df: DataFrame, wanted: dict[str, dict[str, float]], by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Exact percentiles of several columns from one layout: rows are stacked as (column, value), counted and laid out once, and all
    ranks are picked from that. One row per group: ``by`` and every name in ``wanted`` ({column: {name: probability}})."""
    by = list(by)
    values = F.array(*[F.struct(F.lit(n).alias("_stat"), F.when(valid(c), F.col(c).cast("double")).alias("_x")) for n, c in enumerate(wanted)])
    stacked = df.select(*by, F.explode(values).alias("_s")).select(*by, "_s._stat", "_s._x")
    every = {f"p{n}": p for n, p in enumerate(sorted({p for names in wanted.values() for p in names.values()}))}
    found = percentiles_by_counts(stacked, "_x", every, [*by, "_stat"])
    of = {p: name for name, p in every.items()}
    picks = [F.max(F.when(F.col("_stat") == n, F.col(of[p]))).alias(name)
             for n, names in enumerate(wanted.values()) for name, p in names.items()]
    return found.groupBy(*by).agg(*picks)
