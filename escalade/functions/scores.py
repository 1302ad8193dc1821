"""Score columns: pairwise comparison, preference probability, binary prediction (F6, F7, F13) and pooling of
token hidden states (F12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escalade.functions.quantiles import valid

POOLING = ("cls", "mean", "max")
MASK_FLOOR = 1e-9      # denominator clamp of the masked mean
MASKED_VALUE = -1e9    # value given to masked positions before the max


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def compare_responses(score_a: Column | str, score_b: Column | str) -> Column:
    """'a' only when a > b (ties, and scores that are NaN, prefer 'b'); confidence = |a - b|."""
    a, b = _c(score_a), _c(score_b)
    return F.struct(F.when(valid(a) & valid(b) & (a > b), F.lit("a")).otherwise(F.lit("b")).alias("preferred"),
                    F.abs(a - b).alias("confidence"))


def preference_probability(score_a: Column | str, score_b: Column | str) -> Column:
    """P(a preferred over b) = sigmoid(a - b)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(_c(score_b) - _c(score_a)))


def binary_prediction(score: Column | str, threshold: float = 0.5) -> Column:
    """1.0 when the score is strictly above the threshold, else 0.0 (also for NaN)."""
    return F.when(valid(_c(score)) & (_c(score) > F.lit(threshold)), F.lit(1.0)).otherwise(F.lit(0.0))


def pool_hidden_states(hidden: DataFrame, strategy: str = "mean", key: str = "id", pos: str = "pos", dim: str = "dim",
                       value: str = "v", mask: str = "mask") -> DataFrame:
    """one pooled value per (sequence, dimension) from long-form hidden states.

    cls = value at the first position; mean = sum(v * m) / max(sum(m), 1e-9); max = max over positions with masked
    values replaced by -1e9. All are partial aggregations on (key, dim): a very long sequence is reduced on every
    partition before the shuffle.
    """
    if strategy not in POOLING:
        raise ValueError(f"Unknown pooling strategy: {strategy}")
    g = hidden.groupBy(key, dim)
    v, m = F.col(value).cast("double"), F.col(mask).cast("double")
    if strategy == "cls":
        return g.agg(F.min_by(v, F.col(pos)).alias("pooled"))
    if strategy == "mean":
        return g.agg((F.sum(v * m) / F.greatest(F.sum(m), F.lit(MASK_FLOOR))).alias("pooled"))
    return g.agg(F.max(F.when(m == 0, F.lit(MASKED_VALUE)).otherwise(v)).alias("pooled"))


def pool_arrays(hidden: Column | str, mask: Column | str, strategy: str = "mean") -> Column:
    """F12 on one sequence held as arrays: ``hidden`` ARRAY<ARRAY<DOUBLE>> [position][dimension] and ``mask``
    ARRAY<INT> per position -> pooled ARRAY<DOUBLE> per dimension (same rules as :func:`pool_hidden_states`; a
    sequence is bounded by the encoder's maximum length)."""
    if strategy not in POOLING:
        raise ValueError(f"Unknown pooling strategy: {strategy}")
    h, m = _c(hidden), _c(mask)
    dims = F.sequence(F.lit(0), F.size(F.element_at(h, 1)) - 1)
    if strategy == "cls":
        return F.transform(F.element_at(h, 1), lambda v: v.cast("double"))
    if strategy == "mean":
        denom = F.greatest(F.aggregate(m, F.lit(0.0), lambda a, x: a + x.cast("double")), F.lit(MASK_FLOOR))
        return F.transform(dims, lambda j: F.aggregate(
            F.zip_with(h, m, lambda row, mm: row[j].cast("double") * mm.cast("double")), F.lit(0.0),
            lambda a, x: a + x) / denom)
    return F.transform(dims, lambda j: F.array_max(
        F.zip_with(h, m, lambda row, mm: F.when(mm == 0, F.lit(MASKED_VALUE)).otherwise(row[j].cast("double")))))
