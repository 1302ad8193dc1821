"""Training-set construction from collected responses.

Position-dependent steps of the reference (prefix split, batches) use exact global ordinals computed with range
partitioning (:mod:`escalade.functions.ordinals`), never a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escalade.functions.hashing import hash32
from escalade.functions.ordinals import global_ordinals, global_ordinals_with_count
from escalade.functions.text import adequacy_label

LABELING_METHODS = ("heuristic", "manual")
PREFERENCE_METHODS = ("always_strong", "heuristic", "manual")


def drop_failed(collected: DataFrame) -> DataFrame:
    """Rows whose model calls succeeded (no ``error``), without the error column."""
    return collected.where(F.col("error").isNull()).drop("error")


def failed(collected: DataFrame, key: str = "pair_id") -> DataFrame:
    """Failed calls with the first 50 characters of their prompt."""
    return collected.where(F.col("error").isNotNull()).select(
        key, F.substring("prompt", 1, 50).alias("prompt_head"), "error")


def manual_labels(pairs: DataFrame, annotations: DataFrame | None = None, key: str = "pair_id") -> Column | DataFrame:
    """The manual-labeling placeholder: all zeros, or human labels left-joined by key (missing -> 0)."""
    if annotations is None:
        return pairs.withColumn("label", F.lit(0))
    ann = annotations.select(key, F.col("label").cast("int").alias("_ann"))
    return pairs.join(ann, key, "left").withColumn("label", F.coalesce("_ann", F.lit(0))).drop("_ann")


def adequacy_dataset(pairs: DataFrame, method: str = "heuristic", annotations: DataFrame | None = None,
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """(prompt, weak_response, label) with label from F3 (heuristic) or P6 (manual)."""
    if method == "heuristic":
        lab = pairs.withColumn("label", adequacy_label("weak_response", "strong_response"))
    elif method == "manual":
        lab = manual_labels(pairs, annotations)
    else:
        raise ValueError(f"Unknown labeling method: {method}")
    return lab.select(*keep, "prompt", "weak_response", F.col("label").cast("int").alias("label"))


def pairwise_dataset(pairs: DataFrame, method: str = "always_strong", keep: tuple[str, ...] = ()) -> DataFrame:
    """response_a = weak, response_b = strong, preference 'b' (every documented method prefers strong)."""
    if method not in PREFERENCE_METHODS:
        raise ValueError(f"Unknown preference method: {method}")
    return pairs.select(*keep, "prompt", F.col("weak_response").alias("response_a"),
                        F.col("strong_response").alias("response_b"), F.lit("b").alias("preference"))


def to_adequacy_samples(adequacy: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """P5: training-sample form: prompt, response, label as DOUBLE."""
    return adequacy.select(*keep, "prompt", F.col("weak_response").alias("response"),
                           F.col("label").cast("double").alias("label"))


def orient_pairs(pairwise: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Preferred / non-preferred responses from the 'a'/'b' preference."""
    a_wins = F.col("preference") == "a"
    return pairwise.select(*keep, "prompt",
                           F.when(a_wins, F.col("response_a")).otherwise(F.col("response_b")).alias("response_preferred"),
                           F.when(a_wins, F.col("response_b")).otherwise(F.col("response_a"))
                           .alias("response_non_preferred"))


def combine_datasets(adequacy: DataFrame | None, pairwise: DataFrame | None, adequacy_weight: float = 1.0) -> DataFrame:
    """Adequacy samples then pairwise samples, tagged with ``type``; ``part`` keeps the order, ``weight`` is
    the adequacy sampling weight (1.0 for pairwise rows). Either side may be missing."""
    parts = []
    if adequacy is not None:
        parts.append(adequacy.withColumn("type", F.lit("adequacy")).withColumn("part", F.lit(0))
                     .withColumn("weight", F.lit(float(adequacy_weight))))
    if pairwise is not None:
        parts.append(pairwise.withColumn("type", F.lit("pairwise")).withColumn("part", F.lit(1))
                     .withColumn("weight", F.lit(1.0)))
    if not parts:
        raise ValueError("at least one dataset is required")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def prefix_split(df: DataFrame, order_by: list[Column | str], ratio: float = 0.9, name: str = "split",
                 ord_name: str = "ord") -> DataFrame:
    """The first ``int(n * ratio)`` rows (in ``order_by`` order) are 'train', the rest 'val'.

    ``n`` is one scalar count; the cut is computed on the driver with Python semantics (float product, then
    truncation), e.g. n=100, ratio=0.29 gives 28.
    """
    if not 0.0 <= ratio <= 1.0:
        raise ValueError("ratio must be within [0, 1]")
    ranked, n = global_ordinals_with_count(df, order_by, name=ord_name)
    cut = int(n * ratio)
    return ranked.withColumn(name, F.when(F.col(ord_name) < F.lit(cut), "train").otherwise("val"))


def random_split_exact(df: DataFrame, key: str, ratio: float = 0.9, seed: int = 42, name: str = "split") -> DataFrame:
    """A seeded random split with exact sizes: order by the portable hash of the key, then D1."""
    return prefix_split(df, [hash32(F.col(key), seed), F.col(key)], ratio, name, "_rord").drop("_rord")


def shuffle(df: DataFrame, key: str, seed: int = 42, epoch: int = 0) -> DataFrame:
    """D3: a reproducible epoch order (distributed sort on the seeded hash; a new order per epoch)."""
    return df.orderBy(hash32(F.col(key), seed * 1009 + epoch), F.col(key))


def assign_batches(df: DataFrame, order_by: list[Column | str], batch_size: int = 16, name: str = "batch_id") -> DataFrame:
    """Consecutive batches of ``batch_size`` rows in ``order_by`` order; the last one may be short."""
    if batch_size < 1:
        raise ValueError("batch_size must be >= 1")
    ranked = global_ordinals(df, order_by, name="ord")
    return ranked.withColumn(name, F.floor(F.col("ord") / F.lit(batch_size)).cast("bigint"))


def collate(batched: DataFrame, columns: list[str], batch: str = "batch_id") -> DataFrame:
    """One row per batch with the column lists in row order (a batch holds at most ``batch_size`` rows)."""
    g = batched.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct("ord", *columns))).alias("_rows"))
    return g.select(batch, F.size("_rows").alias("batch_rows"),
                    *[F.transform("_rows", _field(c)).alias(c) for c in columns])


def _field(name: str):
    return lambda r: r[name]


def dataset_sizes(df: DataFrame, kind: str = "kind", split: str = "split") -> DataFrame:
    """Rows per dataset kind and split."""
    return df.groupBy(kind, split).agg(F.count(F.lit(1)).alias("rows"))
