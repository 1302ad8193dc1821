"""ST1: assemble streamed completion chunks into whole completions (batch or stream, same code).

One completion = (id, index); chunks carry an explicit ``seq``. Exact retransmissions (same seq and content)
are removed with ``array_distinct``; text is the concatenation in ``seq`` order; role is the first non-NULL role
and finish_reason the last non-NULL one. A completion's chunk list is bounded by its ``max_tokens``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble_chunks(chunks: DataFrame, key: str = "id", index: str | None = "index", seq: str = "seq",
                    content: str = "content", role: str = "role", finish: str | None = "finish_reason",
                    session_gap: str | None = None, time_col: str = "created") -> DataFrame:
    """Batch: one row per completion. Stream: pass ``session_gap`` (with a watermark on ``time_col``) to emit
    each completion once its session closes (append mode), or run without it in update/complete mode."""
    keys = [key] + ([index] if index and index in chunks.columns else [])
    if session_gap:
        keys.append(F.session_window(time_col, session_gap).alias("session"))
    aggs = [
        F.array_distinct(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(content).alias("c")))).alias("_parts"),
        F.min_by(F.col(role), F.when(F.col(role).isNotNull(), F.col(seq))).alias("role"),
    ]
    if finish and finish in chunks.columns:
        aggs.append(F.max_by(F.col(finish), F.when(F.col(finish).isNotNull(), F.col(seq))).alias("finish_reason"))
    g = chunks.groupBy(*keys).agg(*aggs)
    parts = F.array_sort("_parts")
    return (g.withColumn("content", F.array_join(F.transform(parts, lambda x: F.coalesce(x["c"], F.lit(""))), ""))
            .withColumn("n_chunks", F.size("_parts").cast("bigint")).drop("_parts"))
