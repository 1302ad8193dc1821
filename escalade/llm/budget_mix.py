"""Mixing sources to target weights by subset-sum budget fitting.

1. Sizes: words per document. The histogram counts the documents of each source by exact size.
2. Targets: all sources share ``total`` words by weight; a target stops at ``max_repeats`` times its source's size and
   what is over is shared again by weight, until no target is above (a few rounds over one row per source).
3. Plan: a source is taken whole ``floor(target / size)`` times. For the rest of its budget every size gives the same
   share of its documents (rounded down), then single documents of the largest sizes that fit are added while the
   gap is over ``window`` words, and the gap that is left is closed by a bounded-knapsack dynamic programme over the
   counts still free: a bit set of reachable sums up to the gap (and ``slack`` words beyond; if none comes that near, as
   far beyond as the nearest one falls short), counts split into powers of two, the first item that reached each sum kept
   for the way back; the nearest reachable sum wins (ties: the smaller). A budget of at most ``window`` words that is missed
   so is fitted anew from all counts, without the equal shares. The programme sees a source's histogram (one row per size), never its documents.
4. Selection: of the c documents of a (source, size) the plan takes the x that come first by a seeded hash of their id.

The (source, size) groups may be hot (a third of all rows can be copies of one text), so they aren't ranked in one
piece: the group is cut into about c / ``bucket_rows`` hash ranges, ranks inside a range come from a window over
(source, size, range), and the ranges before it are summed from their counts. Texts are read once and never shuffled;
the shuffled rows are (id, source, size).

Defined cases: null and blank texts have size 0: their source's size may be 0, then its target is 0 and nothing is
taken; a null source is a source of its own, the last; a null id takes part like any other value; repeated rows count
each, and are taken as often as the plan says (rows of one id are alike then, so reruns agree); an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escalade.functions.ordinals import global_ordinals
from escalade.llm.common import checked_broadcast, ready, words_of

Histogram = Sequence[tuple[int, int]]


def word_count(text: Column) -> Column:
    """Number of words; null and blank texts have none."""
    return F.size(words_of(text)).cast("bigint")


def subset_sum(items: Histogram, target: int, slack: int = 0) -> dict[int, int]:
    """size -> how many to take (at most the count given), so that the sum comes nearest to ``target``; sums up to
    ``target + slack`` are considered, ties go to the smaller sum."""
    if target <= 0:
        return {}
    limit = target + slack
    reach, mask = 1, (1 << (limit + 1)) - 1
    first = np.full(limit + 1, -1, dtype=np.int64)  # the item that reached each sum first
    split: list[tuple[int, int]] = []
    for size, count in sorted(items, reverse=True):
        left, part = min(count, limit // size) if size > 0 else 0, 1
        while left > 0:
            take = min(part, left)
            weight = take * size
            if weight > limit:
                break
            new = ((reach << weight) & mask) & ~reach
            if new:
                bits = np.frombuffer(new.to_bytes((limit >> 3) + 1, "little"), dtype=np.uint8)
                first[np.flatnonzero(np.unpackbits(bits, bitorder="little", count=limit + 1))] = len(split)
                reach |= new
            split.append((size, take))
            left, part = left - take, part * 2
            if reach >> target & 1:
                break
        if reach >> target & 1:
            break
    near = next(s for d in range(limit + 1) for s in (target - d, target + d) if 0 <= s <= limit and reach >> s & 1)
    taken: dict[int, int] = {}
    while near > 0:
        size, take = split[first[near]]
        taken[size] = taken.get(size, 0) + take
        near -= size * take
    return taken


def _nearest(items: Histogram, target: int, slack: int) -> dict[int, int]:
    """As :func:`subset_sum`, with as many sums above ``target`` as could be nearer than the nearest found."""
    smallest = min((s for s, _ in items), default=0)
    if smallest > target > 0:  # any sum but 0 is above
        return {smallest: 1} if smallest - target < target else {}
    taken = subset_sum(items, target, slack)
    off = abs(target - sum(s * x for s, x in taken.items()))
    return subset_sum(items, target, off) if off > slack else taken


def fit_counts(items: Histogram, budget: int, window: int = 1 << 16, slack: int = 64) -> dict[int, int]:
    """size -> documents to take once, so that their words come nearest to ``budget`` (less than the items' sum; beyond
    ``window`` words, nearest with the equal shares taken)."""
    items = [(s, c) for s, c in items if s > 0]
    whole = sum(s * c for s, c in items)
    if budget <= 0 or whole == 0:
        return {}
    take = {s: c * budget // whole for s, c in items}
    gap = budget - sum(s * x for s, x in take.items())
    for s, c in sorted(items, reverse=True):
        if gap <= window:
            break
        more = min(c - take[s], gap // s)
        take[s] += more
        gap -= s * more
    free = [(s, c - take[s]) for s, c in items if c > take[s]]
    for s, x in _nearest(free, gap, slack).items():
        take[s] += x
    off = abs(budget - sum(s * x for s, x in take.items()))
    if off and budget <= window:  # the equal shares may stand in the way: without them
        anew = _nearest(items, budget, slack)
        if abs(budget - sum(s * x for s, x in anew.items())) < off:
            return anew
    return take


def share_targets(sources: DataFrame, total: int, max_repeats: int = 3) -> DataFrame:
    """Adds ``target`` to (weight, source_size): shares of ``total`` by weight, each at most ``max_repeats`` times its
    source's size, what is over shared again by weight."""
    cap = F.col("source_size") * F.lit(max_repeats)
    rate = None  # words per unit of weight for the sources that aren't at their cap
    while True:
        over = F.lit(False) if rate is None else cap <= F.col("weight") * F.lit(rate)
        free, held = sources.agg(F.sum(F.when(~over, F.col("weight"))), F.sum(F.when(over, cap))).first()
        if not free:
            break
        new = (total - (held or 0)) / free
        if rate is not None and new <= rate:
            break
        rate = new
    target = cap.cast("double") if rate is None else F.least(cap.cast("double"), F.col("weight") * F.lit(rate))
    return sources.withColumn("target", target)


def _plan(window: int, slack: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        whole = int(target // size) if size else 0
        take = fit_counts(list(zip(pdf["size"].tolist(), pdf["docs"].tolist())), round(target - whole * size), window, slack)
        return pd.DataFrame({"source_no": pdf["source_no"], "size": pdf["size"], "docs": pdf["docs"], "whole": whole,
                             "extra": [take.get(s, 0) for s in pdf["size"].tolist()], "source_size": size, "target": target})
    return run


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, max_repeats: int = 3, seed: int = 17,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", window: int = 1 << 16,
        slack: int = 64, bucket_rows: int = 4096, row: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (size x copies) of every row of ``docs``, and ``row`` if given.

    Sources in code point order (null last) weigh ``weights``, repeating, and share ``share`` of all words."""
    ready(docs.sparkSession)
    # one pass over the texts; the checkpointed rows are three numbers and the source's name
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       word_count(F.col(text_col)).alias("size"), (F.lit(0) if row is None else row).alias("row")).checkpoint()
    hist = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")).checkpoint()
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    numbered = global_ordinals(sizes, [F.col("source").asc_nulls_last()], "source_no")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    sources = numbered.withColumn("weight", w).checkpoint()
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    targets = share_targets(sources, words * share, max_repeats)
    told = (hist.join(targets, hist["source"].eqNullSafe(targets["source"]))
            .select("source_no", "size", "docs", "source_size", "target"))
    plan = told.groupBy("source_no").applyInPandas(
        _plan(window, slack), "source_no bigint, size bigint, docs bigint, whole bigint, extra bigint, source_size bigint, "
                              "target double")
    names = targets.select(F.col("source").alias("name"), F.col("source_no").alias("no"))
    plan = plan.join(names, F.col("source_no") == F.col("no")).select(
        "name", F.col("size").alias("plan_size"), "docs", "whole", "extra", "source_size", "target", "source_no").checkpoint()
    # which hash range of its (source, size) a row falls into
    h = F.xxhash64(F.lit(seed), "doc_id")
    ranges = F.ceil(F.col("docs") / F.lit(bucket_rows))
    placed = (rows.join(plan, rows["source"].eqNullSafe(plan["name"]) & (F.col("size") == F.col("plan_size")))
              .select("row", "doc_id", "source_no", "size", "docs", "whole", "extra", "source_size", "target", h.alias("h"),
                      F.floor(F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53)) * ranges).alias("part")))
    group = ["source_no", "size", "part"]
    counts = placed.filter("extra > 0 and extra < docs").groupBy(*group).agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("source_no", "size").orderBy("part")
                                .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("before", F.coalesce(before, F.lit(0))).drop("rows")
    inside = F.row_number().over(Window.partitionBy(*group).orderBy("h", "doc_id", "row"))
    ranked = placed.withColumn("inside", inside).join(offsets, group, "left")
    extra = F.when(F.coalesce("before", F.lit(0)) + F.col("inside") <= F.col("extra"), 1).otherwise(0)
    copies = F.col("whole") + F.when(F.col("extra") >= F.col("docs"), 1).when(F.col("extra") == 0, 0).otherwise(extra)
    out = ranked.select("row", "doc_id", "size", "source_size", "target", copies.cast("bigint").alias("copies"),
                         (F.col("size") * copies).cast("bigint").alias("taken"))
    return out.drop("row") if row is None else out


def take(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``copies``: how often. Other options as for :func:`mix`.

    ``docs`` has to be read from files, so that its rows keep their numbers when they are read again."""
    number = F.monotonically_increasing_id()
    taken = mix(docs, row=number, **options).filter("copies > 0").select(F.col("row").alias("_row"), F.col("copies").alias("_copies"))
    rows = docs.drop("copies").withColumn("_row", number)
    return rows.join(checked_broadcast(taken.checkpoint(), 24), "_row").drop("_row").withColumnRenamed("_copies", "copies")
