"""Exact top-k inner products over vectors of whole numbers, in buckets of similar length.

1. Candidates are laid out by length, longest first, and cut into buckets of ``bucket_rows``; queries into blocks of
   ``query_rows``. A task gets one block and one bucket, whatever the table's size.
2. Every query meets the longest bucket first; its k-th score there is its threshold. A bucket whose longest vector can't reach it
   (|q| * |c| below the threshold, strictly, as ties go by id) isn't sent to the query; since buckets descend, each query goes to
   the first so many buckets.
3. In a bucket the threshold becomes a local one on the cosine: threshold / (|q| * longest). Queries with a low one scan the bucket in order of
   length, in tiles, until |q| * |c| falls below their threshold, which grows as they go (length pruning). For the others the query's
   ``_FOCUS`` largest coordinates bound the cosine: a candidate's share of the product in them plus what the rest of both
   vectors can add at most (Cauchy-Schwarz) has to reach it; the coordinate lists, sorted, give the ranges in which that is possible
   (coordinate pruning). The local cosine from which lists beat scans is found per bucket, from a few of its queries.
4. What is left is verified by the product itself, on a heap of k. Products of whole numbers are exact: in double precision while
   |q| * |c| is below 2**53, else in Python's whole numbers.

Defined cases: vectors that are null, empty, or hold a null, NaN or infinite component take no part; zero vectors do; vectors of
different lengths (in components) aren't compared; a query has all candidates if there are fewer than k; ties go to the smaller id;
an id names one vector: repeated rows of an id count once (the smallest vector, if they differ); rows with a null id take no
part; an empty table gives no rows; further columns are ignored; a product beyond bigint counts and is given as the bigint next to it.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escalade.functions.ordinals import global_ordinals_with_count
from escalade.llm.common import ready

_FOCUS = 3  # coordinates of a query that bound its candidates
_TILE = 1024
_EXACT = float(1 << 53)
_CELL = 1 << 21  # components of a bucket
_BUCKETS = 500_000
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def whole_numbers(vec: Column, scale: int) -> Column:
    """floor(scale * x) of every component x as double: whole numbers, exactly, of any size."""
    return F.transform(vec, lambda x: _floor(x.cast("double") * F.lit(float(scale))))


def _floor(x: Column) -> Column:
    # beyond 2**53 doubles are whole; F.floor gives bigint, which can't hold them
    return F.when(F.abs(x) < F.lit(_EXACT), F.floor(x).cast("double")).otherwise(x)


def _valid(vec: Column) -> Column:
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


class _Heaps:
    """The k best (score, -id) of each query."""

    def __init__(self, qids: np.ndarray, k: int, bar: np.ndarray):
        self.k, self.heaps, self.bar, self.qids = k, [[] for _ in qids], bar.copy(), qids

    def offer(self, i: int, scores: list, ids: list) -> None:
        heap, k = self.heaps[i], self.k
        for score, j in zip(scores, ids):
            if len(heap) < k:
                heapq.heappush(heap, (score, -j))
            elif (score, -j) > heap[0]:
                heapq.heapreplace(heap, (score, -j))
        if len(heap) == k:
            least = float(heap[0][0])
            self.bar[i] = max(self.bar[i], least if least <= heap[0][0] else np.nextafter(least, -np.inf))


def _scan(told: _Heaps, which: np.ndarray, q, qnorm, ids, c, norms) -> None:
    """Length pruning: the bucket in order of length, as long as a query's threshold can be reached."""
    for at in range(0, len(ids), _TILE):
        most = qnorm * norms[at]
        which = which[~(most[which] * (1 + 1e-12) < told.bar[which])]  # of overflowing ones nothing is known
        if not len(which):
            return
        tile, own, doubles = c[at:at + _TILE], ids[at:at + _TILE], most[which] < _EXACT
        some = which[doubles]
        scores = q[some] @ tile.T
        # only what reaches the threshold, and of that what can be among the tile's k best
        scores[told.qids[some][:, None] == own[None, :]] = -np.inf
        low = told.bar[some]
        if len(own) > told.k and len(some):
            low = np.maximum(low, np.partition(scores, len(own) - told.k, axis=1)[:, len(own) - told.k])
        rows, cols = np.nonzero((scores >= low[:, None]) & (scores > -np.inf))
        cut = np.searchsorted(rows, np.arange(len(some) + 1))
        for r, i in enumerate(some.tolist()):
            s = cols[cut[r]:cut[r + 1]]
            if len(s):
                told.offer(i, scores[r, s].astype(np.int64).tolist(), own[s].tolist())
        if not doubles.all():
            numbers = [[int(x) for x in row] for row in tile.tolist()]
            for i in which[~doubles].tolist():
                vec = [int(x) for x in q[i].tolist()]
                both = [(max(_LOW, min(_HIGH, sum(x * y for x, y in zip(vec, row)))), j)
                        for row, j in zip(numbers, own.tolist()) if j != told.qids[i]]
                told.offer(i, [s for s, _ in both], [j for _, j in both])


class _Lists:
    """The bucket's unit vectors by coordinate: for each the sorted values and their rows."""

    def __init__(self, c: np.ndarray, norms: np.ndarray):
        unit = c / np.maximum(norms, 1e-300)[:, None]
        self.unit, self.order = unit, np.argsort(unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(unit, self.order, axis=0)

    def ranges(self, u: np.ndarray, cosine: float) -> list[tuple[int, int, int]]:
        """(coordinate, first, last) of the sorted lists for the focus of a unit query and a least cosine: with x for the
        candidate's coordinate, u x + sqrt(1 - u^2) sqrt(1 - x^2) >= cosine holds between cos(angle(u) -+ angle(cosine))."""
        wide, out = math.acos(min(1.0, max(-1.0, cosine))) + 1e-7, []
        for f in np.argpartition(-np.abs(u), min(_FOCUS, len(u)) - 1)[:_FOCUS].tolist():
            at = math.acos(min(1.0, max(-1.0, float(u[f]))))
            lo = math.cos(at + wide) if at + wide < math.pi else -1.0
            hi = math.cos(at - wide) if at - wide > 0 else 1.0
            col = self.sorted[:, f]
            out.append((f, int(np.searchsorted(col, lo - 1e-9)), int(np.searchsorted(col, hi + 1e-9, side="right"))))
        return sorted(out, key=lambda r: r[2] - r[1])

    def candidates(self, u: np.ndarray, cosine: float) -> np.ndarray:
        """Rows that all lists allow, and the product in the focus with the rest bounded."""
        found = self.ranges(u, cosine)
        f, lo, hi = found[0]
        rows = self.order[lo:hi, f]
        focus = [f for f, _, _ in found]
        part = self.unit[np.ix_(rows, focus)]
        rest = np.sqrt(np.maximum(0.0, 1 - (u[focus] ** 2).sum())) * np.sqrt(np.maximum(0.0, 1 - (part**2).sum(1)))
        return rows[part @ u[focus] + rest >= cosine - 1e-9]


def top_in_bucket(qids, q, bar, ids, c, k: int):
    """(query id, id, score): the k best of each query in one bucket, less what is below its threshold ``bar``."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        yield from _top_in_bucket(qids, q, bar, ids, c, k)


def _top_in_bucket(qids, q, bar, ids, c, k: int):
    norms, qnorm = np.sqrt((c**2).sum(1)), np.sqrt((q**2).sum(1))
    by = np.lexsort((ids, -norms))
    ids, c, norms = ids[by], c[by], norms[by]
    told = _Heaps(qids, k, bar)
    exact = bool(qnorm.max() * norms[0] < _EXACT)
    # least cosine with the bucket's longest vector
    local = np.where(qnorm * norms[0] > 0, np.nan_to_num(told.bar / (qnorm * norms[0]), nan=-1.0), -1.0)
    from_ = 2.0
    if exact and norms[-1] > 0 and (local > 0.1).any() and len(ids) > _TILE:
        lists, asked = _Lists(c, norms), np.argsort(-local, kind="stable")
        unit = lambda i: q[i] / qnorm[i]
        asked = asked[local[asked] > 0.1]
        asked, saved = asked[np.linspace(0, len(asked) - 1, min(16, len(asked))).astype(int)], []
        for i in asked.tolist():
            reached = int(np.searchsorted(-norms, -told.bar[i] / qnorm[i], side="right"))
            _, lo, hi = lists.ranges(unit(i), min(1.0, float(local[i])))[0]
            saved.append(reached - (hi - lo) * 3 - 3000)  # a listed row costs about three scanned ones, a query some calls
        saved = np.cumsum(saved)
        if saved.max() > 0:
            from_ = float(local[asked[int(saved.argmax())]])
    _scan(told, np.flatnonzero(local < from_), q, qnorm, ids, c, norms)
    for i in np.flatnonzero(local >= from_).tolist():
        if local[i] <= 1 + 1e-9:
            rows = lists.candidates(unit(i), min(1.0, float(local[i])))
            rows = rows[ids[rows] != qids[i]]
            scores = c[rows] @ q[i]
            rows, scores = rows[scores >= told.bar[i]], scores[scores >= told.bar[i]]
            told.offer(i, scores.astype(np.int64).tolist(), ids[rows].tolist())
    for i, heap in zip(qids.tolist(), told.heaps):
        for score, neg in heap:
            yield i, -neg, score


def _grouped(column: pa.ChunkedArray):
    """Number of components -> (rows, matrix) of a column of vectors."""
    vec = column.combine_chunks()
    sizes, flat = np.diff(vec.offsets.to_numpy()), vec.flatten().to_numpy(zero_copy_only=False)
    at = np.cumsum(sizes) - sizes
    return {int(d): (np.flatnonzero(sizes == d), np.stack([flat[i:i + d] for i in at[sizes == d]])) for d in np.unique(sizes)}


def _cell(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        asked, base = _grouped(left.column("vec")), _grouped(right.column("cvec"))
        rows = []
        for d in asked.keys() & base.keys():
            (qr, q), (cr, c) = asked[d], base[d]
            qids, bar, ids = left.column("id").to_numpy()[qr], left.column("bar").to_numpy()[qr], right.column("cand").to_numpy()[cr]
            rows += top_in_bucket(qids, q, bar, ids, c, k)
        return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])
    return run


def _last_in_reach(longest: np.ndarray):
    """The number of buckets, whose longest vectors descend, that a query of some length can reach a threshold in."""
    @F.pandas_udf("int")
    def last(norm: pd.Series, bar: pd.Series) -> pd.Series:
        norm, bar = norm.to_numpy(), bar.to_numpy()
        bounded = (norm > 0) & np.isfinite(norm) & (bar > 0)
        # a little below, for the rounding of lengths and of thresholds beyond 2**53
        least = np.where(bounded, bar / np.where(bounded, norm, 1.0) * (1 - 1e-9), -np.inf)
        return pd.Series(np.searchsorted(-longest, -least, side="right")).astype("int32")
    return last


def top_products(base: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "vec", query_rows: int = 1024,
                 bucket_rows: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of ``base`` that ``is_query`` names, the ``k`` rows with the largest
    inner products of ``vec_col``, arrays of doubles that are whole numbers."""
    spark = ready(base.sparkSession)
    rows = base.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"),
                       F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.filter(F.col("id").isNotNull() & _valid(F.col("vec")))
    best = F.min(F.struct(F.size("vec").alias("size"), "vec", "is_query"))
    rows = rows.groupBy("id").agg(best.alias("r")).select("id", "r.vec", "r.is_query")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    laid, n = global_ordinals_with_count(rows.withColumn("norm", norm), [F.col("norm").desc(), F.col("id")])
    nq, longest = laid.agg(F.count(F.when(F.col("is_query"), 1)), F.max(F.size("vec"))).first()
    # a bucket holds at most _CELL components, and there are at most _BUCKETS of them: their lengths go to every task
    bucket_rows = max(min(bucket_rows, max(64, _CELL // (longest or 1))), -(-n // _BUCKETS))
    laid = laid.withColumn("bucket", F.floor(F.col("ord") / bucket_rows).cast("int"))
    nb, blocks = max(1, -(-n // bucket_rows)), max(1, -(-nq // query_rows))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4096, blocks * nb))

    def meet(asked: DataFrame, base: DataFrame) -> DataFrame:
        """(id, vec, bar, block, bucket) against (id, vec, block, bucket)."""
        base = base.select(F.col("id").alias("cand"), F.col("vec").alias("cvec"), F.col("block").alias("block"), F.col("bucket").alias("bucket"))
        return (asked.repartition(parts, "block", "bucket").groupBy("block", "bucket")
                .cogroup(base.repartition(parts, "block", "bucket").groupBy("block", "bucket"))
                .applyInArrow(_cell(k), "query_id bigint, vec_id bigint, score bigint"))

    queries = laid.filter("is_query").select("id", "vec", "norm", block)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    found = meet(queries.select("id", "vec", F.lit(float("-inf")).alias("bar"), "block", F.lit(0).alias("bucket")),
                 laid.filter("bucket = 0").select("id", "vec", every, "bucket"))
    if nb > 1:
        found = found.checkpoint()
        # the k-th score is the threshold; a query that met fewer has none
        bars = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("met"), F.min("score").alias("bar"))
        bars = bars.filter(F.col("met") >= k).select("id", F.col("bar").cast("double").alias("bar"))
        asked = queries.join(bars, "id", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
        told = laid.filter("bucket > 0").groupBy("bucket").agg(F.max("norm").alias("norm")).orderBy("bucket").collect()
        last = _last_in_reach(np.array([r.norm for r in told]))
        asked = asked.withColumn("last", last("norm", "bar")).filter("last > 0")
        sent = asked.select("id", "vec", "bar", "block", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("bucket")).checkpoint()
        wanted = sent.select("block", "bucket").distinct()
        found = found.unionByName(meet(sent, laid.filter("bucket > 0").join(wanted, "bucket").select("id", "vec", "block", "bucket")))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
