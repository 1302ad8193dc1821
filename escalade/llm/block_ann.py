"""Nearest neighbours by a block matrix join over int8 products with error bounds.

Vectors are dealt by a hash of their id into ``R`` query groups and ``C`` candidate groups of bounded size; grid
cell (r, c) holds one group of each, so no task sees more than ``query_rows`` x ``tile_rows`` vectors whatever the
table's size. In a cell every vector is quantised to int8 (``x ~ s * xi``). Integer products of a tile are taken in
float32 (exact, as sums stay below 2**24; longer vectors are summed in slices of 1,024 components) and bounded:

    |q.c - (sq qi).(sc ci)|  <=  |q_hat| * |c - c_hat|  +  |q - q_hat| * |c|

A pair whose upper bound is below the k-th lower bound of its query (or below the k-th exact score so far) can't be
among the k nearest. The others are recomputed in double precision from the original vectors, component by component
in order, and pushed on the query's heap of k. So the result is exact: quantisation only saves work. Cell results
(at most k per query and cell) are ranked by a window over the query.

Defined cases: vectors that are null, empty, all zero, or hold a null, NaN or infinite component take no part, neither
as query nor as candidate; vectors of different lengths aren't compared; a query has all candidates if there are fewer
than k; a product that overflows is infinite, one of which both signs overflow counts as the lowest; ties go to the smaller id; an id names one vector: repeated rows of an id count once (the smallest vector, if
they differ), and none of them is a candidate of the query with that id; rows with a null id take no part; an empty
table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escalade.llm.common import ready

_SLICE = 1024  # components whose int8 products sum exactly in float32


def _valid(vec: Column) -> Column:
    """Finite, complete and not zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0)


def _by_length(pdf: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (ids, matrix), one row per id."""
    best: dict[int, tuple] = {}
    for i, v in zip(pdf["id"].to_numpy(), pdf["vec"]):
        v = np.asarray(v, dtype=np.float64)
        if i not in best or (len(v), tuple(v)) < (len(best[i]), tuple(best[i])):
            best[i] = v
    out: dict[int, tuple[list, list]] = {}
    for i in sorted(best):
        ids, rows = out.setdefault(len(best[i]), ([], []))
        ids.append(i)
        rows.append(best[i])
    return {d: (np.array(ids, dtype=np.int64), np.vstack(rows)) for d, (ids, rows) in out.items()}


def _quantise(x: np.ndarray):
    """int8 values (held as float32 for the product), scale, norm of the quantised vector, error norm, norm."""
    scale = np.abs(x).max(axis=1) / 127.0
    xi = np.rint(x / scale[:, None])
    back = xi * scale[:, None]
    return (xi.astype(np.int8).astype(np.float32), scale, np.sqrt((back**2).sum(1)), np.sqrt(((x - back) ** 2).sum(1)),
            np.sqrt((x**2).sum(1)))


def _int_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], _SLICE):
        total += a[:, at:at + _SLICE] @ b[:, at:at + _SLICE].T
    return total


@np.errstate(over="ignore", invalid="ignore")
def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added in component order (the same for equal vectors, wherever they stand)."""
    acc = np.zeros(len(q))
    for j in range(q.shape[1]):
        acc += q[:, j] * c[:, j]
    return np.where(np.isnan(acc), -np.inf, acc)


@np.errstate(over="ignore", invalid="ignore")
def nearest_in_cell(qids, q, cids, c, k: int, tile: int = 1024, chunk: int = 1 << 16):
    """(query id, id, score) of the k nearest of each query among the cell's candidates."""
    qi, qs, qhat, qerr, _ = _quantise(q)
    heaps: list[list] = [[] for _ in qids]
    worst = np.full(len(qids), -np.inf)  # the k-th exact score so far
    for at in range(0, len(cids), tile):
        ids, x = cids[at:at + tile], c[at:at + tile]
        ci, cs, _, cerr, cnorm = _quantise(x)
        approx = _int_product(qi, ci) * qs[:, None] * cs[None, :]
        slack = qhat[:, None] * cerr[None, :] + qerr[:, None] * cnorm[None, :]
        slack += 1e-9 * (qhat + qerr)[:, None] * cnorm[None, :]  # rounding of the double products
        own = qids[:, None] == ids[None, :]
        with np.errstate(over="ignore", invalid="ignore"):
            lower, upper = approx - slack, approx + slack
        lower = np.where(own | np.isnan(lower), -np.inf, lower)  # of bounds that overflow nothing is known
        bar = worst
        if len(ids) > k:
            bar = np.maximum(bar, np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k])
        rows, cols = np.nonzero(~(upper < bar[:, None]) & ~own)
        for lo in range(0, len(rows), chunk):
            r, s = rows[lo:lo + chunk], cols[lo:lo + chunk]
            for i, score, j in zip(r.tolist(), _exact(q[r], x[s]).tolist(), ids[s].tolist()):
                item, heap = (score, -j), heaps[i]
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        worst = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
    for i, heap in zip(qids.tolist(), heaps):
        for score, neg in heap:
            yield i, -neg, score


def _cell(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        queries, base = _by_length(left), _by_length(right)
        rows = [x for d in queries if d in base for x in nearest_in_cell(*queries[d], *base[d], k)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})
    return run


def nearest(base: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20,
            query_rows: int = 1024, cell_rows: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of ``base`` that ``is_query`` names, its ``k`` nearest."""
    spark = ready(base.sparkSession)
    rows = base.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"), is_query.alias("is_query"))
    rows = rows.filter(F.col("id").isNotNull() & _valid(F.col("vec")))
    n, nq = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_query"), 1))).first()
    grid_r, grid_c = max(1, math.ceil(nq / query_rows)), max(1, math.ceil(n / cell_rows))
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    queries = (rows.filter("is_query").select("id", "vec", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(grid_r)).cast("int")
                                              .alias("r"), every(grid_c).alias("c")))
    cands = rows.select("id", "vec", every(grid_r).alias("r"),
                        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(grid_c)).cast("int").alias("c"))
    # as many tasks as cells: each group is one cell of bounded size, whatever the session's partition count
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4096, grid_r * grid_c))
    found = (queries.repartition(parts, "r", "c").groupBy("r", "c")
             .cogroup(cands.repartition(parts, "r", "c").groupBy("r", "c"))
             .applyInPandas(_cell(k), "query_id bigint, vec_id bigint, score double"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
