import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from escalade.llm import norm_topk as t


def brute(rows, k, scale=64):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(scale * x) for x in v]
            good[i] = min(good.get(i, w), w, key=lambda x: (len(x), x))
    out = []
    for q in good:
        if q % 20 == 0:
            score = lambda c: max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(good[q], good[c]))))
            near = sorted((-score(c), c) for c in good if c != q and len(good[c]) == len(good[q]))[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(near, 1)]
    return sorted(out)


def run(spark, rows, k=5, **options):
    base = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, e array<double>, rank int, id string")
    base = base.select("*", t.whole_numbers(F.col("e"), 64).alias("vec"))
    return sorted(tuple(r) for r in t.top_products(base, F.col("vec_id") % 20 == 0, k=k, **options).collect())


def vectors(seed, n, d, spread):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=d) * math.exp(rng.normal() * spread)).tolist()) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"query_rows": 4, "bucket_rows": 64}])
def test_against_brute_force(spark, options):
    rows = vectors(3, 300, 8, 1.5)
    rows += [(400 + i, rows[3][1]) for i in range(60)] + [(500 + i, [0.0] * 8) for i in range(3)]
    rows += [(20, None), (800, [math.nan] * 8), (801, [1.0, None] + [0.0] * 6), (802, [math.inf] * 8), (803, []), (600, [1.0, 2.0]),
             (620, [3.0, 1.0]), (None, [1.0] * 8), (40, rows[40][1]), (60, [2.0] * 8), (640, [-0.01] * 8), (660, [0.01] * 8)]
    assert run(spark, rows, **options) == brute(rows, 5)


def test_numbers_beyond_doubles_and_bigint(spark):
    rows = [(i, v) for i, v in vectors(4, 60, 4, 1.0)] + [(100, [2.0**30 + 1, 3.0, 0.5, 0.0]), (101, [2.0**31 + 2, 1.0, 0.25, 1.0]),
            (102, [1e300, 0.0, 1.0, 0.0]), (103, [-1e300, 2.0, 0.0, 0.0]), (120, [1e200, 1.0, 1.0, 1.0]), (140, [0.0] * 4)]
    for options in ({}, {"bucket_rows": 64, "query_rows": 2}):
        assert run(spark, rows, **options) == brute(rows, 5)


def test_fewer_than_k_and_empty(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0]), (2, [-3.0])]) == [(0, 1, 1, 64 * 128), (0, 2, 2, -64 * 192)]
    assert run(spark, []) == [] and run(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_coordinate_lists_lose_nothing(monkeypatch):
    """Groups of close vectors of one length: local cosines near 1, where lists beat scans."""
    rng = np.random.default_rng(5)
    base, rows = np.arange(100, 900, 50) * 1.0, []
    for _ in range(200):
        turn, sign = rng.permutation(16), rng.choice([-1.0, 1.0], 16)
        for _ in range(60):
            near = base.copy()
            i = rng.integers(15)
            near[[i, i + 1]] = near[[i + 1, i]]
            rows.append((near * sign)[turn])
    c, ids, qids = np.array(rows), np.arange(12000), np.arange(0, 12000, 133)
    whole = {}
    for i, j, s in t.top_in_bucket(qids, c[qids], np.full(len(qids), -np.inf), ids, c, 10):
        whole.setdefault(i, []).append((-s, j))
    want = {i: sorted(x) for i, x in whole.items()}
    scores = c @ c[qids].T
    bars = np.array([np.sort(np.delete(scores[:, n], q))[-10] for n, q in enumerate(qids)])
    used = []
    listed = t._Lists.candidates
    monkeypatch.setattr(t._Lists, "candidates", lambda self, u, x: used.append(len(r := listed(self, u, x))) or r)
    got = {}
    for i, j, s in t.top_in_bucket(qids, c[qids], bars, ids, c, 10):
        got.setdefault(i, []).append((-s, j))
    assert {i: sorted(x) for i, x in got.items()} == want
    for n, q in enumerate(qids):
        order = sorted((-int(s), j) for j, s in enumerate(scores[:, n]) if j != q)[:10]
        assert want[int(q)] == order
    assert len(used) > len(qids) // 2 and sum(used) < 0.1 * len(used) * len(rows)


def test_short_buckets_are_left_out():
    longest = np.array([9.0, 5.0, 2.0, 0.5])
    last = t._last_in_reach(longest).func
    import pandas as pd
    assert last(pd.Series([1.0, 1.0, 2.0, 0.0, 1.0]), pd.Series([5.0, 9.5, 1.0, 0.0, -np.inf])).tolist() == [2, 0, 4, 4, 4]
