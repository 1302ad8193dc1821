import numpy as np
from pyspark.sql import functions as F

from escalade.llm import block_ann as a


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = min(good.get(i, v), v, key=lambda x: (len(x), tuple(x)))
    out = []
    for q in good:
        if q % 20 == 0:
            score = lambda c: sum(np.float64(np.float32(x)) * np.float64(np.float32(y)) for x, y in zip(good[q], good[c]))
            near = sorted((-score(c), c) for c in good if c != q and len(good[c]) == len(good[q]))[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(near, 1)]
    return sorted(out)


def run(spark, rows, **options):
    base = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, rank int, c string")
    got = a.nearest(base, F.col("vec_id") % 20 == 0, **options).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * 10.0 ** rng.integers(-3, 4)]) for i in range(300)]
    rows += [(400 + i, rows[3][1]) for i in range(60)]  # a very common vector: ties go by id
    rows += [(20, None), (500, [0.0] * 8), (501, [float("nan")] * 8), (502, [1.0, None] + [0.0] * 6), (503, [float("inf")] * 8), (504, []),
             (600, [1.0, 2.0]), (620, [3.0, 1.0]), (None, [1.0] * 8), (40, rows[40][1]), (60, [2.0] * 8)]
    want = brute(rows, 5)
    for options in ({}, {"query_rows": 4, "cell_rows": 30}):
        got = run(spark, rows, k=5, **options)
        assert [x[:3] for x in got] == [x[:3] for x in want]
        assert all(g[3] == w[3] for g, w in zip(got, want))


def test_pruning_keeps_the_nearest():
    rng = np.random.default_rng(4)
    q, c = rng.normal(size=(20, 64)), rng.normal(size=(3000, 64))
    got = {}
    for i, j, s in a.nearest_in_cell(np.arange(20) + 10**6, q, np.arange(3000), c, 10, tile=256):
        got.setdefault(i - 10**6, []).append((-s, j))
    for i in range(20):
        assert [j for _, j in sorted(got[i])] == np.argsort(-(c @ q[i]), kind="stable")[:10].tolist()


def test_fewer_than_k_and_empty(spark):
    assert [x[:3] for x in run(spark, [(0, [1.0]), (1, [2.0]), (2, [3.0])])] == [(0, 1, 2), (0, 2, 1)]
    assert run(spark, []) == []


def test_products_that_overflow(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, 5.0]), (2, [1.0, 1.0]), (3, [-1e200, 2.0]), (20, [1e308, 1e308]), (4, [1e308, -1e308])]
    base = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r) for r in a.nearest(base, F.col("vec_id") % 20 == 0, k=20).collect())
    assert [x[:3] for x in got if x[0] == 0] == [(0, 1, 1), (0, 2, 4), (0, 3, 20), (0, 4, 2), (0, 5, 3)]
    assert len([x for x in got if x[0] == 20]) == 5 and [x[3] for x in got if x[:2] == (20, 5)] == [float("-inf")]
