"""R4 over groups of rows and cells within them."""

import numpy as np

from escalade.operators import routing as R


def expected(queries, battles, gamma):
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1.0, n)
    cos = unit(np.array([e for _, e in queries])) @ unit(np.array([e for _, e, _ in battles])).T
    top, won, out = cos.max(axis=1), np.array([float(w) for *_, w in battles]), {}
    for (i, _), c, m in zip(queries, cos, top):
        w = gamma ** (1.0 + (c / m if m > 0 else 0 * c))
        out[i] = (w @ won / w.sum(), m)
    return out


def test_rates_do_not_depend_on_groups_or_cells(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vec = lambda: [float(x) for x in rng.normal(size=5).astype(np.float32)]
    battles = [(i, [abs(x) for x in vec()], int(rng.integers(0, 2))) for i in range(70)]
    queries = [*((i, vec()) for i in range(40)), (40, [0.0] * 5), (41, [-1.0] * 5), (42, battles[3][1])]
    q = spark.createDataFrame([*queries, (43, None)], "query_id bigint, embedding array<float>")
    b = spark.createDataFrame([*battles, (70, None, 1), (71, vec(), None)], "battle_id bigint, embedding array<float>, strong_wins int")
    want = expected(queries, battles, 4.0)
    for groups, cell in (((8192, 16_384), (100, 64)), ((8192, 16_384), (7, 3)), ((9, 16), (4, 5))):
        monkeypatch.setattr(R, "GROUP_ROWS", groups)
        got = {r.query_id: (r.win_rate, r.max_cos) for r in R.sw_win_rate(q, b, gamma=4.0, query_rows=cell[0], battle_rows=cell[1]).collect()}
        assert got.pop(43) == (None, None) and got.keys() == want.keys()
        assert all(np.allclose(got[i], want[i], rtol=1e-9, atol=1e-12) for i in want)


def test_rows_are_copied_per_group_not_per_cell():
    """61,500 queries and 553,500 battles in cells of 100 by 64: once per cell, each battle was copied 615 times, each query 8,649 times."""
    assert R._grid(61_500, 553_500, 100, 64, 12) == (8, 34)
    assert R._grid(10_000, 92_000, 100, 64, 12) == (2, 24)  # cores have work
    assert R._grid(50, 450, 100, 64, 12) == (1, 1) and R._grid(0, 0, 100, 64, 12) == (1, 1)
    assert R._grid(50_000, 500_000, 20_000, 100_000, 12) == (3, 5)  # larger cells are kept
