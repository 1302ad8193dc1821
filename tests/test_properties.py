"""Property tests: Spark expressions against plain-Python brute force on generated batches."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from escalade.functions import text as X
from escalade.operators import losses as L
from escalade.operators import metrics as M

WORDS = ["a", "b", "C", "dd", "Ee", "f", "g", "hh", "i", "jj"]
texts = st.lists(st.sampled_from(WORDS + [" ", "  ", "\n"]), min_size=0, max_size=40).map(" ".join)


def _py_label(w, s):
    if len(w) < 50:
        return 0
    ws, ss = set(w.lower().split()), set(s.lower().split())
    if not ws:
        return 0
    return 1 if len(ws & ss) / len(ws) > 0.7 else 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(texts, texts), min_size=1, max_size=60))
def test_label_and_containment_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "w string, s string")
    out = df.select("w", "s", X.adequacy_label("w", "s").alias("l"),
                    X.word_containment("w", "s").alias("c"), X.token_count("w").alias("n")).collect()
    for r in out:
        assert r["l"] == _py_label(r["w"], r["s"])
        assert r["n"] == len(r["w"].split())
        ws = set(r["w"].lower().split())
        if ws:
            assert 0.0 <= r["c"] <= 1.0
            assert math.isclose(r["c"], len(ws & set(r["s"].lower().split())) / len(ws))
        else:
            assert r["c"] is None


decisions = st.sampled_from(["weak", "strong", "weak_then_strong", "other"])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(decisions, st.floats(0, 1e-3), st.floats(0, 5e3), st.integers(0, 500), st.integers(0, 500),
                          st.integers(0, 500), st.integers(0, 500)), min_size=1, max_size=80))
def test_routing_metrics_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "model_used string, cost_usd double, latency_ms double, weak_input long, "
                                     "weak_output long, strong_input long, strong_output long")
    r = M.routing_metrics(df, percentile_method="builtin").first()
    n = len(rows)
    assert r["total_requests"] == n
    assert r["weak_only"] + r["strong_only"] + r["weak_then_strong"] <= n
    assert math.isclose(r["total_cost_usd"], sum(x[1] for x in rows), rel_tol=1e-9, abs_tol=1e-15)
    base = sum((x[3] + x[5]) * 10.0 / 1e6 + (x[4] + x[6]) * 10.0 / 1e6 for x in rows)
    assert math.isclose(r["baseline_cost_usd"], base, rel_tol=1e-9, abs_tol=1e-15)
    lat = sorted(x[2] for x in rows)
    pos = 0.95 * (n - 1)
    lo, hi = math.floor(pos), math.ceil(pos)
    p95 = lat[lo] + (lat[hi] - lat[lo]) * (pos - lo)
    assert math.isclose(r["p95_latency_ms"], p95, rel_tol=1e-9, abs_tol=1e-9)
    r2 = M.routing_metrics(df, percentile_method="counts").first()
    assert math.isclose(r2["p95_latency_ms"], p95, rel_tol=1e-9, abs_tol=1e-9)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.floats(-5, 5), st.floats(-5, 5)), min_size=1, max_size=60))
def test_pairwise_losses_nonnegative(spark, rows):
    df = spark.createDataFrame(rows, "score_preferred double, score_non_preferred double")
    bt = L.bradley_terry_loss(df).first()["loss"]
    mr = L.margin_ranking_loss(df).first()["loss"]
    exp_bt = sum(math.log1p(math.exp(-(a - b))) for a, b in rows) / len(rows)
    assert bt >= 0 and mr >= 0 and math.isclose(bt, exp_bt, rel_tol=1e-9, abs_tol=1e-12)
