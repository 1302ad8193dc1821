"""Fits in rounds, the margin by bounds, and the router that reads only prompts."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from escalade.operators import rounds as G
from escalade.operators import routing as R
from escalade.operators import training as M


def rated(spark, n=240, seed=3):
    rng = random.Random(seed)
    words = "red green blue gold grey pink".split()
    rows = []
    for i in range(n):
        good = rng.random() < 0.5
        text = [rng.choice(words) for _ in range(rng.randint(4, 9))] + (["indeed"] if good != (rng.random() < 0.1) else ["never"])
        rows.append((i, "hard " * (not good) + rng.choice(words), " ".join(text), float(good)))
    return spark.createDataFrame(rows, "pair_id int, prompt string, response string, label double")


def test_history_falls_and_the_best_state_is_kept(spark):
    scorer, hist = M.fit_with_history(rated(spark), "pair_id", rounds=5, num_features=64)
    rows = hist.orderBy("epoch").collect()
    assert [r.epoch for r in rows] == list(range(5)) and rows[-1].train_loss < rows[0].train_loss < math.log(2)
    val = M.random_split_exact(rated(spark), "pair_id", 0.9, 42).where("split = 'val'")
    best = M.best_epoch(hist).first()
    m = M.binary_metrics(scorer.score(val, "pred"), "pred", "label").first()
    assert abs(m.loss - best.val_loss) < 1e-9 and abs(m.accuracy - best.val_accuracy) < 1e-9


def test_a_round_is_plain_gradient_descent_on_one_task(spark):
    rows = rated(spark, 40).coalesce(1)
    data = M.featurizer(16).transform(rows).select("label", "features").checkpoint()
    state = np.zeros(2 * 16 + 3 + 1)
    got = G.averaged(data, state, 0.5, 0.01, 2.0, 8)
    own = state.copy()
    dense = [(np.array(r.features.toArray()), r.label) for r in data.collect()]
    for at in range(0, len(dense), 8):
        part = dense[at:at + 8]
        pull = [(1 / (1 + math.exp(-(own[:-1] @ x + own[-1]))) - y) * (2.0 if y == 1 else 1.0) for x, y in part]
        own[:-1] *= 1 - 0.5 * 0.01
        scale = 0.5 / (len(part) * max(1.0, np.mean([x @ x for x, _ in part])))
        for (x, _), g in zip(part, pull):
            own[:-1] -= scale * g * x
            own[-1] -= scale * g
    assert np.allclose(got, own, atol=1e-12)


def test_margin_equals_an_offset_fit(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(80)]
    pairs = spark.createDataFrame([("q", a, b) for a, b in zip(texts[:40], texts[40:])], "prompt string, response_preferred string, response_non_preferred string")
    scorer = M.train_pairwise(pairs, margin=0.5, num_features=4, max_iter=500, reg_param=1e-7)
    pinned = scorer.model.stages[-1].coefficients.toArray()[-1]
    assert abs(pinned + 0.5) < 1e-9
    feats = M.Pipeline(stages=M._pair_stages(4, indicator=False)).fit(M._pair_rows(pairs, 0.5, False))
    x = feats.transform(M._pair_rows(pairs, 0.5, False)).withColumn("off", -0.5 * F.col("_sgn"))
    glm = GeneralizedLinearRegression(family="binomial", offsetCol="off", weightCol="w", fitIntercept=False, regParam=1e-7, maxIter=100,
                                      linkPredictionCol="eta", featuresCol="features", labelCol="label").fit(x)
    want = [r.eta for r in glm.transform(x).orderBy("_sgn", "response", "response_b").collect()]
    data = scorer.model.transform(M._pair_rows(pairs, 0.5, False)).orderBy("_sgn", "response", "response_b").collect()
    assert np.allclose([r.rawPrediction[1] for r in data], want, atol=2e-2)
    big = M.train_pairwise(pairs, margin=0.5, num_features=4096, max_iter=5)  # beyond what a dense solver takes
    assert big.score(spark.createDataFrame([("q", "a b")], "prompt string, response string")).first().score is not None
    with pytest.raises(ValueError):
        M.train_pairwise(pairs, reg_param=0.0)


def test_bilinear_router_learns_a_direction(spark):
    rng = np.random.default_rng(6)
    q = rng.normal(size=(400, 6))
    rows = [(i, v.tolist(), int(v[0] - v[1] > 0)) for i, v in enumerate(q)] + [(900, None, 1), (901, [1.0], 0), (902, [0.0] * 6, None)]
    battles = spark.createDataFrame(rows, "id int, embedding array<double>, strong_wins int")
    model = G.fit_bilinear(battles, rank=4, rounds=30)
    held = spark.createDataFrame([(1, [2.0, -2.0, 0.0, 0.0, 0.0, 0.0]), (2, [-2.0, 2.0, 0.0, 0.0, 0.0, 0.0])], "id int, embedding array<double>")
    got = {r.id: r.win_rate for r in R.mf_win_rate(held, model).collect()}
    assert got[1] > 0.9 and got[2] < 0.1
    u = model.w * (model.v_strong - model.v_weak)
    assert abs(got[1] - 1 / (1 + math.exp(-(u @ (model.W @ np.array([2.0, -2.0, 0, 0, 0, 0]) + model.b))))) < 1e-12
    with pytest.raises(ValueError):
        G.fit_bilinear(battles.where("id >= 900 and id <> 901"))


def test_difficulty_router_reads_only_prompts(spark):
    rows = rated(spark, 300).cache()
    router = M.train_difficulty(rows.where("pair_id < 150"), rows.where("pair_id >= 150 and pair_id < 250"), num_features=64)
    asked = rows.where("pair_id >= 250").withColumnRenamed("response", "weak_response")
    rated_ = router.win_rate(asked)
    # nothing but the prompt is needed, and answers beside it change nothing
    alone = {r.pair_id: r.win_rate for r in router.win_rate(asked.select("pair_id", "prompt")).collect()}
    assert alone == {r.pair_id: r.win_rate for r in rated_.collect()}
    assert M.calibration_error(rated_).first().calibration_error < 0.15
    hard = rated_.groupBy(F.col("prompt").startswith("hard").alias("hard")).agg(F.avg("win_rate").alias("r")).collect()
    assert {r.hard: r.r > 0.5 for r in hard} == {True: True, False: False}
    kept = router.win_rate(rows.limit(3))
    assert "response" in kept.columns and kept.where("response is null or response = ''").count() == 0
    rows.unpersist()
