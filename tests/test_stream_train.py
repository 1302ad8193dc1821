"""Streaming equals batch; late rows are dropped; training beats the majority baseline; reload is identical."""

import math

from pyspark.sql import functions as F

from escalade.operators import datasets as D
from escalade.operators import training as M
from escalade.sources import fixtures as fx
from escalade.streaming import chunks as C
from escalade.streaming import monitor as W
from escalade.streaming import runner as S
from tests.conftest import SF01


def test_chunks_stream_equals_batch_with_duplicates(spark, tmpdir_path):
    rows = [(1, 0, 2, "c ", None, None), (1, 0, 0, "a ", "assistant", None), (1, 0, 1, "b ", None, None),
            (1, 0, 1, "b ", None, None), (1, 0, 3, "", None, "stop"), (2, 0, 0, "x", "assistant", "stop")]
    schema = "id long, index int, seq long, content string, role string, finish_reason string"
    df = spark.createDataFrame(rows, schema)
    batch = {r["id"]: r for r in C.assemble_chunks(df).collect()}
    assert batch[1]["content"] == "a b c " and batch[1]["n_chunks"] == 4 and batch[1]["finish_reason"] == "stop"
    path = f"{tmpdir_path}/chunks"
    df.write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    out = {r["id"]: r for r in S.run_available_now(C.assemble_chunks(stream), "chunks_t", "complete", "memory").collect()}
    assert {k: (v["content"], v["role"], v["finish_reason"]) for k, v in out.items()} == \
           {k: (v["content"], v["role"], v["finish_reason"]) for k, v in batch.items()}


def test_window_metrics_stream_complete_equals_batch(spark, tmpdir_path):
    rr = fx.routing_results(spark, SF01)
    path = f"{tmpdir_path}/rr"
    rr.select("request_id", "ts", "model_used", "cost_usd").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    s = S.run_available_now(W.window_cost_by_model(stream, "1 day"), "wm_t", "complete", "memory")
    b = W.window_cost_by_model(rr, "1 day")
    key = lambda r: (str(r["window_start"]), r["model_used"], r["n"], round(r["cost_usd"], 9))
    assert sorted(map(key, s.collect())) == sorted(map(key, b.collect()))


def test_late_rows_dropped_in_append(spark, tmpdir_path):
    import datetime as dt
    schema = "ts timestamp, model_used string, cost_usd double"
    base = dt.datetime(2024, 1, 1)
    d1 = f"{tmpdir_path}/late"
    spark.createDataFrame([(base + dt.timedelta(hours=h), "weak", 1.0) for h in (1, 2, 30, 55)], schema) \
        .coalesce(1).write.parquet(d1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d1)
    q = W.window_cost_by_model(stream, "1 day", watermark="1 hour")
    out = S.run_available_now(q, "late_t", "append", "memory").collect()
    # windows closed by the watermark (max ts 55h - 1h) are emitted: day 1 (2 rows) and day 2 (1 row)
    got = sorted((str(r["window_start"])[:10], r["n"]) for r in out)
    assert got == [("2024-01-01", 2), ("2024-01-02", 1)]


def test_training_beats_majority_and_reload(spark, tmpdir_path):
    rp = fx.response_pairs(spark, SF01)
    samples = D.to_adequacy_samples(D.adequacy_dataset(rp, keep=("pair_id",)), keep=("pair_id",))
    split = D.random_split_exact(samples, "pair_id", 0.8, 42).cache()
    train, val = split.where("split = 'train'"), split.where("split = 'val'")
    model = M.train_adequacy(train, num_features=512)
    m = M.evaluate_scorer(model, val).first()
    p = train.agg(F.avg("label")).first()[0]
    y = [r["label"] for r in val.select("label").collect()]
    majority = -sum(yy * math.log(p) + (1 - yy) * math.log(1 - p) for yy in y) / len(y)
    assert m["loss"] < majority
    M.save_scorer(model, f"{tmpdir_path}/scorer", {"epoch": 0, "val_loss": m["loss"]})
    loaded, meta = M.load_scorer(spark, f"{tmpdir_path}/scorer")
    a = [r["pred"] for r in M.score_column(model, val, "pred").orderBy("pair_id").collect()]
    b = [r["pred"] for r in M.score_column(loaded, val, "pred").orderBy("pair_id").collect()]
    assert a == b and meta["epoch"] == 0


def test_pairwise_scorer_ranks_preferred(spark):
    rp = fx.response_pairs(spark, SF01)
    pairs = D.orient_pairs(D.pairwise_dataset(rp, keep=("pair_id",)), keep=("pair_id",))
    scorer = M.train_pairwise(pairs, num_features=128)
    sp = scorer.score(pairs.select("pair_id", "prompt", F.col("response_preferred").alias("response")), "sp")
    sn = scorer.score(pairs.select("pair_id", "prompt", F.col("response_non_preferred").alias("response")), "sn")
    acc = sp.join(sn.select("pair_id", "sn"), "pair_id").agg(F.avg((F.col("sp") > F.col("sn")).cast("double"))).first()[0]
    assert acc > 0.5


def test_chunks_session_append(spark, tmpdir_path):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    rows = [(1, 0, s, f"w{s} ", "assistant" if s == 0 else None, None, base + dt.timedelta(seconds=s)) for s in range(3)]
    rows += [(2, 0, 0, "x", "assistant", "stop", base + dt.timedelta(minutes=30))]
    schema = "id long, index int, seq long, content string, role string, finish_reason string, created timestamp"
    path = f"{tmpdir_path}/ch"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(schema).parquet(path).withWatermark("created", "1 minute")
    out = S.run_available_now(C.assemble_chunks(stream, session_gap="10 seconds"), "sess_t", "append", "memory")
    got = {r["id"]: r["content"] for r in out.collect()}
    # completion 1's session closed (watermark passed it); completion 2 is still open at the end of input
    assert got == {1: "w0 w1 w2 "}


def test_pairwise_weights_antisymmetric(spark):
    rp = fx.response_pairs(spark, SF01)
    pairs = D.orient_pairs(D.pairwise_dataset(rp, keep=("pair_id",)), keep=("pair_id",))
    scorer = M.train_pairwise(pairs, num_features=64, max_iter=200, reg_param=0.05)
    w = scorer.model.stages[-1].coefficients.toArray()
    half = len(w) // 2
    u, v = w[:half], w[half:]
    assert abs(u + v).max() <= 1e-3 * max(abs(u).max(), 1e-12) + 1e-6  # optimum satisfies w_B = -w_A


def test_window_sketches_stream_merge_and_late_rows(spark, tmpdir_path):
    import datetime as dt
    import time
    base, path = dt.datetime(2024, 1, 1), f"{tmpdir_path}/sk"
    schema = "request_id long, ts timestamp, model_used string, latency_ms double, cost_usd double"
    rows = [(i, base + dt.timedelta(minutes=i), ("weak", "strong", "weak_then_strong")[i % 3], float(i * 7919 % 1000), 0.5) for i in range(2880)]
    rows[5] = (*rows[5][:3], None, 0.5)
    for part in (rows, [(9000, base + dt.timedelta(days=9), "weak", 1.0, 0.5)], [(9001, base, "strong", 5.0, 0.5)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out, late = S.run_counting_late(W.window_sketches(stream, "1 hour", "10 minutes"), "sk")
    assert late == 1
    days = W.sketch_metrics(W.merge_windows(out, "1 day")).orderBy("window_start").collect()
    assert [(r.n, round(r.strong_pct, 3), round(r.trigger_rate, 3), r.cost_usd) for r in days] == [(1440, 66.667, 33.333, 720.0)] * 2
    for n, r in enumerate(days):
        own = sorted(x[3] for x in rows[n * 1440:(n + 1) * 1440] if x[3] is not None)
        assert abs(sum(x <= r.p95_latency_ms for x in own) / len(own) - 0.95) < 0.005
        assert abs(r.avg_latency_ms - sum(own) / len(own)) < 1e-9
