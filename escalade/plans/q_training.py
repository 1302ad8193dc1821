"""Registered queries: model application (U2-U4), scorer training and evaluation.

Training outputs depend on the optimiser, so those queries emit facts that hold for any good fit (split sizes, held-out
results better than a constant guess, identical scores after reload), and their oracles state them. Model application with
deterministic stand-in functions has DuckDB oracles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from escalade.functions.hashing import hash32, hash32_sql
from escalade.functions.quantiles import valid
from escalade.operators import datasets as D
from escalade.operators import scoring as U
from escalade.operators import training as M
from escalade.operators.routing import route
from escalade.plans.catalog import register, rounded
from escalade.plans.oracle_views import with_views
from escalade.sources import fixtures as fx
from escalade.sources.tables import load


@register("L3_best_epoch", with_views(["train_history"], """
select epoch::bigint as epoch, val_loss from train_history order by val_loss, epoch limit 1"""))
def l3(spark, sf):
    return rounded(M.best_epoch(fx.train_history(spark, sf)))


# ---------------------------------------------------------------- stand-in models (deterministic)

def _weak_model(prompt: str) -> str:
    if len(prompt) % 13 == 0:
        raise TimeoutError("simulated timeout")
    return prompt[:40]


def _strong_model(prompt: str) -> str:
    return prompt + " " + prompt


def _judge(prompt: str, response: str) -> float:
    return float(len(response or "") % 5 + 1)


def _user_prompts(spark, sf):
    c = load(spark, sf, "conversations").where(F.col("role") == "user")
    return c.select((F.col("conv_id") * 4294967296 + F.col("turn")).alias("pair_id"), F.col("text").alias("prompt"))


@register("U2_collect_responses", """
select conv_id * 4294967296 + turn as pair_id,
       case when length(text) % 13 = 0 then '' else substr(text, 1, 40) end as weak_response,
       text || ' ' || text as strong_response,
       case when length(text) % 13 = 0 then 'TimeoutError: simulated timeout' end as error
from conversations where role = 'user'""")
def u2(spark, sf):
    out = U.collect_responses(_user_prompts(spark, sf), _weak_model, _strong_model)
    return out.select("pair_id", "weak_response", "strong_response", "error")


@register("U2_collect_with_ledger", """
select conv_id * 4294967296 + turn as pair_id,
       case when length(text) % 13 = 0 then '' else substr(text, 1, 40) end as weak_response,
       text || ' ' || text as strong_response,
       case when length(text) % 13 = 0 then 'TimeoutError: simulated timeout' end as error,
       case when length(text) % 13 = 0 then 3 else 2 end::bigint as attempts
from conversations where role = 'user'""")
def u2_ledger(spark, sf):
    """The same through a ledger, in two runs: the first one has half of the prompts, the second one all and calls the others only."""
    from escalade.session import scratch_path
    asked, ledger = _user_prompts(spark, sf), scratch_path(spark, "ledger")
    half = asked.where(F.col("pair_id") % 2 == 0)
    for part in (half, asked):
        out = U.collect_with_ledger(part, _weak_model, _strong_model, ledger, wave_rows=1000, retries=1, backoff_s=0.0)
    return rounded(out.select("pair_id", "weak_response", "strong_response", "error", "attempts"))


@register("U3_score_batch", with_views(["response_pairs"], r"""
select pair_id,
       round(case when len(W) = 0 then null else len(list_intersect(W, S)) / len(W) end, 6) as score
from (select pair_id,
             list_distinct(list_filter(regexp_split_to_array(lower(weak_response), '\s+'), lambda t: t <> '')) as W,
             list_distinct(list_filter(regexp_split_to_array(lower(strong_response), '\s+'), lambda t: t <> '')) as S
      from response_pairs) x"""))
def u3(spark, sf):
    rp = fx.response_pairs(spark, sf).select("pair_id", F.col("strong_response").alias("prompt"),
                                             F.col("weak_response").alias("response"))
    s = U.score_batch(rp, U.containment_batch, batch_size=32)
    return rounded(s.select("pair_id", F.when(valid("score"), F.col("score")).alias("score")))


@register("U4_judge_labels", with_views(["response_pairs"], """
select pair_id, (length(weak_response) % 5 + 1)::double as judge_score,
       case when length(weak_response) % 5 + 1 >= 4 then 1 else 0 end::bigint as label
from response_pairs"""))
def u4(spark, sf):
    j = U.judge_labels(fx.response_pairs(spark, sf), _judge, cutoff=4.0)
    return rounded(j.select("pair_id", "judge_score", "label"))


@register("U1_pandas_scorer", with_views(["response_pairs"], r"""
select pair_id,
       round(case when len(W) = 0 then null else len(list_intersect(W, S)) / len(W) end, 6) as score
from (select pair_id,
             list_distinct(list_filter(regexp_split_to_array(lower(weak_response), '\s+'), lambda t: t <> '')) as W,
             list_distinct(list_filter(regexp_split_to_array(lower(strong_response), '\s+'), lambda t: t <> '')) as S
      from response_pairs) x"""))
def u1(spark, sf):
    scorer = U.pandas_scorer(U.containment_batch)
    rp = fx.response_pairs(spark, sf)
    s = rp.select("pair_id", scorer(F.col("strong_response"), F.col("weak_response")).alias("score"))
    return rounded(s.select("pair_id", F.when(valid("score"), F.col("score")).alias("score")))


_LABEL_SQL = r"""case when length(weak_response) < 50 then 0 when len(W(weak_response)) = 0 then 0
    when len(list_intersect(W(weak_response), W(strong_response))) / len(W(weak_response)) > 7e-1 then 1 else 0 end"""
for _side in ("weak_response", "strong_response"):
    _LABEL_SQL = _LABEL_SQL.replace(f"W({_side})", rf"list_distinct(list_filter(regexp_split_to_array(lower({_side}), '\s+'), lambda t: t <> ''))")

# ---------------------------------------------------------------- training
# Fits run with the operators' defaults and are judged on rows they haven't seen. The oracle states the checkable facts:
# how many rows each split has, and that the fit beats what a constant guess would do.

def _adequacy_samples(spark, sf):
    rp = fx.response_pairs(spark, sf)
    return D.to_adequacy_samples(D.adequacy_dataset(rp, keep=("pair_id",)), keep=("pair_id",))


def _split(spark, sf):
    return D.random_split_exact(_adequacy_samples(spark, sf), "pair_id", 0.8, seed=42)


_SPLIT_SQL = f"""select pair_id, case when row_number() over (order by {hash32_sql('pair_id', 42)}, pair_id) - 1
    < cast(floor((select count(*) from response_pairs) * 8e-1) as bigint) then 'train' else 'val' end as split from response_pairs"""


def _facts(scored, pred: str = "pred"):
    """Per split: rows, and whether the log loss is below that of always guessing the split's own share."""
    y, p = F.col("label"), F.greatest(F.least(F.col(pred), F.lit(1 - 1e-9)), F.lit(1e-9))
    r = F.col("rate")
    g = scored.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate"),
                                    F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("loss"))
    return g.select("split", "n", (F.col("loss") < -(r * F.log(r) + (1 - r) * F.log(1 - r))).alias("beats_constant"))


@register("M1_train_adequacy", with_views(["response_pairs"], """
select split, count(*)::bigint as n, true as beats_constant from split group by split""", extra=[("split", _SPLIT_SQL)]))
def m1(spark, sf):
    s = _split(spark, sf)
    model = M.train_adequacy(s.where("split = 'train'"), pos_weight=1.0)
    return _facts(M.score_column(model, s, "pred"))


def _pairs(spark, sf):
    rp = fx.response_pairs(spark, sf)
    return D.random_split_exact(D.orient_pairs(D.pairwise_dataset(rp, keep=("pair_id",)), keep=("pair_id",)), "pair_id", 0.8, seed=42)


def _pair_accuracy(scorer, pairs):
    a = scorer.score(pairs.select("pair_id", "prompt", F.col("response_preferred").alias("response")), "sp")
    b = scorer.score(pairs.select("pair_id", "prompt", F.col("response_non_preferred").alias("response")), "sn")
    j = a.select("pair_id", "sp").join(b.select("pair_id", "sn"), "pair_id")
    return j.agg(F.count(F.lit(1)).alias("n"), (F.avg((F.col("sp") > F.col("sn")).cast("double")) > 0.5).alias("beats_chance"))


_PAIR_SQL = with_views(["response_pairs"], """
select count(*)::bigint as n, true as beats_chance from split where split = 'val'""",
                       extra=[("split", _SPLIT_SQL)])


@register("M2_train_pairwise", _PAIR_SQL)
def m2(spark, sf):
    pairs = _pairs(spark, sf)
    return _pair_accuracy(M.train_pairwise(pairs.where("split = 'train'")), pairs.where("split = 'val'"))


@register("M2_train_pairwise_margin", _PAIR_SQL)
def m2_margin(spark, sf):
    pairs = _pairs(spark, sf)
    scorer = M.train_pairwise(pairs.where("split = 'train'"), margin=0.5)
    return _pair_accuracy(scorer, pairs.where("split = 'val'"))


@register("M3_train_combined", _PAIR_SQL)
def m3(spark, sf):
    pairs, samples = _pairs(spark, sf), _split(spark, sf)
    scorer = M.train_combined(samples.where("split = 'train'"), pairs.where("split = 'train'"))
    return _pair_accuracy(scorer, pairs.where("split = 'val'"))


@register("M4_fit_with_history", with_views(["response_pairs"], """
select 8::bigint as rounds, 0::bigint as first_epoch, 7::bigint as last_epoch, count(*) filter (where split = 'val')::bigint as val_rows,
       true as loss_fell, true as learned, true as kept_state_has_lowest_loss
from split""", extra=[("split", f"""select pair_id, case when row_number() over (order by {hash32_sql('pair_id', 42)}, pair_id) - 1
    < cast(floor((select count(*) from response_pairs) * 9e-1) as bigint) then 'train' else 'val' end as split from response_pairs""")]))
def m4(spark, sf):
    """Eight rounds of one fit. The training loss at the end is below that of the first round and of knowing nothing (ln 2), and the kept
    state, scored anew on the validation rows, has the lowest validation loss of the written history (the first such round)."""
    from escalade.session import scratch_path
    samples = _adequacy_samples(spark, sf)
    scorer, hist = M.fit_with_history(samples, "pair_id")
    path = scratch_path(spark, "history")
    hist.write.parquet(path)
    hist = spark.read.parquet(path)
    val = D.random_split_exact(samples, "pair_id", 0.9, 42).where("split = 'val'")
    kept = M.binary_metrics(scorer.score(val, "pred"), "pred", "label").select(F.col("loss").alias("kept_loss"), F.col("n").alias("val_rows"))
    best = M.best_epoch(hist).select(F.col("val_loss").alias("best_loss"))
    told = hist.agg(F.count(F.lit(1)).alias("rounds"), F.min("epoch").cast("bigint").alias("first_epoch"), F.max("epoch").cast("bigint").alias("last_epoch"),
                    F.max_by("train_loss", "epoch").alias("end"), F.min_by("train_loss", "epoch").alias("start"), F.min("val_loss").alias("lowest"))
    j = told.crossJoin(F.broadcast(kept)).crossJoin(F.broadcast(best))  # one row each
    return j.select("rounds", "first_epoch", "last_epoch", F.col("val_rows").cast("bigint").alias("val_rows"), (F.col("end") < F.col("start")).alias("loss_fell"),
                    (F.col("end") < F.log(F.lit(2.0))).alias("learned"),
                    ((F.abs(F.col("kept_loss") - F.col("best_loss")) < 1e-9) & (F.col("best_loss") == F.col("lowest"))).alias("kept_state_has_lowest_loss"))


@register("M5_evaluate_scorer", with_views(["response_pairs"], """
select 'val' as split, count(*)::bigint as n, true as loss_is_finite, true as better_than_half from split where split = 'val'""",
                                           extra=[("split", _SPLIT_SQL)]))
def m5(spark, sf):
    s = _split(spark, sf)
    val = s.where("split = 'val'")
    m = M.evaluate_scorer(M.train_adequacy(s.where("split = 'train'")), val)
    n = val.agg(F.lit("val").alias("split"), F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(m.drop("n"))).select("split", "n", (F.col("loss") < float("inf")).alias("loss_is_finite"),
                                              (F.col("accuracy") > 0.5).alias("better_than_half"))


_THIRDS = f"""select pair_id, label, case when o < cast(floor(n * 6e-1) as bigint) then 'train'
    when o < cast(floor(n * 8e-1) as bigint) then 'calibrate' else 'val' end as part
from (select pair_id, {_LABEL_SQL} as label, count(*) over () as n, row_number() over (order by {hash32_sql('pair_id', 42)}, pair_id) - 1 as o
      from response_pairs) x"""


@register("R5_classifier_win_rate", with_views(["response_pairs"], """
select t.pair_id as request_id, round(1 - c.rate, 6) as inadequate_among_calibration, true as mean_rate_is_that_share,
       true as order_is_kept, true as decided_by_rate
from t, (select avg(label) as rate from t where part = 'calibrate') c where part = 'val'""", extra=[("t", _THIRDS)]))
def r5(spark, sf):
    """Requests of held-out rows, routed before anything is generated: the classifier is fitted on prompts, its rates are calibrated on
    other rows (there their mean is the share of inadequate answers), and a higher raw score never gets a lower rate."""
    s = _adequacy_samples(spark, sf)
    ranked = D.prefix_split(s, [hash32(F.col("pair_id"), 42), "pair_id"], 0.8, "split", "o").checkpoint()
    n = ranked.count()
    train, calibrate = ranked.where(F.col("o") < int(n * 0.6)), ranked.where((F.col("o") >= int(n * 0.6)) & (F.col("split") == "train"))
    router = M.train_difficulty(train, calibrate)
    seen = router.win_rate(calibrate.select("prompt", "label")).agg(F.avg("win_rate").alias("mean"), F.avg(1.0 - F.col("label")).alias("share"))
    asked = ranked.where("split = 'val'").select(F.col("pair_id").alias("request_id"), "prompt")
    rated = router.calibration.transform(router.raw(asked)).withColumnRenamed("prediction", "win_rate")
    # by rate: the raw scores of a higher rate all lie above those of a lower one (a plateau per rate, as many as calibration made)
    plateau = rated.groupBy("win_rate").agg(F.min("_raw").alias("low"), F.max("_raw").alias("high"))
    pairs = plateau.alias("a").join(plateau.alias("b"), F.expr("a.win_rate < b.win_rate and a.high >= b.low"))
    kept = pairs.agg((F.count(F.lit(1)) == 0).alias("order_is_kept"))
    out = rated.withColumn("decision", route("win_rate", 0.5)).crossJoin(F.broadcast(seen)).crossJoin(F.broadcast(kept))  # one row each
    return rounded(out.select("request_id", F.col("share").alias("inadequate_among_calibration"),
                              (F.abs(F.col("mean") - F.col("share")) < 1e-9).alias("mean_rate_is_that_share"), "order_is_kept",
                              ((F.col("decision") == "strong") == (F.col("win_rate") >= 0.5)).alias("decided_by_rate")))


@register("S9_save_load_scorer", with_views(["response_pairs"], """
select pair_id, true as identical, 1024::bigint as num_features from response_pairs"""))
def s9(spark, sf):
    """Persist a trained scorer with its metadata in the shared checkpoint folder, reload it, score again."""
    from escalade.session import scratch_path
    s = _split(spark, sf)
    model = M.train_adequacy(s.where("split = 'train'"))
    path = scratch_path(spark, "scorer")
    M.save_scorer(model, path, {"epoch": 0, "num_features": 1024})
    loaded, meta = M.load_scorer(spark, path)
    a = M.score_column(model, s, "pred_saved").select("pair_id", "pred_saved")
    b = M.score_column(loaded, s, "pred_loaded").select("pair_id", "pred_loaded")
    j = a.join(b, "pair_id")
    return j.select("pair_id", (F.col("pred_saved") == F.col("pred_loaded")).alias("identical"),
                    F.lit(meta["num_features"]).cast("bigint").alias("num_features"))
