"""Response-quality scorers trained with Spark ML.

The reference fine-tunes a transformer on one machine; here the same objectives run as distributed Spark ML fits
(gradient aggregation over partitions):

* adequacy (M1): P(adequate | prompt, response), weighted logistic regression (``pos_weight`` via ``weightCol``);
* pairwise (M2): Bradley-Terry = logistic regression without intercept on x(prompt, preferred) -
  x(prompt, non_preferred), obtained with sparse features only: both responses sit in two slots of one vector and
  every pair also enters mirrored, so the regularised optimum is antisymmetric across the slots (see
  :func:`train_pairwise`). A margin is a feature whose coefficient is held by bounds. Slot A's weights score a single response;
* combined (M3): adequacy rows and pair rows in one no-intercept fit, weighted wa / wp.

Features are hashed bags of words of prompt and response (HashingTF) plus length and overlap features, assembled
into one vector; every stage is a persistable ML stage.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Matrices
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from escalade.functions.hashing import hash32
from escalade.operators import rounds as rounds_of
from escalade.operators.datasets import random_split_exact
from escalade.operators.losses import binary_metrics
from escalade.schemas import TRAIN_BATCH_SIZE

WS_SQL = r"(?U)\\s+"
NUMERIC = ("f_log_chars", "f_log_tokens", "f_overlap")


def featurizer_stages(num_features: int = 1024, prompt: str = "prompt", response: str = "response",
                      out: str = "features", tag: str = "") -> list:
    """Tokens, hashed term frequencies and numeric features -> ``out`` (all persistable stages; sparse)."""
    tok = lambda c: f"filter(split(lower(coalesce({c}, '')), '{WS_SQL}'), t -> t <> '')"
    num = [f"{n}{tag}" for n in NUMERIC]
    sql = SQLTransformer(statement=f"""
        SELECT *, {tok(prompt)} AS _ptok{tag}, {tok(response)} AS _rtok{tag},
               log1p(length(coalesce({response}, ''))) AS {num[0]},
               log1p(size({tok(response)})) AS {num[1]},
               coalesce(try_divide(size(array_intersect(array_distinct({tok(response)}), array_distinct({tok(prompt)}))),
                                   size(array_distinct({tok(response)}))), 0D) AS {num[2]}
        FROM __THIS__""")
    drop = ", ".join([f"_ptok{tag}", f"_rtok{tag}", f"_rtf{tag}", f"_ptf{tag}"] + (num if tag else []))
    return [sql,
            HashingTF(inputCol=f"_rtok{tag}", outputCol=f"_rtf{tag}", numFeatures=num_features),
            HashingTF(inputCol=f"_ptok{tag}", outputCol=f"_ptf{tag}", numFeatures=num_features),
            VectorAssembler(inputCols=[f"_rtf{tag}", f"_ptf{tag}", *num], outputCol=out),
            SQLTransformer(statement=f"SELECT * EXCEPT ({drop}) FROM __THIS__")]


def featurizer(num_features: int = 1024) -> PipelineModel:
    """The feature stages as a fitted (stateless) pipeline."""
    return PipelineModel(stages=featurizer_stages(num_features))


def _with_weight(df: DataFrame, label: str, pos_weight: float) -> DataFrame:
    return df.withColumn("w", F.when(F.col(label) == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0)))


def train_adequacy(samples: DataFrame, pos_weight: float = 1.0, num_features: int = 1024, max_iter: int = 50,
                   reg_param: float = 0.01) -> PipelineModel:
    """M1: adequacy scorer on (prompt, response, label) samples."""
    data = _with_weight(samples.withColumn("label", F.col("label").cast("double")), "label", pos_weight)
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", maxIter=max_iter,
                            regParam=reg_param)
    return Pipeline(stages=[*featurizer_stages(num_features), lr]).fit(data)


def score_column(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """Apply a scorer: the positive-class probability as a DOUBLE column."""
    t = model.transform(df)
    return t.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability",
                                                                     "prediction", *NUMERIC)


def _pair_stages(num_features: int, indicator: bool, sign: bool = False) -> list:
    """Two feature slots (the scored response in slot A, the other one in slot B) assembled into one sparse vector,
    plus the adequacy indicator for the combined model, or the pair's direction for a margin."""
    return [*featurizer_stages(num_features, "prompt", "response", "_xa", "_a"),
            *featurizer_stages(num_features, "prompt_b", "response_b", "_xb", "_b"),
            VectorAssembler(inputCols=["_xa", "_xb", *(["ind"] if indicator else []), *(["_sgn"] if sign else [])], outputCol="features"),
            SQLTransformer(statement="SELECT * EXCEPT (_xa, _xb) FROM __THIS__")]


def _pair_rows(pairs: DataFrame, weight: float, indicator: bool) -> DataFrame:
    """Each pair twice: (preferred | non-preferred, label 1) and mirrored (non-preferred | preferred, label 0)."""
    ind = [F.lit(0.0).alias("ind")] if indicator else []
    fwd = pairs.select("prompt", F.col("response_preferred").alias("response"), F.col("prompt").alias("prompt_b"),
                       F.col("response_non_preferred").alias("response_b"), F.lit(1.0).alias("label"),
                       F.lit(1.0).alias("_sgn"), *ind)
    rev = pairs.select("prompt", F.col("response_non_preferred").alias("response"), F.col("prompt").alias("prompt_b"),
                       F.col("response_preferred").alias("response_b"), F.lit(0.0).alias("label"),
                       F.lit(-1.0).alias("_sgn"), *ind)
    return fwd.unionByName(rev).withColumn("w", F.lit(float(weight)))


@dataclass
class PairwiseScorer:
    """A scorer trained on pairs: a fitted pipeline whose linear predictor, with the scored response in slot A and
    an empty slot B, is the response score (``indicator`` = 1.0 adds the adequacy offset of the combined model)."""
    model: PipelineModel

    def score(self, df: DataFrame, out: str = "score", indicator: float = 0.0) -> DataFrame:
        x = (df.withColumn("prompt_b", F.lit("")).withColumn("response_b", F.lit(""))
             .withColumn("ind", F.lit(float(indicator))).withColumn("_sgn", F.lit(0.0)))
        t = self.model.transform(x)
        return t.withColumn(out, vector_to_array("rawPrediction")[1]).drop("prompt_b", "response_b", "ind", "_sgn", "features",
                                                                           "rawPrediction", "probability", "prediction")


def train_pairwise(pairs: DataFrame, margin: float = 0.0, num_features: int = 1024, max_iter: int = 50,
                   reg_param: float = 0.01) -> PairwiseScorer:
    """M2: Bradley-Terry fit on (prompt, response_preferred, response_non_preferred).

    Features stay sparse: slot A holds x(prompt, response), slot B the other response. With every pair mirrored,
    the L2-regularised no-intercept logistic objective is invariant under swapping the slots and flipping the
    label, so its unique optimum has w_B = -w_A: the fit *is* logistic regression on x_p - x_n, and w_A scores a
    single response.

    A margin m asks for s_p - s_n >= m: the predictor of a forward pair is lowered by m, that of a mirrored one raised. The
    direction (+1 / -1) is one more feature whose coefficient is held at -m by bounds, so the fit stays sparse at any number of
    features (bounded L-BFGS keeps two dense vectors of coefficients, no matrix).
    """
    if reg_param <= 0:
        raise ValueError("reg_param must be > 0 (it makes the symmetric optimum unique)")
    data = _pair_rows(pairs, 0.5, indicator=False)
    feats = Pipeline(stages=_pair_stages(num_features, indicator=False, sign=margin != 0.0)).fit(data)
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", fitIntercept=False, maxIter=max_iter, regParam=reg_param)
    if margin != 0.0:
        size = 2 * (2 * num_features + len(NUMERIC)) + 1  # the direction comes last
        # the others are as good as free (bounds are scaled by deviations, which may be 0: infinite ones would become NaN)
        bound = lambda free: Matrices.dense(1, size, [free] * (size - 1) + [-float(margin)])
        lr = lr.setLowerBoundsOnCoefficients(bound(-1e30)).setUpperBoundsOnCoefficients(bound(1e30))
    return PairwiseScorer(PipelineModel(stages=[*feats.stages, lr.fit(feats.transform(data))]))


def train_combined(adequacy: DataFrame, pairs: DataFrame, wa: float = 1.0, wp: float = 1.0,
                   num_features: int = 1024, max_iter: int = 50, reg_param: float = 0.01) -> PairwiseScorer:
    """M3: one no-intercept, L2-regularised logistic fit over adequacy and pair rows (sparse features).

    Adequacy rows enter as (x | empty, indicator 1, label y) and mirrored (empty | x, indicator -1, label 1 - y);
    pairs as in M2 with indicator 0. The objective is again symmetric under the slot swap, so w_B = -w_A and the
    indicator weight is the adequacy offset. Row weights make it wa * mean(adequacy loss) + wp * mean(pair loss).
    """
    if reg_param <= 0:
        raise ValueError("reg_param must be > 0 (it makes the symmetric optimum unique)")
    n_a, n_p = adequacy.count(), pairs.count()
    wa_row, wp_row = 0.5 * float(wa) / max(n_a, 1), 0.5 * float(wp) / max(n_p, 1)
    y = F.col("label").cast("double")
    a1 = adequacy.select("prompt", "response", F.lit("").alias("prompt_b"), F.lit("").alias("response_b"),
                         y.alias("label"), F.lit(1.0).alias("ind"))
    a2 = adequacy.select(F.lit("").alias("prompt"), F.lit("").alias("response"), F.col("prompt").alias("prompt_b"),
                         F.col("response").alias("response_b"), (F.lit(1.0) - y).alias("label"), F.lit(-1.0).alias("ind"))
    rows = (a1.unionByName(a2).withColumn("w", F.lit(wa_row))
            .unionByName(_pair_rows(pairs, wp_row, indicator=True).drop("_sgn")))
    feats = Pipeline(stages=_pair_stages(num_features, indicator=True)).fit(rows)
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", fitIntercept=False,
                            maxIter=max_iter, regParam=reg_param).fit(feats.transform(rows))
    return PairwiseScorer(PipelineModel(stages=[*feats.stages, lr]))


def best_epoch(history: DataFrame, loss: str = "val_loss", epoch: str = "epoch") -> DataFrame:
    """L3: the first epoch with the strictly lowest validation loss."""
    cols = history.columns
    best = history.where(F.col(loss).isNotNull()).agg(
        F.min_by(F.struct(*cols), F.struct(F.col(loss), F.col(epoch))).alias("b"))
    return best.select("b.*")


def evaluate_scorer(model: PipelineModel, samples: DataFrame, pos_weight: float = 1.0) -> DataFrame:
    """M5: loss and accuracy of a scorer on held-out (prompt, response, label) rows."""
    s = score_column(model, samples, "pred")
    return binary_metrics(s, "pred", "label", pos_weight=pos_weight)


def fit_with_history(samples: DataFrame, key: str, rounds: int = 8, ratio: float = 0.9, seed: int = 42, pos_weight: float = 1.0,
                     num_features: int = 1024, step: float = 0.5, l2: float = 1e-3, batch_size: int = TRAIN_BATCH_SIZE):
    """M4: rounds of one fit over a fixed exact split (D2). In each round every task goes over its training rows in the round's own
    order (D3), batch by batch, from the state of the round before; the tasks' states are averaged by their rows. After each
    round loss and accuracy on both sides are recorded, and the state with the lowest validation loss is kept (L3).

    Returns (scorer, history with one row per round). Per round two passes over the rows; the driver holds one number per feature."""
    split = random_split_exact(samples, key, ratio, seed)
    feats = featurizer(num_features).transform(split.withColumn("label", F.col("label").cast("double")))
    rows = feats.select(F.col(key).alias("key"), "split", "label", "features").checkpoint()
    train = rows.where("split = 'train'")
    state, best, history = np.zeros(2 * num_features + len(NUMERIC) + 1), None, []
    for epoch in range(rounds):
        ordered = train.sortWithinPartitions(hash32(F.col("key"), seed * 1009 + epoch), "key")
        state = rounds_of.averaged(ordered, state, step / (1 + epoch), l2, pos_weight, batch_size)
        m = rounds_of.measured(rows, state, pos_weight)
        history.append((epoch, *map(float, (*m["train"], *m["val"]))))
        if best is None or m["val"][0] < best[0]:
            best = (m["val"][0], state)
    spark = samples.sparkSession
    hist = spark.createDataFrame(history, "epoch int, train_loss double, train_accuracy double, val_loss double, val_accuracy double")
    return rounds_of.LinearScorer(best[1], num_features), hist


def save_scorer(model: PipelineModel, path: str, metadata: dict) -> None:
    """Persist the model and one JSON metadata record (epoch, val_loss, val_accuracy, config)."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "metadata string") \
        .coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_scorer(spark, path: str) -> tuple[PipelineModel, dict]:
    """Reload a saved scorer and its metadata."""
    model = PipelineModel.load(f"{path}/model")
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    return model, meta


@dataclass
class DifficultyRouter:
    """A classifier of prompts (will the weak model's answer do?), calibrated. It reads nothing but the prompt, so it decides
    before anything is generated."""
    model: PipelineModel
    calibration: object  # IsotonicRegressionModel

    def raw(self, df: DataFrame, out: str = "_raw") -> DataFrame:
        x = df.select("*", F.lit("").alias("response")) if "response" not in df.columns else df.withColumnRenamed("response", "_own_response").withColumn("response", F.lit(""))
        t = score_column(self.model, x, out).drop("response")
        return t.withColumnRenamed("_own_response", "response") if "_own_response" in t.columns else t

    def win_rate(self, requests: DataFrame, out: str = "win_rate") -> DataFrame:
        """``requests`` with the calibrated probability that the strong model is needed."""
        return self.calibration.transform(self.raw(requests)).withColumnRenamed("prediction", out).drop("_raw")


def train_difficulty(samples: DataFrame, calibration: DataFrame, num_features: int = 1024, max_iter: int = 50,
                     reg_param: float = 0.01) -> DifficultyRouter:
    """Fit on (prompt, label) rows, label 1 if the weak answer was adequate; calibrate on others by isotonic regression, which keeps
    the order and makes the mean rate of every plateau the share of inadequate answers there."""
    prompts = samples.select("prompt", F.lit("").alias("response"), (F.lit(1.0) - F.col("label").cast("double")).alias("label"))
    router = DifficultyRouter(train_adequacy(prompts, num_features=num_features, max_iter=max_iter, reg_param=reg_param), None)
    raw = router.raw(calibration.select("prompt", (F.lit(1.0) - F.col("label").cast("double")).alias("label")))
    router.calibration = IsotonicRegression(featuresCol="_raw", labelCol="label").fit(raw)
    return router


def calibration_error(rows: DataFrame, rate: str = "win_rate", label: str = "label", bins: int = 10) -> DataFrame:
    """One row: the expected calibration error of ``rate`` against (1 - ``label``), by equal bins."""
    b = F.least(F.floor(F.col(rate) * bins), F.lit(bins - 1))
    g = rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg(rate) - F.avg(F.lit(1.0) - F.col(label))).alias("gap"))
    return g.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("calibration_error"))


def classifier_win_rate(requests: DataFrame, model: PipelineModel, response: str = "weak_response") -> DataFrame:
    """Difficulty from an adequacy classifier: strong win rate = 1 - P(weak response adequate)."""
    s = score_column(model, requests.withColumn("response", F.col(response)), "_p_adequate")
    return s.withColumn("win_rate", F.lit(1.0) - F.col("_p_adequate")).drop("_p_adequate", "response")

