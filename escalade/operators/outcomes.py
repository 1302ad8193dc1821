"""An outcome for every request: validation, responses, the trained evaluator and timing in one table (R8, U1, ST3).

``settle`` keeps every request. Its result has the columns of routing results (so A1-A16 run on it) and a ``status``:

* ``invalid``: validation (P8) failed; ``error`` names the first failed field;
* ``no_user_message``: the last user message is missing or empty;
* ``no_response``: no responses arrived for it (in time, on a stream);
* ``failed``: a model whose answer the decision needs returned an error;
* ``served``: answered by the cascade.

Only served requests have a decision, a response, tokens and a cost; failed ones keep the decision and the time spent.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escalade.operators.routing import Scorer, _decide, _finish, route
from escalade.operators.training import score_column
from escalade.schemas import CASCADE_THRESHOLD, ROUTER_THRESHOLD, Prices, RoutingConfig

STATUSES = ("served", "failed", "no_response", "no_user_message", "invalid")
RESULT = ("request_id", "ts", "status", "error", "model_used", "routing_score", "weak_quality_score", "evaluator_triggered", "cost_usd",
          "latency_ms", "response", "tokens_used")


class ModelScorer:
    """A fitted adequacy pipeline (M1, or one loaded by S9) as the cascade's evaluator: P(adequate | prompt, response).

    The pipeline's stages run in the JVM on sparse vectors. Rows that aren't to be evaluated get an empty response, so they
    cost no features, and no score."""

    def __init__(self, model: PipelineModel):
        self.model = model

    def add(self, df: DataFrame, wanted: Column, out: str, prompt: str = "prompt", response: str = "weak_response") -> DataFrame:
        """``df`` with the score of (prompt, response) as column ``out``, null where ``wanted`` is not true."""
        own = {c: f"_own_{c}" for c in ("prompt", "response", "features", "rawPrediction", "probability", "prediction") if c in df.columns}
        x = df.withColumn("_wanted", F.coalesce(wanted, F.lit(False)))
        p, r = F.col(prompt), F.when(F.col("_wanted"), F.col(response)).otherwise("")
        x = x.withColumns({"_p": F.when(F.col("_wanted"), p).otherwise(""), "_r": r}).withColumnsRenamed(own)
        x = x.withColumnsRenamed({"_p": "prompt", "_r": "response"})
        scored = score_column(self.model, x, "_score")
        return (scored.drop("prompt", "response").withColumnsRenamed({v: k for k, v in own.items()})
                .withColumn(out, F.when(F.col("_wanted"), F.col("_score"))).drop("_wanted", "_score"))


def with_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Every request with its responses, if there are any: ``answered`` tells."""
    return requests.join(responses.withColumn("answered", F.lit(True)), "request_id", "left")


def settle(answered: DataFrame, scorer: Scorer | ModelScorer | None = None, win_rate: str | None = None,
           threshold: float = CASCADE_THRESHOLD, router_threshold: float = ROUTER_THRESHOLD, prices: Prices = Prices(),
           keep: tuple[str, ...] = ()) -> DataFrame:
    """The outcome of each row of ``with_responses`` (a table, or a stream: nothing here keeps state).

    Needed: request_id, prompt, force_model, disable_evaluator, answered, weak_response, strong_response. Used if present: ts,
    is_valid and errors (P8), weak_error, strong_error, weak_latency_ms, strong_latency_ms."""
    read = ("request_id", "prompt", "force_model", "disable_evaluator", "answered", "weak_response", "strong_response", "ts", "is_valid",
            "errors", "weak_error", "strong_error", "weak_latency_ms", "strong_latency_ms", win_rate, *keep)
    answered = answered.select(*[c for c in answered.columns if c in read])  # others could clash with what is added
    have = lambda c, kind: F.col(c) if c in answered.columns else F.lit(None).cast(kind)
    valid = F.coalesce(have("is_valid", "boolean"), F.lit(True))
    asked = F.coalesce(F.length("prompt"), F.lit(0)) > 0
    got = F.coalesce("answered", F.lit(False))
    weak_error, strong_error = have("weak_error", "string"), have("strong_error", "string")
    usable = valid & asked & got & weak_error.isNull()
    rows = answered
    if isinstance(scorer, ModelScorer):
        # whom the evaluator judges is known before its score: neither forced, nor switched off, nor routed to the strong model
        free = F.col("force_model").isNull() & ~F.coalesce("disable_evaluator", F.lit(False))
        if win_rate:
            free &= route(win_rate, router_threshold) != "strong"
        rows = scorer.add(rows, usable & free, "_quality")
        judge = lambda p, r: F.col("_quality")
    else:
        judge = None if scorer is None else lambda p, r: F.when(usable, scorer(p, r))
    decided = _decide(rows, judge, win_rate, threshold, router_threshold)
    used = F.col("model_used")
    weak_called, strong_called = used.isin("weak", "weak_then_strong"), used.isin("strong", "weak_then_strong")
    failed = F.coalesce(F.when(weak_called, weak_error), F.when(strong_called, strong_error))
    if "errors" in answered.columns:
        invalid = F.get("errors", F.lit(0))["field"]
    else:
        invalid = F.lit("request")
    status = (F.when(~valid, "invalid").when(~asked, "no_user_message").when(~got, "no_response").when(failed.isNotNull(), "failed")
              .otherwise("served"))
    error = F.when(~valid, invalid).when(~asked, F.lit("no_user_message")).when(~got, F.lit("no_response")).otherwise(failed)
    spent = (F.when(weak_called, F.coalesce(have("weak_latency_ms", "double"), F.lit(0.0))).otherwise(0.0)
             + F.when(strong_called, F.coalesce(have("strong_latency_ms", "double"), F.lit(0.0))).otherwise(0.0))
    decided = decided.withColumns({"_status": status, "_error": error, "_spent": spent, "_ts": have("ts", "timestamp")})
    done = _finish(decided, win_rate, prices, ("_status", "_error", "_spent", "_ts", *keep))
    served, called = F.col("_status") == "served", F.col("_status").isin("served", "failed")
    tokens = F.struct(*[F.col(c).cast("bigint").alias(c) for c in ("weak_input", "weak_output", "strong_input", "strong_output")])
    return done.select(
        "request_id", F.col("_ts").alias("ts"), F.col("_status").alias("status"), F.col("_error").alias("error"),
        F.when(called, F.col("model_used")).alias("model_used"), F.when(called, F.col("routing_score")).alias("routing_score"),
        F.when(called, F.col("weak_quality_score")).alias("weak_quality_score"),
        (served & F.col("evaluator_triggered")).alias("evaluator_triggered"),
        F.when(served, F.col("cost_usd")).otherwise(0.0).alias("cost_usd"), F.when(called, F.col("_spent")).alias("latency_ms"),
        F.when(served, F.col("response")).alias("response"), F.when(served, tokens).alias("tokens_used"), *keep)


def settle_by(config: RoutingConfig, answered: DataFrame, scorer: Scorer | ModelScorer | None = None, win_rate: str | None = None,
              keep: tuple[str, ...] = ()) -> DataFrame:
    """``settle`` with the thresholds and prices of a configuration."""
    return settle(answered, scorer, win_rate, config.evaluator_threshold, config.router_threshold, config.prices, keep)


def served_results(outcomes: DataFrame) -> DataFrame:
    """The routing results of the served requests: the input of the cost, quality and latency reports."""
    return outcomes.filter(F.col("status") == "served")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Requests by status and error, with their share."""
    n = outcomes.groupBy("status", "error").agg(F.count(F.lit(1)).alias("requests"))
    total = n.agg(F.sum("requests").alias("_all"))
    return n.join(F.broadcast(total)).select("status", "error", "requests", (F.col("requests") * 100.0 / F.col("_all")).alias("pct"))
