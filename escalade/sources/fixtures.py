"""Views with the reference's table shapes, derived from the driver tables with the DataFrame API.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame; nothing is materialised. The same views are
defined for DuckDB in :mod:`escalade.plans.oracle_views`; FIXTURES.md is the contract for both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from escalade.functions.hashing import unit_uniform
from escalade.schemas import Prices
from escalade.sources.tables import load

WS = r"\s+"


def _tokens(c):
    return F.filter(F.split(c, WS), lambda t: t != F.lit(""))


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn joined to the assistant turn right after it.

    Turns are dense per conversation (0..n-1: a message's position in its request), so "next turn" is the
    equi-join on ``turn + 1`` instead of ``lead`` over a per-conversation window: the join hashes on
    (conv_id, turn), so one very long conversation never lands in a single task.
    """
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    user = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    nxt = (conv.where(F.col("role") == "assistant")
           .select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ntext")))
    return user.join(nxt, ["conv_id", "turn"])


def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _turn_pairs(spark, sf_dir)
    cut = F.floor(F.length("ntext") * F.lit(0.8)).cast("int")
    sel = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3))
    weak = (F.when(sel == 0, F.col("ntext").substr(F.lit(1), cut))
            .when(sel == 1, F.col("ntext").substr(F.lit(1), F.lit(40)))
            .otherwise(F.col("prompt")))
    failed = F.pmod(F.col("conv_id") * 4294967296 + F.col("turn"), F.lit(17)) == 0  # simulated call failures
    return p.select(
        (F.col("conv_id") * 4294967296 + F.col("turn")).alias("pair_id"),
        "prompt",
        F.when(failed, F.lit("")).otherwise(weak).alias("weak_response"),
        F.when(failed, F.lit("")).otherwise(F.col("ntext")).alias("strong_response"),
        F.when(failed, F.lit("timeout")).alias("error"),
    )


def response_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (collected(spark, sf_dir).where(F.col("error").isNull())
            .select("pair_id", "prompt", "weak_response", "strong_response"))


def chat_requests(spark: SparkSession, sf_dir: str, with_messages: bool = False) -> DataFrame:
    conv = load(spark, sf_dir, "conversations")
    ids = conv.select("conv_id").distinct()
    req = ids.select(
        F.col("conv_id").alias("request_id"),
        F.lit("smart-router").alias("model"),
        (F.pmod(F.col("conv_id"), F.lit(25)) / F.lit(10.0)).alias("temperature"),
        F.lit(1.0).alias("top_p"),
        F.when(F.pmod(F.col("conv_id"), F.lit(9)) == 0, F.lit(0)).otherwise(F.lit(256)).cast("int").alias("max_tokens"),
        F.lit(False).alias("stream"),
        F.when(F.pmod(F.col("conv_id"), F.lit(10)) == 0, F.lit("weak"))
         .when(F.pmod(F.col("conv_id"), F.lit(10)) == 1, F.lit("strong"))
         .when(F.pmod(F.col("conv_id"), F.lit(10)) == 2, F.lit("medium")).alias("force_model"),
        (F.pmod(F.col("conv_id"), F.lit(7)) == 0).alias("disable_evaluator"),
    )
    if with_messages:
        from escalade.functions.text import assemble_messages
        msgs = assemble_messages(conv, "conv_id", "turn").withColumnRenamed("conv_id", "request_id")
        req = req.join(msgs, "request_id", "left")
    return req


def routing_results(spark: SparkSession, sf_dir: str, prices: Prices = Prices()) -> DataFrame:
    return routing_results_from(load(spark, sf_dir, "events"), prices)


def routing_results_from(ev: DataFrame, prices: Prices = Prices()) -> DataFrame:
    """The routing-results view over an events DataFrame (a table or a stream)."""
    k = F.get_json_object("props", "$.k").cast("int")
    model_used = (F.when(F.col("event_type") == "purchase", "strong")
                  .when(F.col("event_type") == "error", "weak_then_strong").otherwise("weak"))
    a = ev.select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), "value",
                  "event_type", model_used.alias("model_used"), k.alias("k"))
    mu, kc = F.col("model_used"), F.col("k")
    b = a.select(
        "*",
        F.when(mu == "strong", F.lit(0)).otherwise(100 + kc).alias("weak_input"),
        F.when(mu == "strong", F.lit(0)).otherwise(200 + 2 * kc).alias("weak_output"),
        F.when(mu == "weak", F.lit(0)).otherwise(100 + kc).alias("strong_input"),
        F.when(mu == "weak", F.lit(0)).otherwise(300 + 3 * kc).alias("strong_output"),
    )
    cost = (F.col("weak_input") * prices.weak_input + F.col("weak_output") * prices.weak_output
            + F.col("strong_input") * prices.strong_input + F.col("strong_output") * prices.strong_output) / 1e6
    return b.select(
        "request_id", "ts", "model_used", "k", "weak_input", "weak_output", "strong_input", "strong_output",
        cost.alias("cost_usd"),
        (F.col("value") * 20.0).alias("latency_ms"),
        F.when(mu == "weak", (60 + 0.4 * kc) / 100.0)
         .when(mu == "weak_then_strong", 0.6 * kc / 100.0).alias("weak_quality_score"),
        F.when(mu == "strong", (100 + kc) / 200.0).otherwise(kc / 200.0).alias("routing_score"),
        F.concat(F.col("event_type"), F.repeat(F.lit(" w"), kc)).alias("response"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = load(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(lab, "doc_id").select(
        "doc_id", (F.pmod(F.col("n_chars"), F.lit(100)) / 99.0).alias("pred"), F.col("quality").alias("label"))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return response_pairs(spark, sf_dir).select(
        "pair_id",
        (F.pmod(F.length("strong_response"), F.lit(100)) / 99.0).alias("score_preferred"),
        (F.pmod(F.length("weak_response"), F.lit(100)) / 99.0).alias("score_non_preferred"),
    )


def train_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (routing_results(spark, sf_dir).groupBy("k")
            .agg(F.round(F.avg("latency_ms"), 6).alias("val_loss"))
            .select(F.col("k").alias("epoch"), "val_loss"))


def prices_df(spark: SparkSession, prices: Prices = Prices()) -> DataFrame:
    from escalade.schemas import PRICES_SCHEMA
    return spark.createDataFrame(prices.rows(), PRICES_SCHEMA)


def hidden_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = load(spark, sf_dir, "embeddings")
    e = emb.select(F.col("label").alias("id"), F.col("vec_id").alias("pos"),
                   F.when(F.pmod(F.col("vec_id"), F.lit(5)) == 0, F.lit(0)).otherwise(F.lit(1)).alias("mask"),
                   F.posexplode("embedding").alias("dim", "v"))
    return e.select("id", "pos", F.col("dim").cast("bigint").alias("dim"), F.col("v").cast("double").alias("v"),
                    "mask")


def battles(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = load(spark, sf_dir, "embeddings")
    return emb.where(F.pmod(F.col("vec_id"), F.lit(10)) != 0).select(
        F.col("vec_id").alias("battle_id"), "embedding",
        F.when(F.col("label") < 5, F.lit(1)).otherwise(F.lit(0)).alias("strong_wins"))


def directed_battles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Battles whose outcome depends on the query, with some noise (the labels of ``embeddings`` don't depend on the vectors)."""
    emb = load(spark, sf_dir, "embeddings")
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    lean = e(0) + 0.7 * e(1) - 0.4 * e(2) + 0.1 * (unit_uniform("vec_id", 5) - 0.5)
    return emb.select(F.col("vec_id").alias("battle_id"), "embedding", F.when(lean > 0, 1).otherwise(0).alias("strong_wins"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = load(spark, sf_dir, "embeddings")
    return emb.where(F.pmod(F.col("vec_id"), F.lit(10)) == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = load(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    a = conv.select((F.col("conv_id") * 4294967296 + F.col("turn")).alias("id"), _tokens(F.col("text")).alias("tokens"))
    b = a.select("id", F.posexplode("tokens").alias("seq", "word"))
    return b.select("id", F.col("seq").cast("bigint").alias("seq"), F.concat(F.col("word"), F.lit(" ")).alias("content"),
                    F.when(F.col("seq") == 0, F.lit("assistant")).alias("role"))
