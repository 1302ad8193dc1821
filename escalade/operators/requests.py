"""Chat requests as a table: validation with a quarantine split (P8), the evaluator predicate (P9), and the
completion envelope (F10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escalade.schemas import FORCE_VALUES, ROLES

# Fixed request defaults of the chat-completion schema.
DEFAULTS = {"model": "smart-router", "temperature": 1.0, "top_p": 1.0, "stream": False, "disable_evaluator": False}

# Checks in reporting order: (field, failing condition, message).
def _checks(n_messages: Column | None = None, bad_roles: Column | None = None) -> list[tuple[str, Column, str]]:
    if n_messages is None:
        msgs = F.col("messages")
        n_messages = F.coalesce(F.size(msgs), F.lit(0))
        bad_role = F.exists(F.coalesce(msgs, F.array().cast("array<struct<role:string,content:string>>")),
                            lambda m: ~F.coalesce(m["role"].isin(*ROLES), F.lit(False)))
    else:
        bad_role = F.coalesce(bad_roles, F.lit(0)) > 0
    return [
        ("messages", F.coalesce(n_messages, F.lit(0)) < 1, "List should have at least 1 item"),
        ("messages.role", bad_role, "Input should be 'system', 'user' or 'assistant'"),
        ("temperature", ~F.col("temperature").between(0.0, 2.0), "Input should be between 0 and 2"),
        ("top_p", ~F.col("top_p").between(0.0, 1.0), "Input should be between 0 and 1"),
        ("max_tokens", F.col("max_tokens") < 1, "Input should be greater than or equal to 1"),
        ("force_model", F.col("force_model").isNotNull() & ~F.col("force_model").isin(*FORCE_VALUES),
         "Input should be 'weak' or 'strong'"),
    ]


def with_defaults(requests: DataFrame) -> DataFrame:
    out = requests
    for c, v in DEFAULTS.items():
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
        else:
            out = out.withColumn(c, F.lit(v))
    for c, t in (("max_tokens", "int"), ("force_model", "string")):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(t))
    return out


def _with_errors(r: DataFrame, checks) -> DataFrame:
    # error detail shape of the chat API (message, type, code) plus the offending field
    errs = [F.when(F.coalesce(cond, F.lit(False)),
                   F.struct(F.lit(msg).alias("message"), F.lit("invalid_request_error").alias("type"),
                            F.lit(f"invalid_{field.replace('.', '_')}").alias("code"), F.lit(field).alias("field")))
            for field, cond, msg in checks]
    r = r.withColumn("errors", F.filter(F.array(*errs), lambda e: e.isNotNull()))
    return r.withColumn("is_valid", F.size("errors") == 0)


def validate_requests(requests: DataFrame) -> DataFrame:
    """Defaults filled, then ``errors ARRAY<STRUCT<message, type, code, field>>`` and ``is_valid``."""
    return _with_errors(with_defaults(requests), _checks())


def validate_requests_flat(requests: DataFrame, messages: DataFrame, key: str = "request_id",
                           msg_key: str = "conv_id", role: str = "role") -> DataFrame:
    """P8 for requests whose messages are stored one row per message: the message checks are a partial
    aggregation per request (message count, invalid roles), so no message list is ever assembled and a very long
    conversation is reduced on every partition before the shuffle."""
    stats = messages.groupBy(F.col(msg_key).alias(key)).agg(
        F.count(F.lit(1)).alias("_n_messages"),
        F.count_if(~F.coalesce(F.col(role).isin(*ROLES), F.lit(False))).alias("_bad_roles"))
    r = with_defaults(requests).join(stats, key, "left")
    out = _with_errors(r, _checks(F.col("_n_messages"), F.col("_bad_roles")))
    return out.drop("_n_messages", "_bad_roles")


def split_valid(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid requests, quarantine with their errors)."""
    v = validate_requests(requests)
    return v.where("is_valid").drop("errors", "is_valid"), v.where(~F.col("is_valid"))


def evaluable(evaluator_present: bool = True) -> Column:
    """The evaluator runs only when present, not disabled, and no model is forced."""
    return (F.lit(bool(evaluator_present)) & ~F.coalesce(F.col("disable_evaluator"), F.lit(False))
            & F.col("force_model").isNull())


def response_envelope(decisions: DataFrame, start_col: str | None = None, end_col: str | None = None) -> DataFrame:
    """the nested completion row built from a cascade decision table (R8 output).

    ``id`` is ``chatcmpl-<request_id>`` (deterministic); ``created`` is epoch seconds of the end time;
    ``latency_ms`` = (end - start) * 1000 when both timestamps are given, else NULL.
    """
    if start_col and end_col:
        latency = (F.unix_micros(F.col(end_col)) - F.unix_micros(F.col(start_col))) / F.lit(1000.0)
        created = F.unix_seconds(F.col(end_col))
    else:
        latency = F.lit(None).cast("double")
        created = F.lit(None).cast("bigint")
    return decisions.select(
        F.concat(F.lit("chatcmpl-"), F.col("request_id").cast("string")).alias("id"),
        F.lit("chat.completion").alias("object"),
        created.alias("created"),
        F.col("model_used").alias("model"),
        F.array(F.struct(F.lit(0).alias("index"),
                         F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content")).alias("message"),
                         F.lit("stop").alias("finish_reason"))).alias("choices"),
        F.struct(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("total_tokens")).alias("usage"),
        F.struct(F.col("model_used"), F.col("routing_score"), F.col("weak_quality_score"),
                 F.col("evaluator_triggered"), latency.alias("latency_ms"), F.col("cost_usd")).alias("routing_metadata"),
    )
