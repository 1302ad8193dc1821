"""Declared schemas, routing configuration and prices."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import types as T

# Fixed values that must equal the reference's defaults (USD per 1M tokens, thresholds, batch sizes).
WEAK_INPUT_PER_M = 0.5
WEAK_OUTPUT_PER_M = 1.5
STRONG_INPUT_PER_M = 10.0
STRONG_OUTPUT_PER_M = 30.0
BLENDED_STRONG_PER_M = 10.0
ROUTER_THRESHOLD = 0.5
CASCADE_THRESHOLD = 0.6
CONFIG_EVALUATOR_THRESHOLD = 0.7
TRAIN_BATCH_SIZE = 16
SCORE_BATCH_SIZE = 32
MAX_SEQ_LENGTH = 512
COLLECT_CONCURRENCY = 5

MODEL_USED_VALUES = ("weak", "strong", "weak_then_strong")
ROLES = ("system", "user", "assistant")
FORCE_VALUES = ("weak", "strong")


@dataclass(frozen=True)
class Prices:
    weak_input: float = WEAK_INPUT_PER_M
    weak_output: float = WEAK_OUTPUT_PER_M
    strong_input: float = STRONG_INPUT_PER_M
    strong_output: float = STRONG_OUTPUT_PER_M

    def rows(self) -> list[tuple[str, float, float]]:
        return [("weak", self.weak_input, self.weak_output), ("strong", self.strong_input, self.strong_output)]


@dataclass(frozen=True)
class RoutingConfig:
    router_threshold: float = ROUTER_THRESHOLD
    evaluator_threshold: float = CONFIG_EVALUATOR_THRESHOLD
    prices: Prices = field(default_factory=Prices)

    def __post_init__(self):
        for name in ("router_threshold", "evaluator_threshold"):
            v = getattr(self, name)
            if not 0.0 <= v <= 1.0:
                raise ValueError(f"{name} must be within [0, 1], got {v}")


def routing_config(settings) -> RoutingConfig:
    """The configuration from named settings, a mapping or a session's ``conf`` (keys ``escalade.<name>``): router_threshold,
    evaluator_threshold and the four prices (weak_input, ..); what isn't set keeps its default, what isn't a number raises."""
    def get(name: str, default: float) -> float:
        value = settings.get(f"escalade.{name}", None)
        value = settings.get(name, None) if value is None and hasattr(settings, "keys") else value
        return default if value is None else float(value)

    base = RoutingConfig()
    prices = Prices(**{f.name: get(f.name, f.default) for f in fields(Prices)})
    return RoutingConfig(get("router_threshold", base.router_threshold), get("evaluator_threshold", base.evaluator_threshold), prices)


PRICES_SCHEMA = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("input_per_m", T.DoubleType(), False),
    T.StructField("output_per_m", T.DoubleType(), False),
])

PROMPTS_SCHEMA = T.StructType([
    T.StructField("ord", T.LongType(), False),
    T.StructField("prompt", T.StringType(), True),
])

RESPONSE_PAIRS_SCHEMA = T.StructType([
    T.StructField("pair_id", T.LongType(), False),
    T.StructField("prompt", T.StringType(), True),
    T.StructField("weak_response", T.StringType(), True),
    T.StructField("strong_response", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
])

ADEQUACY_SCHEMA = T.StructType([
    T.StructField("prompt", T.StringType(), True),
    T.StructField("weak_response", T.StringType(), True),
    T.StructField("label", T.IntegerType(), True),
])

PAIRWISE_SCHEMA = T.StructType([
    T.StructField("prompt", T.StringType(), True),
    T.StructField("response_a", T.StringType(), True),
    T.StructField("response_b", T.StringType(), True),
    T.StructField("preference", T.StringType(), True),
])

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])

CHAT_REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("model", T.StringType(), True),
    T.StructField("messages", T.ArrayType(MESSAGE), True),
    T.StructField("temperature", T.DoubleType(), True),
    T.StructField("top_p", T.DoubleType(), True),
    T.StructField("max_tokens", T.IntegerType(), True),
    T.StructField("stream", T.BooleanType(), True),
    T.StructField("force_model", T.StringType(), True),
    T.StructField("disable_evaluator", T.BooleanType(), True),
])

TOKENS_USED = T.StructType([
    T.StructField("weak_input", T.LongType()),
    T.StructField("weak_output", T.LongType()),
    T.StructField("strong_input", T.LongType()),
    T.StructField("strong_output", T.LongType()),
])

ROUTING_RESULTS_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType(), True),
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("model_used", T.StringType(), True),
    T.StructField("routing_score", T.DoubleType(), True),
    T.StructField("weak_quality_score", T.DoubleType(), True),
    T.StructField("cost_usd", T.DoubleType(), True),
    T.StructField("latency_ms", T.DoubleType(), True),
    T.StructField("response", T.StringType(), True),
    T.StructField("tokens_used", TOKENS_USED, True),
])

TRAIN_HISTORY_SCHEMA = T.StructType([
    T.StructField("epoch", T.IntegerType(), False),
    T.StructField("train_loss", T.DoubleType(), True),
    T.StructField("train_accuracy", T.DoubleType(), True),
    T.StructField("val_loss", T.DoubleType(), True),
    T.StructField("val_accuracy", T.DoubleType(), True),
])

CHUNK_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("index", T.IntegerType(), True),
    T.StructField("seq", T.LongType(), False),
    T.StructField("created", T.TimestampType(), True),
    T.StructField("role", T.StringType(), True),
    T.StructField("content", T.StringType(), True),
    T.StructField("finish_reason", T.StringType(), True),
])
