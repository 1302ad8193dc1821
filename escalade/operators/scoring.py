"""Model application surface (U1-U4): injected model / scorer / judge functions applied to whole tables.

Models are plain Python functions supplied by the user (network clients in production, deterministic stand-ins in
tests). They run on Arrow batches, beside the other columns, which pass untouched; failures are captured per row
in an ``error`` column instead of failing the task. Rows that do not need a model (e.g. strong calls for requests
that were not escalated) are filtered out *before* the call.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from typing import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from escalade.functions.arrow import append_columns
from escalade.functions.ordinals import global_ordinals_with_count
from escalade.schemas import COLLECT_CONCURRENCY, SCORE_BATCH_SIZE

TextModel = Callable[[str], str]                      # prompt -> response
BatchScorer = Callable[[pd.Series, pd.Series], pd.Series]   # (prompts, responses) -> scores
Judge = Callable[[str, str], float]                   # (prompt, response) -> score


def pandas_scorer(fn: BatchScorer) -> Callable[[Column, Column], Column]:
    """Wrap a vectorised (prompts, responses) -> scores function as a Column scorer (Arrow pandas UDF)."""
    @F.pandas_udf(T.DoubleType())
    def _score(p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(fn(p, r), dtype="float64").reset_index(drop=True)

    return lambda prompt, response: _score(prompt, response)


def _call(fn: Callable, *args, retries: int = 0, backoff_s: float = 0.0) -> tuple[object, str | None, int]:
    """(result, error, attempts) of one call; a failed one is tried again after a pause that doubles."""
    for attempt in range(retries + 1):
        try:
            return fn(*args), None, attempt + 1
        except Exception as e:  # a failed call becomes a row-level error
            error = f"{type(e).__name__}: {e}"
        if attempt < retries:
            time.sleep(backoff_s * 2**attempt)
    return None, error, retries + 1


def _call_rows(fn: TextModel, prompts: Iterable[str], concurrency: int | None) -> tuple[list, list]:
    if concurrency and concurrency > 1:
        with ThreadPoolExecutor(concurrency) as pool:
            done = list(pool.map(lambda p: _call(fn, p), prompts))
    else:
        done = [_call(fn, p) for p in prompts]
    return ["" if e is not None else x for x, e, _ in done], [e for _, e, _ in done]


def collect_responses(prompts: DataFrame, weak_fn: TextModel, strong_fn: TextModel, key: str = "pair_id",
                      concurrency: int | None = COLLECT_CONCURRENCY) -> DataFrame:
    """Call both models for every prompt; failures of either call go to ``error`` (first one wins).

    ``concurrency`` bounds the simultaneous calls inside each task (threads that wait for the models); the input keeps its
    partitioning, so the calls of the whole job are bounded by that times the running tasks. ``None`` calls one by one.
    :func:`collect_with_ledger` bounds the whole job and resumes.
    """
    def run(asked: list) -> tuple[list, list, list]:
        asked = [p if p is not None else "" for p in asked]
        w, we = _call_rows(weak_fn, asked, concurrency)
        s, se = _call_rows(strong_fn, asked, concurrency)
        return w, s, [a if a is not None else b for a, b in zip(we, se)]

    return append_columns(prompts.select(key, "prompt"), ["prompt"], run, [
        T.StructField(c, T.StringType()) for c in ("weak_response", "strong_response", "error")])


def collect_with_ledger(prompts: DataFrame, weak_fn: TextModel, strong_fn: TextModel, ledger: str, key: str = "pair_id",
                        max_concurrent: int = COLLECT_CONCURRENCY, wave_rows: int = 10_000, retries: int = 2, backoff_s: float = 0.5,
                        retry_interrupted: bool = False) -> DataFrame:
    """U2 for calls that cost money: at most ``max_concurrent`` calls at once in the whole job, and none twice over restarts.

    ``ledger`` is a folder that outlives the run (shared by driver and executors). Prompts are handled in waves of at most
    ``wave_rows``: a wave's keys are appended to ``ledger/claims``, then ``max_concurrent`` tasks call one prompt after the other and
    append what came back to ``ledger/results`` (a finished task's rows stay even if its wave doesn't end). A restart skips every key
    with a claim. Keys that were claimed but have no result were cut off in mid-call: they are returned with the error
    ``interrupted`` and called again only with ``retry_interrupted``. A failed call is tried ``retries`` more times, with a pause that
    starts at ``backoff_s`` and doubles; then its error is the result. Within a run, a task that Spark has to repeat
    (a lost executor) calls the prompts of its wave again.

    Every prompt gives a row: key, prompt, weak_response, strong_response, error, attempts. Keys are unique; rows with a null key are
    left out, as nothing tells whether they were called."""
    if max_concurrent < 1 or wave_rows < 1:
        raise ValueError("max_concurrent and wave_rows must be at least 1")
    spark, kind = prompts.sparkSession, prompts.schema[key].dataType
    asked = prompts.select(key, "prompt").where(F.col(key).isNotNull())
    told = T.StructType([T.StructField(key, kind), *[T.StructField(c, T.StringType()) for c in ("weak_response", "strong_response", "error")],
                         T.StructField("attempts", T.IntegerType())])
    claims, results = f"{ledger}/claims", f"{ledger}/results"
    spark.createDataFrame([], T.StructType([told[key]])).write.mode("append").parquet(claims)
    spark.createDataFrame([], told).write.mode("append").parquet(results)
    read = lambda path, schema: spark.read.schema(schema).parquet(path)
    skip = read(results, told) if retry_interrupted else read(claims, T.StructType([told[key]]))
    # checkpointed there, as it is now: the ledger grows below
    todo, n = global_ordinals_with_count(asked.join(skip.select(key).distinct(), key, "left_anti"), [key], "_row")

    def run(texts: list) -> tuple[list, list, list, list]:
        out = []
        for p in texts:
            w, we, wn = _call(weak_fn, p if p is not None else "", retries=retries, backoff_s=backoff_s)
            s, se, sn = _call(strong_fn, p if p is not None else "", retries=retries, backoff_s=backoff_s)
            out.append((w or "", s or "", we if we is not None else se, wn + sn))
        return tuple(list(c) for c in zip(*out)) if out else ([], [], [], [])

    for start in range(0, n, wave_rows):
        wave = todo.where(F.col("_row").between(start, start + wave_rows - 1)).drop("_row")
        wave.select(key).write.mode("append").parquet(claims)
        # as many tasks as permits, each calling one by one: no more run at once, however large the cluster is
        called = append_columns(wave.repartition(max_concurrent), ["prompt"], run, list(told.fields[1:]))
        (called.drop("prompt").write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(results))
    done = read(results, told).withColumn("_done", F.lit(True)).dropDuplicates([key])
    return (asked.join(done, key, "left").withColumn("error", F.when(F.col("_done"), F.col("error")).otherwise("interrupted"))
            .select(key, "prompt", "weak_response", "strong_response", "error", "attempts"))


def score_batch(df: DataFrame, scorer: BatchScorer, prompt: str = "prompt", response: str = "response",
                batch_size: int = SCORE_BATCH_SIZE, out: str = "score") -> DataFrame:
    """Scores for (prompt, response) rows, calling the scorer on chunks of ``batch_size`` rows."""
    def run(asked: list, answered: list) -> tuple[list]:
        scores: list = []
        for i in range(0, len(asked), batch_size):
            got = scorer(pd.Series(asked[i:i + batch_size], dtype=object), pd.Series(answered[i:i + batch_size], dtype=object))
            scores.extend(None if x is None else float(x) for x in got)
        return (scores,)

    return append_columns(df, [prompt, response], run, [T.StructField(out, T.DoubleType())])


def judge_labels(pairs: DataFrame, judge_fn: Judge, cutoff: float, prompt: str = "prompt",
                 response: str = "weak_response") -> DataFrame:
    """U4: a judge scores each response; label = 1 when score >= cutoff. Judge failures leave score NULL."""
    def run(asked: list, answered: list) -> tuple[list, list]:
        done = [_call(lambda p, r: float(judge_fn(p, r)), p, r) for p, r in zip(asked, answered)]
        return [x for x, _, _ in done], [e for _, e, _ in done]

    out = append_columns(pairs, [prompt, response], run, [T.StructField("judge_score", T.DoubleType()), T.StructField("judge_error", T.StringType())])
    return out.withColumn("label", F.when(F.col("judge_score").isNull(), F.lit(None))
                          .otherwise((F.col("judge_score") >= F.lit(float(cutoff))).cast("int")))


def containment_batch(prompts: pd.Series, responses: pd.Series) -> pd.Series:
    """Deterministic stand-in scorer for U3: word containment of the response in the prompt (plain Python)."""
    out = []
    for p, r in zip(prompts, responses):
        w = set((r or "").lower().split())
        s = set((p or "").lower().split())
        out.append(len(w & s) / len(w) if w else float("nan"))
    return pd.Series(out, dtype="float64")
