"""Routing decisions over whole tables of requests.

Routers produce a strong-win-rate column; ``route`` turns it into a decision. The cascade (R8) is one projection
chain: router -> evaluator score -> escalation -> chosen text, tokens, cost; no per-row Python.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from escalade.functions.arrow import append_columns
from escalade.functions.hashing import unit_uniform
from escalade.functions.joins import attach_row
from escalade.functions.quantiles import valid
from escalade.functions.text import token_count, word_containment
from escalade.operators.requests import evaluable
from escalade.operators.rounds import Bilinear
from escalade.operators.scoring import _call
from escalade.schemas import CASCADE_THRESHOLD, ROUTER_THRESHOLD, Prices

Scorer = Callable[[Column, Column], Column]  # (prompt, response) -> quality score column


def route(win_rate: Column | str, threshold: float = ROUTER_THRESHOLD) -> Column:
    """R1: 'strong' when the strong win rate is >= threshold (inclusive), else 'weak' (also when unknown or NaN, which
    Spark would order above every number)."""
    w = F.col(win_rate) if isinstance(win_rate, str) else win_rate
    return F.when(valid(w) & (w >= F.lit(threshold)), F.lit("strong")).otherwise(F.lit("weak"))


def random_win_rate(key: Column | str, seed: int = 0) -> Column:
    """R2: reproducible uniform [0, 1) per key (portable hash, independent of partitioning)."""
    return unit_uniform(F.col(key) if isinstance(key, str) else key, seed)


def route_only(requests: DataFrame, win_rate: str | None = "win_rate", threshold: float = ROUTER_THRESHOLD) -> DataFrame:
    """Decision without generating text; no router (or no score) falls back to weak."""
    if win_rate is None or win_rate not in requests.columns:
        return requests.withColumn("decision", F.lit("weak"))
    return requests.withColumn("decision", route(win_rate, threshold))


# ---------------------------------------------------------------- matrix factorisation router

def mf_params(W: np.ndarray, b: np.ndarray, w: np.ndarray, v_strong: np.ndarray, v_weak: np.ndarray) -> dict:
    """Fold delta(m, q) = w . (v_m * (W q + b)) for the two models into one linear score:
    delta_s - delta_w = a . q + c with u = w * (v_s - v_w), a = W^T u, c = u . b."""
    u = np.asarray(w, float) * (np.asarray(v_strong, float) - np.asarray(v_weak, float))
    return {"a": (np.asarray(W, float).T @ u).tolist(), "c": float(u @ np.asarray(b, float))}


def mf_win_rate_from_params(queries: DataFrame, params: DataFrame, emb: str = "embedding") -> DataFrame:
    """sigmoid(a . q + c) with the folded parameters in a one-row DataFrame (columns ``a`` array, ``c``)."""
    j = attach_row(queries, params.select("a", "c"))
    dot = F.aggregate(F.zip_with(F.col(emb), F.col("a"), lambda x, y: x.cast("double") * y), F.lit(0.0),
                      lambda acc, v: acc + v)
    return j.withColumn("win_rate", F.lit(1.0) / (F.lit(1.0) + F.exp(-(dot + F.col("c"))))).drop("a", "c")


def mf_win_rate(queries: DataFrame, model: Bilinear, emb: str = "embedding") -> DataFrame:
    """R3 with a learned model (general W, b, w and model vectors): folded into one linear score, which is exact."""
    folded = mf_params(model.W, model.b, model.w, model.v_strong, model.v_weak)
    params = queries.sparkSession.createDataFrame([(folded["a"], folded["c"])], "a array<double>, c double")
    return mf_win_rate_from_params(queries, params, emb)


def mf_params_from_battles(battles: DataFrame, emb: str = "embedding", label: str = "strong_wins") -> DataFrame:
    """Model vectors learnt from past battles with identity projection (W = I, b = 0, w = 1): v_strong / v_weak
    are the mean embeddings of the battles each model won. Returns the folded one-row (a, c).

    Aggregated per (outcome, dimension) with partial aggregation; the model is one row of d values.
    """
    e = battles.select(F.col(label).alias("y"), F.posexplode(emb).alias("dim", "v"))
    m = e.groupBy("dim").agg(F.avg(F.when(F.col("y") == 1, F.col("v").cast("double"))).alias("vs"),
                             F.avg(F.when(F.col("y") == 0, F.col("v").cast("double"))).alias("vw"))
    a = m.agg(F.sort_array(F.collect_list(F.struct("dim", (F.col("vs") - F.col("vw")).alias("d")))).alias("s"))
    return a.select(F.transform("s", lambda x: x["d"]).alias("a"), F.lit(0.0).alias("c"))


def model_vectors_from_battles(battles: DataFrame, emb: str = "embedding", label: str = "strong_wins") -> DataFrame:
    """One row with the two model vectors (mean embedding of the battles each model won): ``v_strong``, ``v_weak``."""
    e = battles.select(F.col(label).alias("y"), F.posexplode(emb).alias("dim", "v"))
    m = e.groupBy("dim").agg(F.avg(F.when(F.col("y") == 1, F.col("v").cast("double"))).alias("vs"),
                             F.avg(F.when(F.col("y") == 0, F.col("v").cast("double"))).alias("vw"))
    a = m.agg(F.sort_array(F.collect_list(F.struct("dim", "vs", "vw"))).alias("s"))
    return a.select(F.transform("s", lambda x: x["vs"]).alias("v_strong"),
                    F.transform("s", lambda x: x["vw"]).alias("v_weak"))


def _cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    return F.try_divide(dot, na * nb)


def query_model_similarity(queries: DataFrame, models: DataFrame, emb: str = "embedding") -> DataFrame:
    """J4 with the tiny side: cosine of every query to each model vector (the one-row model table is broadcast)."""
    j = attach_row(queries, models.select("v_strong", "v_weak"))
    return (j.withColumn("cos_strong", _cosine(F.col(emb), F.col("v_strong")))
            .withColumn("cos_weak", _cosine(F.col(emb), F.col("v_weak"))).drop("v_strong", "v_weak"))


# ---------------------------------------------------------------- similarity-weighted router

#: Queries and battles that one task multiplies at most, about.
GROUP_ROWS = (8192, 16_384)


def _unit_rows(vectors) -> np.ndarray:
    m = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return m / n


def _grid(n_q: int, n_b: int, query_rows: int, battle_rows: int, cores: int) -> tuple[int, int]:
    """Groups of queries and of battles: as few as their size allows, since each row is copied once per group of the other side, but
    of battles enough for some tasks on every core, where there are that many."""
    grid_q = max(1, -(-n_q // max(query_rows, GROUP_ROWS[0])))
    spread = min(-(-4 * cores // grid_q), n_b // max(battle_rows, 512))
    return grid_q, max(1, -(-n_b // max(battle_rows, GROUP_ROWS[1])), spread)


def sw_win_rate(queries: DataFrame, battles: DataFrame, gamma: float = 10.0, q_id: str = "query_id",
                emb: str = "embedding", win: str = "strong_wins", battle_id: str = "battle_id",
                query_rows: int = 2048, battle_rows: int = 8192) -> DataFrame:
    """Per query, weight every past battle by gamma^(1 + cos / max cos) and take the weighted strong win rate.

    Every (query, battle) cosine is needed, so the work is a dense product; it is never materialised as pair rows. Queries
    and battles are dealt by a hash of their ids into groups of bounded size, and each pair of groups is multiplied in one task,
    in cells of ``query_rows`` by ``battle_rows``: the cells bound what a task holds of the product, while rows are copied once per
    group (``GROUP_ROWS``), not once per cell. Two passes (the maximum cosine, then the weighted sums with it) are reduced per query
    by partial aggregation. Equal embeddings have different ids, so they don't meet in one group.

    Without battles the rate and the maximum are NULL. If no battle has a positive cosine, dividing by the maximum would turn
    the order round (or be undefined): then all battles weigh the same. Rows without an embedding get NULL.
    """
    q = queries.select(F.col(q_id).alias("q"), F.col(emb).alias("e")).where("e is not null")
    b = battles.select(F.col(battle_id).alias("b"), F.col(emb).alias("e"), F.col(win).cast("double").alias("w")).where(
        "e is not null and w is not null")
    grid_q, grid_b = _grid(q.count(), b.count(), query_rows, battle_rows, queries.sparkSession.sparkContext.defaultParallelism)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = b.select("e", "w", deal("b", grid_b).alias("cb"), every(grid_q).alias("cq"))
    lg, qt = float(np.log(gamma)), queries.schema[q_id].dataType

    def meet(rows: DataFrame, fn, *out: str) -> DataFrame:
        left = rows.withColumns({"cq": deal("q", grid_q), "cb": every(grid_b)})
        schema = T.StructType([T.StructField("q", qt), *[T.StructField(o, T.DoubleType()) for o in out]])
        return left.groupBy("cq", "cb").cogroup(cells.groupBy("cq", "cb")).applyInPandas(fn, schema)

    def most(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"q": x["q"][:0], "m": np.empty(0)})
        us, vs, m = _unit_rows(x["e"]), _unit_rows(y["e"]), np.full(len(x), -np.inf)
        for i in range(0, len(us), query_rows):
            u, own = us[i:i + query_rows], m[i:i + query_rows]
            for j in range(0, len(vs), battle_rows):
                np.maximum(own, (u @ vs[j:j + battle_rows].T).max(axis=1), out=own)
        return pd.DataFrame({"q": x["q"], "m": m})

    def weigh(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"q": x["q"][:0], "sw": np.empty(0), "s": np.empty(0)})
        top = x["m"].to_numpy(dtype=np.float64)
        alike = ~(top > 0)
        # gamma^(1 + cos / max) without its factor gamma, which leaves the rate as it is
        us = _unit_rows(x["e"]) * (lg / np.where(alike, 1.0, top))[:, None]
        vs, won = _unit_rows(y["e"]), np.column_stack([y["w"].to_numpy(dtype=np.float64), np.ones(len(y))])
        sums = np.zeros((len(us), 2))
        for i in range(0, len(us), query_rows):
            u, flat, own = us[i:i + query_rows], alike[i:i + query_rows], sums[i:i + query_rows]
            for j in range(0, len(vs), battle_rows):
                w = u @ vs[j:j + battle_rows].T
                np.exp(w, out=w)
                w[flat] = 1.0
                own += w @ won[j:j + battle_rows]
        return pd.DataFrame({"q": x["q"], "sw": sums[:, 0], "s": sums[:, 1]})

    top = meet(q, most, "m").groupBy("q").agg(F.max("m").alias("m"))
    sums = meet(q.join(top, "q"), weigh, "sw", "s").groupBy("q").agg(F.sum("sw").alias("sw"), F.sum("s").alias("s"))
    rates = sums.join(top, "q").select(F.col("q").alias(q_id), F.try_divide(F.col("sw"), F.col("s")).alias("win_rate"),
                                       F.col("m").alias("max_cos"))
    return queries.select(q_id).join(rates, q_id, "left")


# ---------------------------------------------------------------- causal-LM score router

def score_parse(text: Column | str) -> Column:
    """the first digit 1-5 in a model's text as INT (NULL when there is none)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract(t, "([1-5])", 1).try_cast("int")


def win_prob_from_scores(logits: Column | str, score_threshold: int = 4) -> Column:
    """softmax over the logits of scores 1..n; strong win rate = 1 - P(score >= threshold)."""
    lg = F.col(logits) if isinstance(logits, str) else logits
    lg = F.transform(lg, lambda x: x.cast("double"))
    mx = F.array_max(lg)
    ex = F.transform(lg, lambda x: F.exp(x - mx))
    tot = F.aggregate(ex, F.lit(0.0), lambda a, x: a + x)
    hi = F.aggregate(F.filter(ex, lambda x, i: i >= F.lit(score_threshold - 1)), F.lit(0.0), lambda a, x: a + x)
    return F.lit(1.0) - hi / tot


def causal_win_rate(df: DataFrame, logits: str = "score_logits", score_threshold: int = 4,
                    threshold: float = ROUTER_THRESHOLD) -> DataFrame:
    """F15 on a score-logits column, then R1."""
    return (df.withColumn("win_rate", win_prob_from_scores(logits, score_threshold))
            .withColumn("decision", route("win_rate", threshold)))


# ---------------------------------------------------------------- joins

def pair_responses(weak: DataFrame, strong: DataFrame, key: str = "pair_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Equi-join weak and strong responses by id; also the ids missing either side (left anti joins)."""
    pairs = weak.join(strong, key, "inner")
    return pairs, weak.join(strong, key, "left_anti"), strong.join(weak, key, "left_anti")


# ---------------------------------------------------------------- cascade

def containment_scorer(prompt: Column, response: Column, reference: Column | None = None) -> Column:
    """Deterministic stand-in scorer: word containment of the weak response in the reference response."""
    return word_containment(response, reference if reference is not None else prompt)


def _decide(requests: DataFrame, scorer: Scorer | None, win_rate: str | None, threshold: float,
            router_threshold: float) -> DataFrame:
    """Adds ``weak_quality_score``, ``model_used`` and ``evaluator_triggered`` (needs ``weak_response``)."""
    fm = F.col("force_model")
    forced = F.coalesce(fm.isin("weak", "strong"), F.lit(False))
    routed_strong = (route(win_rate, router_threshold) == "strong") if win_rate else F.lit(False)
    ev = evaluable(scorer is not None) & ~forced & ~routed_strong
    raw = scorer(F.col("prompt"), F.col("weak_response")) if scorer is not None else F.lit(None).cast("double")
    score = F.when(ev, F.when(valid(raw), raw))
    escalate = F.coalesce(score < F.lit(threshold), F.lit(False))
    model_used = (F.when(forced, fm).when(routed_strong, F.lit("strong"))
                  .when(escalate, F.lit("weak_then_strong")).otherwise(F.lit("weak")))
    d = requests.select("*", score.alias("weak_quality_score")).withColumn("model_used", model_used)
    return d.withColumn("evaluator_triggered", F.col("model_used") == "weak_then_strong")


def _finish(d: DataFrame, win_rate: str | None, prices: Prices, keep: tuple[str, ...]) -> DataFrame:
    """Chosen text, per-model token usage and cost of a decided table."""
    mu = F.col("model_used")
    chosen = F.when(mu.isin("strong", "weak_then_strong"), F.col("strong_response")).otherwise(F.col("weak_response"))
    pt, wt, st = token_count("prompt"), token_count("weak_response"), token_count("strong_response")
    weak_called = mu.isin("weak", "weak_then_strong")
    strong_called = mu.isin("strong", "weak_then_strong")
    d = d.select(
        "*", chosen.alias("response"),
        F.when(weak_called, pt).otherwise(0).alias("weak_input"),
        F.when(weak_called, wt).otherwise(0).alias("weak_output"),
        F.when(strong_called, pt).otherwise(0).alias("strong_input"),
        F.when(strong_called, st).otherwise(0).alias("strong_output"),
        (F.col(win_rate) if win_rate else F.lit(0.0)).cast("double").alias("routing_score"),
    )
    cost = (F.col("weak_input") * prices.weak_input + F.col("weak_output") * prices.weak_output
            + F.col("strong_input") * prices.strong_input + F.col("strong_output") * prices.strong_output) / F.lit(1e6)
    ct = token_count("response")
    return d.select(
        "request_id", "model_used", "routing_score", "weak_quality_score", "evaluator_triggered", "response",
        pt.alias("prompt_tokens"), ct.alias("completion_tokens"), (pt + ct).alias("total_tokens"),
        "weak_input", "weak_output", "strong_input", "strong_output", cost.alias("cost_usd"), *keep)


def cascade(requests: DataFrame, scorer: Scorer | None = None, win_rate: str | None = None,
            threshold: float = CASCADE_THRESHOLD, router_threshold: float = ROUTER_THRESHOLD,
            prices: Prices = Prices(), keep: tuple[str, ...] = ()) -> DataFrame:
    """The weak-then-strong quality cascade on a table of requests whose responses are already known.

    Input columns: request_id, prompt, weak_response, strong_response, force_model, disable_evaluator, and the
    optional router column ``win_rate``. ``scorer(prompt, weak_response)`` returns the quality column.

    Order of decisions (per row): forced model -> router says strong -> evaluator score < threshold (strict)
    escalates -> otherwise weak. A NULL/NaN score never escalates. Forcing bills only the forced model.
    """
    return _finish(_decide(requests, scorer, win_rate, threshold, router_threshold), win_rate, prices, keep)


def _call_where(df: DataFrame, fn, flag: str, out: str) -> DataFrame:
    """Call an injected text model on the rows whose ``flag`` is true, inside each partition (Arrow batches):
    no filter/join round trip, and untaken rows cost nothing. Failures go to ``<out>_error``."""
    def run(needed: list, prompts: list) -> tuple[list, list]:
        done = [_call(fn, p if p is not None else "") if need else (None, None, 0) for need, p in zip(needed, prompts)]
        return [x for x, _, _ in done], [e for _, e, _ in done]

    return append_columns(df, [flag, "prompt"], run, [T.StructField(out, T.StringType()), T.StructField(f"{out}_error", T.StringType())])


def cascade_with_models(requests: DataFrame, weak_fn, strong_fn, scorer: Scorer | None = None,
                        win_rate: str | None = None, threshold: float = CASCADE_THRESHOLD,
                        router_threshold: float = ROUTER_THRESHOLD, prices: Prices = Prices()) -> DataFrame:
    """R8 with injected model functions: the weak model is called only where the weak path is taken, the scorer
    decides, and the strong model is called only for rows routed or forced strong or escalated.

    Input: request_id, prompt, force_model, disable_evaluator [, win_rate]. A failed weak call leaves the score
    NULL (the weak answer is kept, empty); a failed strong call leaves an empty strong answer. Both errors are
    returned, with ``strong_called`` showing which rows paid for the strong model.
    """
    fm = F.col("force_model")
    routed = (route(win_rate, router_threshold) == "strong") if win_rate else F.lit(False)
    need_weak = ~(F.coalesce(fm == "strong", F.lit(False)) | (~F.coalesce(fm.isin("weak", "strong"), F.lit(False))
                                                              & routed))
    step = _call_where(requests.withColumn("_need_weak", need_weak), weak_fn, "_need_weak", "weak_response")
    step = step.withColumn("weak_response", F.coalesce(F.col("weak_response"), F.lit("")))
    # a failed weak call has no answer to evaluate: its score is NULL, so it is never escalated (kept weak)
    guarded = (lambda p, r: F.when(F.col("weak_response_error").isNull(), scorer(p, r))) if scorer else None
    decided = _decide(step, guarded, win_rate, threshold, router_threshold)
    decided = decided.withColumn("strong_called", F.col("model_used").isin("strong", "weak_then_strong"))
    step2 = _call_where(decided, strong_fn, "strong_called", "strong_response")
    step2 = step2.withColumn("strong_response", F.when(F.col("strong_called"),
                                                       F.coalesce(F.col("strong_response"), F.lit(""))))
    return _finish(step2, win_rate, prices, ("strong_called", "weak_response_error", "strong_response_error"))


def preroute_vs_evaluator(decisions: DataFrame, win_rate: str = "win_rate",
                          router_threshold: float = ROUTER_THRESHOLD, prices: Prices = Prices()) -> DataFrame:
    """Pre-routing by score versus the evaluator cascade on the same requests.

    ``decisions`` is a cascade output (no router) that still carries ``win_rate``, ``weak_response`` and
    ``strong_response``. Per strategy: requests, strong %, total cost, mean evaluator score of the rows it serves
    weak, and agreement with the other strategy (% of rows with the same weak/strong outcome).
    """
    pre_strong = valid(win_rate) & (F.col(win_rate) >= F.lit(router_threshold))
    casc_strong = F.col("model_used").isin("strong", "weak_then_strong")
    pt = F.col("prompt_tokens")
    wc = (pt * prices.weak_input + token_count("weak_response") * prices.weak_output) / F.lit(1e6)
    sc = (pt * prices.strong_input + token_count("strong_response") * prices.strong_output) / F.lit(1e6)
    q, n, pct = F.col("weak_quality_score"), F.count(F.lit(1)), lambda c, of: F.try_divide(c * F.lit(100.0), of.cast("double"))
    # both strategies in one aggregate: each row's tokens are counted once
    sides = {"preroute": (pre_strong, F.when(pre_strong, sc).otherwise(wc)), "evaluator": (casc_strong, F.col("cost_usd"))}
    aggs = [n.alias("n"), F.count_if(pre_strong == casc_strong).alias("agree")]
    for name, (strong, cost) in sides.items():
        aggs += [F.count_if(strong).alias(f"{name}_strong"), F.sum(cost).alias(f"{name}_cost"), F.avg(F.when(~strong, q)).alias(f"{name}_q")]
    one = decisions.agg(*aggs).where("n > 0")
    rows = F.explode(F.array(*[F.struct(
        F.lit(name).alias("strategy"), F.col("n").alias("requests"), pct(F.col(f"{name}_strong"), F.col("n")).alias("strong_pct"),
        F.col(f"{name}_cost").alias("total_cost"), F.col(f"{name}_q").alias("avg_quality_weak_served"),
        pct(F.col("agree"), F.col("n")).alias("agreement_pct")) for name in sides]))
    return one.select(rows.alias("s")).select("s.*")
