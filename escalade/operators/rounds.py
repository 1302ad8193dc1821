"""Fits that go in rounds: tasks work on their rows from one shared state, and their sums meet by number.

A state is one array of doubles, as long as the model has parameters (that bounds what reaches the driver). Rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from escalade.functions.arrow import append_columns


def summed(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """The sum over all tasks of the arrays (of ``size``) that ``part`` makes of each task's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([part(batches)], pa.list_(pa.float64()))], names=["part"])

    parts = rows.mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("at", "x"))
    total = np.zeros(size)
    for r in parts.groupBy("at").agg(F.sum("x").alias("x")).collect():  # one row per number of the state
        total[r["at"]] = r["x"]
    return total


def _sparse(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of each row's feature vector, dense or sparse."""
    out = []
    for v in batch.column(batch.schema.get_field_index("features")).to_pylist():
        values = np.asarray(v["values"], dtype=np.float64)
        out.append((np.asarray(v["indices"], dtype=np.int64) if v["type"] == 0 else np.arange(len(values)), values))
    return out


def _lines(rows, state: np.ndarray) -> np.ndarray:
    return np.array([state[i] @ x for i, x in rows]) + state[-1] if rows else np.empty(0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def averaged(train: DataFrame, state: np.ndarray, step: float, l2: float, pos_weight: float, batch_size: int) -> np.ndarray:
    """One round of logistic regression over (label, features): every task takes steps over its rows in their order, in batches; the
    mean of the tasks' states, weighted by rows. The last number of the state is the intercept. A step has the length of the mean
    squared features, so that long texts don't overshoot."""
    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        own, n, held = state.copy(), 0, []

        def go(rows: list) -> None:
            line = _lines([x for x, _ in rows], own)
            y = np.array([label for _, label in rows])
            pull = (_sigmoid(line) - y) * np.where(y == 1.0, pos_weight, 1.0)
            own[:-1] *= 1.0 - step * l2
            scale = step / (len(rows) * max(1.0, float(np.mean([x @ x for (_, x), _ in rows]))))
            for ((i, x), _), g in zip(rows, pull):
                own[i] -= scale * g * x
                own[-1] -= scale * g

        for batch in batches:
            held += list(zip(_sparse(batch), batch.column(batch.schema.get_field_index("label")).to_pylist()))
            n += batch.num_rows
            while len(held) >= batch_size:
                go(held[:batch_size])
                del held[:batch_size]
        if held:
            go(held)
        return np.append(own * n, n)

    total = summed(train, part, len(state) + 1)
    return total[:-1] / total[-1] if total[-1] else state


def measured(rows: DataFrame, state: np.ndarray, pos_weight: float) -> dict[str, tuple[float, float]]:
    """split -> (weighted log loss, accuracy at 0.5) of (split, label, features)."""
    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums = np.zeros(6)
        for batch in batches:
            line = _lines(_sparse(batch), state)
            y = np.array(batch.column(batch.schema.get_field_index("label")).to_pylist())
            loss = np.where(y == 1.0, pos_weight, 1.0) * (np.logaddexp(0.0, line) - y * line)
            right = (line > 0) == (y == 1.0)
            for at, name in ((0, "train"), (3, "val")):
                own = np.array([s == name for s in batch.column(batch.schema.get_field_index("split")).to_pylist()], dtype=bool)
                sums[at:at + 3] += (own.sum(), loss[own].sum(), right[own].sum())
        return sums

    s = summed(rows, part, 6)
    share = lambda at: (s[at + 1] / s[at], s[at + 2] / s[at]) if s[at] else (float("nan"), float("nan"))
    return {"train": share(0), "val": share(3)}


@dataclass
class LinearScorer:
    """What the rounds learned: scores (prompt, response) rows with the probability of an adequate response."""
    state: np.ndarray
    num_features: int

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        from escalade.operators.training import NUMERIC, featurizer
        state = self.state
        rows = featurizer(self.num_features).transform(df).withColumn("_i", F.col("features"))

        def run(vectors: list) -> tuple[list]:
            batch = [(np.asarray(v["indices"], np.int64) if v["type"] == 0 else np.arange(len(v["values"])), np.asarray(v["values"])) for v in vectors]
            return (_sigmoid(_lines(batch, state)).tolist(),)

        scored = append_columns(rows.drop("_i"), ["features"], run, [T.StructField(out, T.DoubleType())])
        return scored.drop("features", *NUMERIC)


# ---------------------------------------------------------------- R3: a bilinear fit over battles

@dataclass
class Bilinear:
    """delta(m, q) = w . (v_m * (W q + b)) with W (k x d), b, w and the two model vectors learned."""
    W: np.ndarray
    b: np.ndarray
    w: np.ndarray
    v_strong: np.ndarray
    v_weak: np.ndarray


def fit_bilinear(battles: DataFrame, emb: str = "embedding", label: str = "strong_wins", rank: int = 16, rounds: int = 40, step: float = 0.1,
                 l2: float = 1e-3, seed: int = 42) -> Bilinear:
    """Logistic fit of P(strong wins | q) = sigmoid(delta(strong, q) - delta(weak, q)) over past battles.

    A round is one pass: tasks sum (p - y) q and (p - y), d + 1 numbers, from which the gradients of W, b, w and both model vectors follow
    on the driver; Adam takes the step. Battles without an embedding or a label, or of another length than the first, are left out."""
    known = battles.select(F.col(emb).alias("e"), F.col(label).cast("double").alias("y")).where("e is not null and y is not null")
    first = known.select(F.size("e").alias("d")).first()
    if first is None:
        raise ValueError("no battles to learn from")
    d = first["d"]
    rows = known.where(F.size("e") == d).select(F.transform("e", lambda x: x.cast("double")).alias("e"), "y").checkpoint()
    rng = np.random.default_rng(seed)
    theta = {"W": rng.normal(size=(rank, d)) / np.sqrt(d), "b": np.zeros(rank), "w": np.ones(rank), "v_strong": rng.normal(size=rank) * 0.1,
             "v_weak": rng.normal(size=rank) * 0.1}
    m, v = ({k: np.zeros_like(x) for k, x in theta.items()} for _ in range(2))
    for t in range(1, rounds + 1):
        u = theta["w"] * (theta["v_strong"] - theta["v_weak"])
        a, c = theta["W"].T @ u, float(u @ theta["b"])

        def part(batches: Iterator[pa.RecordBatch], a=a, c=c) -> np.ndarray:
            sums = np.zeros(d + 2)
            for batch in batches:
                q = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                pull = _sigmoid(q @ a + c) - batch.column(1).to_numpy(zero_copy_only=False)
                sums += np.concatenate([pull @ q, [pull.sum(), len(pull)]])
            return sums

        s = summed(rows, part, d + 2)
        gq, g = s[:d] / s[-1], s[d] / s[-1]
        seen = theta["W"] @ gq + theta["b"] * g  # the mean pull on W q + b
        apart = theta["v_strong"] - theta["v_weak"]
        grad = {"W": np.outer(u, gq), "b": u * g, "w": apart * seen, "v_strong": theta["w"] * seen, "v_weak": -theta["w"] * seen}
        for k in theta:
            grad[k] = grad[k] + l2 * theta[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad[k], 0.999 * v[k] + 0.001 * grad[k] ** 2
            theta[k] = theta[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Bilinear(**theta)
