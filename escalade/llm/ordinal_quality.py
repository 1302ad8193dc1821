"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features.

One weight vector w is shared by all grades; ordered thresholds t_1 < ... < t_{G-1} cut the line:
P(grade < g | x) = sigmoid(t_g - w.x). Selection uses the tail P(grade >= keep_grade), and the expected grade
sum_g P(grade >= g) ranks documents.

Features of a text, all hashed and counted once however often they occur: its bare words (lower case, outer punctuation
off), their first four and five bytes (inflected forms share them), and the outer punctuation (junk is often marked by
it); beside them a few plain ratios (capitals, marks, digits, repeated words, word length, size). Texts are read whole.

The fit takes a bounded sample of the labelled rows: the ``fit_rows`` ones (default 12,000) that come first by a hash of
their id; their features meet in one task, and only the weights reach the driver. Thresholds and weights are found by full-batch L-BFGS on
the penalised likelihood. Scoring runs over all rows in Arrow batches with the broadcast weights (fixed size).

Defined cases: null and blank texts have no features but the intercepts and are scored like any other row; labelled ids
without a document and documents without a label only miss the fit; a null rating isn't used; if the sample holds a
single grade, or nothing, every row gets that grade (the highest if there is none) with certainty; repeated rows are
scored alike; repeated labels count each time; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from escalade.llm.common import bytes_words, ready, slices

BITS = 20
N_DENSE = 6
_PIECE = 1000
#: Fixed value: bytes that are not part of a bare word when they stand at its ends.
_OUTER = b"".join(bytes([b]) for b in range(33, 127) if not chr(b).isalnum())

_CAPITALS, _MARKS, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|!@~^=<>{}[]\\/_+", b"0123456789"


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct buckets, and the dense ratios."""
    words = bytes_words(text)
    distinct = set(words)
    bare, marks = set(), set()
    for word in distinct:
        inner = word.strip(_OUTER)
        bare.add(inner)
        if len(inner) != len(word):
            marks.add(word.replace(inner, b"\x00", 1) if inner else word[:8])
    crc = [crc32(x, 1) for x in bare]
    crc += [crc32(x, 2) for x in {x[:4] for x in bare}]
    crc += [crc32(x, 3) for x in {x[:5] for x in bare}]
    crc += [crc32(x, 4) for x in marks]
    found = np.unique(np.array(crc, dtype=np.int64) & ((1 << BITS) - 1)).astype(np.int32)
    n = max(1, len(words))
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    size = max(1, len(raw))
    shares = [(len(raw) - len(raw.translate(None, kind))) / size for kind in (_CAPITALS, _MARKS, _DIGITS)]
    dense = np.array([*shares, 1 - len(distinct) / n, len(raw) / n / 10 if words else 0.0, np.log1p(len(words)) / 10])
    return found, dense


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    """weights (hashed, then dense), thresholds, mean and scale of the dense features, number of grades."""

    weights: np.ndarray
    thresholds: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    grades: int
    constant: int | None = None

    def line(self, hashed: np.ndarray, dense: np.ndarray) -> float:
        size = 1 << BITS
        return float(self.weights[hashed].sum() + ((dense - self.mean) / self.scale) @ self.weights[size:])

    def tails(self, line: np.ndarray) -> np.ndarray:
        """P(grade >= g), one column for g = 1 .. grades - 1."""
        if self.constant is not None:
            return np.repeat((np.arange(1, self.grades) <= self.constant)[None, :], len(line), 0).astype(float)
        return 1 - _sigmoid(self.thresholds[None, :] - line[:, None])


def _lbfgs(fun, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with a halving line search."""
    value, grad = fun(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, alphas = -grad, []
        for s, y in reversed(steps):
            a = s @ d / (s @ y)
            alphas.append(a)
            d = d - a * y
        if steps:
            s, y = steps[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(alphas)):
            d = d + s * (a - y @ d / (s @ y))
        slope, step = grad @ d, 1.0 if steps else 1.0 / max(1.0, np.linalg.norm(grad))
        if slope >= 0:
            break
        for _ in range(25):
            new_value, new_grad = fun(x + step * d)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = step * d, new_grad - grad
        gain = value - new_value
        x, value, grad = x + s, new_value, new_grad
        if s @ y > 1e-12:
            steps = [*steps[-(memory - 1):], (s, y)]
        if gain < 1e-7 * max(1.0, abs(value)):
            break
    return x


def fit(hashed: list[np.ndarray], dense: np.ndarray, grade: np.ndarray, grades: int, l2: float = 0.3,
        rounds: int = 40, min_docs: int = 4) -> OrdinalModel:
    """Penalised maximum likelihood; ``l2`` is the weight of half the squared norm of w. Buckets that fewer than
    ``min_docs`` rated documents have get no weight: they would only learn those documents by heart."""
    size = 1 << BITS
    seen = np.unique(grade)
    if len(seen) < 2:
        only = int(seen[0]) if len(seen) else grades - 1
        return OrdinalModel(np.zeros(size + N_DENSE), np.zeros(grades - 1), np.zeros(N_DENSE), np.ones(N_DENSE), grades, only)
    mean, scale = dense.mean(0), np.maximum(dense.std(0), 1e-6)
    x = (dense - mean) / scale
    # buckets that are frequent enough get the numbers 0 .. m - 1
    held = np.zeros(size, dtype=np.int64)
    for h in hashed:
        held[h] += 1
    used = np.flatnonzero(held >= min_docs)
    number = np.full(size, -1, dtype=np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    n, m, pieces = len(grade), len(used), []
    for at in range(0, n, _PIECE):  # documents in pieces, so that sums need little memory
        cols = [c[c >= 0] for c in (number[h] for h in hashed[at:at + _PIECE])]
        pieces.append((slice(at, at + len(cols)), np.concatenate(cols), np.array([len(c) for c in cols])))
    low, high = np.where(grade > 0, grade - 1, 0), np.where(grade < grades - 1, grade, 0)

    def unpack(p):
        gaps = np.exp(np.clip(p[m + N_DENSE + 1:], -20, 20))
        return p[:m], p[m:m + N_DENSE], p[m + N_DENSE] + np.concatenate([[0.0], np.cumsum(gaps)]), gaps

    def loss(p):
        w, v, t, gaps = unpack(p)
        line = x @ v
        for part, cols, sizes in pieces:
            line[part] += np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=w[cols], minlength=len(sizes))
        up = np.where(grade < grades - 1, _sigmoid(t[high] - line), 1.0)
        down = np.where(grade > 0, _sigmoid(t[low] - line), 0.0)
        prob = np.maximum(up - down, 1e-12)
        du, dd = up * (1 - up) / prob, down * (1 - down) / prob
        dline = du - dd  # derivative of -log prob by the line
        dt = np.bincount(high, weights=np.where(grade < grades - 1, -du, 0.0), minlength=grades - 1)
        dt += np.bincount(low, weights=np.where(grade > 0, dd, 0.0), minlength=grades - 1)
        gw = l2 * w
        for part, cols, sizes in pieces:
            gw += np.bincount(cols, weights=np.repeat(dline[part], sizes), minlength=m)
        gv = x.T @ dline + l2 * v
        gt = np.concatenate([[dt.sum()], np.cumsum(dt[::-1])[::-1][1:] * gaps])
        return -np.log(prob).sum() + l2 / 2 * (w @ w + v @ v), np.concatenate([gw, gv, gt])

    start = np.zeros(m + N_DENSE + grades - 1)
    share = np.array([(grade < g).mean() for g in range(1, grades)]).clip(1e-3, 1 - 1e-3)
    t0 = np.log(share / (1 - share))
    start[m + N_DENSE] = t0[0]
    start[m + N_DENSE + 1:] = np.log(np.maximum(np.diff(t0), 1e-2))
    w, v, t, _ = unpack(_lbfgs(loss, start, rounds))
    weights = np.zeros(size + N_DENSE, dtype=np.float32)
    weights[used], weights[size:] = w, v
    return OrdinalModel(weights, t, mean, scale, grades)


def train(docs: DataFrame, ratings: DataFrame, grades: int, fit_rows: int = 12_000, l2: float = 0.3,
          id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on at most ``fit_rows`` rated documents; ``ratings`` has (id, grade) with grades 0 .. grades - 1."""
    ready(docs.sparkSession)
    rated = (ratings.select(F.col(id_col).alias("id"), F.col("grade").cast("int").alias("grade"))
             .filter(F.col("id").isNotNull() & F.col("grade").between(0, grades - 1)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    have = texts.select("id").join(rated, "id")
    sample = have.orderBy(F.xxhash64("id"), "id", "grade").limit(fit_rows)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [features(t) for t in pdf["text"]]
            yield pd.DataFrame({"grade": pdf["grade"], "hashed": [h for h, _ in both],
                                "dense": [d for _, d in both]})

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(g, h, d) for pdf in batches for g, h, d in zip(pdf["grade"], pdf["hashed"], pdf["dense"])]
        # a fixed order, so that the sums of the fit don't depend on how tasks finish
        parts.sort(key=lambda p: (p[0], len(p[1]), tuple(p[2]), tuple(p[1][:16])))
        model = fit([np.asarray(h, np.int32) for _, h, _ in parts], np.array([d for _, _, d in parts]).reshape(-1, N_DENSE),
                    np.array([g for g, _, _ in parts], dtype=int), grades, l2)
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    picked = F.broadcast(sample.groupBy("id", "grade").agg(F.count(F.lit(1)).alias("times")))  # at most fit_rows small rows
    # a label that is there several times counts each time
    rows = texts.join(picked, "id").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).mapInPandas(hashed, "grade int, hashed array<int>, dense array<double>")
    # the sample's features meet in one task, bounded by fit_rows; only the weights come to the driver
    return pickle.loads(rows.repartition(1).mapInPandas(fitted, "model binary").first()[0])


def score(docs: DataFrame, model: OrdinalModel, keep_grade: int, min_tail: float = 0.7, id_col: str = "doc_id",
          text_col: str = "text", carry: bool = False, names: tuple[str, str, str] = ("expected_grade", "tail", "keep")) -> DataFrame:
    """id, expected_grade, tail = P(grade >= keep_grade), keep; with ``carry`` beside all columns of ``docs``.

    ``names`` are those of the added columns; columns of ``docs`` with these names are replaced."""
    spark = ready(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)

    rows = docs.drop(*names) if carry else docs.select(id_col, text_col)
    at = rows.columns.index(text_col)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in slices(batches):  # the other columns go through untouched
            tails = m.tails(np.array([m.line(*features(t)) for t in batch.column(at).to_pylist()]))
            tail = tails[:, keep_grade - 1]
            more = [pa.array(tails.sum(1), pa.float64()), pa.array(tail, pa.float64()), pa.array(tail >= min_tail, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    schema = T.StructType([*rows.schema.fields, T.StructField(names[0], T.DoubleType()),
                           T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])
    out = rows.mapInArrow(judged, schema)
    return out if carry else out.drop(text_col)
