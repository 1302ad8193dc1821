"""Periodic runs of words, found by the branching-tandem test on an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q and at least ``max(min_length, min_repeats * q)`` words that no
neighbouring word extends keeping the period. Texts are independent, so tasks work on pieces of about ``_PIECE`` words
from whole texts; a piece is one number sequence with a separator of its own behind each text, handled in whole arrays:

1. Suffix array by prefix doubling, refining only groups of suffixes that aren't told apart yet. The ranks by the first 1, 2,
   4, .. words are kept: equal ranks mean equal blocks, which gives any longest common extension in a few steps.
2. LCP array from these ranks (only pairs that share a block are followed).
3. LCP intervals as index ranges (no tree): for each boundary k with lcp[k] = depth, the nearest smaller values on both
   sides. Intervals with fewer than ``min_repeats`` suffixes can't hold a run: its last ``min_repeats`` periods
   begin with the same q words.
4. Branching-tandem test: each suffix i of the smaller side of a boundary is a square of root length ``depth`` that the next word
   breaks, at i or i - depth, if ISA[i + depth] or ISA[i - depth] lies on the other side. Listing smaller sides only costs
   n log n in all.
5. A square is rotated left to its run's start, by blocks of equal rank. Squares of one stretch are the run and multiples of
   its period: the smallest root stays.

The collapsed text drops the words that a run holds after its first period, and joins the rest by one space.

Defined cases: null and blank texts have no words, no runs and an empty collapsed text; words are maximal sequences of other characters
than space and \\t .. \\r, compared to the byte; overlapping runs each count; repeated rows each give a row; an empty table
gives no rows. Other columns of the input are kept, but for those of the result's names. A row's work and memory grow with its text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escalade.llm.common import ready

_PIECE = 1 << 15  # words handled at once, unless one text has more: arrays that stay small are also faster
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


class _Numbers(dict):
    """word -> number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def suffix_ranks(key: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``key`` (whose last element occurs once) and the ranks by the first 1, 2, 4, .. elements; the last are final."""
    n = len(key)
    order = np.argsort(key, kind="stable")
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = key[order[1:]] != key[order[:-1]]
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = slots[new][np.cumsum(new) - 1]
    levels, width = [rank], 1
    alone = new & np.append(new[1:], True)
    open_ = np.flatnonzero(~alone)  # slots of suffixes in groups of several
    while len(open_):
        suffix = order[open_]
        # a suffix in a group of several has no separator in its first words, so the place behind them exists
        pair = rank[suffix] * n + rank[suffix + width]
        by = np.argsort(pair, kind="stable")
        suffix, pair = suffix[by], pair[by]
        order[open_] = suffix
        new = np.empty(len(open_), bool)
        new[0] = True
        new[1:] = pair[1:] != pair[:-1]
        rank = rank.copy()
        rank[suffix] = open_[new][np.cumsum(new) - 1]
        levels.append(rank)
        width *= 2
        open_ = open_[~(new & np.append(new[1:], True))]
    return order, levels


def _lcp(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix of the suffixes in slots k - 1 and k."""
    n = len(order)
    lcp, at = np.zeros(n, np.int64), np.arange(1, n)
    reached = []  # by level: slots whose pair agrees on 2**level elements
    for rank in levels:
        at = at[rank[order[at - 1]] == rank[order[at]]]
        if not len(at):
            break
        reached.append(at)
    for level in range(len(reached) - 1, -1, -1):
        at, rank = reached[level], levels[level]
        a, b = order[at - 1] + lcp[at], order[at] + lcp[at]
        lcp[at[rank[a] == rank[b]]] += 1 << level
    return lcp


def _nearest_smaller(v: np.ndarray, at: np.ndarray, equal_too: bool = False) -> np.ndarray:
    """For each index in ``at`` the nearest one before it whose value is smaller (or equal). v[0] must be the least. Blocks of
    1, 2, 4, .. elements are skipped by their minima while all of them are larger, then smaller blocks again."""
    value, pos, top = v[at] + int(equal_too), at - 1, np.zeros(len(at), np.int64)
    minima, todo, level = [v], np.arange(len(at)), 0  # minima[j][x]: of the 2**j elements up to x
    while True:
        todo = todo[minima[level][pos[todo]] >= value[todo]]
        if not len(todo):
            break
        pos[todo] -= 1 << level
        last, step = minima[level], 1 << level
        level += 1
        top[todo] = level
        wider = np.full(len(v), -2, v.dtype)  # not enough elements: no such block
        np.minimum(last[step:], last[:-step], out=wider[step:])
        wider[:2 * step - 1] = -2
        minima.append(wider)
    for level in range(level - 1, -1, -1):
        some = np.flatnonzero(top > level)
        some = some[minima[level][pos[some]] >= value[some]]
        pos[some] -= 1 << level
    return pos


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + size[i] - 1, one range behind the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def find_runs(key: np.ndarray, min_length: int, min_repeats: int) -> np.ndarray:
    """Rows (start, end, period) of the runs in ``key``, by start, then period. Its last element has to be one of its kind; so
    has every separator in it."""
    none = np.empty((0, 3), np.int64)
    if len(key) < 3:
        return none
    n = len(key)
    order, levels = suffix_ranks(key)
    lcp, isa = _lcp(order, levels), levels[-1]
    lcp[0] = -1
    at = np.flatnonzero(lcp > 0)
    left = _nearest_smaller(lcp, at)
    back = np.append(-1, lcp[:0:-1])  # the slots from the last one on, behind a barrier
    right = n - _nearest_smaller(back, n - at)
    large = right - left >= min_repeats
    at, right = at[large], right[large]
    left, depth = _nearest_smaller(lcp, at, True), lcp[at]  # sides: left .. at - 1 and at .. right - 1
    small_left = at - left <= right - at
    size = np.where(small_left, at - left, right - at)
    i = order[_ranges(np.where(small_left, left, at), size)]
    lo, hi = (np.repeat(x, size) for x in (np.where(small_left, at, left), np.where(small_left, right, at)))
    d = np.repeat(depth, size)
    found = []
    for start, other in ((i, i + d), (i - d, i - d)):
        ok = (other >= 0) & (other < n)
        place = isa[np.where(ok, other, 0)]
        ok &= (place >= lo) & (place < hi)
        found.append(np.stack([start[ok], d[ok]]))
    start, period = np.concatenate(found, axis=1)
    end = start + 2 * period
    for level in range(len(levels) - 1, -1, -1):  # rotate left by blocks; no block of the last level occurs twice
        s, rank = start - (1 << level), levels[level]
        same = rank[np.maximum(s, 0)] == rank[np.maximum(s, 0) + period]
        start = np.where((s >= 0) & same, s, start)
    long = end - start >= np.maximum(min_length, min_repeats * period)
    runs = np.stack([start[long], end[long], period[long]], axis=1)
    if not len(runs):
        return none
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of_texts(texts: list[list[bytes]], min_length: int, min_repeats: int, keep_periods: int):
    """For each word list (runs as dicts, collapsed text)."""
    numbers = _Numbers()
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(sizes + 1) - (sizes + 1)  # where each text begins, with a separator behind each
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    key = owner * (len(numbers) + 1) + len(numbers)
    word = np.ones(len(key), bool)
    word[base + sizes] = False
    key[word] += ids - len(numbers)
    runs = find_runs(key, min_length, min_repeats)
    cover = np.zeros(len(key) + 1, np.int64)
    np.add.at(cover, np.minimum(runs[:, 0] + keep_periods * runs[:, 2], runs[:, 1]), 1)
    np.add.at(cover, runs[:, 1], -1)
    kept = np.cumsum(cover[:-1]) == 0
    of = owner[runs[:, 0]]
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    for t, words in enumerate(texts):
        own = runs[cuts[t]:cuts[t + 1]]
        if len(own):
            words = compress(words, kept[base[t]:base[t] + sizes[t]].tolist())
        found = [{"start": s, "length": e - s, "period": q} for s, e, q in (own - [base[t], base[t], 0]).tolist()]
        yield found, b" ".join(words).decode("utf-8", "replace")


def _collapse(min_length: int, min_repeats: int, keep_periods: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, first = batch.column(batch.num_columns - 1), 0
            while first < batch.num_rows:  # pieces of whole texts
                pieces, words = [], 0
                while first + len(pieces) < batch.num_rows and (not pieces or words < _PIECE):
                    t = text[first + len(pieces)].as_buffer()
                    pieces.append(t.to_pybytes().split() if t is not None else [])
                    words += len(pieces[-1])
                both = list(runs_of_texts(pieces, min_length, min_repeats, keep_periods))
                own = batch.slice(first, len(pieces))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:-1], pa.array([len(p) for p in pieces], pa.int64()),
                     pa.array([r for r, _ in both], pa.list_(_RUN)), pa.array([c for _, c in both], pa.string())],
                    names=[*own.schema.names[:-1], "n_words", "runs", "collapsed"])
                first += len(pieces)
    return run


def find_periodic_runs(docs: DataFrame, text_col: str = "text", min_length: int = 6, min_repeats: int = 4,
                       keep_periods: int = 1) -> DataFrame:
    """The columns of ``docs`` but the text, with n_words, runs (start and period by word number; by start, then period) and
    collapsed, the text without what its runs repeat after ``keep_periods`` periods."""
    ready(docs.sparkSession)
    if min_repeats < 2 or keep_periods < 1:
        raise ValueError("a run repeats its period at least once and keeps at least one")
    rest = [c for c in docs.columns if c not in (text_col, "n_words", "runs", "collapsed")]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text_col).alias("_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(_collapse(min_length, min_repeats, keep_periods), ", ".join([*kinds, RESULT]))
