"""License scan: MinHash over overlapping text windows retrieves templates, exact shingle containment verifies.

Words are lower-cased and stripped of outer punctuation; a shingle is five words. A license occurs where a stretch of the
text holds at least ``min_containment`` (0.8) of the distinct shingles of its template.

Templates are put into classes by length (each class spans a factor of about 1.5). For a class, a text is cut into
overlapping windows that are long enough for its longest template (with a quarter more words for insertions) plus the
step between windows, so that any occurrence lies whole inside one window. That bounds the Jaccard similarity J of the
template and that window from below. Bands have one row; with b of them a window that holds the template misses all bands
with the probability (1 - J)^b, and each class gets the smallest b for which this is at most ``miss`` (0.001). A window's
MinHash values come from minima of blocks of one step, so overlapping windows share the work.

A retrieved (window, template) pair is verified on the exact shingle sets. Of verified windows of one template that
overlap, the best is reported (most shingles, then the first), with the words from its first to its last common shingle.

Each text is scanned whole, in one pass without a shuffle; long texts go through in overlapping segments, so a task's memory
is bounded. Templates are a small parameter table, sent with the tasks.

Defined cases: null and empty texts, and texts under five words, have no rows; a template under five words raises; two
templates with the same words are both reported; repeated rows are each scanned; further columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escalade.llm.common import bytes_words, mix64, ready

K = 5
_SEGMENT = 1 << 15
_MAX = np.uint64(np.iinfo(np.uint64).max)
_OUTER = b"".join(bytes([b]) for b in range(33, 127) if not chr(b).isalnum())

#: License notices (short forms, and the opening or decisive passage of longer ones).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation"),
    ("AGPL", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
                "this work"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


class _WordHashes(dict):
    """64-bit hashes of words (lower case, outer punctuation off); 0 for a word of punctuation only."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        bare = word.strip(_OUTER)
        value = self[word] = xxhash.xxh3_64_intdigest(bare) or 1 if bare else 0
        return value


_HASHES = _WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    h = np.array([_HASHES[w] for w in bytes_words(text)], dtype=np.uint64)
    return h[h != 0]


def shingles(h: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each five words in a row."""
    if len(h) < K:
        return np.empty(0, np.uint64)
    acc = np.zeros(len(h) - K + 1, dtype=np.uint64)
    for i in range(K):
        acc = mix64(acc + h[i:len(h) - K + 1 + i] + np.uint64(i + 1))
    return acc


def _family(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd factors and offsets of the MinHash functions."""
    seed = mix64(np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seed[:size] | np.uint64(1), seed[size:]


@dataclass
class LengthClass:
    """Templates of similar length, and the windows in which they are looked for (in shingle places)."""

    members: list[int]
    step: int
    blocks: int  # steps of shingles that a window spans
    bands: int
    keys: list[np.ndarray]  # per band, the members' MinHash values
    filters: list[np.ndarray]  # per band, which upper 16 bits they have


@dataclass
class Templates:
    names: list[str]
    sets: list[np.ndarray]
    classes: list[LengthClass]
    factors: np.ndarray
    offsets: np.ndarray


def prepare(templates: Sequence[tuple[str, str]], min_containment: float = 0.8, miss: float = 0.001) -> Templates:
    sets = [np.unique(shingles(word_hashes(t))) for _, t in templates]
    if min((len(s) for s in sets), default=1) == 0:
        raise ValueError("a template needs five words at least")
    lengths = [len(word_hashes(t)) for _, t in templates]
    order, groups = sorted(range(len(sets)), key=lambda i: lengths[i]), []
    for i in order:
        if groups and lengths[i] <= lengths[groups[-1][0]] * (1.5 if lengths[i] > 8 else 1):
            groups[-1].append(i)
        else:
            groups.append([i])
    classes = []
    for members in groups:
        low, high = lengths[members[0]], lengths[members[-1]]
        span = high if high <= 8 else math.ceil(high * 1.25)
        step = 1 << max(1, int(math.log2(low / 4)))  # powers of two, so that windows begin alike in every text
        blocks = 1 + math.ceil((span - K) / step)  # any span of shingles lies whole in such a window
        smallest = min(len(sets[i]) for i in members)
        common = math.ceil(min_containment * smallest)
        jaccard = common / (blocks * step + smallest - common)
        bands = math.ceil(math.log(miss) / math.log(1 - jaccard)) if jaccard < 1 else 1
        classes.append(LengthClass(members, step, blocks, bands, [], []))
    factors, offsets = _family(max((c.bands for c in classes), default=1))
    for c in classes:
        for j in range(c.bands):
            least = np.array([((sets[i] ^ offsets[j]) * factors[j]).min() for i in c.members], dtype=np.uint64)
            c.keys.append(least)
            c.filters.append(np.zeros(1 << 16, dtype=bool))
            c.filters[j][least >> np.uint64(48)] = True
    return Templates([n for n, _ in templates], sets, classes, factors, offsets)


def _candidates(s: np.ndarray, outside: np.ndarray, t: Templates):
    """(template, window's first shingle, end) of the windows that share a band with a template. ``outside``: the places
    between documents."""
    most = max(c.bands for c in t.classes)
    for j in range(most):
        v = (s ^ t.offsets[j]) * t.factors[j]
        v[outside] = _MAX
        lows = {1: v}
        for step in range(1, t.classes[-1].step.bit_length()):
            finer = lows[1 << step - 1]
            lows[1 << step] = np.minimum(finer[::2], finer[1::2])
        for c in t.classes:
            if j >= c.bands:
                continue
            low = lows[c.step]
            least = low.copy()
            for b in range(1, min(c.blocks, len(low))):
                np.minimum(least[:-b], low[b:], out=least[:-b])
            for w in np.flatnonzero(c.filters[j][least >> np.uint64(48)]).tolist():
                for k in np.flatnonzero(c.keys[j] == least[w]).tolist():
                    yield c.members[k], w * c.step, (w + c.blocks) * c.step


def _best_spans(spans):
    """Of (common, first, last) that overlap, the one with most shingles, then the shortest, then the first."""
    best = None
    for common, first, last in sorted(set(spans), key=lambda x: (x[1], x[2])):
        if best is not None and first < best[2]:
            if (common, best[2] - best[1]) > (best[0], last - first):
                best = (common, first, last)
            continue
        if best is not None:
            yield best
        best = (common, first, last)
    if best is not None:
        yield best


def scan_texts(texts: Sequence[str | None], t: Templates, min_containment: float = 0.8):
    """(index, template number, first word, words, containment) of each occurrence, in order."""
    reach = max(c.blocks * c.step for c in t.classes)
    align = max(c.step for c in t.classes)
    pieces: list[tuple[int, int, np.ndarray]] = []  # (index, first place in its text, shingles)
    verified: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    filled = 0

    def flush() -> None:
        total, starts = 0, []
        for _, _, part in pieces:
            starts.append(total)
            total += -(-(len(part) + reach) // align) * align
        s, used = np.zeros(total, dtype=np.uint64), np.zeros(total, dtype=bool)
        for at, (_, _, part) in zip(starts, pieces):
            s[at:at + len(part)] = part
            used[at:at + len(part)] = True
        seen = set()
        begins = np.array(starts)
        for i, lo, hi in _candidates(s, np.flatnonzero(~used), t):
            if (i, lo) in seen or not used[lo:hi].any():
                continue
            seen.add((i, lo))
            n = int(np.searchsorted(begins, lo, side="right")) - 1
            index, offset, part = pieces[n]
            own = part[lo - starts[n]:hi - starts[n]]
            places = np.flatnonzero(np.isin(own, t.sets[i]))
            common = len(np.unique(own[places]))
            if common >= min_containment * len(t.sets[i]) - 1e-9:
                at = offset + lo - starts[n]
                verified.setdefault((index, i), []).append((common, at + int(places[0]), at + int(places[-1]) + K))
        pieces.clear()

    for index, text in enumerate(texts):
        whole = shingles(word_hashes(text))
        for at in range(0, len(whole), _SEGMENT):
            pieces.append((index, at, whole[at:at + _SEGMENT + reach]))
            filled += len(pieces[-1][2]) + reach
            if filled >= 2 * _SEGMENT:
                flush()
                filled = 0
    if pieces:
        flush()
    for (index, i), spans in sorted(verified.items()):
        for common, first, last in _best_spans(spans):
            yield index, i, first, last - first, common / len(t.sets[i])


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, min_containment: float = 0.8,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, template (its number), start_word, n_words, containment of every occurrence."""
    ready(docs.sparkSession)
    prepared = prepare(templates, min_containment)

    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
    names = ("doc_id", "license", "template", "start_word", "n_words", "containment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # ids as Python numbers, which null ones beside them don't round
            ids = batch.column(0).to_pylist()
            rows = [(ids[i], prepared.names[k], k, start, n, share)
                    for i, k, start, n, share in scan_texts(batch.column(1).to_pylist(), prepared, min_containment)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=list(names))

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, license string, template int, start_word bigint, n_words bigint, "
                                 "containment double")
