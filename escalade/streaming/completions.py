"""ST1 in append mode: a completion leaves the stream when its last chunk is there, and so does its state.

Each completion (id, index) keeps only what waits: its chunks until ``finish_reason`` and all chunks before it have come, then, for
``retention``, nothing but the fact that it has left, so that repeated chunks are ignored. Event-time timers end both: a completion
whose end doesn't come within ``timeout`` of its newest chunk leaves as it is (``finish_reason`` null). A completion's chunks are
bounded by ``max_tokens``; more than ``max_chunks`` raise.

Chunks that follow each other in an Arrow batch reach the state as one row per completion and time (``created``): what a completion
costs there is a few calls, not its number of chunks. Chunks of different times stay apart, so the watermark still judges each one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State store with timers; set on the session before such a stream starts.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
MAX_CHUNKS = 131_072
_WAITING = "seq array<bigint>, content array<string>, role string, role_seq bigint, finish string, last bigint, gone boolean, expires bigint"
OUTPUT = "id bigint, index int, content string, n_chunks bigint, role string, finish_reason string"
_KEYS, _PARTS, _SAID = ("id", "index", "created", "at"), ("seq", "content"), ("role", "finish_reason")


class _Assembler(StatefulProcessor):
    def __init__(self, timeout_ms: int, retention_ms: int, max_chunks: int):
        self.timeout_ms, self.retention_ms, self.max_chunks = timeout_ms, retention_ms, max_chunks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("completion", _WAITING)

    def _expire_at(self, at: int, before: int | None) -> None:
        if before is not None and before != at:
            self.handle.deleteTimer(before)
        if before != at:
            self.handle.registerTimer(at)

    def _row(self, key, parts: dict, role, finish) -> Row:
        text = "".join(parts[s] or "" for s in sorted(parts))
        return Row(id=key[0], index=key[1], content=text, n_chunks=len(parts), role=role, finish_reason=finish)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get()
        before = held[7] if held is not None else None
        parts, role, role_seq, finish, last, newest = {}, None, None, None, None, None
        if held is not None and not held[6]:
            parts, (role, role_seq, finish, last) = dict(zip(held[0], held[1])), held[2:6]
        for pack in rows:
            at, seqs = pack["at"], pack["seq"]
            for seq, text in zip(seqs, pack["content"]):
                if seq is not None:  # rows without a place only carry time
                    parts.setdefault(seq, text)
            if any(seq is not None for seq in seqs):
                if at is None:
                    raise ValueError(f"completion {key} has a chunk without a time")
                newest = at if newest is None else max(newest, at)
            for told in pack["role"]:
                if role_seq is None or told["seq"] < role_seq:
                    role, role_seq = told["said"], told["seq"]
            for told in pack["finish_reason"]:
                if last is None or told["seq"] > last:
                    finish, last = told["said"], told["seq"]
        if newest is None:
            return
        if held is not None and held[6]:
            return  # it has left: a repeat
        if len(parts) > self.max_chunks:
            raise ValueError(f"completion {key} has more than {self.max_chunks} chunks")
        if last is not None and len(parts) >= last + 1 and all(s in parts for s in range(last + 1)):
            at = newest + self.retention_ms
            self._expire_at(at, before)
            self.state.update(([], [], None, None, None, None, True, at))
            yield self._row(key, parts, role, finish)
        else:
            at = max(newest + self.timeout_ms, before or 0)
            self._expire_at(at, before)
            order = sorted(parts)
            self.state.update((order, [parts[s] for s in order], role, role_seq, finish, last, False, at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.state.get()
        self.state.clear()
        if held is not None and not held[6] and held[0]:
            yield self._row(key, dict(zip(held[0], held[1])), held[2], held[4])

    def close(self) -> None:
        pass


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (id, index, created) of each batch, with its chunks in lists, in the order in which they came; of roles and
    finish reasons, which few chunks have, only those that are there."""
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in _KEYS])).combine_chunks()
        columns = {c: table[c].combine_chunks() for c in table.column_names}
        new = pa.array([True] + [False] * (len(table) - 1))
        for c in _KEYS[:3]:
            was, now = columns[c][:-1], columns[c][1:]
            differs = pc.or_(pc.fill_null(pc.not_equal(was, now), False), pc.xor(pc.is_null(was), pc.is_null(now)))
            new = pc.or_(new, pa.concat_arrays([pa.array([True]), differs]))
        first = pc.indices_nonzero(new)
        ends = np.append(first.to_numpy().astype(np.int64), len(table))
        out = {c: columns[c].take(first) for c in _KEYS}
        out |= {c: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), columns[c]) for c in _PARTS}
        for c in _SAID:
            there = pc.and_(pc.is_valid(columns[c]), pc.is_valid(columns["seq"]))
            before = np.append(0, np.cumsum(there.to_numpy(zero_copy_only=False)))
            said = pa.StructArray.from_arrays([columns["seq"].filter(there), columns[c].filter(there)], ["seq", "said"])
            out[c] = pa.ListArray.from_arrays(pa.array(before[ends], pa.int32()), said)
        yield pa.RecordBatch.from_pydict(out)


def assemble_completions(chunks: DataFrame, delay: str = "1 minute", timeout_s: int = 600, retention_s: int = 600,
                         max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """Stream of (id, index, seq from 0, created, role, content, finish_reason) -> one row per completion, in append mode."""
    chunks.sparkSession.conf.set(*ROCKSDB)
    # the process that asks the assembler for its state's schema knows only what is sent to it, not the files added to the session
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = chunks.select("id", "index", "created", F.unix_millis("created").alias("at"), F.col("seq").cast("bigint").alias("seq"),
                         "content", "role", "finish_reason")
    kind = {f.name: f.dataType for f in rows.schema.fields}
    said = {c: T.StructType([T.StructField("seq", T.LongType()), T.StructField("said", kind[c])]) for c in _SAID}
    packed = T.StructType([*[T.StructField(c, kind[c]) for c in _KEYS], *[T.StructField(c, T.ArrayType((kind | said)[c])) for c in _PARTS + _SAID]])
    packs = rows.mapInArrow(_pack, packed).withWatermark("created", delay)
    return packs.groupBy("id", "index").transformWithState(
        _Assembler(timeout_s * 1000, retention_s * 1000, max_chunks), OUTPUT, "Append", "EventTime")
