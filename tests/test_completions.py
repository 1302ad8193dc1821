"""ST1 in append mode: completions leave when they are whole, late repeats are ignored, nothing stays behind."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from escalade.streaming import completions as C
from escalade.streaming import runner as S

AT = dt.datetime(2024, 1, 1)
CHUNK_SCHEMA = "id bigint, index int, seq bigint, created timestamp, role string, content string, finish_reason string"


def chunk(i, seq, text, minute=0, role=None, finish=None, index=0):
    return (i, index, seq, AT + dt.timedelta(minutes=minute), role, text, finish)


def run(spark, path, batches, name, **options):
    """One file after the other, as micro-batches of one query; (rows, state rows at the end)."""
    import time
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, CHUNK_SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    stream = spark.readStream.schema(CHUNK_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    table = f"{name}_out"
    q = (C.assemble_completions(stream, **options).writeStream.format("memory").queryName(table).outputMode("append")
         .option("checkpointLocation", f"{path}-ck").trigger(availableNow=True).start())
    S._finish(q)
    left = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1]
    return sorted((r["id"], r["index"], r.content, r.n_chunks, r.role, r.finish_reason) for r in spark.table(table).collect()), left


def test_whole_completions_leave_and_repeats_are_ignored(spark, tmpdir_path):
    first = [chunk(1, 1, "b "), chunk(1, 0, "a ", role="assistant"), chunk(2, 0, "x", role="assistant", finish="stop"), chunk(2, 0, "y", index=1)]
    second = [chunk(1, 2, None, 1, finish="length"), chunk(2, 0, "x", 1, role="assistant", finish="stop"), chunk(1, 0, "a ", 1, role="assistant")]
    third = [chunk(1, 2, None, 2, finish="length"), chunk(3, 1, "late end", 2, finish="stop")]
    got, left = run(spark, f"{tmpdir_path}/c", [first, second, third], "whole")
    assert got == [(1, 0, "a b ", 3, "assistant", "length"), (2, 0, "x", 1, "assistant", "stop")]
    assert left > 0  # what waits, and what has left and may be repeated


def test_state_returns_to_nothing(spark, tmpdir_path):
    first = [chunk(1, 0, "a", role="assistant", finish="stop"), chunk(2, 0, "open "), chunk(2, 1, "end")]
    time_goes_on = [(9, 0, None, AT + dt.timedelta(hours=h), None, None, None) for h in (2,)]
    got, left = run(spark, f"{tmpdir_path}/s", [first, time_goes_on, time_goes_on], "empty", timeout_s=600, retention_s=300)
    assert got == [(1, 0, "a", 1, "assistant", "stop"), (2, 0, "open end", 2, None, None)]
    assert left == 0


def test_too_many_chunks_raise(spark, tmpdir_path):
    with pytest.raises(Exception, match="more than 3 chunks"):
        run(spark, f"{tmpdir_path}/m", [[chunk(1, s, "x") for s in range(5)]], "many", max_chunks=3)


def test_chunks_of_a_completion_reach_the_state_as_one_row(spark, tmpdir_path):
    """1,200 chunks of 4 completions, interleaved, some twice: the state is asked per completion, not per chunk."""
    rows = [chunk(i, s, f"w{s} ", role="assistant" if s == 0 else None, finish="stop" if s == 299 else None) for s in range(300) for i in (1, 2, None, 4)
            for _ in range(2 if s % 7 == 0 else 1)]
    stream = spark.createDataFrame(rows, CHUNK_SCHEMA).coalesce(1).withColumn("at", F.unix_millis("created"))
    kept = [f"{c} array<struct<seq: bigint, said: string>>" for c in ("role", "finish_reason")]
    packs = stream.mapInArrow(C._pack, ", ".join(["id bigint, index int, created timestamp, at bigint, seq array<bigint>, content array<string>", *kept])).collect()
    assert sorted((p.id or 0, len(p.seq), [tuple(r) for r in p.role], [tuple(r) for r in p.finish_reason]) for p in packs) == [
        (i, 343, [(0, "assistant")] * 2, [(299, "stop")]) for i in (0, 1, 2, 4)]
    rows = [r for r in rows if r[0]]
    got, _ = run(spark, f"{tmpdir_path}/p", [rows[500:], rows[:500]], "packs")
    assert [(r[0], *r[3:]) for r in got] == [(i, 300, "assistant", "stop") for i in (1, 2, 4)]
    assert {r[2] for r in got} == {"".join(f"w{s} " for s in range(300))}


def test_a_late_chunk_is_not_carried_by_a_timely_one(spark, tmpdir_path):
    """Chunks of one completion with different times: the watermark judges each on its own, also where they came together."""
    goes_on = [chunk(9, None, None, 60)]
    mixed = [chunk(1, 0, "late ", 0), chunk(1, 1, "in ", 61), chunk(1, 2, "time", 61, finish="stop")]
    end = [chunk(9, None, None, 600)]
    got, _ = run(spark, f"{tmpdir_path}/l", [goes_on, goes_on, mixed, end, end], "late")
    assert got == [(1, 0, "in time", 2, None, "stop")]
