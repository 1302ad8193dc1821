"""Streams over driver tables that are one parquet file, or a folder of part files."""

import pytest

import __spark_entry__ as entry

TURNS = [(7, 0, "user", "how do tides work"), (7, 1, "assistant", "the moon pulls the sea"), (8, 0, "user", "and a\nneap tide"),
         (8, 1, "assistant", " weak  pull "), (12, 0, "user", "hi"), (12, 1, "assistant", "hello there you"), (13, 0, "user", None)]
EVENTS = [(1, "2024-01-01 05:00:00", "purchase", 2.0, '{"k": 3}'), (2, "2024-01-01 06:00:00", "click", 1.0, '{"k": 4}'),
          (3, "2024-01-02 00:00:00", "error", 1.0, '{"k": 5}')]


def write_tables(spark, folder, parts):
    """Both tables as folders of part files, or (parts 0) as one file each, as the driver's small sets have them."""
    import pyarrow.parquet as pq
    conv = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string")
    events = spark.createDataFrame(EVENTS, "event_id bigint, ts string, event_type string, value double, props string")
    for name, df in (("conversations", conv), ("events", events)):
        if parts:
            df.repartition(parts).write.parquet(f"{folder}/{name}.parquet")
        else:
            pq.write_table(df.toArrow(), f"{folder}/{name}.parquet")


@pytest.mark.parametrize("parts", [0, 1, 3])
def test_streams_read_a_table_of_one_file_or_of_many(spark, tmpdir_path, parts):
    write_tables(spark, tmpdir_path, parts)
    q = entry.queries()
    chunks = {(r.id >> 32, r.id & 0xFFFFFFFF): (r.content, r.n_chunks, r.role) for r in q["ST1_assemble_chunks_stream"](spark, tmpdir_path).collect()}
    assert chunks == {(7, 1): ("the moon pulls the sea ", 5, "assistant"), (8, 1): ("weak pull ", 2, "assistant"),
                      (12, 1): ("hello there you ", 3, "assistant")}
    streamed, batch = (sorted(map(tuple, q[n](spark, tmpdir_path).collect()), key=repr) for n in ("ST3_cascade_stream", "R8_cascade"))
    assert streamed == batch and len(streamed) == 3
    streamed, batch = (sorted(map(tuple, q[n](spark, tmpdir_path).collect())) for n in ("ST2_window_cost_by_model_stream", "ST2_window_cost_by_model"))
    assert streamed == batch and len(streamed) == 3
