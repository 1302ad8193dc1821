"""Running streaming queries to completion (``availableNow``) with state and output in the shared checkpoint
folder, and the ST3 cascade on a request stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from escalade.operators.routing import Scorer, cascade
from escalade.schemas import CASCADE_THRESHOLD
from escalade.session import scratch_path
from escalade.sources.tables import load


def run_available_now(stream: DataFrame, name: str, output_mode: str = "append", fmt: str = "parquet") -> DataFrame:
    """Process everything available to the end, write it with the exactly-once file sink (append), as one table that
    each micro-batch replaces (complete), or keep it in memory (``memory``: tests), and return the result as a batch
    DataFrame. A query that fails raises; there is no time limit after which a partial result would be returned."""
    spark = stream.sparkSession
    ck = scratch_path(spark, f"{name}-checkpoint")
    if fmt == "memory":
        table = f"{name}_{uuid.uuid4().hex[:8]}"
        q = (stream.writeStream.format("memory").queryName(table).outputMode(output_mode)
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
        _finish(q)
        return spark.table(table)
    out = scratch_path(spark, f"{name}-out")
    if output_mode == "complete":
        # every micro-batch holds the whole result table: the last one written is the answer
        q = (stream.writeStream.outputMode("complete").option("checkpointLocation", ck).trigger(availableNow=True)
             .foreachBatch(lambda batch, _: batch.write.mode("overwrite").format(fmt).save(out)).start())
        _finish(q)
        return spark.read.format(fmt).load(out)
    q = (stream.writeStream.format(fmt).outputMode(output_mode).option("path", out)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    _finish(q)
    return spark.read.format(fmt).load(out)


def run_counting_late(stream: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Run an append stream to the end; its rows, and how many groups of late rows its stateful operators dropped (rows behind
    the watermark are counted after they were combined by window in their task)."""
    spark = stream.sparkSession
    out, ck = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-checkpoint")
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", ck)
             .trigger(availableNow=True).start())
    _finish(query)
    late = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    return spark.read.schema(stream.schema).parquet(out), late


def awaited_responses(requests: DataFrame, responses: DataFrame, wait: str, delay: str, ts: str = "ts",
                      responded_at: str = "responded_at", key: str = "request_id") -> DataFrame:
    """Every request of a stream with its responses from another one, left outer: ``answered`` is null for requests whose
    responses didn't come within ``wait``; they leave when the watermarks (``delay`` behind both streams) have passed that time, and so
    does their state. A request has one row of responses; rows without a key are dropped."""
    left = requests.withWatermark(ts, delay).alias("q")
    right = responses.withColumnRenamed(key, "_key").withColumn("answered", F.col("_key").isNotNull()).withWatermark(responded_at, delay)
    within = (F.col(f"q.{key}") == F.col("_key")) & (F.col(responded_at) >= F.col(f"q.{ts}")) & (
        F.col(responded_at) <= F.col(f"q.{ts}") + F.expr(f"interval {wait}"))
    return left.filter(F.col(key).isNotNull()).join(right, within, "leftOuter").drop("_key")


def run_to_close(build, name: str, sources: list[tuple[str, str]], key: str = "request_id", beat: str = "2200-01-01 00:00:00") -> DataFrame:
    """Run an append stream over its sources to the end and close every window: after all available data, each source
    (folder, time column) gets one heartbeat row, which moves the watermarks past everything that waits.

    A heartbeat has nulls but for its time and a negative key of its own (a null key would be filtered before the watermark sees the
    row); it waits for a later time that doesn't come, so it isn't emitted. ``build`` makes the stream; both runs continue one
    checkpoint, so nothing is read or emitted twice."""
    ck = out = None
    for closing in (False, True):
        if closing:
            for number, (folder, time_col) in enumerate(sources, 1):
                rows = SparkSession.getActiveSession().read.parquet(folder)
                fixed = {time_col: beat, key: str(-number)}
                row = [F.lit(fixed.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
                rows.sparkSession.range(0, 1, 1, 1).select(*row).write.mode("append").parquet(folder)
        stream = build()
        ck = ck or scratch_path(stream.sparkSession, f"{name}-checkpoint")
        out = out or scratch_path(stream.sparkSession, f"{name}-out")
        _finish(stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", ck)
                .trigger(availableNow=True).start())
    return stream.sparkSession.read.parquet(out)


def _finish(query: StreamingQuery) -> None:
    """Wait for the end of all available data; a failed query raises its error."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def cascade_stream(requests: DataFrame, responses: DataFrame, key: str, scorer: Scorer | None = None,
                   threshold: float = CASCADE_THRESHOLD, **kw) -> DataFrame:
    """ST3: the R8 cascade on a request stream: stream-static join to the responses, then the same stateless
    projection as the batch operator (valid in append mode)."""
    return cascade(requests.join(responses, key), scorer, threshold=threshold, **kw)


def file_stream(spark: SparkSession, directory: str, file_glob: str = "*", fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A file source over ``directory`` (files matching ``file_glob``) with the schema of the files already there
    (streams need a fixed schema)."""
    schema = spark.read.format(fmt).option("pathGlobFilter", file_glob).load(directory).schema
    r = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(directory)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A file source over one driver table, be it one parquet file or a folder of them. The last dot as a glob: Spark would
    take a plain path as the base of partition folders, which a single file can't be."""
    schema = load(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}[.]parquet")
