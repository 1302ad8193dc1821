"""CSV files whose records may hold line breaks, read by many tasks.

Spark's multi-line CSV reader takes a whole file in one task. Here a file is read as lines, in blocks, and records are cut where
the number of quotes so far is even (a doubled quote counts two, so it changes nothing):

1. One aggregate counts the quotes of every block (one row per block of a file); running sums tell whether a block begins inside a record.
2. Each block's lines are joined to records where they are. Only what a block cuts off at its ends, two pieces a block at
   most, is brought together.
3. Records are parsed by Spark (``from_csv``), by the names of the header.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WHOLE, _REST, _OPEN = 0, 1, 2  # a record; what a block begins with of an earlier block's record; the beginning of one that goes on


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, inside, value) in the order of the files -> (file, block, kind, first, text)."""
    at, lines, inside, kind, first = None, [], False, _WHOLE, False

    def piece(kind_: int) -> tuple:
        return (*at, kind_, first, "\n".join(lines))

    for batch in batches:
        out = []
        for file, block, begins_inside, value in zip(*[c.to_pylist() for c in batch.columns]):
            if (file, block) != at:
                if lines:
                    out.append(piece(_OPEN if kind == _WHOLE else _REST))
                at, lines, inside, first = (file, block), [], begins_inside, block == 0
                kind = _REST if inside else _WHOLE
            lines.append(value)
            if value.count('"') % 2:
                inside = not inside
            if not inside:
                out.append(piece(kind))
                lines, kind, first = [], _WHOLE, False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()))],
                                             names=["file", "block", "kind", "first", "text"])
    if lines:
        yield pa.RecordBatch.from_arrays([pa.array([x]) if not isinstance(x, int) or isinstance(x, bool) else pa.array([x], t) for x, t in zip(
            piece(_OPEN if kind == _WHOLE else _REST), (None, pa.int64(), pa.int32(), None, None))], names=["file", "block", "kind", "first", "text"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, text): the records of the CSV files under ``path``, line breaks in quoted fields included; ``first`` marks each
    file's first record (its header). Blank records are left out, an unclosed quote takes the rest of its file."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    blocks = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))  # one row per block
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    inside = blocks.select("file", "block", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"))
    pieces = (lines.join(F.broadcast(inside), ["file", "block"]).select("file", "block", "inside", "value")
              .mapInArrow(_cut, "file string, block bigint, kind int, first boolean, text string"))
    whole = pieces.where(F.col("kind") == _WHOLE).select("file", "first", "text")
    cut = pieces.where(F.col("kind") != _WHOLE)
    number = F.sum(F.when(F.col("kind") == _OPEN, 1).otherwise(0)).over(
        Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0))
    joined = cut.withColumn("number", number).groupBy("file", "number").agg(
        F.bool_or(F.col("first") & (F.col("kind") == _OPEN)).alias("first"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "kind", "text"))), lambda p: p["text"]), "\n").alias("text"))
    records = whole.unionByName(joined.select("file", "first", "text"))
    return records.withColumn("text", F.regexp_replace("text", r"\r\z", "")).where(F.col("text").rlike(r"\S"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the CSV files under ``path`` as strings, named by their header, which has to be the same in all files."""
    records = csv_records(spark, path)
    headers = [r.text for r in records.where("first").select("text").distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError(f"files under {path} have different headers: {headers}")
    if not headers:
        return spark.createDataFrame([], "value string").drop("value")
    named = spark.range(1).select(F.from_csv(F.lit(headers[0]), ", ".join(f"c{i} string" for i in range(headers[0].count(",") + 1)),
                                             {"escape": '"', "quote": '"'}).alias("h")).first()["h"]
    names = [n for n in named if n is not None]
    fields = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    options = {"escape": '"', "quote": '"', "maxCharsPerColumn": "-1", "maxColumns": str(max(len(names) + 1, 20480))}
    return records.where(~F.col("first")).select(F.from_csv("text", fields, options).alias("r")).select("r.*")
