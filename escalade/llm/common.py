"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from escalade.session import ensure_checkpoint_dir, ship_package

#: Fixed value: the word pattern of the query contracts (everything between blanks, tabs and line ends).
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """The session with a reliable checkpoint folder and with this package importable on the executors."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ascii_lower(col: Column) -> Column:
    """A-Z to lower case, nothing else (as the contracts ask; ``lower`` would change other scripts too)."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(col: Column) -> Column:
    """The words of a text in order: null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), WORD_GAP), "")


def bytes_words(text) -> list[bytes]:
    """The same words in Python, with A-Z lower-cased: bytes.lower() and bytes.split() know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def checked_broadcast(df: DataFrame, row_bytes: int, max_bytes: int = 32 << 20) -> DataFrame:
    """``df`` (checkpointed or written, so that counting is cheap) with a broadcast hint if its rows, of at most
    ``row_bytes`` each, are counted to fit ``max_bytes``; else as it is, and the join shuffles. Both give the same rows."""
    return F.broadcast(df) if df.count() * row_bytes <= max_bytes else df


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (Stafford's variant 13)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in small pieces: what a task makes of them at a time stays small, however large Spark's batches are."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class HashedWords(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def packed(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` checkpointed, read back in as few partitions as its counted rows need: narrow tables between the steps of an
    iterative job would otherwise leave a file for every pair of partitions."""
    df = df.checkpoint()
    return df.coalesce(max(1, -(-df.count() // rows)))
