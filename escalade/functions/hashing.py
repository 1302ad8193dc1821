"""Portable seeded hash, identical in Spark and DuckDB.

``hash32(x, seed)`` is the first 32 bits of ``md5("seed:x")``: seeds are independent of each other, every bit mixes, and
both engines write it in plain SQL. Used for reproducible "random" choices (prompt generation, random router, exact
splits, epoch shuffles) where Spark's ``rand`` would depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MOD = 4294967296


def hash32(x: Column | str, seed: int = 0) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(int(seed))), x.cast("string"))), 1, 8), 16, 10).cast("bigint")


def hash32_sql(x: str, seed: int = 0) -> str:
    """DuckDB text of :func:`hash32`."""
    return f"(('0x' || substr(md5('{int(seed)}:' || cast({x} as varchar)), 1, 8))::bigint)"


def unit_uniform(x: Column | str, seed: int = 0) -> Column:
    """Uniform value in [0, 1) derived from :func:`hash32`."""
    return hash32(x, seed) / F.lit(float(_MOD))


def unit_uniform_sql(x: str, seed: int = 0) -> str:
    return f"({hash32_sql(x, seed)} / 4294967296e0)"
