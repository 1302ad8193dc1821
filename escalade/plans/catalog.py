"""Registry of the queries exposed to the driver: name -> (Spark builder, DuckDB oracle SQL or None).

Query names are ``<SURVEY id>_<operator>``. Spark builders take ``(spark, sf_dir)`` and return a lazy DataFrame
computed from the driver tables; oracle SQL is DuckDB text over the same tables (derived views inlined as CTEs).
Outputs are flat scalars; doubles are rounded (money to 9 places, everything else to 6) in both engines so that
summation order cannot change a value hash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle)
        return fn
    return deco


def rounded(df: DataFrame, money: tuple[str, ...] = (), digits: int = 6, money_digits: int = 9) -> DataFrame:
    """Round every DOUBLE/FLOAT column (``money`` columns to ``money_digits``)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            d = money_digits if f.name in money else digits
            out.append(F.round(F.col(f.name).cast("double"), d).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def _load_all():
    # Importing the modules fills REGISTRY.
    from escalade.plans import (q_metrics, q_reports, q_text, q_datasets, q_routing, q_scores,  # noqa: F401
                                q_training, q_streaming, q_io, q_chain)


def all_queries() -> dict[str, Query]:
    if not REGISTRY:
        _load_all()
    return dict(REGISTRY)
