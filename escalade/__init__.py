"""escalade — two-tier model-routing analytics as Spark DataFrame jobs.

Layout:
  sources/    table loading, file readers/writers, fixture views derived from the driver tables
  functions/  Column -> Column building blocks (text, hashing, scores, cost, quantiles, ordinals)
  operators/  DataFrame -> DataFrame operators (datasets, routing, metrics, reports, losses, training)
  plans/      the registered query catalog and its DuckDB oracle SQL
  streaming/  Structured Streaming variants (chunk assembly, windowed metrics, cascade on a stream)
"""

from escalade.session import get_spark, ensure_checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "ensure_checkpoint_dir"]
