"""File sources and sinks (S1, S3-S8): suffix-dispatched readers/writers and typed dataset readers.

Spark writes directories of part files; CSV uses the doubled-quote escape and multi-line records like pandas;
JSON output is JSON Lines (a single pretty-printed array is a single-machine format), while JSON arrays are
still readable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from escalade.functions.quantiles import valid
from escalade.operators.datasets import orient_pairs, prefix_split, to_adequacy_samples
from escalade.schemas import ADEQUACY_SCHEMA, PAIRWISE_SCHEMA, TOKENS_USED
from escalade.sources.records import read_csv

READ_FORMATS = (".csv", ".json", ".jsonl", ".parquet")
WRITE_FORMATS = ("csv", "json", "jsonl", "parquet")
# Texts hold quotes and line breaks; Spark's CSV writer would also trim blanks by default. Blanks stay on reading too.
CSV_WRITE = {"header": True, "escape": '"', "quote": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _suffix(path: str) -> str:
    p = path.rstrip("/")
    dot = p.rfind(".")
    return p[dot:].lower() if dot > p.rfind("/") else ""


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read by suffix: .csv (header, quoted multi-line records, cut in parallel), .json (an array of records or lines, file by
    file), .jsonl, .parquet."""
    suf = _suffix(path)
    if suf not in READ_FORMATS:
        raise ValueError(f"Unsupported format: {suf or path}")
    r = spark.read
    if suf == ".csv":
        df = read_csv(spark, path)
        if schema is None:
            return df
        # by the names of the header: a schema given to the CSV reader would go by position
        return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns
                           else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    if schema is not None:
        r = r.schema(schema)
    if suf == ".json":
        # JSON Lines (what write_table makes) stay splittable; only files that hold an array of records are read whole
        lines = spark.read.text(path).where(F.trim("value") != "").select(
            F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), "value", F.monotonically_increasing_id().alias("i"))
        begins = lines.groupBy("f").agg(F.min_by(F.substring(F.ltrim("value"), 1, 1), F.struct("b", "i")).alias("c"))
        arrays, plain = ([x.f for x in begins.where((F.col("c") == "[") if whole else (F.col("c") != "[")).collect()] for whole in (True, False))
        if not arrays:
            return r.json(path)
        whole = r.option("multiLine", True).json(arrays)
        return whole.unionByName(r.option("multiLine", False).json(plain), allowMissingColumns=True) if plain else whole
    if suf == ".jsonl":
        return r.json(path)
    return r.parquet(path)


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite") -> None:
    """S3: write csv / json (JSON Lines) / jsonl / parquet; any other format raises."""
    fmt = (fmt or _suffix(path).lstrip(".")).lower()
    if fmt not in WRITE_FORMATS:
        raise ValueError(f"Unsupported format: {fmt}")
    w = df.write.mode(mode)
    if fmt == "csv":
        w.options(**CSV_WRITE).csv(path)
    elif fmt in ("json", "jsonl"):
        w.json(path)
    else:
        w.parquet(path)


def write_datasets(pairs_adequacy: DataFrame | None, pairs_pairwise: DataFrame | None, out_dir: str,
                   order_by: str = "pair_id", ratio: float = 0.9, fmt: str = "parquet") -> dict[str, str]:
    """Split each dataset (D1 prefix split) and write ``<kind>`` directories partitioned by ``split``
    (train / val) — the four outputs of the reference as two partitioned tables. Folders carry the format as their
    suffix, so S5 and S6 read them (``split`` comes from the folder names)."""
    if fmt not in WRITE_FORMATS:
        raise ValueError(f"Unsupported format: {fmt}")
    out = {}
    for kind, df in (("adequacy", pairs_adequacy), ("pairwise", pairs_pairwise)):
        if df is None:
            continue
        s = prefix_split(df, [order_by], ratio).drop("ord")
        path = f"{out_dir.rstrip('/')}/{kind}.{fmt}"
        w = s.write.mode("overwrite").partitionBy("split")
        if fmt == "csv":
            w.options(**CSV_WRITE).csv(path)
        else:
            w.format("json" if fmt == "jsonl" else fmt).save(path)
        out[kind] = path
    return out


def read_adequacy(spark: SparkSession, path: str) -> DataFrame:
    """Typed adequacy rows -> training-sample form (prompt, response, label DOUBLE)."""
    return to_adequacy_samples(read_table(spark, path, ADEQUACY_SCHEMA))


def read_pairwise(spark: SparkSession, path: str) -> DataFrame:
    """Typed pairwise rows -> oriented (prompt, response_preferred, response_non_preferred)."""
    return orient_pairs(read_table(spark, path, PAIRWISE_SCHEMA))


TOKEN_FIELDS = ("weak_input", "weak_output", "strong_input", "strong_output")
DOUBLE_COLS = ("routing_score", "weak_quality_score", "cost_usd", "latency_ms")


def normalize_routing_results(df: DataFrame) -> DataFrame:
    """``tokens_used`` as a struct whatever it arrived as (struct, JSON string, or four flat columns), and
    NaN scores/costs/latencies as NULL."""
    cols = df.columns
    if "tokens_used" in cols:
        dt = df.schema["tokens_used"].dataType
        if isinstance(dt, T.StringType):
            tok = F.from_json("tokens_used", TOKENS_USED)
        else:
            tok = F.col("tokens_used")
        tok = F.struct(*[tok[f].cast("bigint").alias(f) for f in TOKEN_FIELDS])
        out = df.withColumn("tokens_used", tok)
    elif all(f in cols for f in TOKEN_FIELDS):
        out = df.withColumn("tokens_used", F.struct(*[F.col(f).cast("bigint").alias(f) for f in TOKEN_FIELDS]))
        out = out.drop(*TOKEN_FIELDS)
    else:
        out = df
    for c in DOUBLE_COLS:
        if c in cols:
            out = out.withColumn(c, F.when(valid(F.col(c).cast("double")), F.col(c).cast("double")))
    return out


def read_routing_results(spark: SparkSession, path: str) -> DataFrame:
    """Read a results file and normalise it."""
    return normalize_routing_results(read_table(spark, path))


def profile_table(df: DataFrame) -> DataFrame:
    """One pass: per column its type, the row count and the NULL count (long form)."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.count_if(F.col(f.name).isNull()).alias(f"n_{i}")
                                                for i, f in enumerate(fields)]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                              F.lit(i).alias("position"), F.col(f"n_{i}").alias("n_null"))
                     for i, f in enumerate(fields)])
    return one.select(F.col("__n").alias("n_rows"), F.inline(rows)).select("position", "column", "type", "n_rows",
                                                                           "n_null")


def sample_rows(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """S8 companion: a preview of ``n`` rows (the notebook's ``head()``); with ``order_by`` it is the first n rows
    of that order (a distributed top-n: each partition keeps n rows, one small merge)."""
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)
