"""From raw documents to a training mix: quality, repeated lines, near duplicates, benchmark leaks, source weights.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``docs``; extra columns are carried.

* quality: trained on the labelled documents, drops those whose chance of the top grade is under 0.7.
* lines: takes out every line of ten letters and digits or more that an earlier line equals (word for word: a line without
  spaces is compared whole) or, from five words on, nearly equals (one word without a number is a fifth of it at most); the
  same floors as op3_line_dedup. Then it drops documents that have no line of their own left: every non-blank one of theirs
  repeated an earlier line (short ones stay in other texts, but don't keep a document). ``n_chars`` follows the text.
* near_duplicates: of documents that link (directly or through others), the one with the smallest id stays; they link if
  their sets of five-word shingles have a Jaccard similarity of 0.8 or more (op5_jaccard_join has its own: three, 0.9).
* decontaminate: drops documents that overlap a benchmark item.
* mix: takes documents (some repeatedly, ``copies`` says how often) until each source has its target share of words.

Defined cases: as the operators say; a null text is kept by every stage but the quality stage, which judges it like an
empty one, and the mix, which has nothing to take from it; null ids stay through the near-duplicate stage; empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from escalade.llm import budget_mix, decontaminate, jaccard_join, line_dedup, ordinal_quality
from escalade.llm.common import table
from escalade.llm.queries import document_grades
from escalade.session import scratch_path

SHINGLE_WORDS, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = ordinal_quality.train(docs, document_grades(spark, sf_dir), grades=3)
    judged = ordinal_quality.score(docs, model, keep_grade=2, carry=True, names=("_grade", "_tail", "_keep"))
    return judged.filter("_keep").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = ("_n_lines", "_n_removed", "_n_own", "_n_repeats")
    out = line_dedup.dedup_lines(docs, count_names=names).filter("_n_repeats = 0 or _n_own > 0")
    n_chars = F.when(F.col("_n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, k=SHINGLE_WORDS, percent=PERCENT).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return budget_mix.take(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", benchmark_leaks),
          ("mix", mix)]

#: SQL can't express the trained stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
