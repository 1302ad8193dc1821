"""Ids beyond 2^53 beside null ones: pandas would hold such a column as doubles."""

from escalade.llm import html_blocks, license_scan, ordinal_quality, ppm
from escalade.llm.license_scan import TEMPLATES

IDS = [2**53 + 1, None, 2**62 + 3, 7]


def told(rows, name="doc_id"):
    return sorted((r[name] for r in rows), key=str)


def documents(spark, text):
    return spark.createDataFrame([(i, text, i) for i in IDS], "doc_id bigint, text string, n_chars bigint").coalesce(1)


def test_scores_and_scans_keep_ids(spark):
    docs = documents(spark, TEMPLATES[0][1])
    assert told(ppm.score(docs).collect()) == sorted(IDS, key=str)
    assert told(license_scan.scan(docs).collect()) == sorted(IDS, key=str)


def test_quality_keeps_ids_and_carried_columns(spark):
    docs = documents(spark, "some words to be judged here")
    ratings = spark.createDataFrame([(i, n % 3) for n, i in enumerate([2**53 + 1, 2**62 + 3, 7])], "doc_id bigint, grade int")
    model = ordinal_quality.train(docs, ratings, grades=3)
    assert told(ordinal_quality.score(docs, model, keep_grade=2).collect()) == sorted(IDS, key=str)
    whole = ordinal_quality.score(docs, model, keep_grade=2, carry=True).collect()
    assert told(whole) == told(whole, "n_chars") == sorted(IDS, key=str)


def test_pages_keep_ids(spark):
    pages = spark.createDataFrame([(i, "u", "<p>a page</p>") for i in IDS], "page_id bigint, url string, html string").coalesce(1)
    assert told(html_blocks.extract(pages).collect(), "page_id") == sorted(IDS, key=str)
