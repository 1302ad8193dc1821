"""The queries that SQL can express against DuckDB, the others against what their tables hold."""

import pytest

from escalade.llm.queries import ORACLES, QUERIES
from escalade.plans.oracle_check import compare, duckdb_connection
from tests.conftest import SF001, SF01


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    r = compare(spark, name, QUERIES[name], ORACLES[name], SF001, duckdb_connection(SF001))
    assert r.ok, r.detail


def test_registered_names():
    import __spark_entry__ as e
    assert {int(n[2:].split("_")[0]) for n in e.queries() if n.startswith("op")} == set(range(1, 14))
    assert "pipeline" in e.queries()


def test_mix_on_table(spark):
    rows = QUERIES["op2_budget_mix"](spark, SF01).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "source").collect()}
    assert len(rows) == len(source)
    taken, target, size = {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[s] = taken.get(s, 0) + r.taken
        size[s] = size.get(s, 0) + r.size
        target[s], own = r.target, r.source_size
        assert own >= r.size
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 * sum(size.values())
    assert all(abs(taken[s] - target[s]) <= 64 for s in target)
    again = QUERIES["op2_budget_mix"](spark, SF01).collect()
    assert sorted(rows) == sorted(again)


def test_extraction_on_table(spark):
    import html
    import re
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()}
    rows = QUERIES["op8_html_blocks"](spark, SF01).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split())
                 for p in re.split(r"</?(?:h1|p)[^>]*>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)


def test_licenses_on_table(spark):
    from escalade.llm.license_scan import TEMPLATES
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    found = {(r.doc_id, r.template) for r in QUERIES["op9_license_scan"](spark, SF01).collect()}
    verbatim = {(i, k) for i, t in texts.items() for k, (_, words) in enumerate(TEMPLATES) if words in t}
    assert verbatim and verbatim <= found
    assert len(found) <= len(verbatim) + 2
