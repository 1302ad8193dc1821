import re

import pytest

from escalade.llm import html_blocks as h

TREE = h.train_tree()
LONG = " ".join(f"word{i}" for i in range(60))


def test_tree_learns_its_table():
    assert all(h.classify(TREE, r[:-1]) == r[-1] for r in h.LABELLED_BLOCKS)


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("   ", ""), ("<p", ""), ("<html><body></body></html>", ""),
    (f"<nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p>One&nbsp;\n two<br>three &#228;</article><footer>{LONG}</footer>",
     "A & B\n\nOne two three ä"),
    (f"<div class='ad'>{LONG}</div><main><p>Kept.</p><aside>{LONG}</aside><form>Name <input></form></main>", "Kept."),
    (f"<article><p>Text <script>var a = '<p>no</p>';</script>more<!-- {LONG} --></p><style>p{{}}</style></article>", "Text\n\nmore"),
    (f"<article><p>Body text</p></article><section id='comments'><p>{LONG}</p></section>", "Body text"),
    ("<article><p>a &lt;b&gt; c &amp;amp;</p></article>", "a <b> c &amp;"),
    (f"<ul class=menu><li><a>x</a><li><a>y</a></ul><div><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div>", LONG),
    ("<article><p title='a>b'>Quoted</p><p>Cut <b>off</b> <a href='", "Quoted\n\nCut off"),
])
def test_pages(page, text):
    assert h.main_text(page, TREE) == text


def test_spark_rows(spark):
    rows = [(1, "u", "<article><p>x y</p></article>", "extra", 4), (2, None, None, "e", 0), (2, None, None, "e", 0), (None, "u", "", "e", 0)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted((str(r.page_id), r.url, r.text, r.n_chars) for r in h.extract(df).collect() if r.url)
    assert got == [("1", "u", "x y", 3), ("None", "u", "", 0)]
    assert h.extract(df).count() == 4 and h.extract(df.filter("false")).count() == 0


def test_very_long_page():
    page = "<article>" + "".join(f"<p>{LONG}</p>" for _ in range(3000)) + "</article>"
    assert h.main_text(page, TREE).count("\n\n") == 2999


def test_pages_without_marks(spark):
    """With every class, id, role and region element taken away, only counts, densities and neighbours are left to go by."""
    from tests.conftest import SF001
    pages = [r.html for r in spark.read.parquet(f"{SF001}/pages.parquet").select("html").collect()]
    kept = found = both = 0
    for page in pages:
        bare = re.sub(r"""\s(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", "", page)
        bare = re.sub(r"(</?)(?:article|main|nav|header|footer|aside|form|section)\b", r"\1div", bare)
        want, got = h.main_text(page, TREE).split(), h.main_text(bare, TREE).split()
        rest = list(want)
        hits = sum(1 for w in got if w in rest and not rest.remove(w)) if len(want) < 3000 else len(set(want) & set(got))
        kept, found, both = kept + len(want), found + len(got), both + hits
    assert both / kept > 0.97 and both / found > 0.93, (both / kept, both / found)
