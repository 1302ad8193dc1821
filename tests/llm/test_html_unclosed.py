import pytest

from escalade.llm import html_blocks as h

TREE = h.train_tree()
LONG = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize("page,text", [
    ("<head><title>t</title><article><p>text", "text"),
    (f"<html><head><meta charset=x><title>a < b</title><style>p{{}}</style><script>'<p>'</script><!-- c -->\n<p>{LONG}", LONG),
    (f"<head><title>t</title></head><body><p>{LONG}</p>", LONG),
    (f"<head><title>t</title>{LONG}", LONG),
    (f"<head><title>t<p>{LONG}</p>", LONG),
    (f"<title>t</title><p>{LONG}</p>", LONG),
    ("<head><title>t</title>", ""),
    ("<article><p>one</p><noscript><p>two</p></article>", "one\n\ntwo"),
    ("<article><button>b <p>two</p></article>", "b\n\ntwo"),
    ("<article><iframe src=x><p>two</p></article>", "two"),
    ("<article><svg><p>two</p></article>", "two"),
    ("<article><select><option>a<option>b</select><p>two</p></article>", "two"),
    ("<article><datalist><option value=a><option value=b></datalist><p>two</p><option>x</option></article>", "two"),
    ("<article><p>one</p><option><p>two</p></article>", "one\n\ntwo"),
    ("<article><p>one</p><textarea><p>two</p></article>", "one"),
    ("<article><p>one</p><script><p>two</p></article>", "one"),
])
def test_unclosed_hidden_elements(page, text):
    assert h.main_text(page, TREE) == text


def test_many_unclosed_elements():
    page = "<article>" + f"<iframe><p>{LONG}</p>" * 3000 + "</article>"
    assert h.main_text(page, TREE).count("\n\n") == 2999
