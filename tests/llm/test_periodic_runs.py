"""Runs against their definition, and the query's digests against a plain account of the contract."""

import hashlib
import random
import re
import tracemalloc
import zlib

import pyarrow as pa
import pytest

from escalade.llm import periodic_runs as p
from escalade.llm.queries import QUERIES
from tests.conftest import SF001


def brute(w, min_length=6, min_repeats=4):
    """(start, length, period): every maximal stretch of each period, the smallest period of a stretch."""
    found = {}
    for q in range(1, len(w) // min_repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_repeats * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def digest(doc_id, text):
    w = split(text)
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        period = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % period] for i in range(n)]
    runs = brute(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(((-x, s, q) for s, x, q in runs), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *top, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (4, 3)])
def test_random_words_against_definition(limits):
    rng = random.Random(13)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            letters = rng.choice([1, 2, 3, 5])
            w = [b"%d" % rng.randrange(letters) for _ in range(rng.choice([0, 1, 2, 5, 20, 60]))]
            unit = [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(1, 9))]
            texts.append(w + unit * rng.randrange(8) + w[:3])
        got = [[(r["start"], r["length"], r["period"]) for r in runs] for runs, _ in p.runs_of_texts(texts, *limits, 1)]
        assert got == [brute(t, *limits) for t in texts]


def test_long_and_nested_repeats():
    word = [b"%d" % i for i in range(700)]
    inner = ([b"a", b"b"] * 5 + [b"c"]) * 6
    texts = [word * 9, [b"x"] * 5000, inner, word, []]
    got = [([(r["start"], r["length"], r["period"]) for r in runs], t) for runs, t in p.runs_of_texts(texts, 6, 4, 1)]
    assert got[0] == ([(0, 6300, 700)], b" ".join(word).decode()) and got[1] == ([(0, 5000, 1)], "x")
    assert got[2][0] == brute(inner) and len(got[2][0]) == 7
    assert got[3] == ([], b" ".join(word).decode()) and got[4] == ([], "")


def test_odd_rows_and_columns(spark):
    rows = [(None, "a a a a a a a", 1), (2**53 + 1, "b " * 9, 2), (3, None, 3), (4, " \n\t ", 4), (5, "é é é é é é", 5),
            (3, "x y x y x y x y", 6), (3, "x y x y x y x y", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs int").coalesce(1)
    got = p.find_periodic_runs(docs)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    told = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=str)
    assert told == sorted([(None, 7, [(0, 7, 1)], "a"), (2**53 + 1, 9, [(0, 9, 1)], "b"), (3, 0, [], ""), (4, 0, [], ""),
                           (5, 6, [(0, 6, 1)], "é"), (3, 8, [(0, 8, 2)], "x y"), (3, 8, [(0, 8, 2)], "x y")], key=str)
    assert p.find_periodic_runs(docs.filter("false")).count() == 0
    with pytest.raises(ValueError):
        p.find_periodic_runs(docs, min_repeats=1)


def test_query_on_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect() if len(split(r.text)) < 1500]
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF001).collect()}
    want = {i: digest(i, t) for i, t in docs}
    assert len(want) > 150 and sum(w[1] > 0 for w in want.values()) > 5
    assert {i: got[i] for i in want} == want


def test_query_on_odd_rows(spark, tmpdir_path):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "q " * 8), (500, None), (501, ""), (502, "\r\n"), (2**53 + 1, "z z z z z z z")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmpdir_path}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op13_periodic_runs"](spark, tmpdir_path).collect()), key=str)
    assert got == sorted((digest(*r) for r in rows), key=str)


def test_texts_are_split_once(spark):
    plan = QUERIES["op13_periodic_runs"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_memory_of_a_task_is_bounded():
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(500)) + " x y" * 50 for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array(texts)], names=["doc_id", "_text"])
    rows, runs = 0, []
    tracemalloc.start()
    try:
        for piece in p._collapse(6, 4, 1)(iter([batch])):
            rows += piece.num_rows
            runs += [[(r["start"], r["length"], r["period"]) for r in x] for x in piece.column("runs").to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 600 and runs[::60] == [brute(split(t)) for t in texts[::60]]
    assert peak < 25e6
