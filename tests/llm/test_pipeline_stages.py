"""Single stages of the pipeline on rows made for what they have to do."""

import random

import corpus_pipeline as p
from tests.conftest import SF001
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_line_dedup import texts_after

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts], SCHEMA)


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def similar(a, b, k, percent):
    a, b = shingles(a, k), shingles(b, k)
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def firsts(texts):
    """The smallest id of each component of documents that link at five words and 0.8."""
    sets = [(i, shingles(t)) for i, t in texts]
    links = [(i, j) for x, (i, a) in enumerate(sets) for j, b in sets[x + 1:] if a and b and 100 * len(a & b) >= 80 * len(a | b)]
    root = {i: i for i, _ in texts}
    for _ in links:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return set(root.values())


def test_near_duplicates_by_five_words_and_four_fifths(spark):
    rng = random.Random(20)
    texts = [None, "", "one two", "One two"]
    for _ in range(10):
        base = [f"w{rng.randrange(500)}" for _ in range(100)]
        texts.append(" ".join(base))
        for edits in (1, 2, 3):
            copy = list(base)
            for at in rng.sample(range(5, 95), edits):
                copy[at] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts = list(enumerate(texts))
    want = firsts(texts)
    assert any(similar(a, b, 5, 80) and not similar(a, b, 3, 90) for i, a in texts for j, b in texts if i < j)
    got = p.near_duplicates(spark, documents(spark, texts), "").collect()
    assert {r.doc_id for r in got} == want


def test_lines_stage_against_brute_force(spark):
    rng = random.Random(21)
    own = lambda: " ".join(f"o{rng.randrange(10**9)}" for _ in range(12))
    short = ["Les.", "All rights reserved.", "\u6625\u7720\u4e0d\u899a\u6681\u8655\u8655\u805e\u557c\u9ce5" * 20, "}", "aa bb cc dd ee", "aa bb cc dd ff",
             "aa bb cc dd", "one two three four five six seven", "one two three four six seven", "one two three four five six seven eight nine"]
    texts = [(i, "\n".join([*([own()] if i % 3 else []), *rng.sample(short, 4), "", " "])) for i in range(60)] + [(70, None), (71, "")]
    want = texts_after(texts)
    assert 40 < len(want) < 62
    got = {r.doc_id: r for r in p.lines(spark, documents(spark, texts), "").collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values() if r.text is not None)


def test_documents_with_a_line_of_their_own_stay(spark):
    boiler = "this page was printed from the archive"
    texts = [(0, boiler), (1, f"{boiler}\nroses are red\nviolets\n"), (2, f"{boiler}\n \n"), (3, f"{boiler}\n春眠不覚暁"),
             (4, f"violets\n{boiler}\nroses are red"), (5, ""), (6, None), (7, "short text"), (8, "short text")]
    got = {r.doc_id: r.text for r in p.lines(spark, documents(spark, texts), "").collect()}
    assert got == {0: boiler, 1: "roses are red\nviolets\n", 3: "春眠不覚暁", 5: "", 6: None, 7: "short text"}


def test_whole_table_by_these_rules(spark, tmpdir_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    for name, stage in p.STAGES:
        texts = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, SF001).write.parquet(f"{tmpdir_path}/{name}")
        docs = spark.read.parquet(f"{tmpdir_path}/{name}")
        after = {r.doc_id: r for r in docs.collect()}
        if name == "lines":
            assert {i: r.text for i, r in after.items()} == texts_after(texts)
        elif name == "near_duplicates":
            assert set(after) == firsts(texts)
        elif name == "decontaminate":
            assert set(after) == {i for i, _ in texts} - {i for i, _ in leaks(texts, items)}
        elif name == "mix":
            size = {i: len(t.split()) for i, t in texts}
            assert abs(sum(size[i] * r.copies for i, r in after.items()) - sum(size.values())) <= 64 * 20
