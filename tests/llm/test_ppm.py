import random
import zlib
from collections import Counter

import numpy as np
import pytest

from escalade.llm import ppm


def held(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1


def brute(rows, order):
    trie, words = ppm.Trie(order), Counter()
    for i, t in rows:
        if not held(i):
            data = b"\xff" * order + ppm.lowered(t) + b"\xff"
            for j in range(order, len(data)):
                trie.learn(data[j - order:j], data[j])
            words.update(ppm.lowered(t).split())
            words[b"\n"] += 1
    n, v, out = sum(words.values()), len(words), []
    for i, t in rows:
        tokens = [*ppm.lowered(t).split(), b"\n"]
        base = sum(np.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        out.append((str(i), held(i), len(tokens), sum(words[w] > 0 for w in tokens), n, round(float(base), 6),
                    round(float(trie.walk(ppm.lowered(t), False)), 6)))
    return sorted(out)


def rows(seed=1):
    rng = random.Random(seed)
    made = [(i, "".join(rng.choice("abcab ab \nXé") for _ in range(rng.choice([0, 1, 2, 5, 30, 60])))) for i in range(40)]
    return [*made, (41, None), (None, "hey ab"), (3, "abc"), (3, "abc")]


def got(df, **options):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
                  for r in ppm.score(df, **options).collect())


@pytest.mark.parametrize("options", [{"order": 4}, {"order": 4, "max_words": 3, "max_grams": 20}, {"order": 2}, {"order": 1}, {"order": 0}])
def test_against_the_plain_trie(spark, options):
    df = spark.createDataFrame([(*r, 1.0) for r in rows()], "doc_id bigint, text string, score double").repartition(3)
    assert got(df, **options) == brute(rows(), options["order"])


def test_probabilities_sum_to_one():
    trie = ppm.Trie(3)
    trie.walk(b"abracadabra abracadabra", True)
    for context in (b"abr", b"zzz", b"\xff\xff\xff", b"xra"):
        assert abs(sum(10 ** trie.log10(context, s) for s in range(256)) - 1) < 1e-9


def test_adaptive_mode(spark):
    df = spark.createDataFrame([(1, "abab abab"), (2, None)], "doc_id bigint, text string")
    want = {1: ppm.Trie(4).walk(b"abab abab", True), 2: ppm.Trie(4).walk(b"", True)}
    assert {r.doc_id: round(r.score, 9) for r in ppm.score(df, mode="adaptive").collect()} == {k: round(float(v), 9) for k, v in want.items()}


def test_no_training_rows_and_empty(spark):
    only = [i for i in range(60) if held(i)][:2]
    df = spark.createDataFrame([(i, "ab") for i in only], "doc_id bigint, text string")
    for r in ppm.score(df).collect():
        assert r.train_tokens == 0 and r.n_known == 0 and abs(r.score - 3 * np.log10(1 / 256)) < 1e-9 and abs(r.base_score) < 1e-9
    assert ppm.score(df.filter("false")).count() == 0


def test_lookup_table():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    table = ppm.Lookup(keys[::2], np.arange(len(keys[::2]), dtype=float))
    out = table.get(keys)
    assert np.array_equal(out[::2], np.arange(len(keys[::2]))) and np.isnan(out[1::2]).all()
    assert np.isnan(ppm.Lookup(keys[:0], np.empty(0)).get(keys)).all()
