import random

import numpy as np
import pytest

from escalade.llm import ordinal_quality as o

SCHEMA = "doc_id bigint, text string, keep string, n int"


def corpus(n, seed):
    rng = random.Random(seed)
    rows, grades = [], []
    for i in range(n):
        grade = rng.randrange(3)
        words = [rng.choice(["sun", "rain", "wind", "the", "of", "sea"]) for _ in range(rng.randint(3, 60))]
        if grade == 0:
            words = [w + "***" for w in words]
        elif grade == 1:
            words[rng.randrange(len(words))] = rng.choice(["rotten", "nasty"])
        rows.append((i, " ".join(words), "clash", 1))
        grades.append((i, grade))
    return rows, grades


def test_held_out_accuracy_and_odd_rows(spark):
    rows, grades = corpus(900, 11)
    rows += [(5000, None, "c", 0), (5001, "", "c", 0), (None, "sun sea", "c", 0), (0, rows[0][1], "c", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    told = [g for g in grades if g[0] % 3] + [(7777, 1), (4, None), (8, 9)]
    model = o.train(docs, spark.createDataFrame(told, "doc_id bigint, grade int"), grades=3)
    out = o.score(docs, model, keep_grade=2).collect()
    assert len(out) == len(rows) and out[0].__fields__ == ["doc_id", "expected_grade", "tail", "keep"]
    truth = dict(grades)
    held = [r for r in out if r.doc_id is not None and r.doc_id % 3 == 0 and r.doc_id in truth]
    assert np.mean([r.keep == (truth[r.doc_id] == 2) for r in held]) > 0.95
    assert np.mean([abs(r.expected_grade - truth[r.doc_id]) for r in held]) < 0.2
    carried = o.score(docs, model, keep_grade=2, carry=True)
    assert carried.columns == ["doc_id", "text", "n", "expected_grade", "tail", "keep"]
    again = o.score(docs, o.train(docs, spark.createDataFrame(told, "doc_id bigint, grade int"), grades=3), 2).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_gradient_and_order_of_thresholds():
    rng = np.random.default_rng(1)
    hashed = [np.unique(rng.integers(0, 40, 6)).astype(np.int32) for _ in range(200)]
    dense = rng.normal(size=(200, o.N_DENSE))
    grade = np.array([min(2, int(h.min() < 5) + int(d[0] > 0)) for h, d in zip(hashed, dense)])
    model = o.fit(hashed, dense, grade, 3, min_docs=1)
    assert np.all(np.diff(model.thresholds) > 0)
    line = np.array([model.line(h, d) for h, d in zip(hashed, dense)])
    tails = model.tails(line)
    assert np.all(tails[:, 0] >= tails[:, 1])
    assert np.mean((tails[:, 1] > 0.5) == (grade == 2)) > 0.8


@pytest.mark.parametrize("grades,want", [([], 2.0), ([(1, 1), (2, 1)], 1.0)])
def test_no_or_one_grade(spark, grades, want):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    model = o.train(docs, spark.createDataFrame(grades, "doc_id bigint, grade int"), 3)
    assert {r.expected_grade for r in o.score(docs, model, 2).collect()} == {want}
    assert o.score(docs.filter("false"), model, 2).count() == 0


def test_repeated_labels_count_each_time(spark):
    rows, grades = corpus(200, 12)
    docs = spark.createDataFrame(rows, SCHEMA)
    train = lambda told: o.train(docs, spark.createDataFrame(told, "doc_id bigint, grade int"), grades=3)
    once, often = train(grades), train(grades + [g for g in grades if g[1] == 0] * 5)
    assert not np.allclose(once.thresholds, often.thresholds)
    mean = lambda m: np.mean([r.expected_grade for r in o.score(docs, m, keep_grade=2).collect()])
    assert mean(often) < mean(once)
