import random

import regex as re
from pyspark.sql import functions as F

from escalade.llm import line_dedup as d


def one_apart(a, b):
    """One word inserted, deleted or replaced at most, which holds no number."""
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    plain = lambda w: not re.search(r"\p{N}", w)
    if len(a) == len(b):
        return a == b or a[p + 1:] == b[p + 1:] and plain(a[p]) and plain(b[p])
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return longer[p + 1:] == shorter[p:] and plain(longer[p])


def letters(line):
    return len(re.findall(r"[\p{L}\p{N}]", line))


def judged(rows, min_letters=d.MIN_LETTERS, near_words=d.NEAR_WORDS):
    places = []
    for i, text in rows:
        if text is not None:
            places += [((i is None, i or 0, k), line.split(), letters(line) >= min_letters) for k, line in enumerate(text.split("\n"))]
    gone, repeats = set(), set()
    for place, words, long in places:
        for other, theirs, counts in places:
            if other < place and words:
                if words == theirs:
                    repeats.add(place)
                near = len(words) >= near_words and len(theirs) >= near_words and one_apart(words, theirs)
                if long and counts and (words == theirs or near):
                    gone.add(place)
    whole = {(i, text): None if text is None else
             "\n".join(x for k, x in enumerate(text.split("\n")) if (i is None, i or 0, k) not in gone) for i, text in rows}
    told = [((i, text), [(i is None, i or 0, k) in gone | repeats for k, x in enumerate((text or "").split("\n")) if x.split()]) for i, text in rows]
    return whole, {row for row, said in told if not all(said) or not said}


def texts_after(rows):
    """What the pipeline's stage keeps: documents go whose every line repeats an earlier one."""
    whole, own = judged(rows)
    return {i: whole[(i, t)] for i, t in rows if (i, t) in own}


def brute(rows, *floors):
    return judged(rows, *floors)[0]


def edited(rng, words):
    words, at = list(words), rng.randrange(len(words))
    kind = rng.choice("sid")
    if kind == "s":
        words[at] = rng.choice("xyz")
    elif kind == "i":
        words.insert(at, rng.choice("abx"))
    else:
        del words[at]
    return words


def test_against_brute_force(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcde") for _ in range(rng.choice([3, 5, 9, 10, 11, 14, 40, 70]))] for _ in range(25)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(0, 4)):
            words = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                words = edited(rng, words)
            lines.append(" ".join(words) if rng.random() < 0.9 else "\t ".join(words) + " ")
        rows.append((i, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "a b c d e\n" * 3), (None, " ".join(base[6])), (0, rows[0][1])]
    docs = spark.createDataFrame([(*r, "k", 9) for r in rows], "doc_id bigint, text string, at string, n_lines int")
    want = brute(rows)
    got = d.dedup_lines(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[(r.doc_id, dict(rows)[r.doc_id])], r.doc_id
        assert r["at"] == "k"


def test_long_line_variants_and_verification(spark):
    words = [f"w{i}" for i in range(3000)]
    other = words[:1500] + ["new"] + words[1500:]
    swapped = words[:10] + [words[11], words[10]] + words[12:]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(swapped))], "doc_id bigint, text string")
    got = {r.doc_id: r.n_removed for r in d.dedup_lines(docs).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_empty_and_plan_without_python(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    out = d.dedup_lines(docs)
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_word_distance_expression(spark):
    rng = random.Random(6)
    pairs = [([rng.choice("ab") for _ in range(rng.randint(1, 6))], [rng.choice("ab") for _ in range(rng.randint(1, 6))]) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>").withColumn("near", d.near_words_apart(F.col("a"), F.col("b")))
    assert all(r.near == one_apart(r.a, r.b) for r in df.collect())


def test_floor_and_numbers(spark):
    """Marks, brackets and short lines stay, whole lines without spaces go, and a number makes a line another one."""
    han = "\u6625\u7720\u4e0d\u899a\u6681\u8655\u8655\u805e\u557c\u9ce5" * 9
    same = ["{", "}", "* * * * * * * * * * * *", "All rights reserved.", han, "Les.", "see the notes on page 7 below"]
    rows = [(1, "\n".join([*same, "chapter 1 of the book", "the red house on the hill", "it has 7 old oak doors"])),
            (2, "\n".join([*same, "chapter 2 of the book", "the green house on the hill", "it has 7 new oak doors"]))]
    got = {r.doc_id: r.text for r in d.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: rows[0][1], 2: "\n".join(["{", "}", same[2], "Les.", "chapter 2 of the book"])} == {i: t for (i, _), t in brute(rows).items()}


def test_ids_that_no_bigint_place_holds(spark):
    text = "one two three four five six\nseven eight nine ten eleven"
    rows = [(2**62, text), (-2**62, text + "\nmore words of its own"), (None, text), (3, "one two three four five seven")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert d.Places.of(docs.selectExpr("coalesce(doc_id, 9223372036854775807) as doc", "text")).wide
    assert {(r.doc_id, r.text) for r in d.dedup_lines(docs).collect()} == {(i, t) for (i, _), t in brute(rows).items()}
