import random

import numpy as np
import pytest

from escalade.llm import license_scan as s

T = s.prepare(s.TEMPLATES)


def test_planted_occurrences_are_found_where_they_are():
    rng = random.Random(12)
    texts, want = [], set()
    for i in range(400):
        words = [f"q{rng.randrange(500)}" for _ in range(rng.randint(0, 300))]
        k = rng.randrange(len(s.TEMPLATES))
        at = rng.randint(0, len(words))
        texts.append(" ".join(words[:at] + s.TEMPLATES[k][1].split() + words[at:]))
        want.add((i, k, at))
    got = {(i, k, at) for i, k, at, _, share in s.scan_texts(texts, T) if share == 1.0}
    assert len(want - got) <= 2  # missed with a chance of 0.001 each


def test_containment_is_exact_and_tolerant():
    mit = s.TEMPLATES[1][1].split()
    changed = mit[:20] + ["CHANGED"] + mit[21:]
    found = [(k, share) for _, k, _, _, share in s.scan_texts([" ".join(changed)], T) if k == 1]
    n = len(T.sets[1])
    assert found and abs(found[0][1] - (n - 5) / n) < 1e-9
    broken = [w if i % 6 else "x" for i, w in enumerate(mit)]
    assert not [k for _, k, *_ in s.scan_texts([" ".join(broken)], T) if k == 1]


def test_result_does_not_depend_on_the_batch():
    rng = random.Random(13)
    texts = [" ".join(["Licensed under the Apache License, Version 2.0."] * rng.randint(0, 3) + ["a b c"] * rng.randint(0, 40)) for _ in range(50)]
    together = {}
    for i, *rest in s.scan_texts(texts, T):
        together.setdefault(i, []).append(rest)
    for i, t in enumerate(texts):
        assert [x[1:] for x in (list(y) for y in s.scan_texts([t], T))] == together.get(i, [])


def test_long_text_in_segments(monkeypatch):
    monkeypatch.setattr(s, "_SEGMENT", 512)
    text = " ".join(f"v{i}" for i in range(511)) + " " + s.TEMPLATES[4][1] + " " + " ".join(f"z{i}" for i in range(3000)) + " " + s.TEMPLATES[1][1]
    assert {(k, at) for _, k, at, _, _ in s.scan_texts([text], T)} == {(4, 511), (1, 511 + 12 + 3000)}


def altered(rng, words, k, low, high):
    """A template's words with some replaced, so that its shingles are kept to a share of low to high; None if that can't be met."""
    own, places = list(words), rng.sample(range(len(words)), len(words))
    sets = T.sets[k]
    for at in places:
        share = len(np.intersect1d(s.shingles(s.word_hashes(" ".join(own))), sets)) / len(sets)
        if share < high:
            return own if share >= low else None
        own[at] = f"changed{rng.randrange(10**6)}"
    return None


@pytest.mark.parametrize("low,high", [(0.8, 0.85), (0.85, 0.92), (0.92, 1.0)])
def test_recall_of_altered_notices(low, high):
    """At the least containment too, at most a few of a thousand are missed; every find is above the bound."""
    rng = random.Random(int(low * 100))
    texts, want = [], set()
    while len(texts) < 250:
        k = rng.randrange(len(s.TEMPLATES))
        own = altered(rng, s.TEMPLATES[k][1].split(), k, low, high)
        if own is not None:
            noise = [f"q{rng.randrange(500)}" for _ in range(rng.randint(0, 120))]
            want.add((len(texts), k))
            texts.append(" ".join(noise + own + noise))
    found = list(s.scan_texts(texts, T))
    assert all(share >= 0.8 - 1e-9 for *_, share in found)
    assert len(want - {(i, k) for i, k, *_ in found}) <= 3


def brute(text, min_containment=0.8):
    """(template) of every template of which some window of twice its length holds enough shingles, by trying all windows."""
    h = s.shingles(s.word_hashes(text))
    out = set()
    for k, own in enumerate(T.sets):
        hit = np.isin(h, own)
        width = 2 * len(own)
        for at in np.flatnonzero(hit):
            if len(np.unique(h[at:at + width][hit[at:at + width]])) >= min_containment * len(own) - 1e-9:
                out.add(k)
                break
    return out


def test_finds_against_all_windows():
    rng = random.Random(15)
    texts = []
    for _ in range(60):
        parts = [f"q{rng.randrange(300)}" for _ in range(60)]
        for k in rng.sample(range(len(s.TEMPLATES)), rng.randrange(3)):
            own = s.TEMPLATES[k][1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                own[rng.randrange(len(own))] = "other"
            parts += own + [f"q{rng.randrange(300)}" for _ in range(60)]
        texts.append(" ".join(parts))
    got = {}
    for i, k, *_ in s.scan_texts(texts, T):
        got.setdefault(i, set()).add(k)
    want = {i: brute(t) for i, t in enumerate(texts)}
    assert sum(map(len, want.values())) > 25
    assert all(got.get(i, set()) <= w for i, w in want.items())
    assert sum(len(w - got.get(i, set())) for i, w in want.items()) <= 1


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (4, s.TEMPLATES[2][1], "x"), (4, s.TEMPLATES[2][1], "x"), (None, s.TEMPLATES[0][1].upper(), "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, license string")
    got = sorted(((r.doc_id, r.license) for r in s.scan(df).collect()), key=str)
    assert got == [(4, "Apache-2.0"), (4, "Apache-2.0"), (None, "MIT")]
    assert s.scan(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        s.prepare([("x", "too short")])
