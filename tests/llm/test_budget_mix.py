import random

from escalade.llm import budget_mix as m


def reachable(items):
    sums = {0}
    for size, count in items:
        sums = {s + size * c for s in sums for c in range(count + 1)}
    return sums


def test_subset_sum_is_exact():
    rng = random.Random(1)
    for _ in range(200):
        items = [(s, rng.randint(1, 4)) for s in rng.sample(range(1, 30), 4)]
        target = rng.randint(0, 90)
        taken = m.subset_sum(items, target, slack=20)
        assert all(0 < c <= dict(items)[s] for s, c in taken.items())
        best = min(abs(s - target) for s in reachable(items) if s <= target + 20)
        assert abs(sum(s * c for s, c in taken.items()) - target) == best


def test_fit_counts_stays_within_the_documents():
    rng = random.Random(2)
    for window in (10, 1 << 16):
        items = [(s, rng.randint(1, 50)) for s in range(1, 200)]
        whole = sum(s * c for s, c in items)
        for share in (0.0, 0.1, 0.37, 0.99):
            take = m.fit_counts(items, int(whole * share), window)
            assert all(0 <= x <= dict(items)[s] for s, x in take.items())
            assert sum(s * x for s, x in take.items()) == int(whole * share)


def water_fill(sizes, weights, total):
    target, capped = {}, set()
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        rate = left / sum(weights[s] for s in free) if free else 0
        over = [s for s in free if rate * weights[s] >= 3 * sizes[s]]
        if not over:
            return {s: 3 * sizes[s] if s in capped else rate * weights[s] for s in sizes}
        capped |= set(over)


def test_targets_nulls_ties_and_clashing_columns(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        source = rng.choice(["a", "b", "c", "d", "é", None])
        n = {"a": 3, "b": 40, "c": rng.randint(0, 90), "d": 1, "é": rng.randint(0, 5), None: 7}[source]
        rows.append((i, " \t".join("w" * rng.randint(1, 3) for _ in range(n)) + "\n", source, "x", 5, 1.0))
    rows += [(1000, None, "a", "x", 0, 0.0), (1001, " \n\x0b ", "e", "x", 0, 0.0), (None, "one two", "b", "x", 0, 0.0), (5, *rows[5][1:])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string, docs bigint, target double")
    for bucket in (4096, 5):
        got = m.mix(docs, bucket_rows=bucket).collect()
        assert len(got) == len(rows)
        sizes, taken, targets = {}, {}, {}
        order = {}
        for i, text, source, *_ in rows:
            order.setdefault(i, source)
            sizes[source] = sizes.get(source, 0) + len((text or "").split())
        for r in got:
            s = order[r.doc_id]
            assert r.source_size == sizes[s] and r.taken == r.size * r.copies and r.copies <= 3
            taken[s], targets[s] = taken.get(s, 0) + r.taken, r.target
        names = sorted((s for s in sizes if s is not None)) + [None]
        weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        want = water_fill(sizes, weights, sum(sizes.values()))
        for s in sizes:
            assert abs(targets[s] - want[s]) < 1e-6
            most = max(len((t or "").split()) for _, t, x, *_ in rows if x == s)
            assert abs(taken[s] - targets[s]) <= max(most / 2, 1)


def test_empty(spark):
    assert m.mix(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0
