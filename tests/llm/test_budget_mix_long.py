"""Budgets of few or long documents: the nearest sum may be above by more than the slack."""

import random

from escalade.llm import budget_mix as m
from tests.llm.test_budget_mix import reachable


def test_fit_counts_takes_the_nearest_sum_above():
    assert m.fit_counts([(1000, 3)], 1900) == {1000: 2}
    assert m.fit_counts([(20_000, 1)], 19_900) == {20_000: 1}
    assert sum(m.fit_counts([(20_000, 1)], 10_000).values()) == 0
    assert m.fit_counts([(9_000_000, 2)], 8_000_000) == {9_000_000: 1}


def test_fit_counts_is_nearest_for_few_documents():
    rng = random.Random(4)
    for _ in range(300):
        items = [(s, rng.randint(1, 3)) for s in rng.sample(range(50, 3000), rng.randint(1, 4))]
        budget = rng.randrange(sum(s * c for s, c in items))
        take = m.fit_counts(items, budget)
        assert all(0 <= x <= dict(items)[s] for s, x in take.items())
        assert abs(sum(s * x for s, x in take.items()) - budget) == min(abs(s - budget) for s in reachable(items))
