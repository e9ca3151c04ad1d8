"""How near the mix comes to its budgets when they are far beyond what the dynamic program holds."""

import numpy as np
import pytest

from tracewright.llm import mixing


@pytest.mark.parametrize("case", range(12))
def test_no_word_is_missed_in_large_sources(case):
    rng = np.random.default_rng(case)
    length = np.unique(np.concatenate([rng.integers(1, 400, 80), rng.integers(400, 60_000, 40)]))
    count = rng.integers(1, 10 ** rng.integers(2, 6), len(length))
    total = int((length * count).sum())
    for budget in (int(total * 0.13), total // 2, int(total * 0.97), mixing.BUDGET + 1, total - mixing.BUDGET - 7):
        if budget > 0:
            take = mixing.fit_counts(length, count, budget)
            assert (take >= 0).all() and (take <= count).all()
            assert int((take * length).sum()) == budget


def test_program_and_share_meet_where_one_takes_over():
    length, count = np.arange(3, 900), np.full(897, 40)
    for budget in range(mixing.BUDGET - 3, mixing.BUDGET + 4):
        assert int((mixing.fit_counts(length, count, budget) * length).sum()) == budget
