"""Pairs over the limit on terms: scored job by job in arrays, as each pair alone would be."""

import numpy as np
import pytest

from matchloom.operators import blocks
from matchloom.operators.ranked import TermRows, ranked_cosine


def document(rng, words):
    n = rng.integers(0, words + 1)
    return (np.sort(rng.choice(words, n, replace=False)).astype(np.int64),
            rng.geometric(rng.choice([.2, .5, .9]), n) * rng.choice([1, 1, 50]))


@pytest.mark.parametrize("seed", range(40))
def test_rows_as_pair_by_pair(seed):
    rng = np.random.default_rng(seed)
    left = [document(rng, 60) for _ in range(6)]
    right = document(rng, 200)
    rows = np.sort(rng.choice(6, 4, replace=False))
    for cap in (1, 2, 10, 40, 300):
        found = TermRows(left).cosines(rows, *right, cap)
        assert found.tolist() == [ranked_cosine(*left[r], *right, cap) for r in rows]


@pytest.mark.parametrize("n", [None, 2])
def test_one_evaluation_per_job(n, monkeypatch):
    asked = []
    scored = TermRows.cosines
    monkeypatch.setattr(TermRows, "cosines", lambda self, rows, *more: asked.append(len(rows)) or scored(self, rows, *more))
    terms = [(np.arange(5), np.ones(5, np.int64))] * 30
    jobs = [(np.arange(k, 40), np.ones(40 - k, np.int64)) for k in range(3)]
    monkeypatch.setattr(blocks, "_term_vectors", lambda left, right, mine, theirs: (terms, jobs))
    over, low, high = np.ones((30, 3), bool), np.zeros((30, 3)), np.full((30, 3), 25.0)
    capped = blocks._settle(None, None, over, low, high, np.zeros((30, 3)), 0.25, 10, 0.0, n)
    assert asked == [30, 30, 30]
    assert np.array_equal(low, high) and np.allclose(low, 25 * capped)
