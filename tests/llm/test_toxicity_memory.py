"""The driver trains on all words of its texts at once, so each array of a sweep counts."""

import tracemalloc

import numpy as np

from quarrywork.llm import toxicity


def test_a_sweep_holds_few_arrays_of_its_words():
    n = 200_000
    energy, before = np.linspace(-3, 3, n), np.arange(0, n + 1, 400)
    tracemalloc.start()
    try:
        p = toxicity.marginals(energy, np.array([[0.1, 0.0], [0.0, 0.2]]), before)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(p) == n and ((p > 0) & (p < 1)).all()
    assert peak < 9.5 * 8 * n
