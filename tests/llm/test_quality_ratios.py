"""The classifier's log-count ratios against counting by hand (test_pipeline holds the solver against the primal)."""

import numpy as np

from scorelake.llm import quality


def rows_and_signs():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(40, size=rng.integers(1, 12), replace=False)).astype(np.int32) for _ in range(60)]
    y = np.where([r.min() < 6 for r in rows], 1.0, -1.0)
    return [*rows, rows[0], np.array([], dtype=np.int32)], np.append(y, [y[0], -1.0])  # a repeated row and an empty one


def test_ratios_equal_counting_each_class():
    rows, y = rows_and_signs()
    shares = []
    for sign in (1, -1):
        counts = [1.0] * (1 << quality.BITS)
        for r, v in zip(rows, y):
            for i in r if v == sign else ():
                counts[i] += 1
        shares.append(np.array(counts) / sum(counts))
    assert np.allclose(quality.ratios(rows, y), np.log(shares[0] / shares[1]))
