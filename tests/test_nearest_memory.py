import tracemalloc

import numpy as np
import pytest

from trajscreen.operators import answers


@pytest.mark.parametrize("k", [1, 5, 5000])
def test_distances_to_a_bank_are_not_held_at_once(k):
    rng = np.random.default_rng(3)
    q, b = rng.normal(size=(256, 4)), rng.normal(size=(30_000, 4))
    tracemalloc.start()
    got = answers._nearest(np.arange(256), q, b, k, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    if k < 100:
        assert peak < 256 * 30_000 * 8  # one matrix of all distances; before, several were held
    want = np.sort(np.linalg.norm(q[7] - b, axis=1))[:k]
    assert got.column("d").to_numpy().reshape(256, k)[7] == pytest.approx(want, abs=1e-6)
