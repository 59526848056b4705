"""The nearest rows of a leaf by a window along its widest key, against all rows."""

import numpy as np
import pytest

from lumenframe.operators import space


@pytest.mark.parametrize(("wide", "steps"), [(300.0, 0), (3.0, 8), (0.0, 3)])
def test_window_gives_what_all_rows_give(monkeypatch, wide, steps):
    rng = np.random.default_rng(4)
    draw = lambda n: np.stack([rng.random(n) * wide if not steps else rng.integers(0, steps, n) * wide, rng.integers(0, 5, n) / 7], axis=1)
    b, a = draw(500), np.vstack([draw(200), [[-50.0, 0.0], [1e6, 1.0]]])  # many ties in the stepped ones; two queries outside
    value, other = rng.integers(0, 9, 500).astype(float), rng.random(500)
    scale = lambda d: d * 3 / 2
    far = scale(space.squared(a, b))
    met, plain = [], space.squared
    monkeypatch.setattr(space, "squared", lambda q, r: met.append(len(q)) or plain(q, r))
    got = {0: [], 1: []}
    for v, i, at, d in space.closest(a, b, [value, other], 5, scale):
        assert (far[i, at] == d).all()
        got[v] += zip(i, d, (value, other)[v][at], strict=True)
    for v, x in enumerate((value, other)):
        i, at = space.taken(far, x, 5)
        assert sorted(got[v]) == sorted(zip(i, far[i, at], x[at], strict=True))
    if not steps:
        assert sum(met) < 20  # few queries meet all rows
