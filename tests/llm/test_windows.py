"""Windows of a text that is gone over in pieces are those of the whole text."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from sentiloom.llm import decontamination as d


def _plain(shingles: np.ndarray, classes: list[int], factors, shifts) -> set[int]:
    """Keys of every window, each with minima of its own: 2u shingles every u, a shorter one at the end."""
    hashes = (shingles >> np.uint64(32)).astype(np.uint32)
    out: set[int] = set()
    for u in classes:
        starts = range(0, max(1, -(-len(hashes) // u) - 1)) if len(hashes) else ()
        for j in starts:
            part = hashes[j * u : (j + 2) * u]
            least = (part[:, None] * factors + shifts).min(axis=0)
            out |= set(d._keys(least[None, :], u).ravel().tolist())
    return out


@pytest.mark.parametrize("classes", [[1, 2, 8, 32], [4], [16, 64]])
@pytest.mark.parametrize("n", [0, 1, 5, 63, 64, 65, 96, 128, 129, 192, 257, 700])
def test_pieces_hold_every_window(classes, n):
    factors, shifts = d._functions()
    shingles = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    want = _plain(shingles, classes, factors, shifts)
    for piece in (1, 64, 100, 8192):
        got = [k.ravel() for k in d.window_keys(shingles, classes, factors, shifts, piece)]
        assert (set(np.concatenate(got).tolist()) if got else set()) == want


def test_memory_does_not_grow_with_the_text():
    factors, shifts = d._functions()
    shingles = np.random.default_rng(0).integers(0, 2**63, 1_000_000).astype(np.uint64)
    tracemalloc.start()
    for _ in d.window_keys(shingles, [1, 8, 32], factors, shifts):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6
