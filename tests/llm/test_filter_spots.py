"""Windows are looked up at a cheap spot first, and no key that an item shares with a window is lost by that."""

from __future__ import annotations

import numpy as np

from sentiloom.llm import common
from sentiloom.llm import decontamination as d


def test_few_windows_get_a_key_and_all_shared_ones_do():
    factors, shifts = d._functions()
    r = np.random.default_rng(3)
    text = r.integers(0, 2**63, 4000).astype(np.uint64)
    items = [text[100:112], text[1000:1030], r.integers(0, 2**63, 40).astype(np.uint64)]
    bits, shared = np.zeros(d.FILTER_BITS // 8, np.uint8), set()
    for item in items:
        keys, spots = d.item_keys(item, factors, shifts)
        for at in (*spots.tolist(), *d._second_spots(keys).tolist()):
            bits[at >> 3] |= 1 << (at & 7)
        shared |= set(keys.tolist())
    classes = [16, 32, 64]
    every = set(np.concatenate([k.ravel() for k in d.window_keys(text, classes, factors, shifts)]).tolist())
    passed = [k for m, u in d._windows(text, classes, factors, shifts) for k in d._passing(m, d._spot_terms(u), d._key_seeds(u), bits).tolist()]
    assert every & shared and every & shared <= set(passed) and len(passed) < len(every) / 20


def test_hashing_words_keeps_nothing():
    parts = [b"w%d" % i for i in range(1000)]
    assert common.hash_words(parts).tolist() == [common.xxhash.xxh3_64_intdigest(w) for w in parts] and len(common.hash_words([])) == 0
    assert not [x for x in vars(common).values() if isinstance(x, dict) and b"w1" in x]
