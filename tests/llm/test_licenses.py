"""License scans: families of licenses, ties, many notices, and a scan of every place with the whole template."""

import random
import time

import numpy as np
import pytest

from sentiloom.llm import licenses as L

INDEX = L.Index(L.TEMPLATES)


@pytest.mark.parametrize("text, name", [
    *[(f"Licensed under CC {kind.upper()} 4.0.", f"cc-{kind}-4.0") for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")],
    *[(f"This work is licensed under the GNU {kind}General Public License, version {v}.", name) for kind, v, name in (
        ("", "2", "gpl-2.0"), ("", "3", "gpl-3.0"), ("Lesser ", "3", "lgpl-3.0"), ("Lesser ", "2.1", "lgpl-2.1"), ("Affero ", "3", "agpl-3.0"))],
    *[(text, name) for name, text in L.TEMPLATES.items()]])
def test_each_license_has_its_own_name(text, name):
    for around in ("{}", "Some words before. {} And some after, 7 of them.", "Chapter\n{}\nNext chapter", "{}\n{}"):
        got = L.scan(around.format(text, text), INDEX)
        assert [g[0] for g in got] == [name] * around.count("{}") and all(g[4] == 1 for g in got)


def test_a_foreign_version_is_no_license_of_the_index():
    for text in ("Licensed under the Apache License, Version 1.1.", "Licensed under CC BY-SA 3.0.", "This work is licensed under the GNU General Public License, version 1."):
        assert L.scan(text, INDEX) == []
    assert [g[0] for g in L.scan("This work is licensed under GNU General Public License, version 3", INDEX)] == ["gpl-3.0"]


def whole_scan(text, index, least=L.COVERAGE):
    """Every template against every window of its length and the band, without an index."""
    words, spans = L.tokens(text)
    given, found = L.deciding(text), set()
    for k, template in enumerate(index.words):
        for d in range(-len(template) + 1, len(words)):
            begin, end = max(0, d - L.BAND), min(len(words), d + L.BAND + len(template))
            for pairs in L.occurrences(template, words, begin, end, d - L.BAND, d + L.BAND, least):
                if L.agrees(pairs, index.decides[k], given):
                    found.add((spans[pairs[0][1]][0], spans[pairs[-1][1]][1], index.names[k], len(pairs), len(pairs) / len(template)))
    return L.outermost(list(found))


def test_scan_equals_a_scan_of_all_places():
    """Texts whose notices share a run of words with their template that winnowing cannot miss."""
    rnd = random.Random(4)
    names, sure, seen = ["a", "b", "c"], L.GRAM + L.WINDOW - 1, 0
    for _ in range(40):
        whole = {n: [f"t{n}{i}" for i in range(rnd.randint(5, 14))] for n in names}
        index, parts = L.Index({n: " ".join(words) for n, words in whole.items()}), []
        for _ in range(rnd.randint(0, 4)):
            words = list(whole[rnd.choice(names)])
            if len(words) >= sure + 2 and rnd.random() < 0.7:
                rnd.choice([lambda: words.insert(rnd.randint(1, 2), "other"), lambda: words.pop(1), lambda: words.pop()])()
            parts += words + [f"free{rnd.randint(0, 9)}" for _ in range(rnd.randint(12, 30))]
        got, want = L.scan(" ".join(parts), index), whole_scan(" ".join(parts), index)
        assert got == want
        seen += len(got)
    assert seen > 50


def test_outermost_equals_comparing_all():
    rng = np.random.default_rng(2)
    for _ in range(200):
        found = [(int(a), int(a + n), f"n{k}", int(m), 1.0) for a, n, k, m in zip(rng.integers(0, 60, 25), rng.integers(1, 20, 25), rng.integers(0, 3, 25), rng.integers(1, 9, 25))]
        kept = []
        for f in sorted(set(found), key=lambda f: (f[0] - f[1], -f[3], -f[4], f[2], f[0])):
            if not any((o[0] <= f[0] and f[1] <= o[1]) or (o[2] == f[2] and f[0] < o[1] and o[0] < f[1]) for o in kept):
                kept.append(f)
        assert sorted(L.outermost(found)) == sorted((n, a, b, m, c) for a, b, n, m, c in kept)


def test_many_notices_in_one_text():
    start = time.time()
    got = L.scan("\n".join(["Released under the MIT License.", "Licensed under CC BY-NC 4.0."] * 10_000), INDEX)
    assert len(got) == 20_000 and {g[0] for g in got} == {"mit", "cc-by-nc-4.0"} and time.time() - start < 20
