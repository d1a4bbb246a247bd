"""Plain versions of the operators, and a table with everything that can go wrong in it."""

import re
from collections import defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_components(rows):
    """[(doc_id, text)] -> [(doc_id, n_shingles, component_id)], all pairs compared."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)].append(doc_id)
    return [(d, len(sets[i]), min([x for x in least[find(i)] if x is not None], default=None)) for i, (d, _) in enumerate(rows)]


def line_windows(rows):
    """[(doc_id, text)] with distinct ids -> {doc_id: deduped text}."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        lines = text.split("\n")
        filled = [(i, x.strip("\x20\x09\x0a\x0b\x0c\x0d")) for i, x in enumerate(lines)]
        filled = [x for x in filled if x[1]]
        gone = set()
        for a, b, c in zip(filled, filled[1:], filled[2:]):
            key = (a[1], b[1], c[1])
            if key in seen:
                gone |= set(range(a[0], c[0] + 1))
            seen.add(key)
        out[doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, component_id string, kept string, score string, predicted string, "
           "size string, taken string, deduped string, n_lines string, key string, rank string, class string, row string, _id string, item_id string, pii string")


def hostile(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, clashing column names."""
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    base = "the quick brown fox jumps over the lazy dog while the cat sleeps on the warm stone near the old mill"
    texts = [
        (1, None), (2, ""), (3, " \t\n\x0b\r "), (4, "one"), (5, "One"), (6, "one two three four"), (7, base), (7, base), (7, base + " again and again"),
        (8, base.upper()), (None, base), (None, None), (None, "another text that nobody has written so far, with some words"), (9, long_text), (10, long_text + " tail"),
        (11, "a\nb\nc\nd"), (12, "x\na\nb\nc\nz"), (13, "a\n\n b \nc\na\nb\nc"), (14, "é😀 ß " * 30), (15, "\n\n\n\n"), (-16, base), (17, "\x00 nul \x1f unit"),
    ]
    rows = [(i, t, *[None if k % 2 else ("en" if n == 0 else "src") for n in range(2)], None if k % 3 else 5, *["x"] * 15) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)
