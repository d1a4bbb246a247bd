"""Characters, words, sentence ends and vowel groups of a text, counted together in Arrow batches.

A regex per character class goes over the text once per class; here each character gets the number of its class and all counts are taken
from those.  The classes are those of :mod:`sentiloom.functions.patterns`.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKS = ["words", "uppercase", "lowercase", "digits", "spaces", "exclamations", "questions", "commas", "periods", "ends", "vowel_groups"]

#: Class numbers.  Vowels stand at the beginning and sentence ends last, so that a comparison finds them; a dotted capital I is an i and a
#: mark in lower case, so the group it begins ends with it.
_LOW_VOWEL, _VOWEL, _DOTTED, _LOW, _UP, _DIGIT, _SPACE, _COMMA, _OTHER, _EXCLAMATION, _QUESTION, _PERIOD = range(12)
_PATTERNS = {
    _LOW: "[a-z]", _UP: "[A-Z]", _LOW_VOWEL: "[aeiouy]", _VOWEL: "[AEIOUY]", _DOTTED: "İ", _DIGIT: r"\d", _SPACE: r"\s", _COMMA: ",",
    _EXCLAMATION: "!", _QUESTION: r"\?", _PERIOD: r"\.",
}


@cache
def _classes() -> np.ndarray:
    """Class of every code point."""
    every = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    out = np.full(len(every), _OTHER, dtype=np.uint8)
    for number, pattern in _PATTERNS.items():  # vowels come after the letters they are among
        out[[found.start() for found in re.finditer(pattern, every)]] = number
    return out


@cache
def _ascii() -> bytes:
    return _classes()[:256].tobytes()


def _counts(text: bytes) -> tuple[int, ...]:
    """The counts of one UTF-8 text, in the order of ``MARKS``."""
    if not text:
        return (0,) * len(MARKS)
    if text.isascii():
        kinds = np.frombuffer(text.translate(_ascii()), np.uint8)
    else:
        kinds = _classes()[np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")]
    n = np.bincount(kinds, minlength=12).tolist()
    space, end, vowel, held = kinds == _SPACE, kinds >= _EXCLAMATION, kinds <= _DOTTED, kinds <= _VOWEL

    def runs(inside: np.ndarray, before: np.ndarray) -> int:
        return int(inside[0]) + int(np.count_nonzero(inside[1:] > before[:-1]))

    return (runs(~space, ~space), n[_UP] + n[_VOWEL], n[_LOW] + n[_LOW_VOWEL], n[_DIGIT], n[_SPACE], n[_EXCLAMATION], n[_QUESTION], n[_COMMA],
            n[_PERIOD], runs(end, end), runs(vowel, held))


def text_marks(text: Column) -> Column:
    """Struct of the counts ``MARKS``, all of them null for a null text."""

    def count(texts: pa.Array) -> pa.Array:
        values = (value.as_py() for value in texts.cast(pa.large_binary()))
        rows = [None if value is None else _counts(value) for value in values]
        columns = [pa.array([None if row is None else row[i] for row in rows], pa.int32()) for i in range(len(MARKS))]
        return pa.StructArray.from_arrays(columns, names=MARKS)

    return F.arrow_udf(count, T.StructType([T.StructField(name, T.IntegerType()) for name in MARKS]))(text)
