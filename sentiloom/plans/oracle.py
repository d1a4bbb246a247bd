"""Building blocks for the DuckDB side of the checks."""

from __future__ import annotations

from sentiloom.functions import patterns as P


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cnt(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {q(pattern)}))"


def has(expr: str, pattern: str) -> str:
    return f"CAST(coalesce(regexp_matches({expr}, {q(pattern)}), false) AS INT)"


def sub(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(to)}, 'g')"


def present(expr: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({expr}, {q(w)}) AS INT)" for w in words) + ")"


def squeeze(expr: str) -> str:
    return f"trim({sub(expr, P.WS + '+', ' ')}, ' ')"


def toks(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, {q(P.WS + '+')}), lambda t: t <> '')"


def n_words(expr: str) -> str:
    return cnt(expr, P.NWS + "+")


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def r6(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 6)" + (f" AS {name}" if name else "")


FULL_TEXT = "coalesce(title, '') || ' ' || coalesce(content, '')"


def clean(expr: str) -> str:
    out = f"lower(coalesce({expr}, ''))"
    for pattern in (P.URL, P.EMAIL, P.AT_NAME, P.USER_PATH, P.FORUM_PATH):
        out = sub(out, pattern, "")
    return squeeze(sub(out, P.HASHTAG, r"\1"))
