"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust a score.

Everything is a row-local expression: no shuffle, no Python on the executors.  ``split`` and ``regexp_extract_all`` of one
pattern give the texts between and within its matches; running sums of their lengths (in code points) give the offsets.  The
sums run in blocks, so a text with very many matches costs little more than linear time.  All repetitions are possessive
and starts inside a run are barred unless a match has just ended there, which changes no match but keeps the scan linear
and the regex engine's stack flat on very long runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiloom.llm.common import table
from sentiloom.llm.registry import llm_query

_BLOCK = 128
_NEAR = 40  # code points of context on either side


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: str  # a cheap pattern that every text with a match has
    score: float
    context: str  # words nearby that raise the score
    taken: int | None = None  # code points the pattern consumes when the match is its first group, a lookahead


KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, "mail|contact|write|@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", 0.6, r"\bip\b|address|server|host|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", 0.8, "card|visa|credit|payment|cvv|expir"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, "phone|call|tel|mobile|fax|contact"),
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9]))[A-Z]{2}", r"[A-Z]{2}[0-9]{2}", 0.9,
         "iban|account|bank|transfer", taken=2),
]

#: Lengths of account numbers by country, of the register to ISO 13616.
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 "
    "GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 "
    "MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 "
    "UA29 VA22 VG24 XK20 YE30").split()}
BASE = 4  # the first four kinds are the base spans


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's sum is a multiple of ten (for at most 19 digits)."""
    def at(text, i):
        return F.substring(text, i, F.lit(1)).cast("int")

    return _let(F.struct(F.reverse(digits).alias("d"), F.translate(F.reverse(digits), "0123456789", "0246813579").alias("twice")), lambda x: F.aggregate(
        F.sequence(F.lit(1), F.length(x["d"])), F.lit(0),
        lambda total, i: total + F.when(i % 2 == 1, at(x["d"], i)).otherwise(at(x["twice"], i))) % 10 == 0)


def _mod97(text: Column) -> Column:
    """Remainder of an account number by the rule of ISO 7064 is one."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    return _let(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), lambda moved: F.aggregate(
        F.sequence(F.lit(1), F.length(moved)), F.lit(0),
        lambda rest, i: _let(F.ascii(F.substring(moved, i, F.lit(1))), lambda c: F.when(c <= 57, (rest * 10 + c - 48) % 97)
                             .otherwise((rest * 100 + c - 55) % 97))) == 1)


def _account(proposed: Column) -> Column:
    """The longest prefix of whole tokens that is an account number, null without one.

    A country of the register sets the length; any other has 15 to 34 characters.
    """
    lengths = F.create_map(*[F.lit(x) for pair in sorted(IBAN_LENGTHS.items()) for x in pair])
    size, due = F.length(proposed), F.try_element_at(lengths, F.substring(proposed, 1, 2))
    ends = F.filter(F.sequence(F.lit(15), F.greatest(size, F.lit(15))), lambda i: (i <= size) & F.substring(proposed, i + 1, F.lit(1)).isin("", " "))
    prefixes = F.filter(F.transform(ends, lambda i: F.substring(proposed, F.lit(1), i)), lambda p: _let(
        F.length(F.replace(p, F.lit(" "), F.lit(""))), lambda n: F.when(due.isNull(), n.between(15, 34)).otherwise(n == due)) & _mod97(p))
    return _let(prefixes, lambda p: F.get(p, F.size(p) - 1))


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return F.regexp_like(match, F.lit(rf"^(?:{part}\.){{3}}{part}$"))
    if kind == "card":
        return _let(_digits(match), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return match.isNotNull()
    return F.lit(True)


_SPAN = "struct<start:bigint,order:int,end:bigint,match:string,score:double>"
_NONE = f"array<{_SPAN}>"


def _spans(text: Column, order: int, kind: Kind) -> Column:
    """Confirmed spans of one kind, in order."""
    between = F.split(text, kind.pattern, -1)
    within = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0 if kind.taken is None else 1))

    def step(done: Column, item: Column) -> Column:
        if kind.taken is None:
            return added(done, item, item["match"], item["after"])
        # proposals may overlap: only the start is consumed, so one that fails hides no later one
        return _let(_account(item["match"]), lambda m: added(done, item, m, F.substring(item["after"], F.length(m) - kind.taken + 1, F.lit(_NEAR))))

    def added(done: Column, item: Column, match: Column, after: Column) -> Column:
        start = done["pos"] + F.length(item["before"])
        end = start + F.length(match)
        near = F.lower(F.concat(F.substring(item["before"], -_NEAR, _NEAR), F.lit(" "), F.substring(after, 1, _NEAR)))
        score = F.lit(kind.score) + F.when(F.regexp_like(near, F.lit(kind.context)), F.lit(0.2)).otherwise(F.lit(0.0))
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), match.alias("match"),
                        F.least(score, F.lit(1.0)).alias("score")).cast(_SPAN)
        valid = _valid(kind.name, match)
        if kind.taken is None:
            pos, until = end, done["until"]
        else:
            valid = valid & (start >= done["until"])
            pos, until = start + kind.taken, F.when(valid, end).otherwise(done["until"])
        kept = F.when(valid, F.array(span)).otherwise(F.array().cast(_NONE))
        return F.struct(pos.alias("pos"), until.alias("until"), F.concat(done["out"], kept).alias("out"))

    def run(parts: Column) -> Column:
        n = F.size(parts["within"])

        def block(done: Column, first: Column) -> Column:
            items = F.transform(F.slice(parts["within"], first, F.lit(_BLOCK)), lambda m, i: F.struct(
                F.get(parts["between"], first + i - 1).alias("before"), m.alias("match"), F.get(parts["between"], first + i).alias("after")))
            return _let(F.aggregate(items, F.struct(done["pos"].alias("pos"), done["until"].alias("until"), F.array().cast(_NONE).alias("out")), step),
                        lambda r: F.struct(r["pos"].alias("pos"), r["until"].alias("until"), F.concat(done["blocks"], F.array(r["out"])).alias("blocks")))

        start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("until"), F.array().cast(f"array<{_NONE}>").alias("blocks"))
        return F.when(n > 0, F.flatten(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(_BLOCK)), start, block)["blocks"])
                      ).otherwise(F.array().cast(_NONE))

    return F.when(F.regexp_like(text, F.lit(kind.gate)),
                  _let(F.struct(between.alias("between"), within.alias("within")), run)).otherwise(F.array().cast(_NONE))


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: array of (start, order, end, match, score), sorted by start, then kind.

    Offsets are code points, end exclusive; ``order`` indexes ``KINDS``.  Spans of different kinds may overlap.  A null text counts
    as empty and has no spans; every other column, null or not, is carried along (one named ``pii`` is replaced).
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumn("pii", F.array_sort(F.concat(*[_spans(body, i, kind) for i, kind in enumerate(KINDS)])))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(order: int) -> Column:
    return F.size(F.filter("pii", lambda s: s["order"] == order)).cast("bigint")


@llm_query("op10_personal_data")
def op10_personal_data(spark, folder):
    found = personal_data(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "pii")
    counts = [_count(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS)]
    base = joined(F.filter("pii", lambda s: s["order"] < BASE))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"),
                        F.transform("pii", lambda s: s["score"]).alias("scores"))
