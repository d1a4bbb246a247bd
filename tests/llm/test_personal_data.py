"""Spans against Python's own regular expressions and plain checksum code."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sentiloom.llm.personal_data import KINDS, joined, personal_data

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def brute(text):
    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if valid(kind, m.group())]
    return ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(found))


def base_spans(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from pyspark.sql import functions as F
    got = personal_data(rows).select("doc_id", joined(F.filter("pii", lambda s: s["order"] < 4)).alias("s"), joined(F.col("pii")).alias("all")).collect()
    return {r.doc_id: (r.s, r.all) for r in got}


HARD = [
    None, "", "a@b.c_d@e.f", "x..y@a.b-c.d@q.r", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.04 0001.2.3.4", "4785380592391139$$$ 4785 3805 9239-1139",
    "4785380592391138", "+1 (743) 555-3824 éè +12345678901234567 +1 2 3", "😀 mail me at joe@x.io 😀 +44 20 7946 0958.", "+4111111111111111 ",
    "a" * 50_000, "1" * 50_000, "1 " * 20_000, "+1" + " " * 20_000, "9.9" * 10_000, "a@" * 10_000, "1.2.3.4 " * 5_000,
    "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, GB82WEST12345698765433", "@@@...+++---", "card\n4111 1111\n1111 1111",
]


def test_hard_texts(spark):
    got = base_spans(spark, HARD)
    for i, text in enumerate(HARD):
        assert got[i][0] == brute(text), (text or "")[:60]
    assert got[18][1].count("iban") == 2


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="01259 .-+@()aZ_é😀\n", max_size=60), min_size=40, max_size=40))
def test_random_texts(spark, texts):
    got = base_spans(spark, texts)
    assert [got[i][0] for i in range(len(texts))] == [brute(t) for t in texts]


def test_accounts_before_upper_case_words(spark):
    german, british = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    texts = [f"IBAN {german} BIC COBADEFFXXX", "DE89370400440532013000 EUR 500", f"{german} {german} {british} OK", f"AB12 {german}", f"BE12 {german} X",
             f"é😀 {british} " * 300, german[:-1] + "1 EUR", "DE89370400440532013000X", ("AB12 " + german + " ") * 200]
    found = base_spans(spark, texts)
    spans = [[tuple(map(int, x.split(":")[1:])) for x in found[i][1].split(",") if x.startswith("iban")] for i in range(len(texts))]
    assert [[texts[i][a:b] for a, b in spans[i]] for i in range(len(texts))] == [
        [german], ["DE89370400440532013000"], [german, german, british], [german], [german], [british] * 300, [], [], [german] * 200]


def test_documents_and_schema(spark):
    from sentiloom.llm.registry import QUERIES
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op10_personal_data"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(want.count(f"{k}:") for k, _ in PATTERNS)


def test_context_raises_score(spark):
    rows = spark.createDataFrame([(1, "pay by credit card 4111111111111111 now", None), (2, "zzz 4111111111111111 zzz", "p")], "doc_id long, text string, pii string")
    scores = {r.doc_id: r.pii[0].score for r in personal_data(rows).collect()}
    assert scores[1] > scores[2]
    assert personal_data(rows.limit(0)).count() == 0
    assert len(KINDS) == 5
