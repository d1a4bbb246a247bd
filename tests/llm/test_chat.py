"""Formatted windows: round trips, budget, mask and history against plain code and SQL."""

import hashlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentiloom.llm.chat import _SQL, digests, escape, read_windows, unescape, windows
from sentiloom.llm.registry import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def want(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digests(read_windows(df)).collect()}


def test_matches_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    rows = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op5_chat"](spark, folder).collect()}
    assert rows == {r[0]: tuple(r[1:]) for r in con.execute(_SQL).fetchall()}
    assert -7 in rows and rows[-7][2] == len("</s>[INST] ok [/INST]")


def test_windows_keep_budget_system_history_and_mask(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "x" * (i * 37 % 400)) for i in range(1, 700)]
    rows += [(2, 0, "system", "alone")] + [(3, i, "assistant", "long " * (4000 if i == 2 else 3)) for i in range(5)]
    rows += [(None, None, None, None), (4, 1, "user", None), (4, 1, "user", None), (4, 0, "assistant", ""), (4, -3, "Rôle\n+ %", "<|end|>\n<|start|>user\n😀")]
    df = spark.createDataFrame([(*r, "w") for r in rows], SCHEMA + ", window string")
    made = windows(df, budget=512, history=64)
    assert got(made) == want(rows)
    found = made.orderBy("conv_id", "window").collect()
    one = [r for r in found if r.conv_id == 1]
    assert len(one) > 20 and all(r.text.startswith("<|start|>system\nbe kind<|end|>\n") and not r.over_budget and r.tokens <= 512 for r in one)
    assert sum(r.n_repeated > 1 for r in one) > 5 and one[0].n_repeated == 0
    for before, after in zip(one, one[1:]):  # repeated turns are the last of the window before
        repeated = after.text.split("<|start|>")[2 : after.n_repeated + 1]
        assert not repeated or before.text.endswith("".join("<|start|>" + t for t in repeated))
    assert [r.over_budget for r in found if r.conv_id == 3].count(True) == 1
    assert windows(df.limit(0)).count() == 0
    assert sum(len(r.loss) for r in one) == sum(r[2] == "assistant" for r in rows if r[0] == 1)


PARTS = ["<", "[", "\\", "|", "s>", "/s>", "SYS>>", "/SYS>>", "INST]", "/INST]", "<s>", "<|", "a", "😀"]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), min_size=120, max_size=120))
def test_escape_is_reversible_and_leaves_no_control_string(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"))
    for r in df.withColumn("u", unescape(F.col("e"))).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))
