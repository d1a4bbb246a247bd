"""Chat formatting with budgeted windows, in DataFrame functions only.

Template: ``<|start|>role\\ntext<|end|>\\n`` per turn.  Control strings inside texts (those of this template and common foreign ones) get a
backslash after their first character; strings that already have backslashes there get one more, so the escape is reversible and an
escaped text never holds a control string.  Roles are URL-encoded.

Windows: prefix sums of turn tokens assign each turn to span floor(prefix / stride), stride = (budget - system - history) / 2.  A span
with no turn longer than the stride has less than two strides, so system turn, repeated history and span fit the budget; a
longer turn stays whole and its window is marked.  The system turn opens every window; the last turns before a span, at most
``history`` tokens of them, are repeated.  Only assistant texts at their first appearance are under the loss mask.

A long conversation is cut into blocks of turns for the prefix sums, and into windows for the texts; only the digest of a
whole conversation, which the query asks for, needs its turns in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentiloom.llm.common import table
from sentiloom.llm.registry import llm_query

BUDGET, HISTORY = 2048, 256
_TURNS = 256  # turn numbers of one block
_START, _END = "<|start|>", "<|end|>\n"
_TAIL = r"(\||/?s>|</?SYS>>|/?INST\])"
_PLAIN, _ESCAPED = rf"([<\[])(\\*){_TAIL}", rf"([<\[])\\(\\*){_TAIL}"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_PLAIN), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPED), F.lit("$1$2$3"))


def turn_tokens(text: Column) -> Column:
    """A quarter of the bytes, and four for the marks."""
    return F.ceil(F.octet_length(text) / 4).cast("long") + 4


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the left keys stay."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys]
    return left.join(right, same, how).drop(*[f"_r_{k}" for k in keys])


def _placed(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Turns with their position, whether they are the system turn, and their span and its stride."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumns({"tokens": turn_tokens(F.col("text")), "block": F.floor(F.col("turn") / _TURNS)})
    order = F.struct("turn", "role", "text")
    blocks = rows.groupBy("conv_id", "block").agg(
        F.sum("tokens").alias("sum"), F.count(F.lit(1)).alias("n"), F.min_by(F.struct("role", "tokens"), order).alias("head"))
    so_far = Window.partitionBy("conv_id").orderBy("block")
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    head = F.first("head").over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = blocks.select(
        "conv_id", "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("_tokens"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"),
        F.when(head["role"] == "system", head["tokens"]).otherwise(F.lit(0)).alias("system_tokens"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    rows = rows.withColumns({
        "_in": F.coalesce(F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_row": F.row_number().over(inside) - 1})
    rows = _join(rows, blocks, ["conv_id", "block"])
    stride = F.greatest(F.floor((F.lit(budget) - F.col("system_tokens") - history) / 2), F.lit(max(1, history)))
    return rows.withColumns({"pos": F.col("_n") + F.col("_row"), "prefix": F.col("_tokens") + F.col("_in") - F.col("system_tokens")}).select(
        "conv_id", "pos", "role", "text", "tokens", "prefix", "system_tokens", ((F.col("pos") == 0) & (F.col("role") == "system")).alias("is_system"),
        F.floor(F.col("prefix") / stride).alias("span"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) -> conv_id, window, text, n_turns, n_repeated, tokens, over_budget, loss.

    ``loss`` lists [start, end) in code points of ``text``.  Turns go by number, then role, then text; repeated rows are turns of their own.
    A null turn counts as 0, null roles and texts are empty, rows without a conv_id form one conversation.  The first turn is the system turn if
    its role is ``system``.  An empty table gives no rows; other columns are ignored.
    """
    turns = _placed(conversations, budget, history)
    body = turns.filter(~F.col("is_system"))
    in_order = Window.partitionBy("conv_id").orderBy("span")
    spans = body.groupBy("conv_id", "span").agg(F.min("prefix").alias("begin")).select(
        "conv_id", "span", F.row_number().over(in_order).alias("window"), F.lead("begin").over(in_order).alias("next_begin"))
    body = _join(body, spans, ["conv_id", "span"])
    again = F.coalesce(F.col("next_begin") - F.col("prefix") <= history, F.lit(False))
    uses = F.filter(F.array(F.struct("window", F.lit(False).alias("again"), F.lit(True).alias("keep")),
                            F.struct((F.col("window") + 1).alias("window"), F.lit(True).alias("again"), again.alias("keep"))), lambda x: x["keep"])
    used = body.withColumn("use", F.explode(uses)).select("conv_id", "use.window", F.struct("pos", "use.again", "role", "text", "tokens").alias("turn"))
    packed = used.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    system = turns.filter("is_system").select("conv_id", F.struct("pos", F.lit(True).alias("again"), "role", "text", "tokens").alias("first"))
    system = system.withColumnRenamed("conv_id", "_conv").withColumn("_present", F.lit(True))
    # a conversation of a system turn alone is a window too
    packed = packed.withColumn("_body", F.lit(True)).join(system, packed["conv_id"].eqNullSafe(system["_conv"]), "full").withColumns({
        "conv_id": F.when(F.col("_body").isNotNull(), F.col("conv_id")).otherwise(F.col("_conv")),
        "window": F.coalesce("window", F.lit(1)), "turns": F.coalesce("turns", F.array().cast("array<struct<pos:bigint,again:boolean,role:string,text:string,tokens:bigint>>"))})
    opened = F.when(F.col("_present").isNotNull(), F.concat(F.array(F.struct(
        F.col("first.pos").alias("pos"), (F.col("window") > 1).alias("again"), F.col("first.role").alias("role"), F.col("first.text").alias("text"),
        F.col("first.tokens").alias("tokens"))), F.col("turns"))).otherwise(F.col("turns"))
    pieces = F.transform(opened, lambda t: F.struct(
        F.concat(F.lit(_START), F.url_encode(t["role"]), F.lit("\n")).alias("open"), escape(t["text"]).alias("body"),
        (~t["again"] & (t["role"] == "assistant")).alias("target"), t["again"].alias("again"), t["tokens"].alias("tokens")))
    out = packed.select("conv_id", "window", pieces.alias("pieces"))

    def place(done: Column, piece: Column) -> Column:
        start = done["at"] + F.length(piece["open"])
        end = start + F.length(piece["body"])
        span = F.when(piece["target"], F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((end + len(_END)).alias("at"), F.concat(done["loss"], span).alias("loss"))

    tokens = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["tokens"])
    return out.select(
        "conv_id", "window", F.array_join(F.transform("pieces", lambda p: F.concat(p["open"], p["body"], F.lit(_END))), "").alias("text"),
        F.size("pieces").cast("long").alias("n_turns"), F.size(F.filter("pieces", lambda p: p["again"])).cast("long").alias("n_repeated"),
        tokens.alias("tokens"), (tokens > budget).alias("over_budget"),
        F.aggregate("pieces", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss")), place)["loss"].alias("loss"))


def read_windows(formatted: DataFrame) -> DataFrame:
    """Back from formatted windows: conv_id, window, turns (role, text; repeated ones left out) and the texts under the loss mask."""
    marked = F.slice(F.split("text", r"<\|start\|>", -1), F.col("n_repeated").cast("int") + 2, F.col("n_turns").cast("int"))

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        return F.struct(F.url_decode(role).alias("role"), unescape(
            F.substring(x, F.length(role) + 2, F.length(x) - F.length(role) - 1 - len(_END))).alias("text"))

    return formatted.select("conv_id", "window", F.length("text").cast("long").alias("chars"), F.transform(marked, turn).alias("turns"), F.transform(
        "loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))).alias("targets"))


def digests(read: DataFrame) -> DataFrame:
    """Per conversation: counts and digests of its turns and of the texts under the mask, joined in window order."""
    parts = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "window", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("targets", "").alias("loss")))).alias("parts"), F.sum(F.size("turns")).alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    turns = F.array_join(F.transform("parts", lambda p: p["turns"]), "")
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return parts.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table and conversation -7, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
 SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256 FROM g
"""


@llm_query("op5_chat")
def op5_chat(spark, folder):
    return digests(read_windows(windows(with_probe(table(spark, folder, "conversations")))))
