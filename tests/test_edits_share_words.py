"""The four edits of a text share one list of its words; each split the text for itself before."""

from pyspark.sql import functions as F

from sentiloom.operators import augment as A
from sentiloom.plans import catalog  # noqa: F401
from sentiloom.plans.registry import CATALOG


def test_texts_are_split_once(spark):
    plan = CATALOG["text_edits"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_ready_made_words_change_nothing(spark):
    rows = [("a", "good news  about the bad market today and a big gain"), ("b", "one two"), ("c", ""), ("d", None)]
    df = spark.createDataFrame(rows, "post_id string, t string").withColumn("w", A.words_of(F.col("t")))
    for edit in (A.synonym_replacement, A.random_insertion, A.random_swap, A.random_deletion):
        got = df.select(edit(F.col("t"), ["post_id"]).alias("x"), edit(F.col("t"), ["post_id"], words=F.col("w")).alias("y")).collect()
        assert all(r.x == r.y for r in got)
