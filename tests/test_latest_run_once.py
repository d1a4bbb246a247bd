"""The runs of read_latest_file are dealt out once, not once per run."""

from sentiloom.plans import catalog  # noqa: F401
from sentiloom.plans.registry import CATALOG

SMALL = "/root/testdata/sf0.001"


def _shuffled(spark):
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_posts_are_shuffled_once(spark, views):
    posts, before = views.posts.count(), _shuffled(spark)
    rows = CATALOG["read_latest_file"](spark, SMALL)
    assert _shuffled(spark) - before < 1.5 * posts  # two shuffles of them before
    assert rows.count() == posts and [r.run for r in rows.select("run").distinct().collect()] == ["second"]
