"""Models that read numbers only get training rows without texts: none is cleaned, written or read again."""

import pytest

from sentiloom.functions import patterns as P
from sentiloom.plans.catalog import c_models
from sentiloom.plans.registry import CATALOG

SMALL = "/root/testdata/sf0.001"


class Stop(Exception):
    pass


@pytest.mark.parametrize("name", ["top_contributions", "linear_contributions", "bootstrap_uncertainty", "permutation_importance", "boosted_classifier"])
def test_no_text_is_written(spark, monkeypatch, capsys, name):
    def stop(df, _):
        df.explain(True)
        raise Stop(df.columns)

    monkeypatch.setattr(c_models, "measured", stop)
    with pytest.raises(Stop) as stopped:
        CATALOG[name](spark, SMALL)
    assert stopped.value.args[0] == ["post_id", "auto_label_id", *c_models.NUMERIC]
    assert P.URL not in capsys.readouterr().out


def test_the_rows_are_the_same(views):
    names = ["post_id", "auto_label_id", "split", *c_models.NUMERIC]
    slim, whole = (c_models.training(views, text=text).select(names).orderBy("post_id").collect() for text in (False, True))
    assert slim == whole and len(slim) > 50
