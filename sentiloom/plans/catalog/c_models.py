"""Model training, ensembles, explanation and scoring over the whole tables."""

import numpy as np
from pyspark.sql import functions as F

from sentiloom.functions import sentiment as S
from sentiloom.lexicons import PRODUCTION_43
from sentiloom.models import classifiers as C
from sentiloom.models import explain as X
from sentiloom.models.scorer import scorer_udf
from sentiloom.models.tuning import hyperparameter_search
from sentiloom.operators import evaluation as E
from sentiloom.operators import frames
from sentiloom.operators import voting as V
from sentiloom.operators.sampling import stratified_split
from sentiloom.plans.catalog.c_text import r6
from sentiloom.plans.features import process_posts, production_features
from sentiloom.plans.registry import query
from sentiloom.session import measured, scratch_path

NUMERIC = PRODUCTION_43


def training(v, numeric: bool = True, text: bool = True):
    """Posts with heuristic label and split, their texts for text models and the production features for numeric ones (each form written once)."""
    name = f"_training_{numeric}_{text}"
    if name not in v._made:
        t = (v.cleaned if text else v.texts).select("post_id", "full_text", *(["cleaned_text"] if text else []), "score", "upvote_ratio", "num_comments")
        rows = (production_features(t, "full_text") if numeric else t).withColumn("auto_label_id", S.heuristic_label(F.col("full_text")))
        rows = rows.select("post_id", *(["full_text", "cleaned_text"] if text else []), "auto_label_id", *(NUMERIC if numeric else []))
        v._made[name] = stratified_split(measured(rows, "training"), "auto_label_id")
    return v._made[name]


def part(v, *names, numeric: bool = True, text: bool = True):
    return training(v, numeric, text).filter(F.col("split").isin(*names)).drop("split")


def text_part(v, *names):
    return part(v, *names, numeric=False)


def numeric_part(v, *names):
    """For models that read no text: none is cleaned, written or read again."""
    return part(v, *names, text=False)


def baseline(v, **kw):
    return C.Baseline(text_col="cleaned_text", **kw)


def boosted(v, **kw):
    return C.Boosted(features=NUMERIC, **kw)


def scored_rows(scored):
    return scored.select("post_id", F.col("auto_label_id").alias("y_true"), F.col("label_id").alias("y_pred"), *C.PROBS)


@query("baseline_classifier")
def _baseline_classifier(v):
    model = baseline(v).fit(text_part(v, "train"))
    return scored_rows(model.transform(text_part(v, "test"))).select("post_id", "y_true", "y_pred", *r6(*C.PROBS))


@query("boosted_classifier")
def _boosted_classifier(v):
    model = boosted(v).fit_cv(numeric_part(v, "train"))
    return scored_rows(model.transform(numeric_part(v, "test"))).select("post_id", "y_true", "y_pred", *r6(*C.PROBS))


_TRAIN = """(SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY l.auto_label_id ORDER BY md5('42|' || p.post_id), p.post_id) AS r,
 floor(count(*) OVER (PARTITION BY l.auto_label_id) * 0.15 + 0.5) AS cut FROM posts p JOIN labeled l USING (post_id)) x WHERE r > 2 * cut) tr"""


@query("impute_mean", f"""
SELECT post_id, round(coalesce(upvote_ratio, (SELECT avg(upvote_ratio) FROM {_TRAIN})), 6) AS upvote_ratio FROM posts""", "posts labeled")
def _impute_mean(v):
    rows = v.posts.select("post_id", "upvote_ratio").join(v.labeled.select("post_id", "auto_label_id"), "post_id")
    train = stratified_split(rows, "auto_label_id").filter("split = 'train'")
    return C.impute_mean(train, ["upvote_ratio"]).transform(rows).select("post_id", *r6("upvote_ratio"))


@query("feature_importance")
def _feature_importance(v):
    return C.feature_importance(v.spark, boosted(v).fit(numeric_part(v, "train")))


@query("top_features")
def _top_features(v):
    return C.top_features(C.feature_importance(v.spark, boosted(v).fit(numeric_part(v, "train"))), 5)


@query("top_terms_per_class")
def _top_terms_per_class(v):
    return C.top_terms_per_class(v.spark, baseline(v).fit(text_part(v, "train")), 20)


@query("stacking")
def _stacking(v):
    train = part(v, "train")
    models = {"baseline": baseline(v).fit(train), "boosted": boosted(v).fit(train)}
    return scored_rows(C.Stacked(models).fit(part(v, "val")).transform(part(v, "test")))


@query("oof_stacking")
def _oof_stacking(v):
    """Both meta-models over the same out-of-fold scores."""
    makers = {"baseline": lambda: baseline(v), "boosted": lambda: boosted(v)}
    first = C.oof_stacking(part(v, "train").drop("full_text"), makers)  # no base model reads it
    out = None
    for meta in ("boosted", "logistic"):
        model = first if meta == first.meta_type else C.Stacked(first.models, meta_type=meta).fit_meta(first.held)
        scored = scored_rows(model.transform(part(v, "test"))).withColumn("meta_model", F.lit(meta))
        out = scored if out is None else out.unionByName(scored)
    return out


@query("bootstrap_uncertainty")
def _bootstrap_uncertainty(v):
    return V.ensemble_uncertainty(C.bootstrap_scores(numeric_part(v, "train"), numeric_part(v, "test"), NUMERIC))


@query("train_eval")
def _train_eval(v):
    model = baseline(v).fit(text_part(v, "train"))
    rows = scored_rows(model.transform(text_part(v, "val", "test"))).withColumn("model", F.lit("baseline"))
    sizes = training(v, numeric=False).groupBy("split").agg(F.count(F.lit(1)).cast("double").alias("n"))
    metrics = E.all_metrics(rows, ["model"]).drop("model", "support")
    flat = metrics.select(F.explode(F.create_map(*[x for c in metrics.columns for x in (F.lit(c), F.col(c))])).alias("name", "value"))
    return flat.unionByName(sizes.select(F.concat(F.col("split"), F.lit("_size")).alias("name"), F.col("n").alias("value")))


@query("hyperparameter_search")
def _hyperparameter_search(v):
    return hyperparameter_search(numeric_part(v, "train"), NUMERIC)


@query("linear_contributions")
def _linear_contributions(v):
    model = X.fit_linear(numeric_part(v, "train"), NUMERIC)
    return X.global_contributions(X.linear_contributions(numeric_part(v, "test"), model, NUMERIC, 2))


@query("top_contributions")
def _top_contributions(v):
    model = X.fit_linear(numeric_part(v, "train"), NUMERIC)
    return X.top_contributions(X.linear_contributions(numeric_part(v, "test"), model, NUMERIC, 2), 5)


@query("permutation_importance")
def _permutation_importance(v):
    model = X.fit_linear(numeric_part(v, "train"), NUMERIC)

    def score(df):
        return model.transform(C.as_double(df, NUMERIC)).withColumn("label_id", F.col("prediction").cast("int"))

    return X.permutation_importance(numeric_part(v, "test"), score, NUMERIC)


@query("batch_score")
def _batch_score(v):
    model = baseline(v).fit(part(v, "train"))
    return C.batch_score(model, training(v).drop("split"), features=NUMERIC[:10]).select(
        "post_id", "prediction", *r6("confidence", *C.PROBS), "confidence_level", "reason",
        *[F.round(F.col("features")[c], 6).alias(f"feature_{c}") for c in NUMERIC[:10]])


@query("save_load_model")
def _save_load_model(v):
    path = scratch_path(v.spark, "baseline-model")
    model = baseline(v).fit(text_part(v, "train"))
    model.save(path)
    again = C.Baseline.load(path)
    before = model.transform(text_part(v, "test")).select("post_id", *C.PROBS)
    after = again.transform(text_part(v, "test")).select("post_id", *[F.col(p).alias(f"again_{p}") for p in C.PROBS])
    gap = F.greatest(*[F.abs(F.col(p) - F.col(f"again_{p}")) for p in C.PROBS])
    return before.join(after, "post_id").agg(F.count(F.lit(1)).alias("rows"), F.max(gap).alias("largest_gap"))


@query("topics")
def _topics(v):
    from sentiloom.models.topics import topics

    return topics(v.cleaned.select("post_id", "cleaned_text"), "cleaned_text")


@query("model_interface")
def _model_interface(v):
    """Both classifiers through the same fit/transform contract."""
    out = None
    for name, model in (("baseline", baseline(v)), ("boosted", boosted(v))):
        scored = model.fit(part(v, "train")).transform(part(v, "test"))
        total = sum((F.col(p) for p in C.PROBS), F.lit(0.0))
        row = scored.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("rows"),
                         F.max(F.abs(total - 1)).alias("probability_gap"), F.max("label_id").alias("largest_label"))
        out = row if out is None else out.unionByName(row)
    return out


def upper_case_scorer():
    """Tiny stand-in scorer: more upper-case letters, more positive."""

    def predict(texts):
        share = np.array([sum(ch.isupper() for ch in t) / (len(t) + 1) for t in texts]).reshape(-1, 1)
        return np.hstack([0.5 * (1 - share), 0.5 * np.ones_like(share), 0.5 * share])

    return predict


@query("scorer_udf", """
SELECT post_id, round(0.5 * (1 - share), 6) AS p_negative, round(0.5 * share, 6) AS p_positive
FROM (SELECT post_id, len(regexp_extract_all(coalesce(title, '') || ' ' || coalesce(content, ''), '\\p{Lu}'))::DOUBLE
 / (length(coalesce(title, '') || ' ' || coalesce(content, '')) + 1) AS share FROM posts) x""", "posts")
def _scorer_udf(v):
    score = scorer_udf(upper_case_scorer)
    out = v.texts.select("post_id", score("full_text").alias("p"))
    return out.select("post_id", F.round(F.col("p")[0], 6).alias("p_negative"), F.round(F.col("p")[2], 6).alias("p_positive"))
