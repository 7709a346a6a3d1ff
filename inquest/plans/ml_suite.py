"""Anomaly and supervised models over document features and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from inquest.operators import anomaly as I
from inquest.operators import ml_features as M
from inquest.operators import supervised as V
from inquest.plans.registry import query

LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("ml_select_features", "SELECT doc_id, toxic AS label, 4 AS n_features FROM v_features", ("v_features",))
def _(t):
    columns = M.feature_columns(t.v_features, ("toxic", "doc_id"))
    frame = M.feature_frame(t.v_features, columns, ("doc_id",), "toxic")
    from pyspark.ml.functions import vector_to_array

    return frame.select("doc_id", "label", F.size(vector_to_array("features")).alias("n_features"))


@query("ml_sample")
def _(t):
    return M.sample_rows(t.lineitem, 1000).select("l_orderkey", "l_linenumber")


def _scan(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *LINE_FEATURES)
    return I.isolation_scan(rows, LINE_FEATURES)


@query("ml_isolation_forest")
def _(t):
    return _scan(t).select("l_orderkey", "l_linenumber", "l_partkey", "if_score", "is_anomaly")


@query("bottomk_anomalies")
def _(t):
    return _scan(t).orderBy("if_score", "l_orderkey", "l_linenumber").limit(25)


@query("ml_contamination_cv")
def _(t):
    return I.contamination_cv(t.v_features.select("doc_id", "n_chars", "n_spaces", "n_stops"), ["n_chars", "n_spaces", "n_stops"], "doc_id")


@query("ml_gbt_fraud")
def _(t):
    scores, _top = V.fit_boosted(t.v_features, "quality", "doc_id")
    return V.evaluate(scores)


@query("ml_random_forest")
def _(t):
    scores, _top = V.fit_forest(t.v_features, "quality", "doc_id")
    return V.choose_threshold(scores, "min_fpr_at_recall")
