import numpy as np
import pytest
from pyspark.sql import functions as F

from inquest.operators import anomaly as I
from inquest.operators import ml_features as M
from inquest.operators import supervised as V
from inquest.operators import thresholds as T


@pytest.fixture(scope="module")
def cloud(spark):
    """A dense cloud with a few far points, whose ids are 1000 and more."""
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (1000, 2)))]
    rows += [(1000 + i, 12.0 + i, -11.0) for i in range(10)]
    return spark.createDataFrame(rows, "id long, a double, b double")


def test_far_points_score_lowest(cloud):
    out = I.isolation_scan(cloud, ["a", "b"], contamination=0.02, n_trees=40)
    low = {r.id for r in out.orderBy("if_score").limit(10).collect()}
    assert low == set(range(1000, 1010))
    flagged = out.filter("is_anomaly").count()
    assert 15 <= flagged <= 25


def test_mean_path():
    assert I.mean_path(1) == 0 and I.mean_path(2) == 1
    assert I.mean_path(256) == pytest.approx(10.24, abs=0.02)


def curve(spark, rows):
    return T.roc_points(spark.createDataFrame(rows, "y int, s double"), "y", "s")


def test_thresholds_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(y), float(np.round(np.clip(0.3 * y + rng.random() * 0.7, 0, 1), 2))) for y in rng.integers(0, 2, 300)]
    y, s = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    cuts = sorted(set(s), reverse=True)[:-1]
    tpr = [((s >= c) & (y == 1)).sum() / (y == 1).sum() for c in cuts]
    fpr = [((s >= c) & (y == 0)).sum() / (y == 0).sum() for c in cuts]
    points = curve(spark, rows)
    best = int(np.argmax(np.array(tpr) - np.array(fpr)))
    assert T.youden_threshold(points).first().threshold == cuts[best]
    ok = [i for i, t in enumerate(tpr) if t >= 0.8]
    assert T.recall_threshold(points).first().threshold == cuts[min(ok, key=lambda i: fpr[i])]
    m = T.metrics_at(points, 0.5).first()
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert m.roc_auc == pytest.approx(auc) and m.tp == int(((s >= 0.5) & (y == 1)).sum())


def test_recall_rule_falls_back(spark):
    points = curve(spark, [(1, 0.1), (1, 0.9), (0, 0.5), (0, 0.4)])
    assert T.recall_threshold(points).first().threshold == T.youden_threshold(points).first().threshold == 0.9


def test_split_keeps_class_shares_and_boosting_learns(spark):
    df = spark.range(1200).select("id", (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 7 > 4, "fraud").otherwise("ok").alias("y"))
    scores, top = V.fit_boosted(df, "y", "id", V.BoostParams(rounds=3))
    row = V.evaluate(scores).first()
    assert row.roc_auc > 0.99 and top.first().feature == "x"
    with pytest.raises(ValueError):
        V.fit_boosted(df.withColumn("y", F.lit("ok")), "y", "id")


def test_fingerprint_ignores_order(spark):
    df = spark.range(50).withColumn("k", F.col("id") * 3)
    a, b = (M.dataset_fingerprint(d, ["id", "k"]).first() for d in (df, df.orderBy(F.desc("id"))))
    assert a == b
    assert M.dataset_fingerprint(df.withColumn("k", F.col("k") + 1), ["id", "k"]).first().row_digest != a.row_digest


@pytest.mark.parametrize("fit", [lambda df: V.fit_forest(df, "y", "id", V.ForestParams(trees=3, depth=3)), lambda df: V.fit_boosted(df, "y", "id", V.BoostParams(rounds=2))])
def test_a_fit_makes_its_features_once(spark, fit):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def feature(i):
        made.add(1)
        return float(i % 7)

    df = spark.range(0, 400, 1, 3).select("id", (F.col("id") % 2).alias("y")).withColumn("x", feature.asNondeterministic()("id"))
    scores, _ = fit(df)
    scores.count()
    assert made.value == 400
