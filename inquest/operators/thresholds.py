"""Score thresholds: ROC points and the two ways to choose one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquest.operators.keyed import running_total

BANDS = 1024
# Recall that must be reached, and the guard against empty sums.
MIN_RECALL = 0.8
EPS = 1e-9


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg, cum_pos, cum_neg, tpr, fpr): one row per distinct score, taken as threshold.

    Rows are counted per score first. The running totals go band by band; bands hold
    about as many scores each, wherever those lie, so no task has to hold the whole curve.
    """
    per = df.groupBy(F.col(score).try_cast("double").alias("score")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) != 1).cast("long")).alias("neg")
    ).filter("score IS NOT NULL")
    span = per.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("s")).scalar()
    # The cuts, ``BANDS`` numbers at most, become constants: both uses of the band must agree on them.
    marks = F.array(*[F.lit(i / BANDS) for i in range(1, BANDS)])
    cuts = sorted(set(per.agg(F.percentile_approx("score", marks, F.lit(10 * BANDS))).first()[0] or []))
    band = F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c < F.col("score")))
    curve = running_total(per, "score", ["pos", "neg"], band)
    return curve.withColumns({"tpr": F.col("cum_pos") / span["p"], "fpr": F.col("cum_neg") / span["n"]})


def _inner(points: DataFrame) -> DataFrame:
    """All points but the last, where everything is called positive."""
    lowest = points.agg(F.min("score")).scalar()
    return points.filter(F.col("score") > lowest)


def youden_threshold(points: DataFrame) -> DataFrame:
    """One row: threshold with the greatest tpr - fpr; of equal ones the highest."""
    best = F.max(F.struct((F.col("tpr") - F.col("fpr")).alias("j"), "score", "tpr", "fpr")).alias("b")
    return _inner(points).agg(best).select(F.col("b.score").alias("threshold"), "b.tpr", "b.fpr")


def recall_threshold(points: DataFrame, min_recall: float = MIN_RECALL) -> DataFrame:
    """One row: least fpr with enough recall, of equal ones the highest threshold; else the other rule."""
    ok = F.col("tpr") >= min_recall
    first = F.min(F.when(ok, F.struct("fpr", (-F.col("score")).alias("neg"), "tpr", "score"))).alias("a")
    second = F.max(F.struct((F.col("tpr") - F.col("fpr")).alias("j"), "score", "tpr", "fpr")).alias("b")
    both = _inner(points).agg(first, second)
    return both.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias("threshold" if c == "score" else c) for c in ("score", "tpr", "fpr")])


def metrics_at(points: DataFrame, threshold) -> DataFrame:
    """One row: counts, recall and fpr at a threshold, with average precision and area under the ROC.

    ``threshold`` is a number or a scalar subquery. All figures come from the curve.
    """
    t = threshold if not isinstance(threshold, (int, float)) else F.lit(float(threshold))
    total = points.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("s")).scalar()
    chosen = F.col("score") >= t
    # A step of the precision curve, and pairs ordered right with ties as half.
    step = F.col("pos") / total["p"] * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    ordered = F.col("pos") * ((total["n"] - F.col("cum_neg")) + F.col("neg") / 2)
    out = points.agg(
        F.sum(F.when(chosen, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(chosen, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~chosen, F.col("neg")).otherwise(0)).alias("tn"), F.sum(F.when(~chosen, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(step).alias("pr_auc"), (F.sum(ordered) / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"),
    )
    return out.withColumns({"recall": F.col("tp") / (F.col("tp") + F.col("fn") + EPS), "fpr": F.col("fp") / (F.col("fp") + F.col("tn") + EPS)})
