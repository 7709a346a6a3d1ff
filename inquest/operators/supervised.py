"""Supervised fraud models with pyspark.ml, and their evaluation on the score curve."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquest.operators.ml_features import feature_columns, feature_frame
from inquest.operators.thresholds import metrics_at, recall_threshold, roc_points, youden_threshold
from inquest.session import cut_lineage

SEED = 42


@dataclass(frozen=True)
class BoostParams:
    """Rounds, depth, learning rate and test share of the boosted model."""

    rounds: int = 120
    depth: int = 5
    step: float = 0.08
    test_share: float = 0.25


@dataclass(frozen=True)
class ForestParams:
    """Fixed value: trees of the forest. Depth is bounded, as the library needs a bound."""

    trees: int = 300
    depth: int = 12


def check_classes(frame: DataFrame, least: int = 2) -> None:
    row = frame.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    if row["p"] < least or row["n"] < least:
        raise ValueError(f"at least {least} rows of each class are needed")


def split_by_class(frame: DataFrame, row_id: str, test_share: float, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test): a hash of the row id, drawn apart per class, so both keep the class shares."""
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("label"), F.col(row_id)), F.lit(10_000)) < int(test_share * 10_000)
    return frame.filter(~draw), frame.filter(draw)


def scored(model, frame: DataFrame, row_id: str) -> DataFrame:
    out = model.transform(frame)
    return out.select(row_id, "label", vector_to_array("probability")[1].alias("score"))


def held_scores(model, frame: DataFrame, row_id: str, held: DataFrame) -> DataFrame:
    """Scores of ``frame``, written, after which ``held`` is let go: the rows that were kept for the passes of a fit."""
    scores = cut_lineage(scored(model, frame, row_id))
    held.unpersist()
    return scores


def importances(model, columns: list[str], spark, top: int = 15) -> DataFrame:
    pairs = [(c, float(w)) for c, w in zip(columns, model.featureImportances.toArray())]
    return spark.createDataFrame(pairs, "feature string, importance double").orderBy(F.col("importance").desc(), "feature").limit(top)


def fit_boosted(df: DataFrame, target: str, row_id: str, p: BoostParams = BoostParams(), seed: int = SEED):
    """(test scores, importances) of gradient-boosted trees on all numeric columns but the target."""
    columns = feature_columns(df, (target, row_id))
    # A fit makes many passes; the features are made once, in the order and partitions that they come in.
    frame = feature_frame(df, columns, (row_id,), target).persist()
    check_classes(frame)
    train, test = split_by_class(frame, row_id, p.test_share, seed)
    model = GBTClassifier(maxIter=p.rounds, maxDepth=p.depth, stepSize=p.step, seed=seed).fit(train)
    return held_scores(model, test, row_id, frame), importances(model, columns, df.sparkSession)


def fit_forest(df: DataFrame, target: str, row_id: str, p: ForestParams = ForestParams(), seed: int = SEED):
    """(scores on the training rows, importances) of a forest with classes of equal weight."""
    columns = feature_columns(df, (target, row_id))
    # As for boosted trees: kept rows have the same partitions, so the trees draw the same samples.
    frame = feature_frame(df, columns, (row_id,), target).persist()
    check_classes(frame)
    shares = frame.groupBy("label").agg(F.count("*").alias("_n"))
    total = frame.agg(F.count("*")).scalar()
    # Two classes, so the broadcast side has two rows.
    weighted = frame.join(F.broadcast(shares), "label").withColumn("_w", total / (2.0 * F.col("_n")))
    model = RandomForestClassifier(numTrees=p.trees, maxDepth=p.depth, weightCol="_w", seed=seed).fit(weighted)
    return held_scores(model, frame, row_id, frame), importances(model, columns, df.sparkSession)


def evaluate(scores: DataFrame) -> DataFrame:
    """Counts, recall, fpr, average precision and ROC area at the Youden threshold."""
    # Scores are written once: the curve reads them more than once, and a model is dear to run again.
    points = roc_points(cut_lineage(scores), "label", "score")
    return metrics_at(points, youden_threshold(points).select("threshold").scalar())


def choose_threshold(scores: DataFrame, objective: str = "youden") -> DataFrame:
    points = roc_points(cut_lineage(scores), "label", "score")
    return recall_threshold(points) if objective.startswith("min_fpr_at_recall") else youden_threshold(points)
