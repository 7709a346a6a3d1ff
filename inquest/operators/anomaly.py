"""Isolation forest (Liu, Ting and Zhou, 2008) on Spark: trees grown per group, rows scored where they lie."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquest.operators.keyed import quantile_by_key
from inquest.session import cut_lineage

# Trees, rows per tree, share of anomalies, seed.
N_TREES = 200
ROWS_PER_TREE = 256
CONTAMINATION = 0.02
SEED = 42
EULER = 0.5772156649015329

TREE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, size int, depth int"


def mean_path(n: float) -> float:
    """Mean depth at which a search in a random tree of ``n`` points ends."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def grow_tree(points: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """One tree as rows (node, feature, split, left, right, size, depth)."""
    limit = math.ceil(math.log2(max(2, len(points))))
    rows: list[tuple] = []
    todo = [(0, np.arange(len(points)), 0)]
    made = 1
    while todo:
        node, idx, depth = todo.pop()
        part = points[idx]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(idx) <= 1 or len(usable) == 0:
            rows.append((node, -1, 0.0, -1, -1, len(idx), depth))
            continue
        f = int(rng.choice(usable))
        split = float(rng.uniform(low[f], high[f]))
        goes_left = part[:, f] < split
        rows.append((node, f, split, made, made + 1, len(idx), depth))
        todo += [(made, idx[goes_left], depth + 1), (made + 1, idx[~goes_left], depth + 1)]
        made += 2
    return rows


@dataclass
class Forest:
    """Flat node arrays of all trees; at most ``n_trees * 2 * rows_per_tree`` nodes."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    depth: int
    norm: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Minus the anomaly score: near -1 is odd, near 0 is ordinary.

        A leaf leads to itself, so all rows take ``depth`` steps and none is asked where it is.
        """
        total = np.zeros(len(x))
        flat, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(flat[first + self.feature[at]] < self.split[at], self.left[at], self.right[at])
            total += self.path[at]
        return -np.exp2(-(total / len(self.roots)) / self.norm)


def fit_forest(df: DataFrame, features: list[str], n_trees: int = N_TREES, rows_per_tree: int = ROWS_PER_TREE, seed: int = SEED) -> Forest:
    """Draw about ``rows_per_tree`` rows per tree, grow the trees in parallel, gather the nodes.

    The draw keeps about ``n_trees * rows_per_tree`` rows whatever the size of the
    table, one tree per drawn row; a small table lends each row to several trees.
    """
    x = df.select(F.array(*_filled(features)).alias("x"))
    total = x.count()
    if total < 10:
        raise ValueError("an isolation forest needs ten rows at least")
    psi = min(rows_per_tree, total)
    # A fifth more than asked for, so nearly every tree gets its full share.
    wanted = 1.2 * n_trees * psi
    copies = max(1, min(n_trees, math.ceil(wanted / total)))
    drawn = x.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).filter(F.rand(seed) < wanted / (total * copies))
    assigned = drawn.withColumn("tree", F.floor(F.rand(seed + 1) * n_trees).cast("int"))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[0])])
        points = np.stack(pdf["x"].to_numpy())
        points = points[rng.permutation(len(points))[:rows_per_tree]]
        out = pd.DataFrame(grow_tree(points, rng), columns=["node", "feature", "split", "left", "right", "size", "depth"])
        out.insert(0, "tree", int(key[0]))
        return out

    nodes = assigned.groupBy("tree").applyInPandas(grow, TREE_SCHEMA).toPandas().sort_values(["tree", "node"])
    start = nodes.groupby("tree", sort=True).size().cumsum().shift(fill_value=0)
    base = nodes["tree"].map(start).to_numpy()
    leaf = nodes["feature"].to_numpy() < 0
    shift = lambda c: np.where(leaf, np.arange(len(nodes)), nodes[c].to_numpy() + base)
    path = nodes["depth"].to_numpy() + np.array([mean_path(s) for s in nodes["size"]])
    return Forest(
        np.where(leaf, 0, nodes["feature"].to_numpy()), nodes["split"].to_numpy(), shift("left"), shift("right"), path,
        start.to_numpy(), int(nodes["depth"].max()), mean_path(psi) or 1.0,
    )


def score_rows(df: DataFrame, features: list[str], forest: Forest, name: str = "if_score") -> DataFrame:
    """Adds the score; the forest has a fixed greatest size and goes to every executor once."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = shared.value
        for columns in batches:
            yield pd.Series(model.scores(np.column_stack([c.to_numpy(dtype="float64") for c in columns])))

    return df.withColumn(name, score(*_filled(features)))


def _filled(features: list[str]) -> list:
    return [F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features]


def isolation_scan(
    df: DataFrame, features: list[str], contamination: float = CONTAMINATION, n_trees: int = N_TREES, seed: int = SEED
) -> DataFrame:
    """Adds ``if_score`` (lower is odder, below 0 is an anomaly) and ``is_anomaly``.

    The offset is the exact ``contamination`` quantile of the raw scores.
    """
    share = min(0.5, max(0.001, contamination))
    # Written once: the quantile and the result both read the scores.
    raw = cut_lineage(score_rows(df, features, fit_forest(df, features, n_trees, seed=seed), "_raw"))
    offset = quantile_by_key(raw.select(F.lit(1).alias("_all"), "_raw"), ["_all"], "_raw", share, "q").select("q").scalar()
    return raw.withColumn("if_score", F.col("_raw") - offset).drop("_raw").withColumn("is_anomaly", F.col("if_score") < 0)


def contamination_cv(
    df: DataFrame, features: list[str], row_id: str, grid: tuple[float, ...] = (0.001, 0.01, 0.05), folds: int = 3, n_trees: int = 256, seed: int = SEED
) -> DataFrame:
    """(contamination, mean_threshold, stability, chosen): fold means of the score quantile and deviation.

    A fold's forest does not depend on the contamination, so each fold is fitted once.
    """
    folded = df.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(folds)))
    rows = None
    for k in range(folds):
        forest = fit_forest(folded.filter(F.col("_fold") != k), features, n_trees, seed=seed + k)
        held = cut_lineage(score_rows(folded.filter(F.col("_fold") == k), features, forest, "s").select("_fold", "s"))
        spread = held.groupBy("_fold").agg(F.stddev_pop("s").alias("stability"))
        for c in grid:
            q = quantile_by_key(held, ["_fold"], "s", c, "threshold").join(spread, "_fold").withColumn("contamination", F.lit(c))
            rows = q if rows is None else rows.unionByName(q)
    out = rows.groupBy("contamination").agg(F.avg("threshold").alias("mean_threshold"), F.avg("stability").alias("stability"))
    best = out.agg(F.min_by("contamination", F.struct(F.round("stability", 9), F.col("contamination")))).scalar()
    return out.withColumn("chosen", F.col("contamination") == best)
