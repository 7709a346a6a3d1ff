"""Nearest vectors by inverted lists: centroids, a list per centroid, and only the lists near a query are compared.

``vector_topk`` in ``retrieval`` is the exact way and the default. Here the centroids are fitted on a bounded sample, but every
vector is in a list, and how many lists a search has to look at for a wanted recall is measured against the exact
way. Written sorted by list, the index lets Parquet skip what no query of a block asks for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquest.operators.keyed import top_per_key
from inquest.operators.retrieval import BLOCK_QUERIES, HITS, _unit, query_blocks, vector_topk
from inquest.session import cut_lineage

#: Vectors that the centroids are fitted on, and the most lists; both bound what a task gets.
FIT_ROWS, MOST_LISTS = 100_000, 4096
#: Queries on which the number of lists is measured.
TUNE_QUERIES = 200


@dataclass(frozen=True)
class VectorIndex:
    """``rows`` (list, id, embedding), written in the order of ``list``; ``centroids``: one unit vector per list.

    List -1 has the vectors that are null, empty, zero or of another length than the centroids; searches never skip it.
    """

    rows: DataFrame
    centroids: np.ndarray


def _usable(size: int):
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return (F.size("embedding") == size) & (norm > 0)


def build_vector_index(vectors: DataFrame, lists: int | None = None, fit_rows: int = FIT_ROWS, seed: int = 7) -> VectorIndex:
    """Index of ``vectors`` (id, embedding); by default about as many lists as the square root of the rows, ``MOST_LISTS`` at most.

    The sample is made of the vectors whose ids hash lowest, so it does not depend on the order of rows. An empty table gives an empty index.
    """
    slim = vectors.select("id", "embedding")
    sizes = slim.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).filter("n > 0").orderBy(F.desc("rows"), "n").first()
    size, total = (sizes["n"], sizes["rows"]) if sizes else (0, 0)
    usable = slim.filter(_usable(size))
    sample = usable.orderBy(F.xxhash64(F.lit(seed), "id")).limit(fit_rows).select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    wanted = min(MOST_LISTS, lists or max(1, round(total**0.5)))
    sample = cut_lineage(sample)
    fitted = sample.count()
    if not fitted:
        centroids = np.zeros((0, size))
    else:
        model = KMeans(k=max(2, min(wanted, fitted)), seed=seed, distanceMeasure="cosine", maxIter=15).fit(sample) if fitted > 1 and wanted > 1 else None
        centroids = _unit(np.array(model.clusterCenters())) if model else _unit(np.array([sample.first()["features"].toArray()]))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            place = np.full(len(pdf), -1)
            fits = np.flatnonzero([e is not None and len(e) == size and bool(np.any(np.asarray(e, float))) for e in pdf["embedding"]])
            if len(fits) and len(centroids):
                units = _unit(np.stack(pdf["embedding"].iloc[fits].to_numpy()).astype("float64"))
                place[fits] = (units @ centroids.T).argmax(axis=1)
            yield pdf.assign(list=place)[["list", "id", "embedding"]]

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    rows = slim.mapInPandas(assign, f"list int, id {kinds['id']}, embedding {kinds['embedding']}")
    # By ranges of (list, id): a list of most vectors is spread over many files, and a file has few lists.
    rows = rows.repartitionByRange("list", F.xxhash64("id")).sortWithinPartitions("list")
    return VectorIndex(cut_lineage(rows), centroids)


def index_topk(index: VectorIndex, queries: DataFrame, probes: int, k: int = HITS, block: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` nearest vectors among the ``probes`` lists nearest to each query, ranks from 0.

    With as many probes as lists it is ``vector_topk``. A block of queries goes to every task; each list is compared with
    the queries that ask for it.
    """
    parts = [_block(index, part, probes, k) for part in query_blocks(queries, "query_id", block)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(cut_lineage(part))
    return out


def _block(index: VectorIndex, queries: DataFrame, probes: int, k: int) -> DataFrame:
    asked = queries.select("query_id", "embedding").orderBy("query_id").collect()
    names = [r["query_id"] for r in asked]
    units = [_unit(np.array([r["embedding"]], dtype="float64"))[0] if r["embedding"] else np.zeros(0) for r in asked]
    size = index.centroids.shape[1]
    # A query that no centroid is comparable with looks at everything.
    near = [np.argsort(-(index.centroids @ u), kind="stable")[:probes] if len(u) == size and u.any() else np.arange(len(index.centroids)) for u in units]
    ask: dict[int, list[int]] = {-1: list(range(len(names)))}
    for q, lists in enumerate(near):
        for at in lists.tolist():
            ask.setdefault(at, []).append(q)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for pdf in batches:
            found = []
            for at, rows in pdf.groupby("list", sort=False):
                embeddings, ids = rows["embedding"].to_numpy(), rows["id"].to_numpy()
                lengths = np.array([0 if e is None else len(e) for e in embeddings])
                for length in np.unique(lengths):
                    who = [q for q in ask.get(at, ()) if len(units[q]) == length]
                    other = [q for q in ask.get(at, ()) if len(units[q]) != length] if at == -1 else []
                    some = np.flatnonzero(lengths == length)
                    if who and length:
                        scores = np.round(_unit(np.stack([np.asarray(embeddings[i], float) for i in some])) @ np.stack([units[q] for q in who]).T, 12)
                        least = -np.partition(-scores, min(k, len(some)) - 1, axis=0)[min(k, len(some)) - 1]
                        r, c = np.nonzero(scores >= least)
                        found.append(pd.DataFrame({"q": np.array(who)[c], "id": ids[some[r]], "similarity": scores[r, c]}))
                    for q in other:
                        found.append(pd.DataFrame({"q": q, "id": ids[some], "similarity": 0.0}))
            both = pd.concat([x for x in (kept, *found) if x is not None]) if found or kept is not None else None
            if both is not None:
                kept = both.sort_values(["q", "similarity", "id"], ascending=[True, False, True]).groupby("q", sort=False).head(k)
        if kept is not None:
            yield pd.DataFrame({"query_id": [names[j] for j in kept["q"]], "id": kept["id"], "similarity": kept["similarity"]})

    kinds = (queries.schema["query_id"].dataType.simpleString(), index.rows.schema["id"].dataType.simpleString())
    rows = index.rows.filter(F.col("list").isin(sorted(ask)))
    found = rows.mapInPandas(nearest, f"query_id {kinds[0]}, id {kinds[1]}, similarity double")
    best = top_per_key(found, ["query_id"], [F.col("similarity").desc(), F.col("id")], k)
    return best.withColumn("rank", F.col("rank") - 1)


def recall(index: VectorIndex, queries: DataFrame, probes: int, k: int = HITS) -> float:
    """Share of the exact ``k`` nearest vectors that a search with ``probes`` lists finds."""
    exact = cut_lineage(vector_topk(index.rows.select("id", "embedding"), queries, k).select("query_id", "id"))
    return _recall(index, queries, probes, k, exact)


def _recall(index: VectorIndex, queries: DataFrame, probes: int, k: int, exact: DataFrame) -> float:
    hits = index_topk(index, queries, probes, k).select("query_id", "id").join(exact, ["query_id", "id"]).count()
    return hits / max(1, exact.count())


def probes_for(index: VectorIndex, queries: DataFrame, target: float = 0.95, k: int = HITS) -> int:
    """The least number of probes, by halving, whose recall on a sample of the queries reaches ``target``.

    The sample is the ``TUNE_QUERIES`` queries whose ids hash lowest. All lists reach it always.
    """
    sample = cut_lineage(queries.select("query_id", "embedding").orderBy(F.xxhash64("query_id")).limit(TUNE_QUERIES))
    exact = cut_lineage(vector_topk(index.rows.select("id", "embedding"), sample, k).select("query_id", "id"))
    low, high = 1, max(1, len(index.centroids))
    while low < high:
        middle = (low + high) // 2
        if _recall(index, sample, middle, k, exact) >= target:
            high = middle
        else:
            low = middle + 1
    return low
