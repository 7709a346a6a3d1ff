"""Inverted lists: recall against the exact search, and equality to it with all lists."""

import numpy as np
from pyspark.sql import functions as F

from inquest.operators import vector_index as V
from inquest.operators.retrieval import vector_topk


def clustered(spark, n=1500, dim=16):
    """Forty clusters, one of which has a third of all vectors; nulls, zeros, ties and another length too."""
    r = np.random.RandomState(4)
    centres = r.normal(size=(40, dim))
    of = np.where(r.random_sample(n) < 1 / 3, 0, r.randint(0, 40, n))
    rows = [(i, [float(x) for x in centres[c] + 0.5 * r.normal(size=dim)]) for i, c in enumerate(of)]
    rows += [(n, [0.0] * dim), (n + 1, None), (n + 2, [1.0, 2.0]), (n + 3, rows[5][1]), (n + 4, [])]
    queries = [(1000 + q, [float(x) for x in centres[q % 40] + 0.5 * r.normal(size=dim)]) for q in range(60)]
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4), spark.createDataFrame(queries, "query_id long, embedding array<double>")


def test_recall_and_equality(spark):
    vectors, queries = clustered(spark)
    index = V.build_vector_index(vectors)
    assert index.rows.count() == vectors.count() and 20 < len(index.centroids) < 60
    assert {r.id for r in index.rows.filter("list = -1").collect()} == {1500, 1501, 1502, 1504}
    filled = V.VectorIndex(index.rows.filter("embedding IS NOT NULL"), index.centroids)
    probes = V.probes_for(filled, queries, 0.95, 10)
    assert probes < len(index.centroids) / 2
    assert V.recall(filled, queries, probes, 10) >= 0.9
    every = V.index_topk(filled, queries, len(index.centroids), 10, block=25)
    exact = vector_topk(filled.rows.select("id", "embedding"), queries, 10)
    key = lambda df: sorted((r.query_id, r["rank"], r.id, r.similarity) for r in df.collect())
    assert key(every) == key(exact)


def test_one_list_and_empty_table(spark):
    vectors, queries = clustered(spark, 30)
    one = V.build_vector_index(vectors.filter(F.col("id") < 30), lists=1)
    assert V.recall(one, queries, 1, 5) == 1.0
    none = V.build_vector_index(vectors.limit(0))
    assert V.index_topk(none, queries, 3).count() == 0
