"""BM25 by bounds against plain scoring, and how much of the work the bounds save."""

import math
import random

import pytest
from pyspark.sql import functions as F

from inquest.operators import retrieval as P


def corpus(seed=2, n=400):
    """Words by rank of frequency: a few in nearly all texts, most in few."""
    r = random.Random(seed)
    vocabulary = [f"word{i:04d}" for i in range(800)]
    weights = [1 / (i + 1) for i in range(800)]
    docs = [(i, " ".join(r.choices(vocabulary, weights, k=r.choice((5, 40, 200))))) for i in range(n)]
    docs += [(n, ""), (n + 1, None), (n + 2, docs[3][1]), (n + 3, docs[3][1])]
    queries = [(q, " ".join(["word0000", "word0001", "word0002", "of", *r.choices(vocabulary, k=4)])) for q in range(25)] + [(25, "word0000"), (26, "nowhere")]
    return docs, queries


def plain_bm25(docs, queries, k):
    tokens = {i: t.lower().split() if t else [] for i, t in docs}
    mean = sum(len(t) for i, t in tokens.items() if dict(docs)[i] is not None) / sum(t is not None for _, t in docs)
    for q, text in queries:
        scores = {}
        for term in {w for w in text.lower().split() if len(w) > 2}:
            df = sum(term in t for t in tokens.values())
            raw = math.log((len(docs) - df + 0.5) / (df + 0.5))
            for i, t in tokens.items():
                if term in t:
                    f = t.count(term)
                    scores[i] = scores.get(i, 0.0) + max(raw, P.MIN_IDF if raw <= 0 else raw) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t) / mean))
        for rank, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]):
            yield q, rank, i, round(s, 6)


@pytest.mark.parametrize("k", [3, 20])
def test_best_texts_are_those_of_plain_scoring(spark, k):
    docs, queries = corpus()
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    got = sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in P.bm25_topk(d, q, k).collect())
    want = sorted(plain_bm25(docs, queries, k))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want))


def test_common_words_gather_no_texts(spark):
    """With the bounds, fewer than half of the (text, query) groups are made."""
    docs, queries = corpus()
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries[:25], "query_id long, text string")
    parts, weights = P.bm25_weights(d, q)
    split = P.split_terms(parts, weights, 3)
    groups = lambda w: parts.join(w.select("query_id", "term"), "term").select("query_id", "id").distinct().count()
    assert groups(split.filter("essential")) < 0.5 * groups(weights)
    assert split.groupBy("query_id").agg(F.count_if("essential").alias("n")).filter("n = 0").isEmpty()


def test_words_are_counted_in_one_pass_over_the_texts(spark):
    """Without a shuffle of words, in any number of blocks, and rows that share id and length count as one text."""
    docs = [(1, "Alpha beta alpha, gamma"), (1, "alpha alpha alpha beta"), (1, "alpha"), (2, "BETA delta"), (3, None), (4, ""), (None, "beta beta"), (None, "beta alpha"), (5, "none of them")]
    d, asked = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame([("alpha",), ("beta",), ("nowhere",)], "term string")
    want = [(1, 1, "alpha", 1), (1, 4, "alpha", 5), (1, 4, "beta", 2), (2, 2, "beta", 1), (None, 2, "alpha", 1), (None, 2, "beta", 3)]
    order = lambda rows: sorted(map(tuple, rows), key=str)
    for block in (1, 100):
        counts, texts = P.asked_counts(d, asked, block)
        assert order(counts.collect()) == order(want)
        assert order(texts.collect()) == order([(i, None if t is None else len([w for w in t.replace(",", "").split()])) for i, t in docs])
    assert P.asked_counts(d, asked.limit(0))[0].isEmpty()


def test_few_texts_have_their_common_words_looked_up(spark, monkeypatch):
    """Texts that the best by essential words leave behind are out before common words are joined."""
    r = random.Random(4)
    fill = lambda n: [f"fill{r.randrange(5000)}" for _ in range(n)]
    # The rare word stands in long texts, so it alone gives a low floor; five of those have the other word too.
    docs = [(i, " ".join(fill(60) + ["rare"] + ["middle"] * 3 * (i < 5) + ["common"] * (i % 2))) for i in range(30)]
    docs += [(i, " ".join(fill(r.randint(5, 10)) + ["middle"] * (i < 300) + ["common"] * (i % 5 < 2))) for i in range(30, 1000)]
    queries = [(0, "rare middle common")]
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    steps = []
    monkeypatch.setattr(P, "cut_lineage", lambda df, cut=P.cut_lineage: steps.append(cut(df)) or steps[-1])
    got = [tuple(x) for x in P.bm25_topk(d, q, 1).select("query_id", "rank", "id").collect()]
    assert got == [x[:3] for x in plain_bm25(docs, queries, 1)]
    sizes = [x.count() for x in steps if x.columns == ["query_id", "id", "score"]]
    assert sizes[-1] <= 30 < 300 <= sizes[0]
