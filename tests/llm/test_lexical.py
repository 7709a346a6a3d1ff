"""Search against plain scoring of every document."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from inquest.llm.lexical import BLOCK, Best, Postings, _shard_rows, build_index, score_parts, search, search_shard, terms_of
from tests.llm.cases import empty, frame, prose, rows

ITEMS = "item_id long, text string, pos string, doc_id long"


def plain_terms(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [t for t in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower) if t]


def plain_search(data, items, k):
    """(item, rank, doc, score) by the contract's arithmetic; rank leaves equal rows apart."""
    docs = [(x[0], plain_terms(x[1])) for x in data]
    docs = [(i, t) for i, t in docs if t]
    n, total, df = len(docs), sum(len(t) for _, t in docs), {}
    for _, t in docs:
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(plain_terms(text))
    for item, terms in asked.items():
        scores = []
        for doc, t in docs:
            m, score = 100 - 50 + (50 * len(t) * n) // total, 0
            for term in terms & set(t):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1)))
                score += w * ((1000000000 * t.count(term)) // (1000 * t.count(term) + 20 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1):
            yield item, rank, doc, -score


def queries_of(data, seed=2):
    r = random.Random(seed)
    texts = [" ".join(r.sample(prose(r, 60).split(), 8)) for _ in range(20)]
    texts += [data[12][1][:200], "übung ÑANDÚ ñandú", "", None, "nowhere to be found", "The, the; THE-river", "x" * 50_000]
    return [(i, t) for i, t in enumerate(texts)] + [(3, "yellow house"), (None, "quiet letter")]


@pytest.mark.parametrize("shard_words, query_terms, k", [(1 << 20, 200_000, 50), (500, 40, 5), (1, 200_000, 3)])
def test_against_plain_scoring(spark, shard_words, query_terms, k):
    data = rows()
    items = queries_of(data)
    index = build_index(frame(spark, data), shard_words=shard_words)
    got = search(index, spark.createDataFrame([(i, t, "p", 9) for i, t in items], ITEMS), k, query_terms=query_terms)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_search(data, items, k)))


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "the house", "", 1)], ITEMS)
    assert search(build_index(empty(spark)), items).count() == 0
    assert search(build_index(frame(spark, rows())), items.limit(0)).count() == 0
    assert search(build_index(empty(spark)), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_terms():
    for x in rows():
        assert [t.decode() for t in terms_of(x[1])] == plain_terms(x[1])


def test_blocks_are_rejected_before_they_are_decoded():
    """A rare term decides; of the list of a frequent one only blocks with candidates are decoded, and the result is the same."""
    r, n = random.Random(1), 20_000
    texts = [[b"common"] * r.choice((1, 1, 1, 2)) + ([b"rare"] if i in (70, 71, 9000, 15_000, 15_001) else []) + [b"other"] * r.randint(1, 30) for i in range(n)]
    lengths = np.array([len(t) for t in texts])
    batch = _shard_rows(7, np.arange(n), lengths, pa.array([w for t in texts for w in t], pa.binary()))
    parts = score_parts(n, int(lengths.sum()))

    def lists():
        out = {}
        for row in batch.to_pylist()[1:]:
            out[row["term"]] = Postings(row["df"], *(np.array(row[c]) for c in ("last", "sizes", "impacts", "impact_tf", "impact_len")), row["control"], row["data"])
            out[row["term"]].bound(parts)
        return out

    held = lists()
    for term, p in held.items():
        docs, tf = p._decode(None)
        assert docs.tolist() == [i for i, t in enumerate(texts) if term in t] and tf.tolist() == [t.count(term) for t in texts if term in t]
        some = np.array([0, len(p.last) - 1]) if len(p.last) > 1 else np.array([0])
        part = p._decode(some)[0]
        assert set(part.tolist()) == {d for b in some for d in docs[b * BLOCK : (b + 1) * BLOCK].tolist()}
    held, best = lists(), Best(3)
    search_shard([(9000, held[b"rare"]), (5, held[b"common"])], np.arange(n), lengths, parts, best)
    score = np.zeros(n, np.int64)
    for term, w in ((b"rare", 9000), (b"common", 5)):
        docs, tf = lists()[term]._decode(None)
        score[docs] += w * parts(tf, lengths[docs])
    want = np.lexsort((np.arange(n), -score))[:3]
    assert best.ids.tolist() == want.tolist() and best.scores.tolist() == score[want].tolist()
    assert 0 < held[b"common"].decoded <= 3 < len(held[b"common"].last)
