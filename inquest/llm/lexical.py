"""Ranked lexical search: a block index in shards, searched by MaxScore with block maxima.

A shard is a bounded number of words of whole documents (one document at least). Of each of its terms the index has a
row: the postings (document number, occurrences) in blocks of ``BLOCK``, variable-length coded, and for each block its last
document and its impacts, the least length among its documents by occurrences. From those the greatest score part that
a posting of the block can have is exact for any corpus statistics, so the index does not depend on them.

A query takes the lists of its terms by falling bound (weight times greatest part of the list). While documents that
are in none of the lists so far could still reach the threshold, the next list is essential: it is decoded whole. The
others only add to candidates: a candidate whose score so far, plus the block maximum at its place, plus the bounds of
the lists to come, is below the threshold is rejected before the block is decoded. The threshold is the score of the
last of the best so far, of this shard and of the shards before in the task. Tasks give out one heap per query, and the heaps are
merged by a window per query, cut in each task before its shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.llm.common import ascii_lower, land, scratch
from inquest.llm.tokenfile import _binary, pack, unpack
from inquest.operators.keyed import top_per_key

BLOCK = 128
#: Words and documents of a shard.
SHARD_WORDS, SHARD_DOCS = 1 << 20, 1 << 16
#: Query terms that are sent to the tasks at a time.
QUERY_TERMS = 200_000
TOP = 50
#: Stands for a null id; such documents come last among equal scores.
LAST = (1 << 63) - 1

#: Characters below U+0080 that are neither digits nor letters separate terms.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

INDEX_ROWS = (
    "shard long, term binary, df int, last array<int>, sizes array<int>, impacts array<int>, impact_tf array<int>, impact_len array<int>, "
    "control binary, data binary, ids array<long>, lengths array<int>"
)
HITS = "item long, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of digits, letters and characters from U+0080 on, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def terms_column(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values))


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, np.int64)


def _shard_rows(shard: int, ids: np.ndarray, lengths: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    """The rows of one shard: first its documents (null term), then its terms."""
    coded = words.dictionary_encode()
    docs = len(ids)
    key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * docs + np.repeat(np.arange(docs), lengths), return_counts=True)
    term, doc = key // docs, key % docs
    begins = _runs(term)
    df = np.diff(np.r_[begins, len(term)])
    place = np.arange(len(term)) - np.repeat(begins, df)
    blocks = -(-df // BLOCK)
    block_cuts = np.r_[0, np.cumsum(blocks)]
    block = np.repeat(block_cuts[:-1], df) + place // BLOCK
    starts = _runs(block)
    size = np.diff(np.r_[starts, len(block)])
    # Coded values of a block: its gaps, less 1 but for the first, then its occurrences less 1.
    gaps = np.diff(doc, prepend=0) - 1
    gaps[starts] = doc[starts]
    at = np.arange(len(term)) + np.repeat(starts, size)
    values = np.zeros(2 * len(term), np.uint32)
    values[at], values[at + np.repeat(size, size)] = gaps, tf - 1
    control, control_cuts, data, data_cuts = pack(values, 2 * size)
    # Impacts: the least length of each number of occurrences in a block.
    length = lengths[doc]
    order = np.lexsort((length, tf, block))
    pair = block[order] * (int(tf.max(initial=0)) + 1) + tf[order]
    kept = order[_runs(pair)]
    impacts = np.bincount(block[kept], minlength=len(starts))
    impact_cuts = np.r_[0, np.cumsum(impacts)]

    rows, none = len(begins), pa.nulls(1, pa.binary())
    lead = lambda cuts: np.r_[0, cuts]  # noqa: E731  an empty list for the row of documents
    ints = lambda x: x.astype(np.int32)
    zeros = np.zeros(rows, np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(rows + 1, shard)),
            pa.concat_arrays([none, coded.dictionary.take(pa.array(term[begins]))]),
            pa.array(ints(np.r_[0, df])),
            _lists(ints(doc[starts + size - 1]), lead(block_cuts)),
            _lists(ints(np.diff(data_cuts)), lead(block_cuts)),
            _lists(ints(impacts), lead(block_cuts)),
            _lists(ints(tf[kept]), lead(impact_cuts[block_cuts])),
            _lists(ints(length[kept]), lead(impact_cuts[block_cuts])),
            _binary(lead(control_cuts[block_cuts]), control),
            _binary(lead(data_cuts[block_cuts]), data),
            _lists(ids, np.r_[0, docs, zeros + docs]),
            _lists(ints(lengths), np.r_[0, docs, zeros + docs]),
        ],
        [c.split()[0] for c in INDEX_ROWS.split(", ")],
    )


def _indexed(shard_words: int, shard_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, lengths, words, held = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms_of(text)
                ids.append(LAST if doc is None else doc)
                lengths.append(len(found))
                words.append(pa.array(found, pa.binary()))
                held += len(found)
                if held >= shard_words or len(ids) >= shard_docs:
                    yield _shard_rows(shard, np.array(ids, np.int64), np.array(lengths), pa.concat_arrays(words))
                    shard, ids, lengths, words, held = shard + 1, [], [], [], 0
        if ids:
            yield _shard_rows(shard, np.array(ids, np.int64), np.array(lengths), pa.concat_arrays(words))

    return run


@dataclass(frozen=True)
class LexicalIndex:
    """``rows`` in the shared folder, and the corpus counts: documents with a term, and terms with repeats."""

    rows: DataFrame
    documents: int
    words: int
    folder: str


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS, shard_docs: int = SHARD_DOCS) -> LexicalIndex:
    """Index all terms of all rows. Ids are whole numbers; rows without one, and rows that share one, are documents of their own.

    Null and empty texts have no terms and are never found. An empty table gives an empty index. Other columns are not read.
    """
    folder = scratch(docs.sparkSession, "lexical")
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = land(slim.mapInArrow(_indexed(shard_words, shard_docs), INDEX_ROWS), f"{folder}/index")
    heads = rows.filter("term IS NULL").select(
        F.size(F.filter("lengths", lambda n: n > 0)).alias("documents"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("words")
    )
    counts = heads.agg(F.sum("documents"), F.sum("words")).first()
    return LexicalIndex(rows, counts[0] or 0, counts[1] or 0, folder)


class Postings:
    """The list of a term in a shard; blocks are decoded when asked for."""

    def __init__(self, df: int, last, sizes, impacts, impact_tf, impact_len, control: bytes, data: bytes):
        self.last, self.impacts = last, (impacts, impact_tf, impact_len)
        self.n = np.full(len(last), BLOCK)
        self.n[-1] = df - BLOCK * (len(last) - 1)
        self.control, self.data = np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8)
        self.control_cuts, self.data_cuts = np.r_[0, np.cumsum(-(-2 * self.n // 4))], np.r_[0, np.cumsum(sizes)]
        self.whole: tuple[np.ndarray, np.ndarray] | None = None
        self.decoded = 0

    def bound(self, parts) -> None:
        """Greatest score part of each block, and of the list, before the term's weight."""
        each, tf, length = self.impacts
        self.block_most = np.maximum.reduceat(parts(tf.astype(np.int64), length.astype(np.int64)), np.cumsum(each) - each)
        self.most = int(self.block_most.max())

    def _decode(self, which: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        if which is None:
            n, control, data = self.n, self.control, self.data
        else:
            n = self.n[which]
            control, data = (np.concatenate([raw[cuts[b] : cuts[b + 1]] for b in which]) for raw, cuts in ((self.control, self.control_cuts), (self.data, self.data_cuts)))
        self.decoded += len(n)
        values = unpack(control, data, 2 * n).astype(np.int64)
        begin = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(begin, n)
        steps = values[at] + 1
        steps[begin] -= 1
        total = np.cumsum(steps)
        docs = total - np.repeat(total[begin] - steps[begin], n)
        return docs, values[at + np.repeat(n, n)] + 1

    def all(self, parts, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and score parts of the whole list."""
        if self.whole is None:
            docs, tf = self._decode(None)
            self.whole = docs, parts(tf, lengths[docs])
        return self.whole

    def at(self, blocks: np.ndarray, parts, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.whole is not None:
            return self.whole
        docs, tf = self._decode(blocks)
        return docs, parts(tf, lengths[docs])


@dataclass
class Best:
    """The best documents of a query so far."""

    k: int
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def threshold(self) -> int:
        """A document with a lower score is not among the best."""
        return int(self.scores[-1]) if len(self.scores) >= self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def _kth(values: np.ndarray, k: int) -> int:
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0


def search_shard(lists: list[tuple[int, Postings]], ids: np.ndarray, lengths: np.ndarray, parts, best: Best) -> None:
    """Add to ``best`` what a shard has for one query; ``lists`` has the weight and the list of each term that the shard holds."""
    lists = sorted(lists, key=lambda x: -x[0] * x[1].most)
    bounds = np.array([w * p.most for w, p in lists] + [0], np.int64)
    rest = np.cumsum(bounds[::-1])[::-1].tolist()
    threshold, score, i = best.threshold(), np.zeros(len(ids), np.int64), 0
    while i < len(lists) and rest[i] >= threshold:
        weight, postings = lists[i]
        docs, part = postings.all(parts, lengths)
        score[docs] += weight * part
        i += 1
        if i < len(lists):
            # What a document has so far is less than its score, so the k-th of these bounds the k-th score.
            threshold = max(threshold, _kth(score, best.k))
    found = np.flatnonzero(score + rest[i] >= threshold)
    score = score[found]
    while i < len(lists) and len(found):
        weight, postings = lists[i]
        i += 1
        block = np.searchsorted(postings.last, found)
        most = weight * np.append(postings.block_most, 0)[block]
        alive = score + most + rest[i] >= threshold
        found, score, block = found[alive], score[alive], block[alive]
        asked = np.unique(block[block < len(postings.last)])
        if len(asked):
            docs, part = postings.at(asked, parts, lengths)
            place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            score = score + np.where(docs[place] == found, weight * part[place], 0)
        threshold = max(threshold, _kth(score, best.k))
        alive = score + rest[i] >= threshold
        found, score = found[alive], score[alive]
    keep = score >= threshold
    best.add(score[keep], ids[found[keep]])


def score_parts(documents: int, words: int):
    """The score part of a posting before its weight, from occurrences and document length; whole numbers."""

    def parts(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        m = 100 - 50 + (50 * length * documents) // max(words, 1)
        return (1_000_000_000 * tf) // (1000 * tf + 20 * m)

    return parts


def _list_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(name)
    return column.offsets.to_numpy(), column.values.to_numpy()


def _searched(queries: list[tuple[int, list[tuple[bytes, int]]]], documents: int, words: int, k: int):
    """Rows come sorted by shard, the one of its documents first."""
    parts = score_parts(documents, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: Best(k) for item, _ in queries}
        shard, ids, lengths, held = None, None, None, {}

        def search() -> None:
            for item, terms in queries:
                lists = [(w, held[t]) for t, w in terms if t in held]
                if lists:
                    search_shard(lists, ids, lengths, parts, best[item])

        for batch in batches:
            shards, terms, df = batch.column("shard").to_pylist(), batch.column("term").to_pylist(), batch.column("df").to_pylist()
            control, data = batch.column("control"), batch.column("data")
            arrays = {c: _list_of(batch, c) for c in ("last", "sizes", "impacts", "impact_tf", "impact_len", "ids", "lengths")}
            for i, (now, term) in enumerate(zip(shards, terms)):
                some = {c: values[cuts[i] : cuts[i + 1]] for c, (cuts, values) in arrays.items()}
                if term is None:
                    search()
                    shard, ids, lengths, held = now, some["ids"], some["lengths"].astype(np.int64), {}
                    continue
                if now != shard:
                    raise ValueError(f"shard {now} has no row of documents")
                held[term] = Postings(df[i], *(some[c] for c in ("last", "sizes", "impacts", "impact_tf", "impact_len")), control[i].as_py(), data[i].as_py())
                held[term].bound(parts)
        search()
        item = np.repeat(np.array(list(best), np.int64), [len(b.ids) for b in best.values()])
        docs, scores = (np.concatenate([getattr(b, c) for b in best.values()] or [np.zeros(0, np.int64)]) for c in ("ids", "scores"))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(docs, mask=docs == LAST), pa.array(scores)], ["item", "doc_id", "score"])

    return run


def search(index: LexicalIndex, items: DataFrame, k: int = TOP, item_id: str = "item_id", text: str = "text", query_terms: int = QUERY_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item with a score above 0.

    Equal scores come by ascending doc_id, rows without one last. Rows that share an item id are one item with the terms
    of all; a null id is an id. Items without terms, or whose terms no document has, have no rows. Queries go to the tasks in
    blocks of about ``query_terms`` terms, each block once over the lists of its terms.
    """
    spark, folder = items.sparkSession, scratch(items.sparkSession, "search")
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), F.explode(terms_column(F.col(f"`{text}`"))).alias("term")).distinct()
    numbers = land(asked.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()), f"{folder}/items")
    terms = asked.join(numbers.withColumnRenamed("item_id", "n_id"), F.col("item_id").eqNullSafe(F.col("n_id"))).select("item", F.col("term").cast("binary").alias("term"))
    terms = land(terms, f"{folder}/terms")
    lists = index.rows.filter("term IS NOT NULL")
    df = lists.select("term", "df").join(terms.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * index.documents + 2)) / (2 * F.col("df") + 1))).cast("long")
    weighed = land(terms.join(df, "term").select("item", "term", weight.alias("weight")).filter("weight > 0"), f"{folder}/weighed")
    blocks = -(-weighed.count() // query_terms)
    hits = [spark.createDataFrame([], HITS)]
    for b in range(blocks):
        block = weighed.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        queries: dict[int, list[tuple[bytes, int]]] = {}
        for row in block.collect():
            queries.setdefault(row.item, []).append((bytes(row.term), row.weight))
        if not queries:
            continue
        heads = index.rows.filter("term IS NULL")
        rows = lists.join(block.select("term").distinct(), "term", "left_semi").select(heads.columns).unionByName(heads)
        rows = rows.repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("term"))
        hits.append(land(rows.mapInArrow(_searched(sorted(queries.items()), index.documents, index.words, k), HITS), f"{folder}/hits-{b}"))
    found = reduce(DataFrame.unionByName, hits)
    found = top_per_key(found, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k)
    return found.join(numbers, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
