"""Text retrieval: chunks, nearest vectors, BM25, rank fusion, nearest prototype."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inquest.functions.scalar import cosine
from inquest.operators.keyed import top_per_key
from inquest.session import cut_lineage

# Hits kept per ranking, fusion constant, BM25 constants, least idf, prototype floor.
HITS = 20
RRF_K = 60
BM25_K1 = 1.2
BM25_B = 0.75
MIN_IDF = 1e-6
ROUTE_FLOOR = 0.15
# Queries that travel with a task at a time; more of them go in blocks of about this size, each a pass over the vectors.
BLOCK_QUERIES = 1000
# Asked words that travel with a task at a time, likewise.
BLOCK_WORDS = 200_000


def replace_source(old: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """Chunks after a load: a source that comes again replaces its earlier chunks."""
    again = new.select(source).distinct()
    return old.join(again, source, "left_anti").unionByName(new)


def query_blocks(queries: DataFrame, key: str, size: int = BLOCK_QUERIES) -> list[DataFrame]:
    """The queries in parts of about ``size`` rows, by a hash of their key."""
    blocks = -(-queries.count() // size)
    return [queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == i) for i in range(blocks)] if blocks > 1 else [queries]


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = HITS, block: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` nearest vectors per query, ranks from 0.

    ``vectors`` has (id, embedding), ``queries`` has (query_id, embedding). A block of
    queries goes to every executor; a task multiplies its vectors with it batch by batch,
    keeps the best ``k`` per query, and passes those on when it has seen all of its vectors.
    """
    parts = [_block_topk(vectors, part, k) for part in query_blocks(queries, "query_id", block)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _block_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    asked = queries.select("query_id", "embedding").orderBy("query_id").collect()
    names = [r["query_id"] for r in asked]
    by_size: dict[int, list[int]] = {}
    for i, r in enumerate(asked):
        by_size.setdefault(len(r["embedding"]), []).append(i)
    # One matrix per vector length: a query only meets vectors of its own length, others score 0.
    packed = {size: (idx, _unit(np.array([asked[i]["embedding"] for i in idx], dtype="float64"))) for size, idx in by_size.items()}
    shared = vectors.sparkSession.sparkContext.broadcast((names, packed))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrices = shared.value
        kept = pd.DataFrame({"q": pd.Series(dtype="int64"), "id": pd.Series(dtype="object"), "similarity": pd.Series(dtype="float64")})
        for pdf in batches:
            lengths = pdf["embedding"].map(len).to_numpy()
            scores = np.zeros((len(pdf), len(ids)))
            for size, (idx, matrix) in matrices.items():
                rows = np.flatnonzero(lengths == size)
                if len(rows):
                    part = _unit(np.stack(pdf["embedding"].iloc[rows].to_numpy()).astype("float64"))
                    scores[np.ix_(rows, idx)] = np.round(part @ matrix.T, 12)
            # Rows below the k-th best of the batch are out; those that tie with it stay until ids decide.
            least = -np.partition(-scores, min(k, len(pdf)) - 1, axis=0)[min(k, len(pdf)) - 1]
            row, q = np.nonzero(scores >= least)
            found = pd.DataFrame({"q": q, "id": pdf["id"].to_numpy()[row], "similarity": scores[row, q]})
            both = pd.concat([kept, found]) if len(kept) else found
            kept = both.sort_values(["q", "similarity", "id"], ascending=[True, False, True]).groupby("q", sort=False).head(k)
        yield pd.DataFrame({"query_id": [ids[j] for j in kept["q"]], "id": kept["id"], "similarity": kept["similarity"]})

    kinds = (queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString())
    near = vectors.select("id", "embedding").mapInPandas(nearest, f"query_id {kinds[0]}, id {kinds[1]}, similarity double")
    best = top_per_key(near, ["query_id"], [F.col("similarity").desc(), F.col("id")], k)
    return best.withColumn("rank", F.col("rank") - 1)


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def words(body: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(body), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _counted(shared, texts: bool):
    """(id, len, term, tf) of the asked words of each text; with ``texts`` also one row per text with no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(shared.value, pa.string())
        for batch in batches:
            found = pc.fill_null(pc.index_in(pc.list_flatten(batch.column(1)), value_set=asked), -1).to_numpy(zero_copy_only=False)
            row = pc.list_parent_indices(batch.column(1)).to_numpy(zero_copy_only=False)
            pairs, tf = np.unique(row[found >= 0].astype("int64") * len(asked) + found[found >= 0], return_counts=True)
            row, term = np.divmod(pairs, max(1, len(asked)))
            none = np.arange(batch.num_rows if texts else 0)
            rows = pa.array(np.concatenate([row, none]))
            terms = pa.concat_arrays([asked.take(pa.array(term)), pa.nulls(len(none), pa.string())])
            counts = pa.array(np.concatenate([tf, np.ones(len(none), "int64")]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pc.list_value_length(batch.column(1)).take(rows), terms, counts], ["id", "len", "term", "tf"])

    return run


def asked_counts(docs: DataFrame, asked: DataFrame, block: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(id, len, term, tf) of the words ``asked`` (term) in all texts, and (id, len) of every text; rows of equal id and len are one text.

    A block of the words goes to every executor, where each text's words are counted as they are split: a text is split once per
    block. Only texts whose id comes again meet in a shuffle.
    """
    body = docs.select("id", words(F.col("text")).alias("_w"))
    kind = f"id {docs.schema['id'].dataType.simpleString()}, len int, term string, tf long"
    out = None
    for part in query_blocks(asked, "term", block):
        shared = docs.sparkSession.sparkContext.broadcast([r["term"] for r in part.collect()])
        rows = body.mapInArrow(_counted(shared, out is None), kind)
        out = rows if out is None else out.unionByName(rows)
    flat = cut_lineage(out)
    texts, counts = flat.filter("term IS NULL").select("id", "len"), flat.filter("term IS NOT NULL")
    again = cut_lineage(texts.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("again")))
    same = F.col("id").eqNullSafe(F.col("again"))
    merged = cut_lineage(counts.join(again, same, "left_semi").groupBy("id", "len", "term").agg(F.sum("tf").alias("tf")))
    return counts.join(again, same, "left_anti").unionByName(merged), texts


def bm25_weights(docs: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, term, part) of all asked words in all texts, and (query_id, term, df, idf, bound), both written.

    ``part`` is a word's score in a text before its weight, ``bound`` the most that the word can add to a text's score.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(F.filter(words(F.col("text")), lambda w: F.length(w) > 2))).alias("term"))
    asked = terms.select("term").distinct()
    tf, texts = asked_counts(docs, asked)
    stats = texts.agg(F.struct(F.count("*").alias("n"), F.avg("len").alias("mean")).alias("st")).scalar()
    parts = cut_lineage(tf.select("id", "term", (F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / stats["mean"]))).alias("part")))
    per = parts.groupBy("term").agg(F.count("*").alias("df"), F.max("part").alias("most"))
    raw = F.log((stats["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = terms.join(per, "term").withColumn("idf", F.when(raw > 0, raw).otherwise(MIN_IDF))
    return parts, cut_lineage(weighed.select("query_id", "term", "df", "idf", (F.col("idf") * F.col("most")).alias("bound")))


#: Texts with a selective word that are scored first, per wanted hit; they set the threshold of a query.
FIRST_TEXTS = 20


def split_terms(parts: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """``weights`` with ``floor`` and ``essential``: the least score among the best ``k`` is no lower than the floor, and a text
    with no essential word of the query cannot reach it.

    The floor is the ``k``-th best score by the rarest words alone. The words that add least are not essential as long as
    their bounds together stay below it.
    """
    rising = W.partitionBy("query_id").orderBy("df", "term").rowsBetween(W.unboundedPreceding, -1)
    rare = weights.withColumn("before", F.coalesce(F.sum("df").over(rising), F.lit(0))).filter(F.col("before") < FIRST_TEXTS * k)
    first = parts.join(rare.select("query_id", "term", "idf"), "term").groupBy("query_id", "id").agg(F.sum(F.col("idf") * F.col("part")).alias("score"))
    best = top_per_key(first, ["query_id"], [F.col("score").desc(), F.col("id")], k)
    # Scores are compared after rounding, so the floor gives way by more than that.
    floors = best.filter(F.col("rank") == k).select(F.col("query_id").alias("f_id"), (F.col("score") - 1e-5).alias("floor"))
    joined = weights.join(floors, F.col("query_id") == F.col("f_id"), "left").drop("f_id").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    least = W.partitionBy("query_id").orderBy("bound", "term").rowsBetween(W.unboundedPreceding, 0)
    return joined.withColumn("essential", F.sum("bound").over(least) >= F.col("floor"))


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = HITS) -> DataFrame:
    """(query_id, id, score, rank): best texts per query, any word of three letters and more counts.

    ``docs`` has (id, text), ``queries`` has (query_id, text). Only words that some query asks for leave the text scan,
    already counted per text. Exact top ``k`` by bounds: texts are gathered by a query's essential words; those that with all
    the other words could not reach the ``k``-th best of them go, and only for the rest are the common words looked up.
    """
    parts, weights = bm25_weights(docs, queries)
    split = cut_lineage(split_terms(parts, weights, k))
    found = cut_lineage(parts.join(split.filter("essential").select("query_id", "term", "idf"), "term").groupBy("query_id", "id").agg(F.sum(F.col("idf") * F.col("part")).alias("score")))
    # Common words only add, so the best k by essential words raise the floor before any common word is looked up.
    raised = top_per_key(found, ["query_id"], [F.col("score").desc(), F.col("id")], k).filter(F.col("rank") == k).select("query_id", (F.col("score") - 1e-5).alias("raised"))
    limits = split.groupBy("query_id").agg(F.max("floor").alias("floor"), F.coalesce(F.sum(F.when(~F.col("essential"), F.col("bound"))), F.lit(0.0)).alias("rest"))
    limits = limits.join(raised, "query_id", "left").withColumn("floor", F.greatest("floor", "raised"))
    held = cut_lineage(found.join(limits, "query_id").filter(F.col("score") + F.col("rest") >= F.col("floor")).select("query_id", "id", "score"))
    common = split.filter(~F.col("essential")).select("query_id", "term", "idf")
    more = held.select("query_id", "id").join(common, "query_id").join(parts, ["id", "term"]).select("query_id", "id", (F.col("idf") * F.col("part")).alias("score"))
    scored = held.unionByName(more).groupBy("query_id", "id").agg(F.sum("score").alias("score"))
    # Equal texts have equal scores up to the order of the sum; rounding keeps their order by id.
    best = top_per_key(scored, ["query_id"], [F.round("score", 6).desc(), F.col("id")], k)
    return best.withColumn("rank", F.col("rank") - 1)


def fuse_ranks(a: DataFrame, b: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, score, rank): reciprocal ranks of two rankings added up, best ``k`` per query."""
    left = a.select("query_id", "id", (1.0 / (RRF_K + F.col("rank"))).alias("_a"))
    right = b.select("query_id", "id", (1.0 / (RRF_K + F.col("rank"))).alias("_b"))
    both = left.join(right, ["query_id", "id"], "full")
    scored = both.select("query_id", "id", (F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))).alias("score"))
    return top_per_key(scored, ["query_id"], [F.col("score").desc(), F.col("id")], k)


def hybrid_search(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5, hits: int = HITS) -> DataFrame:
    """``queries`` has (query_id, text, embedding)."""
    near = vector_topk(vectors, queries.select("query_id", "embedding"), hits)
    text = bm25_topk(docs, queries.select("query_id", "text"), hits)
    return fuse_ranks(near, text, k)


def prototype_route(vectors: DataFrame, prototypes: DataFrame, fallback: str, floor: float = ROUTE_FLOOR) -> DataFrame:
    """(id, route, similarity): class of the nearest prototype, or ``fallback`` below the floor.

    ``prototypes`` has (route, embedding). A block of them travels as one array; the
    best of each block meet in the row.
    """
    packs = [part.agg(F.array_sort(F.collect_list(F.struct("route", "embedding")))).scalar() for part in query_blocks(prototypes, "embedding")]
    listed = vectors.select("id", "embedding", *(p.alias(f"_p{i}") for i, p in enumerate(packs)))
    nearest = lambda c: F.array_max(F.transform(c, lambda p: F.struct(cosine(F.col("embedding"), p["embedding"]).alias("s"), p["route"].alias("route"))))
    best = listed.select("id", F.array_max(F.array(*(nearest(F.col(f"_p{i}")) for i in range(len(packs))))).alias("b"))
    route = F.when(F.col("b.s") >= floor, F.col("b.route").cast("string")).otherwise(fallback)
    return best.select("id", route.alias("route"), F.col("b.s").alias("similarity"))
