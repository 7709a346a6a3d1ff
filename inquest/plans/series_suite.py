"""Time series, profile templates, text retrieval and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from inquest.functions import text as X
from inquest.operators import retrieval as P
from inquest.operators import series as Q
from inquest.operators import thresholds as T
from inquest.operators import vector_index as V
from inquest.operators.ml_features import dataset_fingerprint
from inquest.plans.functions_suite import CHUNK_SQL
from inquest.plans.registry import query

TXN, CASE_ROWS = ("v_txn",), ("v_case_rows",)

SERIES = """h AS (SELECT {k} AS k, date_trunc('hour', {ts}) AS hb, sum({v}) AS y FROM {t} WHERE {ts} >= (SELECT max({ts}) FROM {t}) - INTERVAL 24 HOUR GROUP BY ALL),
o AS (SELECT k, list(y ORDER BY hb) AS ys FROM h GROUP BY k), l AS (SELECT k, ys[greatest(1, len(ys) - 23):len(ys)] AS ys FROM o),
p AS (SELECT k, list_concat(list_transform(range(0, greatest(0, 24 - len(ys))), lambda i: ys[1]), ys) AS ys FROM l),
s AS (SELECT k, CAST(generate_subscripts(ys, 1) - 1 AS INT) AS slot, unnest(ys) AS value FROM p),
th AS (SELECT k, CASE WHEN max(value) > 0 THEN quantile_cont(value, 0.85) ELSE avg(value) + 1e-6 END AS threshold FROM s GROUP BY k)"""


@query("ts_activity_24h", f"WITH {SERIES.format(k='1', ts='ts', v='value', t='events')} SELECT slot, round(value, 4) AS value, round(threshold, 4) AS threshold FROM s JOIN th ON th.k = s.k")
def _(t):
    out = Q.activity_series(t.events, "ts", "value", t.events.agg(F.max("ts")).scalar(), [])
    return out.select("slot", F.round("value", 4).alias("value"), F.round("threshold", 4).alias("threshold"))


@query(
    "ts_activity_bulk",
    f"WITH {SERIES.format(k='user_id', ts='ts', v='value', t='events')} SELECT s.k AS user_id, slot, round(value, 4) AS value, round(threshold, 4) AS threshold FROM s JOIN th ON th.k = s.k",
)
def _(t):
    out = Q.activity_series(t.events, "ts", "value", t.events.agg(F.max("ts")).scalar(), ["user_id"])
    return out.select("user_id", "slot", F.round("value", 4).alias("value"), F.round("threshold", 4).alias("threshold"))


@query(
    "ts_bucket_by_position",
    "SELECT CAST(slot AS INT) AS slot, round(sum(value), 4) AS value, count(*) AS n FROM (SELECT value, ntile(24) OVER (ORDER BY ts, event_id) - 1 AS slot FROM events) GROUP BY slot",
)
def _(t):
    rows = t.events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return Q.position_series(rows, "us", "event_id", "value").withColumn("value", F.round("value", 4))


@query("tpl_velocity", "SELECT user_id, count(*) AS txn_count, round(sum(amount), 2) AS volume, max(amount) AS max_amount FROM v_txn GROUP BY 1", TXN)
def _(t):
    return Q.velocity_profile(t.v_txn, "user_id", "amount").select("user_id", "txn_count", F.round("volume", 2).alias("volume"), "max_amount")


@query("tpl_segment", "SELECT segment, count(*) AS txn_count, round(sum(amount), 2) AS volume, round(avg(amount), 3) AS avg_amount FROM v_txn GROUP BY 1", TXN)
def _(t):
    out = Q.segment_profile(t.v_txn, "segment", "amount")
    return out.select("segment", "txn_count", F.round("volume", 2).alias("volume"), F.round("avg_amount", 3).alias("avg_amount"))


@query("tpl_time_series", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS txns, round(sum(value), 2) AS volume FROM events GROUP BY 1")
def _(t):
    return Q.daily_profile(t.events, "ts", "value").withColumn("volume", F.round("volume", 2))


@query("tpl_chargeback_rate", "SELECT segment, count(*) AS total_txns, count(*) FILTER (disputed) AS chargebacks, count(*) FILTER (disputed) / count(*)::DOUBLE AS cb_rate FROM v_txn GROUP BY 1", TXN)
def _(t):
    return Q.chargeback_rate(t.v_txn, "segment", "disputed")


@query("tpl_zscore", "SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events), 6) AS amount_z FROM events")
def _(t):
    return Q.z_scores(t.events, "value").select("event_id", F.round("amount_z", 6).alias("amount_z"))


@query("tpl_shared_attribute", "SELECT ip, count(DISTINCT user_id) AS distinct_users FROM v_txn GROUP BY ip HAVING count(DISTINCT user_id) > 1", TXN)
def _(t):
    return Q.shared_attribute(t.v_txn, "ip", "user_id")


@query("tpl_describe")
def _(t):
    return Q.describe_table(t.events.select("user_id", "event_type", "value"))


# ---- retrieval ---------------------------------------------------------------------


@query("rag_chunk", f"WITH {CHUNK_SQL} SELECT d.source, count(DISTINCT c.doc_id) AS docs, count(*) AS chunks, sum(length(c.text))::BIGINT AS chars FROM chunk_rows c JOIN documents d ON d.doc_id = c.doc_id GROUP BY d.source")
def _(t):
    # All documents were loaded before in another cut, and all are loaded again.
    old = X.chunk_table(t.documents, "doc_id", "text", max_chars=300, overlap=50)
    new = P.replace_source(old, X.chunk_table(t.documents, "doc_id", "text"), "doc_id")
    sources = new.join(t.documents.select("doc_id", "source"), "doc_id")
    return sources.groupBy("source").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


# Benchmark items are the queries; their vector is the embedding of the same number.
QUERIES = """q AS (SELECT b.item_id AS query_id, b.text, e.embedding::DOUBLE[] AS v FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)"""
NEAR = """near AS (SELECT query_id, id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) - 1 AS INT) AS "rank" FROM
 (SELECT q.query_id, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.v) AS similarity FROM q, embeddings e) QUALIFY "rank" < 20)"""
BM25 = r"""toks AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
terms AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) > 2)) AS term FROM q),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM toks),
tf AS (SELECT id, length AS len, term, count(*) AS tf FROM (SELECT id, len(w) AS length, unnest(w) AS term FROM toks) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT t.query_id, t.term, CASE WHEN ln((st.n - df.df + 0.5) / (df.df + 0.5)) > 0 THEN ln((st.n - df.df + 0.5) / (df.df + 0.5)) ELSE 1e-6 END AS idf FROM terms t JOIN df ON df.term = t.term, st),
bm AS (SELECT query_id, id, sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) AS score FROM tf JOIN idf ON idf.term = tf.term, st GROUP BY ALL),
txt AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) - 1 AS INT) AS "rank" FROM bm QUALIFY "rank" < 20)"""


def _queries(t):
    return t.benchmark.join(t.embeddings, F.col("vec_id") == F.col("item_id")).select(F.col("item_id").alias("query_id"), "text", "embedding")


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding")


def _docs(t):
    return t.documents.select(F.col("doc_id").alias("id"), "text")


@query("rag_vector_topk", f'WITH {QUERIES}, {NEAR} SELECT query_id, id, round(round(similarity, 12), 6) AS similarity, "rank" FROM near')
def _(t):
    return P.vector_topk(_vectors(t), _queries(t)).withColumn("similarity", F.round("similarity", 6))


@query("rag_vector_index_recall", "SELECT count(*) AS queries, true AS reached FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id")
def _(t):
    # All vectors are indexed; what the lists that were tuned on a sample find is held against the exact result of all queries.
    index = V.build_vector_index(_vectors(t))
    asked = _queries(t).select("query_id", "embedding")
    found = V.recall(index, asked, V.probes_for(index, asked))
    return asked.agg(F.count("*").alias("queries")).withColumn("reached", F.lit(found >= 0.9))


@query("rag_bm25_topk", f'WITH {QUERIES}, {BM25} SELECT query_id, id, round(score, 4) AS score, "rank" FROM txt')
def _(t):
    return P.bm25_topk(_docs(t), _queries(t)).withColumn("score", F.round("score", 4))


FUSED = """fused AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, coalesce(1.0::DOUBLE / (60 + a."rank"), 0.0) + coalesce(1.0::DOUBLE / (60 + b."rank"), 0.0) AS score FROM near a FULL JOIN txt b ON a.query_id = b.query_id AND a.id = b.id)"""


@query(
    "rag_hybrid_rrf",
    f'WITH {QUERIES}, {NEAR}, {BM25}, {FUSED} SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS "rank" FROM fused QUALIFY "rank" <= 5',
)
def _(t):
    return P.hybrid_search(_docs(t), _vectors(t), _queries(t)).withColumn("score", F.round("score", 6))


@query("win_rank_fusion", f"WITH {QUERIES}, {NEAR}, {BM25}, {FUSED} SELECT query_id, id, round(score, 6) AS score FROM fused")
def _(t):
    q = _queries(t)
    both = P.fuse_ranks(P.vector_topk(_vectors(t), q), P.bm25_topk(_docs(t), q), k=2 * P.HITS)
    return both.select("query_id", "id", F.round("score", 6).alias("score"))


@query("union_rrf_ids", f"WITH {QUERIES}, {NEAR}, {BM25} SELECT query_id, id FROM near UNION SELECT query_id, id FROM txt")
def _(t):
    q = _queries(t)
    near, text = P.vector_topk(_vectors(t), q), P.bm25_topk(_docs(t), q)
    return near.select("query_id", "id").unionByName(text.select("query_id", "id")).distinct()


@query(
    "rag_prototype_route",
    """WITH pr AS (SELECT 'class_' || label AS route, embedding::DOUBLE[] AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 2),
s AS (SELECT e.vec_id AS id, pr.route, list_cosine_similarity(e.embedding::DOUBLE[], pr.v) AS s FROM embeddings e, pr), b AS (SELECT id, max(s) AS s, arg_max(route, (s, route)) AS route FROM s GROUP BY id)
SELECT id, CASE WHEN s >= 0.15 THEN route ELSE 'analyst' END AS route, round(s, 6) AS similarity FROM b""",
)
def _(t):
    from inquest.operators.keyed import top_per_key

    first = top_per_key(t.embeddings, ["label"], [F.col("vec_id")], 2)
    prototypes = first.select(F.concat(F.lit("class_"), "label").alias("route"), "embedding")
    return P.prototype_route(_vectors(t), prototypes, "analyst").withColumn("similarity", F.round("similarity", 6))


# ---- thresholds ----------------------------------------------------------------------

SCORES = ("v_scores",)
CURVE = """per AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM v_scores GROUP BY score),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC)::BIGINT AS cum_pos, sum(neg) OVER (ORDER BY score DESC)::BIGINT AS cum_neg FROM per),
r AS (SELECT *, cum_pos::DOUBLE / (SELECT sum(pos) FROM per) AS tpr, cum_neg::DOUBLE / (SELECT sum(neg) FROM per) AS fpr FROM c), i AS (SELECT * FROM r WHERE score > (SELECT min(score) FROM r))"""


def _curve(t):
    return T.roc_points(t.v_scores, "label", "score")


@query("win_cumulative_roc", f"WITH {CURVE} SELECT score, pos, neg, cum_pos, cum_neg, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM r", SCORES)
def _(t):
    return _curve(t).withColumns({"tpr": F.round("tpr", 9), "fpr": F.round("fpr", 9)})


@query("ml_threshold_youden", f"WITH {CURVE} SELECT score AS threshold, tpr, fpr FROM i ORDER BY tpr - fpr DESC, score DESC LIMIT 1", SCORES)
def _(t):
    return T.youden_threshold(_curve(t))


@query("ml_threshold_recall", f"WITH {CURVE} SELECT score AS threshold, tpr, fpr FROM i WHERE tpr >= 0.8 ORDER BY fpr, score DESC LIMIT 1", SCORES)
def _(t):
    return T.recall_threshold(_curve(t))


@query(
    "ml_metrics_at_threshold",
    f"""WITH {CURVE}, th AS (SELECT score AS t FROM i ORDER BY tpr - fpr DESC, score DESC LIMIT 1), m AS (SELECT sum(pos) FILTER (score >= t)::BIGINT AS tp, sum(neg) FILTER (score >= t)::BIGINT AS fp, sum(neg) FILTER (score < t)::BIGINT AS tn, sum(pos) FILTER (score < t)::BIGINT AS fn,
 round(sum(pos::DOUBLE / (SELECT sum(pos) FROM per) * cum_pos / (cum_pos + cum_neg)), 6) AS pr_auc, round(sum(pos * ((SELECT sum(neg) FROM per) - cum_neg + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM r, th)
SELECT *, round(tp / (tp + fn + 1e-9), 6) AS recall, round(fp / (fp + tn + 1e-9), 6) AS fpr FROM m""",
    SCORES,
)
def _(t):
    points = _curve(t)
    out = T.metrics_at(points, T.youden_threshold(points).select("threshold").scalar())
    return out.withColumns({c: F.round(c, 6) for c in ("pr_auc", "roc_auc", "recall", "fpr")})


@query(
    "ml_dataset_fingerprint",
    """SELECT count(*) AS n_rows, CAST(sum(('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)), 1, 12))::BIGINT) AS VARCHAR) AS row_digest,
 sha256('o_custkey:bigint,o_orderkey:bigint,o_orderpriority:string,o_orderstatus:string') AS schema_digest FROM orders""",
)
def _(t):
    return dataset_fingerprint(t.orders, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
