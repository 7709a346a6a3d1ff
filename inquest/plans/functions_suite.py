"""Scalar functions, one query each, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inquest.functions import scalar as S
from inquest.functions import text as X
from inquest.plans.registry import query

SESSIONS = ("v_sessions",)
TXN = ("v_txn",)


@query(
    "fn_clean_key",
    "SELECT event_id, nullif(trim(CASE WHEN event_id % 5 = 0 THEN '  ' ELSE '  ' || event_type || ' ' END), '') AS k FROM events",
)
def _(t):
    raw = F.when(F.col("event_id") % 5 == 0, "  ").otherwise(F.concat(F.lit("  "), "event_type", F.lit(" ")))
    return t.events.select("event_id", S.clean_key(raw).alias("k"))


@query(
    "fn_ipv4_subnet24",
    """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE regexp_replace(ip, '\\.[0-9]+$', '.0/24') END AS subnet24 FROM v_sessions""",
    SESSIONS,
)
def _(t):
    # Every ninth address is made invalid.
    ip = F.when(F.col("event_id") % 9 == 0, F.concat("ip", F.lit("999"))).otherwise(F.col("ip"))
    return t.v_sessions.select("event_id", S.ipv4_subnet24(ip).alias("subnet24"))


@query(
    "fn_email_parts",
    """SELECT event_id, split_part(lower(trim(email)), '@', 1) AS local_part, split_part(lower(trim(email)), '@', 2) AS domain FROM v_sessions""",
    SESSIONS,
)
def _(t):
    return t.v_sessions.select("event_id", S.email_local(F.col("email")).alias("local_part"), S.email_domain(F.col("email")).alias("domain"))


@query(
    "fn_gmail_normalize",
    """SELECT event_id, CASE WHEN split_part(lower(trim(email)), '@', 2) IN ('gmail.com', 'googlemail.com')
 THEN replace(split_part(lower(trim(email)), '@', 1), '.', '') ELSE split_part(lower(trim(email)), '@', 1) END AS normal_local FROM v_sessions""",
    SESSIONS,
)
def _(t):
    e = F.col("email")
    return t.v_sessions.select("event_id", S.gmail_normal_local(S.email_local(e), S.email_domain(e)).alias("normal_local"))


@query(
    "fn_shannon_entropy",
    """SELECT event_id, round(list_aggregate(string_split(split_part(email, '@', 1), ''), 'entropy'), 6) AS bits FROM v_sessions""",
    SESSIONS,
)
def _(t):
    return t.v_sessions.select("event_id", F.round(S.shannon_entropy(S.email_local(F.col("email"))), 6).alias("bits"))


@query(
    "fn_chrome_major",
    """SELECT event_id, TRY_CAST(regexp_extract(user_agent, 'Chrome/([0-9]+)', 1) AS INT) AS major,
 coalesce(TRY_CAST(regexp_extract(user_agent, 'Chrome/([0-9]+)', 1) AS INT) < 115, false) AS stale FROM v_sessions""",
    SESSIONS,
)
def _(t):
    ua = F.col("user_agent")
    return t.v_sessions.select("event_id", S.chrome_major(ua).alias("major"), S.chrome_is_stale(ua).alias("stale"))


@query(
    "fn_disposable_domain",
    "SELECT event_id, split_part(email, '@', 2) IN ('mailinator.com', 'yopmail.com') AS disposable FROM v_sessions",
    SESSIONS,
)
def _(t):
    return t.v_sessions.select("event_id", S.is_disposable(S.email_domain(F.col("email"))).alias("disposable"))


@query(
    "fn_parse_loose_amount",
    """SELECT event_id, CASE event_id % 5 WHEN 1 THEN -value WHEN 3 THEN NULL WHEN 4 THEN value + 1000 ELSE value END AS amount FROM events
 WHERE value IS NOT NULL""",
)
def _(t):
    v = F.format_string("%.2f", "value")
    raw = (
        F.when(F.col("event_id") % 5 == 1, F.concat(F.lit("(€ "), v, F.lit(")")))
        .when(F.col("event_id") % 5 == 3, F.concat(v, F.lit(" or so")))
        .when(F.col("event_id") % 5 == 4, F.concat(F.lit("$ "), F.format_number(F.col("value") + 1000, 2)))
        .otherwise(F.concat(F.lit(" £"), v))
    )
    return t.events.filter("value IS NOT NULL").select("event_id", S.parse_loose_amount(raw).alias("amount"))


@query(
    "fn_normalize_amount_fields",
    """SELECT event_id, value AS amount, 'about ' || CAST(event_id AS VARCHAR) AS balance, event_type AS note FROM events""",
)
def _(t):
    raw = F.create_map(
        F.lit("amount"), F.concat(F.lit("$"), F.format_string("%.2f", "value")),
        F.lit("balance"), F.concat(F.lit("about "), F.col("event_id").cast("string")),
        F.lit("note"), F.col("event_type"),
    )
    m = S.normalize_amount_map(raw)
    return t.events.select("event_id", m["amount"].cast("double").alias("amount"), m["balance"].alias("balance"), m["note"].alias("note"))


@query(
    "fn_parse_ts_tolerant",
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS parsed FROM events""",
)
def _(t):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = (
        F.when(F.col("event_id") % 4 == 0, F.concat(iso, F.lit("Z")))
        .when(F.col("event_id") % 4 == 1, F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
        .when(F.col("event_id") % 4 == 2, F.date_format("ts", "dd/MM/yyyy"))
        .otherwise(F.lit("not a time"))
    )
    return t.events.select("event_id", S.parse_ts_tolerant(raw).alias("parsed"))


@query(
    "fn_haversine_miles",
    """SELECT event_id, round(2 * 3958.7613 * atan2(sqrt(h), sqrt(greatest(0.0, 1 - h))), 6) AS miles FROM (
 SELECT event_id, pow(sin(radians(latitude - 40.0) / 2), 2) + cos(radians(40.0)) * cos(radians(latitude)) * pow(sin(radians(longitude + 74.0) / 2), 2) AS h FROM v_sessions)""",
    SESSIONS,
)
def _(t):
    d = S.haversine_miles(F.lit(40.0), F.lit(-74.0), F.col("latitude"), F.col("longitude"))
    return t.v_sessions.select("event_id", F.round(d, 6).alias("miles"))


@query(
    "fn_is_disputed",
    """SELECT l_orderkey, l_linenumber, l_partkey, lower(trim(CASE l_linenumber % 4 WHEN 0 THEN ' Yes' WHEN 1 THEN 'CHARGEBACK' WHEN 2 THEN 'no' ELSE CAST(l_returnflag = 'R' AS VARCHAR) END))
 IN ('yes', 'chargeback', 'true') AS disputed FROM lineitem""",
)
def _(t):
    n = F.col("l_linenumber") % 4
    raw = F.when(n == 0, " Yes").when(n == 1, "CHARGEBACK").when(n == 2, "no").otherwise((F.col("l_returnflag") == "R").cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.is_disputed(raw).alias("disputed"))


@query(
    "fn_status_class",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'disputed' ELSE 'other' END AS status_class FROM orders""",
)
def _(t):
    raw = F.when(F.col("o_orderstatus") == "F", " Settled").when(F.col("o_orderstatus") == "P", "Refund requested").otherwise("open")
    return t.orders.select("o_orderkey", S.status_class(raw).alias("status_class"))


@query("fn_hosting_isp", "SELECT event_id, isp = 'OVH Hosting' AS hosting FROM v_sessions", SESSIONS)
def _(t):
    return t.v_sessions.select("event_id", S.is_hosting_isp(F.col("isp")).alias("hosting"))


@query(
    "fn_norm_postal",
    "SELECT c_custkey, replace(c_name, '#', '') || CAST(c_nationkey AS VARCHAR) AS postal FROM customer",
)
def _(t):
    raw = F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.lit(" \t")), F.lit("  "), F.col("c_nationkey").cast("string"), F.lit(" "))
    return t.customer.select("c_custkey", S.norm_postal(raw).alias("postal"))


@query(
    "fn_screen_resolution",
    "SELECT event_id, CAST(screen_width AS VARCHAR) || 'x' || CAST(screen_height AS VARCHAR) AS resolution FROM v_sessions",
    SESSIONS,
)
def _(t):
    return t.v_sessions.select("event_id", S.screen_resolution(F.col("screen_width"), F.col("screen_height")).alias("resolution"))


@query(
    "fn_avs_cvv_strong",
    "SELECT transaction_id, amount, avs = 'Match' AS avs_strong, cvv = 'P' AS cvv_strong FROM v_txn",
    TXN,
)
def _(t):
    return t.v_txn.select(
        "transaction_id", "amount", S.check_is_strong(F.col("avs")).alias("avs_strong"), S.check_is_strong(F.col("cvv")).alias("cvv_strong")
    )


@query(
    "fn_stable_id",
    "SELECT DISTINCT hardware_id, 'd:' || substr(sha256('d:' || hardware_id), 1, 14) AS stable_id FROM v_sessions",
    SESSIONS,
)
def _(t):
    return t.v_sessions.select("hardware_id").distinct().select("hardware_id", S.stable_id("d", F.col("hardware_id")).alias("stable_id"))


@query(
    "fn_entity_type_alias",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'user_id' WHEN 'click' THEN 'ip_address' WHEN 'signup' THEN 'card_hash' WHEN 'error' THEN 'device_id' END AS entity_type FROM events""",
)
def _(t):
    e = F.col("event_type")
    raw = F.when(e == "view", "Account").when(e == "click", " IP").when(e == "signup", "card-hash").when(e == "error", "device").otherwise("zip")
    return t.events.select("event_id", S.entity_type_alias(raw).alias("entity_type"))


@query(
    "fn_case_status",
    """SELECT case_id, CASE WHEN upper(trim(status)) IN ('FLAGGED', 'CLEARED') THEN upper(trim(status)) ELSE 'INVESTIGATING' END AS status,
 CASE upper(trim(status)) WHEN 'FLAGGED' THEN 'Fraud Confirmed' WHEN 'CLEARED' THEN 'Cleared' ELSE 'Under Investigation' END AS label FROM v_cases""",
    ("v_cases",),
)
def _(t):
    s = F.col("status")
    return t.v_cases.select("case_id", S.case_status(s).alias("status"), S.case_status_label(s).alias("label"))


@query(
    "fn_month_label",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN substr('unknown date', 1, 10) ELSE strftime(o_orderdate, '%b %Y') END AS month_label FROM orders""",
)
def _(t):
    raw = F.when(F.col("o_orderkey") % 7 == 0, "unknown date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return t.orders.select("o_orderkey", S.month_label(raw).alias("month_label"))


@query(
    "fn_binary_label",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN CASE WHEN value >= 0.5 THEN 1 ELSE 0 END ELSE 0 END AS label FROM events""",
)
def _(t):
    e = F.col("event_type")
    raw = F.when(e == "view", "Fraud").when(e == "click", F.col("value").cast("string")).otherwise("clean")
    return t.events.select("event_id", S.binary_label(raw).alias("label"))


@query(
    "fn_row_to_json",
    """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","note":null}' AS row_json FROM nation""",
)
def _(t):
    wide = t.nation.select("n_nationkey", "n_name", F.lit(None).cast("string").alias("note"))
    return wide.select("n_nationkey", S.row_json(wide.columns).alias("row_json"))


@query(
    "fn_round_geo",
    "SELECT event_id, round(latitude + 0.0004, 3) AS lat, round(longitude - 0.0004, 3) AS lon FROM v_sessions",
    SESSIONS,
)
def _(t):
    return t.v_sessions.select(
        "event_id", S.round_geo(F.col("latitude") + 0.0004).alias("lat"), S.round_geo(F.col("longitude") - 0.0004).alias("lon")
    )


# Every document gets one line that names its own ids, as a dispute letter would.
LETTER = """ || ' Transaction ID: TX' || CAST(doc_id * 7919 + 100000 AS VARCHAR(20)) || ', order #ORD-' || CAST(doc_id + 1000000 AS VARCHAR(20)) || ' and tx' || CAST(doc_id * 7919 + 100000 AS VARCHAR(20)) || ' cb-AB' || CAST(doc_id + 1000 AS VARCHAR(20))"""


@query(
    "extract_txn_ids",
    f"""WITH letters AS (SELECT doc_id, text {LETTER} AS body FROM documents),
found AS (SELECT doc_id, unnest(ids) AS raw, generate_subscripts(ids, 1) AS pos FROM (SELECT doc_id,
 regexp_extract_all(body, 'transaction\\s*(?:id|#|number|no\\.?)\\s*[:#]?\\s*([A-Za-z0-9][A-Za-z0-9_-]{{5,40}})', 1, 'i')
 || regexp_extract_all(body, 'order\\s*(?:id|#|number)\\s*[:#]?\\s*([A-Za-z0-9][A-Za-z0-9_-]{{5,40}})', 1, 'i')
 || regexp_extract_all(body, 'txn\\s*(?:id|#)?\\s*[:#]?\\s*([A-Za-z0-9][A-Za-z0-9_-]{{5,40}})', 1, 'i')
 || regexp_extract_all(body, '\\b(?:chb|cb)-[A-Z0-9]{{6,24}}\\b', 0, 'i')
 || regexp_extract_all(body, '\\b(?:ord|txn)[_-][A-Z0-9]{{8,32}}\\b', 0, 'i') AS ids FROM letters)),
firsts AS (SELECT doc_id, lower(trim(raw)) AS folded, min(pos) AS pos, arg_min(trim(raw), pos) AS txn_id FROM found WHERE length(trim(raw)) BETWEEN 6 AND 48 GROUP BY ALL)
SELECT doc_id, txn_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS position FROM firsts""",
)
def _(t):
    letters = t.sql(f"SELECT doc_id, text {LETTER} AS body FROM {{documents}}", documents=t.documents)
    return X.txn_id_candidates(letters, "doc_id", "body")


@query(
    "extract_entities_text",
    r"""WITH tokens AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:(?:25[0-5]|2[0-4]\d|1?\d{1,2})\.){3}(?:25[0-5]|2[0-4]\d|1?\d{1,2})\b|[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b|\b[a-f0-9]{24,128}\b|\bacc[_-][a-z0-9]{2,}\b|\bu[_-]?[a-z0-9]{4,}\b', 0, 'i')) AS token FROM documents)
SELECT doc_id, token, count(*) AS hits, CASE
 WHEN regexp_full_match(token, '(?:(?:25[0-5]|2[0-4]\d|1?\d{1,2})\.){3}(?:25[0-5]|2[0-4]\d|1?\d{1,2})') THEN 'ip'
 WHEN regexp_full_match(token, '[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}', 'i') THEN 'user'
 WHEN length(token) >= 24 AND regexp_full_match(token, '[a-f0-9]+', 'i') THEN 'fingerprint'
 WHEN regexp_full_match(token, 'acc[_-][a-z0-9]{2,}', 'i') THEN 'user'
 WHEN regexp_matches(token, '^u[_-]?[a-z0-9]+$|^usr[_-]?\d+|^\d{6,}$', 'i') THEN 'user' ELSE 'other' END AS kind FROM tokens GROUP BY doc_id, token""",
)
def _(t):
    return X.entities_in_text(t.documents, "doc_id", "text")


# Every third human turn names a user, in one of three wordings.
MENTION = """ || CASE turn % 3 WHEN 0 THEN ' user id: "U_' || CAST(conv_id AS VARCHAR(20)) || '"' WHEN 1 THEN ' see u_' || CAST(conv_id * 100003 AS VARCHAR(20)) || ' now' ELSE '' END"""


@query(
    "extract_user_id_text",
    f"""WITH turns AS (SELECT conv_id, turn, text {MENTION} AS body FROM conversations WHERE role = 'user'),
named AS (SELECT conv_id, turn, coalesce(
 nullif(trim(regexp_extract(body, '\\buser[_\\s]*id[\\s:=]+[''"]?([^\\s''",)]+)', 1, 'i')), ''),
 nullif(trim(regexp_extract(body, '\\b(?:for|user)\\s+[''"]?([uU]_[a-zA-Z0-9_\\-:.]+)[''"]?', 1, 'i')), ''),
 nullif(trim(regexp_extract(body, '\\b([uU]_[a-zA-Z0-9_]{{4,}})\\b', 1)), ''),
 nullif(trim(regexp_extract(body, '\\b(?:account|acct)[_\\s]*id[\\s:=]+[''"]?([^\\s''",)]+)', 1, 'i')), '')) AS user_id FROM turns)
SELECT conv_id, arg_max(user_id, turn) AS user_id, max(turn) AS turn FROM named WHERE user_id IS NOT NULL GROUP BY conv_id""",
)
def _(t):
    turns = t.sql(f"SELECT conv_id, turn, role, text {MENTION} AS body FROM {{conversations}}", conversations=t.conversations)
    return X.user_id_per_conversation(turns, "conv_id", "turn", "role", "body")


@query(
    "fn_cosine",
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(t):
    nxt = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next_embedding"))
    pair = t.embeddings.join(nxt, "vec_id")
    return pair.select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("next_embedding")), 6).alias("similarity"))


@query(
    "fn_l2_normalize",
    """SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS dim,
 round(unnest(embedding)::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda v: v * v))), 6) AS weight FROM embeddings""",
)
def _(t):
    unit = t.embeddings.select("vec_id", F.posexplode(S.l2_normalize(F.col("embedding"))).alias("dim", "weight"))
    return unit.withColumn("weight", F.round("weight", 6))


CHUNK_SQL = r"""parts AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g'), '\n{2,}', chr(1), 'g'), '\n#', chr(1) || '#', 'g'), chr(1)),
 lambda p: regexp_replace(p, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g')), lambda p: p <> '') AS parts FROM documents),
pieces AS (SELECT doc_id, flatten(list_transform(parts, lambda p: list_transform(range(0, (length(p) - 1) // 900 + 1), lambda i: substr(p, i * 900 + 1, 900)))) AS pieces FROM parts),
folded AS (SELECT doc_id, list_reduce(list_transform(pieces, lambda p: {'buf': p, 'done': []::VARCHAR[]}), lambda acc, x:
 CASE WHEN length(acc.buf) + length(x.buf) + 2 <= 900 THEN {'buf': CASE WHEN acc.buf = '' THEN x.buf ELSE regexp_replace(acc.buf || chr(10) || chr(10) || x.buf, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g') END, 'done': acc.done}
 WHEN acc.buf = '' THEN {'buf': x.buf, 'done': acc.done}
 ELSE {'buf': regexp_replace(right(acc.buf, 150) || chr(10) || chr(10) || x.buf, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g'), 'done': list_append(acc.done, acc.buf)} END,
 {'buf': '', 'done': []::VARCHAR[]}) AS acc FROM pieces),
chunks AS (SELECT doc_id, CASE WHEN acc.buf = '' THEN acc.done ELSE list_append(acc.done, acc.buf) END AS chunks FROM folded),
chunk_rows AS (SELECT doc_id, CAST(generate_subscripts(chunks, 1) - 1 AS INT) AS chunk_index, unnest(chunks) AS text FROM chunks)"""


@query("fn_chunk_text", f"WITH {CHUNK_SQL} SELECT doc_id, chunk_index, length(text) AS n_chars, md5(text) AS digest FROM chunk_rows")
def _(t):
    return X.chunk_table(t.documents, "doc_id", "text").select(
        "doc_id", "chunk_index", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest")
    )


@query("fn_hour_of_day", "SELECT hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return t.events.groupBy(S.hour_of_day(F.col("ts")).alias("hour")).agg(F.count("*").alias("n"))


@query(
    "fn_truncate_ts",
    """SELECT event_id, date_trunc('minute', ts) AS minute, time_bucket(INTERVAL 5 MINUTE, ts) AS slot, date_trunc('hour', ts) AS hour, date_trunc('day', ts)::TIMESTAMP AS day FROM events""",
)
def _(t):
    ts = F.col("ts")
    return t.events.select(
        "event_id", S.truncate_ts(ts, "minute").alias("minute"), S.truncate_ts(ts, "5 minutes").alias("slot"),
        S.truncate_ts(ts, "hour").alias("hour"), S.truncate_ts(ts, "day").alias("day"),
    )


@query(
    "fn_array_ops",
    """SELECT p_partkey, len(w) AS n, len(list_distinct(w)) AS n_unique, w[1] AS head, w[4] AS fourth, array_to_string(w[1:2], '|') AS first_two, array_to_string(list_sort(w), ',') AS sorted
 FROM (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS w FROM part)""",
)
def _(t):
    w = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    return t.part.select(
        "p_partkey", F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("n_unique"), F.get(w, F.lit(0)).alias("head"),
        F.get(w, F.lit(3)).alias("fourth"), F.array_join(F.slice(w, 1, 2), "|").alias("first_two"), F.array_join(F.array_sort(w), ",").alias("sorted"),
    )


@query(
    "fn_json_snippet",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN replace(props, ' ', '') WHEN 1 THEN '{"value":' || CAST(event_id AS VARCHAR) || '}' ELSE '{"snippet":"bad ' || event_type || '"}' END AS raw_data FROM events""",
)
def _(t):
    n = F.col("event_id") % 3
    raw = F.when(n == 0, F.col("props")).when(n == 1, F.col("event_id").cast("string")).otherwise(F.concat(F.lit("bad "), "event_type"))
    return t.events.select("event_id", raw.alias("raw")).select("event_id", S.json_or_snippet(F.col("raw")).alias("raw_data"))


@query(
    "fn_clamp_score",
    "SELECT event_id, round(least(greatest(value / 100, 0.0), 1.0), 6) AS unit, round(least(greatest(value - 20, 0.0), 100.0), 6) AS gauge FROM events",
)
def _(t):
    return t.events.select(
        "event_id", F.round(S.clamp(F.col("value") / 100, 0, 1), 6).alias("unit"), F.round(S.clamp(F.col("value") - 20, 0, 100), 6).alias("gauge")
    )
