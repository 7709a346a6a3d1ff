"""The corpus queries by name, each over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inquest.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def corpus_query(key: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn

    return wrap


_WORDS_SQL = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _quality_sql() -> str:
    from inquest.llm.quality import STOP_WORDS

    stops = ", ".join("'" + x + "'" for x in sorted({x for group in STOP_WORDS.values() for x in group}))
    langs = ", ".join(f"'{x}'" for x in STOP_WORDS)
    return rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, {_WORDS_SQL} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
grams AS (
  SELECT r, i, w[i:i+2] AS g, count(*) OVER (PARTITION BY r, w[i:i+2]) AS n FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM base)),
cover AS (
  SELECT r, sum(least(3, coalesce(nxt - i, 3))) AS k FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM grams WHERE n > 1) GROUP BY r),
counts AS (
  SELECT b.r, doc_id, lang IS NULL OR lang IN ({langs}) AS listed, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(k, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
    len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stops, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letters
  FROM base b LEFT JOIN cover c ON b.r = c.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars / greatest(n_words, 1) NOT BETWEEN 1.5 AND 20
    OR n_symbols / greatest(n_words, 1) > 0.3 OR (listed AND n_stops / greatest(n_words, 1) < 0.02)
    OR n_dup_lines / greatest(n_lines, 1) > 0.5 OR n_letters / greatest(n_words, 1) < 0.6) AS kept
FROM counts"""


@corpus_query("op6_quality_rules", _quality_sql())
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    from inquest.llm.quality import quality_report

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    report = quality_report(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return report.select("doc_id", *(F.col(f"q_{x}").alias(x) for x in names))


#: Rules of the URL query: host, path, verdict.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_URL_SQL = r"""
WITH rules(h, p, v) AS (VALUES {rules}),
parts AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS u, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
hits AS (
  SELECT r, max_by(h || p, [length(h || p), length(h)]) AS rule, max_by(v, [length(h || p), length(h)]) AS v
  FROM cut JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM cut LEFT JOIN hits USING (r)
""".format(rules=", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES))


@corpus_query("op9_url_filters", _URL_SQL)
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    from inquest.llm.urlrules import judge_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", *(F.col(f"u_{x}").alias(x) for x in ("host", "path", "rule", "verdict")))


SHARDS = 16


def _sharding_sql() -> str:
    from inquest.llm.permute import permuted_sql
    from inquest.llm.sharding import SEED

    placed = permuted_sql("r", "n", str(SEED), "rows", "doc_id, size, bytes")
    return f"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
rows AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes,
    row_number() OVER (ORDER BY doc_id NULLS LAST) - 1 AS r, count(*) OVER () AS n FROM documents),
placed AS ({placed})
SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)::BIGINT AS text_crc32,
  'rows' AS law, (place % {SHARDS})::INT AS shard, (place // {SHARDS})::INT AS slot, NULL::INT AS grown_shard
FROM placed, crc_table"""


@corpus_query("op4_sharding", _sharding_sql())
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document by the law of equal row counts."""
    from inquest.llm.sharding import shard_rows

    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = shard_rows(docs, SHARDS, ("doc_id", "text_crc32", "size"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _mixing_sql() -> str:
    from inquest.llm.mixing import BLOCK_WORDS as B
    from inquest.llm.permute import permuted_sql

    placed = permuted_sql("slot % blocks", "blocks", "7 + rank * 1009 + slot // blocks * 104729", "slots", "rank")
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, len({_WORDS_SQL})::BIGINT AS size FROM documents),
sized AS (
  SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM docs GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS weight, (size * 2)::DOUBLE AS most FROM sized),
levels AS (
  SELECT *, ((sum(size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM weighed),
free AS (SELECT level AS v FROM levels WHERE level * weight < most ORDER BY most / weight, rank LIMIT 1),
targets AS (SELECT *, coalesce(least((SELECT v FROM free) * weight, most), most) AS target, (size + {B - 1}) // {B} AS blocks FROM levels),
quotas AS (SELECT *, least(coalesce(round(target * blocks / nullif(size, 0)), 0)::BIGINT, blocks * 2) AS quota FROM targets),
slots AS (SELECT rank, blocks, unnest(range(quota)) AS slot FROM quotas),
uses AS (SELECT rank, place AS block, count(*) AS uses FROM ({placed}) GROUP BY ALL),
starts AS (
  SELECT r, doc_id, d.source, d.size, rank, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM docs d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source),
pieces AS (SELECT *, unnest(range(a // {B}, (a + size - 1) // {B} + 1)) AS block FROM starts WHERE size > 0),
taken AS (
  SELECT r, sum((least(a + size - 1, (block + 1) * {B} - 1) - greatest(a, block * {B}) + 1) * uses)::BIGINT AS taken FROM pieces JOIN uses USING (rank, block) GROUP BY r)
SELECT doc_id, s.size, q.size AS source_size, q.target, coalesce(taken, 0) AS taken
FROM starts s JOIN quotas q USING (rank) LEFT JOIN taken USING (r)"""


@corpus_query("op2_source_mixing", _mixing_sql())
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target of each document's source and the words that the mix takes from the document."""
    from inquest.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


_DECONTAM_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, w[i:i + least(len(w), 10) - 1] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM items WHERE len(w) > 0)),
spots AS (
  SELECT r, i, k, w[i:i + k - 1] AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM wins))),
found AS (SELECT r, i, k, item_id FROM spots JOIN wins USING (k, g)),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r),
ids AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS l FROM found GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)"""


@corpus_query("op10_benchmark_decontamination", _DECONTAM_SQL)
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie inside ten-word windows of benchmark items."""
    from inquest.llm.decontam import contamination

    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@corpus_query("op1_simhash_near_dedup")
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    from inquest.llm.simhash import near_duplicates

    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_SUBSTRING_SQL = r"""
WITH docs AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
wins AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM wins) WHERE k > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM again) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (
  SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.p) AS t
  FROM words LEFT JOIN (SELECT doc_id, unnest(ps) AS p FROM gone) g ON words.doc_id = g.doc_id AND words.p = g.p WHERE g.p IS NULL GROUP BY words.doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)"""


@corpus_query("op5_substring_dedup", _SUBSTRING_SQL)
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the words of repeated windows of 20 words."""
    from inquest.llm.substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@corpus_query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenize all documents, write the files, and read start, count and checksum of each document from them."""
    import public_tokenizers

    from inquest.llm.common import scratch
    from inquest.llm.tokenfile import read_tokens, write_tokens

    path = scratch(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return read_tokens(spark, path, digest=True)


@corpus_query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by a model of the labelled ones that are not held out."""
    from inquest.llm.toxicity import is_held_out, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model, prefix="t_")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("t_score").alias("score"), F.col("t_predicted").alias("predicted"))


@corpus_query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from inquest.llm.extraction import extract

    texts = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


_CRC_TABLE_SQL = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def _merkle_sql(levels: int = 7, group_levels: int = 3) -> str:
    """Trees of at most 8 ** levels leaves a language, and as many languages as three levels hold."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, n: int) -> str:
        steps = []
        for k in range(n):
            run = f"PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN"
            steps.append(f"""
{name}_side{k} AS (
  SELECT g, i, n, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,
    CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r FROM {name}{k}),
{name}{k + 1} AS (
  SELECT g, i // 8 AS i, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h, (max(n) + 7) // 8 AS n FROM {name}{k} GROUP BY ALL)""")
        return ",".join(steps)

    def climb(name: str, n: int, at: str, key: str, start: str) -> str:
        steps = []
        for k in range(n):
            steps.append(f"""
{start}{k + 1} AS (
  SELECT a.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.l || fold || s.r) ELSE fold END AS fold, proof || s.l || s.r AS proof)
  FROM {start}{k} a JOIN {name}_side{k} s ON s.g IS NOT DISTINCT FROM a.{key} AND s.i = a.{at} // {8**k})""")
        return ",".join(steps)

    return f"""
WITH crc_table AS (SELECT {_CRC_TABLE_SQL} AS t),
docs AS (
  SELECT doc_id, lang, {leaf('text')} AS leaf, {leaf(lower)} AS low,
    list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
leaves AS (
  SELECT doc_id, lang, leaf, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS i,
    CASE WHEN doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 3 = 0 THEN low ELSE leaf END AS start
  FROM docs, crc_table),
doc0 AS (SELECT lang AS g, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaves),{tree('doc', levels)},
top0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n, g AS lang FROM doc{levels}),
lang0 AS (SELECT g, i, h, n FROM top0),{tree('lang', group_levels)},
up0 AS (SELECT *, start AS fold, '' AS proof FROM leaves),{climb('doc', levels, 'i', 'lang', 'up')},
over0 AS (SELECT u.*, top0.i AS k, 0 AS one, top0.h AS subroot FROM up{levels} u JOIN top0 ON top0.lang IS NOT DISTINCT FROM u.lang),{climb('lang', group_levels, 'k', 'one', 'over')}
SELECT doc_id, leaf, subroot, top.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = top.h AS verified FROM over{group_levels}, lang{group_levels} AS top"""


@corpus_query("op13_merkle_manifest", _merkle_sql())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that a tampered third of them leads to."""
    from inquest.llm.merkle import verify_documents

    return verify_documents(table(spark, sf_dir, "documents")).drop("tampered_leaf")


_LEXICAL_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex({text}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex({text}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark),
total AS (SELECT count(*)::BIGINT AS N, sum(len(w))::BIGINT AS L FROM docs WHERE len(w) > 0),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
parts AS (
  SELECT item_id, tf.r, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(w) * N) // L))) AS part
  FROM items JOIN tf USING (term) JOIN df USING (term) JOIN docs ON docs.r = tf.r, total),
scores AS (SELECT item_id, r, sum(part)::BIGINT AS score FROM parts GROUP BY ALL HAVING sum(part) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
FROM scores JOIN docs USING (r) QUALIFY rank <= 50""".replace("{text}", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


@corpus_query("op12_lexical_search", _LEXICAL_SQL)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents for each benchmark item."""
    from inquest.llm.lexical import build_index, search

    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_NEAR_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
grams AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT r, count(*)::BIGINT AS n FROM grams GROUP BY r),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes s ON s.r = x JOIN sizes t ON t.r = y WHERE 100 * k >= 85 * (s.n + t.n - k)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT r AS v, r AS x FROM docs UNION SELECT reach.v, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.x),
least AS (SELECT v, min(doc_id) AS component_id FROM reach JOIN docs ON docs.r = reach.x GROUP BY v)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM docs JOIN least ON least.v = docs.r LEFT JOIN sizes ON sizes.r = docs.r"""


@corpus_query("op11_hyperminhash_near_dedup", _NEAR_SQL)
def op11_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set and near-duplicate class of every document."""
    from inquest.llm.hyperminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))
