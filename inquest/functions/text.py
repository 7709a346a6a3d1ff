"""Extraction from free text: identifiers, entities and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# A word edge between ASCII letters, digits and underscore only. Java's own ``\\b``
# counts accented letters in some releases and not in others.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def ascii_edges(pattern: str) -> str:
    return pattern.replace(r"\b", EDGE)


# How transaction and order ids are written, with the group to keep.
TXN_RULES = (
    (r"(?i)transaction\s*(?:id|#|number|no\.?)\s*[:#]?\s*([A-Za-z0-9][A-Za-z0-9_-]{5,40})", 1),
    (r"(?i)order\s*(?:id|#|number)\s*[:#]?\s*([A-Za-z0-9][A-Za-z0-9_-]{5,40})", 1),
    (r"(?i)txn\s*(?:id|#)?\s*[:#]?\s*([A-Za-z0-9][A-Za-z0-9_-]{5,40})", 1),
    (r"(?i)\b(?:chb|cb)-[A-Z0-9]{6,24}\b", 0),
    (r"(?i)\b(?:ord|txn)[_-][A-Z0-9]{8,32}\b", 0),
)
# Entity tokens in prose, and how a token is classified.
IPV4 = r"(?:(?:25[0-5]|2[0-4]\d|1?\d{1,2})\.){3}(?:25[0-5]|2[0-4]\d|1?\d{1,2})"
UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"
ENTITY_TOKEN = (
    rf"(?i)\b{IPV4}\b|{UUID}\b|\b[a-f0-9]{{24,128}}\b|\bacc[_-][a-z0-9]{{2,}}\b|\bu[_-]?[a-z0-9]{{4,}}\b"
)
# How a user id is named in a message, strongest form first.
USER_ID_RULES = (
    r"""(?i)\buser[_\s]*id[\s:=]+['"]?([^\s'",)]+)""",
    r"""(?i)\b(?:for|user)\s+['"]?([uU]_[a-zA-Z0-9_\-:.]+)['"]?""",
    r"""\b([uU]_[a-zA-Z0-9_]{4,})\b""",
    r"""(?i)\b(?:account|acct)[_\s]*id[\s:=]+['"]?([^\s'",)]+)""",
)
# Fixed value: a chunk may start after a blank line or at a heading.
CHUNK_BREAK = r"\n{2,}|\n(?=#)"


def txn_id_candidates(docs: DataFrame, doc_id: str, body: str, limit: int | None = None) -> DataFrame:
    """One row per transaction id found: (doc_id, position, txn_id).

    Ids are taken rule by rule, 6 to 48 characters, first spelling of each kept.
    The matches of a text are exploded, so the dedupe is a keyed aggregate and
    not a scan inside one array.
    """
    found = F.concat(*[F.regexp_extract_all(F.col(body), F.lit(ascii_edges(rule)), F.lit(group)) for rule, group in TXN_RULES])
    rows = docs.select(doc_id, F.posexplode(found).alias("at", "raw"))
    rows = rows.select(doc_id, "at", F.trim("raw").alias("txn_id")).filter(F.length("txn_id").between(6, 48))
    first = rows.groupBy(doc_id, F.lower("txn_id").alias("folded")).agg(
        F.min("at").alias("at"), F.min_by("txn_id", "at").alias("txn_id")
    )
    position = F.row_number().over(W.partitionBy(doc_id).orderBy("at"))
    out = first.select(doc_id, position.alias("position"), "txn_id")
    return out.filter(F.col("position") <= limit) if limit else out


def entity_kind(token: Column) -> Column:
    return (
        F.when(token.rlike(rf"^{IPV4}$"), F.lit("ip"))
        .when(token.rlike(rf"(?i)^{UUID}$"), F.lit("user"))
        .when((F.length(token) >= 24) & token.rlike(r"(?i)^[a-f0-9]+$"), F.lit("fingerprint"))
        .when(token.rlike(r"(?i)^acc[_-][a-z0-9]{2,}$"), F.lit("user"))
        .when(token.rlike(r"(?i)^u[_-]?[a-z0-9]+$|^usr[_-]?\d+|^\d{6,}$"), F.lit("user"))
        .otherwise(F.lit("other"))
    )


def entities_in_text(docs: DataFrame, doc_id: str, body: str) -> DataFrame:
    """(doc_id, token, kind, hits) for every entity token of every text."""
    tokens = docs.select(doc_id, F.explode(F.regexp_extract_all(F.col(body), F.lit(ascii_edges(ENTITY_TOKEN)), F.lit(0))).alias("token"))
    return tokens.groupBy(doc_id, "token").agg(F.count("*").alias("hits")).withColumn("kind", entity_kind(F.col("token")))


def user_id_in_text(body: Column) -> Column:
    """The id by the strongest rule that matches, else null."""
    hits = [F.nullif(F.trim(F.regexp_extract(body, ascii_edges(rule), 1)), F.lit("")) for rule in USER_ID_RULES]
    return F.coalesce(*hits)


def user_id_per_conversation(turns: DataFrame, conv: str, turn: str, role: str, body: str, human: str = "user") -> DataFrame:
    """The id named in the latest human turn that names one."""
    named = turns.filter(F.col(role) == human).select(conv, turn, user_id_in_text(F.col(body)).alias("user_id"))
    return named.filter(F.col("user_id").isNotNull()).groupBy(conv).agg(
        F.max_by("user_id", turn).alias("user_id"), F.max(turn).alias("turn")
    )


def strip(c: Column) -> Column:
    """Without white space at both ends (``trim`` would take blanks only)."""
    return F.regexp_replace(c, r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", "")


def chunk_array(body: Column, max_chars: int = 900, overlap: int = 150) -> Column:
    """Chunks of a text as an array: paragraphs packed up to ``max_chars``, the
    last ``overlap`` characters of a chunk repeated at the head of the next.

    A paragraph longer than ``max_chars`` is cut into pieces, so no text is lost;
    a chunk holds at most one carried overlap and one full piece.
    """
    parts = F.filter(F.transform(F.split(strip(body), CHUNK_BREAK), strip), lambda p: p != "")
    pieces = F.flatten(
        F.transform(
            parts,
            lambda p: F.transform(
                F.sequence(F.lit(0), F.floor((F.length(p) - 1) / max_chars).cast("int")),
                lambda i: F.substring(p, i * max_chars + 1, F.lit(max_chars)),
            ),
        )
    )
    start = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, piece: Column) -> Column:
        buf = acc["buf"]
        fits = F.length(buf) + F.length(piece) + 2 <= max_chars
        tail = F.when(F.length(buf) > overlap, F.substring(buf, -overlap, overlap)).otherwise(buf)
        joined = lambda head: F.when(head == "", piece).otherwise(strip(F.concat(head, F.lit("\n\n"), piece)))
        return F.struct(
            F.when(fits, joined(buf)).otherwise(joined(tail)).alias("buf"),
            F.when(fits | (buf == ""), acc["done"]).otherwise(F.array_append(acc["done"], buf)).alias("done"),
        )

    return F.aggregate(
        pieces, start, step, lambda acc: F.when(acc["buf"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["buf"]))
    )


def chunk_table(docs: DataFrame, source: str, body: str, max_chars: int = 900, overlap: int = 150) -> DataFrame:
    """(source, chunk_index, text): one row per chunk."""
    return docs.select(source, F.posexplode(chunk_array(F.col(body), max_chars, overlap)).alias("chunk_index", "text"))
