"""URL filters: host-suffix and path-prefix expressions, joined to rules by short digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.llm.common import ascii_lower

#: Hex digits of the digest that the join key keeps: 32 bits, as in public safe-browsing lists.
KEY_DIGITS = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def compile_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their digests. Rows without a host or a verdict say nothing and go; a null path is empty.

    Of repeated rules one is kept; if the same host and path are both allowed and blocked, block holds.
    """
    rules = rules.filter("host IS NOT NULL AND verdict IS NOT NULL")
    host, path = ascii_lower(F.col("host")), F.coalesce("path", F.lit(""))
    rules = rules.select(host.alias("r_host"), path.alias("r_path"), "verdict")
    rules = rules.groupBy("r_host", "r_path").agg(F.max("verdict").alias("r_verdict"))
    digest = _digest(F.col("r_host"), F.col("r_path"))
    return rules.select("r_host", "r_path", "r_verdict", digest.alias("r_digest"), F.substring(digest, 1, KEY_DIGITS).alias("r_key"))


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """All (host suffix, path prefix) pairs that a rule could have, with ``lengths`` the path lengths of the rules."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = F.array(*(F.lit(n) for n in lengths)).cast("array<int>")
    prefixes = F.transform(F.filter(known, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _digest(s, p))))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", prefix: str = "u_") -> DataFrame:
    """All columns of ``pages`` and, named with ``prefix``, host, path, rule (null if none fits) and verdict.

    A rule fits its host and all subdomains, if the path starts with the rule's. The longest rule text wins; of equally
    long ones the one with the longer host. Null urls and urls without ``://`` have an empty host and path and get
    ``default`` unless a rule has an empty host. Repeated rows are judged one by one; an empty table gives an empty
    result. The join is by 32-bit keys, so the digests are compared too. Only path lengths that some rule has are
    expanded, and there are no more of those than a path has characters.
    """
    book = compile_rules(rules)
    lengths = sorted(r[0] for r in book.select(F.length("r_path")).distinct().collect())
    host, path = host_of(F.col(f"`{url}`")), path_of(F.col(f"`{url}`"))
    rows = pages.select(F.struct(*(pages[f"`{c}`"] for c in pages.columns)).alias("page"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("id", F.monotonically_increasing_id())
    asked = rows.withColumn("digest", F.explode_outer(expressions(F.col("host"), F.col("path"), lengths)))
    hits = asked.join(book, (F.substring("digest", 1, KEY_DIGITS) == F.col("r_key")) & (F.col("digest") == F.col("r_digest")), "left")
    best = F.max(
        F.when(
            F.col("r_key").isNotNull(),
            F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")),
        )
    )
    judged = hits.groupBy("id").agg(F.first("page").alias("page"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
    return judged.select(
        *(F.col("page").getField(c).alias(c) for c in pages.columns),
        F.col("host").alias(f"{prefix}host"),
        F.col("path").alias(f"{prefix}path"),
        F.col("best.rule").alias(f"{prefix}rule"),
        F.coalesce("best.verdict", F.lit(default)).alias(f"{prefix}verdict"),
    )
