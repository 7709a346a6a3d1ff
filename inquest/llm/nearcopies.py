"""One document of each group of near copies: texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

Candidates come from method 1 (SimHash fingerprints, anchors, links of at most 3 differing bits) and, since most pairs at 0.8
differ in more bits than that, from the bands of ``hyperminhash.near_classes`` at its own limit: a pair at 0.8 is compared
with a chance of all but 3 in a million. Every link, of either kind, is confirmed on full sets: of method 1 first those that span,
then all pairs that meet at an anchor and are not connected yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquest.llm.common import land, row_keys, scratch
from inquest.llm.hyperminhash import CHUNK, near_classes

#: Least similarity, as a fraction.
SIMILARITY = (4, 5)


def keep_one_copy(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """One document of each group of near copies, the one with the least id, with its own columns.

    A group is what links of at least ``similarity`` connect; words are runs without ASCII white space, A-Z as a-z. Texts
    without words (null or empty) are one group. Rows without an id come after those with one, rows that share an id in
    the order of a hash. Of rows that are equal in id and text one stays, the least in its other columns.
    """
    folder, names = scratch(docs.sparkSession, "copies"), ["".join(docs.columns) + x for x in ("_a", "_b")]
    first, second = row_keys(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    rows = docs.withColumns({names[0]: first, names[1]: second})
    key = F.struct(F.col(f"`{doc_id}`").isNull().alias("none"), F.col(f"`{doc_id}`").alias("doc"), F.col(names[0]).alias("a"), F.col(names[1]).alias("b"))
    found = near_classes(rows.select(key.alias("key"), F.col(names[0]).alias("a"), F.col(names[1]).alias("b"), F.col(f"`{text}`").alias("text")), similarity, chunk, fingerprints=True)
    wordless = found.marked.filter("size = 0").agg(F.min("key.key").alias("least")).filter("least IS NOT NULL")
    kept = found.named.select("least").distinct().unionByName(wordless).select(F.col("least.a").alias("kept_a"), F.col("least.b").alias("kept_b"))
    times = found.marked.groupBy(F.col("key.a").alias("kept_a"), F.col("key.b").alias("kept_b")).agg(F.count("*").alias("times"))
    kept = land(kept.join(times, ["kept_a", "kept_b"]), f"{folder}/kept")
    same = (rows[names[0]] == F.col("kept_a")) & (rows[names[1]] == F.col("kept_b"))
    once = rows.join(kept.filter("times = 1"), same, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
    repeated = rows.join(land(kept.filter("times > 1"), f"{folder}/repeated"), same, "left_semi")
    least = repeated.groupBy(*names).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("row"))
    return once.unionByName(least.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)))
