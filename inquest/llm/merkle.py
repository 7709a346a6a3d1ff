"""Merkle manifest of a dataset: one root for all rows, and for each row the hashes that lead from it to the root.

Rows are leaves. The leaves of a group, in order, are cut into runs of ``FANOUT``; a run becomes a parent whose hash is
that of its children's hashes put together, level by level until one node is left: the group's subroot. The subroots,
in the order of their groups, make the root in the same way.

Slot pivot: a parent is a row with one column per slot, filled by conditional aggregates over its children, so no list
of children is collected. All slot columns put together are what the parent hashes; without a child's own column they
are that child's siblings. On the way down a parent hands the siblings on to its children; a leaf's path is as long as
the tree is high, whatever the number of rows. Only hashes are shuffled, never the rows themselves, and a group of any
size is spread over its runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.llm.common import ascii_lower, land, scratch
from inquest.llm.sharding import with_row_numbers

FANOUT = 8
SLOTS = [f"s{k}" for k in range(FANOUT)]
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"
ROOT = "root"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts put together; null parts are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field_text(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return digest(*(field_text(c) for c in fields))


def _whole(x: Column, n: int = FANOUT) -> Column:
    return F.floor(x / n).cast("long")


def parents(nodes: DataFrame) -> DataFrame:
    """(g, run, s0 to s7, n) of nodes (g, i, h, n): children of a run in their slots; n is the number of runs of the group."""
    slot = F.col("i") % FANOUT
    spread = nodes.groupBy("g", _whole(F.col("i")).alias("run")).agg(*(F.max(F.when(slot == k, F.col("h"))).alias(s) for k, s in enumerate(SLOTS)), F.max("n").alias("n"))
    return spread.withColumn("n", F.ceil(F.col("n") / FANOUT).cast("long"))


def sibling_step(slot: Column) -> Column:
    """What stands left and right of a slot in its run: the slot columns without its own."""
    left = F.concat_ws("", *(F.when(slot > k, F.col(s)) for k, s in enumerate(SLOTS)))
    right = F.concat_ws("", *(F.when(slot < k, F.col(s)) for k, s in enumerate(SLOTS)))
    return F.struct(left.alias("left"), right.alias("right"))


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf hash and its path lead to."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def path_digest(path: Column) -> Column:
    """Hash of all siblings, level by level from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def grow(nodes: DataFrame, folder: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels of parents from nodes (g, i, h, n) upward, and the top hash (g, top) of each group.

    A group whose single node is left takes no part in higher levels. There are as many levels as the largest group needs.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops, now = [], [nodes.filter("n = 1").select("g", F.col("h").alias("top"))], nodes
    while most > 1:
        level = land(parents(now.filter("n > 1")), f"{folder}/level-{len(levels)}")
        levels.append(level)
        now = level.select("g", F.col("run").alias("i"), digest(*map(F.col, SLOTS)).alias("h"), "n")
        tops.append(now.filter("n = 1").select("g", F.col("h").alias("top")))
        most = -(-most // FANOUT)
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return levels, top


def descend(levels: list[DataFrame], top_paths: DataFrame, folder: str) -> DataFrame | None:
    """Runs of the lowest level (g, run, s0 to s7, path): ``path`` leads from the run's parent to the root.

    ``top_paths`` (g, path) goes on from the top node of each group.
    """
    above = None
    for depth in reversed(range(len(levels))):
        level = levels[depth]
        ends = level.filter("n = 1").join(top_paths, level["g"].eqNullSafe(top_paths["g"])).select(level["g"], "run", *SLOTS, "path")
        if above is not None:
            inner = level.filter("n > 1").select(F.col("g").alias("c_g"), F.col("run").alias("c_run"), *(F.col(s).alias(f"c_{s}") for s in SLOTS))
            on = F.col("c_g").eqNullSafe(F.col("g")) & (_whole(F.col("c_run")) == F.col("run"))
            path = F.concat(F.array(sibling_step(F.col("c_run") % FANOUT)), "path")
            inner = inner.join(above, on).select(F.col("c_g").alias("g"), F.col("c_run").alias("run"), *(F.col(f"c_{s}").alias(s) for s in SLOTS), path.alias("path"))
            ends = ends.unionByName(inner)
        above = land(ends, f"{folder}/down-{depth}") if depth else ends
    return above


@dataclass(frozen=True)
class Manifest:
    """``rows``: the carried columns, g, i, leaf, subroot and path. ``root``: the root's hash, null for an empty table."""

    rows: DataFrame
    root: str | None


def build_manifest(leaves: DataFrame, group: str, order: list[str], leaf: str) -> Manifest:
    """Tree over the rows of ``leaves``, which has the hash ``leaf`` and is ordered in each ``group`` by ``order``.

    Groups are ordered bytewise, null first, and null is a group of its own. Nulls of the order columns come last; rows
    that are equal in group and order may swap places. Names of other columns must not be those of ``Manifest``.
    """
    folder = scratch(leaves.sparkSession, "manifest")
    taken = {"g", "i", "n", "run", "path", "subroot", *SLOTS, *(f"c_{s}" for s in SLOTS)} & set(leaves.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} exist; rename them")
    numbered = with_row_numbers(leaves.withColumn("g", F.col(f"`{group}`").cast("string")), ["g", *order], "i")
    numbered = land(numbered, f"{folder}/numbered")
    sizes = numbered.groupBy("g").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    # One row per group meets here; subroots are numbered as rows are, so there may be many groups.
    sizes = land(sizes.withColumnRenamed("g", "s_g"), f"{folder}/sizes")
    placed = numbered.join(sizes, F.col("g").eqNullSafe(F.col("s_g"))).withColumn("i", F.col("i") - F.col("first")).drop("s_g", "first")
    placed = land(placed, f"{folder}/placed")

    levels, tops = grow(placed.select("g", "i", F.col(leaf).alias("h"), "n"), folder)
    tops = land(tops, f"{folder}/subroots")
    count = tops.count()
    if not count:
        return Manifest(placed.select(*leaves.columns, "g", "i", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast(PATH).alias("path")), None)
    # Null goes first: an empty string in front of the name keeps an empty name apart from null.
    ranked = with_row_numbers(tops.withColumn("k", F.coalesce(F.concat(F.lit("1"), "g"), F.lit("0"))), ["k"], "i")
    ranked = land(ranked.select(F.col("g").alias("name"), F.lit(ROOT).alias("g"), "i", F.col("top").alias("h"), F.lit(count).cast("long").alias("n")), f"{folder}/ranked")
    over, root = grow(ranked, f"{folder}/groups")
    root = root.first()["top"]
    start = leaves.sparkSession.createDataFrame([(ROOT, [])], f"g string, path {PATH}")
    group_paths = _with_paths(ranked.withColumn("leaf", F.col("h")), over, start, f"{folder}/groups")
    group_paths = land(group_paths.select(F.col("name").alias("g"), "path", F.col("leaf").alias("subroot")), f"{folder}/paths")
    rows = _with_paths(placed, levels, group_paths.select("g", "path"), folder)
    subroots = group_paths.select(F.col("g").alias("p_g"), "subroot")
    rows = rows.join(subroots, F.col("g").eqNullSafe(F.col("p_g"))).select(*leaves.columns, "g", "i", "subroot", "path")
    return Manifest(rows, root)


def _with_paths(nodes: DataFrame, levels: list[DataFrame], top_paths: DataFrame, folder: str) -> DataFrame:
    """Nodes (g, i, n, ...) with their path to the root; each run meets its at most eight nodes."""
    single = nodes.filter("n = 1").join(top_paths.withColumnRenamed("g", "t_g"), F.col("g").eqNullSafe(F.col("t_g"))).drop("t_g")
    runs = descend(levels, top_paths, folder)
    if runs is None:
        return single
    runs = runs.withColumnsRenamed({"g": "r_g", "path": "r_path"})
    on = F.col("g").eqNullSafe(F.col("r_g")) & (_whole(F.col("i")) == F.col("run"))
    path = F.concat(F.array(sibling_step(F.col("i") % FANOUT)), "r_path")
    many = nodes.filter("n > 1").join(runs, on).withColumn("path", path).drop("r_g", "run", "r_path", *SLOTS)
    return single.unionByName(many)


def verify_documents(docs: DataFrame, fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id", group: str = "lang", text: str = "text") -> DataFrame:
    """Manifest of documents and a tampering trial: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, tampered_leaf.

    A leaf is the hash of the ``fields`` of a row. Rows are leaves of their own, also when they are equal; in a group they
    ascend by id (null last), rows of one id by leaf. Where 3 divides the CRC-32 of the id as text, the text is
    tampered with: A-Z become a-z, and the fold starts at the leaf of that (``tampered_leaf``, else null). Null texts stay, rows
    without an id are not tampered with. The siblings are always those of the original. Columns that are not fields are not
    read. An empty table gives an empty result.
    """
    plain = {c: F.col(f"`{c}`") for c in fields}
    other = {**plain, text: ascii_lower(plain[text])}
    chosen = F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % 3 == 0, F.lit(False))
    leaves = docs.select(
        F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{group}`").alias("of"), leaf_hash([plain[c] for c in fields]).alias("leaf"),
        F.when(chosen, leaf_hash([other[c] for c in fields])).alias("tampered_leaf"),
    )
    # The texts are read once: what follows, the sampling of ranges included, starts from the hashes.
    leaves = land(leaves, scratch(docs.sparkSession, "leaves"))
    made = build_manifest(leaves, "of", ["doc", "leaf"], "leaf")
    root = F.lit(made.root).cast("string")
    folded = fold(F.col("path"), F.coalesce("tampered_leaf", "leaf"))
    rows = made.rows.select(
        F.col("doc").alias("doc_id"), "leaf", "subroot", root.alias("root"), path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"), "tampered_leaf"
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
