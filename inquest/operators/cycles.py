"""Payment cycles: strongly connected components, and simple cycles grown inside them from their least account."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquest.session import cut_lineage, replace_step

ARROW = " → "


def trim_to_core(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) whose ends both pay and get paid, again and again until nothing goes; every cycle is in them."""
    core = cut_lineage(edges.select("src", "dst").filter("src <> dst").distinct())
    left = core.count()
    while left:
        payers, payees = core.select("src").distinct(), core.select("dst").distinct()
        core = replace_step(core, core.join(payers.toDF("dst"), "dst", "left_semi").join(payees.toDF("src"), "src", "left_semi").select("src", "dst"))
        now = core.count()
        if now == left:
            break
        left = now
    return core


def strongly_connected(edges: DataFrame, src: str = "payer", dst: str = "payee") -> DataFrame:
    """(account, component, size): accounts on a cycle of two and more, by the least account that is on one with them.

    Least labels run forward along the edges until they rest: an account's label is the least one that reaches it, and
    whoever reaches the owner of the label backward inside its label is in the owner's component. Edges inside found components, between
    labels, and those that no cycle can use go, and the rest starts again. Edges of a hot account are
    no trouble: labels combine before the shuffle, and there is one label per account on the other side of each join.
    """
    left = trim_to_core(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")))
    found: list[DataFrame] = []
    while not left.isEmpty():
        state = cut_lineage(left.select(F.col("src").alias("v")).distinct().withColumns({"label": F.col("v"), "new": F.lit(True)}))
        # Only labels that have changed are sent on.
        while not state.filter("new").isEmpty():
            sent = left.join(state.filter("new").select(F.col("v").alias("src"), "label"), "src").groupBy(F.col("dst").alias("v")).agg(F.min("label").alias("got"))
            state = replace_step(state, state.join(sent, "v", "left").select("v", F.least("label", "got").alias("label"), F.coalesce(F.col("got") < F.col("label"), F.lit(False)).alias("new")))
        labels = cut_lineage(state.select("v", "label"))
        inside = left.join(labels.toDF("src", "label"), "src").join(labels.toDF("dst", "d_label"), "dst").filter("label = d_label")
        inside = cut_lineage(inside.select("src", "dst", "label"))
        back = cut_lineage(labels.select("v", (F.col("v") == F.col("label")).alias("reached"), (F.col("v") == F.col("label")).alias("new")))
        while not back.filter("new").isEmpty():
            hits = inside.join(back.filter("new").select(F.col("v").alias("dst")), "dst", "left_semi").select(F.col("src").alias("v")).distinct().withColumn("hit", F.lit(True))
            now = F.col("reached") | F.coalesce("hit", F.lit(False))
            back = replace_step(back, back.join(hits, "v", "left").select("v", now.alias("reached"), (now & ~F.col("reached")).alias("new")))
        own = cut_lineage(back.filter("reached").join(labels, "v").select("v", "label"))
        found.append(own)
        rest = inside.join(own.select(F.col("v").alias("src")), "src", "left_anti").join(own.select(F.col("v").alias("dst")), "dst", "left_anti")
        left = trim_to_core(rest)
    if not found:
        kind = edges.schema[src].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"account {kind}, component {kind}, size long")
    members = reduce(DataFrame.unionByName, found).toDF("account", "component")
    sizes = members.groupBy("component").agg(F.count("*").alias("size")).filter("size > 1")
    return cut_lineage(members.join(sizes, "component").select("account", "component", "size"))


def circular_payments(edges: DataFrame, min_len: int = 2, max_len: int = 12, max_cycles: int | None = None) -> DataFrame:
    """(cycle_length, path, accounts, truncated), each cycle once, written from its least account.

    A path only visits accounts of one strongly connected component above its start, so no cycle is found twice. The
    search stops when no open path is left. ``truncated`` is true if it stopped at ``max_len`` before, or if
    ``max_cycles``, which keeps the shortest, then first in order, left some out.
    """
    spark = edges.sparkSession
    comp = strongly_connected(edges).select("account", "component")
    pairs = edges.select(F.col("payer").alias("src"), F.col("payee").alias("dst")).filter("src <> dst").distinct()
    pairs = pairs.join(comp.toDF("src", "a"), "src").join(comp.toDF("dst", "b"), "dst").filter("a = b")
    core = cut_lineage(pairs.select("src", "dst"))
    step = core.select(F.col("src").alias("last"), F.col("dst").alias("next"))
    paths = core.filter("dst > src").select(F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("accounts"))
    found, cut = [], False
    for length in range(2, max_len + 1):
        grown = cut_lineage(
            paths.join(step, "last").filter((F.col("next") == F.col("start")) | ((F.col("next") > F.col("start")) & ~F.array_contains("accounts", F.col("next"))))
        )
        if length >= min_len:
            found.append(grown.filter("next = start").select(F.lit(length).alias("cycle_length"), "accounts"))
        open_paths = grown.filter("next <> start")
        if open_paths.isEmpty():
            break
        cut = length == max_len
        paths = open_paths.select("start", F.col("next").alias("last"), F.concat("accounts", F.array("next")).alias("accounts"))
    if not found:
        return spark.createDataFrame([], "cycle_length int, path string, accounts array<string>, truncated boolean")
    cycles = reduce(DataFrame.unionByName, found)
    path = F.array_join(F.concat("accounts", F.slice("accounts", 1, 1)), ARROW)
    out = cycles.select("cycle_length", path.alias("path"), "accounts")
    if max_cycles:
        more = cycles.agg(F.count("*") > max_cycles).scalar()
        return out.orderBy("cycle_length", "path").limit(max_cycles).withColumn("truncated", more | F.lit(cut))
    return out.withColumn("truncated", F.lit(cut))


def cycles_per_account(cycles: DataFrame) -> DataFrame:
    return cycles.select(F.explode("accounts").alias("account")).groupBy("account").agg(F.count("*").alias("cycles"))
