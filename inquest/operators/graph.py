"""Fraud-ring graph: shared values, payments and staff touches as edges; degrees, roles, reports.

Accounts that share a value are tied to a vertex for that value ("hub"), never to
each other: n accounts give n edges. Everything that the pairs would tell, group
sizes, co-member counts, components, communities, is computed from the hubs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inquest.functions.scalar import clean_key, stable_id
from inquest.operators.keyed import top_per_key
from inquest.operators.neighbours import neighbour_counts
from inquest.operators.relational import employee_account_touches, payment_edges
from inquest.roles import ColumnRoles
from inquest.session import cut_lineage

# Sizes of a shared-value group that raise an alert.
ALERT_HIGH = 10
ALERT_CRITICAL = 50


def shared_values(df: DataFrame, account: str, kinds: dict[str, str]) -> DataFrame:
    """(kind, value, account, group_size) for values with two accounts and more; all kinds in one pass."""
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), clean_key(F.col(c)).alias("value")) for k, c in kinds.items()])
    long = df.select(clean_key(F.col(account)).alias("account"), F.explode(cells).alias("c")).select("account", "c.kind", "c.value")
    pairs = long.filter("account IS NOT NULL AND value IS NOT NULL").distinct()
    sizes = pairs.groupBy("kind", "value").agg(F.count("*").alias("group_size")).filter("group_size >= 2")
    return pairs.join(sizes, ["kind", "value"]).select("kind", "value", "account", "group_size")


def link_kinds(r: ColumnRoles) -> dict[str, str]:
    named = {"shared_device": r.device, "shared_address": r.address, "shared_phone": r.phone}
    return {k: c for k, c in named.items() if c}


def linkage_alerts(spokes: DataFrame) -> DataFrame:
    """Large shared-value groups with severity."""
    groups = spokes.groupBy("kind", "value").agg(F.count("*").alias("accounts_in_group")).filter(F.col("accounts_in_group") >= ALERT_HIGH)
    return groups.withColumn("severity", F.when(F.col("accounts_in_group") >= ALERT_CRITICAL, "critical").otherwise("high"))


def hub_id(kind: Column, value: Column) -> Column:
    """Vertex id of a shared value, marked by its kind."""
    plain = F.replace(kind, F.lit("shared_"), F.lit(""))
    return F.concat(plain, F.lit(":"), stable_id("d", value))


def employee_id(employee: Column) -> Column:
    return F.concat(F.lit("employee:"), stable_id("emp", employee))


def undirected_payments(edges: DataFrame) -> DataFrame:
    """(src, dst, pay_count) with src < dst, self payments left out."""
    pairs = edges.filter("payer <> payee")
    return pairs.groupBy(F.least("payer", "payee").alias("src"), F.greatest("payer", "payee").alias("dst")).agg(
        F.sum("transfer_count").alias("pay_count")
    )


def ring_edges(spokes: DataFrame, payments: DataFrame | None = None, touches: DataFrame | None = None) -> DataFrame:
    """All undirected edges (src, dst, kinds, pay_count): account-hub, account-account, employee-account."""
    parts = [spokes.select(F.col("account").alias("src"), hub_id(F.col("kind"), F.col("value")).alias("dst"), "kind", F.lit(0).cast("long").alias("pay_count"))]
    if payments is not None:
        parts.append(undirected_payments(payments).select("src", "dst", F.lit("payment").alias("kind"), "pay_count"))
    if touches is not None:
        parts.append(touches.select(employee_id(F.col("employee_id")).alias("src"), F.col("account_id").alias("dst"), F.lit("internal_escalation").alias("kind"), F.lit(0).cast("long").alias("pay_count")))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    # Kinds are a handful of words, so the list per edge is short.
    return long.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("edge_kinds"), F.sum("pay_count").alias("pay_count"))


def is_account(v: Column) -> Column:
    return ~v.rlike("^(device|address|phone|employee):")


#: Groups of shared values up to this size are lists of members where neighbours are counted. It changes the way, not the result.
EXACT_GROUP = 200


def _both_ends(payments: DataFrame) -> DataFrame:
    """(account, other) of every payment pair, both ways round."""
    p = undirected_payments(payments)
    return p.select(F.col("src").alias("account"), F.col("dst").alias("other")).unionByName(p.select(F.col("dst").alias("account"), F.col("src").alias("other")))


def _signatures(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (account, gid): (account, class, groups), and per class of accounts with the same groups (class, groups, n)."""
    per = cut_lineage(groups.groupBy("account").agg(F.array_sort(F.collect_list("gid")).alias("groups")))
    classes = cut_lineage(per.groupBy("groups").agg(F.count("*").alias("n")).withColumn("class", F.monotonically_increasing_id()))
    return cut_lineage(per.join(classes.select("class", "groups"), "groups").select("account", "class", "groups")), classes


def account_degrees(spokes: DataFrame, payments: DataFrame | None = None, touches: DataFrame | None = None, exact_group: int = EXACT_GROUP, max_subsets: int | None = None) -> DataFrame:
    """(account, degree): distinct neighbours by shared values, payments and staff links; exact for groups of any size.

    Accounts with the same groups are one class, whose union of groups is counted once; partners in it are left out of an
    account's direct ones. No group is taken apart into pairs: blocks of classes meet slices of their neighbours, where large
    groups are bitmaps (``neighbours``). ``exact_group`` changes the way, not the result; ``max_subsets`` is kept for callers:
    unions of any number of groups are counted in one way.
    """
    near = []
    if payments is not None:
        near.append(_both_ends(payments))
    if touches is not None:
        near.append(touches.select(F.col("account_id").alias("account"), F.concat(F.lit("employee:"), F.col("employee_id").cast("string")).alias("other")))
    if not near:
        near.append(spokes.select("account", F.col("account").alias("other")).limit(0))
    counts = neighbour_counts(spokes.select("kind", "value", "account"), reduce(DataFrame.unionByName, near), exact_group)
    return counts.withColumnRenamed("n", "degree")


def neighbor_communities(spokes: DataFrame, payments: DataFrame | None, communities: DataFrame) -> DataFrame:
    """(account, communities_near): distinct communities among the neighbours by shared values and payments.

    Accounts with the same shared values are one class, whose communities are gathered once. The own community is among
    them only if another member of one of the values, or a payment partner, has it.
    """
    c = communities.select("account", "community_id")
    named = cut_lineage(spokes.select("kind", "value").distinct().withColumn("gid", F.monotonically_increasing_id()))
    members = cut_lineage(spokes.join(named, ["kind", "value"]).select("account", "gid"))
    accounts, classes = _signatures(members)
    in_hub = cut_lineage(members.join(c, "account"))
    per_hub = in_hub.groupBy("gid", "community_id").agg(F.count("*").alias("n"))
    around = cut_lineage(classes.select("class", F.explode("groups").alias("gid")).join(per_hub, "gid").select("class", F.col("community_id").alias("near")).distinct())
    counts = around.groupBy("class").agg(F.count("*").alias("known"))
    # Alone in all its values with its community.
    alone = in_hub.join(per_hub, ["gid", "community_id"]).groupBy("account", "community_id").agg((F.max("n") == 1).alias("alone"))
    by_value = accounts.select("account", "class").join(counts, "class").join(alone, "account", "left")
    by_value = cut_lineage(by_value.withColumn("alone", F.coalesce("alone", F.lit(False))))
    found = by_value.select("account", (F.col("known") - F.col("alone").cast("int")).alias("d"))
    if payments is not None:
        paid = _both_ends(payments).join(c.toDF("other", "near"), "other").select("account", "near").distinct()
        paid = paid.join(by_value.select("account", "class", F.when(F.col("alone"), F.col("community_id")).alias("own")), "account", "left")
        known = around.withColumn("seen", F.lit(True))
        new = paid.join(known, ["class", "near"], "left").filter("seen IS NULL OR near <=> own")
        found = found.unionByName(new.groupBy("account").agg(F.count("*").alias("d")))
    return found.groupBy("account").agg(F.sum("d").alias("communities_near")).filter("communities_near > 0")


# Limits of the role rules.
HUB_MIN_DEGREE = 4
HUB_SHARE = 9
BRIDGE_MIN = 2
MULE_CYCLE_DEGREE = 5
MULE_TOUCH_DEGREE = 2


def hub_threshold(degrees: DataFrame) -> Column:
    """Degree at position n / 9 of the descending positive degrees, at least 4; a one-row subquery.

    Degrees are counted per value first, so the ordering works on distinct degrees.
    """
    counts = degrees.filter("degree > 0").groupBy("degree").agg(F.count("*").alias("n"))
    desc = W.orderBy(F.col("degree").desc())
    upto = counts.withColumn("upto", F.sum("n").over(desc)).withColumn("total", F.sum("n").over(W.partitionBy()))
    cut = upto.filter(F.col("upto") > F.floor(F.col("total") / HUB_SHARE)).agg(F.max("degree").alias("d"))
    return cut.select(F.greatest(F.lit(HUB_MIN_DEGREE).cast("long"), F.coalesce("d", F.lit(HUB_MIN_DEGREE).cast("long")))).scalar()


def account_roles(degrees: DataFrame, near: DataFrame, cyclic: DataFrame | None = None, touches: DataFrame | None = None) -> DataFrame:
    """(account, role, degree, communities_near, on_cycle, touch_weight): bridge, hub, mule or peripheral.

    ``cyclic`` has the accounts that lie on a payment cycle of any length.
    """
    out = degrees.join(near, "account", "left")
    if cyclic is not None:
        out = out.join(cyclic.select("account", F.lit(True).alias("on_cycle")), "account", "left")
    else:
        out = out.withColumn("on_cycle", F.lit(False))
    if touches is not None:
        weight = F.when(F.col("total_amount") != 0, F.col("total_amount")).otherwise(F.col("touch_count"))
        out = out.join(touches.groupBy(F.col("account_id").alias("account")).agg(F.sum(weight).alias("touch_weight")), "account", "left")
    else:
        out = out.withColumn("touch_weight", F.lit(None).cast("double"))
    out = out.fillna(0, ["communities_near", "touch_weight"]).fillna(False, ["on_cycle"]).withColumn("_hub", hub_threshold(degrees))
    d = F.col("degree")
    role = (
        F.when(F.col("communities_near") >= BRIDGE_MIN, "bridge")
        .when(d >= F.col("_hub"), "hub")
        .when(F.col("on_cycle") & (d <= MULE_CYCLE_DEGREE), "mule")
        .when((d <= MULE_TOUCH_DEGREE) & (F.col("touch_weight") > 0), "mule")
        .otherwise("peripheral")
    )
    return out.withColumn("role", role).drop("_hub")


def role_summary(roles: DataFrame, samples: int = 12) -> DataFrame:
    """(role, n, samples): accounts per role with a few ids."""
    counts = roles.groupBy("role").agg(F.count("*").alias("n"))
    few = top_per_key(roles.select("role", "account"), ["role"], [F.col("account")], samples)
    lists = few.groupBy("role").agg(F.array_sort(F.collect_list("account")).alias("samples"))
    return counts.join(lists, "role")


# Size and degree that make a community a risk.
RISK_SIZE = 8
RISK_DEGREE = 12


def risk_communities(communities: DataFrame, degrees: DataFrame) -> DataFrame:
    per = communities.join(degrees, "account", "left").groupBy("community_id").agg(
        F.count("*").alias("size"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree")
    )
    return per.filter((F.col("size") >= RISK_SIZE) | (F.col("max_degree") >= RISK_DEGREE))


def directed_density(edges: DataFrame) -> DataFrame:
    """One row on the payment graph: vertices, edges, m / (n (n - 1))."""
    n = edges.select("payer").union(edges.select("payee")).distinct().agg(F.count("*").alias("nodes"))
    m = edges.agg(F.count("*")).scalar()
    out = n.withColumn("edges", m)
    return out.withColumn("density", F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1).cast("double"))).otherwise(0.0))


def link_density(spokes: DataFrame) -> DataFrame:
    """One row on the co-membership graph: accounts, links, 2 m / (n (n - 1)), links counted from group sizes."""
    links = spokes.groupBy("kind", "value").agg(F.count("*").alias("s")).agg(F.sum(F.col("s") * (F.col("s") - 1) / 2).cast("long")).scalar()
    out = spokes.agg(F.count_distinct("account").alias("nodes")).withColumn("links", links)
    return out.withColumn("density", F.when(F.col("nodes") > 1, 2.0 * F.col("links") / (F.col("nodes") * (F.col("nodes") - 1).cast("double"))).otherwise(0.0))


def device_bridges(spokes: DataFrame, degrees: DataFrame) -> DataFrame:
    """One row: devices that join accounts, accounts, greatest degree, and whether three-hop paths can exist."""
    devices = spokes.filter("kind = 'shared_device'").agg(F.count_distinct("value")).scalar()
    out = degrees.agg(F.count("*").alias("account_nodes"), F.max("degree").alias("max_degree")).withColumn("bridges", devices)
    return out.withColumn("three_hop_ready", (F.col("bridges") > 0) | (F.coalesce("max_degree", F.lit(0)) >= 3))


def three_hop_paths(spokes: DataFrame, payments: DataFrame) -> DataFrame:
    """Paths account -> shared value -> peer -> payee, folded by their first hop.

    One row per (value, peer, payee); it stands for ``starts`` paths, one from every
    other member of the group. The payment side has one row per (payer, payee).
    """
    out = payments.filter("payer <> payee").select(F.col("payer").alias("account"), "payee", "transfer_count")
    return spokes.join(out, "account").select(
        "kind", "value", F.col("account").alias("peer"), "payee", "transfer_count", (F.col("group_size") - 1).alias("starts")
    )


def three_hop_counts(spokes: DataFrame, payments: DataFrame) -> DataFrame:
    """(account, paths): number of three-hop paths from each account, from sums per value."""
    fan = payments.filter("payer <> payee").groupBy(F.col("payer").alias("account")).agg(F.count("*").alias("out_edges"))
    members = spokes.join(fan, "account", "left").fillna(0, ["out_edges"])
    per_value = members.groupBy("kind", "value").agg(F.sum("out_edges").alias("all_out"))
    reached = members.join(per_value, ["kind", "value"])
    return reached.groupBy("account").agg(F.sum(F.col("all_out") - F.col("out_edges")).alias("paths")).filter("paths > 0")


# Size of the picture of a graph.
VIEW_NODES = 900
VIEW_EDGES = 3500


def view_sample(degrees: DataFrame, edges: DataFrame, nodes: int = VIEW_NODES, n_edges: int = VIEW_EDGES) -> DataFrame:
    """Edges among the accounts of greatest degree, for a picture; a top-k report."""
    top = degrees.orderBy(F.col("degree").desc(), "account").limit(nodes).select("account")
    inside = edges.join(top.toDF("src"), "src", "left_semi").join(top.toDF("dst"), "dst", "left_semi")
    return inside.orderBy(F.col("pay_count").desc(), "src", "dst").limit(n_edges)


def graph_tables(spokes: DataFrame, payments: DataFrame | None, touches: DataFrame | None, roles: DataFrame | None = None, communities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables with the attributes that graph tools read."""
    edges = ring_edges(spokes, payments, touches).select("src", "dst", "edge_kinds", "pay_count", F.lit(1.0).alias("weight"))
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    label = F.substring("id", 1, 80)
    out = nodes.select("id", label.alias("label"), F.when(is_account(F.col("id")), "account").otherwise(F.substring_index("id", ":", 1)).alias("node_class"))
    if roles is not None:
        out = out.join(roles.select(F.col("account").alias("id"), F.col("role").alias("ring_role")), "id", "left")
    else:
        out = out.withColumn("ring_role", F.lit(None).cast("string"))
    if communities is not None:
        out = out.join(communities.select(F.col("account").alias("id"), F.col("community_id").alias("community")), "id", "left")
    else:
        out = out.withColumn("community", F.lit(None).cast("string"))
    return out.withColumn("community", F.coalesce("community", F.lit("-1"))), edges


def ring_inputs(df: DataFrame, r: ColumnRoles, min_pair_n: int = 3, amount_threshold: float = 5_000.0) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Spokes, payment edges and staff touches of one table, as far as it has the columns."""
    spokes = shared_values(df, r.user, link_kinds(r))
    payments = payment_edges(df, r.payer, r.payee, r.amount) if r.payer and r.payee else None
    touches = employee_account_touches(df, r.employee, r.user, r.amount, min_pair_n, amount_threshold) if r.employee else None
    return spokes, payments, touches
