"""Fraud-ring graph queries: links from the link view, payments from purchases."""

from __future__ import annotations

from pyspark.sql import functions as F

from inquest.operators import communities as L
from inquest.operators import components as N
from inquest.operators import cycles as Y
from inquest.operators import graph as G
from inquest.operators.relational import employee_account_touches, payment_edges
from inquest.plans.registry import query
from inquest.session import cut_lineage, shared_scratch
from inquest.sources.sinks import sink_graph_tables

LINKS, PAY, BOTH, TXN = ("v_links",), ("v_payments",), ("v_links", "v_payments"), ("v_txn",)

SPOKES = """pairs AS (SELECT DISTINCT 'shared_device' AS kind, device_id AS value, account_id AS account FROM v_links UNION SELECT 'shared_address', address, account_id FROM v_links UNION SELECT 'shared_phone', phone, account_id FROM v_links),
spokes AS (SELECT *, count(*) OVER (PARTITION BY kind, value) AS group_size FROM pairs QUALIFY group_size >= 2)"""
EDGES = """pe AS (SELECT 'U_' || payer AS payer, 'U_' || payee AS payee, count(*) AS transfer_count, sum(amount) AS total_amount FROM v_payments GROUP BY ALL)"""
UND = """und AS (SELECT least(payer, payee) AS src, greatest(payer, payee) AS dst, sum(transfer_count)::BIGINT AS pay_count FROM pe WHERE payer <> payee GROUP BY ALL)"""
DEG = """deg AS (SELECT account, count(DISTINCT other) AS degree FROM (SELECT a.account, b.account AS other FROM spokes a JOIN spokes b USING (kind, value) WHERE a.account <> b.account UNION ALL SELECT src, dst FROM und UNION ALL SELECT dst, src FROM und) GROUP BY account)"""


def _spokes(t):
    return G.shared_values(t.v_links, "account_id", {"shared_device": "device_id", "shared_address": "address", "shared_phone": "phone"})


def _payments(t):
    named = t.v_payments.select(F.concat(F.lit("U_"), "payer").alias("payer"), F.concat(F.lit("U_"), "payee").alias("payee"), "amount")
    return payment_edges(named, "payer", "payee", "amount")


def _degrees(t):
    return G.account_degrees(_spokes(t), _payments(t))


HUB = "replace(kind, 'shared_', '') || ':d:' || substr(sha256('d:' || value), 1, 14)"


@query(
    "graph_linkage_edges",
    f"""WITH {SPOKES}, {EDGES}, {UND} SELECT account AS src, {HUB} AS dst, kind AS edge_kinds, 0::BIGINT AS pay_count FROM spokes UNION ALL SELECT src, dst, 'payment', pay_count FROM und""",
    BOTH,
)
def _(t):
    return G.ring_edges(_spokes(t), _payments(t))


@query("graph_linkage_spokes", f"WITH {SPOKES} SELECT kind, value, account, group_size FROM spokes", LINKS)
def _(t):
    return _spokes(t)


@query(
    "graph_linkage_alerts",
    f"WITH {SPOKES} SELECT kind, value, count(*) AS accounts_in_group, CASE WHEN count(*) >= 50 THEN 'critical' ELSE 'high' END AS severity FROM spokes GROUP BY ALL HAVING count(*) >= 10",
    LINKS,
)
def _(t):
    return G.linkage_alerts(_spokes(t))


@query("graph_payment_edges", f"WITH {EDGES} SELECT payer, payee, transfer_count, round(total_amount, 4) AS total_amount FROM pe", PAY)
def _(t):
    return _payments(t).withColumn("total_amount", F.round("total_amount", 4))


ON_CYCLE = """e AS (SELECT DISTINCT payer AS src, payee AS dst FROM pe WHERE payer <> payee),
reach AS (SELECT src AS v, dst AS r FROM e UNION SELECT reach.v, e.dst FROM reach JOIN e ON e.src = reach.r),
inner_e AS (SELECT e.* FROM e JOIN reach ON reach.v = e.dst AND reach.r = e.src)"""
#: Longest cycles that the query lists; their number grows about tenfold with each step on the test tables.
CYCLE_LENGTH = 4


@query(
    "graph_circular_payments",
    f"""WITH RECURSIVE {EDGES}, {ON_CYCLE},
p AS (SELECT src AS start, dst AS last, [src, dst] AS accounts, 1 AS hops FROM inner_e WHERE dst > src
 UNION ALL SELECT p.start, e.dst, list_append(p.accounts, e.dst), p.hops + 1 FROM p JOIN inner_e e ON e.src = p.last WHERE p.hops < {CYCLE_LENGTH} AND e.dst > p.start AND NOT list_contains(p.accounts, e.dst))
SELECT CAST(hops + 1 AS INT) AS cycle_length, array_to_string(list_append(accounts, start), ' → ') AS path, (SELECT count(*) > 0 FROM p WHERE hops = {CYCLE_LENGTH}) AS truncated
FROM p JOIN inner_e e ON e.src = p.last AND e.dst = p.start WHERE hops < {CYCLE_LENGTH}""",
    PAY,
)
def _(t):
    return Y.circular_payments(_payments(t), max_len=CYCLE_LENGTH).select("cycle_length", "path", "truncated")


@query(
    "graph_payment_cores",
    f"""WITH RECURSIVE {EDGES}, {ON_CYCLE},
pairs AS (SELECT a.v, a.r FROM reach a JOIN reach b ON a.v = b.r AND a.r = b.v)
SELECT v AS account, min(r) AS component, count(DISTINCT r) AS size FROM pairs GROUP BY v HAVING count(DISTINCT r) > 1""",
    PAY,
)
def _(t):
    return Y.strongly_connected(_payments(t))


@query(
    "graph_internal_escalation",
    """SELECT 'employee:emp:' || substr(sha256('emp:' || employee_id), 1, 14) AS src, CAST(user_id AS VARCHAR) AS dst, count(*) AS touch_count, round(sum(amount), 2) AS total_amount FROM v_txn GROUP BY ALL HAVING count(*) >= 3 OR sum(amount) >= 5000""",
    TXN,
)
def _(t):
    touches = employee_account_touches(t.v_txn, "employee_id", "user_id", "amount")
    return touches.select(G.employee_id(F.col("employee_id")).alias("src"), F.col("account_id").alias("dst"), "touch_count", F.round("total_amount", 2).alias("total_amount"))


@query(
    "graph_components",
    f"""WITH RECURSIVE {SPOKES}, e AS (SELECT account AS a, {HUB} AS b FROM spokes), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS v, a AS r FROM both_ways UNION SELECT reach.v, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r)
SELECT v AS vertex, min(r) AS component FROM reach GROUP BY v""",
    LINKS,
)
def _(t):
    return N.connected_components(G.ring_edges(_spokes(t)))


@query("graph_degree", f"WITH {SPOKES}, {EDGES}, {UND}, {DEG} SELECT * FROM deg", BOTH)
def _(t):
    return _degrees(t)


def _landed(t):
    """Spokes and payments, made once for queries that read them several times."""
    return cut_lineage(_spokes(t)), cut_lineage(_payments(t))


def _communities(spokes, payments):
    found = L.louvain(G.ring_edges(spokes, payments))
    return found.filter(G.is_account(F.col("vertex"))).select(F.col("vertex").alias("account"), "community_id", "settled")


@query("graph_communities")
def _(t):
    return _communities(_spokes(t), _payments(t))


@query("graph_neighbor_communities")
def _(t):
    spokes, payments = _landed(t)
    return G.neighbor_communities(spokes, payments, _communities(spokes, payments))


def _roles(t):
    spokes, payments = _landed(t)
    degrees = G.account_degrees(spokes, payments)
    near = G.neighbor_communities(spokes, payments, _communities(spokes, payments))
    return cut_lineage(G.account_roles(degrees, near, Y.strongly_connected(payments)))


@query("graph_roles")
def _(t):
    return _roles(t)


@query("graph_role_summary")
def _(t):
    return G.role_summary(_roles(t)).withColumn("samples", F.array_join("samples", ","))


@query("graph_risk_communities")
def _(t):
    spokes, payments = _landed(t)
    return G.risk_communities(_communities(spokes, payments), G.account_degrees(spokes, payments))


@query(
    "agg_role_summary",
    f"""WITH {SPOKES}, {EDGES}, {UND}, {DEG}, n AS (SELECT count(*) AS n FROM deg WHERE degree > 0), th AS (SELECT greatest(4, (SELECT degree FROM deg WHERE degree > 0 ORDER BY degree DESC LIMIT 1 OFFSET (SELECT n // 9 FROM n))) AS h),
r AS (SELECT account, CASE WHEN degree >= h THEN 'hub' ELSE 'peripheral' END AS role FROM deg, th)
SELECT role, count(*) AS n, array_to_string(list_sort(list(account))[1:12], ',') AS samples FROM r GROUP BY role""",
    BOTH,
)
def _(t):
    # Degrees alone: no communities, cycles or touches, so the roles are hub and peripheral.
    degrees = _degrees(t)
    none = degrees.select("account", F.lit(0).alias("communities_near"))
    return G.role_summary(G.account_roles(degrees, none)).withColumn("samples", F.array_join("samples", ","))


@query(
    "graph_density",
    f"""WITH {EDGES}, n AS (SELECT count(*) AS nodes FROM (SELECT payer FROM pe UNION SELECT payee FROM pe)) SELECT nodes, (SELECT count(*) FROM pe) AS edges, round((SELECT count(*) FROM pe) / (nodes * (nodes - 1))::DOUBLE, 8) AS density FROM n""",
    PAY,
)
def _(t):
    return G.directed_density(_payments(t)).withColumn("density", F.round("density", 8))


@query(
    "graph_link_density",
    f"""WITH {SPOKES}, l AS (SELECT CAST(sum(s * (s - 1) // 2) AS BIGINT) AS links FROM (SELECT count(*) AS s FROM spokes GROUP BY kind, value)), n AS (SELECT count(DISTINCT account) AS nodes FROM spokes)
SELECT nodes, links, round(2.0::DOUBLE * links / (nodes * (nodes - 1)), 8) AS density FROM n, l""",
    LINKS,
)
def _(t):
    return G.link_density(_spokes(t)).withColumn("density", F.round("density", 8))


@query(
    "graph_device_bridges",
    f"""WITH {SPOKES}, {EDGES}, {UND}, {DEG} SELECT count(*) AS account_nodes, max(degree) AS max_degree, (SELECT count(DISTINCT value) FROM spokes WHERE kind = 'shared_device') AS bridges, true AS three_hop_ready FROM deg""",
    BOTH,
)
def _(t):
    return G.device_bridges(_spokes(t), _degrees(t))


@query(
    "graph_three_hop_paths",
    f"""WITH {SPOKES}, {EDGES} SELECT kind, value, account AS peer, payee, transfer_count, group_size - 1 AS starts FROM spokes JOIN pe ON pe.payer = account AND payer <> payee""",
    BOTH,
)
def _(t):
    return G.three_hop_paths(_spokes(t), _payments(t))


@query(
    "graph_three_hop_counts",
    f"""WITH {SPOKES}, {EDGES} SELECT a.account, count(*) AS paths FROM spokes a JOIN spokes b ON b.kind = a.kind AND b.value = a.value AND b.account <> a.account JOIN pe ON pe.payer = b.account AND payer <> payee GROUP BY a.account""",
    BOTH,
)
def _(t):
    return G.three_hop_counts(_spokes(t), _payments(t))


@query(
    "graph_view_sample",
    f"""WITH {SPOKES}, {EDGES}, {UND}, {DEG}, top AS (SELECT account FROM deg ORDER BY degree DESC, account LIMIT 900)
SELECT src, dst, pay_count FROM und WHERE src IN (SELECT account FROM top) AND dst IN (SELECT account FROM top) ORDER BY pay_count DESC, src, dst LIMIT 3500""",
    BOTH,
)
def _(t):
    payments = G.undirected_payments(_payments(t))
    return G.view_sample(_degrees(t), payments)


GRAPH_NODES = f"""WITH {SPOKES}, {EDGES}, {UND}, ed AS (SELECT account AS src, {HUB} AS dst FROM spokes UNION ALL SELECT src, dst FROM und)
SELECT id, substr(id, 1, 80) AS label, CASE WHEN id LIKE '%:%' THEN split_part(id, ':', 1) ELSE 'account' END AS node_class, NULL::VARCHAR AS ring_role, '-1' AS community FROM (SELECT src AS id FROM ed UNION SELECT dst FROM ed)"""


@query("sink_graph_tables", GRAPH_NODES, BOTH)
def _(t):
    nodes, edges = G.graph_tables(_spokes(t), _payments(t), None)
    return sink_graph_tables(nodes, edges, shared_scratch(t.spark, "graph"))[0]


@query(
    "sink_graph_edges",
    f"""WITH {SPOKES}, {EDGES}, {UND} SELECT account AS src, {HUB} AS dst, kind AS edge_kinds, 0::BIGINT AS pay_count, 1.0::DOUBLE AS weight FROM spokes UNION ALL SELECT src, dst, 'payment', pay_count, 1.0 FROM und""",
    BOTH,
)
def _(t):
    nodes, edges = G.graph_tables(_spokes(t), _payments(t), None)
    return sink_graph_tables(nodes, edges, shared_scratch(t.spark, "graph"), "csv")[1]
