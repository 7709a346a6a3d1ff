"""Communities by modularity: local moves of a frontier, then contraction (Blondel et al., 2008).

The links of a level are packed once into cells, arrays of numbers that stay cached where they are; a round sends each cell
the state of the vertices it names, a few bytes each. A cell has links from one part of a block of vertices to one block, so its
size is bounded for vertices with any number of links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.session import cut_lineage, replace_step


def _both_ways(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(u, v, w): every edge in both directions, weight 1, loops dropped."""
    one = edges.select(F.col(src).cast("string").alias("u"), F.col(dst).cast("string").alias("v")).filter("u <> v")
    return one.union(one.select("v", "u")).distinct().withColumn("w", F.lit(1.0))


def modularity(edges: DataFrame, membership: DataFrame) -> float:
    """Modularity of a partition; ``edges`` (u, v, w) both ways, ``membership`` (v, c)."""
    c = membership
    tagged = edges.join(c.toDF("u", "cu"), "u").join(c.toDF("v", "cv"), "v")
    per = tagged.groupBy("cu").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inside"))
    row = per.agg(F.sum("tot"), F.sum("inside"), F.sum(F.col("tot") * F.col("tot"))).first()
    total = float(row[0] or 0.0)
    return 0.0 if total == 0 else float(row[1]) / total - float(row[2]) / (total * total)


#: A round tries to let all willing vertices move, every second, every fourth and so on; the share that raises modularity most does.
SHARES = tuple(1 << i for i in range(11))
#: A guard: the rounds of one level.
MAX_ROUNDS = 240
#: Vertices of a block, and links of a cell, about. They change the way, not the result.
BLOCK, CELL = 1 << 20, 1 << 22

_CELL = "cell int, part int, at int, to int, u binary, start binary, v binary, w binary"


@dataclass(frozen=True)
class _Graph:
    """One level: ``vertices`` (v, h, k, loop, root) with v from 0 on, ``cells`` of its links, ``reads`` (block, cell)."""

    vertices: DataFrame
    cells: DataFrame
    reads: DataFrame
    total: float
    block: int
    blocks: int

    @property
    def kind(self) -> str:
        """Of numbers of vertices."""
        return "int32" if self.block * self.blocks < 2**31 else "int64"


def _numbered(df: DataFrame, order: str, name: str) -> tuple[DataFrame, int]:
    """Rows with numbers from 0 on in the order of a column, without gaps; and how many rows."""
    placed = cut_lineage(df.orderBy(order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33).cast("int")
    sizes = dict(placed.groupBy(part.alias("part")).agg(F.count("*")).collect())
    before = np.concatenate([[0], np.cumsum([sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)])]).tolist()
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in before]), part + 1)
    return placed.withColumn(name, start + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"), before[-1]


def _whole(table: pa.Table, column: str, kind: type | str) -> np.ndarray:
    return np.frombuffer(table[column][0].as_py(), kind)


def _runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])


def _blob(values: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())


def _packed_links(block: int) -> Callable[[pa.Table], pa.Table]:
    """The links of a cell by their first end, as offsets in the blocks of their ends; weights only if one is not 1."""

    def pack(table: pa.Table) -> pa.Table:
        u, v, w = (table[c].to_numpy() for c in ("u", "v", "w"))
        order = np.lexsort((v, u))
        u, v, w = u[order], v[order], w[order]
        own, start = np.unique(u, return_index=True)
        weights = w if (w != 1).any() else w[:0]
        blobs = [(own % block).astype(np.int32), np.append(start, len(u)).astype(np.int64), (v % block).astype(np.int32), weights.astype(np.float64)]
        blocks = [pa.array([x[0] // block], pa.int32()) for x in (u, v)]
        return pa.table([table["cell"].slice(0, 1), table["part"].slice(0, 1), *blocks, *map(_blob, blobs)], ["cell", "part", "at", "to", "u", "start", "v", "w"])

    return pack


def _packed_state(block: int, columns: dict[str, str]) -> tuple[Callable[[pa.Table], pa.Table], str]:
    """One row for a block of vertices, its columns as arrays by vertex. Of communities a list comes, and places in it."""

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table["v"].to_numpy())
        blobs, names = [], []
        for name, kind in columns.items():
            blobs.append(_blob(table[name].to_numpy()[order].astype(kind)))
            names.append(name)
        if "tot" in columns:
            c, first, place = np.unique(table["c"].to_numpy()[order], return_index=True, return_inverse=True)
            blobs += [_blob(c), _blob(table["tot"].to_numpy()[order][first]), _blob(place.astype(np.int32))]
            names += ["ids", "tots", "place"]
            for gone in ("tot", "c"):
                at = names.index(gone)
                del names[at], blobs[at]
        return pa.table([table["block"].slice(0, 1), *blobs], ["block", *names])

    kept = [c for c in columns if "tot" not in columns or c not in ("tot", "c")] + (["ids", "tots", "place"] if "tot" in columns else [])
    return pack, ", ".join(["block int", *(f"{c} binary" for c in kept)])


def _met(graph: _Graph, state: DataFrame, columns: dict[str, str], work: Callable, schema: str) -> DataFrame:
    """``work`` of each cell (one row) with the packed state of the blocks it reads (one or two rows)."""
    pack, packed = _packed_state(graph.block, columns)
    blocks = state.select(F.floor(F.col("v") / graph.block).cast("int").alias("block"), "v", *columns).groupBy("block").applyInArrow(pack, packed)
    sent = blocks.join(graph.reads, "block")
    return graph.cells.groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(work, schema)


def _ends(cell: pa.Table, state: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The state of the block of the cell's rows, and of the one they are linked to."""
    numbers = state["block"].to_pylist()
    return tuple(state.slice(numbers.index(cell[c][0].as_py()), 1) for c in ("at", "to"))


def _pairs(cell: pa.Table, state: pa.Table, only_asked: bool) -> dict[str, np.ndarray]:
    """Rows of a cell with their own state, and what links each to which community."""
    here, there = _ends(cell, state)
    u, start, v, w = _whole(cell, "u", np.int32), _whole(cell, "start", np.int64), _whole(cell, "v", np.int32), _whole(cell, "w", np.float64)
    place, ids, tots = _whole(here, "place", np.int32)[u], _whole(here, "ids", np.int64), _whole(here, "tots", np.float64)
    flags = _whole(here, "flags", np.uint8)[u]
    out = {"u": u.astype(np.int64), "own": ids[place], "own_tot": tots[place], "k": _whole(here, "k", np.float64)[u], "asked": flags & 1 > 0}
    near, ids, tots = _whole(there, "place", np.int32)[v], _whole(there, "ids", np.int64), _whole(there, "tots", np.float64)
    row = np.repeat(np.arange(len(u)), np.diff(start))
    # Asked are those that were not let, and those with a neighbour that moved to another community than theirs.
    moved = np.flatnonzero((_whole(there, "flags", np.uint8) & 2)[v])
    out["asked"][row[moved[ids[near[moved]] != out["own"][row[moved]]]]] = True
    if only_asked and not out["asked"].all():
        keep = out["asked"][row]
        row, near, w = row[keep], near[keep], w[keep] if len(w) else w
    key, n = row * len(ids) + near, len(u) * len(ids)
    if n <= 4 * len(key):
        count = np.bincount(key, w if len(w) else None, n)
        # Weights are 1 and more.
        key = np.flatnonzero(count)
        kc = count[key].astype(np.float64)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = _runs(key)
        kc = np.add.reduceat(w[order], first) if len(w) else np.diff(np.append(first, len(key))).astype(np.float64)
        key = key[first]
    return out | {"row": key // len(ids), "c": ids[key % len(ids)], "kc": kc, "tot": tots[key % len(ids)]}


def _wanted(p: dict[str, np.ndarray], total: float, base: int) -> pa.Table:
    """(v, to, kc, to_tot, own_kc) of the rows that want to move; pairs come by row and community."""
    if total < 2**31:
        # Weights are whole numbers: gains, times ``total``, are exact.
        whole = {c: p[c].astype(np.int64) for c in ("k", "own_tot", "kc", "tot")}
        gain = lambda kc, k, tot: kc * int(total) - k * tot
        least = np.iinfo(np.int64).min
    else:
        whole, least = p, -np.inf
        gain = lambda kc, k, tot: np.round(kc - k * tot / total, 9)
    mine = p["c"] == p["own"][p["row"]]
    own_kc = np.zeros(len(p["u"]), whole["kc"].dtype)
    own_kc[p["row"][mine]] = whole["kc"][mine]
    stay = gain(own_kc, whole["k"], whole["own_tot"] - whole["k"])
    other = np.flatnonzero(~mine)
    row = p["row"][other]
    score = gain(whole["kc"][other], whole["k"][row], whole["tot"][other])
    first = _runs(row)
    best = np.full(len(p["u"]), least)
    if len(first):
        best[row[first]] = np.maximum.reduceat(score, first)
    top = other[(score == best[row]) & p["asked"][row] & (best > stay)[row]]
    # Of equal ones the least community, the first of its row.
    top = top[_runs(p["row"][top])]
    who = p["row"][top]
    return pa.table({"v": base + p["u"][who], "to": p["c"][top], "kc": p["kc"][top], "to_tot": p["tot"][top], "own_kc": own_kc[who].astype(np.float64)})


_WANTED = "v long, to long, kc double, to_tot double, own_kc double"
_PARTS = {"u": np.int64, "own": np.int64, "own_tot": np.float64, "k": np.float64, "asked": np.bool_, "row": np.int64, "c": np.int64, "kc": np.float64, "tot": np.float64}


def _empty(schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.table({n: pa.array([], kinds[t]) for n, t in (x.split() for x in schema.split(", "))})


def _merged(total: float, block: int) -> Callable[[pa.Table], pa.Table]:
    """As ``_wanted``, for rows whose links lie in several cells."""

    def merge(table: pa.Table) -> pa.Table:
        parts = [{c: np.frombuffer(r[c], kind) for c, kind in _PARTS.items()} for r in table.to_pylist()]
        cat = lambda c: np.concatenate([p[c] for p in parts])
        u, first, place = np.unique(cat("u"), return_index=True, return_inverse=True)
        out = {"u": u} | {c: cat(c)[first] for c in ("own", "own_tot", "k")}
        out["asked"] = np.bincount(place, cat("asked"), len(u)) > 0
        shift = np.cumsum([0, *(len(p["u"]) for p in parts)])
        row = place[np.concatenate([p["row"] + s for p, s in zip(parts, shift)])]
        c = cat("c")
        order = np.lexsort((c, row))
        row, c = row[order], c[order]
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (c[1:] != c[:-1])]) if len(row) else order
        kc = np.add.reduceat(cat("kc")[order], new) if len(row) else cat("kc")
        return _wanted(out | {"row": row[new], "c": c[new], "kc": kc, "tot": cat("tot")[order][new]}, total, table["at"][0].as_py() * block)

    return merge


def _wants(graph: _Graph, placed: DataFrame) -> DataFrame:
    """(v, to, kc, to_tot, own_kc) of the vertices of the frontier that are better off elsewhere."""
    total, block = graph.total, graph.block
    state = placed.withColumn("flags", F.col("active").cast("int") + 2 * F.col("moved").cast("int"))
    columns = {"c": "int64", "tot": "float64", "k": "float64", "flags": "uint8"}
    if graph.blocks == 1:

        def decide(cell: pa.Table, state: pa.Table) -> pa.Table:
            return _wanted(_pairs(cell, state, True), total, 0) if cell.num_rows else _empty(_WANTED)

        return _met(graph, state, columns, decide, _WANTED)
    schema = "at int, part int, " + ", ".join(f"{c} binary" for c in _PARTS)

    def gather(cell: pa.Table, state: pa.Table) -> pa.Table:
        if not cell.num_rows:
            return _empty(schema)
        found = _pairs(cell, state, False)
        return pa.table([cell["at"], cell["part"], *(_blob(found[c].astype(kind)) for c, kind in _PARTS.items())], ["at", "part", *_PARTS])

    return _met(graph, state, columns, gather, schema).groupBy("part").applyInArrow(_merged(total, block), _WANTED)


def _decided(state: DataFrame, graph: _Graph) -> DataFrame:
    """(v, k, h, c, to, rise): the best community of each vertex of the frontier; of equal ones staying first, then the least.

    The frontier is who wanted to move and was not let, and who has a neighbour that moved to another community than theirs.
    All others, and those that want to stay, have ``to`` = ``c``.
    """
    placed = state.join(state.groupBy("c").agg(F.sum("k").alias("tot")), "c")
    wants = _wants(graph, placed)
    gain = lambda kc, tot: F.round(F.col(kc) - F.col("k") * tot / graph.total, 9)
    rise = gain("kc", F.col("to_tot")) - gain("own_kc", F.col("tot") - F.col("k"))
    return placed.join(wants, "v", "left").select("v", "k", F.xxhash64("h").alias("h"), "c", F.coalesce("to", "c").alias("to"), rise.alias("rise"))


def _inside(cell: pa.Table, state: pa.Table, kind: str) -> np.ndarray:
    """The weight of links within communities: if no one moves, and if those move whose ``turn`` is 0, 1 and so on at least."""
    here, there = _ends(cell, state)
    u, start, v, w = _whole(cell, "u", np.int32), _whole(cell, "start", np.int64), _whole(cell, "v", np.int32), _whole(cell, "w", np.float64)
    row = np.repeat(u, np.diff(start))
    c_u, c_v = _whole(here, "c", kind)[row], _whole(there, "c", kind)[v]
    t_u, t_v = _whole(here, "turn", np.int8)[row], _whole(there, "turn", np.int8)[v]
    one = lambda x: (x * w if len(w) else x).astype(np.float64)
    low, high = np.minimum(t_u, t_v), np.maximum(t_u, t_v)
    n = len(SHARES) + 1
    same = one(c_u == c_v)
    # Choice 0 moves no one, choice i the vertices with a turn of i - 1 and more.
    out = np.full(n, same.sum())
    some = np.flatnonzero(high >= 0)
    if len(some):
        w = w[some] if len(w) else w
        row, other, low, high = row[some], v[some], low[some], high[some]
        to_u, to_v = _whole(here, "to", kind)[row], _whole(there, "to", kind)[other]
        c_u, c_v, first = c_u[some], c_v[some], t_u[some] > t_v[some]
        upto = lambda turn, x: np.append(np.bincount(turn + 1, x, n)[::-1].cumsum()[::-1][1:], 0.0)
        apart, both = one(np.where(first, to_u == c_v, c_u == to_v)), one(to_u == to_v)
        # Up to the lesser turn both ends move, up to the greater one of them.
        out[1:] += (upto(high, apart) - upto(high, same[some]) + upto(low, both) - upto(low, apart))[: n - 1]
    return out


def _insides(graph: _Graph, state: DataFrame) -> DataFrame:
    """(choice, part): weights as of ``_inside``, one row for each cell and choice."""
    schema, kind = "choice int, part double", graph.kind

    def count(cell: pa.Table, state: pa.Table) -> pa.Table:
        if not cell.num_rows:
            return _empty(schema)
        found = _inside(cell, state, kind)
        return pa.table({"choice": pa.array(range(len(found)), pa.int32()), "part": pa.array(found, pa.float64())})

    return _met(graph, state, {"c": kind, "to": kind, "turn": "int8"}, count, schema)


def _turn() -> Column:
    """Of a vertex that wants to move the last of ``SHARES`` that lets it; -1 of others."""
    return F.when(F.col("to") != F.col("c"), sum((F.pmod("h", F.lit(n)) == 0).cast("int") for n in SHARES) - 1).otherwise(-1)


def _ratings(decided: DataFrame, graph: _Graph) -> tuple[int, list[float]]:
    """How many vertices want to move, and modularity (but for a constant) if none does and after each share of them does."""
    state, total = decided.withColumn("turn", _turn()), graph.total
    inside = _insides(graph, state).groupBy("choice").agg((F.sum("part") / total).alias("part"))
    willing = state.filter("turn >= 0")
    ends = F.explode(F.array(F.struct(F.col("c"), (-F.col("k")).alias("k")), F.struct(F.col("to").alias("c"), F.col("k"))))
    weights = state.select("c", "k", F.lit(-1).alias("turn")).union(willing.select(ends.alias("e"), "turn").select("e.c", "e.k", "turn"))
    own = F.sum(F.when(F.col("turn") < 0, F.col("k")).otherwise(0.0)).alias("k")
    moved = [F.sum(F.when(F.col("turn") >= i, F.col("k")).otherwise(0.0)).alias(f"m{i}") for i in range(len(SHARES))]
    after = [F.col("k"), *(F.col("k") + F.col(f"m{i}") for i in range(len(SHARES)))]
    spread = weights.groupBy("c").agg(own, *moved).agg(*[F.sum(x * x).alias(f"s{i}") for i, x in enumerate(after)])
    spread = spread.select(F.posexplode(F.array(*spread.columns)).alias("choice", "part")).withColumn("part", -F.col("part") / (total * total))
    count = willing.agg(F.lit(-1).alias("choice"), F.count("*").cast("double").alias("part"))
    rows = dict(inside.unionByName(spread).unionByName(count).groupBy("choice").agg(F.sum("part")).collect())
    return int(rows[-1]), [rows[i] for i in range(len(SHARES) + 1)]


def _one_level(graph: _Graph, max_rounds: int) -> tuple[DataFrame, bool]:
    """Local moves on one graph: (v, c), and whether they came to rest.

    Only vertices of the frontier decide: all at first, then those with a neighbour that moved to another community than theirs.
    In a round a share of those that want to move does, so neighbours do not swap places for ever: the share, of some nested ones
    that a hash (``h``, hashed again each round) makes, after which modularity is greatest. If it is raised by
    none of them, the vertex that gains most moves alone. So modularity rises in every round, and the end is that no one wants to.
    """
    state = graph.vertices.select("v", "k", "h", F.col("v").alias("c"), F.lit(False).alias("moved"), F.lit(True).alias("active"))
    step = cut_lineage(_decided(state, graph))
    for _ in range(max_rounds):
        willing, rated = _ratings(step, graph)
        if not willing:
            break
        best = max(range(len(rated)), key=lambda i: (rated[i], -i))
        if best:
            turn = F.pmod("h", F.lit(SHARES[best - 1])) == 0
        else:
            turn = F.col("v") == step.filter("to <> c").orderBy(F.desc("rise"), "v").first()["v"]
        moves = turn & (F.col("to") != F.col("c"))
        state = step.select("v", "k", "h", F.when(moves, F.col("to")).otherwise(F.col("c")).alias("c"), moves.alias("moved"), (~moves & (F.col("to") != F.col("c"))).alias("active"))
        step = replace_step(step, _decided(state, graph))
    # A community is named after its least vertex.
    least = step.groupBy("c").agg(F.min("v").alias("name"))
    return step.join(least, "c").select("v", F.col("name").alias("c")), step.filter("to <> c").isEmpty()


def _keys(df: DataFrame, n: int) -> list[int]:
    """Numbers that the shuffle deals to partitions 0 to n - 1 of n, so that each cell has a partition of its own."""
    found: dict[int, int] = {}
    at, step = 0, 16 * n
    while len(found) < n:
        ids = df.sparkSession.range(at, at + step, numPartitions=1).select(F.col("id").cast("int").alias("id"))
        for part, key in ids.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("part")).agg(F.min("id")).collect():
            found.setdefault(part, key)
        at += step
    return [found[i] for i in range(n)]


def _graph(vertices: DataFrame, n: int, links: DataFrame, block: int, cell: int) -> _Graph:
    """A level from its vertices (v, h, loop, root) and links (u, v, w), both ways and without loops."""
    size = links.count()
    blocks = max(1, -(-n // block))
    tasks = min(vertices.sparkSession.sparkContext.defaultParallelism, -(-size // (1 << 16)))
    parts = max(1, -(-size // (cell * blocks * blocks)), -(-tasks // (blocks * blocks)))
    number = blocks * parts * blocks
    keys = _keys(vertices, number)
    block_of = lambda c: F.floor(F.col(c) / block).cast("int")
    part = (block_of("u") * parts + F.pmod(F.xxhash64("u"), F.lit(parts)).cast("int")).alias("part")
    key = F.element_at(F.array(*[F.lit(k) for k in keys]), (F.col("part") * blocks + block_of("v") + 1).cast("int"))
    dealt = links.select(part, "u", "v", "w").withColumn("cell", key).repartition(number, "cell").groupBy("cell").applyInArrow(_packed_links(block), _CELL)
    cells = cut_lineage(dealt).repartition(number, "cell").persist()
    reads = sorted({(b, k) for i, k in enumerate(keys) for b in (i // blocks // parts, i % blocks)})
    reads = vertices.sparkSession.createDataFrame(reads, "block int, cell int")
    weight = cells.mapInArrow(_row_weights(block), "v long, w double").groupBy("v").agg(F.sum("w").alias("w"))
    whole = vertices.join(weight, "v", "left").withColumn("k", F.coalesce("w", F.lit(0.0)) + F.col("loop")).drop("w")
    whole = cut_lineage(whole)
    return _Graph(whole, cells, reads, float(whole.agg(F.sum("k")).first()[0]), block, blocks)


def _row_weights(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(v, w): the weight of the links of each row of a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = pa.Table.from_batches([batch.slice(i, 1)])
                start, w = _whole(cell, "start", np.int64), _whole(cell, "w", np.float64)
                sums = np.add.reduceat(w, start[:-1]) if len(w) else np.diff(start).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(_whole(cell, "u", np.int32).astype(np.int64) + block * cell["at"][0].as_py()), pa.array(sums)], ["v", "w"])

    return run


def _folded(graph: _Graph, moved: DataFrame) -> DataFrame:
    """(u, v, w): links between the communities (``moved``: v, c) of a level, loops included."""
    schema, kind = "u long, v long, w double", graph.kind

    def fold(cell: pa.Table, state: pa.Table) -> pa.Table:
        if not cell.num_rows:
            return _empty(schema)
        here, there = _ends(cell, state)
        start, w = _whole(cell, "start", np.int64), _whole(cell, "w", np.float64)
        u = _whole(here, "c", kind)[np.repeat(_whole(cell, "u", np.int32), np.diff(start))]
        v = _whole(there, "c", kind)[_whole(cell, "v", np.int32)]
        (left, u), (right, v) = np.unique(u, return_inverse=True), np.unique(v, return_inverse=True)
        key, at = np.unique(u * len(right) + v, return_inverse=True)
        sums = np.bincount(at, w if len(w) else None, len(key)).astype(np.float64)
        return pa.table({"u": left[key // len(right)].astype(np.int64), "v": right[key % len(right)].astype(np.int64), "w": sums})

    links = _met(graph, moved, {"c": kind}, fold, schema)
    loops = graph.vertices.filter("loop > 0").join(moved, "v").select(F.col("c").alias("u"), F.col("c").alias("v"), F.col("loop").alias("w"))
    return links.unionByName(loops).groupBy("u", "v").agg(F.sum("w").alias("w"))


def louvain(edges: DataFrame, src: str = "src", dst: str = "dst", max_levels: int = 30, max_rounds: int = MAX_ROUNDS, min_gain: float = 1e-6, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """(vertex, community_id, settled): community ids are the least vertex of the community.

    Rounds go on until no vertex wants to decide again, and levels, on the graph of communities, until none raises
    modularity; nothing is random. The bounds are a guard: ``settled`` is false if one was met.
    """
    one = edges.select(F.col(src).cast("string").alias("a"), F.col(dst).cast("string").alias("b")).filter("a <> b")
    pairs = cut_lineage(one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # Numbers in the order of the names stand for vertices.
    names, n = _numbered(pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct(), "name", "v")
    if not n:
        return pairs.select(F.col("a").alias("vertex"), F.col("b").alias("community_id"), F.lit(True).alias("settled"))
    names = cut_lineage(names)
    ends = pairs.join(names.select(F.col("name").alias("a"), F.col("v").alias("x")), "a").join(names.select(F.col("name").alias("b"), F.col("v").alias("y")), "b")
    ends = replace_step(pairs, ends.select("x", "y"))
    links = ends.toDF("u", "v").union(ends.select("y", "x")).withColumn("w", F.lit(1.0))
    # ``root``: the number of the vertex that a community is named after.
    vertices = names.select("v", F.xxhash64("name").alias("h"), F.lit(0.0).alias("loop"), F.col("v").alias("root"))
    graph = _graph(vertices, n, links, block, cell)
    members, settled = cut_lineage(names.select("v", F.col("v").alias("c"))), True
    squares = lambda g: float(g.vertices.agg(F.sum(F.col("k") * F.col("k"))).first()[0]) / (g.total * g.total)
    inner = lambda g: float(g.vertices.agg(F.sum("loop")).first()[0]) / g.total
    quality = inner(graph) - squares(graph)
    for _ in range(max_levels):
        moved, rest = _one_level(graph, max_rounds)
        settled, moved = settled and rest, cut_lineage(moved)
        folded = cut_lineage(_folded(graph, moved))
        # The communities in the order of their least vertices are the vertices of the next level.
        found, n = _numbered(moved.select("c").distinct(), "c", "n")
        found = cut_lineage(found)
        loops = folded.filter("u = v").select(F.col("u").alias("c"), F.col("w").alias("loop"))
        vertices = found.join(graph.vertices.select(F.col("v").alias("c"), "h", "root"), "c").join(loops, "c", "left")
        vertices = cut_lineage(vertices.select(F.col("n").alias("v"), "h", F.coalesce("loop", F.lit(0.0)).alias("loop"), "root"))
        links = folded.filter("u <> v").join(found.toDF("u", "nu"), "u").join(found.toDF("v", "nv"), "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"), "w")
        level = _graph(vertices, n, links, block, cell)
        better = inner(level) - squares(level)
        graph.cells.unpersist()
        if better <= quality + min_gain:
            level.cells.unpersist()
            break
        merged = members.withColumnRenamed("c", "v_").join(moved.toDF("v_", "c"), "v_").join(found, "c").select("v", F.col("n").alias("c"))
        quality, members, graph = better, replace_step(members, merged), level
    else:
        graph.cells.unpersist()
        settled = False
    out = members.join(names.select("v", F.col("name").alias("vertex")), "v").join(graph.vertices.select(F.col("v").alias("c"), "root"), "c")
    out = out.join(names.select(F.col("v").alias("root"), F.col("name").alias("community_id")), "root")
    return out.select("vertex", "community_id", F.lit(settled).alias("settled"))
