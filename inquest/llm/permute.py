"""Pseudorandom permutations of 0..n-1 as column expressions: a Feistel network with cycle walking.

A number below ``m * m``, with ``m`` the least whole number whose square reaches n, is split into two digits of base m.
Each round swaps the digits and adds a keyed function of one to the other, so the network is a permutation of the
square whatever that function is. Results of n or more are put through it again until one falls below n. The square
has at most 2 * sqrt(n) + 1 numbers that are too large, so one walk in sqrt(n) takes a second step.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inquest.llm.common import let

PRIME = 2147483647
#: Multiplier and summand of each round; fixed, so that every run and every engine gives the same order.
ROUNDS = ((1103515245, 12345), (69069, 1234567), (1664525, 1013904223), (22695477, 91648253), (134775813, 271828182), (214013, 2531011))
#: A walk of so many steps has not been met; one that is longer stops the job instead of giving a wrong number.
STEPS = 200


def side(n: Column) -> Column:
    """The least m with m * m >= n, exact for n up to 2^61."""
    root = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    root = F.when((root - 1) * (root - 1) >= n, root - 1).otherwise(root)
    return F.greatest(F.when(root * root < n, root + 1).otherwise(root), F.lit(1)).cast("long")


def _pass(x: Column, m: Column, key: Column) -> Column:
    def round_of(a: int, b: int):
        def one(digits: Column) -> Column:
            left, right = digits["l"], digits["r"]
            mixed = (right * F.lit(a) + F.lit(b) + key) % F.lit(PRIME)
            return F.struct(right.alias("l"), let(mixed, lambda t: (left + (t * t) % F.lit(PRIME)) % m).alias("r"))

        return one

    state = F.struct(((x - x % m) / m).cast("long").alias("l"), (x % m).alias("r"))
    for a, b in ROUNDS:
        state = let(state, round_of(a, b))
    return let(state, lambda s: s["l"] * m + s["r"])


def permuted(x: Column, n: Column, key: Column) -> Column:
    """The place of ``x`` in the permutation of 0..n-1 that ``key`` (0 to 2^31) names; all are long columns."""
    x, n, key = x.cast("long"), n.cast("long"), key.cast("long")

    def walk(m: Column) -> Column:
        first = _pass(x, m, key)
        steps = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), first, lambda at, _: F.when(at < n, at).otherwise(_pass(at, m, key)))
        return F.when(first < n, first).otherwise(steps)

    def checked(y: Column) -> Column:
        return F.when(y < n, y).otherwise(F.raise_error(F.lit("cycle walk is too long")).cast("long"))

    return let(let(side(n), walk), checked)


def permuted_sql(x: str, n: str, key: str, source: str, keep: str) -> str:
    """The same in SQL: a query with the columns ``keep`` and ``place`` over ``source``."""
    start = f"SELECT {keep}, ({x})::BIGINT AS x, ({n})::BIGINT AS n, ({key})::BIGINT AS k, greatest(ceil(sqrt(({n})::DOUBLE)), 1)::BIGINT AS m FROM {source}"

    def network(rows: str) -> str:
        rows = f"SELECT *, x // m AS l, x % m AS r FROM ({rows})"
        for a, b in ROUNDS:
            rows = f"SELECT * EXCLUDE (l, r, t), r AS l, (l + (t * t) % {PRIME}) % m AS r FROM (SELECT *, (r * {a} + {b} + k) % {PRIME} AS t FROM ({rows}))"
        return f"SELECT * EXCLUDE (x, l, r), l * m + r AS x FROM ({rows})"

    return (
        f"WITH RECURSIVE walk AS ({network(start)} UNION ALL {network('SELECT * FROM walk WHERE x >= n')}) "
        f"SELECT {keep}, x AS place FROM walk WHERE x < n"
    )
