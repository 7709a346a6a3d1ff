"""Distinct neighbours of accounts that share groups, counted without pairs of members.

Accounts with the same set of groups are one class, and the union of its groups is counted once for all of them. Of an
account's direct partners those that are in the union are left out, the others are added.

Classes are dealt to blocks, and accounts, as neighbours, to slices; a task has one block and one slice. There a group with
many members in the slice is a bitmap of them, any other a list. Slices have no account in common, so
their counts add up. A row is an account with a list of numbers, one list for each range of ``RANGE`` numbers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquest.session import cut_lineage, replace_step

#: Memberships in a slice, and accounts in a block, about; blocks are smaller, down to the second, where cores would be idle.
SLICE_ROWS = 8_000_000
BLOCK_ACCOUNTS, LEAST_BLOCK = 1 << 16, 1 << 12
RANGE = 4096

_MEMBER, _GROUPS, _DIRECT = 0, 1, 2


def _rows(table: pa.Table, role: int, *ids: str) -> tuple[np.ndarray, ...]:
    """(ids, number) of all lists of a role."""
    part = table.filter(pc.equal(table["role"], role)).combine_chunks()
    lengths = pc.list_value_length(part["list"]).to_numpy().astype(np.int64)
    return *(np.repeat(part[c].to_numpy(), lengths) for c in ids), pc.list_flatten(part["list"]).to_numpy()


def _places(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value is; -1 if it is not there."""
    if not len(sorted_values):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return np.where(sorted_values[at] == wanted, at, -1)


def _counter(list_size: int) -> Callable[[pa.Table], pa.Table]:
    def count(table: pa.Table) -> pa.Table:
        member, gid = _rows(table, _MEMBER, "id")
        people, seat = np.unique(member, return_inverse=True)
        order = np.argsort(gid, kind="stable")
        groups, first, size = np.unique(gid[order], return_index=True, return_counts=True)
        seat = seat[order].astype(np.int32)
        width = -(-max(len(people), 1) // 64) * 8
        # A bitmap takes no more than 8 bytes a membership.
        wide = np.flatnonzero(size > max(list_size, len(people) // 64))
        bitmap_of = np.full(len(groups), -1)
        bitmap_of[wide] = np.arange(len(wide))
        maps = np.zeros((len(wide), width), np.uint8)
        flags = np.zeros(width * 8, bool)
        for i, g in enumerate(wide):
            here = seat[first[g] : first[g] + size[g]]
            flags[here] = True
            maps[i] = np.packbits(flags)
            flags[here] = False
        maps = maps.view(np.uint64)

        own, part, asked = _rows(table, _GROUPS, "class", "part")
        place = _places(groups, asked)
        # The first part of a class reports its union.
        report = np.unique(own[part == 0])
        own, place = own[place >= 0], place[place >= 0]
        by = np.argsort(own, kind="stable")
        own, place = own[by], place[by]
        of, payer, partner = _rows(table, _DIRECT, "class", "id")
        by = np.lexsort((payer, of))
        of, payer, partner = of[by], payer[by], _places(people, partner[by])
        classes = np.unique(np.concatenate([own, of]))
        own_at, pay_at = (np.searchsorted(x, np.append(classes, np.iinfo(np.int64).max)) for x in (own, of))
        unions = np.zeros(len(classes), np.int64)
        # Partners that are in no group of the slice are in no union.
        beside = partner < 0
        for i in range(len(classes)):
            mine, pays = place[own_at[i] : own_at[i + 1]], slice(pay_at[i], pay_at[i + 1])
            maps_of = bitmap_of[mine]
            near = [seat[first[g] : first[g] + size[g]] for g in mine[maps_of < 0]]
            near = np.concatenate(near) if near else seat[:0]
            flags[near] = True
            direct = partner[pays]
            if (maps_of >= 0).any():
                union = np.bitwise_or.reduce(maps[maps_of[maps_of >= 0]], axis=0) | np.packbits(flags).view(np.uint64)
                unions[i] = int(np.bitwise_count(union).sum())
                inside = union.view(np.uint8)[direct >> 3] >> (7 - (direct & 7)).astype(np.uint8) & 1 > 0
            else:
                unions[i] = len(np.unique(near))
                inside = flags[direct]
            beside[pays] |= ~inside
            flags[near] = False
        told = np.isin(classes, report)
        payers, extra = np.unique(payer[beside], return_counts=True)
        ids = np.concatenate([classes[told], payers])
        return pa.table({"id": pa.array(ids, pa.int64()), "of_class": pa.array(np.arange(len(ids)) < told.sum()), "n": pa.array(np.concatenate([unions[told], extra]), pa.int64())})

    return count


def _classes(held: DataFrame) -> DataFrame:
    """(id, class): accounts with the same groups, named by the least of them; from (id, range, list), lists in order.

    128 bits stand for a list, so a row is short for accounts of any number of groups.
    """
    marks = F.struct("range", F.xxhash64("list").alias("a"), F.xxhash64(F.lit(1), "list").alias("b"))
    signed = held.groupBy("id").agg(F.array_sort(F.collect_list(marks)).alias("groups"))
    least = signed.groupBy("groups").agg(F.min("id").alias("class"))
    return signed.join(least, "groups").select("id", "class")


def neighbour_counts(members: DataFrame, direct: DataFrame, list_size: int, slice_rows: int = SLICE_ROWS, block_accounts: int = BLOCK_ACCOUNTS) -> DataFrame:
    """(account, n): how many others are in a group with an account or are its direct partners, if any.

    ``members`` (kind, value, account), distinct; ``direct`` (account, other), one way, never both the same. Groups of up to
    ``list_size`` members in a slice are lists there.
    """
    members, direct = cut_lineage(members), cut_lineage(direct.distinct())
    groups = cut_lineage(members.select("kind", "value").distinct().withColumn("gid", F.monotonically_increasing_id()))
    everyone = members.select("account").union(direct.select("account")).union(direct.select("other")).distinct()
    everyone = cut_lineage(everyone.withColumnRenamed("account", "name").withColumn("id", F.monotonically_increasing_id()))
    held = members.join(groups, ["kind", "value"]).join(everyone, F.col("account") == F.col("name")).select("id", "gid")
    held = replace_step(members, held.groupBy("id", F.floor(F.col("gid") / RANGE).alias("range")).agg(F.array_sort(F.collect_list("gid")).alias("list")))
    belongs = cut_lineage(_classes(held))
    named = direct.join(everyone, F.col("account").eqNullSafe(F.col("name"))).select("id", "other")
    named = named.join(everyone.withColumnRenamed("id", "to"), F.col("other").eqNullSafe(F.col("name"))).select("id", "to")
    # Accounts without groups are classes of their own.
    named = cut_lineage(named.join(belongs, "id", "left").withColumn("class", F.coalesce("class", "id")))
    memberships = held.agg(F.coalesce(F.sum(F.size("list")), F.lit(0))).first()[0]
    accounts = max(belongs.agg(F.count_distinct("class")).first()[0], named.agg(F.count_distinct("id")).first()[0])
    slices = max(1, -(-memberships // slice_rows))
    busy = -(-2 * held.sparkSession.sparkContext.defaultParallelism // slices)
    blocks = max(1, -(-accounts // block_accounts), min(busy, -(-accounts // LEAST_BLOCK)))
    # A class of more accounts than a block is told to several blocks, which share its accounts.
    sizes = belongs.groupBy("class").agg(F.ceil(F.count("*") / block_accounts).cast("int").alias("parts"))
    part_of = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    slice_of = lambda c: F.pmod(F.xxhash64(c), F.lit(slices)).cast("int")
    block_of = F.pmod(F.xxhash64("class", "part"), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cell = lambda block, slice: (block * slices + slice).cast("int").alias("cell")
    columns = ["cell", "role", "class", "part", "id", "list"]
    there = held.withColumn("block", every(F.lit(blocks))).select(cell(F.col("block"), slice_of("id")), F.lit(_MEMBER).alias("role"), F.col("id").alias("class"), F.lit(0).alias("part"), "id", "list")
    asks = held.join(sizes, F.col("id") == F.col("class")).withColumn("part", every(F.col("parts"))).withColumn("slice", every(F.lit(slices)))
    asks = asks.select(cell(block_of, F.col("slice")), F.lit(_GROUPS).alias("role"), "class", "part", "id", "list")
    pays = named.join(sizes, "class", "left").withColumn("part", part_of).groupBy("class", "part", "id", slice_of("to").alias("slice"), F.floor(F.col("to") / RANGE).alias("range"))
    pays = pays.agg(F.collect_list("to").alias("list")).select(cell(block_of, F.col("slice")), F.lit(_DIRECT).alias("role"), "class", "part", "id", "list")
    dealt = there.unionByName(asks).unionByName(pays).select(*columns)
    found = replace_step(held, dealt.groupBy("cell").applyInArrow(_counter(list_size), "id long, of_class boolean, n long"))
    # An account is in the union of its own groups.
    unions = found.filter("of_class").groupBy(F.col("id").alias("class")).agg((F.sum("n") - 1).alias("n"))
    total = belongs.join(unions, "class").select("id", "n").unionByName(found.filter("NOT of_class").select("id", "n"))
    total = total.groupBy("id").agg(F.sum("n").alias("n")).filter("n > 0")
    return total.join(everyone, "id").select(F.col("name").alias("account"), "n")
