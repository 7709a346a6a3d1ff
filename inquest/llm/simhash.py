"""SimHash near-duplicates by anchor-point covering.

Two fingerprints of 64 bits that differ in at most 3 differ in at most 1 bit of one of two halves of 31 bits (the last
two bits are in neither). The anchors of a half are the words of the Hamming code of length 31: a perfect covering code
of radius 1, so each fingerprint has one anchor within 1 (its home), and an anchor within 1 of x is within 2 of every y
that differs from x in at most 1 bit of the half. So each fingerprint is sent to all anchors within covering radius plus
threshold, 1 + 1, of either half: home and some fifteen more. At an anchor those at home are compared with all.

Only distinct fingerprints are compared. An anchor with more than ``CHUNK`` of them is cut into chunks by a hash, and
each pair of chunks is a group of its own, so no task holds an unbounded group. A batch of groups gives out one link
per fingerprint to the least one of its connected set, not all pairs; connected sets stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquest.llm.common import land, scratch
from inquest.operators.components import connected_components

SEED = 42
SHINGLE = 3
THRESHOLD = 3
HALF_BITS = 31
CHUNK = 4096
#: Pairs that are compared at a time in one task.
PAIRS = 1 << 21

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles whose bits are counted at a time.
_PIECE = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is 1 in over half of the shingles' hashes; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    spans = [words[i:] for i in range(min(shingle, len(words)))]
    n = len(spans[-1])
    ones = np.zeros(64, np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in map(b" ".join, zip(*spans))), np.uint64, n)
    for at in range(0, n, _PIECE):
        part = hashes[at : at + _PIECE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(x) for x in batch.column(batch.num_columns - 1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], [*batch.schema.names[:-1], "fp"])


def with_fingerprints(docs: DataFrame, keep: str, text: str = "text") -> DataFrame:
    """(keep, fp) of every row; fp is the fingerprint as a signed long. Null texts are empty ones."""
    slim = docs.select(F.col(f"`{keep}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(_fingerprints, f"id {docs.schema[keep].dataType.simpleString()}, fp long")


def _syndrome(x: np.ndarray) -> np.ndarray:
    """The place (1 to 31) of the bit in which a word differs from its anchor; 0 if it is one."""
    out = np.zeros(len(x), np.uint64)
    for place in range(1, HALF_BITS + 1):
        out ^= ((x >> np.uint64(place - 1)) & np.uint64(1)) * np.uint64(place)
    return out


def _flip(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """x with the bit at a place (from 1) turned; place 0 turns none."""
    return x ^ np.where(place > 0, np.uint64(1) << (np.maximum(place, 1) - np.uint64(1)), np.uint64(0))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mask = np.uint64((1 << HALF_BITS) - 1)
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for half in (0, 1):
            part = (prints >> np.uint64(half * HALF_BITS)) & mask
            away = _syndrome(part)
            keys, who = [_flip(part, away)], [prints]
            # Anchors at distance 2: turn bit i, then the one that the new syndrome names. A fingerprint that is one
            # bit from home has those that are one further bit from i; one that is an anchor has none at distance 2.
            for i in range(1, HALF_BITS + 1):
                at = np.uint64(i)
                second = away ^ at
                ok = (away > 0) & (second > 0) & (second > at) & (at != away)
                keys.append(_flip(_flip(part[ok], np.full(ok.sum(), at)), second[ok]))
                who.append(prints[ok])
            home = np.concatenate([np.ones(len(prints), bool), np.zeros(sum(map(len, who[1:])), bool)])
            anchor = np.concatenate(keys) | np.uint64(half << HALF_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(np.concatenate(who).view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])


def _spanning(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end of the links and the least end of its connected set, where they differ."""
    nodes, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = ends[: len(left)], ends[len(left) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _compare(groups: np.ndarray, prints: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among sorted, complete groups, as spanning sets for every ``PAIRS`` comparisons."""
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    size = np.diff(np.r_[first, len(groups)])
    start, length = np.repeat(first, size), np.repeat(size, size)
    homes = np.flatnonzero(home & (length > 1))
    lengths = length[homes]
    ends = np.cumsum(lengths)
    at = 0
    while at < len(homes):
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        own, n = homes[at:until], lengths[at:until]
        x = np.repeat(own, n)
        y = np.repeat(start[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        near = (np.bitwise_count(prints[x] ^ prints[y]) <= THRESHOLD) & (prints[x] != prints[y])
        if near.any():
            yield _spanning(prints[x[near]], prints[y[near]])
        at = until


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by group; a group that goes on in the next batch waits for it."""
    held: list[np.ndarray] | None = None

    def out(groups, prints, home):
        for a, b in _compare(groups, prints, home):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["src", "dst"])

    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        now[1] = now[1].view(np.uint64)
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        yield from out(*(x[:cut] for x in now)) if cut else ()
        held = [x[cut:] for x in now]
    if held is not None and len(held[0]):
        yield from out(*held)


def anchors(prints: DataFrame) -> DataFrame:
    """(anchor, fp, home) from a frame of distinct fingerprints ``fp``: two at distance 3 or less meet where one is at home."""
    return prints.mapInArrow(_anchors, "anchor long, fp long, home boolean")


def links(prints: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(src, dst) from a frame of distinct fingerprints ``fp``: links that connect what pairs at distance 3 or less connect."""
    sent = anchors(prints)
    # An anchor counts if someone is at home there and someone else is there too.
    live = sent.groupBy("anchor").agg(F.count("*").alias("n"), F.max("home").alias("any")).filter("n > 1 AND any").select("anchor", "n")
    rows = sent.join(live.hint("merge"), "anchor").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    # Pair (i, j) of chunks: those of chunk i at home meet all of chunk j.
    homes = rows.filter("home").withColumn("j", every).select("anchor", own.alias("i"), "j", "fp", F.lit(True).alias("home"))
    others = rows.withColumn("i", every).withColumn("j", own).filter("NOT (home AND i = j)").select("anchor", "i", "j", "fp", F.lit(False).alias("home"))
    group = F.xxhash64("anchor", "i", "j").alias("group")
    dealt = homes.unionByName(others).select(group, "fp", "home").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(_links, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``.

    ``component_id`` is the least doc_id that links of at most 3 differing bits reach, its own included. Equal
    fingerprints are linked, so copies and texts without words (null or empty, fingerprint 0) come together. Rows without
    a doc_id take part and get the least id of their component, null if it has none. Repeated rows are returned as
    often as they come. An empty table gives an empty result. Other columns are not read. No join is a broadcast: all sides
    grow with the input, and the driver holds none of them.
    """
    folder = scratch(docs.sparkSession, "simhash")
    marked = land(with_fingerprints(docs, doc_id, text), f"{folder}/prints")
    prints = land(marked.groupBy("fp").agg(F.min("id").alias("least")), f"{folder}/distinct")
    found = land(links(prints.select("fp")), f"{folder}/links")
    joined = connected_components(found)
    joined = joined.select(F.col("vertex").alias("fp"), F.col("component").alias("set"))
    sets = land(prints.join(joined.hint("merge"), "fp", "left").withColumn("set", F.coalesce("set", "fp")), f"{folder}/sets")
    least = sets.groupBy("set").agg(F.min("least").alias("component_id"))
    named = land(sets.join(least.hint("merge"), "set").select("fp", "component_id"), f"{folder}/named")
    return marked.join(named.hint("merge"), "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")
