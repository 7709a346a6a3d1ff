"""Near duplicates of whole texts by HyperMinHash, confirmed on full shingle sets.

A text's set has its distinct five-word shingles as 64-bit hashes. The top bits of a hash choose one of ``REGISTERS`` buckets; of
the least hash of a bucket, the bucket's register has the number of leading zeros (6 bits) and the bits after the first
one (10). An empty bucket takes the register of the bucket that comes first, of those that are not empty, in an order of
its own, so small sets are compared as large ones are.

Bands of ``ROWS`` registers give candidates: a pair at similarity s shares one with chance 1 - (1 - s^6)^42 at least, which
is all but 2 in a billion at 0.85. The estimate of a pair's similarity from equal registers, less the share that different
hashes make equal, rejects candidates that are far below the limit (six standard deviations); the rest is confirmed by
counting common shingles.

Equal sets are one text. In a group of texts that share a band, each is first compared with one leader, in chunks of
the leader's followers, so a crowd of copies of any size costs one comparison per text. What these links connect needs no
more comparison. Only bands that still hold texts of different components go on: there every pair of different
components counts, once, in the first band that it shares. Texts outside the leader's component meet all others in pairs
of chunks, first by registers alone; full sets are sent only of texts that have a likely partner. Links between
components come out spanning, not as pairs.

A caller may ask for the links of method 1 as well: SimHash fingerprints that differ in few bits, found by anchors. They are
confirmed on full sets beside those of the leaders, before any band is looked at for more. They come out spanning, so a pair
that they connect by way of others is not a link itself, and others are left unconfirmed: texts of different components that
meet at an anchor count in pairs, as those that share a band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.llm import simhash
from inquest.llm.common import land, row_keys, scratch
from inquest.operators.components import connected_components

SEED = 42
SHINGLE = 5
#: Least similarity, as a fraction.
SIMILARITY = (85, 100)
REGISTERS, MANTISSA = 256, 10
ROWS = 6
BANDS = REGISTERS // ROWS
#: Texts and shingles of a chunk.
CHUNK, CHUNK_SHINGLES = 256, 1 << 20
SIGMAS = 6.0
#: In place of the number of a band: a group of texts that meet at an anchor of method 1.
ANCHOR = -1

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_random = np.random.RandomState(SEED)
_PLACES = _random.randint(0, 1 << 62, SHINGLE, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES = _random.randint(0, 1 << 62, ROWS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _random.randint(0, 1 << 62, BANDS, np.int64).astype(np.uint64)
#: For each bucket the order in which others stand in for it.
_STAND_IN = np.argsort(_random.random_sample((REGISTERS, REGISTERS)), axis=1)
_BUCKET_BITS = REGISTERS.bit_length() - 1
_BUCKET_STARTS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - _BUCKET_BITS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of five words, A-Z as a-z; of a shorter text the whole is one."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    length = min(SHINGLE, len(words))
    n = len(words) - length + 1
    # The length keeps a text of three words from being a shingle of five.
    out = np.full(n, length, np.uint64)
    for i in range(length):
        out += hashes[i : i + n] * _PLACES[i]
    return np.unique(_mix(out))


def registers(shingles: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of the least hash of each bucket, 16 bits together; the set is not empty."""
    first = np.searchsorted(shingles, _BUCKET_STARTS)
    filled = np.diff(np.append(first, len(shingles))) > 0
    rest = shingles[np.minimum(first, len(shingles) - 1)] << np.uint64(_BUCKET_BITS)
    # 53 bits are exact as a float; fewer than one bucket in 10^15 has more leading zeros.
    zeros = 53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]
    after = (rest << zeros.astype(np.uint64)) << np.uint64(1)
    out = (zeros << MANTISSA).astype(np.uint16) | (after >> np.uint64(64 - MANTISSA)).astype(np.uint16)
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _STAND_IN[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    values = (regs[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64) * _VALUES).sum(axis=1, dtype=np.uint64)
    return _mix(values + _BAND).view(np.int64)


def chance_equal(size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Chance that two different least hashes of a bucket, of sets of these sizes, have equal registers.

    The hashes fall into intervals, those of one register; a bucket's least has the density a e^(-a x), a = size / buckets.
    """
    a, b = np.asarray(size_a, float) / REGISTERS, np.asarray(size_b, float) / REGISTERS
    total = np.zeros(np.broadcast(a, b).shape)
    for zeros in range(54):
        low, high = 2.0 ** -(zeros + 1), 2.0**-zeros
        total += low / (1 << MANTISSA) * (np.exp(-(a + b) * low) - np.exp(-(a + b) * high))
    return total * a * b / (a + b) / (-np.expm1(-a) * -np.expm1(-b))


def estimate(equal: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Similarity from the number of equal registers, corrected for chance."""
    chance = chance_equal(size_a, size_b)
    return (equal / REGISTERS - chance) / (1 - chance)


def likely(equal: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Pairs that can be similar: by their sizes, and by an estimate that is not far below the limit."""
    top, bottom = similarity
    limit = top / bottom
    equal, size_a, size_b = np.broadcast_arrays(equal, size_a, size_b)
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    # Of a small set many buckets are empty, and only the others are samples.
    samples = np.maximum(1.0, REGISTERS * -np.expm1(-large / REGISTERS))
    least = limit - 0.02 - SIGMAS * np.sqrt(limit * (1 - limit) / samples)
    # Chance only lowers an estimate, so it is reckoned where the bare share of equal registers is enough.
    out = (bottom * small >= top * large) & (equal / REGISTERS >= least - 1e-9)
    if out.any():
        out[out] = estimate(equal[out], size_a[out], size_b[out]) >= least[out]
    return out


def similar(a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> bool:
    """Exact test on two sorted sets."""
    top, bottom = similarity
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int((b[place] == a).sum())
    return bottom * common >= top * (len(a) + len(b) - common)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Fewer rows at a time: sets are as large as their texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _sketched(fingerprints):
    """Digest, size and registers of the sets; with ``fingerprints`` also the texts' SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = batch.column(1).to_pylist()
            sets = [shingle_set(t) for t in texts]
            digests = [xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets]
            regs = [registers(s).tobytes() if len(s) else None for s in sets]
            columns, names = [batch.column(0), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(regs, pa.binary())], ["key", "digest", "size", "regs"]
            if fingerprints:
                prints = np.fromiter((simhash.fingerprint(t) for t in texts), np.uint64, len(texts))
                columns, names = [*columns, pa.array(prints.view(np.int64))], [*names, "fp"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        nums, out = batch.column(0).to_numpy(), [bands(r) for r in _regs(batch.column(1))]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out)), pa.array(np.tile(np.arange(BANDS, dtype=np.int8), len(out))), pa.array(np.repeat(nums, BANDS))], ["band", "b", "num"]
            )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by band and number, those whose band is not alone, with the least number of the band as leader."""
    last = None

    def out(rows):
        band, b, num = rows
        first = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
        size = np.diff(np.r_[first, len(band)])
        keep = np.repeat(size > 1, size)
        return [band[keep], b[keep], num[keep]], np.repeat(num[first], size)[keep]

    def batch_of(rows, leader):
        return pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(leader)], ["band", "b", "num", "leader"])

    # A band that goes on in the next batch is held by its first row and one that has not been given out yet.
    pending, leader, given = None, None, False
    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        if not len(rows[0]):
            continue
        if last is not None and rows[0][0] == last:
            n = int(np.searchsorted(rows[0] != last, True)) if (rows[0] != last).any() else len(rows[0])
            more = [c[:n] for c in rows]
            if pending is not None:
                more, pending = [np.concatenate(p) for p in zip(pending, more)], None
            yield batch_of(more, np.full(len(more[0]), leader))
            given = True
            rows = [c[n:] for c in rows]
            if not len(rows[0]):
                continue
        # The last run may go on.
        cut = int(np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])[-1])
        if cut:
            whole, leaders = out([c[:cut] for c in rows])
            if len(leaders):
                yield batch_of(whole, leaders)
        tail = [c[cut:] for c in rows]
        last, leader, given = tail[0][0], tail[2][0], len(tail[0]) > 1
        pending = None if given else tail
        if given:
            yield batch_of(tail, np.full(len(tail[0]), leader))


def _likely_pairs(similarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                size_a, size_b = (batch.column(c).to_numpy() for c in ("size", "l_size"))
                equal = (_regs(batch.column("regs")) == _regs(batch.column("l_regs"))).sum(axis=1)
                keep = pa.array(likely(equal, size_a, size_b, similarity))
                yield batch.select(["num", "leader"]).filter(keep)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles and registers in place of texts; rows that repeat a text of the task go."""
    seen: set[int] = set()
    for batch in _slices(batches):
        nums, sets = [], []
        for num, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if num not in seen:
                seen.add(num)
                nums.append(num)
                sets.append(shingle_set(text))
        columns = [pa.array(nums, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([registers(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["num", "size", "regs", "shingles"])


def _followers(similarity):
    """Links of followers to their leader; the leader comes first in each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leader = None, None
        for batch in batches:
            src, dst = [], []
            for who, num, shingles in zip(*(batch.column(c).to_pylist() for c in ("leader", "num", "shingles"))):
                own = np.frombuffer(shingles, np.uint64)
                if num == who:
                    at, leader = who, own
                elif at == who and similar(own, leader, similarity):
                    src.append(num)
                    dst.append(who)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one group at a time, from batches sorted by the first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], len(group)]):
            part = batch.slice(a, b - a)
            if held and held[0].column(0)[0].as_py() != group[a]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _candidates(batch: pa.RecordBatch, regs: np.ndarray, similarity) -> Iterator[tuple[int, np.ndarray]]:
    """Pairs of rows of a group that this group has to settle: row, and the rows that it is likely similar to."""
    b, num, comp, size = (batch.column(c).to_numpy() for c in ("b", "num", "comp", "size"))
    home, away, outside = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("home", "away", "outside"))
    top, bottom = similarity
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    for x in np.flatnonzero(home):
        # Two that are both outside the leader's component meet once, from the greater one.
        ask = np.flatnonzero(away & (comp != comp[x]) & (~outside | (num < num[x])))
        if not len(ask):
            continue
        ask = ask[bottom * np.minimum(size[ask], size[x]) >= top * np.maximum(size[ask], size[x])]
        same = regs[ask] == regs[x]
        # At an anchor all count, also those that share no band.
        here = np.ones(len(ask), bool) if b[x] == ANCHOR else same[:, : BANDS * ROWS].reshape(len(ask), BANDS, ROWS).all(axis=2).argmax(axis=1) == b[x]
        if here.any():
            found.append((x, ask[here], same[here].sum(axis=1)))
    if not found:
        return
    # One estimate for all pairs of the group: its cost is by call, not by pair.
    counts = [len(ask) for _, ask, _ in found]
    every = np.concatenate([ask for _, ask, _ in found])
    ok = likely(np.concatenate([equal for *_, equal in found]), size[every], np.repeat(size[[x for x, *_ in found]], counts), similarity)
    for (x, ask, _), keep in zip(found, np.split(ok, np.cumsum(counts)[:-1])):
        if keep.any():
            yield x, ask[keep]


def _asked(similarity):
    """Rows of a group that have a likely partner there, by registers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches):
            wanted = np.zeros(batch.num_rows, bool)
            for x, others in _candidates(batch, _regs(batch.column("regs")), similarity):
                wanted[x] = wanted[others] = True
            yield batch.filter(pa.array(wanted)).select([c for c in batch.schema.names if c != "regs"])

    return run


def _joined(similarity):
    """Links between components, as few as connect what the group's pairs connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches):
            sets = [np.frombuffer(s, np.uint64) for s in batch.column("shingles").to_pylist()]
            comp = batch.column("comp").to_numpy()
            label = {int(c): int(c) for c in comp}

            def root(c: int) -> int:
                while label[c] != c:
                    label[c] = c = label[label[c]]
                return c

            src, dst = [], []
            for x, others in _candidates(batch, np.stack([registers(s) for s in sets]), similarity):
                for y in others:
                    a, b = root(int(comp[x])), root(int(comp[y]))
                    if a != b and similar(sets[x], sets[y], similarity):
                        label[max(a, b)] = min(a, b)
                        src.append(max(a, b))
                        dst.append(min(a, b))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return run


def _chunks(n: Column, shingles: Column, chunk: int) -> Column:
    return F.greatest(F.ceil(n / chunk), F.ceil(shingles / CHUNK_SHINGLES)).cast("int")


def _connected(nums: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``nums`` (num, ...) with ``name``: the least number that links connect."""
    found = connected_components(links).select(F.col("vertex").alias("c_num"), "component")
    return nums.join(found, F.col("num") == F.col("c_num"), "left").withColumn(name, F.coalesce("component", "num")).drop("c_num", "component")


@dataclass(frozen=True)
class Classes:
    """``marked``: key, digest, size of every row. ``named``: digest, least (key of the class) of every distinct set with a shingle."""

    marked: DataFrame
    named: DataFrame


def _fingerprint_links(marked: DataFrame, prints: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Sets to confirm, from texts whose SimHash fingerprints are linked by method 1 or equal.

    First (num, leader): each fingerprint stands for the least number that has it; its other sets follow that one, and the
    links between fingerprints are spanning. Then (band, b, num): the sets that have such a link, by the anchors where they meet, all
    pairs at distance 3 or less among them.
    """
    who = marked.filter("size > 0").select("digest", "fp").distinct()
    who = land(who.join(prints.select("digest", "num").hint("merge"), "digest").select("fp", "num"), f"{folder}/who")
    heads = land(who.groupBy("fp").agg(F.min("num").alias("head")), f"{folder}/heads")
    found = land(simhash.links(heads.select("fp")), f"{folder}/near_prints")
    near = found.join(heads.toDF("src", "num").hint("merge"), "src").join(heads.toDF("dst", "leader").hint("merge"), "dst").select("num", "leader")
    equal = who.join(heads.hint("merge"), "fp").select("num", F.col("head").alias("leader"))
    near = land(near.unionByName(equal).filter("num <> leader").distinct(), f"{folder}/near")
    linked = near.select("num").union(near.select("leader")).distinct()
    linked = land(who.join(linked.hint("merge"), "num").select("fp", "num"), f"{folder}/linked")
    sent = simhash.anchors(linked.select("fp").distinct()).join(linked.hint("merge"), "fp")
    live = sent.groupBy("anchor").agg(F.count("*").alias("n"), F.max("home").alias("any")).filter("n > 1 AND any").select("anchor")
    met = sent.join(live.hint("merge"), "anchor").select(F.xxhash64("anchor").alias("band"), F.lit(ANCHOR).cast("byte").alias("b"), "num").distinct()
    return near, land(met, f"{folder}/met")


def near_classes(rows: DataFrame, similarity: tuple[int, int] = SIMILARITY, chunk: int = CHUNK, fingerprints: bool = False) -> Classes:
    """Classes of rows (key, a, b, text): what links of at least ``similarity`` connect, named by the least key.

    ``a`` and ``b`` tell rows apart by key and text, the same in every pass. With ``fingerprints`` the links of
    ``simhash.links`` are candidates too.
    """
    folder = scratch(rows.sparkSession, "hyperminhash")
    kind = rows.schema["key"].dataType.simpleString()
    keyed = rows.select(F.struct("key", "a", "b").alias("key"), "text")
    marks = f"key struct<key:{kind},a:long,b:long>, digest binary, size long, regs binary" + ", fp long" * fingerprints
    marked = land(keyed.mapInArrow(_sketched(fingerprints), marks), f"{folder}/marked")
    prints = marked.filter("size > 0").groupBy("digest").agg(F.min("key").alias("least"), F.first("regs").alias("regs"))
    prints = land(prints.withColumn("num", F.monotonically_increasing_id()), f"{folder}/prints")

    # Texts that share a band, and the leader of the band.
    banded = prints.select("num", "regs").mapInArrow(_banded, "band long, b byte, num long")
    shared = banded.repartition("band").sortWithinPartitions("band", "num").mapInArrow(_shared, "band long, b byte, num long, leader long")
    shared = land(shared, f"{folder}/shared")
    # A text follows the leader of most of its bands.
    votes = shared.filter("num <> leader").groupBy("num", "leader").agg(F.count("*").alias("n"))
    stars = votes.groupBy("num").agg(F.max(F.struct("n", (-F.col("leader")).alias("leader")))["leader"].alias("leader")).select("num", (-F.col("leader")).alias("leader"))
    stars, able = land(stars, f"{folder}/stars"), shared.select("num")
    groups = shared.select("band", "b", "num")
    if fingerprints:
        near, met = _fingerprint_links(marked, prints, folder)
        groups = groups.unionByName(met)
        stars = stars.unionByName(near).distinct()
        able = able.unionByName(near.select("num")).unionByName(near.select("leader").toDF("num"))

    # Full sets of all texts with a candidate. The texts meet the list of those by a shuffle at any size of the list.
    wanted = able.distinct().join(prints.select("num", F.col("least.a").alias("w_a"), F.col("least.b").alias("w_b")), "num")
    wanted = land(wanted, f"{folder}/wanted").hint("merge")
    texts = rows.select("a", "b", "text").join(wanted, (F.col("a") == F.col("w_a")) & (F.col("b") == F.col("w_b")))
    held = land(texts.select("num", "text").mapInArrow(_sets, "num long, size long, regs binary, shingles binary"), f"{folder}/sets")
    sets, sketches = held.select("num", "shingles"), held.select("num", "size", "regs")

    pairs = stars.join(sketches, "num").join(sketches.toDF("leader", "l_size", "l_regs"), "leader")
    stars = land(pairs.mapInArrow(_likely_pairs(similarity), "num long, leader long"), f"{folder}/likely")
    # Followers meet their leader, each leader once per chunk of followers.
    fans = stars.groupBy("leader").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    dealt = land(stars.join(fans, "leader").select("num", "leader", F.pmod(F.xxhash64("num"), F.col("chunks")).alias("part")), f"{folder}/dealt")
    heads = dealt.select("leader", "part").distinct().withColumn("num", F.col("leader"))
    meet = dealt.select("leader", "part", "num", F.lit(False).alias("head")).unionByName(heads.withColumn("head", F.lit(True))).join(sets, "num")
    meet = meet.repartition("leader", "part").sortWithinPartitions("leader", "part", F.desc("head")).select("leader", "num", "shingles")
    links = land(meet.mapInArrow(_followers(similarity), "src long, dst long"), f"{folder}/links")
    joined = land(_connected(prints.select("num"), links, "comp"), f"{folder}/components")

    # Bands, and anchors, that still hold more than one component.
    seen = land(groups.join(joined, "num"), f"{folder}/seen")
    base = seen.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct("num", "comp"))["comp"].alias("base"))
    held = seen.join(base.filter("low <> high").select("band", "base"), "band").select("band", "b", "num", "comp", (F.col("comp") != F.col("base")).alias("outside"))
    held = land(held.join(sketches, "num"), f"{folder}/open")
    outside = lambda c: F.when(F.col("outside"), F.col(c))
    parts = held.groupBy("band").agg(_chunks(F.count("*"), F.sum("size"), chunk).alias("all_parts"), _chunks(F.count(outside("num")), F.sum(outside("size")), chunk).alias("out_parts"))
    held = held.join(parts, "band")
    own_out, own_all = (F.pmod(F.xxhash64("num"), F.col(c)).cast("int") for c in ("out_parts", "all_parts"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ["b", "num", "comp", "size", "outside", "regs"]
    away = held.select("band", own_all.alias("j"), every("out_parts").alias("i"), *columns, F.lit(False).alias("home"), F.lit(True).alias("away"))
    homes = held.filter("outside").select("band", every("all_parts").alias("j"), own_out.alias("i"), *columns, F.lit(True).alias("home"), F.lit(False).alias("away"))
    group = F.xxhash64("band", "i", "j").alias("group")
    met = away.unionByName(homes).select(group, "b", "num", "comp", "size", "outside", "home", "away", "regs").repartition("group").sortWithinPartitions("group")
    rest = "group long, b byte, num long, comp long, size long, outside boolean, home boolean, away boolean"
    asked = land(met.mapInArrow(_asked(similarity), rest), f"{folder}/asked")
    meet = asked.join(sets, "num").select(*asked.columns, "shingles").repartition("group").sortWithinPartitions("group")
    more = land(meet.mapInArrow(_joined(similarity), "src long, dst long").distinct(), f"{folder}/more")

    comps = joined.select(F.col("comp").alias("num")).distinct()
    sets_of = _connected(comps, more, "set").select(F.col("num").alias("comp"), "set")
    named = prints.select("num", "digest", "least").join(joined, "num").join(sets_of, "comp")
    named = land(named.select("digest", "set", F.col("least.key").alias("key")), f"{folder}/sets_of")
    least = named.groupBy("set").agg(F.min("key").alias("least"))
    return Classes(marked.select("key", "digest", "size"), land(named.join(least, "set").select(F.col("digest").alias("n_digest"), "least"), f"{folder}/named"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of ``docs``.

    ``component_id`` is the least doc_id that links reach, its own included; ``kept`` says that it is the row's own. Texts
    without words (null or empty) are linked with nothing and kept. Rows without an id take part; they get the
    least id of their class, null if it has none, and are kept only in that case. Rows that share an id are documents of their
    own and get equal verdicts only by their classes. An empty table gives an empty result. Other columns are not read.
    """
    first, second = row_keys(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    key = F.struct(F.col(f"`{doc_id}`").isNull().alias("none"), F.col(f"`{doc_id}`").alias("doc"))
    found = near_classes(docs.select(key.alias("key"), first.alias("a"), second.alias("b"), F.col(f"`{text}`").alias("text")), similarity, chunk)
    rows = found.marked.select(F.col("key.key.doc").alias("doc_id"), F.col("size").alias("n_shingles"), "digest")
    rows = rows.join(found.named, F.col("digest") == F.col("n_digest"), "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least.doc"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
