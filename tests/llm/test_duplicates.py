"""SimHash classes and repeated windows against plain loops."""

import hashlib
import random

import numpy as np
import xxhash

from inquest.llm.simhash import fingerprint, links, near_duplicates
from inquest.llm.substring import remove_repeats
from inquest.operators.components import _large_star, _small_star
from tests.llm.cases import empty, frame, prose, rows, split_words


def plain_fingerprint(text):
    words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def sets_of(values, near):
    """Least index reachable for each value."""
    group = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def test_fingerprint():
    for x in rows():
        assert fingerprint(x[1]) == plain_fingerprint(x[1])


def test_classes(spark):
    data = rows()
    got = near_duplicates(frame(spark, data)).collect()
    prints = [plain_fingerprint(x[1]) for x in data]
    group = sets_of(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {g: min((x[0] for x, h in zip(data, group) if h == g and x[0] is not None), default=None) for g in set(group)}
    want = sorted((str(x[0]), p, str(least[g])) for x, p, g in zip(data, prints, group))
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in got) == want
    assert near_duplicates(empty(spark)).count() == 0


def test_links_find_every_pair_within_three_bits(spark):
    r = random.Random(5)
    values = set()
    for _ in range(40):
        base = r.getrandbits(64)
        values.add(base)
        for n in (1, 2, 3, 3, 3, 4, 5, 8):
            x = base
            for b in r.sample(range(64), n):
                x ^= 1 << b
            values.add(x)
    base = r.getrandbits(64)
    values |= {base ^ (1 << i) for i in range(64)}
    values = sorted(values)
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    want = sets_of(values, lambda a, b: (a ^ b).bit_count() <= 3)
    for chunk in (4096, 3):
        found = [(x.src % (1 << 64), x.dst % (1 << 64)) for x in links(df, chunk).collect()]
        pairs = {frozenset(p) for p in found}
        at = {v: i for i, v in enumerate(values)}
        group = list(range(len(values)))
        for a, b in found:
            low, high = sorted((group[at[a]], group[at[b]]))
            group = [low if g == high else g for g in group]
        assert len(set(group)) == len(set(want))
        assert {tuple(sorted(i for i, g in enumerate(group) if g == k)) for k in set(group)} == {tuple(sorted(i for i, g in enumerate(want) if g == k)) for k in set(want)}
        assert len(pairs) < len(values) * 8


def plain_removed(data, window=20):
    """(n_words, kept words) for each row: rows in the order of id (null last) and text hash."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.getActiveSession()
    texts = spark.createDataFrame([(i, x[1] or "") for i, x in enumerate(data)], "i int, t string")
    hashes = {r.i: r.h for r in texts.select("i", F.xxhash64("t").alias("h")).collect()}
    order = sorted(range(len(data)), key=lambda i: (data[i][0] is None, data[i][0] or 0, hashes[i]))
    seen, out, done = {}, {}, {}
    for i in order:
        key = (data[i][0], data[i][1] or "")
        if key in done:
            out[i] = done[key]
            continue
        w, gone = split_words(data[i][1]), set()
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            if g in seen:
                gone.update(range(p, p + window))
            seen.setdefault(g, i)
        done[key] = out[i] = (len(w), [x for k, x in enumerate(w) if k not in gone])
    return [out[i] for i in range(len(data))]


def test_repeated_windows(spark):
    r = random.Random(8)
    data = rows()
    loop = prose(r, 25)
    data += [(100, loop + " " + loop + " " + loop, *data[0][2:]), (101, prose(r, 19), *data[0][2:]), (102, loop[5:], *data[0][2:]), (103, prose(r, 20), *data[0][2:])]
    got = remove_repeats(frame(spark, data)).collect()
    want = sorted((str(x[0]), n, n - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest(), " ".join(k)) for x, (n, k) in zip(data, plain_removed(data)))
    assert sorted((str(x.doc_id), x.n_words, x.n_removed, x.kept_sha256, bytes(x.kept).decode()) for x in got) == want
    assert sum(x.n_removed > 0 for x in got) > 10
    assert remove_repeats(empty(spark)).count() == 0


def test_other_window_lengths(spark):
    data = rows(seed=9)
    for window in (6, 50):
        got = remove_repeats(frame(spark, data), window).collect()
        want = sorted((str(x[0]), n - len(k)) for x, (n, k) in zip(data, plain_removed(data, window)))
        assert sorted((str(x.doc_id), x.n_removed) for x in got) == want


def test_no_join_of_the_classes_is_a_broadcast(spark):
    """The driver would hold one side, which grows with the input, in every join and in every round of the components."""
    found = near_duplicates(frame(spark, rows()))
    edges = spark.createDataFrame([(2, 1), (3, 2), (5, 4)], "a long, b long")
    for df in (found, _large_star(edges), _small_star(edges)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
