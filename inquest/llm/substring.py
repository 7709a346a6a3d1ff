"""Substring dedup by level-wise doubling: windows that repeat at one length alone are extended to twice that length.

The wanted window is the last level, half of it the first. At the first level a document gives only the windows that
are the least (by hash) of some wanted window's, about one in six; equal wanted windows choose the same one, so where
it does not repeat, no wanted window around it does, and nothing there is a candidate. At the second level only wanted
windows around a survivor are hashed and compared. Longer repeats need no further level: all words of a longer repeat
are covered by repeats of the wanted length, so no candidate for more coverage is left.

Each comparison is one shuffle by hash. What a task can settle among its own rows is settled before: of rows with one
hash it sends on a single row, so a passage that a third of all documents share arrives once per chunk of documents.
Hashes of the first level have 64 bits (a collision only makes a candidate), those of the last level 96.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquest.llm.common import land, scratch
from inquest.session import remove_folder

WINDOW = 20
#: Words whose hashes a task holds at a time (one document is never cut).
CHUNK_WORDS = 1 << 19
LAST = (1 << 63) - 1

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xD6E8FEB86659FD93)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _ODD) ^ (b + (a << np.uint64(17)) + (a >> np.uint64(7)))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _mix2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = ((a ^ (a >> np.uint64(31))) * _ODD2) + (b ^ (b << np.uint64(23)))
    return x ^ (x >> np.uint64(27))


def _spans(a: np.ndarray, n: int, join=_mix) -> np.ndarray:
    """Hashes of all windows of n elements, each from those of half the length."""
    if n == 1:
        return a
    half = n // 2
    part = _spans(a, half, join)
    out = join(part[:-half], part[half:])
    return join(out[:-1], a[n - 1 :]) if n % 2 else out


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _chunks(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, position, word hash) of all words of some rows after another, of about ``CHUNK_WORDS`` words at most."""
    rows, lengths, hashes, total = [], [], [], 0
    for row, text in enumerate(texts):
        words = _words(text)
        if words:
            rows.append(row)
            lengths.append(len(words))
            hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
            total += len(words)
        if total >= CHUNK_WORDS:
            yield _flat(rows, lengths, hashes)
            rows, lengths, hashes, total = [], [], [], 0
    if rows:
        yield _flat(rows, lengths, hashes)


def _flat(rows, lengths, hashes):
    n = np.array(lengths)
    start = np.cumsum(n) - n
    return np.repeat(np.array(rows), n), np.arange(n.sum()) - np.repeat(start, n), np.concatenate(hashes)


def _seeds(row: np.ndarray, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the first level; where wanted windows begin; where the least half-length window of each begins."""
    half = window // 2
    if len(hashes) < window:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    level = _spans(hashes, half)
    begin = np.flatnonzero(row[: len(row) - window + 1] == row[window - 1 :])
    least = np.lib.stride_tricks.sliding_window_view(level, window - half + 1).argmin(axis=1)
    return level, begin, least[begin] + begin


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in columns], names)


SEED_ROWS = "grp long, kind byte, o long, x long, pos int"
WINDOW_ROWS = "grp long, chk int, kind byte, o long, x long, pos int"
PLACES = "o long, x long, pos int"


def _seed_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o, x = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for row, pos, hashes in _chunks(batch.column(2).to_pylist()):
                level, _, least = _seeds(row, hashes, window)
                at = np.unique(least)
                _, which, count = np.unique(level[at], return_inverse=True, return_counts=True)
                # kind 1: repeats here, goes on as it is, dealt by its place; kind 2: one witness of it for other tasks.
                twice = count[which] > 1
                witness = np.unique(level[at[twice]])
                own, single = at[twice], at[~twice]
                spread = _mix(level[own], (pos[own].astype(np.uint64) << np.uint64(20)) ^ x[row[own]].view(np.uint64))
                grp = np.concatenate([level[single], spread, witness])
                kind = np.concatenate([np.zeros(len(single), np.int8), np.ones(len(own), np.int8), np.full(len(witness), 2, np.int8)])
                from_ = np.concatenate([single, own])
                pad = np.zeros(len(witness), np.int64)
                yield _batch(
                    ["grp", "kind", "o", "x", "pos"], grp, kind, np.concatenate([o[row[from_]], pad]),
                    np.concatenate([x[row[from_]], pad]), np.concatenate([pos[from_], pad]).astype(np.int32),
                )

    return run


def _settled_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, those whose hash is not alone. At most one row per chunk has a given hash."""
    held = None

    def out(grp, kind, o, x, pos):
        first = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]])
        size = np.diff(np.r_[first, len(grp)])
        seen = np.maximum.reduceat(kind, first) == 2
        stays = (kind == 1) | ((kind == 0) & np.repeat((size > 1) | seen, size))
        return _batch(["o", "x", "pos"], o[stays], x[stays], pos[stays])

    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            now = [np.concatenate(p) for p in zip(held, now)]
        cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        if cut:
            yield out(*(c[:cut] for c in now))
        held = [c[cut:] for c in now]
    if held is not None and len(held[0]):
        yield out(*held)


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o, x = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            places = batch.column(3).to_pylist()
            for row, pos, hashes in _chunks(batch.column(2).to_pylist()):
                _, begin, least = _seeds(row, hashes, window)
                if not len(begin):
                    continue
                alive = np.zeros(len(row), bool)
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                for at in first:
                    alive[at + np.array(places[row[at]], np.int64)] = True
                at = begin[alive[least]]
                if not len(at):
                    continue
                grp, chk = _spans(hashes, window)[at], (_spans(hashes, window, _mix2)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                oo, xx, pp = o[row[at]], x[row[at]], pos[at].astype(np.int32)
                order = np.lexsort((pp, xx, oo, chk, grp))
                grp, chk, oo, xx, pp, = (c[order] for c in (grp, chk, oo, xx, pp))
                # kind 1: an earlier equal window is in this chunk, so the row is settled and goes on as it is.
                later = _beyond_first(np.flatnonzero(np.r_[True, (grp[1:] != grp[:-1]) | (chk[1:] != chk[:-1])]), oo, xx, pp)
                key = np.where(later, _mix(grp, (pp.astype(np.uint64) << np.uint64(20)) ^ xx.view(np.uint64)), grp)
                yield _batch(["grp", "chk", "kind", "o", "x", "pos"], key, chk, later.astype(np.int8), oo, xx, pp)

    return run


def _beyond_first(begins: np.ndarray, o: np.ndarray, x: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which rows of the runs are at another place than their run's first row; a repeated row of the table is not."""
    head = np.repeat(begins, np.diff(np.r_[begins, len(o)]))
    return (o != o[head]) | (x != x[head]) | (pos != pos[head])


def _later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by kind, hash and place, all of kind 1 and of kind 0 those that are not the first of their hash."""
    first = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(rows[0]):
            continue
        if first is not None:
            # The first row of the run that the last batch ended in goes before, and out again.
            rows = [np.concatenate([f, c]) for f, c in zip(first, rows)]
        grp, chk, kind, o, x, pos = rows
        begins = np.flatnonzero(np.r_[True, (grp[1:] != grp[:-1]) | (chk[1:] != chk[:-1]) | (kind[1:] != kind[:-1])])
        stays = (kind == 1) | _beyond_first(begins, o, x, pos)
        if first is not None:
            stays[0] = False
        first = [c[begins[-1] : begins[-1] + 1] for c in rows]
        yield _batch(["o", "x", "pos"], o[stays], x[stays], pos[stays])


def _apply(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, copies, places = (batch.column(i) for i in range(4))
            n, removed, digests, kept_texts = [], [], [], []
            for text, copy, begins in zip(texts.to_pylist(), copies.to_pylist(), places.to_pylist()):
                words = _words(text)
                if copy and len(words) >= window:
                    kept = []
                elif begins and not copy:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(np.array(begins, np.int64))
                    edge[at] += 1
                    edge[at + window] -= 1
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                else:
                    kept = words
                n.append(len(words))
                removed.append(len(words) - len(kept))
                joined = b" ".join(kept)
                digests.append(hashlib.sha256(joined).hexdigest())
                kept_texts.append(joined)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.binary())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return run


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A row's key: o orders the documents (null ids last), x tells texts apart that share an id; y makes x 128 bits wide."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{doc_id}`"), F.lit(LAST)).cast("long").alias("o"),
        F.xxhash64(body).alias("x"), F.xxhash64(F.lit(1), body).alias("y"), body.alias("text"),
    )


def _shortened(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows with x = 0 where their id has one text only: the id alone names the document in everything that is shuffled."""
    return rows.join(shared, F.col("o") == F.col("shared_o"), "left").withColumn("x", F.when(F.col("shared_o").isNotNull(), F.col("x")).otherwise(F.lit(0)).cast("long")).drop("shared_o")


def _positions(places: DataFrame) -> DataFrame:
    """Places of a document as one list, no longer than the document."""
    return places.groupBy("o", "x").agg(F.collect_list("pos").alias("places")).withColumnsRenamed({"o": "p_o", "x": "p_x"})


def repeated_windows(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, firsts, places): the rows with their keys o and x; the document of each distinct text that comes first; where
    windows begin that begin earlier too. Later copies of a whole text have no places: all of their windows repeat.
    """
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "substring")
    keyed = _keyed(docs, doc_id, text)
    keys = land(keyed.select("o", "x", "y").distinct(), f"{folder}/keys")
    shared = land(keys.groupBy("o").agg(F.count("*").alias("texts")).filter("texts > 1").select(F.col("o").alias("shared_o")), f"{folder}/shared")
    firsts = _shortened(keys.groupBy("x", "y").agg(F.min("o").alias("o")), shared).select(F.col("o").alias("f_o"), F.col("x").alias("f_x")).distinct()
    firsts = land(firsts, f"{folder}/firsts")
    keyed = _shortened(keyed, shared).select("doc_id", "o", "x", "text")

    # Level 1 over all documents.
    seeds = keyed.select("o", "x", "text").mapInArrow(_seed_rows(window), SEED_ROWS)
    seeds = seeds.repartition("grp").sortWithinPartitions("grp").mapInArrow(_settled_seeds, PLACES)
    alive = _positions(land(seeds, f"{folder}/seeds"))
    # Level 2 around survivors, in the first document of each text.
    texts = keyed.select("o", "x", "text").join(firsts, (F.col("o") == F.col("f_o")) & (F.col("x") == F.col("f_x")), "left_semi")
    texts = texts.join(alive, (F.col("o") == F.col("p_o")) & (F.col("x") == F.col("p_x"))).select("o", "x", "text", "places")
    windows = texts.mapInArrow(_window_rows(window), WINDOW_ROWS)
    windows = windows.repartition("grp").sortWithinPartitions("kind", "grp", "chk", "o", "x", "pos")
    places = land(windows.mapInArrow(_later_windows, PLACES), f"{folder}/windows")
    for step in ("keys", "seeds"):
        remove_folder(spark, f"{folder}/{step}")
    return keyed, firsts, places


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row: what is left when each word in a repeated window goes.

    A window of ``window`` words (an even number) repeats if the same words also begin earlier: in a document with a
    smaller id (whole numbers; nulls come last, texts that share an id in the order of their hash) or earlier in the
    same one. Null and empty texts have no words. Rows that are equal in id and text get the same result each. Texts
    shorter than the window stay whole. Empty tables give empty results. ``kept`` is the rest, UTF-8, words joined by one space.
    """
    keyed, firsts, places = repeated_windows(docs, window, doc_id, text)
    rows = keyed.join(firsts, (F.col("o") == F.col("f_o")) & (F.col("x") == F.col("f_x")), "left")
    rows = rows.join(_positions(places), (F.col("o") == F.col("p_o")) & (F.col("x") == F.col("p_x")), "left")
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = rows.select("doc_id", "text", F.col("f_o").isNull().alias("copy"), "places")
    return rows.mapInArrow(_apply(window), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept binary")
