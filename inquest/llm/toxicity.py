"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words of a text, the beginnings of longer words (so that a compound or inflected form counts with its
stem), pairs of neighbours and pairs with one word between, hashed to ``2^BITS`` places; a feature is there or not,
however often it comes. Learning keeps a rate per coordinate, and its L1 term leaves
most weights at zero, so the model is a short list of places and weights. Its size is bounded by ``2^BITS``, which
bounds what is sent to the tasks that score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.llm.common import land, scratch

BITS = 20
#: Labelled rows that are learned from at most: those whose ids have the least hashes.
TRAIN_ROWS = 20_000
FOLDS = 5
STEMS = (5, 7)

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: ASCII letters in lower case, digits as they are, all other ASCII characters spaces; bytes of other characters stay.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    epochs: int = 6


@dataclass(frozen=True)
class Model:
    bias: float
    places: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.places] = self.weights
        return out


def _join(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    x = (a * _ODD + np.uint64(kind)) ^ (b + (a << np.uint64(13)))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def features(text: str | None) -> np.ndarray:
    """Places of all words, stems, n-grams and skip-grams of the whole text, repeats included."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()
    a = _hashes(words)
    stems = [_hashes([b"%d~%b" % (n, w[:n]) for w in words if len(w) > n]) for n in STEMS]
    grams = np.concatenate([a, *stems, _join(a[:-1], a[1:], 2), _join(a[:-2], a[2:], 3)])
    return (grams >> np.uint64(64 - BITS)).astype(np.int32)


def fit_ftrl(rows: list[tuple[np.ndarray, int]], how: Ftrl = Ftrl()) -> Model:
    """Learn from (distinct places, label) rows in the order given."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    positive = sum(y for _, y in rows)
    bias = float(np.log((positive + 0.5) / (len(rows) - positive + 0.5)))
    bias_n = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * how.l1) / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2)
        return np.where(np.abs(zs) <= how.l1, 0.0, w)

    for _ in range(how.epochs):
        for at, y in rows:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = p - y
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / how.alpha
            z[at] += g - step * w
            n[at] += g * g
            bias_n += g * g
            bias -= how.alpha * g / (how.beta + np.sqrt(bias_n))
    every = np.arange(1 << BITS)
    w = weights(every)
    kept = np.flatnonzero(w)
    return Model(bias, kept.astype(np.int32), w[kept])


def is_held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """One id in ``folds`` by the checksum of its text form; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.unique(features(x)) for x in batch.column(3).to_pylist()]
        cuts = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
        flat = pa.array(np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(cuts), flat)], ["h", "doc_id", "y", "places"])


def _learn(how: Ftrl):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(x.values.to_numpy(), int(y)) for b in batches for x, y in zip(b.column(3), b.column(2).to_pylist())]
        model = fit_ftrl(rows, how)
        places, weights = np.r_[-1, model.places].astype(np.int32), np.r_[model.bias, model.weights]
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(weights)], ["place", "weight"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS, how: Ftrl = Ftrl()) -> Model:
    """A model from labelled rows that are not held out, at most ``rows`` of them.

    Labels other than 0 and 1 and labels without a document are left out; of contradicting labels of one id 1 holds.
    Without any label the model is a constant 0.5. The bound keeps what one task learns from small: about 5 kB a row.
    """
    folder = scratch(docs.sparkSession, "toxicity")
    known = labels.select(F.col(doc_id).alias("l_id"), F.col(label).alias("y")).filter("l_id IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("l_id").agg(F.max("y").alias("y")).filter(~is_held_out(F.col("l_id")))
    chosen = land(known.withColumn("h", F.xxhash64("l_id")).orderBy("h", "l_id").limit(rows), f"{folder}/chosen")
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # ``chosen`` has ``rows`` rows at most.
    texts = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("h", F.col("doc_id").cast("string").alias("doc_id"), F.col("y").cast("int").alias("y"), "text")
    vectors = land(texts.mapInArrow(_vectors, "h long, doc_id string, y int, places array<int>"), f"{folder}/vectors")
    ordered = vectors.repartition(1).sortWithinPartitions("h", "doc_id", F.xxhash64("places"))
    model = ordered.mapInArrow(_learn(how), "place int, weight double").collect()
    bias = next((r.weight for r in model if r.place < 0), 0.0)
    learned = [r for r in model if r.place >= 0]
    return Model(bias, np.array([r.place for r in learned], np.int64), np.array([r.weight for r in learned]))


def score(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """All columns of ``docs`` and ``score`` (0 to 1) and ``predicted`` (1 if the score is 0.5 or more), named with ``prefix``.

    Null and empty texts have no features and get the score of the bias. Repeated rows get equal scores; an empty table
    gives an empty result. Names that clash raise ValueError.
    """
    clash = {prefix + "score", prefix + "predicted"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist; choose another prefix")
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.places, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, places, weights = shared.value
        dense = Model(bias, places, weights).dense()
        for batch in batches:
            total = np.empty(batch.num_rows)
            for i, x in enumerate(batch.column(batch.num_columns - 1)):
                at = features(x.as_py())
                at = np.unique(at[dense[at] != 0])
                total[i] = bias + dense[at].sum(dtype=np.float64)
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*names, prefix + "score", prefix + "predicted"])

    names = docs.columns
    held = "".join(names) + "_text"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    rows = docs.withColumn(held, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return rows.mapInArrow(run, f"{kinds}, `{prefix}score` double, `{prefix}predicted` int")
