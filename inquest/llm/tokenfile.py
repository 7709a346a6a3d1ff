"""Token ids on disk: frequency-ranked, byte-aligned variable length, control bytes apart from data bytes.

Format. A dataset is a folder with two Parquet parts. ``ranks`` (id, rank): ids by falling count over the whole corpus,
the smaller id first among equals. ``blocks``: one row per document with ``part``, ``start`` (ids of the part before
it), ``doc_id``, ``n``, ``control`` and ``data``. The ids of a document, as ranks, take 1 to 4 bytes each, little-endian,
in ``data``; ``control`` has two bits per id, its bytes less 1, four ids in a byte, the first in the lowest bits, each
document beginning a new byte. Parts are ranges of ascending doc_id (nulls last). The decoder looks the four lengths of
a control byte up in a table and gathers the bytes of all ids at once.

The rank table has as many rows as the tokenizer has ids, which bounds what is sent to the driver and to the tasks.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inquest.llm.common import scratch

#: Ids that are coded or decoded at a time.
CHUNK_IDS = 1 << 20
#: Pieces of text that a task remembers; beyond that it forgets those it has not met again since it last forgot some.
MEMORY = 1_000_000
#: Bytes of text that are encoded at a time (one text at least).
CHUNK_BYTES = 1 << 24
#: Between a character that is no white space and a space before another: no token of a byte-level BPE with word
#: splitting goes over such a place, so the pieces between can be encoded one by one and remembered.
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Texts that have more between words than single spaces, or line feeds without a space beside them.
_ODD = (
    r"\A |  | \n|\n | \z|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) % 4 + 1


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] to starts[i] + lengths[i] - 1, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class PieceMemory:
    """Ids of distinct pieces: ``ids`` holds them all, ``starts`` and ``lengths`` where those of a piece are."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype: np.dtype):
        self.learn, self.pieces = learn, pa.array([], pa.string())
        self.ids, self.starts, self.lengths, self.met = np.zeros(0, dtype), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _forget(self) -> None:
        which = np.flatnonzero(self.met)
        which = which[: 0 if len(which) > MEMORY // 2 else None]
        self.pieces, self.ids, self.lengths = self.pieces.take(pa.array(which)), self.ids[_gather(self.starts[which], self.lengths[which])], self.lengths[which]
        self.starts, self.met = np.cumsum(self.lengths) - self.lengths, np.zeros(len(which), bool)

    def _places(self, distinct: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(distinct, value_set=self.pieces), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def find(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece begin in ``ids``, and how many they are."""
        coded = pieces.dictionary_encode()
        place = self._places(coded.dictionary)
        self.met[place[place >= 0]] = True
        if len(self.pieces) + int((place < 0).sum()) > MEMORY:
            self._forget()
            place = self._places(coded.dictionary)
        new = np.flatnonzero(place < 0)
        if len(new):
            lacking = coded.dictionary.take(pa.array(new))
            ids, lengths = self.learn(lacking.to_pylist())
            place[new] = len(self.pieces) + np.arange(len(new))
            self.pieces = pa.concat_arrays([self.pieces, lacking])
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths, self.ids = np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, ids])
            self.met = np.concatenate([self.met, np.zeros(len(new), bool)])
        of = place[coded.indices.to_numpy()]
        return self.starts[of], self.lengths[of]


class PieceEncoder:
    """Encodes whole texts with a tokenizer file, each distinct piece of text once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.begins = np.zeros(self.size, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        #: Texts with one of these go through the tokenizer whole: added tokens are cut out before words are split.
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        #: Pieces that come after a space, without it; pieces as they are.
        self.spaced, self.plain = PieceMemory(self._after_space, self.dtype), PieceMemory(self._alone, self.dtype)

    def _alone(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has."""
        ids = [coded.ids for coded in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([i for one in ids for i in one], self.dtype), np.fromiter(map(len, ids), np.int64, len(ids))

    def _after_space(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Each has one token that begins with a space, its first: many can be encoded as one text and told apart again.
        out, sizes = [], []
        runs = [pieces[i : i + 1000] for i in range(0, len(pieces), 1000)]
        for run, coded in zip(runs, self.tokenizer.encode_batch_fast([" " + " ".join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(coded.ids, self.dtype)
            first = np.flatnonzero(self.begins[ids])
            lengths = np.diff(np.append(first, len(ids)))
            if len(first) != len(run):
                ids, lengths = self._alone([" " + p for p in run])
            out.append(ids)
            sizes.append(lengths)
        return np.concatenate(out), np.concatenate(sizes)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, each followed by ``end``, and how many each has."""
        # 0: cut at each space; 1: with other spacing; 2: with an added token.
        kind = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False).astype(np.int8)
        for token in self.added:
            kind[pc.match_substring(texts, token).to_numpy(zero_copy_only=False)] = 2
        rows = [np.flatnonzero(kind == k) for k in range(3)]
        some = [texts.take(pa.array(r)) for r in rows]

        split = pc.split_pattern(some[0], " ")
        cuts = split.offsets.to_numpy().astype(np.int64)
        flat = split.values.slice(cuts[0], cuts[-1] - cuts[0])
        odd = [_CUT.split(t) for t in some[1].to_pylist()]
        whole, sizes = self._alone(some[2].to_pylist())
        starts, lengths = self.spaced.find(flat)
        first = cuts[:-1] - cuts[0]
        # First pieces have no space in front of them.
        others = self.plain.find(pa.concat_arrays([flat.take(pa.array(first)), pa.array([p for o in odd for p in o], pa.string())]))
        begin = np.cumsum([0, len(self.spaced.ids), len(self.plain.ids)])
        starts[first], lengths[first] = others[0][: len(first)] + begin[1], others[1][: len(first)]
        pool = np.concatenate([self.spaced.ids, self.plain.ids, whole, np.array([] if end is None else [end], self.dtype)])
        starts = np.concatenate([starts, others[0][len(first) :] + begin[1], begin[2] + np.cumsum(sizes) - sizes, [len(pool) - 1]])
        lengths = np.concatenate([lengths, others[1][len(first) :], sizes, [1]])
        # Pieces of the texts in the order of the table, each text with the end as its last piece.
        counts = np.zeros(len(texts), np.int64)
        counts[rows[0]], counts[rows[1]], counts[rows[2]] = np.diff(cuts), [len(o) for o in odd], 1
        order = np.concatenate(rows)
        from_ = np.zeros(len(texts), np.int64)
        from_[order] = np.cumsum(counts[order]) - counts[order]
        piece = _gather(from_, counts)
        if end is not None:
            piece = np.insert(piece, np.cumsum(counts), len(starts) - 1)
            counts = counts + 1
        starts, lengths = starts[piece], lengths[piece]
        ends = np.r_[0, np.cumsum(lengths)]
        return pool[_gather(starts, lengths)], np.diff(ends[np.r_[0, np.cumsum(counts)]])


def _text_chunks(texts: pa.Array) -> Iterator[slice]:
    return _groups(pc.binary_length(texts).to_numpy(zero_copy_only=False), CHUNK_BYTES)


_encoders: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _binary(cuts: np.ndarray, raw: np.ndarray) -> pa.Array:
    """Byte strings raw[cuts[i]:cuts[i + 1]]."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def _tokenized(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = _encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for rows in _text_chunks(texts):
                ids, n = encoder.encode(texts[rows.start : rows.stop], end)
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                cuts = np.r_[0, np.cumsum(n)] * encoder.dtype.itemsize
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(starts), batch.column(0)[rows.start : rows.stop], pa.array(n), _binary(cuts, ids.view(np.uint8))],
                    ["part", "start", "doc_id", "n", "ids"],
                )

    return run


def _counted(size: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += np.bincount(np.frombuffer(blob.as_buffer(), dtype), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    return run


def _groups(n: np.ndarray, most: int = CHUNK_IDS) -> Iterator[slice]:
    """Rows of sizes ``n`` that have ``most`` at most together, one row at least."""
    at, ends = 0, np.cumsum(n, dtype=np.int64)
    while at < len(n):
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, until)
        at = until


def pack(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control and data bytes of rows of n values each, and where each row's begin and end in them."""
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = -(-n // 4) * 4
    row_start = np.cumsum(padded) - padded
    place = np.arange(len(values)) + np.repeat(row_start - (np.cumsum(n) - n), n)
    codes = np.zeros(int(padded.sum()), np.uint8)
    codes[place] = code
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = values.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    sizes = np.r_[0, np.cumsum(code.astype(np.int64) + 1)]
    return control, np.r_[0, np.cumsum(padded // 4)], data, sizes[np.r_[0, np.cumsum(n)]]


def unpack(control: np.ndarray, data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The values of rows of n values each from their control and data bytes, one row after the other."""
    padded = -(-n // 4) * 4
    place = np.arange(int(n.sum())) + np.repeat((np.cumsum(padded) - padded) - (np.cumsum(n) - n), n)
    size = _LENGTHS[control].reshape(-1)[place]
    at = np.cumsum(size) - size
    raw = np.concatenate([data, np.zeros(4, np.uint8)])
    value = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = size > k
        if longer.any():
            value[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return value


def _packed(rank: np.ndarray, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            blobs = batch.column("ids")
            for rows in _groups(n):
                ids = np.frombuffer(b"".join(blobs[rows.start : rows.stop].to_pylist()), dtype)
                control, control_cuts, data, data_cuts = pack(rank[ids], n[rows])
                head = [batch.column(c)[rows.start : rows.stop] for c in ("part", "start", "doc_id", "n")]
                yield pa.RecordBatch.from_arrays([*head, _binary(control_cuts, control), _binary(data_cuts, data)], ["part", "start", "doc_id", "n", "control", "data"])

    return run


def _decoded(ids_of: np.ndarray, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            for rows in _groups(n):
                control, data = (np.frombuffer(b"".join(batch.column(c)[rows.start : rows.stop].to_pylist()), np.uint8) for c in ("control", "data"))
                raw = ids_of[unpack(control, data, n[rows])].tobytes()
                cuts = np.r_[0, np.cumsum(n[rows])] * 4
                if digest:
                    view = memoryview(raw)
                    last = pa.array([zlib.crc32(view[a:b]) for a, b in zip(cuts, cuts[1:])], pa.int64())
                else:
                    last = _binary(cuts, np.frombuffer(raw, np.uint8))
                head = [batch.column(c)[rows.start : rows.stop] for c in ("part", "start", "doc_id", "n")]
                yield pa.RecordBatch.from_arrays([*head, last], ["part", "start", "doc_id", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts, append ``end`` to each, and write the folder ``path`` in the format above.

    Null texts are empty ones and have the end id alone. Equal rows are documents of their own; rows that share an id
    come in the order of a hash of their text. Rows without an id come last. An empty table gives empty parts.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # Tokenizing is the costly part, so its ids are kept until the counts of the whole corpus are known.
    ids = rows.mapInArrow(_tokenized(tokenizer, end), f"part int, start long, doc_id {kind}, n long, ids binary")
    ids.write.option("compression", "zstd").parquet(f"{folder}/ids")
    ids = spark.read.parquet(f"{folder}/ids")
    encoder = _encoder(tokenizer)
    size, dtype = encoder.size, encoder.dtype.str
    counts = ids.select("ids").mapInArrow(_counted(size, dtype), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counted = np.zeros(size, np.int64)
    for i, n in counts.collect():
        counted[i] = n
    falling = np.argsort(-counted, kind="stable")
    rank = np.empty(size, np.uint32)
    rank[falling] = np.arange(size, dtype=np.uint32)
    spark.createDataFrame(list(enumerate(rank.tolist())), "id int, rank int").coalesce(1).write.parquet(f"{path}/ranks")
    packed = ids.mapInArrow(_packed(rank, dtype), f"part int, start long, doc_id {kind}, n long, control binary, data binary")
    packed.write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from a folder of the format: start counts the ids of all documents before, ids are
    little-endian unsigned 32-bit integers. With ``digest`` their unsigned CRC-32, ``ids_crc32``, stands for them."""
    blocks = spark.read.parquet(f"{path}/blocks")
    ranks = spark.read.parquet(f"{path}/ranks").toPandas()
    ids_of = np.zeros(len(ranks), "<u4")
    ids_of[ranks["rank"].to_numpy()] = ranks["id"].to_numpy()
    kind = blocks.schema["doc_id"].dataType.simpleString()
    last = "ids_crc32 long" if digest else "ids binary"
    rows = blocks.mapInArrow(_decoded(ids_of, digest), f"part int, start long, doc_id {kind}, n_tokens long, {last}")
    # One row per part: the parts are few, whatever the number of documents.
    sizes = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = rows.join(offsets, "part").withColumn("start", F.col("start") + F.col("before"))
    return rows.select("doc_id", "start", "n_tokens", last.split()[0])
