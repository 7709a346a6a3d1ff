"""Mixing, sharding and token files: laws that must hold, and exact round trips."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inquest.llm import tokenfile
from inquest.llm.mixing import mix_documents, mix_report, mixed_copies
from inquest.llm.permute import permuted
from inquest.llm.sharding import shard_rows
from inquest.llm.tokenfile import PieceEncoder, pack, read_tokens, unpack, write_tokens
from tests.llm.cases import empty, frame, rows, split_words


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_permutation(spark, n):
    got = [r.p for r in spark.range(n).select(permuted(F.col("id"), F.lit(n), F.lit(5)).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    if n > 9:
        assert got != list(range(n))


def test_shards(spark):
    data = rows()
    got = shard_rows(frame(spark, data), 7).collect()
    assert len(got) == len(data)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    again = shard_rows(frame(spark, data).repartition(5), 7).collect()
    key = lambda rs: sorted((r.shard, r.slot, str(r.text)) for r in rs if r.doc_id is not None)
    assert key(got) == key(again)
    assert shard_rows(empty(spark)).count() == 0
    assert shard_rows(frame(spark, data[:3]), 7).count() == 3
    with pytest.raises(ValueError):
        shard_rows(frame(spark, data).withColumn("shard", F.lit(1)))


def plain_targets(sizes, weights=(5, 2, 1)):
    """Reshare step by step, as the words say it."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= 2 * sizes[s]
        open_ -= full
    return target


@pytest.mark.parametrize("seed", [3, 4])
def test_mix(spark, seed):
    data = rows(seed)
    if seed == 4:  # one source with most of the words, and one that has none
        data = [(*x[:3], "big" if (x[0] or 0) % 3 else x[3], *x[4:]) for x in data] + [(900, None, "en", "nothing", 0, 0, "", 0.0, "")]
    got = mix_report(frame(spark, data), block_words=16, shard_blocks=64).collect()
    assert len(got) == len(data)
    size = defaultdict(int)
    for x in data:
        size[x[3]] += len(split_words(x[1]))
    target = plain_targets(size)
    source = {x[0]: x[3] for x in data if x[0] is not None}
    taken = defaultdict(int)
    for r in got:
        assert r.taken <= 2 * r.size
        if r.doc_id is not None:
            s = source[r.doc_id]
            assert r.source_size == size[s] and r.target == pytest.approx(target[s])
            taken[s] += r.taken
        else:
            taken["?"] += r.taken
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.05)
    again = mix_report(frame(spark, data).repartition(7), block_words=16, shard_blocks=64).collect()
    key = lambda rs: sorted((r.doc_id, r.taken) for r in rs if r.doc_id is not None and r.doc_id != 12)
    assert key(got) == key(again)


def test_mix_parts(spark):
    data = rows()
    mix = mix_documents(frame(spark, data), block_words=16, shard_blocks=64)
    slots, blocks = mix.slots.collect(), {r["rank"]: (r.blocks, r.quota) for r in mix.sources.collect()}
    uses = Counter((s["rank"], s.block) for s in slots)
    for rank, (n, quota) in blocks.items():
        own = [s for s in slots if s["rank"] == rank]
        assert sorted(s.slot for s in own) == list(range(quota))
        assert all(0 <= s.block < n for s in own)
        counts = [uses[rank, b] for b in range(n)]
        assert max(counts, default=0) - min(counts, default=0) <= 1
    copies = mixed_copies(frame(spark, data))
    assert copies.columns == empty(spark).columns
    assert mix_report(empty(spark)).count() == 0 and mixed_copies(empty(spark)).count() == 0


def test_copies_keep_the_words_of_a_source(spark):
    """One text has most words of its source, one source has a single text: copies are within a longest text of what is taken."""
    r = random.Random(6)
    data = [(i, " ".join(["w"] * r.randint(1, 300)), "en", "src" + str(i % 3), 0, i, "", 0.5, "") for i in range(400)]
    data += [(500, "long " * 20_000, "en", "src1", 0, 0, "", 0.5, ""), (501, "lone " * 3000, "en", "src9", 0, 0, "", 0.5, ""), (502, "none " * 50, "en", None, 0, 0, "", 0.5, "")]
    words_of = {x[0]: len(split_words(x[1])) for x in data}
    taken = {x.doc_id: x.taken for x in mix_report(frame(spark, data), order=("doc_id",)).collect()}
    copies = Counter(x.doc_id for x in mixed_copies(frame(spark, data)).collect())
    for source in {x[3] for x in data}:
        own = [x[0] for x in data if x[3] == source]
        want, got = sum(taken[i] for i in own), sum(copies[i] * words_of[i] for i in own)
        assert abs(want - got) <= max(words_of[i] for i in own)
        assert all(copies[i] <= 2 for i in own)
    total = sum(copies[i] * words_of[i] for i in copies)
    assert abs(total - sum(taken.values())) <= 20_000 + 3000 + 300 * 3


def test_codes():
    r = random.Random(2)
    for rows_ in ([], [0], [1, 4, 5, 0, 3], [1000]):
        n = np.array(rows_, np.int64)
        values = np.array([r.choice((r.randrange(256), r.randrange(1 << 16), r.randrange(1 << 24), r.randrange(1 << 32))) for _ in range(int(n.sum()))], np.uint32)
        control, control_cuts, data, data_cuts = pack(values, n)
        assert len(control) == control_cuts[-1] == sum(-(-k // 4) for k in rows_)
        assert len(data) == data_cuts[-1] == sum(max(1, (int(v).bit_length() + 7) // 8) for v in values)
        assert (unpack(control, data, n) == values).all()


def tokenizer_path():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(path, texts, end=None):
    ids, n = PieceEncoder(path).encode(pa.array(texts, pa.string()), end)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if texts else []


def plain_ids(path, texts):
    """By the library alone."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_are_encoded_like_whole_texts(monkeypatch):
    texts = [x[1] or "" for x in rows()] + ["  two  spaces ", "\u00a0a\u3000b \u2003c", "x\n y\n\n  z", "don't  <|endoftext|> stop", " lead", "trail ", "\x1c a\x85 b", "1 2,3 4", "a\n\nb c\n", "\n"]
    want = plain_ids(tokenizer_path(), texts)
    assert encoded(tokenizer_path(), texts) == want
    assert encoded(tokenizer_path(), texts, 7) == [[*x, 7] for x in want]
    assert encoded(tokenizer_path(), []) == []
    # A memory that forgets all the time gives the same ids.
    monkeypatch.setattr(tokenfile, "MEMORY", 30)
    encoder, got = PieceEncoder(tokenizer_path()), []
    for i in range(0, len(texts), 4):
        ids, n = encoder.encode(pa.array(texts[i : i + 4], pa.string()))
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == want


def test_added_tokens_of_the_file_are_kept(spark, tmp_path):
    path, end = tokenizer_path(), "<|endoftext|>"
    texts = [f"one document {end} next document", end, f"{end}{end} a", "no such token", f"  two{end}\n\nthree ", "<|endoftext| >", ""]
    want = plain_ids(path, texts)
    assert encoded(path, texts) == want
    write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "t"), path, end=2)
    got = sorted(read_tokens(spark, str(tmp_path / "t")).collect())
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == [[*x, 2] for x in want]


def test_token_files(spark, tmp_path):
    path, data = tokenizer_path(), rows()
    write_tokens(frame(spark, data), str(tmp_path / "t"), path, end=2)
    got = read_tokens(spark, str(tmp_path / "t")).collect()
    sums = {(r.start, r.n_tokens): r.ids_crc32 for r in read_tokens(spark, str(tmp_path / "t"), digest=True).collect()}
    want = Counter((x[0], np.array([*ids, 2], "<u4").tobytes()) for x, ids in zip(data, plain_ids(path, [x[1] or "" for x in data])))
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and len(r.ids) == 4 * r.n_tokens and sums[r.start, r.n_tokens] == zlib.crc32(bytes(r.ids))
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    known = [x for x in order if x is not None]
    assert known == sorted(known) and order[: len(known)] == known
    write_tokens(empty(spark), str(tmp_path / "e"), path, end=2)
    assert read_tokens(spark, str(tmp_path / "e")).count() == 0
