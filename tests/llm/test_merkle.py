"""Manifest against a plain tree."""

import hashlib
import zlib

import pytest

from inquest.llm.merkle import build_manifest, verify_documents
from tests.llm.cases import empty, frame, rows


def plain_digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return plain_digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def plain_tree(nodes):
    """The top hash, and for each node the steps (left, right) that lead to it."""
    paths, at, now = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(now) > 1:
        for leaf, i in enumerate(at):
            run, slot = now[i // 8 * 8 : i // 8 * 8 + 8], i % 8
            paths[leaf].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        now = [plain_digest(now[i : i + 8]) for i in range(0, len(now), 8)]
        at = [i // 8 for i in at]
    return now[0], paths


def plain_rows(data):
    """(id, leaf, subroot, root, proof, folded root, verified) of every row."""
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    groups = {}
    for x in data:
        doc, text, lang, source, chars = x[:5]
        low = None if text is None else text.encode().translate(lower).decode()
        tampered = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
        leaf = plain_leaf((doc, source, lang, chars, text))
        groups.setdefault(lang, []).append((doc is None, doc or 0, leaf, doc, plain_leaf((doc, source, lang, chars, low)) if tampered else leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, over = plain_tree([trees[g][0] for g in names])
    for g, up in zip(names, over):
        for x, path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            fold = x[4]
            for left, right in path + up:
                fold = plain_digest((left, fold, right))
            proof = plain_digest(a + b for a, b in path + up)
            yield x[3], x[2], trees[g][0], root, proof, fold, fold == root


def with_langs(data):
    """A group with most rows, one of 65, one of nine, one of a single row, null and the empty name."""
    langs = ["en"] * len(data)
    langs[3], langs[4:6], langs[20:29] = "zz", ["", ""], ["é"] * 9
    langs[40:43] = [None] * 3
    out = [(*x[:2], lang, *x[3:]) for x, lang in zip(data, langs)]
    return out + [(1000 + i, "Text A" * i, "many", None, i, 0, "", 0.0, "") for i in range(65)]


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_documents_against_plain_trees(spark):
    data = with_langs(rows())
    got = verify_documents(frame(spark, data))
    want = sorted(map(str, plain_rows(data)))
    assert sorted(str(tuple(r)) for r in got.select(*COLUMNS).collect()) == want
    tampered = [r for r in got.collect() if not r.verified]
    assert tampered and all(r.tampered_leaf != r.leaf for r in tampered)
    assert verify_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513])
def test_one_group(spark, n):
    data = [(i, f"Text {i}", "en", "s", i, 0, "", 0.0, "") for i in range(n)]
    got = verify_documents(frame(spark, data))
    assert sorted(str(tuple(r)) for r in got.select(*COLUMNS).collect()) == sorted(map(str, plain_rows(data)))


def test_rows_that_are_equal_keep_places_of_their_own(spark):
    data = [(5, "same", "en", "s", 4, 0, "", 0.0, "")] * 20
    assert [r.verified for r in verify_documents(frame(spark, data)).collect()].count(True) in (0, 20)
    got = verify_documents(frame(spark, data)).collect()
    assert sorted(str(tuple(r[c] for c in COLUMNS)) for r in got) == sorted(map(str, plain_rows(data)))


def test_clashing_names(spark):
    with pytest.raises(ValueError):
        build_manifest(spark.createDataFrame([("a", "b", 1)], "of string, leaf string, path int"), "of", ["leaf"], "leaf")
