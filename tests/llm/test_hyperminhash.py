"""Near duplicates at 0.85 against plain loops; registers and their estimate against plain forms."""

import random

import numpy as np
import pyarrow as pa
import pytest

from inquest.llm.hyperminhash import BANDS, REGISTERS, ROWS, _shared, bands, estimate, likely, near_duplicates, registers, shingle_set
from tests.llm.cases import empty, frame, rows
from tests.llm.test_duplicates import sets_of
from tests.llm.test_nearcopies import edited, plain_shingles, planted


def plain_near(data, top=85, bottom=100):
    sets = [plain_shingles(x[1]) for x in data]
    group = sets_of(sets, lambda a, b: bool(a) and bool(b) and bottom * len(a & b) >= top * len(a | b))
    least = {g: min((x[0] for x, h in zip(data, group) if h == g and x[0] is not None), default=None) for g in set(group)}
    return [(x[0], len(s), least[g], x[0] == least[g]) for x, s, g in zip(data, sets, group)]


def templates(n=60):
    """Texts on a few templates whose pairs lie on both sides of the limit, so leaders do not settle them."""
    r = random.Random(4)
    base = [f"t{i}" for i in range(150)]
    texts = []
    for i in range(n):
        words = list(base)
        at = r.randrange(140)
        length = r.choice((1, 1, 2, 2, 2, 3, 6, 9))
        words[at : at + length] = [f"v{i}x{k}" for k in range(length)]
        texts.append(" ".join(words))
    return [(i, t, "en", "a", len(t), i, "", 0.5, "") for i, t in enumerate(texts)]


@pytest.mark.parametrize("chunk", [256, 7])
@pytest.mark.parametrize("make", [planted, templates, rows])
def test_classes_against_plain_sets(spark, make, chunk):
    data = make()
    want = plain_near(data)
    got = near_duplicates(frame(spark, data), chunk=chunk).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    if make is not rows:
        assert 2 < len({x[2] for x in want}) < 0.7 * len(data)


def test_other_limit_and_empty_table(spark):
    data = templates()
    got = near_duplicates(frame(spark, data), similarity=(4, 5)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_near(data, 4, 5)))
    assert near_duplicates(empty(spark)).count() == 0


def plain_register(hashes):
    """By strings of bits: zeros before the first one, then ten bits."""
    least = {}
    for h in hashes:
        bits = f"{int(h):064b}"
        bucket = int(bits[:8], 2)
        least[bucket] = min(least.get(bucket, "2"), bits[8:])
    out = {}
    for bucket, bits in least.items():
        zeros = len(bits) - len(bits.lstrip("0"))
        out[bucket] = zeros << 10 | int((bits[zeros + 1 :] + "0" * 10)[:10], 2)
    return out


def test_registers():
    r = np.random.RandomState(2)
    for n in (1, 3, 100, 5000):
        hashes = np.unique(r.randint(0, 1 << 62, n, np.int64).astype(np.uint64) * np.uint64(4) + np.uint64(3))
        hashes[0] = hashes[0] >> np.uint64(30)
        hashes = np.unique(hashes)
        want, got = plain_register(hashes), registers(hashes)
        assert all(got[b] == v for b, v in want.items())
        assert set(got.tolist()) == set(want.values())


def test_estimate_and_bands():
    """The estimate is near the truth, no pair at the limit is rejected, and pairs at the limit share a band."""
    r = random.Random(9)
    for size in (6, 12, 40, 200, 2000):
        errors, shares = [], []
        for _ in range(60):
            top = r.choice((0.85, 0.9))
            common = size - max(1, int(size * (1 - top) / (1 + top)))
            words = [f"w{r.randrange(10**9)}" for _ in range(size + 4)]
            full = shingle_set(" ".join(words))
            other = np.unique(np.concatenate([full[np.array(sorted(r.sample(range(len(full)), common)))], shingle_set(" ".join(f"z{r.randrange(10**9)}" for _ in range(size - common + 4)))]))
            inter = len(np.intersect1d(full, other))
            truth = inter / (len(full) + len(other) - inter)
            a, b = registers(full), registers(other)
            equal = np.array([(a == b).sum()])
            sizes = np.array([len(full)]), np.array([len(other)])
            errors.append(abs(float(estimate(equal, *sizes)[0]) - truth))
            if truth >= 0.85:
                assert likely(equal, *sizes, (85, 100)).all()
                shares.append((bands(a) == bands(b)).any())
        assert np.mean(errors) < (0.03 if size >= 200 else 0.12)
        assert all(shares)
    far = shingle_set(" ".join(f"a{i}" for i in range(3000))), shingle_set(" ".join(f"b{i}" for i in range(3000)))
    equal = np.array([(registers(far[0]) == registers(far[1])).sum()])
    assert not likely(equal, np.array([2996]), np.array([2996]), (85, 100)).any()


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_bands_of_one_text_go(size):
    """Runs over batch borders are found whole, whatever the batches."""
    r = random.Random(size)
    band = np.sort(np.array([r.randrange(30) for _ in range(60)] + [50] * 20 + [60]))
    num = np.arange(len(band))
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + size]) for x in (band, np.zeros(len(band), np.int8), num)], ["band", "b", "num"]) for i in range(0, len(band), size)]
    got = [tuple(x.values()) for batch in _shared(iter(batches)) for x in batch.to_pylist()]
    want = [(int(b), 0, int(i), int(num[band == b].min())) for b, i in zip(band, num) if (band == b).sum() > 1]
    assert sorted(got) == sorted(want)
    assert BANDS * ROWS <= REGISTERS


def test_pairs_of_a_group_are_estimated_in_one_call(monkeypatch):
    """As many as there are, and the same as one by one; the estimate's cost is by call."""
    import pyarrow as pa

    from inquest.llm import hyperminhash as H

    r = np.random.RandomState(3)
    base = np.unique(r.randint(0, 1 << 62, 900).astype(np.uint64) * np.uint64(4))
    sets = [np.unique(np.r_[base[: 900 - 12 * i], r.randint(0, 1 << 62, 12 * i).astype(np.uint64) * np.uint64(4)]) for i in range(24)]
    regs = np.stack([H.registers(s) for s in sets])
    n, size = len(sets), np.array([len(s) for s in sets])
    firsts = lambda x, y: np.flatnonzero((regs[x] == regs[y])[: H.BANDS * H.ROWS].reshape(H.BANDS, H.ROWS).all(axis=1))
    calls = []
    monkeypatch.setattr(H, "chance_equal", lambda *a, keep=H.chance_equal: calls.append(1) or keep(*a))
    found = 0
    for band in range(H.BANDS):
        batch = pa.RecordBatch.from_arrays(
            [pa.array(v) for v in (np.full(n, band, np.int8), np.arange(n), np.arange(n), size, np.full(n, True), np.full(n, True), np.full(n, True))],
            ["b", "num", "comp", "size", "home", "away", "outside"],
        )
        del calls[:]
        got = {(x, int(y)) for x, ask in H._candidates(batch, regs, (85, 100)) for y in ask}
        assert len(calls) <= 1
        equal = lambda x, y: np.array([(regs[x] == regs[y]).sum()])
        want = set()
        for x in range(n):
            for y in range(x):
                shared = firsts(x, y)
                if (shared[0] if len(shared) else 0) == band and H.likely(equal(x, y), size[[x]], size[[y]], (85, 100))[0]:
                    want.add((x, y))
        assert got == want
        found += len(got)
    assert found > 20
