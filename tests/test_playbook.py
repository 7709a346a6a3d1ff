"""Playbook operators against plain Python."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from inquest.functions.sql import register_functions
from inquest.functions.text import chunk_table
from inquest.operators import playbook as K


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance, chunk", [(2, 2000), (2, 3), (1, 2000)])
def test_fuzzy_names_equal_all_pairs(spark, distance, chunk):
    """Names with edits at every place, short ones, repeated letters, and a crowd that shares all but its last letters."""
    r = random.Random(3)
    letters = "abcdefghij"
    names = ["".join(r.choice(letters) for _ in range(r.randint(1, 12))) for _ in range(60)]
    for n in list(names):
        for _ in range(2):
            s = list(n)
            for _ in range(r.randint(1, 3)):
                at = r.randrange(len(s) + 1)
                s[at : at + r.choice((0, 1))] = r.choice((["x"], [], [r.choice(letters)]))
            names.append("".join(s))
    names += [f"northern trading company {i:03d}" for i in range(40)] + ["aaaa", "aaaaa", "aaaaaa", "ÉCOLE d'Été", "ecole dété", "", None]
    got = {(x.name_a, x.name_b): x.distance for x in K.fuzzy_name_pairs(spark.createDataFrame([(n,) for n in names], "name string"), "name", distance, chunk).collect()}
    clean = sorted({"".join(c for c in (n or "").lower() if c.isalnum()) for n in names})
    clean = [c for c in clean if len(c) > 2 * (distance - 1) + 1]
    want = {(a, b): edits(a, b) for i, a in enumerate(clean) for b in clean[i + 1 :] if edits(a, b) <= distance}
    assert {tuple(sorted(k)): v for k, v in got.items()} == {tuple(sorted(k)): v for k, v in want.items()} and len(got) == len(want)


def test_robust_z_with_one_large_cohort(spark):
    r = random.Random(5)
    data = [("big", r.gauss(0, 9) ** 3) for _ in range(30_000)] + [("small", float(x)) for x in (1, 2, 4, 50)] + [("flat", 3.0)] * 5 + [(None, 1.0), ("small", None)]
    got = K.robust_z(spark.createDataFrame(data, "cohort string, v double"), "cohort", "v").collect()
    assert len(got) == len(data)
    for cohort in ("big", "small"):
        values = [v for c, v in data if c == cohort and v is not None]
        median = statistics.median(values)
        mad = statistics.median(abs(v - median) for v in values)
        for x in got:
            if x.cohort == cohort and x.v is not None:
                assert math.isclose(x.robust_z, 0.6745 * (x.v - median) / mad, rel_tol=1e-9, abs_tol=1e-12)
    assert all(x.robust_z is None for x in got if x.cohort in (None, "flat") or x.v is None)


def test_digits_refs_and_round_amounts(spark):
    amounts = spark.createDataFrame([("123.4",), ("-0.0019",), ("0",), ("x",), (None,), ("9e5",), ("1",)], "v string")
    digits = {r.digit: r.n for r in K.first_digits(amounts, "v").collect()}
    assert digits == {1: 3, 9: 1, **{d: 0 for d in range(2, 9)}}
    refs = spark.createDataFrame([("ab-12", "u1", 5.0), ("AB 12", "u2", 5.0), ("ab13", "u1", 5.0), (" ", "u1", 1.0), (None, "u1", 1.0), ("--", "u3", 2.0), ("--", "u3", 2.0)], "ref string, u string, v double")
    assert [tuple(r) for r in K.duplicate_refs(refs, "ref", "u", "v").collect()] == [("AB12", 2, 2, 1, 10.0)]
    rows = [("a", "m1", x) for x in (100, 200, 300, 7)] + [("a", "m2", x) for x in (100, 3, 5, 7, 9)] + [("b", "m1", 100)] * 5 + [("c", "m1", None)]
    found = K.round_amount_spikes(spark.createDataFrame(rows, "u string, m string, v int"), "u", "v", F.col("m")).collect()
    assert [(r.account, r.period, r.n, r.round_n, r.share, r.usual) for r in found] == [("a", "m1", 4, 3, 0.75, 0.2)]


def test_table_function_cuts_as_the_column_does(spark):
    r = random.Random(2)
    texts = ["\n\n".join(" ".join("word"[: r.randint(1, 4)] for _ in range(r.choice((1, 5, 40, 300)))) for _ in range(r.randint(1, 9))) for _ in range(30)]
    texts += ["", " \n\n ", None, "# head\n# next\n\n\n\ntail  ", "x" * 5000, "\n\n  a\n\nb  \n#c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, body string")
    register_functions(spark)
    for most, overlap in ((900, 150), (50, 10), (20, 0)):
        got = spark.sql(f"SELECT d.doc, c.chunk_index, c.text FROM {{d}} d, LATERAL chunk_text(d.body, {most}, {overlap}) c", d=docs)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunk_table(docs, "doc", "body", most, overlap).collect()))
