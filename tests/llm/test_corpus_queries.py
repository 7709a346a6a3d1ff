"""Registered corpus queries against their SQL, and the pipeline stage by stage, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from inquest.llm.queries import ORACLES, QUERIES
from tools.check_queries import norm

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[key])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    df = QUERIES[key](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(norm(r[c]) for c in sorted(names)) for r in df.collect()) == want


def test_all_are_registered():
    keys = entry.queries()
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14))
    assert set(QUERIES) <= set(keys) and "pipeline" in keys


def test_pipeline(spark, tmp_path):
    from tests.llm.test_filters import plain_contamination
    from tests.llm.test_nearcopies import plain_groups

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        old, new = before.collect(), after.collect()
        ids = {r.doc_id for r in new}
        assert {(r.doc_id, r.text) for r in new} <= {(r.doc_id, r.text) for r in old}
        if name == "near_duplicates":
            group = plain_groups([r.text for r in old])
            assert sorted(ids) == sorted({min(r.doc_id for r, h in zip(old, group) if h == g) for g in set(group)})
        elif name == "decontamination":
            assert ids == {r.doc_id for r in old if not plain_contamination(r.text, items)[1]}
        elif name == "mixing":
            assert max(sum(r.doc_id == i for r in new) for i in ids) <= 2
        if name == "sharding":
            assert after.columns == [*columns, "shard", "slot"]
            assert len(new) == len(old) and len({(r.shard, r.slot) for r in new}) == len(new)
        else:
            assert after.columns == columns
        before = after


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "inquest")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                assert "inquest.llm" not in open(os.path.join(folder, name)).read()
