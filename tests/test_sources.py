import pytest
from pyspark.sql import functions as F

from inquest.operators.graph import graph_tables
from inquest.sources import external, files
from inquest.sources.sinks import append_audit, sink_graph_tables


def put(tmp_path, name, data: bytes):
    (tmp_path / name).write_bytes(data)
    return str(tmp_path / name)


def test_semicolon_bom_and_bad_line(spark, tmp_path):
    path = put(tmp_path, "a.csv", "﻿id;when;amount;note\n1;2024-01-02 03:04:05;7.5;x\n2;2024-01-03;8;y;surplus\n3;;9;z\n".encode())
    rows, rejected = files.scan_csv_tolerant(spark, path)
    assert dict(rows.dtypes) == {"id": "bigint", "when": "timestamp_ntz", "amount": "double", "note": "string"}
    assert [r.id for r in rows.orderBy("id").collect()] == [1, 3]
    assert [r[files.CORRUPT] for r in rejected.collect()] == ["2;2024-01-03;8;y;surplus"]


def test_other_encoding(spark, tmp_path):
    path = put(tmp_path, "b.csv", "name|n\nJosé|1\nZoë|2\n".encode("cp1252"))
    rows, _ = files.scan_csv_tolerant(spark, path)
    assert sorted(r.name for r in rows.collect()) == ["José", "Zoë"]


def test_empty_file(spark, tmp_path):
    rows, rejected = files.scan_csv_tolerant(spark, put(tmp_path, "c.csv", b""))
    assert rows.columns == [] and rejected.count() == 0


def test_reload_of_a_case_replaces_it_alone(spark, tmp_path):
    root = str(tmp_path / "sets")
    files.ingest_dataset(spark.range(5), root, "a")
    files.ingest_dataset(spark.range(7), root, "b")
    stored = files.ingest_dataset(spark.range(2), root, "a")
    assert {r.case_id: r["count"] for r in stored.groupBy("case_id").count().collect()} == {"a": 2, "b": 7}


def test_reader_options():
    o = external.reader_options("jdbc", "select 1;", url="jdbc:x", user="u", secret="s", driver="d")
    assert o == {"url": "jdbc:x", "user": "u", "password": "s", "driver": "d", "query": "select 1"}
    with pytest.raises(ValueError):
        external.reader_options("jdbc", "drop table x")
    with pytest.raises(ValueError):
        external.reader_options("other", "select 1")


@pytest.mark.parametrize("fmt", ["json", "xml"])
def test_graph_tables_in_other_formats(spark, tmp_path, fmt):
    spokes = spark.createDataFrame([("shared_device", "d1", "a", 2), ("shared_device", "d1", "b", 2)], "kind string, value string, account string, group_size long")
    nodes, edges = sink_graph_tables(*graph_tables(spokes, None, None), str(tmp_path), fmt)
    assert edges.count() == 2 and {r.node_class for r in nodes.collect()} == {"account", "device"}


def test_audit_rows_are_whole(spark, tmp_path):
    row = append_audit(spark.createDataFrame([("c" * 30_000, "n" * 9_000)], "code string, notes string"), str(tmp_path / "audit")).first()
    assert (len(row.code), len(row.notes)) == (30_000, 9_000)


def test_late_values_widen_types_and_quotes_hold(spark, tmp_path):
    lines = ["id,amount,body"] + [f'{i},{i},"{{\\"a\\": {i}, \\"b\\": \\"x\\"}}"' for i in range(60_000)] + [f"{i},{i}.5,late" for i in range(60_000, 60_005)]
    rows, rejected = files.scan_csv_tolerant(spark, put(tmp_path, "d.csv", "\n".join(lines).encode()))
    assert dict(rows.dtypes) == {"id": "bigint", "amount": "double", "body": "string"}
    assert rows.count() == 60_005 and rejected.count() == 0
    assert rows.filter("id = 7").first().body == '{"a": 7, "b": "x"}'


def test_a_late_byte_sets_the_encoding(spark, tmp_path):
    data = "\n".join(["name|n", *(f"plain|{i}" for i in range(500)), "Zoë|500"]).encode("cp1252")
    rows, _ = files.scan_csv_tolerant(spark, put(tmp_path, "e.csv", data))
    assert rows.filter("n = 500").first().name == "Zoë" and rows.count() == 501


def test_evidence_rows_have_the_buckets_of_their_transaction_without_a_join_of_wide_rows(spark, tmp_path):
    """Ids that come twice, with one bucket or several, null ids and users; the files are compressed."""
    import datetime as dt
    import glob

    from inquest.operators import chargeback as C
    from inquest.plans.chargeback_suite import evidence_rows
    from inquest.roles import ColumnRoles
    from inquest.sources.sinks import sink_evidence_packages

    schema = "transaction_id string, user_id long, amount double, disputed boolean, login_ts timestamp_ntz"
    at = dt.datetime(2024, 1, 1)
    own = [("a", 11, 1.0, True, at), ("a", 21, 2.0, True, None), ("b", 5, 3.0, True, at), (None, 7, 4.0, True, at), ("c", None, 5.0, True, at), ("d", 9, 6.0, False, at), ("b", 5, 3.0, True, at)]
    roles = ColumnRoles(user="user_id", transaction="transaction_id", amount="amount", disputed="disputed", login="login_ts")
    for data in (own, [*own, ("b", 6, 7.0, True, at), ("b", None, 8.0, True, at), ("a", 13, 9.0, False, at)]):
        df = spark.createDataFrame(data, schema)
        pairs = df.filter("disputed").select("transaction_id", (F.col("user_id") % 10).alias("bucket")).distinct()
        want = C.manifest_summary(C.manifests(df, roles)).join(pairs, "transaction_id")
        rows = evidence_rows(df, roles)
        order = lambda x: sorted(map(tuple, x.select("transaction_id", "bucket", "sections", "manifest").collect()), key=str)
        assert order(rows) == order(want)
    plain = evidence_rows(spark.createDataFrame(own, schema), roles)
    assert "Join" not in plain._jdf.queryExecution().optimizedPlan().toString()
    folder = str(tmp_path / "out")
    assert order(sink_evidence_packages(plain, folder, "bucket")) == order(plain)
    assert len(glob.glob(f"{folder}/bucket=*/*.json.gz")) == len(glob.glob(f"{folder}/*/part-*"))
