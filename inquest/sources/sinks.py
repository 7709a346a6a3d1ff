"""Findings out: graph tables, evidence packages, leads, audit rows, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inquest.functions.scalar import clamp, clean_key
from inquest.sources.files import clustered


def sink_graph_tables(nodes: DataFrame, edges: DataFrame, folder: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Node and edge tables for graph tools, as ``parquet``, ``csv`` or ``json``; XML too."""
    spark = nodes.sparkSession
    out = []
    for name, df in (("nodes", nodes), ("edges", edges)):
        path = f"{folder}/{name}"
        writer = df.write.mode("overwrite").format(fmt)
        reader = spark.read.format(fmt).schema(df.schema)
        if fmt == "csv":
            writer, reader = writer.option("header", "true"), reader.option("header", "true")
        if fmt == "xml":
            tag = name[:-1]
            writer = writer.options(rowTag=tag, rootTag=name)
            reader = reader.option("rowTag", tag)
        writer.save(path)
        out.append(reader.load(path))
    return out[0], out[1]


def sink_evidence_packages(manifests: DataFrame, folder: str, by: str, compression: str = "gzip") -> DataFrame:
    """One JSON line per transaction, in folders per ``by``; files are compressed, since a manifest repeats its row and all headers."""
    clustered(manifests, by).write.mode("overwrite").partitionBy(by).json(folder, compression=compression)
    # The partition value is in the path, and the reader puts it last.
    fields = [f for f in manifests.schema.fields if f.name != by]
    schema = type(manifests.schema)([*fields, manifests.schema[by]])
    return manifests.sparkSession.read.schema(schema).json(folder)


LEAD_KEY = ("case_id", "pin_kind", "fingerprint")


def new_leads(incoming: DataFrame, existing: DataFrame, order: str = "created_at") -> DataFrame:
    """Incoming leads that open something new: no OPEN lead has the same key.

    Of several incoming leads with one key the earliest is kept; severity goes to [0, 1].
    """
    open_keys = existing.filter(F.col("status") == "OPEN").select(*LEAD_KEY).distinct()
    fresh = incoming.join(open_keys, list(LEAD_KEY), "left_anti")
    first = fresh.withColumn("_n", F.row_number().over(W.partitionBy(*LEAD_KEY).orderBy(order, "lead_id"))).filter("_n = 1")
    return first.drop("_n").withColumn("severity", clamp(F.col("severity"), 0, 1)).withColumn("status", F.lit("OPEN"))


def append_audit(actions: DataFrame, path: str) -> DataFrame:
    """Append to the audit table; code and notes are kept whole."""
    actions.write.mode("append").parquet(path)
    return actions.sparkSession.read.parquet(path)


def bulk_flags(members: DataFrame, cluster: tuple[str, ...], account: str, reason: str = "BOT_CLUSTER") -> DataFrame:
    """One row per flagged account and cluster, trimmed and without repeats; no account is left out."""
    rows = members.select(*cluster, clean_key(F.col(account)).alias("account_id")).filter("account_id IS NOT NULL")
    return rows.distinct().withColumn("reason", F.lit(reason))
