"""SQL warehouses as sources: the options per system, and landing of a result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inquest.sources.files import sink_csv, sink_parquet

# Option names of the public connectors, by our own setting names.
CONNECTOR_OPTIONS = {
    "snowflake": {"account_url": "sfURL", "user": "sfUser", "secret": "sfPassword", "database": "sfDatabase", "schema": "sfSchema", "warehouse": "sfWarehouse"},
    "bigquery": {"project": "parentProject", "dataset": "materializationDataset", "credentials_file": "credentialsFile"},
    "jdbc": {"url": "url", "user": "user", "secret": "password", "driver": "driver", "fetch_size": "fetchsize"},
}


def reader_options(system: str, query: str, **settings: str) -> dict[str, str]:
    """Options for ``spark.read.format(system)``; the query runs in the remote system."""
    if system not in CONNECTOR_OPTIONS:
        raise ValueError(f"unknown system {system!r}, expected one of {sorted(CONNECTOR_OPTIONS)}")
    names = CONNECTOR_OPTIONS[system]
    unknown = set(settings) - set(names)
    if unknown:
        raise ValueError(f"{system} has no setting {sorted(unknown)}")
    text = query.strip().rstrip(";")
    if not text.lower().startswith(("select", "with")):
        raise ValueError("only a query can be a source")
    options = {names[k]: v for k, v in settings.items()}
    options["query"] = text
    if system == "bigquery":
        options["viewsEnabled"] = "true"
    return options


def read_warehouse(spark: SparkSession, system: str, query: str, **settings: str) -> DataFrame:
    """Needs the connector of the system on the class path."""
    return spark.read.format(system).options(**reader_options(system, query, **settings)).load()


def land_result(df: DataFrame, folder: str) -> DataFrame:
    """Land a query result as Parquet, with a CSV copy for exchange; returns the Parquet rows."""
    landed = sink_parquet(df, f"{folder}/parquet")
    sink_csv(landed, f"{folder}/csv")
    return landed
