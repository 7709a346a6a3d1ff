"""CSV and Parquet sources, dataset tables per case, and schema summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inquest.functions.scalar import clean_key
from inquest.roles import clean_headers

DELIMITERS = (",", ";", "\t", "|")
CORRUPT = "_rejected"


@dataclass(frozen=True)
class CsvLayout:
    delimiter: str
    encoding: str
    header: tuple[str, ...]
    head: str


def sniff_csv(spark: SparkSession, path: str) -> CsvLayout | None:
    """Delimiter, encoding and header of a file from all of its lines; ``None`` for an empty one.

    ``read.text`` keeps the raw bytes of a line, so bytes that are not UTF-8 are seen wherever they stand. The header
    is the first line that is not blank; the delimiter is the one that most lines have as often as the header.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    first = lines.select(F.col("value").cast("binary").alias("b")).first()
    if first is None:
        return None
    start = bytes(first["b"])
    if start[:2] in (b"\xff\xfe", b"\xfe\xff"):
        encoding, head = "UTF-16", spark.read.options(encoding="UTF-16", sep="\u0001").csv(path).first()[0]
        counts = {d: 1 for d in DELIMITERS}
    else:
        number = {d: start.count(d.encode()) for d in DELIMITERS}
        same = [
            F.count_if(F.length("value") - F.length(F.replace("value", F.lit(d), F.lit(""))) == n).alias(str(i)) if n else F.lit(0).alias(str(i))
            for i, (d, n) in enumerate(number.items())
        ]
        found = lines.agg(F.every(F.is_valid_utf8("value")).alias("utf8"), *same).first()
        encoding = "UTF-8" if found["utf8"] else "ISO-8859-1"
        head = start.decode(encoding)
        counts = {d: found[str(i)] for i, d in enumerate(DELIMITERS)}
    head = head.lstrip("\ufeff").rstrip("\r")
    delimiter = max(DELIMITERS, key=lambda d: (counts[d], head.count(d)))
    header = tuple(h.strip().strip('"') for h in head.split(delimiter))
    return CsvLayout(delimiter, encoding, header, head)


def infer_types(raw: DataFrame) -> T.StructType:
    """Types that every non-empty cell of the whole frame can take: long, double, timestamp, else string."""
    tests = []
    for c in raw.columns:
        k = clean_key(F.col(f"`{c}`"))

        def all_cast(kind, k=k):
            return F.coalesce(F.every(F.when(k.isNotNull(), k.try_cast(kind).isNotNull())), F.lit(False))

        looks_like_time = F.coalesce(F.every(F.when(k.isNotNull(), k.rlike(r"^\d{4}-\d{2}-\d{2}"))), F.lit(False))
        tests.append(
            F.when(all_cast("bigint"), "bigint").when(all_cast("double"), "double")
            .when(looks_like_time & all_cast("timestamp_ntz"), "timestamp_ntz").otherwise("string")
        )
    kinds = raw.agg(F.array(*tests).alias("kinds")).first()["kinds"]
    return T.StructType([T.StructField(c, T._parse_datatype_string(k)) for c, k in zip(raw.columns, kinds)])


def _csv_lines(spark: SparkSession, path: str, layout: CsvLayout) -> DataFrame:
    """The data lines as text: no blank ones and no header."""
    if layout.encoding == "UTF-16":
        # ``read.text`` cuts lines at single bytes; the CSV reader with a delimiter that no text has gives whole lines.
        lines = spark.read.options(encoding="UTF-16", sep="\u0001", quote="").schema("line string").csv(path)
    else:
        lines = spark.read.text(path).select(F.decode(F.col("value").cast("binary"), layout.encoding).alias("line"))
    plain = F.rtrim(F.ltrim("line", F.lit("\ufeff")), F.lit("\r"))
    return lines.select(plain.alias("line")).filter((F.trim("line") != "") & (F.col("line") != layout.head))


def scan_csv_tolerant(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): unknown delimiter, encoding and types; bad lines are kept apart, not lost.

    Types come from all lines, so a value that fits no earlier one widens its column instead of being rejected.
    """
    layout = sniff_csv(spark, path)
    if layout is None:
        empty = spark.createDataFrame([], T.StructType([]))
        return empty, spark.createDataFrame([], f"{CORRUPT} string")
    lines = _csv_lines(spark, path, layout)

    def parsed(fields: list[T.StructField]) -> DataFrame:
        schema = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        options = {"sep": layout.delimiter, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
        return lines.select(F.from_csv("line", ddl, options).alias("r")).select("r.*")

    texts = parsed([T.StructField(h, T.StringType()) for h in layout.header])
    typed = infer_types(texts.filter(F.col(CORRUPT).isNull()).drop(CORRUPT))
    rows = parsed(typed.fields)
    good = clean_headers(rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT))
    return good, rows.filter(F.col(CORRUPT).isNotNull())


def scan_csv_typed(spark: SparkSession, path: str, schema: str, n_rows: int | None = None, **options: str) -> DataFrame:
    """CSV under a given schema, dates read as times; a row limit only where asked for."""
    df = spark.read.options(header="true", mode="PERMISSIVE", **options).schema(schema).csv(path)
    return df.limit(n_rows) if n_rows else df


def preview_rows(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def preview_schema(df: DataFrame, n: int = 5) -> DataFrame:
    """(column_name, dtype, sample): one row per column from the first rows."""
    kinds = dict(df.dtypes)
    head = df.limit(n)
    packs = [
        F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("dtype"), F.first(F.col(f"`{c}`").cast("string"), ignorenulls=True).alias("sample"))
        for c in df.columns
    ]
    return head.agg(F.array(*packs).alias("m")).select(F.inline("m"))


def schema_summary(df: DataFrame) -> DataFrame:
    """(column_name, dtype, null_count, row_count) from one aggregation over all columns."""
    packs = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(kind).alias("dtype"),
            F.count_if(F.col(f"`{c}`").isNull()).alias("null_count"), F.count("*").alias("row_count"),
        )
        for c, kind in df.dtypes
    ]
    return df.agg(F.array(*packs).alias("m")).select(F.inline("m"))


def clustered(df: DataFrame, by: str) -> DataFrame:
    """Rows of one partition value side by side before a partitioned write, so files are few.

    The hint lets AQE cut a value that holds a large share of the rows over many tasks.
    """
    return df.hint("rebalance", by)


def ingest_dataset(df: DataFrame, root: str, case_id: str | None = None) -> DataFrame:
    """Write a case's rows as Parquet under ``case_id=...``; an earlier load of the case is replaced.

    Only the partitions in ``df`` are overwritten. Without ``case_id`` the frame
    has to carry that column and many cases land in one job.
    """
    rows = df.withColumn("case_id", F.lit(case_id)) if case_id is not None else df
    clustered(rows, "case_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").parquet(root)
    return df.sparkSession.read.parquet(root)


def sink_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def sink_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").options(header="true", sep=sep, timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
