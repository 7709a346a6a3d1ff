"""The cross-case ledger: events, entities, overlap between cases, and who may see what.

Per entity the ledger keeps one row per case (``entity_cases``), never one long
list; counts and overlaps are aggregates of that table. An entity that occurs in
every case is therefore spread over as many rows as there are cases.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inquest.functions.scalar import case_status_label, month_label, row_json
from inquest.operators.keyed import packed_members
from inquest.operators.relational import search_rows_text
from inquest.roles import entity_columns
from inquest.session import cut_lineage
from inquest.sources.files import clustered

ENTITY = ["entity_type", "entity_value"]

# ---- ledger ------------------------------------------------------------------


def numbered(rows: DataFrame, case: str) -> DataFrame:
    """Adds ``_row_index``, gapless from 0 in each case: places inside a part, and the row counts of the parts before it."""
    parts = cut_lineage(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    earlier = Window.partitionBy(case).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy(case, "_part").agg(F.count("*").alias("_n"))
    offsets = offsets.select(F.col(case).alias("_case"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(case, "_part").orderBy("_at")) - 1
    placed = parts.withColumn("_in", inside).join(offsets, F.col(case).eqNullSafe(F.col("_case")) & (F.col("_part") == F.col("_p")))
    return placed.withColumn("_row_index", F.col("_in") + F.col("_before")).select(*rows.columns, "_row_index")


def append_events(rows: DataFrame, case: str, uploaded: str, row_index: str | None = None, filename: str | None = None) -> DataFrame:
    """Ledger rows: case, upload time, file name, row index, and the row as JSON text.

    Without an index column the rows of a case are numbered 0, 1, ... in the order they are read; the rows are
    written to the shared folder first, so that the numbers stand.
    """
    if row_index is None:
        rows, row_index = numbered(rows, case), "_row_index"
    body = [c for c in rows.columns if c not in (case, uploaded, row_index, filename)]
    name = F.col(filename) if filename else F.concat(F.col(case), F.lit(".csv"))
    index = F.col(row_index).cast("long")
    return rows.select(
        F.col(case).alias("source_case_id"), F.col(uploaded).alias("upload_timestamp"), name.alias("source_filename"),
        index.alias("row_index"), row_json(body).alias("row_json"),
    )


# Texts that stand for a missing value.
EMPTY_WORDS = ("null", "none", "nan")


def extract_entities(rows: DataFrame, case: str, uploaded: str, columns: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per entity in a row: case, time, type, value, source column.

    The entity columns of one row are a short array, so the first of equal (type,
    value) pairs is kept inside the row, without a shuffle.
    """
    found = columns if columns is not None else entity_columns([c for c in rows.columns if c not in (case, uploaded)])
    value = lambda c: F.trim(F.col(c).cast("string"))
    cells = F.array(*[F.struct(F.lit(k).alias("t"), value(c).alias("v"), F.lit(c).alias("c")) for k, c in found])
    filled = F.filter(cells, lambda e: e["v"].isNotNull() & (e["v"] != "") & ~F.lower(e["v"]).isin(*EMPTY_WORDS))
    rows = rows.withColumn("_cells", filled)
    keys = F.transform("_cells", lambda e: F.struct(e["t"], e["v"]))
    firsts = F.filter("_cells", lambda e, i: F.array_position(keys, F.struct(e["t"], e["v"])) == i + 1)
    return rows.select(F.col(case).alias("source_case_id"), F.col(uploaded).alias("upload_timestamp"), F.explode(firsts).alias("e")).select(
        "source_case_id", "upload_timestamp", F.col("e.t").alias("entity_type"), F.col("e.v").alias("entity_value"), F.col("e.c").alias("source_column")
    )


def entity_cases(occurrences: DataFrame) -> DataFrame:
    """(type, value, case, first_seen, last_seen): one row per entity and case."""
    return occurrences.groupBy(*ENTITY, "source_case_id").agg(
        F.min("upload_timestamp").alias("first_seen"), F.max("upload_timestamp").alias("last_seen")
    )


def entity_map(occurrences: DataFrame) -> DataFrame:
    """(type, value, distinct_case_count, first_seen, last_seen) over all cases."""
    per_case = entity_cases(occurrences)
    return per_case.groupBy(*ENTITY).agg(
        F.count("*").alias("distinct_case_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def entity_case_lists(occurrences: DataFrame, chunk: int = 1000) -> DataFrame:
    """The case list of each entity in sorted pieces of about ``chunk`` cases."""
    return packed_members(occurrences, ENTITY, "source_case_id", chunk)


def refresh_entity_map(old: DataFrame, occurrences: DataFrame, touched: DataFrame) -> DataFrame:
    """Entity map after a change: only the touched entities are counted again."""
    keys = touched.select(*ENTITY).distinct()
    again = entity_map(occurrences.join(keys, ENTITY, "left_semi"))
    return old.join(keys, ENTITY, "left_anti").unionByName(again)


def remove_case(occurrences: DataFrame, old_map: DataFrame, case_id: Column | str) -> tuple[DataFrame, DataFrame]:
    """Occurrences without the case, and the map counted again for its entities."""
    gone = F.col("source_case_id") == case_id
    rest = occurrences.filter(~gone)
    return rest, refresh_entity_map(old_map, rest, occurrences.filter(gone))


class Ledger:
    """Ledger tables under one folder, partitioned by case; a case's files are replaced as a whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def put(self, rows: DataFrame, case: str, uploaded: str, row_index: str | None = None) -> None:
        parts = {"events": append_events(rows, case, uploaded, row_index), "occurrences": extract_entities(rows, case, uploaded)}
        for name, df in parts.items():
            clustered(df, "source_case_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_case_id").parquet(f"{self.root}/{name}")

    def events(self, spark: SparkSession | None = None) -> DataFrame:
        return (spark or self.spark).read.parquet(f"{self.root}/events")

    def occurrences(self, spark: SparkSession | None = None) -> DataFrame:
        return (spark or self.spark).read.parquet(f"{self.root}/occurrences")

    def query(self, sql: str, allowed: list[str] | DataFrame | None = None, limit: int | None = None) -> DataFrame:
        """A read-only query over views that show the allowed cases only.

        It runs in a session of its own. The parsed query may name the three views and its own common table
        expressions; any other name, of a catalog table, a global view or a file, is refused. ``allowed`` is a
        list of cases or a frame with ``source_case_id``.
        """
        text = readonly_query(sql)
        scoped = self.spark.newSession()
        scoped.conf.set("spark.sql.runSQLOnFiles", "false")
        strange = named_relations(scoped, text) - set(VIEW_NAMES)
        if strange:
            raise ValueError(f"query names {sorted(strange)}; it may read {', '.join(VIEW_NAMES)}")
        events, seen = self.events(scoped), self.occurrences(scoped)
        if isinstance(allowed, DataFrame):
            mine = allowed.select("source_case_id").distinct()
            events, seen = (d.join(mine, "source_case_id", "left_semi") for d in (events, seen))
        elif allowed is not None:
            events, seen = (d.filter(F.col("source_case_id").isin(*allowed)) for d in (events, seen))
        events.createOrReplaceTempView("warehouse_events")
        seen.createOrReplaceTempView("entity_occurrences")
        entity_map(seen).createOrReplaceTempView("entity_map")
        out = scoped.sql(text)
        return out.limit(limit) if limit else out


VIEW_NAMES = ("warehouse_events", "entity_occurrences", "entity_map")


def named_relations(spark: SparkSession, sql: str) -> set[str]:
    """Names of the tables that a parsed query reads, subqueries included, without its own common table expressions."""
    tree = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).treeString()
    own = {x.strip().lower() for m in re.findall(r"CTE \[([^\]]*)\]", tree) for x in m.split(",")}
    read = {".".join(x.strip().lower() for x in m.split(",")) for m in re.findall(r"UnresolvedRelation \[([^\]]*)\]", tree)}
    return read - own


# Words that a read-only query does not contain, and its greatest length.
FORBIDDEN_WORDS = (
    "insert|update|delete|drop|alter|attach|detach|copy|pragma|export|import|"
    "create|replace|truncate|call|checkpoint|rollback|commit|vacuum"
)
MAX_SQL_CHARS = 12_000


def readonly_query(sql: str) -> str:
    """The text of one SELECT or WITH query, or ``ValueError``."""
    text = (sql or "").strip().rstrip(";").strip()
    problems = (
        (not text, "the query is empty"),
        (len(text) > MAX_SQL_CHARS, "the query is too long"),
        (not re.match(r"(?i)(select|with)\b", text), "only SELECT or WITH can start a query"),
        (";" in text, "one statement only"),
        ("--" in text or "/*" in text, "no comments in a query"),
        (bool(re.search(rf"(?i)\b({FORBIDDEN_WORDS})\b", text)), "a query does not change anything"),
        (bool(re.search(r"(?i)\bmain\.|\bset\s+schema\b", text)), "name the views without a schema"),
    )
    for bad, why in problems:
        if bad:
            raise ValueError(why)
    return text


# ---- access ---------------------------------------------------------------------


def allowed_cases(cases: DataFrame, shares: DataFrame) -> DataFrame:
    """(viewer_case_id, case_id) for every case as viewer: itself, and owners of its tenant that share with it."""
    own = cases.select(F.col("case_id").alias("viewer_case_id"), "case_id")
    tenant = cases.select("case_id", "tenant_id")
    pairs = shares.select("owner_case_id", "viewer_case_id").distinct()
    shared = (
        pairs.join(tenant.toDF("viewer_case_id", "viewer_tenant"), "viewer_case_id")
        .join(tenant.toDF("owner_case_id", "owner_tenant"), "owner_case_id")
        .filter("viewer_tenant = owner_tenant")
    )
    return own.unionByName(shared.select("viewer_case_id", F.col("owner_case_id").alias("case_id"))).distinct()


def tenant_cases(cases: DataFrame, tenant: str) -> DataFrame:
    return cases.filter(F.col("tenant_id") == tenant).select("case_id")


def visible_rows(rows: DataFrame, allowed: DataFrame, viewer: str) -> DataFrame:
    """Ledger rows of the cases that the viewer may see."""
    mine = allowed.filter(F.col("viewer_case_id") == viewer).select(F.col("case_id").alias("source_case_id"))
    return rows.join(mine, "source_case_id", "left_semi").select(*rows.columns)


def visible_entity_map(occurrences: DataFrame, allowed: DataFrame, viewer: str) -> DataFrame:
    """Entity map counted from visible rows only, so hidden cases do not show in the numbers."""
    return entity_map(visible_rows(occurrences, allowed, viewer))


def entities_touching(entities: DataFrame, occurrences: DataFrame, allowed: DataFrame, viewer: str) -> DataFrame:
    """Entities of the full map that occur in any visible case (their counts cover all cases)."""
    keys = visible_rows(occurrences, allowed, viewer).select(*ENTITY).distinct()
    return entities.join(keys, ENTITY, "left_semi")


# ---- overlap --------------------------------------------------------------------

# More other cases than this make a repeat offender, and the three priorities.
RECIDIVIST_OVER = 2
PRIORITIES = ("Recidivist Fraudster", "Elevated", "Normal")


def overlap_priority(others: Column) -> Column:
    repeat, elevated, normal = PRIORITIES
    return F.when(others > RECIDIVIST_OVER, repeat).when(others > 0, elevated).otherwise(normal)


def entity_overlap(occurrences: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(case, type, value, other_cases, recidivist, priority) for all entities of all cases."""
    per_case = entity_cases(occurrences).select("source_case_id", *ENTITY)
    counts = (entities if entities is not None else entity_map(occurrences)).select(*ENTITY, "distinct_case_count")
    others = F.col("distinct_case_count") - 1
    return per_case.join(counts, ENTITY).select(
        "source_case_id", *ENTITY, others.alias("other_cases"), (others > RECIDIVIST_OVER).alias("recidivist"), overlap_priority(others).alias("priority")
    )


def overlap_by_case(occurrences: DataFrame) -> DataFrame:
    """Per case and type: entities, entities seen elsewhere, repeat offenders, and links to other cases in all."""
    return entity_overlap(occurrences).groupBy("source_case_id", "entity_type").agg(
        F.count("*").alias("entities"), F.count_if(F.col("other_cases") > 0).alias("shared"),
        F.count_if("recidivist").alias("recidivists"), F.sum("other_cases").alias("links"),
    )


def overlap_with(occurrences: DataFrame, active: Column | str) -> DataFrame:
    """The active case against history: per other case and type, the number of shared entities.

    One side is the active case alone, so an entity in n cases gives n - 1 rows.
    """
    per_case = entity_cases(occurrences).select("source_case_id", *ENTITY)
    mine = per_case.filter(F.col("source_case_id") == active).select(*ENTITY)
    other = per_case.filter(F.col("source_case_id") != active)
    return other.join(mine, ENTITY, "left_semi").groupBy("source_case_id", "entity_type").agg(F.count("*").alias("shared"))


def with_case_meta(rows: DataFrame, cases: DataFrame, case: str = "source_case_id") -> DataFrame:
    """Adds name, status, label and opening time of the case; an unknown case shows its id."""
    meta = cases.select(F.col("case_id").alias(case), "case_name", "status", "created_at")
    out = rows.join(meta, case, "left")
    return out.withColumns({
        "result_label": F.when(F.col("case_name").isNull(), "Unknown").otherwise(case_status_label(F.col("status"))),
        "status": F.when(F.col("case_name").isNull(), "UNKNOWN").otherwise(F.coalesce("status", F.lit("INVESTIGATING"))),
        "case_name": F.coalesce("case_name", F.col(case)),
    })


def linkage_timeline(occurrences: DataFrame, cases: DataFrame, active: Column | str) -> DataFrame:
    """Cases around each entity of the active case: historical ones by opening time, and the active one."""
    per_case = entity_cases(occurrences).select("source_case_id", *ENTITY)
    mine = per_case.filter(F.col("source_case_id") == active).select(*ENTITY)
    known = with_case_meta(per_case.join(mine, ENTITY, "left_semi"), cases)
    current = F.col("source_case_id") == active
    theme = F.when(current, "active_investigation").when(F.lower("case_name").contains("bot"), "bot_activity").otherwise("prior_case")
    return known.select(
        *ENTITY, F.col("source_case_id").alias("case_id"), F.col("case_name").alias("title"), month_label(F.col("created_at")).alias("month_label"),
        F.when(current, "current").otherwise("historical").alias("position"), theme.alias("theme"), "result_label", "created_at",
    )


def linkage_edges(occurrences: DataFrame, active: Column | str) -> DataFrame:
    """Edges historical case -> entity -> active case, one row per edge."""
    per_case = entity_cases(occurrences).select("source_case_id", *ENTITY)
    node = F.concat_ws(":", *ENTITY)
    mine = per_case.filter(F.col("source_case_id") == active)
    shared = per_case.filter(F.col("source_case_id") != active).join(mine.select(*ENTITY), ENTITY, "left_semi")
    history = shared.select(F.concat(F.lit("case:"), "source_case_id").alias("src"), node.alias("dst"), F.lit("seen_in").alias("relation"))
    now = mine.join(shared.select(*ENTITY).distinct(), ENTITY, "left_semi").select(
        node.alias("src"), F.concat(F.lit("case:"), "source_case_id").alias("dst"), F.lit("active").alias("relation")
    )
    return history.unionByName(now)


def probe_rows(events: DataFrame, term: str, ip: str, limit: int | None = None) -> DataFrame:
    """Distinct (case, file, time) of rows that contain both a term and an address."""
    both = events.filter(F.lower("row_json").contains(term.lower()) & F.col("row_json").contains(ip))
    found = both.select("source_case_id", "source_filename", "upload_timestamp").distinct()
    return found.orderBy("upload_timestamp", "source_case_id").limit(limit) if limit else found


def probe_pattern(events: DataFrame, occurrences: DataFrame, term: str, entity_type: str, value: str) -> DataFrame:
    """Cases that carry an entity; where no case does, cases whose text has the term and the value.

    The choice is made inside the plan: text hits are kept only if there is no entity hit.
    """
    direct = occurrences.filter((F.col("entity_type") == entity_type) & (F.col("entity_value") == value)).select("source_case_id").distinct()
    n_direct = direct.agg(F.count("*")).scalar()
    text = probe_rows(events, term, value).select("source_case_id").distinct().filter(n_direct == 0)
    return direct.withColumn("source", F.lit("entity")).unionByName(text.withColumn("source", F.lit("text")))


def text_search(events: DataFrame, allowed: DataFrame | None, viewer: str | None, needle: str, limit: int | None = None) -> DataFrame:
    rows = visible_rows(events, allowed, viewer) if allowed is not None and viewer else events
    return search_rows_text(rows, needle, limit)
