"""The scalar functions for SQL users, and read-only SQL on one case table.

The scalar ones are SQL functions, so the optimizer puts their bodies in place; nothing
runs in Python. Table functions run in Python, a row of the table at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from inquest.functions.scalar import DISPOSABLE_DOMAINS, EARTH_RADIUS_MILES, HOSTING_PATTERN
from inquest.functions.text import CHUNK_BREAK

_DOMAINS = ", ".join(f"'{d}'" for d in DISPOSABLE_DOMAINS)
_HOSTING = HOSTING_PATTERN.replace("\\", "\\\\")

SQL_FUNCTIONS = {
    "clean_key(v STRING) RETURNS STRING": "nullif(trim(v), '')",
    "subnet24(ip STRING) RETURNS STRING": (
        "CASE WHEN trim(ip) RLIKE '^((25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})[.]){3}(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$' "
        "THEN concat(substring_index(trim(ip), '.', 3), '.0/24') END"
    ),
    "email_domain(e STRING) RETURNS STRING": "get(split(lower(trim(e)), '@'), 1)",
    "is_disposable(e STRING) RETURNS BOOLEAN": f"get(split(lower(trim(e)), '@'), 1) IN ({_DOMAINS})",
    "shannon_entropy(s STRING) RETURNS DOUBLE": (
        "CASE WHEN length(s) = 0 THEN 0.0D ELSE log2(length(s)) - aggregate(array_distinct(filter(split(s, ''), c -> c <> '')), 0.0D, "
        "(acc, c) -> acc + (length(s) - length(replace(s, c, ''))) * log2(length(s) - length(replace(s, c, '')))) / length(s) END"
    ),
    "chrome_major(ua STRING) RETURNS INT": "try_cast(nullif(regexp_extract(ua, '(?i)Chrome/([0-9]+)', 1), '') AS INT)",
    "is_hosting_isp(isp STRING) RETURNS BOOLEAN": f"isp RLIKE '{_HOSTING}'",
    "haversine_miles(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) RETURNS DOUBLE": (
        f"2 * {EARTH_RADIUS_MILES}D * asin(least(1.0D, sqrt(pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2))))"
    ),
}


_BLANKS = " \t\n\f\r"


@udtf(returnType="chunk_index int, text string")
class ChunkText:
    """``chunk_text(body, max_chars, overlap)``: the chunks of a text as rows, as ``chunk_table`` makes them.

    A null text has none, and neither has one of white space alone.
    """

    def eval(self, body: str, max_chars: int, overlap: int) -> Iterator[tuple[int, str]]:
        held, index = "", 0
        for part in re.split(CHUNK_BREAK, (body or "").strip(_BLANKS)):
            part = part.strip(_BLANKS)
            for piece in (part[i : i + max_chars] for i in range(0, len(part), max_chars)):
                if len(held) + len(piece) + 2 <= max_chars:
                    held = f"{held}\n\n{piece}".strip(_BLANKS) if held else piece
                    continue
                if held:
                    yield index, held
                    index += 1
                    # Slices from the end need a length above 0.
                    held = held[len(held) - overlap :] if len(held) > overlap else held
                held = f"{held}\n\n{piece}".strip(_BLANKS) if held else piece
        if held:
            yield index, held


TABLE_FUNCTIONS = {"chunk_text": ChunkText}


def register_functions(spark: SparkSession) -> list[str]:
    """Make the functions known in the session; returns their names."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)
    return [*(h.split("(")[0] for h in SQL_FUNCTIONS), *TABLE_FUNCTIONS]


def run_select(dataset: DataFrame, sql: str, limit: int | None = None) -> DataFrame:
    """A read-only query on the case table, which it calls ``{dataset}``."""
    from inquest.operators.warehouse import readonly_query

    out = dataset.sparkSession.sql(readonly_query(sql), dataset=dataset)
    return out.limit(limit) if limit else out
