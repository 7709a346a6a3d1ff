"""Playbook queries: amounts from order lines, names from the first words of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from inquest.operators import playbook as K
from inquest.plans.registry import query

TXN = ("v_txn",)


@query(
    "pb_benford",
    """WITH d AS (SELECT segment, CAST(substr(format('{:e}', amount), 1, 1) AS INT) AS digit FROM v_txn WHERE amount > 0), t AS (SELECT segment, count(*) AS total FROM d GROUP BY segment),
r AS (SELECT segment, digit, total, (SELECT count(*) FROM d WHERE d.segment = t.segment AND d.digit = g.digit) AS n FROM t, (SELECT unnest(range(1, 10))::INT AS digit) g)
SELECT segment, digit, n, round(n / total, 9) AS share, round(log10(1 + 1 / digit), 9) AS expected, round(power(n - total * log10(1 + 1 / digit), 2) / (total * log10(1 + 1 / digit)), 6) AS chi2 FROM r""",
    TXN,
)
def _(t):
    out = K.first_digits(t.v_txn, "amount", ["segment"])
    return out.select("segment", "digit", "n", F.round("share", 9).alias("share"), F.round("expected", 9).alias("expected"), F.round("chi2", 6).alias("chi2"))


@query(
    "pb_robust_z",
    """WITH m AS (SELECT segment, median(amount) AS med FROM v_txn GROUP BY segment), s AS (SELECT t.segment, any_value(med) AS med, median(abs(amount - med)) AS mad FROM v_txn t JOIN m ON m.segment = t.segment GROUP BY t.segment)
SELECT transaction_id, t.segment, round(0.6745::DOUBLE * (amount - med) / mad, 6) AS robust_z FROM v_txn t JOIN s ON s.segment = t.segment""",
    TXN,
)
def _(t):
    out = K.robust_z(t.v_txn.select("transaction_id", "segment", "amount"), "segment", "amount")
    return out.select("transaction_id", "segment", F.round("robust_z", 6).alias("robust_z"))


@query(
    "pb_duplicate_refs",
    """SELECT upper(regexp_replace(device_id || '/' || CAST(employee_id AS VARCHAR), '[^0-9A-Za-z]', '', 'g')) AS ref, count(*) AS rows, count(DISTINCT CAST(user_id AS VARCHAR)) AS accounts, count(DISTINCT amount) AS amounts, round(sum(amount), 2) AS total
FROM v_txn GROUP BY 1 HAVING count(*) > 1""",
    TXN,
)
def _(t):
    rows = t.v_txn.withColumn("ref", F.concat_ws("/", "device_id", "employee_id"))
    return K.duplicate_refs(rows, "ref", "user_id", "amount").withColumn("total", F.round("total", 2))


@query(
    "pb_round_dollar_spikes",
    """WITH per AS (SELECT CAST(user_id AS VARCHAR) AS account, strftime(transaction_date, '%Y-%m') AS period, count(*) AS n, count(*) FILTER (WHERE floor(amount)::BIGINT % 10 = 0) AS round_n FROM v_txn GROUP BY ALL),
w AS (SELECT account, sum(n) AS all_n, sum(round_n) AS all_round FROM per GROUP BY account)
SELECT per.account, period, n, round_n, round(round_n / n, 9) AS share, round((all_round - round_n) / (all_n - n), 9) AS usual FROM per JOIN w ON w.account = per.account WHERE all_n > n AND round_n >= 2 AND round_n / n >= 2 * ((all_round - round_n) / (all_n - n))""",
    TXN,
)
def _(t):
    # Whole tens of dollars: the table's amounts have cents of every kind.
    whole = t.v_txn.withColumn("dollars", F.floor("amount"))
    out = K.round_amount_spikes(whole, "user_id", "dollars", F.date_format("transaction_date", "yyyy-MM"), unit=10, min_round=2)
    return out.withColumns({"share": F.round("share", 9), "usual": F.round("usual", 9)})


@query(
    "pb_fuzzy_name_match",
    r"""WITH n AS (SELECT DISTINCT lower(regexp_replace(array_to_string(regexp_extract_all(text, '[^\s]+')[1:2], ' '), '[^\p{L}\p{N}]', '', 'g')) AS s FROM documents), m AS (SELECT s FROM n WHERE length(s) > 3)
SELECT a.s AS name_a, b.s AS name_b, levenshtein(a.s, b.s)::INT AS distance FROM m a JOIN m b ON a.s < b.s AND abs(length(a.s) - length(b.s)) <= 2 WHERE levenshtein(a.s, b.s) <= 2""",
)
def _(t):
    named = t.documents.select(F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"([^\s]+)"), 1), 1, 2), " ").alias("name"))
    return K.fuzzy_name_pairs(named, "name")
