"""Quality rules: a threshold table compiled into one projection.

Every measure is a column expression over the text of its own row, so the scan is
the only stage: nothing is shuffled, no row meets another one, and no user function
runs. Measures that others need are computed once and bound with ``let``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.llm.common import let, words

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages that are kept.
STOP_WORDS = {
    "en": "the of and to in is that it for was be as are with".split(),
    "de": "der die und den von zu das mit sich ist im dem nicht ein eine auf für".split(),
    "fr": "le la de et les des en un du une que est pour dans qui sur".split(),
    "es": "el la de que y en un los se del las por con una su para".split(),
}
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= measure <= high``; a missing bound always holds."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The base rules of the contract come first, then the ratios.
BASE_RULES = (Rule("n_words", low=50), Rule("repeat_percent", high=50))
RATIO_RULES = (
    Rule("word_length", low=1.5, high=20),
    Rule("symbols_per_word", high=0.3),
    Rule("stop_share", low=0.02),
    Rule("dup_line_share", high=0.5),
    Rule("letter_share", low=0.6),
)


def repeat_words(w: Column) -> Column:
    """Words covered by windows of three words that occur twice or more in the array.

    Windows are compared by a 64-bit hash: sorted with their places, neighbours that are
    equal are the repeated ones, so the work is n log n for a text of any length.
    """
    n = F.size(w)
    hashes = F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))
    )

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def repeated(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = let(
            ordered,
            lambda z: F.sort_array(
                F.transform(
                    F.filter(
                        z,
                        lambda e, k: F.coalesce(F.get(z, k - 1)["h"] == e["h"], F.lit(False))
                        | F.coalesce(F.get(z, k + 1)["h"] == e["h"], F.lit(False)),
                    ),
                    lambda e: e["i"],
                )
            ),
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(places, covered))

    return F.when(n < WINDOW + 1, 0).otherwise(let(hashes, repeated)).cast("long")


def measures(text: Column) -> Column:
    """One struct of all counts of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    stops = sorted({x for group in STOP_WORDS.values() for x in group})

    def of_words(w: Column) -> list[Column]:
        return [
            F.size(w).cast("long").alias("n_words"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(stops))).cast("long").alias("n_stops"),
            F.size(F.filter(w, lambda x: x.rlike("\\p{L}"))).cast("long").alias("n_letter_words"),
        ]

    def of_lines(x: Column) -> list[Column]:
        return [
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ]

    return F.struct(
        let(words(text), lambda w: F.struct(*of_words(w))).alias("w"),
        let(lines, lambda x: F.struct(*of_lines(x))).alias("l"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )


def _ratios(m: Column) -> dict[str, Column]:
    n, lines = F.greatest(m["w"]["n_words"], F.lit(1)), F.greatest(m["l"]["n_lines"], F.lit(1))
    return {
        "n_words": m["w"]["n_words"],
        "repeat_percent": 100 * m["w"]["n_repeat_words"] / n,
        "word_length": m["word_chars"] / n,
        "symbols_per_word": m["n_symbols"] / n,
        "stop_share": m["w"]["n_stops"] / n,
        "letter_share": m["w"]["n_letter_words"] / n,
        "dup_line_share": m["l"]["n_dup_lines"] / lines,
    }


def broken_rules(m: Column, rules: tuple[Rule, ...], listed: Column | None = None) -> Column:
    """Names of the rules that a document breaks, in the order of the table; the stop-word rule holds where ``listed`` is not true."""
    values, marks = _ratios(m), []
    for rule in rules:
        value = values[rule.measure]
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (value < F.lit(rule.low))
        if rule.high is not None:
            bad = bad | (value > F.lit(rule.high))
        if rule.measure == "stop_share" and listed is not None:
            bad = bad & listed
        marks.append(F.when(bad, F.lit(rule.measure)))
    return F.array_compact(F.array(*marks))


def quality_report(
    docs: DataFrame,
    text: str = "text",
    base: tuple[Rule, ...] = BASE_RULES,
    ratios: tuple[Rule, ...] = RATIO_RULES,
    prefix: str = "q_",
    lang: str = "lang",
) -> DataFrame:
    """All columns of ``docs`` and, named with ``prefix``, the counts, ``reasons``, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged one by one. The stop-word rule
    judges rows whose language, in the column ``lang``, has a list, and rows without a language or without that column.
    An empty table gives an empty result. Columns of ``docs`` stay as they are; choose another ``prefix``
    if one of them has a name of the report (ValueError).
    """
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_stops n_letter_words reasons base_failed kept".split()
    clash = {prefix + x for x in names} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist; choose another prefix")

    listed = F.col(f"`{lang}`").isNull() | F.col(f"`{lang}`").isin(list(STOP_WORDS)) if lang in docs.columns else F.lit(True)

    def report(m: Column) -> Column:
        failed = F.size(broken_rules(m, base)) > 0
        reasons = broken_rules(m, base + ratios, listed)
        flat = {"n_words": m["w"]["n_words"], "word_chars": m["word_chars"], "n_symbols": m["n_symbols"], "n_dup_lines": m["l"]["n_dup_lines"], "n_repeat_words": m["w"]["n_repeat_words"], "n_lines": m["l"]["n_lines"], "n_stops": m["w"]["n_stops"], "n_letter_words": m["w"]["n_letter_words"]}
        return F.struct(*(v.alias(k) for k, v in flat.items()), reasons.alias("reasons"), failed.alias("base_failed"), (F.size(reasons) == 0).alias("kept"))

    # The report is one array element, exploded: an expression that no later projection can copy.
    held = "".join(docs.columns) + "_report"
    rows = docs.select(*(docs[f"`{c}`"] for c in docs.columns), F.explode(F.array(let(measures(F.col(f"`{text}`")), report))).alias(held))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(f"`{held}`.{x}").alias(prefix + x) for x in names))


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    prefix = "".join(docs.columns) + "_"
    return quality_report(docs, text, prefix=prefix).filter(F.col(f"`{prefix}kept`")).select(*(F.col(f"`{c}`") for c in docs.columns))
