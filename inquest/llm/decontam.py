"""Benchmark decontamination with a distributed positional inverted index.

The index holds a posting (document row, position, term) for every training token whose term some benchmark item has;
tokens of other terms can be in no match. It is partitioned by document, as it is written by the scan that makes it:
no posting is shuffled, and a frequent term is spread over all parts. An item is looked up by its rarest terms: every
window of an item goes by the term of it that has the fewest postings; posting position minus term offset is where the
item would begin. Such alignments are then intersected, term by term at their offsets, with the postings of the
documents found, the second rarest first, and runs of matching offsets as long as a window are exact occurrences.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inquest.llm.common import ascii_lower, land, row_keys, scratch

WINDOW = 10
#: A proximity match: so many consecutive words hold so large a share of a window's distinct terms.
SPAN, SHARE = 20, (4, 5)
#: Runs of characters below U+0080 that are neither digits nor a-z separate words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def match_words(text: Column) -> Column:
    """Lower-case words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


@dataclass(frozen=True)
class Index:
    """Frames in the shared folder.

    ``postings``: row, doc_id, n_words, pos, tid; position 0 of every document is there, with a null tid if no item has
    its term, and a document without words has one row with a null pos. ``items``: item, item_id, n, off, tid.
    ``frequency``: tid, df (postings).
    """

    postings: DataFrame
    items: DataFrame
    frequency: DataFrame
    folder: str


def build_index(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> Index:
    """Index all words of ``docs`` that occur in ``items``.

    Rows with equal ids are documents of their own. Items without words are never found. Repeated item rows are one
    item; items that share an id but not a text count once by id. Other columns are not read, whatever their names.
    """
    folder = scratch(docs.sparkSession, "index")
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), match_words(F.col(f"`{item_text}`")).alias("w")).distinct().filter("size(w) > 0")
    asked = land(asked.withColumn("item", F.monotonically_increasing_id()), f"{folder}/texts")
    spread = asked.select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("off", "term"))
    terms = land(spread.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), f"{folder}/terms")
    held = land(spread.join(terms, "term").drop("term"), f"{folder}/items")

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), match_words(F.col(f"`{text}`")).alias("w"))
    tokens = rows.select("row", "doc_id", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "term"))
    postings = tokens.join(terms, "term", "left").filter("tid IS NOT NULL OR pos IS NULL OR pos = 0")
    postings = land(postings.select("row", "doc_id", "n_words", "pos", "tid"), f"{folder}/postings")
    frequency = land(postings.filter("tid IS NOT NULL").groupBy("tid").agg(F.count("*").alias("df")), f"{folder}/frequency")
    return Index(postings, held, frequency, folder)


def rarest_terms(index: Index, window: int = WINDOW) -> DataFrame:
    """(item, n, off, tid, off2, tid2): the two rarest terms of each window of each item.

    Windows with a term that no document has go. A window of one word has no second term.
    """
    items = index.items.join(index.frequency, "tid", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    first, last = F.greatest(F.lit(0), F.col("off") - window + 1), F.greatest(F.lit(0), F.least("off", F.col("n") - window))
    windows = items.withColumn("start", F.explode(F.sequence(first, last))).groupBy("item", "n", "start")
    windows = windows.agg(F.sort_array(F.collect_list(F.struct("df", "off", "tid"))).alias("r")).filter("r[0].df > 0")
    return windows.select("item", "n", F.expr("r[0].off AS off"), F.expr("r[0].tid AS tid"), F.expr("get(r, 1).off AS off2"), F.expr("get(r, 1).tid AS tid2")).distinct()


def alignments(index: Index, window: int = WINDOW) -> DataFrame:
    """(row, item, n, begin, off): the item would begin at ``begin``, and both rarest terms of a window around ``off`` are where it wants them."""
    rare = land(rarest_terms(index, window), f"{index.folder}/rare")
    # Only the lists of rare terms are read on; most postings are of other terms.
    asked = rare.select("tid").union(rare.filter("tid2 IS NOT NULL").select("tid2")).distinct()
    lists = land(index.postings.filter("tid IS NOT NULL").select("row", "pos", "tid").join(land(asked, f"{index.folder}/asked"), "tid", "left_semi"), f"{index.folder}/lists")
    found = lists.join(rare, "tid").select("row", "item", "n", (F.col("pos") - F.col("off")).alias("begin"), "off", "off2", "tid2")
    second = lists.select(F.col("row").alias("row2"), F.col("pos").alias("pos2"), F.col("tid").alias("t2"))
    both = found.join(second, (F.col("row") == F.col("row2")) & (F.col("begin") + F.col("off2") == F.col("pos2")) & (F.col("tid2") == F.col("t2")), "left_semi")
    return both.unionByName(found.filter("tid2 IS NULL")).select("row", "item", "n", "begin", "off")


def exact_matches(index: Index, window: int = WINDOW) -> DataFrame:
    """(row, item, item_id, begin, end): longest runs of positions that hold consecutive terms of an item.

    A run has at least ``window`` words, or the whole item if that is shorter.
    """
    aligned = land(alignments(index, window), f"{index.folder}/aligned")
    rows = land(aligned.select("row").distinct(), f"{index.folder}/rows")
    near = index.postings.filter("tid IS NOT NULL").select("row", "pos", "tid").join(rows, "row", "left_semi")
    offsets = F.sequence(F.greatest(F.lit(0), F.col("off") - window + 1), F.least(F.col("n") - 1, F.col("off") + window - 1))
    wanted = aligned.select("row", "item", "begin", F.explode(offsets).alias("off")).distinct()
    wanted = wanted.join(index.items.select("item", "item_id", "n", "off", "tid"), ["item", "off"]).withColumn("pos", F.col("begin") + F.col("off"))
    hits = wanted.join(land(near, f"{index.folder}/near"), ["row", "pos", "tid"]).select("row", "item", "item_id", "n", "begin", "off", "pos")
    line = Window.partitionBy("row", "item", "begin").orderBy("off")
    runs = hits.withColumn("run", F.col("off") - F.row_number().over(line))
    runs = runs.groupBy("row", "item", "item_id", "n", "begin", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    runs = runs.filter(F.col("last") - F.col("first") + 1 >= F.least(F.lit(window), F.col("n")))
    return runs.select("row", "item", "item_id", F.col("first").alias("begin"), F.col("last").alias("end"))


def _windows_of(index: Index, window: int) -> DataFrame:
    """(item, start, tids): the distinct terms of each window of each item, rarest first, those that no document has before all."""
    items = index.items.join(index.frequency, "tid", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    first, last = F.greatest(F.lit(0), F.col("off") - window + 1), F.greatest(F.lit(0), F.least("off", F.col("n") - window))
    terms = items.withColumn("start", F.explode(F.sequence(first, last)))
    return terms.groupBy("item", "start").agg(F.sort_array(F.collect_set(F.struct("df", "tid")))["tid"].alias("tids"))


def proximity_matches(index: Index, window: int = WINDOW, span: int = SPAN, share: tuple[int, int] = SHARE) -> DataFrame:
    """(row, item): documents in which ``span`` consecutive words hold at least ``share`` of the distinct terms of a window of the item.

    Order and repeats do not count. Windows of one distinct term have no such match. Of the distinct terms of a window a
    match lacks at most n - need, so it has two of the n - need + 2 rarest: only where two different ones of an item's
    stand within a span are the other terms looked up, position by position.
    """
    top, bottom = share
    size = F.size("tids")
    need = F.ceil(size * top / bottom).cast("int")
    windows = land(_windows_of(index, window).withColumn("need", need).filter("need >= 2").withColumn("win", F.monotonically_increasing_id()), f"{index.folder}/windows")
    rare = land(windows.select("item", F.explode(F.slice("tids", 1, size - F.col("need") + 2)).alias("tid")).distinct(), f"{index.folder}/rare-terms")
    postings = index.postings.filter("tid IS NOT NULL").select("row", "pos", "tid")
    seen = postings.join(rare, "tid")
    line = Window.partitionBy("row", "item").orderBy("pos")
    apart = F.lead("pos").over(line) - F.col("pos")
    beside = seen.withColumns({"apart": apart, "other": F.lead("tid").over(line)}).filter(F.col("apart") < span).filter("other <> tid")
    # Every span that holds both of the two words begins and ends less than a span away.
    zones = beside.select("row", "item", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") + F.col("apart") - span + 1), F.col("pos") + span - 1)).alias("pos")).distinct()
    zones = land(zones, f"{index.folder}/zones")
    near = land(postings.join(land(zones.select("row").distinct(), f"{index.folder}/zone-rows"), "row", "left_semi"), f"{index.folder}/zone-postings")
    spots = near.join(zones, ["row", "pos"])
    terms = windows.select("item", "win", "need", F.explode("tids").alias("tid"))
    spots = spots.join(terms, ["item", "tid"]).select("row", "item", "win", "need", "pos", "tid")
    inside = Window.partitionBy("row", "win").orderBy("pos").rangeBetween(0, span - 1)
    return spots.withColumn("held", F.size(F.collect_set("tid").over(inside))).filter("held >= need").select("row", "item").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, proximity: bool = False, **columns: str) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_words, n_hit (words inside exact matches), item_ids (of those, sorted, as
    strings) and, with ``proximity``, n_near (items with a proximity match, by id; an exact match of two distinct terms and
    more is one). Proximity matches read many times as many postings as exact ones.

    ``row`` is a number that is unique in the result. Null and empty texts have no words and no hits. An empty
    benchmark finds nothing; an empty table gives an empty result. A null item id is written as the empty string.
    """
    index = build_index(docs, items, **columns)
    found = land(exact_matches(index, window), f"{index.folder}/found")
    # Union of the runs of a document: a run adds the words beyond the farthest end of the runs before it.
    before = Window.partitionBy("row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    runs = found.select("row", "begin", "end").distinct().withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(-1)))
    words = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("begin") - 1, "reach"))
    hit = runs.groupBy("row").agg(F.sum(words).alias("n_hit"))
    # Item ids are first made distinct per row, so a list is never longer than the benchmark.
    ids = found.select("row", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id")).distinct()
    ids = ids.groupBy("row").agg(F.sort_array(F.collect_list("id")).alias("item_ids"))
    heads = index.postings.filter("pos IS NULL OR pos = 0").select("row", "doc_id", "n_words")
    out = heads.join(hit.join(ids, "row"), "row", "left").select(
        "row", "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )
    if not proximity:
        return out
    names = index.items.select("item", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id")).distinct()
    near = proximity_matches(index, window).join(names, "item").select("row", "id").distinct().groupBy("row").agg(F.count("*").alias("n_near"))
    near = land(near, f"{index.folder}/near-items")
    return out.join(near, "row", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long"))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with no match, with their own columns.

    Each row is judged by its own text: rows that share an id, or have none, stay or go apart from each other; rows that are
    equal in id and text stay or go together.
    """
    names = ["".join(docs.columns) + x for x in ("_a", "_b")]
    first, second = row_keys(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    keyed = docs.select(F.struct(first.alias("a"), second.alias("b")).alias("key"), F.col(f"`{text}`").alias("text"))
    window, columns = options.pop("window", WINDOW), options
    index = build_index(keyed, items, doc_id="key", text="text", **columns)
    heads = index.postings.filter("pos = 0").select("row", F.col("doc_id.a").alias("found_a"), F.col("doc_id.b").alias("found_b"))
    found = heads.join(exact_matches(index, window).select("row").distinct(), "row", "left_semi").select("found_a", "found_b").distinct()
    found = land(found, scratch(docs.sparkSession, "contaminated"))
    rows = docs.withColumns({names[0]: first, names[1]: second})
    same = (rows[names[0]] == found["found_a"]) & (rows[names[1]] == found["found_b"])
    return rows.join(found, same, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
