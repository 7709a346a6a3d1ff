"""Mixing sources to target weights: blocks of words, multinomial draws per shard, permuted block indices.

The words of a source, document after document, are cut into blocks of fixed length. An output shard draws how many
blocks it takes from each source; the j-th block taken from a source over all shards is the block that a pseudorandom
permutation of the source's block indices names, a new permutation for each time round. Documents meet their blocks by
(source, block) in an equi-join, so a source of any size is spread over its blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inquest.llm.common import land, row_keys, scratch, words
from inquest.llm.permute import permuted

BLOCK_WORDS = 128
SHARD_BLOCKS = 4096
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Steps of the ladder on which a draw finds its source.
LADDER = 4096
DRAW_DIGITS = 13
#: Rests of a document's share are counted in so many parts of one.
REST_BITS = 30
RESTS = 1 << REST_BITS


@dataclass(frozen=True)
class Mix:
    """The parts of a mix; all frames are read from the shared folder.

    ``docs``: the documents with ``m_row``, a number of their own, and ``m_size``, their words.
    ``places``: m_row, m_rank (of the source), m_size, m_start (words of the source before it).
    ``sources``: rank, source, size, weight, target, blocks, quota (blocks taken).
    ``counts``: shard, rank, first, taken: the shard takes the source's blocks number first to first + taken - 1.
    ``slots``: shard, rank, slot, block: which block each of these is.
    ``pieces``: m_row, rank, block, start, n: words start to start + n - 1 of a document are in that block.
    """

    docs: DataFrame
    places: DataFrame
    sources: DataFrame
    counts: DataFrame
    slots: DataFrame
    pieces: DataFrame

    def taken(self) -> DataFrame:
        """m_row and the words that the mix takes from the document, repeats counted; documents without words are not here."""
        uses = self.slots.groupBy("rank", "block").agg(F.count("*").alias("uses"))
        return self.pieces.join(uses, ["rank", "block"]).groupBy("m_row").agg(F.sum(F.col("n") * F.col("uses")).alias("taken"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, size) to (rank, source, size, weight, target).

    Sources by code point, null last, get the weights in turn. ``target`` is weight * level, at most ``most`` * size, with the
    level at which the targets add up to ``share`` of all sizes: sources whose limit is lowest for their weight fill
    first, and what they leave goes to the others. One row per source: the windows below run over that list alone.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1))
    ranked = ranked.withColumn("most", (F.col("size") * most).cast("double"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    filled, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(filled), F.lit(0.0))
    ranked = ranked.withColumn("level", left / F.sum("weight").over(rest))
    # The first source that its limit does not stop sets the level; nothing after it is stopped either.
    free = F.min(F.when(F.col("level") * F.col("weight") < F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("rank"), F.col("level").alias("v")))).over(everything)["v"]
    target = F.coalesce(F.least(free * F.col("weight"), F.col("most")), F.col("most"))
    return ranked.select("rank", "source", "size", "weight", target.alias("target"))


def _blocks(size: Column, block: int) -> Column:
    return ((size + (block - 1) - (size + (block - 1)) % block) / block).cast("long")


def draw(slot: Column, total: Column, seed: int) -> Column:
    """A number below ``total`` for a slot; md5 gives the same one in every engine."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), slot.cast("string"))), 1, DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("long") % total


def mix_documents(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    order: tuple[str, ...] = ("doc_id",),
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
    seed: int = 7,
) -> Mix:
    """Draw a mix of ``docs``; see ``Mix`` for what comes out.

    The size of a document is its number of words, 0 for null. Documents without words keep their row and take nothing.
    A null source is a source of its own, the last one. Equal rows are documents of their own. An empty table gives an
    empty mix. Columns of ``docs`` stay; their names must not begin with ``m_``. Draws depend on the seed, the slots and
    the sizes alone, so reruns agree.

    Totals are exact: draws of a source beyond its quota are void and the last shard takes what is missing, a few
    times the square root of the number of blocks. No block is taken more than ``most`` times.
    """
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "mix")
    rank_keys = [F.asc_nulls_last(source), *(F.asc_nulls_last(c) for c in order)]
    sized = docs.withColumn("m_size", F.size(words(F.col(f"`{text}`"))).cast("long")) if "m_size" not in docs.columns else docs
    dealt = sized.repartitionByRange(*rank_keys).sortWithinPartitions(*rank_keys)
    dealt = dealt.withColumn("m_part", F.spark_partition_id()).withColumn("m_row", F.monotonically_increasing_id())
    dealt = land(dealt, f"{folder}/docs")

    parts = dealt.groupBy(F.col(source).alias("source"), "m_part").agg(F.sum("m_size").alias("n"))
    sizes = parts.groupBy("source").agg(F.sum("n").alias("size"))
    blocks = _blocks(F.col("size"), block_words)
    targets = source_targets(sizes, weights, share, most).withColumn("blocks", blocks)
    quota = F.least(F.coalesce(F.round(F.try_divide(F.col("target") * F.col("blocks"), F.col("size"))), F.lit(0)).cast("long"), F.col("blocks") * most)
    sources = land(targets.withColumn("quota", quota), f"{folder}/sources")

    # Words before a document in its source: those of earlier parts, then those of earlier rows of its part.
    earlier = Window.partitionBy("source").orderBy("m_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(
        sources.select(F.col("source").alias("s"), "rank"), F.col("source").eqNullSafe(F.col("s"))
    )
    offsets = offsets.select(F.col("source").alias("o_source"), F.col("m_part").alias("o_part"), "before", F.col("rank").alias("m_rank"))
    within = Window.partitionBy("m_part", source).orderBy("m_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.select("m_row", "m_part", source, "m_size").withColumn("m_start", F.coalesce(F.sum("m_size").over(within), F.lit(0)))
    placed = placed.join(offsets, (F.col("m_part") == F.col("o_part")) & F.col(source).eqNullSafe(F.col("o_source")))
    placed = land(placed.select("m_row", "m_rank", "m_size", (F.col("m_start") + F.col("before")).alias("m_start")), f"{folder}/places")

    first, last = F.col("m_start"), F.col("m_start") + F.col("m_size") - 1
    spans = placed.filter("m_size > 0").select(
        "m_row", F.col("m_rank").alias("rank"), first.alias("a"), last.alias("b"),
        F.explode(F.sequence(((first - first % block_words) / block_words).cast("long"), ((last - last % block_words) / block_words).cast("long"))).alias("block"),
    )
    begin = F.greatest("a", F.col("block") * block_words)
    pieces = spans.select("m_row", "rank", "block", (begin - F.col("a")).alias("start"), (F.least("b", (F.col("block") + 1) * block_words - 1) - begin + 1).alias("n"))

    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    counts = land(_shard_counts(sources, total, shard_blocks, seed), f"{folder}/counts")
    # A row of counts stands for thousands of slots, so the rows are spread before they are taken apart.
    tasks = max(spark.sparkContext.defaultParallelism, total // 200_000 + 1)
    slots = counts.repartition(tasks, "shard", "rank").join(sources.select("rank", "blocks"), "rank").withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("taken") - 1)))
    time = ((F.col("slot") - F.col("slot") % F.col("blocks")) / F.col("blocks")).cast("long")
    slots = slots.select("shard", "rank", "slot", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.lit(seed) + F.col("rank") * 1009 + time * 104729).alias("block"))
    return Mix(dealt.drop("m_part"), placed, sources, counts, slots, pieces)


def _shard_counts(sources: DataFrame, total: int, shard_blocks: int, seed: int) -> DataFrame:
    """(shard, rank, first, taken) with taken > 0: multinomial draws of the shards, made exact in total."""
    spark = sources.sparkSession
    shards = max(1, -(-total // shard_blocks))
    width = total // LADDER + 1
    ends = sources.filter("quota > 0").withColumn("high", F.sum("quota").over(Window.orderBy("rank")))
    steps = ends.select("rank", (F.col("high") - F.col("quota")).alias("low"), "high")
    rung = lambda x: ((x - x % width) / width).cast("long")
    steps = steps.withColumn("rung", F.explode(F.sequence(rung(F.col("low")), rung(F.col("high") - 1))))
    draws = spark.range(total).select(((F.col("id") - F.col("id") % shard_blocks) / shard_blocks).cast("long").alias("shard"), draw(F.col("id"), F.lit(max(total, 1)), seed).alias("ticket"))
    drawn = draws.withColumn("rung", rung(F.col("ticket"))).join(steps, "rung").filter("ticket >= low AND ticket < high")
    drawn = drawn.groupBy("shard", "rank").agg(F.count("*").alias("k"))
    quotas = sources.filter("quota > 0").select("rank", "quota")
    last = quotas.select(F.lit(shards - 1).cast("long").alias("shard"), "rank", F.lit(0).cast("long").alias("k"))
    drawn = drawn.unionByName(last).groupBy("shard", "rank").agg(F.sum("k").alias("k")).join(quotas, "rank")
    so_far = Window.partitionBy("rank").orderBy("shard")
    low = F.least("quota", F.coalesce(F.sum("k").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    high = F.when(F.col("shard") == shards - 1, F.col("quota")).otherwise(F.least("quota", F.sum("k").over(so_far)))
    return drawn.select("shard", "rank", low.alias("first"), (high - low).alias("taken")).filter("taken > 0")


def mix_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """doc_id, size, source_size, target (its source's) and taken of every document."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("m_size"))
    mix = mix_documents(slim, source="source", **options)
    about = mix.sources.select(F.col("rank").alias("m_rank"), F.col("size").alias("source_size"), "target")
    rows = mix.places.join(about, "m_rank").join(mix.docs.select("m_row", "doc_id"), "m_row").join(mix.taken(), "m_row", "left")
    return rows.select("doc_id", F.col("m_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, **options) -> DataFrame:
    """The documents that the mix takes, each as often as its words are taken, in whole documents.

    The documents of a source stand in line by size. Each comes as often as its share says, rounded down, and once
    more where the running total of the rests passes a whole number. As sizes rise along the line, the words of a source's
    copies differ from the words taken by no more than the size of its longest document (rows that are equal in id and text count as one), and
    no document comes more often than its words may be taken. Rows that are equal in id and text come equally often.
    Columns are those of ``docs``. The mix is drawn without the texts, which meet the counts in one join.
    """
    first, second = row_keys(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    slim = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.size(words(F.col(f"`{text}`"))).cast("long").alias("m_size"), first.alias("m_a"), second.alias("m_b")
    )
    mix = mix_documents(slim, source="source", order=("doc_id", "m_a", "m_b"), seed=seed, **options)
    folder = scratch(docs.sparkSession, "copies")
    taken = mix.docs.join(mix.taken(), "m_row").groupBy("m_a", "m_b").agg(
        F.max(F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))).alias("m_line"), F.sum("m_size").alias("m_size"), F.sum("taken").alias("taken")
    )
    order = ["m_line", "m_size", "m_a", "m_b"]
    dealt = taken.repartitionByRange(*order).sortWithinPartitions(*order)
    rest = F.floor((F.col("taken") % F.col("m_size")) * F.lit(RESTS) / F.col("m_size")).cast("long")
    dealt = land(dealt.withColumns({"m_part": F.spark_partition_id(), "m_place": F.monotonically_increasing_id(), "m_rest": rest}), f"{folder}/line")
    # Rests before a document: those of earlier parts of its line, then those of earlier rows of its part.
    parts = dealt.groupBy("m_line", "m_part").agg(F.sum("m_rest").alias("n"))
    earlier = Window.partitionBy("m_line").orderBy("m_part").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.pmod(F.xxhash64(F.lit(seed), "m_line"), F.lit(RESTS))
    parts = parts.select("m_line", "m_part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + begin).alias("m_before"))
    within = Window.partitionBy("m_part", "m_line").orderBy("m_place")
    total = dealt.withColumn("m_total", F.sum("m_rest").over(within)).join(parts, ["m_line", "m_part"]).withColumn("m_total", F.col("m_total") + F.col("m_before"))
    passed = F.shiftright("m_total", REST_BITS) - F.shiftright(F.col("m_total") - F.col("m_rest"), REST_BITS)
    copies = total.select("m_a", "m_b", (F.floor(F.col("taken") / F.col("m_size")) + passed).cast("int").alias("m_copies")).filter("m_copies > 0")
    copies = land(copies, f"{folder}/copies")
    rows = docs.withColumns({"m_a": first, "m_b": second}).join(copies, ["m_a", "m_b"])
    return rows.withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.col("m_copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))
