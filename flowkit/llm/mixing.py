"""Mixing sources to target weights.

The words of each source are laid end to end in a pseudorandom order of its documents and packed into blocks of a fixed
length. A source's target gives the number of blocks that the mix takes from it. Every output shard draws how many blocks
it takes of each source: a multinomial draw by the targets, from hashes of a seed and the place in the output. What a
source drew above its target over all shards is taken back evenly along them and given to the sources below theirs, so
each source keeps its target and about the square root of the slots changes hands. Prefix sums of the counts number the
slots of a source; slot j maps through a pseudorandom permutation of the source's block indices, a new one for every
pass, and blocks join by index.

Everything is DataFrame expressions. Prefix sums run in two levels, so a source of any size is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowkit.llm.common import WORD, checkpoint, text_of
from flowkit.operators.components import before_in_range

#: Words of a block, blocks of an output shard, passes over a source at most, rounds of the permutations.
BLOCK_WORDS, SHARD_BLOCKS, MOST_PASSES, ROUNDS = 64, 1024, 3, 6
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
SEED = 7
#: Slots that one row makes, numbers in a cell of the draws, shards whose counts are summed together.
_SLOTS_PER_ROW, _CELL, _SHARDS_PER_PART = 1 << 14, 1 << 10, 1 << 12


def permuted(index: Column, n: Column, seed: list[Column], rounds: int = ROUNDS) -> Column:
    """index mapped by a pseudorandom permutation of 0 .. n-1 (swap-or-not, Hoang, Morris and Rogaway 2012)."""

    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(r, *seed) - x, n)
        return F.when(F.xxhash64(F.lit("swap"), r, *seed, F.greatest(x, other)) % 2 == 0, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), turn)


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """From (source, source_size): s (rank from 0, null last), target.

    The sources share the sum of all sizes by weight; a target stops at most times its source's size, and the excess goes
    to the others by weight until none is above. In the order of size by weight, the level that the targets of the others
    reach rises while sources stop below it and falls afterwards, so it is the maximum. One row per source.
    """
    ranked = sizes.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), F.col("s") % len(weights) + 1)
    ranked = ranked.withColumns({"w": weight, "cap": most * F.col("source_size")})
    everything = Window.partitionBy()
    lower = Window.orderBy(F.col("cap") / F.col("w"), "s").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(lower), F.lit(0))
    rest_w = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(lower), F.lit(0.0))
    level = ranked.withColumn("level", rest / rest_w)
    level = level.withColumn("level", F.max("level").over(everything))
    return level.select("source", "source_size", "s", F.least(F.col("cap").cast("double"), F.col("w") * F.col("level")).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, h (hash of id and text) and size (words) of every row."""
    return docs.select(F.col("doc_id"), F.col("source"), F.xxhash64("doc_id", "text").alias("h"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))


def laid_out(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows with their source's s, source_size, target and with start, their first word's place in the source."""
    n = rows.count()
    rows = rows.withColumn("bucket", F.pmod(F.col("h"), F.lit(max(1, math.isqrt(n)))).cast("int"))
    t = targets.withColumnRenamed("source", "__source")
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    totals = rows.groupBy("s", "bucket").agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("s", "bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("s", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(totals, ["s", "bucket"]).withColumn("start", F.col("__base") + F.col("__before")).drop("bucket", "__base", "__before")


def slot_plan(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """s, blocks (of the source), slots (that the mix takes), low (slots of the sources before) and all (of all sources)."""
    words = F.col("source_size")
    blocks = F.ceil(words / block_words)
    passes = F.floor(F.col("target") / words)
    slots = passes * blocks + F.round((F.col("target") - passes * words) * blocks / words).cast("long")
    plan = targets.where(words > 0).select("s", blocks.alias("blocks"), slots.alias("slots"))
    plan = plan.withColumn("low", F.sum("slots").over(Window.orderBy("s")) - F.col("slots"))
    return plan.withColumn("all", F.sum("slots").over(Window.partitionBy()))


def draw_counts(plan: DataFrame, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """shard, s, of (blocks of the source), slots and drawn: a multinomial draw of shard_blocks slots for every shard.

    Each place of the output draws a number below all slots; the source whose slots hold it is found in the number's cell.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(_SLOTS_PER_ROW).cast("long"))
    parts = plan.where("slots > 0").select("*", F.explode(starts).alias("from"))
    # a number keeps the tasks apart: each row becomes thousands
    parts = parts.repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s", "from")
    first = F.col("low") + F.col("from")
    last = F.col("low") + F.least(F.col("from") + _SLOTS_PER_ROW, F.col("slots")) - 1
    places = parts.select("all", F.explode(F.sequence(first, last)).alias("place"))
    number = F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "place"), F.col("all"))
    places = places.select(F.floor(F.col("place") / shard_blocks).alias("shard"), number.alias("number")).withColumn("cell", F.floor(F.col("number") / _CELL))
    cells = parts.select(F.struct("low", "s", F.col("blocks").alias("of"), "slots").alias("source"), F.explode(F.sequence(F.floor(first / _CELL), F.floor(last / _CELL))).alias("cell"))
    cells = cells.groupBy("cell").agg(F.collect_set("source").alias("sources"))  # at most one for each of its numbers
    source = F.array_max(F.filter("sources", lambda x: x["low"] <= F.col("number")))
    drawn = places.join(cells.hint("merge"), "cell").select("shard", source.alias("source")).select("shard", "source.s", "source.of", "source.slots")
    return drawn.groupBy("shard", "s", "of", "slots").agg(F.count(F.lit(1)).alias("drawn"))


def _numbered(counts: DataFrame, n: str) -> DataFrame:
    """counts with start, the sum of n over the same source's earlier shards, and __total, that over all of them."""
    counts = counts.withColumn("__part", F.floor(F.col("shard") / _SHARDS_PER_PART))
    inside = Window.partitionBy("s", "__part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__in", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    counts = counts.join(before_in_range(counts, F.col(n), "s").hint("merge"), ["s", "__part"])  # it grows: never broadcast
    return counts.withColumn("start", F.col("__before") + F.col("__in")).drop("__part", "__in", "__before", "__size")


def shard_counts(plan: DataFrame, drawn: DataFrame, seed: int = SEED) -> DataFrame:
    """shard, s, of and taken, the blocks that each shard takes from each source: drawn, with the totals set to the plan's.

    A source above its slots gives back evenly along the shards; the places given back are dealt to the sources below.
    """
    totals = plan.join(drawn.groupBy("s").agg(F.sum("drawn").alias("got")), "s", "left").withColumn("over", F.coalesce("got", F.lit(0)) - F.col("slots"))
    before = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    above, below = F.greatest("over", F.lit(0)), F.greatest(-F.col("over"), F.lit(0))
    totals = totals.withColumns({"give_low": F.coalesce(F.sum(above).over(before), F.lit(0)), "take_low": F.coalesce(F.sum(below).over(before), F.lit(0)), "moved": F.sum(above).over(Window.partitionBy())})
    rows = _numbered(drawn, "drawn")
    over, got = F.greatest(F.col("__total") - F.col("slots"), F.lit(0)).cast("decimal(38,0)"), F.col("__total")
    upto = lambda x: F.floor(x * over / got).cast("long")
    rows = rows.withColumns({"back_from": upto(F.col("start")), "back": upto(F.col("start") + F.col("drawn")) - upto(F.col("start"))})
    rows = rows.select("shard", "s", "of", (F.col("drawn") - F.col("back")).alias("taken"), "back_from", "back")
    back = rows.where("back > 0").select("shard", "s", F.explode(F.sequence("back_from", F.col("back_from") + F.col("back") - 1)).alias("k"))
    back = back.join(totals.select("s", "give_low", "moved"), "s").select("shard", permuted(F.col("give_low") + F.col("k"), F.col("moved"), [F.lit(seed + 2)]).alias("r"))
    takers = totals.where("over < 0").select("s", F.col("blocks").alias("of"), F.explode(F.sequence("take_low", F.col("take_low") - F.col("over") - 1)).alias("r"))
    moved = back.join(takers.hint("merge"), "r").select("shard", "s", "of", F.lit(1).cast("long").alias("taken"))
    both = rows.select("shard", "s", "of", "taken").unionByName(moved)
    return both.groupBy("shard", "s", "of").agg(F.sum("taken").alias("taken")).where("taken > 0")


def draw_slots(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """One row per slot of the mix: shard, s and block. A block is taken once a pass at most."""
    plan = checkpoint(slot_plan(targets, block_words))
    drawn = checkpoint(draw_counts(plan, shard_blocks, seed))
    counts = checkpoint(shard_counts(plan, drawn, seed))
    rows = _numbered(counts, "taken").select("shard", "s", "of", "start", "taken")
    # a number keeps the tasks apart: each row becomes up to shard_blocks
    rows = rows.repartition(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "s")
    rows = rows.select("shard", "s", "of", F.explode(F.sequence("start", F.col("start") + F.col("taken") - 1)).alias("j"))
    rows = rows.withColumn("pass", F.floor(F.col("j") / F.col("of")))
    place = F.col("j") - F.col("pass") * F.col("of")
    return rows.select("shard", "s", permuted(place, F.col("of"), [F.lit(seed + 1), F.col("s"), F.col("pass")]).alias("block"))


def taken_pieces(rows: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """rows (from laid_out) cut at block bounds, with times, how often the mix takes the piece, and its first shard.

    from and upto are word places in the document. A row without words has one piece that nothing takes.
    """
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    nowhere = F.array(-1 - F.pmod("h", F.lit(1 << 20)))  # no slot has it; rows without words stay spread over the tasks
    pieces = rows.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(nowhere)))
    pieces = pieces.withColumns({"from": F.greatest(F.col("block") * block_words, F.col("start")) - F.col("start"), "upto": F.least((F.col("block") + 1) * block_words, F.col("start") + F.col("size")) - F.col("start")})
    taken = slots.groupBy("s", "block").agg(F.count(F.lit(1)).alias("times"), F.min("shard").alias("shard"))
    return pieces.join(taken.hint("merge"), ["s", "block"], "left")  # it grows with the input: never broadcast


def plan_mix(docs: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    rows = checkpoint(sized(docs))
    targets = checkpoint(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights))
    return taken_pieces(laid_out(rows, targets), draw_slots(targets, block_words, seed=seed), block_words)


def mix_sizes(docs: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_shard for every row.

    Null texts count as empty; they take nothing. A null source is a source of its own, the last. Repeated rows are rows
    each. With no words at all every target is 0. Reruns give the same rows.
    """
    pieces = plan_mix(docs, weights, block_words, seed)
    taken = F.coalesce(F.sum(F.when(F.col("size") > 0, (F.col("upto") - F.col("from")) * F.col("times"))), F.lit(0)).cast("long")
    # rows without words can share a start with others, and with each other: they are told apart by size and counted
    found = pieces.groupBy("doc_id", "s", "start", "h", "size", "source_size", "target").agg(taken.alias("taken"), F.min("shard").alias("first_shard"), F.count(F.lit(1)).alias("__rows"))
    again = F.when(F.col("size") == 0, F.col("__rows")).otherwise(1)
    found = found.withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), again.cast("long"))))
    return found.select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def mix_documents(docs: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix as documents: one row per document and pass in which some of its words are taken, with docs' columns.

    A pass that takes all of a document keeps its text; else its taken words are joined by single spaces. n_chars, if there,
    follows the text. Documents of which no block is taken, or that have no words, are left out.
    """
    pieces = plan_mix(docs, weights, block_words, seed).where("times > 0")
    part = F.struct("from", "upto", "times")
    found = pieces.groupBy("doc_id", "h", "s", "start", "size").agg(F.array_sort(F.collect_list(part)).alias("__parts"))
    found = found.withColumn("__pass", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max("__parts.times"))))
    found = found.withColumn("__parts", F.filter("__parts", lambda p: p["times"] >= F.col("__pass")))
    found = found.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("size").alias("__size"), "__parts")
    rows = docs.withColumn("__hash", F.xxhash64("doc_id", "text")).dropDuplicates(["doc_id", "__hash"])
    rows = rows.join(found, (F.col("__hash") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    words = F.regexp_extract_all(text_of(), F.lit(WORD), 0)
    some = F.array_join(F.flatten(F.transform("__parts", lambda p: F.slice(F.col("__words"), (p["from"] + 1).cast("int"), (p["upto"] - p["from"]).cast("int")))), " ")
    n = F.aggregate("__parts", F.lit(0).cast("long"), lambda a, p: a + p["upto"] - p["from"])
    rows = rows.withColumn("__words", F.when(n < F.col("__size"), words))
    rows = rows.withColumn("text", F.when(F.col("__words").isNull(), F.col("text")).otherwise(some))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
