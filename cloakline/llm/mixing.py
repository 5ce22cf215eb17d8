"""Mixing of sources to target weights by a low-discrepancy schedule.

Slot i of the schedule takes the source into whose share of the unit interval
the golden-ratio point frac((i + 1/2) * phi) falls. A source's documents stand
in a keyed random order and are cut into blocks of equal word counts; the r-th
slot of a source takes its block r modulo the number of its blocks. Only
DataFrame functions are used.

Nothing ranks a whole source in one task. Slots are ranked within chunks of
slots, documents within slices of the random order, about the square root of
the count each, and the sums of earlier chunks or slices are added.

Defined results. Null text: size 0; null source: a source of its own, last in
order. Documents without words take part in no block and have taken 0. An empty
table gives no rows. Repeated rows are documents of their own. Only doc_id,
source and text are read, so other columns can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakline.llm.common import WORD, column, result_names, written

PHI = (math.sqrt(5) - 1) / 2


def sized(docs: DataFrame, seed: int, *carried: str) -> DataFrame:
    """(doc_id, source, size, u, and the carried columns as _c0, _c1 and so on): words of the text and a keyed hash of the row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", F.crc32(text)).alias("u"), *[column(c).alias(f"_c{i}") for i, c in enumerate(carried)])


def targets(slim: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0, least: float = 0.0) -> DataFrame:
    """One row per source: (source, sid, n_docs, source_size, weight, target).

    Sources in code point order, null last, get the weights in turn. They share
    `share` times all sizes by weight; a target stays between `least` and
    `most` times its source's size, and what the upper bound cuts off is shared
    again: target = least * size + min(level * weight, (most - least) * size)
    with the one level that uses all of the total up. The table has a row per
    source, so its windows are over few rows.
    """
    per = slim.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    per = per.withColumn("sid", (F.row_number().over(order) - 1).cast("int"))
    per = per.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights)))
    per = per.withColumn("cap", (most - least) * F.col("source_size"))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    per = per.withColumn("total", (share - least) * F.sum("source_size").over(everything))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    per = per.withColumn("open", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    per = per.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    # the first source, by cap for its weight, that the level of its rest doesn't fill
    per = per.withColumn("found", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("full", "level"))).over(everything)["level"])
    target = least * F.col("source_size") + F.least(F.coalesce(F.col("found") * F.col("weight"), F.col("cap")), F.col("cap"))
    return per.select("source", "sid", "n_docs", "source_size", "weight", target.cast("double").alias("target"))


def schedule(spark, goals: DataFrame, block_words: int, cells: int = 1024) -> DataFrame:
    """(slot, sid, pass, block): which block of which source each slot takes."""
    total = goals.agg(F.sum("target").alias("t")).first()["t"] or 0.0
    n = math.ceil(total / block_words)
    chunk = 1 << max(10, (max(n, 1).bit_length() + 1) // 2)
    # point of slot i, exact to 1e-10 for any i below 2**40: the index is split so that products stay small
    step = (PHI * (1 << 20)) % 1.0
    high, low = F.floor(F.col("slot") / (1 << 20)), F.col("slot") % (1 << 20)
    turn = lambda x: x - F.floor(x)
    point = turn(turn(high * F.lit(step)) + low * F.lit(PHI) + F.lit(PHI / 2))
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("x", point)
    slots = slots.withColumn("cell", F.floor(F.col("x") * cells).cast("int"))

    # shares of the unit interval, cut by the cells of a grid: a slot meets the few sources of its cell
    run = Window.orderBy("sid")
    ends = goals.where("target > 0").withColumn("hi", F.sum("target").over(run) / F.lit(total or 1.0))
    ends = ends.withColumn("lo", F.coalesce(F.lag("hi").over(run), F.lit(0.0)))
    ends = ends.withColumn("hi", F.when(F.lead("hi").over(run).isNull(), F.lit(2.0)).otherwise(F.col("hi")))
    last = F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)).cast("int")
    grid = ends.select("sid", "source_size", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells).cast("int"), last)).alias("cell"))
    grid = written(grid, "grid")
    taken = slots.join(grid, "cell").where("x >= lo and x < hi")
    taken = taken.select("slot", "sid", "source_size", F.floor(F.col("slot") / chunk).alias("chunk"))

    counts = taken.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.select("sid", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "counts")
    rank = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    taken = taken.withColumn("rank", rank).join(counts, ["sid", "chunk"])
    rank, blocks = F.col("before") + F.col("rank"), F.ceil(F.col("source_size") / block_words)
    return taken.select("slot", "sid", F.floor(rank / blocks).cast("int").alias("pass"), (rank % blocks).cast("long").alias("block"))


def positions(slim: DataFrame, goals: DataFrame, *carried: str) -> DataFrame:
    """slim with sid, target, source_size and the words [c0, c1) of its source that a document holds."""
    known = goals.select(F.col("source").alias("of"), "sid", "n_docs", "source_size", "target")
    placed = slim.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    part = F.shiftrightunsigned("u", 11).cast("double") / F.lit(float(1 << 53))
    placed = placed.withColumn("slice", F.floor(part * F.ceil(F.sqrt("n_docs"))).cast("int"))
    sums = placed.groupBy("sid", "slice").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("sid").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(sums.select("sid", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "slices")
    within = Window.partitionBy("sid", "slice").orderBy(F.shiftrightunsigned("u", 11), "u", "doc_id", "size", *carried).rowsBetween(Window.unboundedPreceding, 0)
    # unsigned order agrees with the slices
    placed = placed.withColumn("c1", F.sum("size").over(within)).join(sums, ["sid", "slice"])
    placed = placed.withColumn("c1", F.col("before") + F.col("c1"))
    return placed.select("doc_id", "source", "size", "sid", "target", "source_size", (F.col("c1") - F.col("size")).alias("c0"), "c1", *carried)


def placements(spark, placed: DataFrame, goals: DataFrame, block_words: int, most: float) -> DataFrame:
    """(slot, pass, sid, c0, first_word, n_words): the words of a document that a slot holds."""
    b = F.lit(block_words).cast("long")
    holds = placed.where("size > 0").select("sid", "c0", "c1", F.explode(F.sequence(F.floor(F.col("c0") / b), F.floor((F.col("c1") - 1) / b))).alias("block"))
    slots = schedule(spark, goals, block_words).where(F.col("pass") < F.lit(math.ceil(most)))
    both = holds.join(slots, ["sid", "block"])
    first, last = F.greatest("c0", F.col("block") * b), F.least(F.col("c1"), (F.col("block") + 1) * b)
    return both.select("slot", "pass", "sid", "c0", (first - F.col("c0")).alias("first_word"), (last - first).alias("n_words"))


def mixed(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0, least: float = 0.0, block_words: int = 64, seed: int = 3, carried: tuple = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, carried...) for each row of docs.

    taken is the number of words that the slots of the schedule hold of the
    document, repeats counted.
    """
    spark = docs.sparkSession
    slim = written(sized(docs, seed, *carried), "sizes")
    goals = written(targets(slim, weights, share, most, least), "targets")
    aside = [f"_c{i}" for i in range(len(carried))]
    placed = written(positions(slim, goals, *aside), "positions")
    used = placements(spark, placed, goals, block_words, most).groupBy("sid", "c0").agg(F.sum("n_words").alias("words"))
    used = used.withColumn("has", F.lit(True))
    out = placed.withColumn("has", F.col("size") > 0).join(used, ["sid", "c0", "has"], "left")
    results = ["doc_id", "source", "size", "source_size", "target", "taken"]
    back = [F.col(a).alias(c) for a, c in zip(aside, result_names(carried, results), strict=True)]
    return out.select(*results[:5], F.coalesce("words", F.lit(0)).cast("long").alias("taken"), *back)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")
