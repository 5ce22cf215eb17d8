"""Labels: numbers of entities per document, policies, shifted dates, and the rewritten text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakline.functions import dates, fixed
from cloakline.functions.canonical import canonical


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def numbered(spans: DataFrame, doc: str = "doc_id", block: str = "block_ix", policies: dict = fixed.POLICIES) -> DataFrame:
    """spans (doc, block, start, category, value, ...) with policy, canonical and number.

    Equal canonical values of a category of a document have one number, in
    the order of their first appearance. The windows are over one document's
    entities, never over all.
    """
    rows = spans.withColumn("policy", F.coalesce(_lookup(policies, F.col("category")), F.lit(fixed.NUMBER))).withColumn("canonical", canonical(F.col("category"), F.col("value")))
    same = Window.partitionBy(doc, "category", "canonical")
    order = Window.partitionBy(doc, "category").orderBy("first")
    rows = rows.withColumn("first", F.min(F.struct(F.col(block), F.col("start"))).over(same))
    rank = F.dense_rank().over(order)
    return rows.withColumn("number", F.when(F.col("policy") == fixed.NUMBER, rank)).drop("first")


def labelled(rows: DataFrame, doc: str = "doc_id", shift_dates: bool = False, seed: int = 0) -> DataFrame:
    """rows of numbered() with label, null where the value stays."""
    stem = F.coalesce(_lookup(fixed.LABELS, F.col("category")), F.col("category"))
    label = F.when(F.col("policy") == fixed.NUMBER, F.concat(F.lit("["), stem, F.lit(" "), F.col("number").cast("string"), F.lit("]")))
    label = label.when(F.col("policy") == fixed.NO_NUMBER, F.concat(F.lit("["), stem, F.lit("]")))
    if shift_dates:
        moved = dates.shifted(F.col("value"), dates.offset(F.col(doc), seed))
        label = F.when(F.col("category") == "date", F.when(moved != F.col("value"), moved)).otherwise(label)
    return rows.withColumn("label", label)


def spliced(text: Column, replacements: Column) -> Column:
    """The text with array<struct<start, end, label>> put in place; spans don't overlap."""
    ordered = F.array_sort(replacements, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, r):
        return F.struct(r["end"].alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, r["start"] - a["at"]), r["label"])).alias("out"))

    rest = lambda a: F.array_join(F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, F.length(text)))), "")
    return F.aggregate(ordered, begin, step, rest)


def entity_counts(rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, category, entities): distinct numbered entities."""
    return rows.where("number is not null").groupBy(doc, "category").agg(F.max("number").alias("entities"))
