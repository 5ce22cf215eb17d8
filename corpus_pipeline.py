"""From raw documents to pieces for training, in five stages.

Each stage is a function of (spark, docs, sf_dir). It works on all its
predecessor kept; what it returns is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.

Columns beside doc_id, text, lang, source and n_chars are carried through all
stages, whatever they are named. Null, empty and very long texts, ties, repeated
rows and empty tables have the results that each stage states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakline.llm.common import WORD, column, written
from cloakline.llm.jaccard import similar_groups
from cloakline.llm.mixing import mixed
from cloakline.llm.quality import accepted
from cloakline.llm.sentencepiece_dropout import encoded
from cloakline.llm.suffix_dedup import deduplicated


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the adaptive thresholds reject go; null and empty texts have no words, so they
    go. Repeated rows are judged each for itself. No rows of an empty table."""
    return accepted(docs)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 or more of five-word shingles, that of
    the smallest doc_id stays. Of rows equal in doc_id and text, one stays. Documents without doc_id stay, and null and
    empty texts are linked with nothing. No rows of an empty table."""
    groups = similar_groups(docs, percent=80, words=5)
    first = written(groups.where("doc_id = component_id").select(F.col("doc_id").alias("_first")).distinct(), "first")
    # a document is one column here, so no name in it can clash
    whole = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), F.octet_length("text").alias("_size"), F.struct(*[column(c) for c in docs.columns]).alias("_row"))
    one = F.row_number().over(Window.partitionBy("_id", "_text", "_size").orderBy("_row.source", "_row.lang"))
    kept = whole.join(first, F.col("_id") == F.col("_first")).withColumn("_copy", one).where("_copy = 1")
    return kept.select("_row").unionByName(whole.where("_id is null").select("_row")).select("_row.*")


def _aside(docs: DataFrame, *own: str) -> tuple[DataFrame, list[str], list[str]]:
    """docs with its other columns named _p0, _p1 and so on; these names, and the columns' own."""
    others = [c for c in docs.columns if c not in own]
    names = [f"_p{i}" for i in range(len(others))]
    return docs.select(*own, *[column(c).alias(n) for c, n in zip(others, names, strict=True)]), names, others


def repeated_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Characters of strings of 200 bytes that occur elsewhere too are removed; documents with no word left go.
    Null, empty and shorter texts stay as they are. No rows of an empty table."""
    plain, names, others = _aside(docs, "doc_id", "text")
    out = deduplicated(plain, *names, with_text=True)
    out = out.where((F.col("n_removed") == 0) | F.col("kept").rlike(WORD))
    back = {o: F.col(n) for o, n in zip(others, names, strict=True)}
    back |= {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select([back[c].alias(c) for c in docs.columns])


def source_mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated as often as the schedule takes them.

    All sources get one pass, so that no document that earlier stages kept is
    lost; half of all words once more is shared by the weights, up to a second
    pass. Documents without words are taken once. No rows of an empty table.
    """
    plain, names, others = _aside(docs, "doc_id", "source", "text")
    numbered = written(plain.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    taken = mixed(numbered, least=1.0, carried=("_at",))
    times = F.when(F.col("size") > 0, F.greatest(F.lit(1), F.floor(F.col("taken") / F.col("size") + 0.5))).otherwise(1).cast("int")
    taken = written(taken.select("_at", times.alias("_times")), "taken")
    both = numbered.join(taken, "_at").withColumn("_pass", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    back = {o: F.col(n) for o, n in zip(others, names, strict=True)}
    return both.select([back[c].alias(c) if c in back else F.col(c) for c in docs.columns])


def pieces(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their pieces, the number and checksum of these, merged with dropout and decoded again.

    Null and empty texts have no pieces. A text that the pieces don't give back is an error, never a lost row. A
    column named like a result is returned with docs_ before its name. No rows of an empty table."""
    out = encoded(docs, *docs.columns)
    return out.where(F.when(F.col("lossless"), True).otherwise(F.raise_error(F.lit("pieces don't give a text back")).cast("boolean")))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("pieces", pieces),
]

#: SQL can't express the sketches, the schedule and the keyed merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
