"""Names: gazetteers as joins, inflected forms, and the literal second look for known persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakline.functions import fixed
from cloakline.operators.spans import occurrences, spans

PERSON = "legal_role_person"


def gazetteer(lines: DataFrame, column: str = "value") -> DataFrame:
    """(token) of a list of names: trimmed, in lower case, each once."""
    return lines.select(F.lower(F.trim(column)).alias("token")).where("token <> ''").distinct()


def surname_forms(name: Column) -> Column:
    """The name and its forms by case, from its ending."""
    out = None
    for ending, cut, suffixes in fixed.INFLECTION:
        stem = F.substring(name, F.lit(1), F.length(name) - cut) if cut else name
        forms = F.array_distinct(F.array(name, *[F.concat(stem, F.lit(s)) for s in suffixes]))
        if not ending:
            return out.otherwise(forms)
        out = (F.when if out is None else out.when)(F.lower(name).endswith(ending), forms)


def name_forms(name: Column) -> Column:
    """Forms of a full name: those of its last word after the others."""
    words = F.split(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")), " ")
    given = F.array_join(F.slice(words, 1, F.size(words) - 1), " ")
    last = F.element_at(words, -1)
    return F.when(name == "", F.array().cast("array<string>")).when(F.size(words) < 2, surname_forms(name)).otherwise(F.transform(surname_forms(last), lambda f: F.concat(given, F.lit(" "), f)))


def gazetteer_persons(blocks: DataFrame, first_names: DataFrame, surnames: DataFrame, keys: list[str]) -> DataFrame:
    """blocks with pairs of a known first name and a known surname added to blocks without a model's person.

    Equi-joins of the pairs' words with the lists; Spark broadcasts a list only if it is small.
    """
    pattern = fixed.java(fixed.NAME_PAIR)
    pairs = spans(F.col("text"), pattern)
    persons = F.exists("detections", lambda d: (d["category"] == PERSON) & (d["priority"] == 60))
    each = blocks.where(~persons).select(*keys, F.explode(pairs).alias("p"))
    words = F.split(F.lower(F.regexp_replace("p.value", r"(?U)\s+", " ")), " ")
    each = each.withColumn("a", F.get(words, F.lit(0))).withColumn("b", F.get(words, F.lit(1)))
    for side in "ab":
        for name, known in (("first", first_names), ("last", surnames)):
            known = known.select(F.col("token").alias(side), F.lit(True).alias(f"{name}_{side}"))
            each = each.join(known, side, "left")
    hit = (F.col("first_a") & F.col("last_b")) | (F.col("last_a") & F.col("first_b"))
    one = F.struct(F.col("p.start").alias("start"), F.col("p.end").alias("end"), F.lit(PERSON).alias("category"), F.col("p.value").alias("value"), F.lit(35).alias("priority"), F.lit(False).alias("nestable"), F.lit(fixed.GAZETTEER_SCORE).alias("score"), F.lit(80).alias("seq"))
    more = each.where(F.coalesce(hit, F.lit(False))).groupBy(*keys).agg(F.collect_list(one).alias("more"))
    joined = blocks.join(more, keys, "left")
    return joined.withColumn("detections", F.when(F.col("more").isNull(), F.col("detections")).otherwise(F.concat("detections", "more"))).drop("more")


def rescanned(text: Column, detections: Column) -> Column:
    """detections with the literal occurrences of all forms of the block's persons that have no span yet."""
    people = F.array_distinct(F.transform(F.filter(detections, lambda d: d["category"] == PERSON), lambda d: d["value"]))
    forms = F.array_distinct(F.flatten(F.transform(people, name_forms)))

    def hits(form):
        return F.transform(occurrences(text, form), lambda s: F.struct(s.alias("start"), (s + F.length(form)).alias("end"), F.lit(PERSON).alias("category"), form.alias("value"), F.lit(65).alias("priority"), F.lit(False).alias("nestable"), F.lit(1.0).alias("score"), F.lit(200).alias("seq")))

    every = F.flatten(F.transform(forms, hits))
    new = F.filter(every, lambda h: ~F.exists(detections, lambda d: (d["start"] == h["start"]) & (d["end"] == h["end"])))
    return F.when(F.size(people) > 0, F.concat(detections, new)).otherwise(detections)
