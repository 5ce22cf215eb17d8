"""Spans of a pattern as expressions alone: offsets from the gaps between matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakline.functions import fixed


def bound(value: Column, body) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of all matches of a Java pattern.

    What lies between matches and the matches themselves alternate, so a
    match starts where the lengths of all before it end.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))

    def step(a, m):
        start = a["at"] + F.length(m["gap"])
        end = start + F.length(m["whole"])
        span = F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    found = F.aggregate(rows, begin, step, lambda a: a["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def detector_spans(text: Column, pattern: str) -> Column:
    """Spans of one of the fixed patterns."""
    return spans(text, fixed.java(pattern), 1 if "(?P<value>" in pattern else 0)


def occurrences(text: Column, form: Column) -> Column:
    """Starts of a literal string, without overlaps."""
    gaps = F.split(text, F.concat(F.lit("\\Q"), F.replace(form, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), F.lit(-1))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(a, gap):
        start = a["at"] + F.length(gap)
        return F.struct((start + F.length(form)).alias("at"), F.concat(a["out"], F.array(start)).alias("out"))

    return F.aggregate(F.slice(gaps, 1, F.size(gaps) - 1), begin, step, lambda a: a["out"])
