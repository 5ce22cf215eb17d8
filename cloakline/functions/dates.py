"""Parsing, shifting and writing of dates in the styles that the detectors find."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakline.functions import fixed

DOTTED = r"^([0-9]{1,2})([./-])([0-9]{1,2})\2([0-9]{4})$"
ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
TEXTUAL = r"(?U)^([0-9]{1,2})\s+(\w+)\s+([0-9]{4})\s*(r\.|roku)?$"


def _trimmed(v: Column) -> Column:
    return F.regexp_replace(v, r"(?U)^\s+|\s+$", "")


def parse(value: Column) -> Column:
    """The date, or null if the value is none or not in the calendar."""
    v = _trimmed(value)
    part = lambda p, i: F.regexp_extract(v, p, i)
    names = F.array(*[F.lit(m) for m in fixed.MONTHS])
    month = F.array_position(names, F.lower(part(TEXTUAL, 2))).cast("string")
    at = lambda y, m, d: F.try_to_timestamp(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    return (
        F.when(v.rlike(DOTTED), at(part(DOTTED, 4), part(DOTTED, 3), part(DOTTED, 1)))
        .when(v.rlike(ISO), F.try_to_timestamp(v, F.lit("yyyy-MM-dd")).cast("date"))
        .when(v.rlike(TEXTUAL) & (month != "0"), at(part(TEXTUAL, 3), month, part(TEXTUAL, 1)))
    )


def written_like(value: Column, date: Column) -> Column:
    v = _trimmed(value)
    names = F.array(*[F.lit(m) for m in fixed.MONTHS])
    suffix = F.regexp_extract(v, TEXTUAL, 4)
    text = F.concat(F.dayofmonth(date).cast("string"), F.lit(" "), F.element_at(names, F.month(date)), F.lit(" "), F.year(date).cast("string"), F.when(suffix != "", F.concat(F.lit(" "), suffix)).otherwise(""))
    sep = F.regexp_extract(v, DOTTED, 2)
    dotted = F.concat(F.date_format(date, "dd"), sep, F.date_format(date, "MM"), sep, F.date_format(date, "yyyy"))
    return F.when(v.rlike(DOTTED), dotted).when(v.rlike(ISO), F.date_format(date, "yyyy-MM-dd")).when(v.rlike(TEXTUAL), text).otherwise(value)


def shifted(value: Column, days: Column) -> Column:
    """The value moved by days in its own style; what can't be read stays as it is."""
    date = parse(value)
    return F.when(date.isNull(), value).otherwise(written_like(value, F.date_add(date, days.cast("int"))))


def offset(doc_id: Column, seed: int) -> Column:
    """Whole weeks, up to 52 either way, in days; one draw for each document."""
    return ((F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(105)) - 52) * 7).cast("int")
