"""Expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakline.functions import fixed

#: What office files can't hold: control characters but tab and line feed, and non-characters.
ILLEGAL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\uFDD0-\\uFDEF\\uFFFE\\uFFFF]"


def looks_polish(text: Column) -> Column:
    """False only for a text of 30 words or more without Polish letters and with few common Polish words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))
    common = F.size(F.filter(words, lambda w: w.isin(*fixed.POLISH_WORDS)))
    return (F.size(words) < 30) | text.rlike("[ąćęłńóśźżĄĆĘŁŃÓŚŹŻ]") | (common / F.greatest(F.size(words), F.lit(1)) >= 0.03)


def trustworthy_layer(text: Column) -> Column:
    """Whether a page's text layer reads like text rather than like a broken encoding."""
    share = F.length(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}\s]", "")) / F.greatest(F.length(text), F.lit(1))
    hint = rf"(?iuU)\b(?:{'|'.join(fixed.PAGE_WORDS)})\b"
    stripped = F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    return F.when(stripped == 0, False).when(stripped < 20, True).when(share < 0.6, False).when(text.rlike(hint), True).otherwise(share >= 0.85)


def reflowed(text: Column) -> Column:
    """Wrapped lines joined to paragraphs, which two line ends part.

    Empty lines and sentence ends close a paragraph; a hyphen at the end of a
    line goes as the next one is joined to it.
    """
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(a, line):
        joined = (
            F.when(a["now"] == "", line)
            .when(a["now"].rlike(r"-\s*$"), F.concat(F.regexp_replace(a["now"], r"-\s*$", ""), line))
            .otherwise(F.concat(a["now"], F.lit(" "), line))
        )
        close = (line == "") | line.rlike(r"[.:;!?…”\"'\)\]]\s*$")
        held = F.when(line == "", a["now"]).otherwise(joined)
        done = F.when(close & (held != ""), F.concat(a["done"], F.array(held))).otherwise(a["done"])
        return F.struct(F.when(close, F.lit("")).otherwise(held).alias("now"), done.alias("done"))

    end = lambda a: F.array_join(F.when(a["now"] != "", F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]), "\n\n")
    return F.aggregate(lines, start, step, end)


def sanitized(text: Column) -> Column:
    """Line ends as line feeds, without the characters that office files can't hold."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), ILLEGAL, "")


def paragraphs(text: Column) -> Column:
    """Blocks parted by empty lines, single line ends as spaces, empty ones left out."""
    parts = F.transform(F.split(sanitized(text), "\n\n", -1), lambda p: F.regexp_replace(F.regexp_replace(p, "\n", " "), r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")
