"""What a reviewer sees: uncertain hits, words that may have been missed, risks, leaks."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakline.functions import fixed
from cloakline.functions.text import looks_polish
from cloakline.operators.detectors import BY_NAME, LEAK_CHECKED, detected

_TOKEN = re.compile(f"[{fixed.UPPER}][{fixed.LOWER}]{{2,}}")
_COMMON = frozenset(fixed.COMMON_CAPITALISED)


class LeakDetectedError(Exception):
    """Identifiers were found in text that was to be published; names no values."""


def _stripped(s: str) -> str:
    """Without white space before the end, which a last line separator does not move."""
    last = s[-1:] if s[-1:] in _SEPARATORS else ""
    return s[: len(s) - len(last)].rstrip(" \t\n\r") + last


def _inside(text: str, start: int) -> bool:
    """Whether the last character before the word that is no white space ends no sentence."""
    before = _stripped(text[max(start - 16, 0) : start]) or _stripped(text[:start])
    return before != "" and (before[:-1] if before[-1] in _SEPARATORS else before)[-1:] not in tuple(".!?")


_SEPARATORS = ("\u0085", "\u2028", "\u2029")
_MISSED = pa.list_(pa.struct([("start", pa.int32()), ("token", pa.string()), ("note", pa.string())]))


def missed_in(text: str | None, covered: list[tuple[int, int]]) -> list[dict]:
    """(start, token, note) of the first of each capitalised word inside a sentence that no span covers."""
    out: dict[str, dict] = {}
    for m in _TOKEN.finditer(text or ""):
        start, token = m.start(), m[0].lower()
        if token not in out and token not in _COMMON and not any(a <= start < b for a, b in covered) and _inside(text, start):
            out[token] = {"start": start, "token": token, "note": text[max(start - 25, 0) : m.end() + 25].strip(" ")}
    return list(out.values())


def potentially_missed(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, token, note): capitalised words inside sentences that no detection covers, each once in a
    block, with 25 characters around. found has text and resolved."""
    rows = found.select(*keys, "text", F.transform("resolved", lambda d: d["start"]).alias("a"), F.transform("resolved", lambda d: d["end"]).alias("b"))
    n = len(keys)

    def run(batches):
        for batch in batches:
            texts, a, b = (batch.column(n + i).to_pylist() for i in range(3))
            missed = [missed_in(t, list(zip(x or (), y or (), strict=True))) for t, x, y in zip(texts, a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(missed, _MISSED)], [*keys, "m"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema][:n] + ["m array<struct<start:int,token:string,note:string>>"])
    each = rows.mapInArrow(run, schema).select(*keys, F.explode("m").alias("m"))
    return each.groupBy(*keys, F.col("m.token").alias("token")).agg(F.min("m").alias("m")).select(*keys, "m.start", "token", "m.note")


def uncertain(rows: DataFrame) -> DataFrame:
    """Replaced spans of less than full score, with a note that holds no value."""
    return rows.where("label is not null and score < 1").withColumn("note", F.concat("label", F.lit(" - "), F.format_string("%d%%", F.round(F.col("score") * 100).cast("int"))))


def uncovered(candidates: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of a model that overlap no detection: an interval anti-join within each block."""
    other = resolved.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("start").alias("_start"), F.col("end").alias("_end"))
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    return candidates.join(other, [*same, F.col("start") < F.col("_end"), F.col("_start") < F.col("end")], "left_anti")


def leak_findings(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, detector, findings): hits of the checked detectors in text to be published, without values."""
    specs = tuple(BY_NAME[n] for n in LEAK_CHECKED)
    rows = detected(blocks.select(*keys, "text"), specs, with_addresses=False).select(*keys, F.explode("detections").alias("d"))
    names = F.create_map(*[F.lit(x) for i, n in enumerate(LEAK_CHECKED) for x in (i, n)])
    return rows.groupBy(*keys, names[F.col("d.seq")].alias("detector")).agg(F.count("*").alias("findings"))


def assert_clean(findings: DataFrame) -> None:
    """Raises LeakDetectedError if there is any finding."""
    n = findings.limit(1).count()
    if n:
        raise LeakDetectedError("identifiers remain in the text to be published")


def small_cells(counts: DataFrame, doc: str = "doc_id", policies: dict = fixed.POLICIES) -> DataFrame:
    """(doc, rare): categories with one entity in a document that leaves others visible."""
    if fixed.LEAVE not in policies.values():
        return counts.where("false").groupBy(doc).agg(F.array_sort(F.collect_set("category")).alias("rare"))
    rare = counts.where((F.col("entities") <= 1) & ~F.col("category").isin("amount", "case_number"))
    return rare.groupBy(doc).agg(F.array_sort(F.collect_set("category")).alias("rare"))


def format_warnings(kind: Column, tracked_changes: Column, unprotected: Column, confidence: Column) -> Column:
    """What a reviewer must know of a file: its kind's limits, changes in it that were tracked, protection that
    was removed, and poor text recognition. Null stands for not known, and warns of nothing."""
    say = lambda when, text: F.when(when, F.lit(text))
    return F.array_compact(
        F.array(
            say(kind == "pdf", "the layout of a PDF is kept roughly"), say(kind == "image", "the text was recognised in an image"),
            say(tracked_changes, "the file holds tracked changes"), say(unprotected, "protection against editing was removed"),
            say(confidence < 60, "the text was recognised with low confidence"),
        )
    )


def language_warnings(blocks: DataFrame, doc: str = "doc_id", block: str = "block_ix", chars: int = 5000) -> DataFrame:
    """(doc, polish): whether the first characters of a document's text look Polish."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(block, "text"))), lambda b: b["text"]), " ")
    return blocks.groupBy(doc).agg(looks_polish(F.substring(joined, 1, chars)).alias("polish"))
