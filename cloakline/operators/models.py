"""Model layers: entity recognition and zero-shot candidates from providers that the caller supplies.

A provider is a function without arguments that loads a model and returns a
function from a list of texts to a list, for each text, of (start, end, label,
score). It is called once per task, so a model is loaded once for many blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakline.functions import fixed
from cloakline.operators.names import PERSON

Provider = Callable[[], Callable[[list[str]], list[list[tuple[int, int, str, float]]]]]
ENTITY = "struct<start:int,end:int,value:string,label:string,score:double>"
#: Labels of entity models: category, priority and whether the span may hold others; places go to addresses.
LABELS = {"PERSON": (PERSON, 60, False), "ORG": ("institution", 55, True)}
PLACE = "LOC"
#: Order among equal spans: after the detectors, before gazetteers and addresses.
MODEL_SEQ = 70


def entities(blocks: DataFrame, provider: Provider, text: str = "text", as_column: str = "entities", threshold: float = 0.0, batch_rows: int = 64) -> DataFrame:
    """blocks with array<struct<start, end, value, label, score>> of the model's hits, empty for null text.

    A batch of texts on which the model fails is tried text by text; a text on
    which it fails yields null, so that one bad text doesn't end the job.
    """
    names, at = [*blocks.columns, as_column], blocks.columns.index(text)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("label", pa.string()), ("score", pa.float64())]))

    def attempt(model, texts):
        try:
            return [[{"start": s, "end": e, "value": t[s:e], "label": label, "score": float(score)} for s, e, label, score in hits if score >= threshold] for t, hits in zip(texts, model(texts), strict=True)]
        except Exception:  # a provider's errors are of any kind
            return [None] if len(texts) == 1 else [row for t in texts for row in attempt(model, [t])]

    def run(batches):
        model = provider()
        for batch in batches:
            for a in range(0, batch.num_rows, batch_rows):
                part = batch.slice(a, batch_rows)
                rows = attempt(model, [x or "" for x in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, kind)], names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema] + [f"`{as_column}` array<{ENTITY}>"])
    return blocks.mapInArrow(run, schema)


def known_places(blocks: DataFrame, cities: DataFrame, keys: list[str]) -> DataFrame:
    """blocks (with entities) with places: spans of the model's places that the list of cities (token) holds.

    An equi-join of the places' names with the list; Spark broadcasts the list only if it is small.
    """
    each = blocks.select(*keys, F.explode("entities").alias("e")).where(F.col("e.label") == PLACE).withColumn("token", F.lower("e.value"))
    known = each.join(cities.select("token"), "token", "left_semi")
    spans = known.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("e.start", "e.end"))).alias("places"))
    return blocks.join(spans, keys, "left")


def _detections(label: str) -> Column:
    category, priority, nestable = LABELS[label]

    def one(e):
        return F.struct(
            e["start"].alias("start"), e["end"].alias("end"), F.lit(category).alias("category"), e["value"].alias("value"), F.lit(priority).alias("priority"),
            F.lit(nestable).alias("nestable"), F.lit(1.0).alias("score"), F.lit(MODEL_SEQ).alias("seq"),
        )

    return F.transform(F.filter("entities", lambda e: e["label"] == label), one)


def with_model_detections(rows: DataFrame) -> DataFrame:
    """rows (entities, detections) with the model's persons and organisations among the detections."""
    every = F.concat("detections", *[_detections(label) for label in LABELS])
    return rows.withColumn("detections", F.when(F.col("entities").isNull(), F.col("detections")).otherwise(every))


def candidate_notes(found: DataFrame, provider: Provider, keys: list[str], threshold: float = fixed.ZERO_SHOT_THRESHOLD) -> DataFrame:
    """(keys, note): hits of a zero-shot model that overlap no standing detection, for review alone.

    They never become replacements, and a note holds label and score but no
    value. A block on which the model fails gives one note that says so.
    """
    rows = entities(found.select(*keys, "text", "resolved"), provider, as_column="candidates", threshold=threshold)
    clear = F.filter("candidates", lambda c: ~F.exists("resolved", lambda d: (d["start"] < c["end"]) & (c["start"] < d["end"])))
    notes = F.transform(clear, lambda c: F.concat(c["label"], F.lit(" - "), F.format_string("%d%%", F.round(c["score"] * 100).cast("int"))))
    failed = F.array(F.lit("the model failed on a block"))
    return rows.select(*keys, F.explode(F.when(F.col("candidates").isNull(), failed).otherwise(notes)).alias("note"))
