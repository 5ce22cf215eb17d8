"""The plan: blocks to detections, labels, rewritten text and results per document."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakline.functions import fixed
from cloakline.operators import detectors, label, models, names, resolve, review


@dataclass(frozen=True)
class Options:
    """Policies per category, shifting of dates, gazetteers (token) for names and places, and providers of models.

    entities is a model of persons, organisations and places; of the places,
    those in cities are addresses. zero_shot gives candidates for review only.
    """

    policies: dict = field(default_factory=lambda: dict(fixed.POLICIES))
    shift_dates: bool = False
    seed: int = 0
    first_names: DataFrame | None = None
    surnames: DataFrame | None = None
    addresses: bool = True
    entities: models.Provider | None = None
    cities: DataFrame | None = None
    zero_shot: models.Provider | None = None


def detect(blocks: DataFrame, options: Options = Options(), keys: tuple = ("doc_id", "block_ix")) -> DataFrame:
    """blocks (keys, text) with resolved: the detections that stand, nested ones included."""
    rows, places = blocks, None
    if options.entities is not None:
        rows = models.entities(rows, options.entities)
        if options.cities is not None:
            rows, places = models.known_places(rows, options.cities, list(keys)), "places"
    rows = detectors.detected(rows, with_addresses=options.addresses, places=places)
    if options.entities is not None:
        rows = models.with_model_detections(rows).drop("entities", "places")
    if options.first_names is not None and options.surnames is not None:
        rows = names.gazetteer_persons(rows, options.first_names, options.surnames, list(keys))
    person = F.exists("detections", lambda d: d["category"] == names.PERSON)
    every = F.when(person, names.rescanned(F.col("text"), F.col("detections"))).otherwise(F.col("detections"))
    standing = resolve.bound(every, lambda d: F.when(F.size(d) > 1, resolve.resolved(d)).otherwise(d))
    return rows.withColumn("resolved", standing).drop("detections")


def replacements(found: DataFrame, options: Options = Options(), keys: tuple = ("doc_id", "block_ix")) -> DataFrame:
    """(keys, start, end, category, value, score, number, label): spans to replace; label null where the value stays."""
    flat = resolve.bound(F.col("resolved"), lambda d: F.when(F.size(d) > 1, resolve.collapsed(d)).otherwise(d))
    spans = found.select(*keys, F.explode(flat).alias("d")).select(*keys, "d.start", "d.end", "d.category", "d.value", "d.score")
    return label.labelled(label.numbered(spans, keys[0], keys[1], options.policies), keys[0], options.shift_dates, options.seed).drop("canonical", "policy")


def anonymize(blocks: DataFrame, options: Options = Options(), keys: tuple = ("doc_id", "block_ix"), spans: DataFrame | None = None) -> DataFrame:
    """blocks with anonymized, their text with labels in place of what was found (or of the given replacements)."""
    spans = (replacements(detect(blocks, options, keys), options, keys) if spans is None else spans).where("label is not null")
    lists = spans.groupBy(*keys).agg(F.collect_list(F.struct("start", "end", "label")).alias("labels"))
    rows = blocks.join(lists, list(keys), "left")
    text = F.when(F.col("labels").isNull(), F.col("text")).otherwise(label.spliced(F.col("text"), F.col("labels")))
    return rows.withColumn("anonymized", text).drop("labels")


def results(blocks: DataFrame, options: Options = Options(), found: DataFrame | None = None) -> DataFrame:
    """Per document: text, entity_count, uncertain, potentially_missed, rare, polish and leaks, for review before release.

    found are the detections of detect(), if they are at hand; a table that was written spares detecting for each part."""
    keys = ("doc_id", "block_ix")
    found = detect(blocks, options, keys) if found is None else found
    spans = replacements(found, options, keys)
    text = anonymize(blocks, options, keys, spans)
    whole = text.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ix", "anonymized"))), lambda b: b["anonymized"]), "\n\n").alias("text"))
    counts = label.entity_counts(spans)
    total = counts.groupBy("doc_id").agg(F.sum("entities").alias("entity_count"))
    notes = review.uncertain(spans).select("doc_id", "note")
    if options.zero_shot is not None:
        notes = notes.unionByName(models.candidate_notes(found, options.zero_shot, list(keys)).select("doc_id", "note"))
    notes = notes.groupBy("doc_id").agg(F.sort_array(F.collect_list("note")).alias("uncertain"))
    missed = review.potentially_missed(found, list(keys))
    missed = missed.groupBy("doc_id", F.lower("note").alias("k")).agg(F.min(F.struct("block_ix", "start", "note")).alias("m"))
    missed = missed.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["note"]).alias("potentially_missed"))
    leaks = review.leak_findings(text.select("doc_id", "block_ix", F.col("anonymized").alias("text")), ["doc_id"]).groupBy("doc_id").agg(F.sum("findings").alias("leaks"))
    out = whole
    for part in (total, notes, missed, review.small_cells(counts, policies=options.policies), review.language_warnings(blocks), leaks):
        out = out.join(part, "doc_id", "left")
    return out.fillna(0, ["entity_count", "leaks"])
