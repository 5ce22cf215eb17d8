"""Model layers, images, staging and release, and recall over the synthetic documents."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakline.operators import evaluate, models, review
from cloakline.plans import deidentify, release
from cloakline.sources import images


def provider(*rules):
    """A model that finds literal words; fails on texts that say so."""

    def load():
        def model(texts):
            if any("broken" in t for t in texts):
                raise ValueError("broken")
            return [[(m.start(), m.end(), label, score) for word, label, score in rules for m in re.finditer(word, t)] for t in texts]

        return model

    return load


def blocks(spark, *texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, block_ix int, text string")


def test_entities_survive_failures(spark):
    df = blocks(spark, "Jan tu", "broken Jan", None, "").coalesce(1)
    got = {r.doc_id: r.entities for r in models.entities(df, provider(("Jan", "PERSON", 0.9))).collect()}
    assert [(e.start, e.end, e.value, e.label) for e in got[0]] == [(0, 3, "Jan", "PERSON")]
    assert got[1] is None and got[2] == [] and got[3] == []


def test_model_detections_take_part_in_the_plan(spark):
    model = provider(("Jan Nowak", "PERSON", 0.9), ("Alfa", "ORG", 0.9), ("Kraków", "LOC", 0.9), ("Nigdzie", "LOC", 0.9))
    cities = spark.createDataFrame([("kraków",)], "token string")
    names = [spark.createDataFrame([(n,)], "token string") for n in ("anna", "zając")]
    options = deidentify.Options(entities=model, cities=cities, first_names=names[0], surnames=names[1])
    df = blocks(spark, "był Jan Nowak z Alfa, Kraków i Nigdzie, Anna Zając", "była Anna Zając", None, "broken")
    found = {r.doc_id: {(d.category, d.value, d.priority) for d in r.resolved} for r in deidentify.detect(df, options).collect()}
    assert found[0] == {("legal_role_person", "Jan Nowak", 60), ("institution", "Alfa", 55), ("address", "Kraków", 20)}  # a model's person rules out the lists
    assert found[1] == {("legal_role_person", "Anna Zając", 35)} and found[2] == found[3] == set()
    text = {r.doc_id: r.anonymized for r in deidentify.anonymize(df, options).collect()}
    assert text[0] == "był [Osoba 1] z [instytucja 1], [adres 1] i Nigdzie, Anna Zając" and text[3] == "broken"


def test_zero_shot_candidates_are_only_noted(spark):
    model = provider(("sekret", "secret", 0.71), ("a@b.pl", "email", 0.9), ("cicho", "secret", 0.3))
    df = blocks(spark, "to sekret, a@b.pl i cicho", "broken", "nic")
    notes = {r.doc_id: r.uncertain for r in deidentify.results(df, deidentify.Options(zero_shot=model)).collect()}
    assert notes == {0: ["secret - 71%"], 1: ["the model failed on a block"], 2: None}
    with_model, without = (deidentify.anonymize(df, o).select("anonymized") for o in (deidentify.Options(zero_shot=model), deidentify.Options()))
    assert with_model.exceptAll(without).count() == without.exceptAll(with_model).count() == 0


def test_recall_over_all_templates(spark):
    docs = evaluate.golden(spark.range(1, 201))
    truth = docs.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.category", "e.start", "e.end", "e.value")
    text = docs.select("doc_id", "text")
    assert truth.join(text, "doc_id").where("substring(text, start + 1, end - start) <> value").count() == 0
    replaced = deidentify.replacements(deidentify.detect(docs.select("doc_id", F.lit(0).alias("block_ix"), "text"))).where("label is not null")
    got = evaluate.recall(truth, replaced).collect()
    assert {r.category for r in got} == set(evaluate.MAKERS) and all(r.planted == r.matched > 0 for r in got)


def test_release(spark, tmp_path):
    df = blocks(spark, "Poczta a@b.pl", None)
    staging, target = f"file://{tmp_path}/staged", f"file://{tmp_path}/out"
    release.stage(df, staging)
    release.promote(spark, staging, target)
    assert {r.doc_id: r.anonymized for r in spark.read.parquet(target).collect()} == {0: "Poczta [adres e-mail 1]", 1: None}
    assert set(spark.read.parquet(f"{staging}/review").columns) >= {"doc_id", "uncertain", "potentially_missed", "leaks"}
    spark.createDataFrame([(0, 0, "pesel", 1)], "doc_id long, block_ix int, detector string, findings long").write.mode("overwrite").parquet(f"{staging}/leaks")
    with pytest.raises(review.LeakDetectedError):
        release.promote(spark, staging, target)
    release.promote(spark, staging, target, acknowledged=True)
    release.discard(spark, staging)
    assert not (tmp_path / "staged").exists()


def test_format_warnings(spark):
    rows = [("pdf", None, None, 59.0), ("docx", True, True, None), ("image", False, False, 60.0)]
    df = spark.createDataFrame(rows, "k string, t boolean, p boolean, c double").coalesce(1)
    got = [len(r.w) for r in df.select(review.format_warnings(*[F.col(c) for c in "ktpc"]).alias("w")).collect()]
    assert got == [2, 2, 1]


def page(tilt=0.0):
    sheet = np.full((300, 400), 230, np.uint8)
    for y in range(40, 260, 30):
        sheet[y : y + 8, 40:360] = 30
    return images.rotated(sheet, tilt, 230)


def test_image_preprocessing():
    assert images.skew(page()) == 0
    assert abs(images.skew(page(3.0)) + 3.0) <= 0.5
    assert 30 <= images.otsu(page()) < 230
    noisy = page()
    noisy[90, 200] = 0
    assert images.median3(noisy)[90, 200] == 230
    assert max(images.enlarged(page()).shape) == images.LEAST_SIDE and images.enlarged(np.zeros((1600, 10), np.uint8)).shape == (1600, 10)
    black = images.prepared(np.stack([page()] * 3, axis=2))
    assert set(np.unique(black)) == {0, 255} and images.prepared(np.zeros((0, 0), np.uint8)).size == 0


def test_recognition_tries_modes_until_one_is_sure(spark):
    def engine():
        return lambda image, mode: (f"mode {mode}", {6: 40.0, 3: 70.0, 11: 90.0}[mode])

    df = spark.createDataFrame([("a", 300, 400, page().tobytes()), ("b", 7, 7, b"123")], "path string, height int, width int, pixels binary")
    got = {r.path: r for r in images.recognise(df, engine).collect()}
    assert (got["a"].text, got["a"].mean_confidence, got["a"].psm_used, got["a"].error) == ("mode 3", 70.0, 3, None)
    assert got["b"].text is None and got["b"].error
    assert {r.error for r in images.recognise(df).collect()} == {"no text recognition installed"}
    assert images.recognised(np.zeros((2, 2)), lambda image, mode: ("", {6: 9.0, 3: 50.0, 11: 20.0}[mode])) == ("", 50.0, 3)
