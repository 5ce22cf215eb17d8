"""Work in tasks of bounded size; searches that only try likely places against plain ones; checks against plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from cloakline.functions import checksums, fixed
from cloakline.operators import detectors, evaluate, review, spread
from cloakline.plans import catalog, parts, planted_documents

BITS = ("Pan ", "świadek ", "radca prawny", "  ", "\n", "Jan", " Nowak", "Łucja Żak", "44051401359", "4405I401359", "526-000-12-46", "+48 601 234 567", "(22) 123 45 67", "ul. Długa 5", "oſ. Nowa 3",
        "00-950 Warszawa", "WA 12345", "ABC123456", "AB1234567", "WVWZZZ1J0AW000001", "PL61109010140000071219812874", "61 1090 1014 0000 0712 1981 2874", "1.2.3.4", "fe80:0:0:0:1:2:3:4",
        "IMEI:123456789012345", "12.03.2024", "3 maja 2020 r.", "1", "22", "-", ".", "/", "x", "ł", "O0IlSB", "\0", "123456785", "")


def test_searches_from_likely_places_are_finditer():
    r = random.Random(3)
    texts = ["".join(r.choice(BITS) + r.choice(("", " ")) for _ in range(r.randint(0, 14))) for _ in range(1500)]
    every = detectors.Texts(texts)
    for pattern in (*detectors.STARTS, fixed.ROLE_PERSON, fixed.IP):
        got = [(row, *m.span()) for row, m in every.matches(pattern)]
        assert got == [(i, *m.span()) for i, t in enumerate(texts) for m in detectors._compiled(pattern).finditer(t)], pattern
        assert got, pattern


def test_tasks_grow_with_the_input(spark, tmp_path):
    spark.range(200000).selectExpr("id as c_custkey", "uuid() as c_name").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    rows = planted_documents.blocks(spark, str(tmp_path))
    size = spread.input_bytes(spark.read.parquet(str(tmp_path / "customer.parquet")))
    assert size > 1 << 20 and rows.rdd.getNumPartitions() >= size >> 16
    for some in (catalog._blocks(spark, "/root/testdata/sf0.001"), parts._entities(spark, "/root/testdata/sf0.001")):
        assert some.rdd.getNumPartitions() >= 4


def test_first_missed_words():
    text = "Zdanie. Potem Zubrowskim i Sądem.\u2028 Wola oraz Zubrowskim, Wola"
    assert [(m["start"], m["token"]) for m in review.missed_in(text, [])] == [(14, "zubrowskim"), (57, "wola")]
    assert [m["token"] for m in review.missed_in(text, [(10, 12), (56, 70)])] == ["zubrowskim"]
    assert review.missed_in(None, []) == []


def plain_mod97(v):
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def test_account_numbers(spark):
    values = ["GB82WEST12345698765432", "gb82west12345698765432", "GB82WEST12345698765431", "DE89370400440532013000", "MT84MALT011000012345MTLCAST001S", "PL61109010140000071219812874", "ZZ00ZZZZZZZZZZZZZZZZZZZZZZZZZZZZZZ"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r.x for r in rows.select(checksums.iban(F.col("v")).alias("x")).collect()] == [plain_mod97(v) for v in values]


@pytest.mark.parametrize("most", [1, 2])
def test_noised_values_pass_corrected(spark, most):
    values = spark.range(6).select(evaluate.iban(F.col("id") + 7).alias("v"), "id").select("v", evaluate.noised(F.col("v"), F.col("id"), most).alias("n"))
    for r in values.withColumn("fine", checksums.passes_corrected("iban", F.col("n"))).collect():
        assert sum(a != b for a, b in zip(r.v, r.n, strict=True)) == most and len(r.v) == len(r.n) and r.fine
