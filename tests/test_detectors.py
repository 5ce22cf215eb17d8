"""Detectors and checks, by the arrow pass and by expressions."""

import random

import pytest
from pyspark.sql import functions as F

from cloakline.functions import checksums
from cloakline.operators import detectors as d
from cloakline.operators.spans import detector_spans, occurrences


def hits(spark, detectors, *texts):
    """Per text, the detections as (start, end, value, score, category), by place."""
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    rows = d.detected(df, tuple(detectors), with_addresses=False).collect()
    return [sorted((h.start, h.end, h.value, h.score, h.category) for h in r.detections) for r in sorted(rows, key=lambda r: r.id)]


def values(spark, name, text):
    return [h[2] for h in hits(spark, [d.BY_NAME[name]], text)[0]]


@pytest.mark.parametrize(
    ("name", "text", "want"),
    [
        ("pesel", "PESEL 44051401359.", ["44051401359"]), ("pesel", "44051401358 i kwota 12345678901 zł", []),
        ("nip", "526-000-12-46 5260001246 5260001247", ["526-000-12-46", "5260001246"]), ("regon", "012345675 012345676", ["012345675"]),
        ("iban", "PL61109010140000071219812874 PL61 1090 1014 0000 0712 1981 2874", ["PL61109010140000071219812874", "PL61 1090 1014 0000 0712 1981 2874"]),
        ("land_register", "KW WA1M/00000001/8", ["WA1M/00000001/8"]), ("passport", "AB1234567", ["AB1234567"]),
        ("vin", "1M8GDM9A4KP042768", ["1M8GDM9A4KP042768"]), ("plate", "auto WA12345", ["WA12345"]), ("krs", "KRS: 0000123456", ["0000123456"]), ("krs", "0000123456", []),
        ("npwz", "NPWZ 1234567, prawo wykonywania zawodu 7654321", ["1234567", "7654321"]), ("npwz", "zwykły numer 1234567", []),
        ("notarial_act", "Rep. A Nr 123/2024 Repertorium A Numer 5/2023", ["123/2024", "5/2023"]), ("usc_act", "akt urodzenia nr 12/2022", ["12/2022"]),
        ("inheritance", "poświadczenie dziedziczenia Rep. A Nr 100/2024", ["100/2024"]), ("inheritance_register", "NORS/123/2024", ["/123/2024"]),
        ("phone", "+48 601 234 567, 601-234-567, 601234567, (22) 123 45 67", ["+48 601 234 567", "601-234-567", "601234567", "(22) 123 45 67"]), ("phone", "44051401359", []),
        ("email", "kontakt@example.com, test.user@domena.pl", ["kontakt@example.com", "test.user@domena.pl"]), ("email", "to nie jest email", []),
        ("ip", "192.168.1.1 300.300.300.300 2001:0db8:85a3:0000:0000:8a2e:0370:7334", ["192.168.1.1", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"]),
        ("imei", "IMEI 123456789012345", ["123456789012345"]), ("url", "https://google.com nie-url", ["https://google.com"]),
        ("date", "12.03.2024, 2024-03-12, 12 marca 2024 r., 12.03.2024 roku", ["12.03.2024", "2024-03-12", "12 marca 2024 r.", "12.03.2024"]),
        ("birth_date", "urodzony 12.03.1990 oraz data urodzenia 15 maja 2000, Data to 12.03.2024", ["12.03.1990", "15 maja 2000"]),
        ("amount", "1500 zł; 1 500,00 zł; 1500,50 PLN; 1.500,00 zł; 5 000 EUR; kwotę 5000 (pięć tysięcy) złotych", ["1500 zł", "1 500,00 zł", "1500,50 PLN", "1.500,00 zł", "5 000 EUR", "kwotę 5000 (pięć tysięcy) złotych"]),
        ("role_person", "Mec. Jan Kowalski i Świadek Adam Nowak", ["Jan Kowalski", "Adam Nowak"]), ("role_person", "Mec. jan kowalski", []),
        ("court", "Sąd Rejonowy w Warszawie; Komenda Miejska Policji w Krakowie; Sklep w Warszawie", ["Sąd Rejonowy w Warszawie", "Komenda Miejska Policji w Krakowie"]),
    ],
)
def test_detectors(spark, name, text, want):
    assert values(spark, name, text) == want


def test_ocr_tolerance_and_context(spark):
    near, far = hits(spark, d.DETECTORS, "Pesel osoby to 44O51401359, dalej", "numer 44O51401359")
    assert [h[3] for h in near if h[4] == "pesel"] == [0.85] and [h[3] for h in far if h[4] == "pesel"] == [0.4]
    assert values(spark, "nip", "526O001246") == ["526O001246"] and values(spark, "pesel", "601234567") == []
    df = spark.createDataFrame([("WA1M/O0000001/8",)], "v string")
    assert df.select(checksums.land_register(F.col("v")).alias("x")).collect()[0].x is False


def test_corrected_values(spark):
    """One or two confused characters are made good, wherever they stand; three are not, and other characters never."""
    cases = {
        "id_card": [("AAT923456", True), ("AAT9Z3456", True), ("AAT9Z34S6", True), ("AAT9234X6", False)],
        "land_register": [("WA1M/OOO00001/8", False), ("WA1M/O000000l/8", True), ("WAIM/00000001/8", True), ("WA1M/00000001/B", True)],
        "iban": [("PL61109O1014000007l219812874", True), ("PL61109010140000071219812874", True)],
        "vehicle_vin": [("1M8GDM9A4KPO42768", True), ("IM8GDM9A4KPO42768", True), ("IM8GDM9A4KPO4Z768", False)],
    }
    for category, pairs in cases.items():
        df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(pairs)], "i int, v string").coalesce(1)
        check = checksums.EXPRESSIONS[category]
        got = {r.i: r.x for r in df.select("i", (check(F.col("v")) | checksums.passes_corrected(category, F.col("v"))).alias("x")).collect()}
        assert [got[i] for i in range(len(pairs))] == [want for _, want in pairs], category


def test_addresses():
    got = d.addresses("przy ul. Polnej 5, 00-950 Warszawa oraz dalej")
    assert got == [(5, 34, "ul. Polnej 5, 00-950 Warszawa", "high")]
    assert [c[3] for c in d.addresses("zamieszkały w Marszałkowska 10/12.")] == ["medium"]
    assert d.addresses("Sąd wydal wyrok w sprawie") == []


def test_case_numbers(spark):
    text = "I C 123/24, II K 45/24, PR 1 Ds. 123.2026, RSD-123/26, II SA/Wa 123/24, KIO 123/24, Km 123/24"
    df = spark.createDataFrame([(text,), ("12.03.2024, 601 234 567",)], "t string").coalesce(1)
    found, none = (r.c for r in df.select(d.case_numbers(F.col("t")).alias("c")).collect())
    assert all(text[s.start : s.end] == s.value for s in found) and none == []
    assert [s.subtype for s in found] == ["cywilne_gospodarcze", "karne", "prokuratorskie", "policyjne", "administracyjne", "sn_kio", "komornicze"]


def test_expressions_agree_with_the_arrow_pass(spark):
    rng = random.Random(1)
    parts = ["kontakt@example.com", "601 234 567", "ul. Polna 5", "12 marca 2024 r.", "1 500,00 ZŁ", "Świadek Jan Nowak", "𝔘ż", "WA12345", "\n", "10.0.0.300", "Sąd Rejonowy w Gdańsku", "KRS: 0000123456", "123456789012345"]
    texts = [" ".join(rng.choices(parts, k=8)) for _ in range(40)] + [""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for name in ("email", "phone", "date", "amount", "role_person", "plate", "imei", "url", "krs", "court"):
        spec = d.DetectorSpec(name, name, d.BY_NAME[name].pattern, 1)
        got = {r.id: [tuple(s) for s in r.s] for r in df.select("id", detector_spans(F.col("text"), spec.pattern).alias("s")).collect()}
        assert got == {i: [h[:3] for h in found] for i, found in enumerate(hits(spark, [spec], *texts))}, name


def plain_check(category, v):
    """The check digit rules, plainly."""
    n = [int(c, 36) for c in v if c.isalnum()]
    dot = lambda weights, m=10: sum(a * b for a, b in zip(n, weights, strict=False)) % m
    if category == "pesel":
        return (10 - dot((1, 3, 7, 9, 1, 3, 7, 9, 1, 3))) % 10 == n[10]
    if category == "nip":
        return dot((6, 5, 7, 2, 3, 4, 5, 6, 7), 11) == n[9]
    if category == "regon":
        return dot((8, 9, 2, 3, 4, 5, 6, 7), 11) % 10 == n[8] and (len(n) == 9 or dot((2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8), 11) % 10 == n[13])
    if category == "iban":
        v = v if v[:2].isalpha() else "PL" + v
        return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
    if category == "land_register":
        digits = "".join(str(int(c, 36)) for c in v[:4]) + v[5:13]
        return sum(int(c) * (1, 3, 7)[i % 3] for i, c in enumerate(reversed(digits))) % 10 == int(v[14])
    if category == "id_card":
        return dot((7, 3, 1, 0, 7, 3, 1, 7, 3)) == n[3]
    if category == "vehicle_vin":
        table = {c: (i % 9 + 1 if c < "J" else {"J": 1, "K": 2, "L": 3, "M": 4, "N": 5, "P": 7, "R": 9}.get(c) or ord(c) - ord("S") + 2) for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ")}
        total = sum((int(c) if c.isdigit() else table[c]) * w for c, w in zip(v, (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2), strict=True)) % 11
        return v[8] == ("X" if total == 10 else str(total))
    return "." not in v or all(int(p) <= 255 for p in v.split("."))


def test_checks_agree(spark):
    rng = random.Random(2)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    cases = {
        "pesel": [digits(11) for _ in range(200)] + ["44051401359"], "nip": [digits(10) for _ in range(200)] + ["526-000-12-46"], "regon": [digits(9) for _ in range(200)] + [digits(14) for _ in range(400)],
        "iban": ["PL61109010140000071219812874", "61109010140000071219812874"] + [digits(26) for _ in range(300)] + [f"DE{digits(2)}AB{digits(16)}" for _ in range(300)], "land_register": [f"WA{rng.choice('1KX')}M/{digits(8)}/{digits(1)}" for _ in range(200)],
        "id_card": ["ABC" + digits(6) for _ in range(200)], "vehicle_vin": ["1M8GDM9A4KP042768"] + ["1M8GDM9A%sKP%s" % (rng.choice("0123456789X"), digits(6)) for _ in range(200)],
        "ip_address": ["1.2.3.4", "300.1.1.1", "aaaa:bbbb"],
    }
    for name, vs in cases.items():
        df = spark.createDataFrame([(v,) for v in vs], "v string").coalesce(1)
        got = [(r.v, r.ok) for r in df.select("v", checksums.EXPRESSIONS[name](F.col("v")).alias("ok")).collect()]
        assert got == [(v, plain_check(name, v)) for v in vs], name
    closed = spark.createDataFrame([("44O51401359",), ("44051401359",), ("OOO51401359",)], "v string").select(checksums.ocr_digits(F.col("v"), checksums.pesel).alias("x"))
    assert [r.x for r in closed.collect()] == [True, False, False]


def test_occurrences(spark):
    df = spark.createDataFrame([("Nowak, Nowakowski i Nowak", "Nowak"), ("a\\Eb a\\Eb", "a\\Eb"), ("x", "y")], "t string, f string")
    assert [r.o for r in df.select(occurrences(F.col("t"), F.col("f")).alias("o")).collect()] == [[0, 7, 20], [0, 5], []]
