"""Detectors over texts made from keys: SQL knows what was planted and where."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline.functions import checksums, fixed
from cloakline.operators import detectors, review, spans


def _number(expression: str, digits: int) -> str:
    return f"lpad(CAST(({expression}) % {10**digits} AS STRING), {digits}, '0')"


def _text(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


def _choice(*options: str) -> str:
    return "CASE " + " ".join(f"WHEN id % {len(options)} = {i} THEN '{o}'" for i, o in enumerate(options)) + " END"


@dataclass(frozen=True)
class Plant:
    """A text: before, lead (words that the match covers too), the value (SQL of id), after."""

    pattern: str
    before: str
    lead: str
    value: str
    after: str


_CASE = f"{_text('1 + id % 9999')} || '/' || {_text('10 + id % 15')}"
_ENTRY = f"{_text('1 + id % 99999')} || '/' || {_text('1990 + id % 35')}"
_DATE = f"{_text('1 + id % 28')} || '.' || {_text('1 + id % 12')} || '.' || {_text('1990 + id % 30')}"
_PATTERN = {d.name: d.pattern for d in detectors.DETECTORS}

PLANTED = {
    "passport": Plant(_PATTERN["passport"], "Okazano paszport ", "", f"chr(CAST(65 + id % 26 AS INT)) || chr(CAST(65 + id % 25 AS INT)) || {_number('id * 7919', 7)}", " i odmówiono."),
    "krs": Plant(_PATTERN["krs"], "Wpis pod numerem ", "KRS: ", _number("id * 104729", 10), ", wydział szósty."),
    "npwz": Plant(_PATTERN["npwz"], "Lekarz, ", "prawo wykonywania zawodu ", _number("id * 7907", 7), "."),
    "civil_case": Plant(_PATTERN["case_number"], "W sprawie ", "", f"{_choice('I C', 'II Nc', 'XIV GC')} || ' ' || {_CASE}", " orzeczono."),
    "criminal_case": Plant(_PATTERN["case_number"], "W sprawie ", "", f"{_choice('III K', 'II Ko', 'V Kp')} || ' ' || {_CASE}", " orzeczono."),
    "prosecutor_case": Plant(_PATTERN["case_number"], "Akta ", "", f"'PR ' || {_text('1 + id % 9')} || ' Ds. ' || {_text('1 + id % 9999')} || '.' || {_text('2000 + id % 25')}", " przekazano."),
    "bailiff_case": Plant(_PATTERN["case_number"], "Komornik, ", "", f"{_choice('Km', 'GKm', 'Kmp')} || ' ' || {_CASE}", ", zajął konto."),
    "notarial_act": Plant(_PATTERN["notarial_act"], "Sporządzono akt, ", "Rep. A Nr ", _ENTRY, " z odpisem."),
    "civil_registry_act": Plant(_PATTERN["usc_act"], "Dołączono ", "akt urodzenia nr ", _ENTRY, " do wniosku."),
    "inheritance_act": Plant(_PATTERN["inheritance"], "Przedłożono ", "poświadczenie dziedziczenia, Rep. A Nr ", _ENTRY, " dnia."),
    "inheritance_register": Plant(_PATTERN["inheritance_register"], "Wpis: ", "Rejestr Spadkowy, ", f"'PL-' || {_ENTRY}", " dnia."),
    "phone": Plant(_PATTERN["phone"], "Telefon: ", "", f"'6' || {_number('id * 31', 2)} || '-' || {_number('id * 37', 3)} || '-' || {_number('id * 41', 3)}", ", po szóstej."),
    "date": Plant(_PATTERN["date"], "Umowa z dnia ", "", _DATE, ", zmieniona."),
    "date_in_words": Plant(_PATTERN["date"], "Umowa z dnia ", "", f"{_text('1 + id % 28')} || ' ' || {_choice(*fixed.MONTHS)} || ' ' || {_text('1990 + id % 30')} || ' r.'", ", zmieniona."),
    "birth_date": Plant(_PATTERN["birth_date"], "Powódka, ", "urodzona ", _DATE, ", wnosi."),
    "role_person": Plant(_PATTERN["role_person"], "Zeznaje ", "Świadek ", f"{_choice('Anna', 'Łucja', 'Jan')} || ' ' || {_choice('Żak', 'Kowalska', 'Nowak', 'Wiśniewski')}", " z urzędu."),
    "court": Plant(_PATTERN["court"], "Wyrok wydał ", "", f"{_choice('Sąd Rejonowy', 'Sąd Okręgowy', 'Komenda Miejska Policji', 'Prokuratura Okręgowa')} || ' w ' || {_choice('Łodzi', 'Krakowie', 'Gdańsku')}", ", wydział drugi."),
    "company": Plant(_PATTERN["company"], "najemcą jest ", "", f"'Firma' || {_text('id')} || ' ' || {_choice('Handel sp. z o.o.', 'i Syn S.A.', 'Łódź sp.j.')}", ", dalej spółka"),
    "street": Plant(fixed.ADDRESS_STREET, "Lokal mieści się przy ", "", f"{_choice('ul. Długiej', 'al. Jana Pawła', 'os. Zielonym')} || ' ' || {_text('1 + id % 300')} || '/' || {_text('1 + id % 40')}", ", na parterze."),
    "postal_city": Plant(fixed.ADDRESS_POSTAL, "Poczta: ", "", f"{_number('id', 2)} || '-' || {_number('id * 7', 3)} || ' ' || {_choice('Kraków', 'Zielona Góra', 'Bielsko-Biała')}", ", odbiór."),
    "anchored_place": Plant(fixed.ADDRESS_ANCHOR, "Spółka ", "z siedzibą w ", _choice("Krakowie", "Nowym Targu", "Łodzi"), ", wpisana."),
}


def _planted(name: str):
    plant = PLANTED[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
        text = F.concat(F.lit(plant.before + plant.lead), F.expr(plant.value), F.lit(plant.after))
        return rows.select("id", F.explode(spans.detector_spans(text, plant.pattern)).alias("s")).select("id", "s.start", "s.end", "s.value")

    return query


def _planted_sql(name: str) -> str:
    plant = PLANTED[name]
    start, whole = len(plant.before), len(plant.before + plant.lead)
    # a pattern without the group gives the whole match
    lead = plant.lead if "(?P<value>" not in plant.pattern else ""
    return f"""WITH v AS (SELECT id, {plant.value} AS value FROM (SELECT c_custkey AS id FROM customer))
SELECT id, CAST({start} AS INTEGER) AS start, CAST({whole} + length(value) AS INTEGER) AS "end", '{lead}' || value AS value FROM v"""


# ---------------------------------------------------------------- VIN, model candidates


_VIN_BODY = f"'WVWZZZ1J' || {_choice('0', '1', '2', '3', '4', '5', '6', '7', '8', '9', 'X')} || chr(CAST(65 + id % 8 AS INT)) || 'W' || {_number('id * 7919', 6)}"


def check_vin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    return rows.select("id", F.expr(_VIN_BODY).alias("value")).withColumn("valid", checksums.vin(F.col("value")))


VIN_SQL = f"""WITH v AS (SELECT id, {_VIN_BODY} AS value FROM (SELECT c_custkey AS id FROM customer)),
t AS (SELECT *, translate(value, '{"".join(fixed.VIN_LETTERS)}', '{"".join(map(str, fixed.VIN_LETTERS.values()))}') AS t FROM v),
s AS (SELECT *, ({" + ".join(f"{w} * CAST(substr(t, {i + 1}, 1) AS INTEGER)" for i, w in enumerate(fixed.VIN_WEIGHTS) if w)}) % 11 AS s FROM t)
SELECT id, value, substr(value, 9, 1) = CASE WHEN s = 10 THEN 'X' ELSE CAST(s AS VARCHAR) END AS valid FROM s"""


def uncovered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of odd line items of an order that overlap none of its even ones: the anti-join of model candidates."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("line"), (F.col("l_partkey") % 200).cast("int").alias("start"))
    rows = rows.withColumn("end", F.col("start") + 10 + F.col("line"))
    return review.uncovered(rows.where("line % 2 = 1"), rows.where("line % 2 = 0").select("id", "start", "end"), ["id"])


UNCOVERED_SQL = """WITH r AS (SELECT l_orderkey AS id, CAST(l_linenumber AS INTEGER) AS line, CAST(l_partkey % 200 AS INTEGER) AS start FROM lineitem),
s AS (SELECT *, start + 10 + line AS "end" FROM r)
SELECT * FROM s WHERE line % 2 = 1 AND NOT EXISTS (SELECT 1 FROM s AS o WHERE o.line % 2 = 0 AND o.id = s.id AND s.start < o."end" AND o.start < s."end")"""


def queries() -> dict:
    return {f"find_{name}": _planted(name) for name in PLANTED} | {"check_vin": check_vin, "uncovered_candidates": uncovered_candidates}


def oracle_sql() -> dict:
    return {f"find_{name}": _planted_sql(name) for name in PLANTED} | {"check_vin": VIN_SQL, "uncovered_candidates": UNCOVERED_SQL}
