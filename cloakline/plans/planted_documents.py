"""Whole documents made from keys, with true entities, near misses and words to miss: SQL knows what the plan must do."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline.functions import fixed
from cloakline.operators import evaluate, label, review
from cloakline.operators.spread import spread
from cloakline.plans import deidentify


@dataclass(frozen=True)
class Slot:
    """An entity: category, SQL of its value (of id), SQL of what makes two values one, the text around that belongs to
    the replaced span, and priority, score and detector of its detection."""

    category: str
    value: str
    same: str | None = None
    lead: str = ""
    priority: int = 100
    score: float = 1.0
    detector: str | None = None


def _pad(expression: str, digits: int) -> str:
    return f"lpad(CAST(({expression}) % {10**digits} AS STRING), {digits}, '0')"


def _dot(body: str, weights: tuple) -> str:
    return "(" + " + ".join(f"{w} * CAST(substr({body}, {i + 1}, 1) AS INT)" for i, w in enumerate(weights)) + ")"


_PESEL_BODY = _pad("id * 7919 + 4405140135", 10)
_PESEL_CHECK = f"((10 - {_dot(_PESEL_BODY, fixed.PESEL_WEIGHTS)} % 10) % 10)"
_PESEL = f"{_PESEL_BODY} || CAST({_PESEL_CHECK} AS STRING)"
_WRONG = f"{_PESEL_BODY} || CAST(({_PESEL_CHECK} + 3) % 10 AS STRING)"
_REGON_BODY = _pad("id * 15485863 + 1234567", 8)
_REGON = f"{_REGON_BODY} || CAST({_dot(_REGON_BODY, fixed.REGON_WEIGHTS)} % 11 % 10 AS STRING)"
_PHONE = f"'6' || {_pad('id * 31', 2)} || '-' || {_pad('id * 37', 3)} || '-' || {_pad('id * 41', 3)}"
_PHONE_ABROAD = f"'+48 6' || {_pad('id * 31', 2)} || ' ' || {_pad('id * 37', 3)} || ' ' || {_pad('id * 41', 3)}"
_PHONE_DIGITS = f"'6' || {_pad('id * 31', 2)} || {_pad('id * 37', 3)} || {_pad('id * 41', 3)}"
_MAIL = "'osoba' || CAST(id AS STRING) || '@poczta.pl'"
_MAIL_AGAIN = "'Osoba' || CAST(id AS STRING) || '@Poczta.pl'"
_CASE = "'II K ' || CAST(1 + id % 9999 AS STRING) || '/' || CAST(10 + id % 15 AS STRING)"
_AMOUNT = "CAST(100 + id % 900 AS STRING) || ',50 zł'"
_DATE = "lpad(CAST(1 + id % 28 AS STRING), 2, '0') || '.' || lpad(CAST(1 + id % 12 AS STRING), 2, '0') || '.2024'"
_STREET = "'ul. Długa ' || CAST(1 + id % 300 AS STRING)"
_KRS_BODY = _pad("id * 104729", 9)
_KRS = f"{_KRS_BODY} || CAST(({_dot(_KRS_BODY, fixed.NIP_WEIGHTS)} % 11 + 5) % 10 AS STRING)"  # no NIP as well

#: Three kinds of documents, each of blocks, each of text and slots.
KINDS = (
    (
        ("Powódka podaje PESEL ", Slot("pesel", _PESEL, detector="pesel"), ", telefon ", Slot("phone", _PHONE, _PHONE_DIGITS, priority=80), " i pisze z adresu ", Slot("email", _MAIL, priority=80), ", sprawa ", Slot("case_number", _CASE, priority=90), "."),
        ("Zapis ", _WRONG, " to nie numer, kod 1234 też nie. Oddzwonić na ", Slot("phone", _PHONE_ABROAD, _PHONE_DIGITS, priority=80), " w sprawie kwoty ", Slot("amount", _AMOUNT, priority=10), "."),
        ("Nic tu nie ma.",),
    ),
    (
        ("Spółka, REGON ", Slot("regon", _REGON, detector="regon"), ", wpisana jako ", Slot("krs", _KRS, lead="KRS: ", priority=90), ", mieści się przy ", Slot("address", _STREET, priority=85), ", a pismo nosi datę ", Slot("date", _DATE, priority=10), "."),
        ("Serwer 300.300.300.300 milczy, a wpis bez numeru KRS i podpis obok Zubrowskim nic nie znaczą. Pisać: ", Slot("email", _MAIL, priority=80), " albo ", Slot("email", _MAIL_AGAIN, _MAIL, priority=80), " jeszcze."),
    ),
    (("Spotkanie odbyło się rano, mówił o tym Wiertlak oraz inni.",), ("Bez numerów, bez adresów. Koniec.",)),
)


def _rows(part: str) -> str:
    """SQL with a row per piece of text: id, block_ix, nth, piece, and of slots lead, category, same, priority, score, detector."""
    rows = []
    for kind, blocks in enumerate(KINDS):
        for block, pieces in enumerate(blocks):
            for nth, piece in enumerate(pieces):
                slot = piece if isinstance(piece, Slot) else None
                text = f"'{slot.lead}' || {slot.value}" if slot else piece if piece is _WRONG else f"'{piece}'"
                facts = (f"'{slot.category}'", f"lower({slot.same or slot.value})", str(slot.priority), str(slot.score), f"'{slot.detector}'" if slot.detector else "CAST(NULL AS STRING)") if slot else ("CAST(NULL AS STRING)",) * 2 + ("0", "0.0", "CAST(NULL AS STRING)")
                value = slot.value if slot else "''"
                rows.append(f"SELECT id, {block} AS block_ix, {nth} AS nth, {text} AS piece, {value} AS value, {facts[0]} AS category, {facts[1]} AS same, {facts[2]} AS priority, {facts[3]} AS score, {facts[4]} AS detector FROM keys WHERE id % {len(KINDS)} = {kind}")
    return f"WITH keys AS (SELECT c_custkey AS id FROM customer), pieces AS ({' UNION ALL '.join(rows)}) {part}"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id")), "id", each=1 << 16)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, block_ix, text) of the documents."""
    keys = _customers(spark, sf_dir)
    texts = [[" || ".join(f"'{p.lead}' || {p.value}" if isinstance(p, Slot) else p if p is _WRONG else f"'{p}'" for p in pieces) for pieces in parts] for parts in KINDS]
    kinds = " ".join(f"WHEN {kind} THEN array({', '.join(parts)})" for kind, parts in enumerate(texts))
    return keys.selectExpr("id as doc_id", f"posexplode(CASE id % {len(KINDS)} {kinds} END) as (block_ix, text)")


_PLACED = """, placed AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY id, block_ix ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM pieces)"""
_NUMBERED = f"""{_PLACED}, first AS (SELECT *, min(block_ix * 100000 + start) OVER (PARTITION BY id, category, same) AS first FROM placed),
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY id, category ORDER BY first) AS number FROM first)"""


def detect_planted(spark, sf_dir):
    found = deidentify.detect(blocks(spark, sf_dir))
    return found.select("doc_id", "block_ix", F.explode("resolved").alias("d")).select("doc_id", "block_ix", *[F.col(f"d.{c}").alias(c) for c in ("start", "end", "category", "value", "priority", "score")])


DETECT_SQL = _rows(f"""{_PLACED} SELECT id AS doc_id, CAST(block_ix AS INTEGER) AS block_ix, CAST(start AS INTEGER) AS start, CAST(start + length(piece) AS INTEGER) AS "end", category,
  value, CAST(priority AS INTEGER) AS priority, CAST(score AS DOUBLE) AS score FROM placed WHERE category IS NOT NULL""".strip())


def anonymize_planted(spark, sf_dir):
    return deidentify.anonymize(blocks(spark, sf_dir)).select("doc_id", "block_ix", F.col("anonymized").alias("text"))


def _label_sql() -> str:
    names = " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in fixed.LABELS.items())
    numbered = ", ".join(f"'{c}'" for c, p in fixed.POLICIES.items() if p == fixed.NUMBER)
    return f"CASE WHEN category IN ({numbered}) THEN '[' || CASE category {names} END || ' ' || CAST(number AS VARCHAR) || ']' WHEN category = 'amount' THEN '[kwota]' ELSE piece END"


_TEXT_SQL = f"""{_NUMBERED}, texts AS (SELECT id AS doc_id, CAST(block_ix AS INTEGER) AS block_ix, string_agg({_label_sql()}, '' ORDER BY nth) AS text FROM numbered GROUP BY ALL)"""
ANONYMIZE_SQL = _rows(f"{_TEXT_SQL} SELECT * FROM texts".strip())


def results_planted(spark, sf_dir):
    out = deidentify.results(blocks(spark, sf_dir))
    missed = F.coalesce(F.size("potentially_missed"), F.lit(0))
    return out.select("doc_id", "text", F.col("entity_count").cast("long").alias("entity_count"), F.col("leaks").cast("long").alias("leaks"), F.when(missed < 0, 0).otherwise(missed).cast("long").alias("missed"))


RESULTS_SQL = _rows(f"""{_TEXT_SQL}, whole AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY block_ix) AS text FROM texts GROUP BY doc_id),
counts AS (SELECT id AS doc_id, count(DISTINCT category || '|' || same) AS n FROM pieces WHERE category NOT IN ('amount', 'date') GROUP BY id)
SELECT w.doc_id, w.text, coalesce(n, 0) AS entity_count, CAST(0 AS BIGINT) AS leaks, CAST(CASE WHEN w.doc_id % {len(KINDS)} IN (1, 2) THEN 1 ELSE 0 END AS BIGINT) AS missed
FROM whole AS w LEFT JOIN counts AS c USING (doc_id)""".strip())


def missed_planted(spark, sf_dir):
    return review.potentially_missed(deidentify.detect(blocks(spark, sf_dir)), ["doc_id", "block_ix"]).select("doc_id", "block_ix", "start", "token")


def _missed_sql() -> str:
    words = {1: (1, "Zubrowskim"), 2: (0, "Wiertlak")}
    parts = [f"SELECT c_custkey AS doc_id, CAST({block} AS INTEGER) AS block_ix, CAST({KINDS[kind][block][0].index(word)} AS INTEGER) AS start, '{word.lower()}' AS token FROM customer WHERE c_custkey % {len(KINDS)} = {kind}" for kind, (block, word) in words.items()]
    return " UNION ALL ".join(parts)


def leaks_planted(spark, sf_dir):
    """What a leak check says of texts that nobody has rewritten, and of those that were: the first are full of findings."""
    plain = blocks(spark, sf_dir)
    clean = deidentify.anonymize(plain).select("doc_id", F.col("anonymized").alias("text"))
    both = plain.select("doc_id", "text", F.lit("plain").alias("state")).unionByName(clean.withColumn("state", F.lit("rewritten")))
    return review.leak_findings(both, ["doc_id", "state"]).select("doc_id", "state", "detector", "findings")


LEAKS_SQL = _rows("SELECT id AS doc_id, 'plain' AS state, detector, count(*) AS findings FROM pieces WHERE detector IS NOT NULL GROUP BY ALL")


def planted_precision(spark, sf_dir):
    """Replacements in all, and those that overlap what was planted: the near misses would show as a difference."""
    plain = blocks(spark, sf_dir)
    replaced = deidentify.replacements(deidentify.detect(plain)).where("label is not null").select(F.concat_ws("-", "doc_id", "block_ix").alias("doc_id"), "start", "end")
    keys = plain.where("block_ix = 0").select("doc_id")
    truth = None
    for kind, parts in enumerate(KINDS):
        for block, pieces in enumerate(parts):
            before = "''"
            for p in pieces:
                text = f"'{p.lead}' || {p.value}" if isinstance(p, Slot) else p if p is _WRONG else f"'{p}'"
                if isinstance(p, Slot) and p.category != "date":
                    one = keys.where(f"doc_id % {len(KINDS)} = {kind}").withColumn("id", F.col("doc_id")).selectExpr(f"concat_ws('-', doc_id, {block}) as doc_id", f"length({before}) as start", f"length({before} || {text}) as end")
                    truth = one if truth is None else truth.unionByName(one)
                before = f"{before} || {text}"
    out = evaluate.precision(truth, replaced)
    return out.select(F.col("replacements").cast("long").alias("replacements"), F.col("planted").cast("long").alias("planted"))


PRECISION_SQL = _rows("SELECT count(*) AS replacements, count(*) AS planted FROM pieces WHERE category IS NOT NULL AND category <> 'date'")


# ---------------------------------------------------------------- noise of text recognition

_NOISE = {"pesel": evaluate.pesel, "nip": evaluate.nip, "regon": evaluate.regon, "iban": evaluate.iban, "id_card": evaluate.id_card, "vehicle_vin": evaluate.vin}


def golden_noise(spark, sf_dir):
    """Values of all six checked categories with one digit read as a letter: whether the plan replaces them."""
    keys = _customers(spark, sf_dir)
    made = F.array(*[F.struct(F.lit(category).alias("category"), maker(F.col("id")).alias("value")) for category, maker in _NOISE.items()])
    rows = keys.select("id", F.explode(made).alias("v")).select("id", "v.category", evaluate.noised(F.col("v.value"), F.col("id")).alias("value"))
    rows = rows.select(F.concat_ws("-", "id", "category").alias("doc_id"), "id", "category", "value", F.lit(0).alias("block_ix"), F.concat(F.lit("zapis: "), "value", F.lit(".")).alias("text"))
    spans = label.labelled(label.numbered(deidentify.detect(rows).select("doc_id", "block_ix", "id", F.col("category").alias("planted"), F.explode("resolved").alias("d")).select("doc_id", "block_ix", "id", "planted", "d.start", "d.end", "d.category", "d.value")))
    whole = spans.where("label is not null and start = 7").select("doc_id").distinct()
    out = rows.join(whole.withColumn("hit", F.lit(1)), "doc_id", "left")
    return out.groupBy("category").agg(F.count("*").alias("planted"), F.coalesce(F.sum("hit"), F.lit(0)).alias("replaced"))


NOISE_SQL = " UNION ALL ".join(f"SELECT '{c}' AS category, count(*) AS planted, count(*) AS replaced FROM customer" for c in _NOISE)


def queries() -> dict:
    return {
        "detect_planted": detect_planted, "anonymize_planted": anonymize_planted, "results_planted": results_planted, "missed_planted": missed_planted,
        "leaks_planted": leaks_planted, "planted_precision": planted_precision, "golden_noise": golden_noise,
    }


def oracle_sql() -> dict:
    return {
        "detect_planted": DETECT_SQL, "anonymize_planted": ANONYMIZE_SQL, "results_planted": RESULTS_SQL, "missed_planted": _missed_sql(),
        "leaks_planted": LEAKS_SQL, "planted_precision": PRECISION_SQL, "golden_noise": NOISE_SQL,
    }
