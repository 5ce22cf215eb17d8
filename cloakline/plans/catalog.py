"""Registry of the engine's named queries and of their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline.functions import canonical, checksums, dates, fixed, text
from cloakline.operators import detectors, evaluate, label, names, resolve, review, spans
from cloakline.operators.spread import spread
from cloakline.plans import deidentify, parts, planted, planted_documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _blocks(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return spread(rows, "doc_id", "text", each=1 << 20).select("doc_id", F.lit(0).alias("block_ix"), "text")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize_documents(spark, sf_dir)


# ---------------------------------------------------------------- documents and conversations


def anonymize_documents(spark, sf_dir):
    return deidentify.anonymize(_blocks(spark, sf_dir)).select("doc_id", F.col("anonymized").alias("text"))


def detect_documents(spark, sf_dir):
    found = deidentify.detect(_blocks(spark, sf_dir))
    return found.select("doc_id", F.explode("resolved").alias("d")).select("doc_id", *[F.col(f"d.{c}").alias(c) for c in ("start", "end", "category", "value", "priority", "score")])


def _single(name: str):
    def query(spark, sf_dir):
        spec = detectors.BY_NAME[name]
        rows = _table(spark, sf_dir, "documents").select("doc_id", F.explode(spans.detector_spans(F.col("text"), spec.pattern)).alias("s")).select("doc_id", "s.start", "s.end", "s.value")
        return rows.where(checksums.ip(F.col("value"))) if name == "ip" else rows

    return query


def _single_sql(pattern: str, group: int = 0, where: str = "true") -> str:
    return f"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS w, regexp_extract_all(text, '{pattern}', {group}) AS v, string_split_regex(text, '{pattern}') AS g FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w, v, g FROM m WHERE len(w) > 0),
p AS (SELECT doc_id, v[i] AS value, w[i] AS whole, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS start FROM s)
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(start + length(whole) AS INTEGER) AS "end", value FROM p WHERE {where}"""


IP_SQL = "(value NOT LIKE '%.%' OR list_bool_and(list_transform(string_split(value, '.'), lambda x: CAST(x AS INTEGER) <= 255)))"


def redact_email(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", fixed.EMAIL, "[adres e-mail]").alias("text"))


def number_conversations(spark, sf_dir):
    """Numbers of planted e-mail addresses over the turns of conversations."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_ix"))
    mail = F.concat(F.lit("User"), F.pmod(F.col("block_ix") * 7 + F.col("doc_id"), F.lit(3)).cast("string"), F.lit("@Example.com"))
    rows = turns.select("doc_id", "block_ix", F.lit(0).alias("start"), F.lit("email").alias("category"), mail.alias("value"))
    return label.labelled(label.numbered(rows)).select("doc_id", "block_ix", "value", F.col("number").cast("long").alias("number"), "label")


NUMBER_SQL = """
WITH r AS (SELECT conv_id AS doc_id, turn AS block_ix, 'User' || CAST((turn * 7 + conv_id) % 3 AS VARCHAR) || '@Example.com' AS value FROM conversations),
f AS (SELECT *, min(block_ix) OVER (PARTITION BY doc_id, lower(value)) AS first FROM r)
SELECT doc_id, block_ix, value, dense_rank() OVER (PARTITION BY doc_id ORDER BY first) AS number,
  '[adres e-mail ' || CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY first) AS VARCHAR) || ']' AS label FROM f"""


def polish_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.looks_polish(F.col("text")).alias("polish"))


POLISH_SQL = f"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}]+') AS w FROM documents)
SELECT doc_id, len(w) < 30 OR regexp_matches(text, '[ąćęłńóśźżĄĆĘŁŃÓŚŹŻ]')
  OR len(list_filter(w, lambda x: x IN ({', '.join(f"'{x}'" for x in fixed.POLISH_WORDS)}))) / greatest(len(w), 1) >= 0.03 AS polish FROM w"""


def reflow_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.reflowed(F.col("text")).alias("text"))


def page_layers(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.trustworthy_layer(F.col("text")).alias("trusted"))


def missed_words(spark, sf_dir):
    found = deidentify.detect(_blocks(spark, sf_dir))
    return review.potentially_missed(found, ["doc_id"]).select("doc_id", "start", "token", "note")


def leak_check(spark, sf_dir):
    out = deidentify.anonymize(_blocks(spark, sf_dir)).select("doc_id", F.col("anonymized").alias("text"))
    return review.leak_findings(out, ["doc_id"])


def document_results(spark, sf_dir):
    return deidentify.results(_blocks(spark, sf_dir)).select("doc_id", "text", "entity_count", "polish", "leaks")


def plates(spark, sf_dir):
    return _single("plate")(spark, sf_dir).where(checksums.plate(F.col("value")))


# ---------------------------------------------------------------- identifiers made from keys


def _keys(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))


def check_pesel(spark, sf_dir):
    body = F.lpad((F.col("id") * 7919 + 44051401).cast("string"), 10, "0")
    return _keys(spark, sf_dir).select("id", F.concat(body, (F.col("id") % 10).cast("string")).alias("value")).withColumn("valid", checksums.pesel(F.col("value")))


def check_nip(spark, sf_dir):
    body = F.lpad((F.col("id") * 104729 + 526000124).cast("string"), 9, "0")
    return _keys(spark, sf_dir).select("id", F.concat(body, (F.col("id") % 10).cast("string")).alias("value")).withColumn("valid", checksums.nip(F.col("value")))


def check_regon(spark, sf_dir):
    body = F.lpad(((F.col("id") * 15485863 + 1234567) % 100000000).cast("string"), 8, "0")
    return _keys(spark, sf_dir).select("id", F.concat(body, (F.col("id") % 10).cast("string")).alias("value")).withColumn("valid", checksums.regon(F.col("value")))


def check_iban(spark, sf_dir):
    body = F.concat(F.lpad((F.col("id") % 97).cast("string"), 2, "0"), F.lpad((F.col("id") * 982451653 + 1090101400).cast("string"), 24, "0"))
    return _keys(spark, sf_dir).select("id", body.alias("value")).withColumn("valid", checksums.iban(F.col("value")))


def check_id_card(spark, sf_dir):
    letters = F.concat(*[F.chr(65 + F.pmod(F.floor(F.col("id") / d), F.lit(26))) for d in (1, 7, 31)])
    return _keys(spark, sf_dir).select("id", F.concat(letters, F.lpad((F.col("id") * 7919 % 1000000).cast("string"), 6, "0")).alias("value")).withColumn("valid", checksums.id_card(F.col("value")))


def check_land_register(spark, sf_dir):
    value = F.concat(F.lit("WA1M/"), F.lpad((F.col("id") * 7919 % 100000000).cast("string"), 8, "0"), F.lit("/"), (F.col("id") % 10).cast("string"))
    return _keys(spark, sf_dir).select("id", value.alias("value")).withColumn("valid", checksums.land_register(F.col("value")))


def _weighted_sql(weights, offset=0) -> str:
    return " + ".join(f"{w} * CAST(substr(value, {i + 1 + offset}, 1) AS INTEGER)" for i, w in enumerate(weights))


PESEL_SQL = f"""WITH v AS (SELECT c_custkey AS id, lpad(CAST(c_custkey * 7919 + 44051401 AS VARCHAR), 10, '0') || CAST(c_custkey % 10 AS VARCHAR) AS value FROM customer)
SELECT id, value, (10 - ({_weighted_sql(fixed.PESEL_WEIGHTS)}) % 10) % 10 = CAST(substr(value, 11, 1) AS INTEGER) AS valid FROM v"""
NIP_SQL = f"""WITH v AS (SELECT c_custkey AS id, lpad(CAST(c_custkey * 104729 + 526000124 AS VARCHAR), 9, '0') || CAST(c_custkey % 10 AS VARCHAR) AS value FROM customer)
SELECT id, value, length(value) = 10 AND ({_weighted_sql(fixed.NIP_WEIGHTS)}) % 11 = CAST(substr(value, 10, 1) AS INTEGER) AS valid FROM v"""
REGON_SQL = f"""WITH v AS (SELECT c_custkey AS id, lpad(CAST((c_custkey * 15485863 + 1234567) % 100000000 AS VARCHAR), 8, '0') || CAST(c_custkey % 10 AS VARCHAR) AS value FROM customer)
SELECT id, value, ({_weighted_sql(fixed.REGON_WEIGHTS)}) % 11 % 10 = CAST(substr(value, 9, 1) AS INTEGER) AS valid FROM v"""
IBAN_SQL = """WITH v AS (SELECT c_custkey AS id, lpad(CAST(c_custkey % 97 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey * 982451653 + 1090101400 AS VARCHAR), 24, '0') AS value FROM customer)
SELECT id, value, CAST(substr(value, 3) || '2521' || substr(value, 1, 2) AS HUGEINT) % 97 = 1 AS valid FROM v"""
ID_CARD_SQL = f"""WITH v AS (SELECT c_custkey AS id, chr(CAST(65 + c_custkey % 26 AS INTEGER)) || chr(CAST(65 + (c_custkey // 7) % 26 AS INTEGER)) || chr(CAST(65 + (c_custkey // 31) % 26 AS INTEGER))
  || lpad(CAST(c_custkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS value FROM customer)
SELECT id, value, (7 * (ascii(substr(value, 1, 1)) - 55) + 3 * (ascii(substr(value, 2, 1)) - 55) + (ascii(substr(value, 3, 1)) - 55) + {_weighted_sql(fixed.ID_CARD_WEIGHTS[3:], 3)}) % 10 = CAST(substr(value, 4, 1) AS INTEGER) AS valid FROM v"""
LAND_SQL = """WITH v AS (SELECT c_custkey AS id, 'WA1M/' || lpad(CAST(c_custkey * 7919 % 100000000 AS VARCHAR), 8, '0') || '/' || CAST(c_custkey % 10 AS VARCHAR) AS value FROM customer),
d AS (SELECT id, value, reverse('3210122' || substr(value, 6, 8)) AS r FROM v)
SELECT id, value, list_sum(list_transform(range(1, length(r) + 1), lambda i: CAST(substr(r, i, 1) AS INTEGER) * [1, 3, 7][(i - 1) % 3 + 1])) % 10 = CAST(substr(value, 15, 1) AS INTEGER) AS valid FROM d"""


def canonical_forms(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lpad((F.col("c_custkey") * 32452843 % 1000000000).cast("string"), 9, "6").alias("c_phone"), "c_name")
    return rows.select("id", canonical.phone(F.concat(F.lit("+48 "), F.col("c_phone"))).alias("phone"), canonical.alnum(F.col("c_name")).alias("alnum"), canonical.email(F.concat(F.lit("  "), F.col("c_name"), F.lit("@Example.COM"))).alias("email"), canonical.squeezed(F.concat(F.col("c_name"), F.lit("  \t x "))).alias("plain"))


CANONICAL_SQL = """WITH v AS (SELECT c_custkey AS id, c_name, regexp_replace(regexp_replace('+48 ' || lpad(CAST(c_custkey * 32452843 % 1000000000 AS VARCHAR), 9, '6'), '[^0-9]+', '', 'g'), '^0048', '') AS d FROM customer)
SELECT id, CASE WHEN length(d) = 11 AND d LIKE '48%' THEN substr(d, 3, 9) ELSE d END AS phone, upper(regexp_replace(c_name, '[^0-9A-Za-z]+', '', 'g')) AS alnum,
  lower(trim('  ' || c_name || '@Example.COM')) AS email, lower(c_name || ' x') AS plain FROM v"""


def shift_dates(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("value"))
    return rows.select("id", "value", dates.shifted(F.col("value"), (F.col("id") % 105 - 52) * 7).alias("shifted"))


SHIFT_SQL = """SELECT o_orderkey AS id, strftime(o_orderdate, '%d.%m.%Y') AS value,
  strftime(CAST(o_orderdate AS DATE) + CAST((o_orderkey % 105 - 52) * 7 AS INTEGER), '%d.%m.%Y') AS shifted FROM orders"""


def find_amounts(spark, sf_dir):
    sentence = F.concat(F.lit("Kwota "), F.regexp_replace(F.format_number("l_extendedprice", 0), ",", " "), F.lit(",00 zł do zapłaty."))
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), sentence.alias("text"))
    return rows.select("id", "line", F.explode(spans.detector_spans(F.col("text"), fixed.AMOUNT)).alias("s")).select("id", "line", "s.start", "s.value")


AMOUNT_SQL = """SELECT l_orderkey AS id, l_linenumber AS line, CAST(6 AS INTEGER) AS start,
  replace(format('{:,}', CAST(round_even(l_extendedprice, 0) AS BIGINT)), ',', ' ') || ',00 zł' AS value FROM lineitem"""


def surname_forms(spark, sf_dir):
    rows = _table(spark, sf_dir, "nation").select("n_name")
    return rows.select(F.col("n_name").alias("name"), F.explode(names.surname_forms(F.lower("n_name"))).alias("form"))


def _inflection_sql() -> str:
    cases = "".join(f" WHEN name LIKE '%{e}' THEN list_transform([{', '.join(repr(s) for s in fs)}], lambda s: substr(name, 1, length(name) - {c}) || s)" for e, c, fs in fixed.INFLECTION if e)
    last = ", ".join(repr(s) for s in fixed.INFLECTION[-1][2])
    return f"WITH v AS (SELECT n_name, lower(n_name) AS name FROM nation), f AS (SELECT n_name, name, CASE{cases} ELSE list_transform([{last}], lambda s: name || s) END AS fs FROM v) SELECT n_name AS name, unnest(list_distinct(list_append(fs, name))) AS form FROM f"


def golden_recall(spark, sf_dir):
    """Share of planted entities that the whole plan replaces, by category."""
    docs = evaluate.golden(spread(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", each=1 << 16))
    truth = docs.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.category", "e.start", "e.end")
    blocks = docs.select("doc_id", F.lit(0).alias("block_ix"), "text")
    replaced = deidentify.replacements(deidentify.detect(blocks)).where("label is not null")
    return evaluate.recall(truth, replaced)


def _golden_sql() -> str:
    """Every planted entity is found."""
    kinds = sorted(evaluate.TEMPLATES)
    rows = [f"SELECT '{name}' AS category, count(*) AS planted, count(*) AS matched FROM orders WHERE o_orderkey % {len(kinds)} IN ({', '.join(str(i) for i, k in enumerate(kinds) if '{' + name + '}' in evaluate.TEMPLATES[k])})" for name in evaluate.MAKERS]
    return " UNION ALL ".join(rows)


def overlap_folds(spark, sf_dir):
    """Resolution and collapsing of spans made from line items of an order."""
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 40).cast("int").alias("start"), (F.col("l_quantity").cast("int") % 20 + 1).alias("n"), F.col("l_linenumber").cast("int").alias("seq"))
    one = F.struct("start", (F.col("start") + F.col("n")).alias("end"), F.lit("x").alias("category"), F.lit("").alias("value"), (F.col("seq") % 3 * 10).alias("priority"), (F.col("seq") % 2 == 0).alias("nestable"), F.lit(1.0).alias("score"), "seq")
    sets = rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(one).alias("d")).withColumn("resolved", resolve.resolved(F.col("d")))
    return sets.select("id", F.size("resolved").alias("resolved"), F.size(resolve.collapsed(F.col("resolved"))).alias("collapsed"))


def small_cells(spark, sf_dir):
    rows = number_conversations(spark, sf_dir).withColumn("category", F.lit("email"))
    return review.small_cells(label.entity_counts(rows)).select("doc_id", F.array_join("rare", ",").alias("rare"))


SMALL_SQL = f"SELECT doc_id, 'email' AS rare FROM ({NUMBER_SQL}) GROUP BY doc_id HAVING max(number) <= 1"


def hmac_keys(spark, sf_dir):
    rows = _table(spark, sf_dir, "nation").select("n_name")
    return rows.select(F.col("n_name").alias("name"), canonical.hmac_sha256(F.encode(F.lit("salt"), "utf-8"), F.concat(F.lit("person:"), F.lower("n_name"))).alias("key"))


# ---------------------------------------------------------------- SQL of the functions over whole texts

# other letters, digits and white space than ASCII's become one of these, so that \\b and \\s mean what they mean in Unicode
_ASCII_TEXT = "regexp_replace(regexp_replace(text, '[^\\x00-\\x7F\\pL\\pM\\pN]', chr(1), 'g'), '[^\\x00-\\x7F]', 'x', 'g')"
PLATES_SQL = f"""
WITH t AS (SELECT doc_id, text, {_ASCII_TEXT} AS u FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, text, regexp_extract_all(u, '\\b[A-Z]{{2,3}}\\s?[A-Z0-9]{{4,5}}\\b') AS w, string_split_regex(u, '\\b[A-Z]{{2,3}}\\s?[A-Z0-9]{{4,5}}\\b') AS g FROM t),
s AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m WHERE len(w) > 0),
p AS (SELECT doc_id, text, length(w[i]) AS n, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS start FROM s)
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(start + n AS INTEGER) AS "end", substr(text, CAST(start AS BIGINT) + 1, n) AS value FROM p
WHERE length(regexp_replace(substr(text, CAST(start AS BIGINT) + 1, n), '\\s', '', 'g')) BETWEEN 5 AND 8"""

LAYERS_SQL = f"""
WITH t AS (SELECT doc_id, text, length(regexp_replace(text, '[^\\pL\\pN\\s\\x0B]', '', 'g')) / greatest(length(text), 1) AS share, length(regexp_replace(text, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g')) AS n,
  regexp_replace(text, '[^\\x00-\\x7F\\pL\\pM\\pN]', ' ', 'g') AS u FROM documents)
SELECT doc_id, CASE WHEN text IS NULL THEN share >= 0.85 WHEN n = 0 THEN false WHEN n < 20 THEN true WHEN share < 0.6 THEN false
  WHEN regexp_matches(lower(u), '(?:^|[^\\pL\\pM\\pN_])(?:{'|'.join(fixed.PAGE_WORDS)})(?:$|[^\\pL\\pM\\pN_])') THEN true ELSE share >= 0.85 END AS trusted FROM t"""

REFLOW_SQL = """
WITH RECURSIVE l AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, chr(13) || chr(10), chr(10), 'g'), chr(13), chr(10), 'g'), chr(10)) AS x FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, list_transform(x, lambda y: regexp_replace(y, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g')) AS x FROM l),
r AS (SELECT doc_id, x, 0 AS i, '' AS now, CAST([] AS VARCHAR[]) AS done FROM p
  UNION ALL
  SELECT doc_id, x, i + 1, CASE WHEN shut THEN '' ELSE held END, CASE WHEN shut AND held <> '' THEN list_append(done, held) ELSE done END FROM (
    SELECT *, line = '' OR regexp_matches(line, '[.:;!?…”"''\\)\\]]$') AS shut, CASE WHEN line = '' THEN now WHEN now = '' THEN line
      WHEN regexp_matches(now, '-\\s*$') THEN regexp_replace(now, '-\\s*$', '') || line ELSE now || ' ' || line END AS held
    FROM (SELECT *, x[i + 1] AS line FROM r WHERE i < len(x)) AS a) AS b)
SELECT doc_id, array_to_string(CASE WHEN now <> '' THEN list_append(done, now) ELSE done END, chr(10) || chr(10)) AS text FROM r WHERE i = len(x)
UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL"""


def _hmac_sql(key: bytes = b"salt") -> str:
    padded = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in padded).hex() for x in (0x36, 0x5C))
    return f"SELECT n_name AS name, sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode('person:' || lower(n_name))))) AS key FROM nation"


HMAC_SQL = _hmac_sql()

OVERLAP_SQL = """
WITH RECURSIVE s AS (SELECT l_orderkey AS id, CAST(l_partkey % 40 AS INTEGER) AS a, CAST(l_partkey % 40 + CAST(trunc(l_quantity) AS INTEGER) % 20 + 1 AS INTEGER) AS b, CAST(l_linenumber AS INTEGER) AS seq FROM lineitem),
t AS (SELECT id, {'a': a, 'b': b, 'p': seq % 3 * 10, 'n': seq % 2 = 0, 's': seq} AS d FROM s),
o AS (SELECT id, list(d ORDER BY d.p DESC, d.a - d.b, d.a, d.s) AS x FROM t GROUP BY id),
r AS (SELECT id, x, 0 AS i, x[1:0] AS held FROM o
  UNION ALL
  SELECT id, x, i + 1, CASE WHEN len(c) = 0 OR (len(list_filter(c, lambda h: NOT ((h.a <= d.a AND d.b <= h.b OR d.a <= h.a AND h.b <= d.b) AND NOT (h.a = d.a AND h.b = d.b)))) = 0
      AND (d.n OR len(list_filter(c, lambda h: h.n)) > 0)) THEN list_append(held, d) ELSE held END
  FROM (SELECT *, list_filter(held, lambda h: h.a < d.b AND d.a < h.b) AS c FROM (SELECT *, x[i + 1] AS d FROM r WHERE i < len(x)) AS q) AS u),
v AS (SELECT id, len(held) AS resolved, list_transform(held, lambda h: h) AS y FROM r WHERE i = len(x)),
z AS (SELECT id, resolved, (SELECT list(e ORDER BY e.a, e.a - e.b, e.s) FROM (SELECT unnest(y) AS e)) AS y FROM v),
k AS (SELECT id, resolved, y, 0 AS i, y[1:0] AS held FROM z
  UNION ALL
  SELECT id, resolved, y, i + 1, CASE WHEN len(c) = 0 OR d.p > list_max(list_transform(c, lambda h: h.p)) THEN list_append(list_filter(held, lambda h: NOT (h.a < d.b AND d.a < h.b)), d) ELSE held END
  FROM (SELECT *, list_filter(held, lambda h: h.a < d.b AND d.a < h.b) AS c FROM (SELECT *, y[i + 1] AS d FROM k WHERE i < len(y)) AS q) AS u)
SELECT id, CAST(resolved AS INTEGER) AS resolved, CAST(len(held) AS INTEGER) AS collapsed FROM k WHERE i = len(y)"""


def queries() -> dict:
    return {
        "anonymize_documents": anonymize_documents, "detect_documents": detect_documents, "document_results": document_results,
        "detect_email": _single("email"), "detect_ip": _single("ip"), "detect_imei": _single("imei"), "detect_url": _single("url"), "detect_plates": plates,
        "redact_email": redact_email, "number_conversations": number_conversations, "small_cells": small_cells,
        "polish_documents": polish_documents, "reflow_documents": reflow_documents, "page_layers": page_layers, "missed_words": missed_words, "leak_check": leak_check,
        "check_pesel": check_pesel, "check_nip": check_nip, "check_regon": check_regon, "check_iban": check_iban, "check_id_card": check_id_card, "check_land_register": check_land_register,
        "canonical_forms": canonical_forms, "hmac_keys": hmac_keys, "shift_dates": shift_dates, "find_amounts": find_amounts, "surname_forms": surname_forms,
        "golden_recall": golden_recall, "overlap_folds": overlap_folds,
    } | parts.queries() | planted.queries() | planted_documents.queries()


def oracle_sql() -> dict:
    return {
        "detect_email": _single_sql("[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+"),
        "detect_ip": _single_sql("(?:(?:[0-9]{1,3}\\.){3}[0-9]{1,3}|(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4})", where=IP_SQL),
        "detect_imei": _single_sql("(?:IMEI[:\\s]?)?([0-9]{15})", 1),
        "detect_url": _single_sql("(?:https?://[^\\s]+|[\\p{L}\\p{M}\\p{N}_]+\\.com/[\\p{L}\\p{M}\\p{N}_]+|@[\\p{L}\\p{M}\\p{N}_]+)"),
        "redact_email": "SELECT doc_id, regexp_replace(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+', '[adres e-mail]', 'g') AS text FROM documents",
        "number_conversations": NUMBER_SQL, "small_cells": SMALL_SQL, "polish_documents": POLISH_SQL,
        "check_pesel": PESEL_SQL, "check_nip": NIP_SQL, "check_regon": REGON_SQL, "check_iban": IBAN_SQL, "check_id_card": ID_CARD_SQL, "check_land_register": LAND_SQL,
        "canonical_forms": CANONICAL_SQL, "shift_dates": SHIFT_SQL, "find_amounts": AMOUNT_SQL, "surname_forms": _inflection_sql(), "golden_recall": _golden_sql(),
        "detect_plates": PLATES_SQL, "page_layers": LAYERS_SQL, "reflow_documents": REFLOW_SQL, "hmac_keys": HMAC_SQL, "overlap_folds": OVERLAP_SQL,
    } | parts.oracle_sql() | planted.oracle_sql() | planted_documents.oracle_sql()
