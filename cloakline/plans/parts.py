"""Single functions of the plan over the tables, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakline.functions import canonical, dates, fixed, text
from cloakline.operators import label, review, spans
from cloakline.operators.spread import spread
from cloakline.sources import files


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- canonical forms by category

_FORMED = {
    "pesel": "'44 05-' || k", "nip": "'PL 526-' || k || '-46'", "krs": "'KRS: 0000' || k", "iban": "'pl 61 ' || k", "vehicle_plate": "'wa ' || k",
    "case_number": "'I C ' || k || '/24'", "phone": "'0048 601 ' || k", "email": "' User' || k || '@Domena.PL '", "address": "'ul.   Polna ' || k",
}
_PERSONS = {
    "Jan Kowalski": "jan kowal", "Janowi  Kowalskiemu": "jan kowal", "Anna Nowak": "ann nowak", "Annie Nowak": "ann nowak", "ANNĘ NOWAK": "ann nowak",
    "Ewa Zielińska": "ewa zielin", "Jana Kowalczyka": "jan kowalczyk",
}


def canonical_categories(spark, sf_dir):
    """The canonical form of a value of each kind, chosen by its category."""
    keys = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lpad((F.col("c_custkey") * 7919 % 1000000).cast("string"), 6, "0").alias("k"))
    made = F.array(*[F.struct(F.lit(c).alias("category"), F.expr(v).alias("value")) for c, v in _FORMED.items()])
    rows = keys.select("id", F.explode(made).alias("v")).select("id", "v.category", "v.value")
    names = list(_PERSONS)
    person = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("id") % len(names) + 1).cast("int"))
    rows = rows.unionByName(keys.select("id", F.lit("legal_role_person").alias("category"), person.alias("value")))
    return rows.select("id", "category", canonical.canonical(F.col("category"), F.col("value")).alias("form"))


_FORMS_SQL = {
    "pesel": "'4405' || k", "nip": "'526' || k || '46'", "krs": "'0000' || k", "iban": "'PL61' || k", "vehicle_plate": "'WA' || k",
    "case_number": "'IC' || k || '24'", "phone": "'601' || k", "email": "'user' || k || '@domena.pl'", "address": "'ul. polna ' || k",
}
CATEGORIES_SQL = "WITH c AS (SELECT c_custkey AS id, lpad(CAST(c_custkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS k FROM customer) " + " UNION ALL ".join(
    [f"SELECT id, '{c}' AS category, {v} AS form FROM c" for c, v in _FORMS_SQL.items()]
    + [f"SELECT id, 'legal_role_person' AS category, [{', '.join(repr(f) for f in _PERSONS.values())}][id % {len(_PERSONS)} + 1] AS form FROM c"]
)


# ---------------------------------------------------------------- dates in all styles

_MONTH = f"array({', '.join(repr(m) for m in fixed.MONTHS)})"


def date_styles(spark, sf_dir):
    """Dates with points, slashes, hyphens, as ISO, in words with both endings, not in the calendar, and none."""
    d = "o_orderdate"
    words = f"concat(day({d}), ' ', element_at({_MONTH}, month({d})), ' ', year({d}))"
    styles = [f"date_format({d}, 'dd.MM.yyyy')", f"date_format({d}, 'dd/MM/yyyy')", f"date_format({d}, 'dd-MM-yyyy')", f"date_format({d}, 'yyyy-MM-dd')", words, f"{words} || ' r.'", f"{words} || ' roku'", "'31.02.2026'", "'wczoraj'"]
    value = F.element_at(F.array(*[F.expr(s) for s in styles]), (F.col("o_orderkey") % len(styles) + 1).cast("int"))
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), value.alias("value"))
    return rows.select("id", "value", dates.parse(F.col("value")).cast("string").alias("parsed"), dates.shifted(F.col("value"), ((F.col("id") % 105 - 52) * 7)).alias("shifted"))


def _styles_sql() -> str:
    months = f"[{', '.join(repr(m) for m in fixed.MONTHS)}]"
    words = lambda d: f"day({d}) || ' ' || {months}[month({d})] || ' ' || year({d})"
    every = lambda d: f"[strftime({d}, '%d.%m.%Y'), strftime({d}, '%d/%m/%Y'), strftime({d}, '%d-%m-%Y'), strftime({d}, '%Y-%m-%d'), {words(d)}, {words(d)} || ' r.', {words(d)} || ' roku', '31.02.2026', 'wczoraj'][id % 9 + 1]"
    return f"""WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST((o_orderkey % 105 - 52) * 7 AS INTEGER) AS e FROM orders)
SELECT id, {every('d')} AS value, CASE WHEN id % 9 < 7 THEN CAST(d AS VARCHAR) END AS parsed, {every('e')} AS shifted FROM o"""


# ---------------------------------------------------------------- labels

_KINDS = ("email", "amount", "date", "pesel", "unknown")


def _entities(spark, sf_dir):
    """Line items as entities of their order: five categories, few values of each. An order's are in one task, whose size
    doesn't grow with the table, so that numbering sorts no more at once than that."""
    rows = spread(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey", each=1 << 22)
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("l_partkey") % len(_KINDS) + 1).cast("int"))
    value = F.concat(F.lit("4405140135"), (F.col("l_suppkey") % 3).cast("string"))
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("block_ix"), F.lit(0).alias("start"), kind.alias("category"), value.alias("value"))


_ENTITIES_SQL = f"""
WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS block_ix, [{', '.join(repr(k) for k in _KINDS)}][l_partkey % {len(_KINDS)} + 1] AS category, '4405140135' || CAST(l_suppkey % 3 AS VARCHAR) AS value FROM lineitem),
f AS (SELECT *, min(block_ix) OVER (PARTITION BY doc_id, category, value) AS first FROM r),
n AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, category ORDER BY first) AS place FROM f)
"""


def label_policies(spark, sf_dir):
    """Labels with numbers, without, and none, by the category's policy; unknown categories are numbered."""
    return label.labelled(label.numbered(_entities(spark, sf_dir))).select("doc_id", "block_ix", "category", "label")


POLICIES_SQL = (
    _ENTITIES_SQL
    + """SELECT doc_id, block_ix, category, CASE category WHEN 'amount' THEN '[kwota]' WHEN 'date' THEN NULL
  ELSE '[' || CASE category WHEN 'email' THEN 'adres e-mail' WHEN 'pesel' THEN 'PESEL' ELSE category END || ' ' || place || ']' END AS label FROM n"""
)


def entity_counts(spark, sf_dir):
    """Different numbered entities of each document and category."""
    return label.entity_counts(label.numbered(_entities(spark, sf_dir))).select("doc_id", "category", F.col("entities").cast("long").alias("entities"))


COUNTS_SQL = _ENTITIES_SQL + "SELECT doc_id, category, CAST(max(place) AS BIGINT) AS entities FROM n WHERE category NOT IN ('amount', 'date') GROUP BY doc_id, category"


def small_cell_orders(spark, sf_dir):
    """Categories with one entity only, in documents that keep their dates."""
    counts = label.entity_counts(label.numbered(_entities(spark, sf_dir)))
    return review.small_cells(counts).select("doc_id", F.array_join("rare", ",").alias("rare"))


SMALL_CELL_SQL = f"SELECT doc_id, string_agg(category, ',' ORDER BY category) AS rare FROM ({COUNTS_SQL}) WHERE entities <= 1 GROUP BY doc_id"


def splice_email(spark, sf_dir):
    """Found spans replaced in the text by the plan's own splicing."""
    found = spans.detector_spans(F.col("text"), fixed.EMAIL)
    parts = F.transform(found, lambda s: F.struct(s["start"], s["end"], F.lit("[adres e-mail]").alias("label")))
    return _table(spark, sf_dir, "documents").select("doc_id", label.spliced(F.col("text"), parts).alias("text"))


SPLICE_SQL = "SELECT doc_id, regexp_replace(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+', '[adres e-mail]', 'g') AS text FROM documents"


# ---------------------------------------------------------------- files and warnings

_CONTENT = {
    "25504446 2D312E37": "a.pdf", "504B0304 1400": "b.docx", "D0CF11E0 A1B11AE1": "c.DOC", "D0CF11E0 A1B11AE1 00": "d.xls", "49492A00": "e.tif",
    "7A776B6C79": "f.txt", "FFD8FFE0": "g.bin", "89504E47 0D0A1A0A": "h", "00": "i.docx", "": "j",
}
_SNIFFED = ("pdf", "zip", "doc", "unknown", "image", "txt", "image", "image", "unknown", "unknown")


def sniff_files(spark, sf_dir):
    """The format of files made from keys, by content first, then by name."""
    kinds = F.array(*[F.struct(F.unhex(F.lit(c.replace(" ", ""))).alias("content"), F.lit(n).alias("name")) for c, n in _CONTENT.items()])
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.element_at(kinds, (F.col("c_custkey") % len(_CONTENT) + 1).cast("int")).alias("f"))
    return rows.select("id", files.sniffed(F.col("f.content"), F.concat(F.lit("/in/"), F.col("id").cast("string"), F.col("f.name"))).alias("format"))


SNIFF_SQL = f"SELECT c_custkey AS id, [{', '.join(repr(s) for s in _SNIFFED)}][c_custkey % {len(_SNIFFED)} + 1] AS format FROM customer"


def sanitize_documents(spark, sf_dir):
    """Texts as office files can hold them."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a\r\nb\r"), "text", F.lit("\u0007")).alias("text"))
    return rows.select("doc_id", text.sanitized(F.col("text")).alias("text"))


SANITIZE_SQL = """WITH d AS (SELECT doc_id, replace(replace('a' || chr(13) || chr(10) || 'b' || chr(13) || text || chr(7), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents)
SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{FDD0}-\\x{FDEF}\\x{FFFE}\\x{FFFF}]', '', 'g') AS text FROM d"""


def file_warnings(spark, sf_dir):
    """What a reviewer is told of a file, over all combinations of its facts."""
    k = F.col("c_custkey")
    kind = F.element_at(F.array(F.lit("pdf"), F.lit("image"), F.lit("docx")), (k % 3 + 1).cast("int"))
    found = review.format_warnings(kind, k % 2 == 0, k % 5 == 0, F.when(k % 7 != 0, k % 100))
    return _table(spark, sf_dir, "customer").select(k.alias("id"), F.array_join(found, "; ").alias("warnings"))


WARNINGS_SQL = """SELECT c_custkey AS id, concat_ws('; ', CASE c_custkey % 3 WHEN 0 THEN 'the layout of a PDF is kept roughly' WHEN 1 THEN 'the text was recognised in an image' END,
  CASE WHEN c_custkey % 2 = 0 THEN 'the file holds tracked changes' END, CASE WHEN c_custkey % 5 = 0 THEN 'protection against editing was removed' END,
  CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 100 < 60 THEN 'the text was recognised with low confidence' END) AS warnings FROM customer"""


def conversation_language(spark, sf_dir):
    """Whether the beginning of a conversation's text looks Polish."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_ix"), "text")
    return review.language_warnings(turns)


LANGUAGE_SQL = f"""
WITH t AS (SELECT conv_id AS doc_id, substr(string_agg(text, ' ' ORDER BY turn), 1, 5000) AS text FROM conversations GROUP BY conv_id),
w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}]+') AS w FROM t)
SELECT doc_id, len(w) < 30 OR regexp_matches(text, '[ąćęłńóśźżĄĆĘŁŃÓŚŹŻ]')
  OR len(list_filter(w, lambda x: x IN ({', '.join(f"'{x}'" for x in fixed.POLISH_WORDS)}))) / greatest(len(w), 1) >= 0.03 AS polish FROM w"""


def queries() -> dict:
    return {
        "canonical_categories": canonical_categories, "date_styles": date_styles, "label_policies": label_policies, "entity_counts": entity_counts,
        "small_cell_orders": small_cell_orders, "splice_email": splice_email, "sniff_files": sniff_files, "sanitize_documents": sanitize_documents,
        "file_warnings": file_warnings, "conversation_language": conversation_language,
    }


def oracle_sql() -> dict:
    return {
        "canonical_categories": CATEGORIES_SQL, "date_styles": _styles_sql(), "label_policies": POLICIES_SQL, "entity_counts": COUNTS_SQL,
        "small_cell_orders": SMALL_CELL_SQL, "splice_email": SPLICE_SQL, "sniff_files": SNIFF_SQL, "sanitize_documents": SANITIZE_SQL,
        "file_warnings": WARNINGS_SQL, "conversation_language": LANGUAGE_SQL,
    }
