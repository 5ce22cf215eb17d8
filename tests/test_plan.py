"""Span algebra, canonical forms, labels, dates, review, files and whole documents."""

import hashlib
import hmac
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from cloakline.functions import canonical, dates, text
from cloakline.operators import evaluate, label, names, resolve, review
from cloakline.operators.detectors import DETECTION
from cloakline.plans import catalog, deidentify
from cloakline.sources import files


def fold(spark, spans):
    rows = [(a, b, "c", f"{a}-{b}", p, n, 1.0, i) for i, (a, b, p, n) in enumerate(spans)]
    df = spark.createDataFrame([(rows,)], f"d array<{DETECTION}>").withColumn("r", resolve.resolved(F.col("d"))).withColumn("c", resolve.collapsed(F.col("r")))
    row = df.collect()[0]
    return [(s.start, s.end, s.priority) for s in row.r], [(s.start, s.end, s.priority) for s in row.c]


def test_resolution(spark):
    assert fold(spark, [(0, 12, 100, False), (4, 12, 50, False)])[0] == [(0, 12, 100)]
    assert fold(spark, [(0, 30, 80, False), (20, 28, 60, True)]) == ([(0, 30, 80), (20, 28, 60)], [(0, 30, 80)])
    assert fold(spark, [(0, 22, 45, True), (6, 22, 100, False)]) == ([(0, 22, 45), (6, 22, 100)], [(6, 22, 100)])
    assert fold(spark, [(0, 9, 40, False), (0, 9, 100, False)])[0] == [(0, 9, 100)]
    assert fold(spark, []) == ([], [])


def one(spark, expression, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string").coalesce(1)
    return [r.x for r in df.select(expression(F.col("v")).alias("x")).collect()]


def test_canonical(spark):
    assert len(set(one(spark, canonical.phone, "+48 601 234 567", "601-234-567", "0048601234567"))) == 1
    assert len(set(one(spark, canonical.person, "Anna Nowak", "Annie Nowak", "Annę Nowak", "Anny Nowak"))) == 1
    assert len(set(one(spark, canonical.person, "Jan Kowalski", "Janowi Kowalskiemu"))) == 1
    assert len(set(one(spark, canonical.person, "Jan Kowalski", "Jan Kowalczyk", "Jan Nowicka"))) == 3
    key, message = b"some salt of bytes", "person:jan kowalski ł"
    got = spark.range(1).select(canonical.hmac_sha256(F.lit(key), F.lit(message)).alias("h")).collect()[0].h
    assert got == hmac.new(key, message.encode(), hashlib.sha256).hexdigest()


def test_dates(spark):
    moved = one(spark, lambda v: dates.shifted(v, F.lit(7)), "01.01.2026", "31.02.2026", "2024-02-26", "5/3/2024", "28 lutego 2024 r.", "30 grudnia 2023", "1.2/2024", "abc")
    assert moved == ["08.01.2026", "31.02.2026", "2024-03-04", "12/03/2024", "6 marca 2024 r.", "6 stycznia 2024", "1.2/2024", "abc"]


def test_texts(spark):
    assert one(spark, text.reflowed, "Ala ma\nkota.\nNowe zda-\nnie\n\nKoniec", "", "a\r\nb") == ["Ala ma kota.\n\nNowe zdanie\n\nKoniec", "", "a b"]
    polish = "Sąd oddalił powództwo w całości oraz zasądził koszty procesu " * 6
    assert one(spark, text.looks_polish, polish, "the quick brown fox jumps over the lazy dog " * 6, "short", "") == [True, False, True, True]
    assert one(spark, text.trustworthy_layer, "", "krótki", "\x01\x02@#$%^&*()" * 9, "zwykły tekst strony w dokumencie") == [False, True, False, True]
    assert one(spark, text.paragraphs, "a\nb\r\n\r\n\x0bc\n\n\n\nd") == [["a b", "c", "d"]]


def test_names(spark):
    forms = one(spark, names.name_forms, "Jan Kowalski", "Nowak", "")
    assert set(forms[0]) == {"Jan Kowalski", "Jan Kowalskiego", "Jan Kowalskiemu", "Jan Kowalskim"}
    assert set(forms[1]) == {"Nowak", "Nowaka", "Nowakowi", "Nowakiem", "Nowaku"} and forms[2] == []


def blocks(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id string, block_ix int, text string")


def test_documents(spark):
    df = blocks(
        spark,
        ("a", 0, "Powód Jan Kowalski, PESEL 44051401359, tel. 601-234-567, wnosi pozew przeciwko Janowi Kowalskiemu."),
        ("a", 1, "Jan Kowalski zapłaci 1500 zł do dnia 12.03.2024. Tel. +48 601 234 567 lub 602 234 567."),
        ("b", 0, None), ("b", 1, ""),
    )
    got = {(r.doc_id, r.block_ix): r.anonymized for r in deidentify.anonymize(df).collect()}
    assert got["a", 0].startswith("[Osoba 1], PESEL [PESEL 1], tel. [numer telefonu 1], wnosi pozew")
    assert "[kwota]" in got["a", 1] and "12.03.2024" in got["a", 1] and "[numer telefonu 1] lub [numer telefonu 2]" in got["a", 1]
    assert got["b", 0] is None and got["b", 1] == ""
    shifted = deidentify.anonymize(df, deidentify.Options(shift_dates=True, seed=3)).where("doc_id = 'a' and block_ix = 1").collect()[0].anonymized
    assert "12.03.2024" not in shifted
    summary = {r.doc_id: r for r in deidentify.results(df).collect()}
    assert summary["a"].entity_count == 4 and summary["a"].leaks == 0


def test_gazetteer_and_rescan(spark):
    first = names.gazetteer(spark.createDataFrame([("Jan ",), ("JAN",)], "value string"))
    last = names.gazetteer(spark.createDataFrame([("Kowalski",)], "value string"))
    df = blocks(spark, ("a", 0, "Wniosek - Jan Kowalski PESEL: x"), ("b", 0, "Dane: Kowalski Jan, i"), ("c", 0, "Sąd Rejonowy dla Warszawy"))
    found = deidentify.detect(df, deidentify.Options(first_names=first, surnames=last)).collect()
    assert {r.doc_id: [d.value for d in r.resolved if d.category == names.PERSON] for r in found} == {"a": ["Jan Kowalski"], "b": ["Kowalski Jan"], "c": []}


def test_numbers_have_no_gaps(spark):
    rows = spark.createDataFrame([("d", i % 7, i, "email", f"u{i * i % 11}@x.pl") for i in range(60)], "doc_id string, block_ix int, start int, category string, value string")
    got = label.numbered(rows).collect()
    assert {r.number for r in got} == set(range(1, len({r.value for r in got}) + 1))
    assert len({(r.value, r.number) for r in got}) == len({r.value for r in got})


def test_review(spark):
    df = blocks(spark, ("a", 0, "Spotkał się z Zubrowskim wczoraj. Potem Zubrowskim i Sądem oraz\nWola")).withColumn("resolved", F.array().cast(f"array<{DETECTION}>"))
    assert [r.token for r in review.potentially_missed(df, ["doc_id"]).orderBy("start").collect()] == ["zubrowskim", "wola"]
    leaks = review.leak_findings(blocks(spark, ("a", 0, "zostało 44051401359")), ["doc_id"])
    assert [(r.detector, r.findings) for r in leaks.collect()] == [("pesel", 1)]
    with pytest.raises(review.LeakDetectedError):
        review.assert_clean(leaks)
    review.assert_clean(leaks.where("false"))
    counts = spark.createDataFrame([("a", "address", 1), ("a", "case_number", 1), ("b", "address", 2)], "doc_id string, category string, entities int")
    assert [(r.doc_id, r.rare) for r in review.small_cells(counts).collect()] == [("a", ["address"])]
    candidates = spark.createDataFrame([("a", 0, 5), ("a", 8, 9)], "doc_id string, start int, end int")
    held = spark.createDataFrame([("a", 4, 6)], "doc_id string, start int, end int")
    assert [r.start for r in review.uncovered(candidates, held, ["doc_id"]).collect()] == [8]


def test_recall_is_whole(spark):
    docs = evaluate.golden(spark.range(100))
    for r in docs.limit(20).collect():
        assert all(r.text[e.start : e.end] == e.value for e in r.entities)
    truth = docs.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.category", "e.start", "e.end")
    replaced = deidentify.replacements(deidentify.detect(docs.select("doc_id", F.lit(0).alias("block_ix"), "text"))).where("label is not null")
    assert all(r.planted == r.matched for r in evaluate.recall(truth, replaced).collect())
    p = evaluate.precision(truth, replaced).collect()[0]
    assert p.planted <= p.replacements


def docx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>PESEL 4405</w:t></w:r><w:r><w:t>1401359 koniec</w:t></w:r></w:p></w:body></w:document>")
        z.writestr("word/settings.xml", f'<w:settings {ns}><w:documentProtection w:edit="readOnly"/><w:docVar w:val="tel. 601-234-567"/></w:settings>')
        z.writestr("docProps/core.xml", "<c><creator>Jan</creator></c>")
        z.writestr("word/media/x.png", b"\x89PNG")
    return out.getvalue()


def test_office_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx())
    (tmp_path / "b.txt").write_text("raz\n\ndwa")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "d.docx").write_bytes(b"PK\x03\x04broken")
    rows = files.read_files(spark, str(tmp_path))
    found = files.office_blocks(rows).collect()
    assert {r.format for r in found} == {"docx", "txt", "pdf", "zip"} and sum(r.error is not None for r in found) == 2
    good = spark.createDataFrame([r for r in found if r.format == "docx"], files.BLOCK)
    spans = deidentify.replacements(deidentify.detect(good.select(F.col("path").alias("doc_id"), "block_ix", "text"))).where("label is not null")
    out = files.rewritten_files(rows.where("path like '%a.docx'"), spans.withColumnRenamed("doc_id", "path")).collect()[0].content
    with zipfile.ZipFile(io.BytesIO(bytes(out))) as z:
        body, settings = z.read("word/document.xml").decode(), z.read("word/settings.xml").decode()
        assert "[PESEL 1]" in body and "4405" not in body and "1401359" not in body and " koniec" in body
        assert "[numer telefonu 1]" in settings and "documentProtection" not in settings
        assert "Jan" not in z.read("docProps/core.xml").decode() and z.read("word/media/x.png") == b"\x89PNG"
    assert files.neutral_names(rows).where("name = 'dokument_zanonimizowany.docx'").count() == 1


def test_stream(spark, tmp_path):
    from cloakline.streaming.files import stream

    blocks(spark, ("a", 0, "poczta x@example.com")).write.parquet(str(tmp_path / "in"))
    query = stream(spark, str(tmp_path / "in"), "doc_id string, block_ix int, text string", str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert [r.anonymized for r in spark.read.parquet(str(tmp_path / "out/text")).collect()] == ["poczta [adres e-mail 1]"]


def test_queries_match_their_sql(spark):
    import duckdb

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("nation", "customer", "orders", "lineitem", "documents", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    queries = catalog.queries()
    for name, sql in catalog.oracle_sql().items():
        got = queries[name](spark, sf)
        columns = sorted(got.columns)
        want = con.sql(f'select {", ".join(chr(34) + c + chr(34) for c in columns)} from ({sql})').fetchall()
        assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want)), name
