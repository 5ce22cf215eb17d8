"""Office files whose XML stays as it was but for the labels, and the seams for readers and converters."""

import io
import json
import sys
import zipfile

import numpy as np

from cloakline.operators import evaluate
from cloakline.sources import documents, files, images

BODY = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\r\n<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" '
    'xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" mc:Ignorable="w14">'
    "<w:body><w:p w14:paraId='1'><w:r><w:t>A &amp; B: PESEL 4405</w:t></w:r><!-- note --><w:r><w:t xml:space=\"preserve\">1401359 &lt;kończ&#261;cy&gt; </w:t></w:r></w:p>"
    "<w:p><w:r><w:t><![CDATA[tel. 601-234-567 & co]]></w:t></w:r><w:br/></w:p></w:body></w:document>"
)


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def part(content, name):
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
        return z.read(name).decode()


def test_docx_keeps_prefixes_and_declarations():
    content = office({"word/document.xml": BODY, "word/media/x.png": b"\x89PNG"})
    blocks = files.blocks_of(content, "docx")
    text = blocks[0][2]
    assert text.startswith("A & B: PESEL 44051401359 <kończący> ") and "tel. 601-234-567 & co" in text
    a, b = text.index("44051401359"), text.index("601-234-567")
    new = part(files.rewritten(content, "docx", {0: [(a, a + 11, "[PESEL 1]"), (b, b + 11, "[a & b]")]}), "word/document.xml")
    assert new == BODY.replace("PESEL 4405<", "PESEL [PESEL 1]<").replace(">1401359 ", "> ").replace("601-234-567", "[a & b]")
    assert part(files.rewritten(content, "docx", {}), "word/document.xml") == BODY


def test_odt_paragraphs():
    body = '<office:text xmlns:office="o" xmlns:text="t"><text:h>Pismo</text:h><text:p>PESEL <text:span>4405</text:span>1401359</text:p></office:text>'
    content = office({"mimetype": "x", "content.xml": body})
    assert [b[2] for b in files.blocks_of(content, "odt")] == ["Pismo", "PESEL 44051401359"]
    new = part(files.rewritten(content, "odt", {1: [(6, 17, "[PESEL 1]")]}), "content.xml")
    assert new == body.replace("4405<", "[PESEL 1]<").replace(">1401359<", "><")


def test_protection_and_metadata_go_and_nothing_else():
    settings = '<w:settings xmlns:w="w"><w:zoom/><w:documentProtection w:edit="readOnly"></w:documentProtection><w:x/></w:settings>'
    core = '<cp:core xmlns:cp="c" xmlns:dc="d"><dc:creator>Jan</dc:creator><cp:revision>2</cp:revision></cp:core>'
    out = files.scrubbed(files.unprotected(office({"word/settings.xml": settings, "docProps/core.xml": core})))
    assert part(out, "word/settings.xml") == '<w:settings xmlns:w="w"><w:zoom/><w:x/></w:settings>'
    assert part(out, "docProps/core.xml") == core.replace("Jan", "")


def test_one_bad_file_is_a_row(spark):
    rows = [("a.docx", office({"word/document.xml": BODY}), "zip"), ("b.docx", b"PK\x03\x04broken", "zip"), ("c.docx", office({"word/document.xml": "<w:p>"}), "zip"), ("d.pdf", b"%PDF", "pdf")]
    df = spark.createDataFrame(rows, "path string, content binary, format string").coalesce(1)
    labels = spark.createDataFrame([("a.docx", 0, 0, 1, "[x]"), ("c.docx", 0, 0, 1, "[x]")], "path string, block_ix int, start int, end int, label string")
    got = {r.path: r for r in files.rewritten_files(df, labels).collect()}
    assert got["a.docx"].error is None and "[x] &amp; B" in part(got["a.docx"].content, "word/document.xml")
    assert [got[p].content for p in ("b.docx", "c.docx", "d.pdf")] == [None] * 3
    assert got["b.docx"].error == "BadZipFile" and got["c.docx"].error and got["d.pdf"].error == "not an office file"


def test_pdf_pages(spark):
    def reader():
        def read(content):
            if content == b"locked":
                raise documents.NeedsPassword
            if content == b"bad":
                raise OSError("secret")
            return [("zwykły tekst strony w dokumencie", lambda: b"no"), ("", lambda: b"png"), ("\x01\x02@#$%^&*()" * 9, lambda: b"png")]

        return read

    df = spark.createDataFrame([("a", b"x"), ("b", b"locked"), ("c", b"bad")], "path string, content binary").coalesce(1)
    got = sorted(((r.path, r.page, r.image and bytes(r.image), r.error, r.trusted) for r in documents.pdf_pages(df, reader).collect()), key=str)
    assert got == [("a", 0, None, None, True), ("a", 1, b"png", None, False), ("a", 2, b"png", None, False), ("b", None, None, "needs_password", None), ("c", None, None, "OSError", None)]
    assert {r.error for r in documents.pdf_pages(df).collect()} == {"no PDF reader installed"}


def test_conversion(spark):
    program = "import sys, time, pathlib; s = pathlib.Path(sys.argv[1]); d = s.read_bytes(); time.sleep(9 if d == b'slow' else 0); d != b'bad' and pathlib.Path(sys.argv[2], 'x.docx').write_bytes(d[::-1])"
    command = [sys.executable, "-c", program, "{source}", "{folder}"]
    df = spark.createDataFrame([("a.doc", b"abc"), ("b.doc", b"bad"), ("c.doc", b"slow")], "path string, content binary").coalesce(1)
    got = {r.path: (r.content and bytes(r.content), r.error) for r in documents.converted(df, "docx", command, timeout=4).collect()}
    assert got == {"a.doc": (b"cba", None), "b.doc": (None, "converter left with 0"), "c.doc": (None, "timeout")}
    assert {r.error for r in documents.converted(df, "docx").collect()} == {"no converter installed"}
    assert {r.error for r in documents.converted(df, "docx", ["/no/such/program"]).collect()} == {"converter not found"}


def test_text_as_docx(spark):
    df = spark.createDataFrame([(1, "a & b\nc\r\n\r\n\x0bd\n\n\n\n"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: bytes(r.content) for r in documents.as_docx(df).collect()}
    assert [t for k, n, t in files.blocks_of(got[1], "docx") if k == "part" and n == "word/document.xml"] == ["a & b cd"]
    assert "<w:t xml:space=\"preserve\">a &amp; b c</w:t>" in part(got[1], "word/document.xml") and part(got[2], "word/document.xml").endswith("<w:body></w:body></w:document>")


def test_golden_files_and_reports(spark, tmp_path):
    docs = evaluate.golden(spark.range(20))
    documents.write_golden(docs, str(tmp_path / "golden"))
    again = documents.read_golden(spark, str(tmp_path / "golden"))
    assert sorted(map(str, docs.collect())) == sorted(map(str, again.collect()))
    line = next(x for p in (tmp_path / "golden").glob("*.json") for x in p.read_text().splitlines())
    assert set(json.loads(line)) == {"doc_id", "doc_type", "text", "entities"}
    rates = spark.createDataFrame([("pesel", 4, 3), ("nip", 2, 2)], "category string, planted long, matched long")
    assert documents.report(rates).splitlines()[2:] == ["| nip | 2 | 2 | 100.0 % |", "| pesel | 4 | 3 | 75.0 % |", "| all | 6 | 5 | 83.3 % |"]
    after = spark.createDataFrame([("pesel", 4, 4), ("nip", 2, 2)], rates.schema)
    assert {r.category: (r.checked, r.before, r.after) for r in evaluate.recall_delta(rates, after).collect()} == {"pesel": (True, 0.75, 1.0), "nip": (True, 1.0, 1.0)}


def test_stale_folders(spark, tmp_path):
    for name in ("a_staging_1", "b_staging_2", "other"):
        (tmp_path / name).mkdir()
    assert documents.remove_stale(spark, str(tmp_path)) == []
    assert documents.remove_stale(spark, str(tmp_path), hours=-1) == ["a_staging_1", "b_staging_2"]
    assert [p.name for p in tmp_path.iterdir()] == ["other"]


def test_images_by_width_and_whole_when_turned():
    tall = np.zeros((1600, 1000), np.uint8)
    assert images.enlarged(tall).shape == (2400, 1500)
    page = np.full((40, 200), 255, np.uint8)
    page[0, 0] = page[-1, -1] = page[0, -1] = page[-1, 0] = 0
    assert (images.rotated(page, 5.0) == 0).sum() >= 4
