"""Files as rows: format by content, text blocks of plain text and office files, and their rewriting.

Office files are zip archives of XML parts, read with the standard library inside
Arrow batches; a row is a file, so files run in parallel. Rewriting works on the
XML's own characters: labels are put between them and everything else, prefixes
and declarations included, stays byte by byte. PDF, images and old formats need
libraries or programs that are no dependency: a reader or converter is a function
that the caller passes (see documents.py); without one they yield a row that says so.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "path string, format string, block_ix int, kind string, part_name string, text string, error string"
_NAMES = ["path", "format", "block_ix", "kind", "part_name", "text", "error"]
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

# --- fixed values: parts whose text flows, parts that hold no text, attributes that are technical
FLOW = re.compile(r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml$")
NO_TEXT = re.compile(r"\[Content_Types\]\.xml$|fontTable|numbering|styles|/theme/|webSettings")
TECHNICAL = re.compile(r"rsid\w*$|id$|embed$|link$", re.I)
SCRUBBED = ("creator", "title", "subject", "description", "lastModifiedBy", "keywords", "created", "modified", "Manager", "Company")
IMAGES = ("jpg", "jpeg", "png", "tif", "tiff", "bmp")


def sniffed(content: Column, path: Column) -> Column:
    """Format by the first bytes, then by the name: pdf, zip, doc, txt, image or unknown."""
    head = lambda n: F.hex(F.substring(content, 1, n))
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(head(5) == "255044462D", "pdf").when(head(4) == "504B0304", "zip")
        .when(head(8) == "D0CF11E0A1B11AE1", F.when(ext == "doc", "doc").otherwise("unknown"))
        .when(ext.isin("tif", "tiff", "bmp"), "image").when(ext == "txt", "txt")
        .when((head(3) == "FFD8FF") | (head(8) == "89504E470D0A1A0A"), "image").otherwise("unknown")
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, format) of all files under path."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    return rows.withColumn("format", sniffed(F.col("content"), F.col("path")))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, block_ix, text): plain text files in blocks parted by empty lines."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), "value")
    return rows.select("doc_id", F.posexplode(F.split("value", "\n\n", -1)).alias("block_ix", "text"))


def zip_kind(content: bytes, path: str) -> str:
    """docx or odt by what the archive holds, then by the name."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
    if "word/document.xml" in names:
        return "docx"
    if {"content.xml", "mimetype"} <= names:
        return "odt"
    ext = path.rpartition(".")[2].lower()
    return ext if ext in ("docx", "odt") else "unknown"


def office_blocks(files: DataFrame) -> DataFrame:
    """BLOCK rows of read_files(); a file that can't be read yields one row with its error's kind."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content, kind in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                try:
                    kind = zip_kind(content, path) if kind == "zip" else kind
                    if kind in ("docx", "odt"):
                        found = blocks_of(content, kind)
                    elif kind == "txt":
                        found = [("chunk", "", t) for t in content.decode("utf-8", "replace").split("\n\n")]
                    else:
                        raise ValueError("needs an optional reader" if kind in ("pdf", "image", "doc") else "unsupported format")
                    rows += [(path, kind, i, k, p, t, None) for i, (k, p, t) in enumerate(found)]
                except Exception as e:  # one bad file must not stop the others; the message holds no content
                    rows.append((path, kind, None, None, None, None, str(e) if isinstance(e, ValueError) else type(e).__name__))
            kinds = [pa.string(), pa.string(), pa.int32()] + [pa.string()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], _NAMES)

    return files.select("path", "content", "format").mapInArrow(run, BLOCK)


_MARKUP = re.compile(r"<!--.*?-->|<!\[CDATA\[(?P<raw>.*?)\]\]>|<\?.*?\?>|<![^>]*>|<(?P<close>/?)(?P<tag>[^\s/>]+)(?P<rest>(?:\s+[^\s=>/]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(?P<empty>/?)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>/]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""", re.S)
_ENTITY = re.compile(r"&(#x[0-9A-Fa-f]+|#[0-9]+|amp|lt|gt|quot|apos);")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def _characters(raw: str, whole: bool = False) -> list[tuple[str, int, int]]:
    """(character, start, end) of text in a part's source; references are one character, a CR LF is one line feed."""
    out, at = [], 0
    for m in [] if whole else _ENTITY.finditer(raw):
        out += [(c, at + i, at + i + 1) for i, c in enumerate(raw[at : m.start()])]
        name = m[1]
        out.append((_NAMED.get(name) or chr(int(name[2:], 16) if name[1] == "x" else int(name[1:])), m.start(), m.end()))
        at = m.end()
    out += [(c, at + i, at + i + 1) for i, c in enumerate(raw[at:])]
    lines = []
    for c, a, b in out:
        if c == "\n" and b == a + 1 and lines and lines[-1][0] == "\r" and raw[a - 1 : a] == "\r":
            lines[-1] = ("\n", lines[-1][1], b)
        else:
            lines.append((c, a, b))
    return [("\n" if c == "\r" and raw[a:b] == "\r" else c, a, b) for c, a, b in lines]


class Source:
    """A part's XML as characters: its pieces of text and its attribute values, with their places."""

    def __init__(self, data: bytes):
        self.bom = data.startswith(b"\xef\xbb\xbf")
        self.text = data.decode("utf-8-sig")
        ET.fromstring(data)  # what is no XML is an error before anything is written
        self.pieces: list[tuple[int, int, bool, tuple]] = []  # start, end, CDATA, the elements around
        self.attributes: list[tuple[str, str, int, int, dict]] = []  # element, name, start, end, all of the element's
        self.tags: list[tuple[str, int, int, tuple]] = []  # element, start and end of its markup, the elements around
        around, at, n = [], 0, 0
        for m in _MARKUP.finditer(self.text):
            if m.start() > at and around:
                self.pieces.append((at, m.start(), False, tuple(around)))
            at = m.end()
            if m["raw"] is not None and around:
                self.pieces.append((*m.span("raw"), True, tuple(around)))
            if m["tag"] is None:
                continue
            if m["close"]:
                _, start, _ = around.pop()
                self.tags.append((m["tag"], start, m.end(), tuple(around)))
                continue
            found = [(a[1], *(a.span(2) if a[2] is not None else a.span(3))) for a in _ATTRIBUTE.finditer(m["rest"])]
            base = m.start("rest")
            values = {name: m["rest"][x:y] for name, x, y in found}
            self.attributes += [(m["tag"], name, base + x, base + y, values) for name, x, y in found if not (name == "xmlns" or name.startswith("xmlns:"))]
            if m["empty"]:
                self.tags.append((m["tag"], m.start(), m.end(), tuple(around)))
            else:
                around.append((m["tag"], m.start(), n))
                n += 1
        self.edits: list[tuple[int, int, str]] = []

    def put(self, pieces: list[tuple], joint: str, labels: list[tuple[int, int, str]]) -> None:
        """Labels (by place in the joined texts of pieces) into the first piece each touches; the others lose their share."""
        at, places = 0, []
        for start, end, raw, _ in pieces:
            found = _characters(self.text[start:end], raw)
            if found:
                places.append((at, at + len(found), start, found, raw))
                at += len(found) + len(joint)
        for a, b, label in labels:
            first = True
            for x, y, base, found, raw in places:
                if x < b and a < y:
                    i, j = max(a - x, 0), min(b, y) - x
                    shown = label if raw else escape(label, {'"': "&quot;"})
                    self.edits.append((base + found[i][1], base + found[j - 1][2], shown if first else ""))
                    first = False

    def written(self) -> bytes:
        text, out, at = self.text, [], 0
        for a, b, new in sorted(self.edits):
            out += [text[at:a], new]
            at = b
        return (b"\xef\xbb\xbf" if self.bom else b"") + "".join([*out, text[at:]]).encode()


def _plain(name: str) -> str:
    return name.rpartition(":")[2]


def _text_attributes(name: str, source: Source) -> list[tuple[int, int]]:
    """Places of the attribute values that may hold text; of relations only targets outside."""
    if name.endswith(".rels"):
        return [(a, b) for _, key, a, b, every in source.attributes if key == "Target" and every.get("TargetMode") == "External" and b > a]
    return [(a, b) for _, key, a, b, _ in source.attributes if not TECHNICAL.fullmatch(_plain(key))]


def _units(name: str, source: Source, kind: str):
    """(kind, pieces, joint) of a part's blocks in their order."""
    if kind == "docx":
        yield "part", source.pieces, "" if FLOW.search(name) else "\n"
        for a, b in _text_attributes(name, source):
            yield "attr", [(a, b, False, ())], ""
        return
    paragraphs: dict[int, list] = {}
    starts = sorted(start for tag, start, _, _ in source.tags if tag in ("text:p", "text:h"))
    for start in starts:
        paragraphs[start] = []
    for piece in source.pieces:
        for tag, start, _ in piece[3]:
            if tag in ("text:p", "text:h"):
                paragraphs[start].append(piece)
    for start in starts:
        yield "paragraph", paragraphs[start], ""


def _parts(z: zipfile.ZipFile, kind: str):
    if kind == "docx":
        names = [n for n in sorted(z.namelist()) if n.endswith((".xml", ".rels")) and not NO_TEXT.search(n)]
    else:
        names = ["content.xml"]
    for name in names:
        yield name, Source(z.read(name))


def blocks_of(content: bytes, kind: str) -> list[tuple[str, str, str]]:
    """(kind, part, text) of an office file."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name, source in _parts(z, kind):
            for unit, pieces, joint in _units(name, source, kind):
                texts = ["".join(c for c, _, _ in _characters(source.text[a:b], raw)) for a, b, raw, _ in pieces]
                out.append((unit, name, joint.join(t for t in texts if t)))
    return out


def rewritten(content: bytes, kind: str, labels: dict[int, list[tuple[int, int, str]]]) -> bytes:
    """The office file with labels (by block number) in place; all else stays byte by byte."""
    out, ix = io.BytesIO(), 0
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        changed: dict[str, bytes] = {}
        for name, source in _parts(z, kind):
            for _, pieces, joint in _units(name, source, kind):
                source.put(pieces, joint, labels.get(ix, []))
                ix += 1
            if source.edits:
                changed[name] = source.written()
        for entry in z.infolist():
            new.writestr(entry, changed.get(entry.filename, z.read(entry.filename)))
    return out.getvalue()


def _edited(content: bytes, edit) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for entry in z.infolist():
            data = z.read(entry.filename)
            new.writestr(entry, edit(entry.filename, data) or data)
    return out.getvalue()


def scrubbed(content: bytes) -> bytes:
    """The file without its author, title, dates and company."""

    def edit(name, data):
        if name in ("docProps/core.xml", "docProps/app.xml", "meta.xml"):
            source = Source(data)
            source.edits = [(a, b, "") for a, b, _, around in source.pieces if _plain(around[-1][0]) in SCRUBBED]
            return source.written()

    return _edited(content, edit)


def unprotected(content: bytes) -> bytes:
    """The file without protection against editing."""

    def edit(name, data):
        if name == "word/settings.xml":
            source = Source(data)
            source.edits = [(a, b, "") for tag, a, b, _ in source.tags if _plain(tag) == "documentProtection"]
            return source.written()

    return _edited(content, edit)


def tracked_changes(content: bytes) -> bool:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    return any(e.tag in (f"{W}ins", f"{W}del") for e in root.iter())


def rewritten_files(files: DataFrame, labels: DataFrame) -> DataFrame:
    """(path, content, error) of office files with labels (path, block_ix, start, end, label) put in, and metadata
    removed. A file that can't be rewritten has no content and its error's kind."""
    lists = labels.groupBy("path").agg(F.collect_list(F.struct("block_ix", "start", "end", "label")).alias("labels"))

    def run(batches):
        for batch in batches:
            out, errors = [], []
            for path, content, kind, found in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                by: dict[int, list] = {}
                for r in found or []:
                    by.setdefault(r["block_ix"], []).append((r["start"], r["end"], r["label"]))
                new = error = None
                try:
                    kind = zip_kind(content, path) if kind == "zip" else kind
                    if kind not in ("docx", "odt"):
                        raise ValueError("not an office file")
                    new = scrubbed(unprotected(rewritten(content, kind, by)))
                except Exception as e:  # one bad file must not stop the others; the message holds no content
                    error = str(e) if type(e) is ValueError else type(e).__name__
                out.append(new)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(errors, pa.string())], ["path", "content", "error"])

    rows = files.join(lists, "path", "left").select("path", "content", "format", "labels")
    return rows.mapInArrow(run, "path string, content binary, error string")


def neutral_names(files: DataFrame, order: str = "path", stem: str = "dokument_zanonimizowany") -> DataFrame:
    """files with a name that tells nothing of the content; numbers follow from the order of a folder's files."""
    from pyspark.sql import Window

    folder = F.regexp_extract(order, r"^(.*)/[^/]*$", 1)
    n = F.row_number().over(Window.partitionBy(folder).orderBy(order))
    return files.withColumn("name", F.concat(F.lit(stem), F.when(n > 1, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), F.lit(".docx")))
