"""Seams for readers and converters that are no dependency, and formats of our own making: DOCX from text, JSON lines.

A reader or converter is a function that the caller passes; without it, and where
it fails, a row says so and the job goes on.
"""

from __future__ import annotations

import io
import subprocess
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline.functions.text import paragraphs, trustworthy_layer


class NeedsPassword(Exception):
    """What a PDF reader raises for a file that is locked."""


PAGE = "path string, page int, text string, image binary, error string"


def pdf_pages(files: DataFrame, reader: Callable[[], Callable] | None = None) -> DataFrame:
    """(path, page, text, image, error, trusted) of PDF files (path, content): a row per page.

    reader() gives a function from a file's bytes to pages (text layer, a function that renders the page as image
    bytes); a page whose layer reads like text is not rendered. Errors: needs_password, or the error's kind.
    """

    def run(batches):
        read = reader() if reader is not None else None
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if read is None:
                        raise ValueError("no PDF reader installed")
                    for number, (text, render) in enumerate(read(content)):
                        rows.append((path, number, text, None if _reads_like_text(text) else render(), None))
                except NeedsPassword:
                    rows.append((path, None, None, None, "needs_password"))
                except Exception as e:  # one bad file must not stop the others; the message holds no content
                    rows.append((path, None, None, None, str(e) if type(e) is ValueError else type(e).__name__))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "page", "text", "image", "error"])

    return files.select("path", "content").mapInArrow(run, PAGE).withColumn("trusted", F.when(F.col("error").isNull(), trustworthy_layer(F.coalesce("text", F.lit("")))))


def _reads_like_text(text: str | None) -> bool:
    """Whether rendering can be spared: only a layer that is plainly text; the column trusted has the whole rule."""
    kept = sum(c.isalnum() or c.isspace() for c in text or "")
    return bool(text and text.strip()) and kept >= 0.85 * len(text)


def converted(files: DataFrame, target: str, command: list[str] | None = None, timeout: float = 180.0) -> DataFrame:
    """(path, content, error) of files (path, content) turned into another format by a program.

    command is the program with {source}, {folder}, {target} and {profile} in its arguments; it runs once a file in a
    folder of its own and leaves one file of the target's ending there. Errors: timeout, the exit code, not installed.
    """

    def one(path: str, content: bytes) -> tuple[bytes | None, str | None]:
        if not command:
            return None, "no converter installed"
        with tempfile.TemporaryDirectory() as folder:  # of this task; only bytes leave it
            source = Path(folder, "in", "file" + Path(path).suffix)
            out = Path(folder, "out")
            source.parent.mkdir()
            out.mkdir()
            source.write_bytes(content)
            values = {"source": str(source), "folder": str(out), "target": target, "profile": str(Path(folder, "profile"))}
            try:
                done = subprocess.run([a.format(**values) for a in command], timeout=timeout, capture_output=True, check=False)
            except subprocess.TimeoutExpired:
                return None, "timeout"
            except OSError:
                return None, "converter not found"
            made = sorted(out.glob(f"*.{target}"))
            return (made[0].read_bytes(), None) if made else (None, f"converter left with {done.returncode}")

    def run(batches):
        for batch in batches:
            done = [one(p, c) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in done], pa.binary()), pa.array([e for _, e in done], pa.string())], ["path", "content", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary, error string")


_PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}


def _docx(blocks: list[str]) -> bytes:
    out = io.BytesIO()
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(b)}</w:t></w:r></w:p>' for b in blocks)
    document = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in {**_PARTS, "word/document.xml": document}.items():
            z.writestr(zipfile.ZipInfo(name), data)  # without the time, so that reruns agree
    return out.getvalue()


def as_docx(texts: DataFrame) -> DataFrame:
    """(doc_id, content): a DOCX of each text (doc_id, text); paragraphs are parted by empty lines."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_docx(b or []) for b in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "content"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", paragraphs(F.coalesce("text", F.lit(""))).alias("blocks")).mapInArrow(run, f"doc_id {kind}, content binary")


GOLDEN = "doc_id long, doc_type string, text string, entities array<struct<category:string,start:int,end:int,value:string>>"


def write_golden(docs: DataFrame, path: str) -> None:
    """Synthetic documents as JSON lines."""
    docs.select("doc_id", "doc_type", "text", "entities").write.mode("overwrite").json(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Synthetic documents of JSON lines; lines that are none are an error."""
    return spark.read.schema(GOLDEN).option("mode", "FAILFAST").json(path)


def report(rates: DataFrame) -> str:
    """A table in Markdown of rows (category, planted, matched): one row per category, a small number."""
    rows = rates.orderBy("category").collect()
    total = [sum(r[c] for r in rows) for c in ("planted", "matched")]
    line = lambda name, a, b: f"| {name} | {a} | {b} | {100 * b / a if a else 100:.1f} % |"
    return "\n".join(["| category | planted | matched | recall |", "|---|---|---|---|", *[line(r["category"], r["planted"], r["matched"]) for r in rows], line("all", *total)])


def remove_stale(spark: SparkSession, folder: str, hours: float = 24.0, mark: str = "_staging_") -> list[str]:
    """Delete the folders under `folder` whose names hold the mark and that nobody touched for so long; their names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    oldest, gone = spark._jvm.System.currentTimeMillis() - hours * 3_600_000, []
    for entry in store.listStatus(path):
        name = entry.getPath().getName()
        if entry.isDirectory() and mark in name and entry.getModificationTime() < oldest:
            store.delete(entry.getPath(), True)
            gone.append(name)
    return sorted(gone)
