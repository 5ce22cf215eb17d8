"""WARC archives: writing captures, reading records, assembling transactions.

A capture is three records: the request, the response (or a revisit, if an
earlier capture has an equal payload) and a metadata record. Request and
metadata name the response in WARC-Concurrent-To; assembly joins the records
through these identifiers and emits one nested row per capture.

Archives are written by Spark's text writer with the record end as line
separator, compressed with gzip, so they lie in whatever store the path names.
They are read as a stream of lines: a task holds one record at a time, however
long the file. (Files that Spark would split between tasks must be compressed,
as web archives usually are.)

Defined results. Null html: an empty payload. Null url: an empty target. Null
page_id: written as empty, read as null. Of captures with equal payloads of at
least `least_bytes`, that with the smallest page_id is the response, null last;
of rows that repeat a page_id, the first read. Line ends in a url are escaped.
An empty table gives an empty archive and no rows. Columns other than page_id,
url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline.llm.common import new_path, written

END = "\r\n\r\n"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = (
    "warc_type string, record_id string, target_uri string, concurrent_to array<string>, refers_to string, "
    "declared_digest string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"
)


def base32_sha1(data: F.Column) -> F.Column:
    """Bare upper-case base32 SHA-1 of a string or binary column."""
    code = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(code, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), HEX32, BASE32)


def _urn(*cols: F.Column) -> F.Column:
    h = F.md5(F.concat_ws("|", *cols))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def _record(kind: str | F.Column, urn: F.Column, block: F.Column, *headers: tuple[str, F.Column]) -> F.Column:
    parts = [F.lit("WARC/1.1\r\nWARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit("\r\nWARC-Record-ID: "), urn]
    for name, value in headers:
        parts.append(F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit("")))
    return F.concat(*parts, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a request, a response or revisit, and a metadata record per row of pages."""
    html = F.coalesce(F.col("html"), F.lit(""))
    url = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "\r", "%0D"), "\n", "%0A")
    rows = pages.select("page_id", url.alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), base32_sha1(html).alias("digest"), F.monotonically_increasing_id().alias("at"))
    rows = rows.withColumn("urn", _urn(F.col("page_id").cast("string"), F.col("at").cast("string")))
    first = rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "at", "urn", "url")).alias("first"), F.min("bytes").alias("bytes"))
    # a join on both columns deals both sides anew, so that a frequent payload can be split
    rows = rows.join(first, ["digest", "bytes"], "left")
    again = F.coalesce(F.col("first.at") != F.col("at"), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END), F.when(again, "").otherwise(F.col("html")))
    asked = F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1" + END))
    about = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    target, when = ("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date))
    near = ("WARC-Concurrent-To", F.col("urn"))
    records = F.array(
        _record("request", _urn(F.lit("request"), F.col("urn")), asked, target, when, near, ("Content-Type", F.lit("application/http;msgtype=request"))),
        _record(
            F.when(again, "revisit").otherwise("response"), F.col("urn"), http, target, when,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.when(again, F.col("first.urn"))), ("WARC-Refers-To-Target-URI", F.when(again, F.col("first.url"))),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ),
        _record("metadata", _urn(F.lit("metadata"), F.col("urn")), about, target, when, near, ("Content-Type", F.lit("application/warc-fields"))),
    )
    rows.select(F.explode(records).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def _headers(lines: list[bytes]) -> list[tuple[str, str]]:
    found = []
    for line in lines:
        name, colon, value = line.partition(b":")
        if colon:
            found.append((name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace")))
    return found


def parse_records(lines):
    """(headers, block) of each record in a stream of (file, line without its newline)."""
    file, head, body, left = None, None, None, 0
    for at, line in lines:
        if at != file:  # what an earlier file left unfinished is lost, as after a break in a download
            file, head, body = at, None, None
        if body is not None:
            body.append(line)
            left -= len(line) + 1
            if left <= 0:
                block = b"\n".join(body) + b"\n"
                yield head, block[: len(block) + left]
                head = body = None
        elif head is None:
            if line.startswith(b"WARC/"):
                head = []
        elif line in (b"\r", b""):
            head = _headers(head)
            left = int(dict(head).get("content-length", "0") or 0)
            body = [] if left else None
            if not left:
                yield head, b""
                head = None
        else:
            head.append(line)


def _rows(batches, with_payload: bool):
    columns: list[list] = [[] for _ in RECORD.split(", ")]
    size = 0

    def flush():
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()), strict=True)]
        out = pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in RECORD.split(", ")])
        for c in columns:
            c.clear()
        return out

    def lines():
        for batch in batches:
            files = batch.column(1).to_pylist()
            for line, at in zip(batch.column(0), files, strict=True):
                yield at, line.as_py() or b""

    for head, block in parse_records(lines()):
        first = dict(reversed(head))
        kind, fields, payload = first.get("warc-type", ""), {}, block
        if kind in ("request", "response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            fields = dict(_headers(http.split(b"\r\n")[1:]))
        elif first.get("content-type", "").startswith("application/warc-fields"):
            fields = dict(_headers(block.split(b"\r\n")))
        digest = first.get("warc-payload-digest", "").removeprefix("sha1:") or None
        n, real = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else None
        if kind == "revisit":  # the payload is that of the record it refers to
            n, real = int(fields.get("content-length") or 0), digest
        row = (kind, first.get("warc-record-id"), first.get("warc-target-uri"), [v for k, v in head if k == "warc-concurrent-to"], first.get("warc-refers-to"), digest, n, real, list(fields.items()), payload if with_payload else None)
        for c, v in zip(columns, row, strict=True):
            c.append(v)
        size += 200 + len(payload) * with_payload
        if size > 4 << 20:
            yield flush()
            size = 0
    if columns[0]:
        yield flush()


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the archives under path; payload_digest is computed from the payload read."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"))
    return lines.mapInArrow(lambda batches: _rows(batches, with_payload), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, response, requests, metadata).

    A request or metadata record belongs to the response that it names as
    concurrent, that names it, or that the request it names belongs to.
    Records of no known capture are left out.
    """
    main = records.where(F.col("warc_type").isin("response", "revisit"))
    rest = records.where(F.col("warc_type").isin("request", "metadata")).drop("payload")
    names = rest.select(F.col("record_id").alias("member"), F.explode("concurrent_to").alias("other"))
    named = main.select(F.explode("concurrent_to").alias("member"), F.col("record_id").alias("capture_id"))
    ids = main.select(F.col("record_id").alias("capture_id"))
    direct = names.join(ids, F.col("other") == F.col("capture_id")).select("member", "capture_id").unionByName(named)
    through = names.withColumnRenamed("member", "by").join(direct, F.col("other") == F.col("member")).select(F.col("by").alias("member"), "capture_id")
    links = direct.unionByName(through).distinct()
    parts = rest.join(links, F.col("record_id") == F.col("member")).groupBy("capture_id").agg(
        F.collect_list(F.when(F.col("warc_type") == "request", F.struct("record_id", "target_uri", "fields"))).alias("requests"),
        F.collect_list(F.when(F.col("warc_type") == "metadata", F.struct("record_id", "fields"))).alias("metadata"),
    )
    whole = F.struct("warc_type", "record_id", "target_uri", "refers_to", "payload_bytes", "payload_digest", "declared_digest", "fields", "payload")
    return main.select(F.col("record_id").alias("capture_id"), whole.alias("response")).join(parts, "capture_id", "left")


def op1(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = new_path(spark, "warc")
    write_warc(pages, path)
    got = written(assemble(written(read_warc(spark, path, with_payload=False), "records")), "captures")
    number = F.nullif(F.element_at("metadata", 1)["fields"]["page-id"], F.lit("")).cast("long")
    got = got.select(number.alias("page_id"), "capture_id", "response.payload_bytes", "response.payload_digest", F.col("response.warc_type").alias("record_type"), F.col("response.refers_to").alias("to"))
    first = got.where("record_type = 'response'").select(F.col("capture_id").alias("to"), F.col("page_id").alias("refers_to"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = got.where("to is null").withColumn("refers_to", F.lit(None).cast("long"))
    return whole.select(columns).unionByName(got.join(first, "to", "inner").select(columns))


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest
  FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to
FROM q
"""
