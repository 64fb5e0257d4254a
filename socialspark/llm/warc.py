"""WARC derivatives: linked metadata and plain-text conversion records for response records.

A response record is parsed from its bytes (header lines, blank line, HTTP block). Each well-formed one
gives a ``metadata`` record (warc-fields: status, content type, title, counts, source headers) and a
``conversion`` record (plain text). Both refer to the response by its record id, repeat its target, date
and payload digest, and carry a digest of their own block. Ids of derivatives follow from the source id,
so a rerun gives the same records. All work is column expressions, but for character references: an Arrow
function decodes every named and numeric one inside the tasks. Nothing is shuffled.

The SQL twin decodes the nine references of ``REFERENCES`` only, ended by a semicolon; on pages with others it differs.

Files: ``write_warc`` writes uncompressed records ended by two line breaks; ``read_warc`` walks plain or gzip
files by Content-Length and marks a record complete only if its block has the stated length.

Defined cases: a null body is an empty block; a null URL leaves the target header out and target_uri
null; line breaks in a URL become %0D / %0A; records that are not well formed or not responses give no
derivative (``responses`` shows them); repeated records give repeated derivatives; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VERSION = "WARC/1.1"
CRLF = "\r\n"
BLANK = "\r\n\r\n"
#: What HTML-to-text conversion replaces, in order: (regular expression, replacement). Valid in Java and RE2 alike.
TAGS = (
    (r"(?s)<!--.*?-->", " "),
    (r"(?is)<(?:script\b.*?</script|style\b.*?</style)\s*>", " "),
    (r"(?i)<(?:/?(?:p|div|section|article|header|footer|nav|aside|ul|ol|li|table|tr|h[1-6]|blockquote|pre|form|title|body|head|html)\b[^>]*|br\s*/?)>", "\n"),
    (r"<[^>]*>", ""),
)
#: A character reference, named or numeric, with or without its semicolon, as ``html.unescape`` finds it.
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
#: The references that SQL decodes, in order; & comes last.
REFERENCES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
#: White space: these characters become a space, then runs become one; line breaks take the spaces around them.
BLANKS = ("\t", "\r", "\f", "\x0b")


def _decoded(reference: re.Match[str]) -> str:
    """The characters of a reference; a referenced no-break space counts as a space."""
    return unescape(reference[0]).replace("\xa0", " ")


@F.arrow_udf(StringType())
def decoded(texts: pa.Array) -> pa.Array:
    """Texts with every named and numeric character reference decoded once; only texts with an ampersand become Python strings."""
    held = pc.fill_null(pc.match_substring(texts, "&"), False)
    if not pc.any(held).as_py():
        return texts
    return pc.replace_with_mask(texts, held, pa.array([REFERENCE.sub(_decoded, t) for t in texts.filter(held).to_pylist()], texts.type))


def plain_text(html: Column) -> Column:
    for pattern, new in TAGS:
        html = F.regexp_replace(html, F.lit(pattern), F.lit(new))
    html = decoded(html)
    for blank in BLANKS:
        html = F.replace(html, F.lit(blank), F.lit(" "))
    html = F.replace(F.regexp_replace(html, F.lit(" {2,}"), F.lit(" ")), F.lit(" \n"), F.lit("\n"))
    return F.btrim(F.regexp_replace(html, F.lit("\n[ \n]+"), F.lit("\n")), F.lit(" \n"))


def _uuid(seed: Column) -> Column:
    h = F.md5(seed)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record's text: version line, headers whose value is not null, blank line, block."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in headers]
    return F.concat(F.concat_ws(CRLF, F.lit(VERSION), *lines), F.lit(BLANK), block)


def response_records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id, record: crawl pages (page_id, url, html) as WARC response records."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.regexp_replace(F.regexp_replace(F.col("url").cast("string"), "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(BLANK), html)
    headers = [
        ("WARC-Type", F.lit("response")), ("WARC-Record-ID", _uuid(F.concat(F.lit("response:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(url, F.lit(""))))),
        ("WARC-Target-URI", url), ("WARC-Date", F.lit(date)), ("WARC-Payload-Digest", _digest(html)), ("Page-Id", F.col("page_id").cast("string")),
        ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(http)),
    ]
    return pages.select(F.col("page_id").cast("long"), _record(headers, http).alias("record"))


def _header(lines: Column, name: str) -> Column:
    """First value of a header, by name without regard to case; null if absent."""
    prefix = name.lower() + ":"
    found = F.filter(lines, lambda x: F.lower(F.substring(x, 1, len(prefix))) == prefix)
    return F.trim(F.substring(F.get(found, F.lit(0)), F.lit(len(prefix) + 1), F.lit(1 << 30)))


def responses(records: DataFrame) -> DataFrame:
    """Parsed records: type, record_id, target_uri, date, payload_digest, page_id, status, content_type, body, http_headers, well_formed."""
    cut = F.instr("record", BLANK)
    stated = F.col("complete") if "complete" in records.columns else F.lit(None).cast("boolean")  # the reader's judgement, by bytes
    df = records.select("record", stated.alias("complete"), F.split(F.substring(F.col("record"), F.lit(1), cut - 1), CRLF).alias("h"), F.substring(F.col("record"), cut + 4, F.lit(1 << 30)).alias("block"))
    df = df.withColumn("body_at", F.instr("block", BLANK))
    http = F.split(F.when(F.col("body_at") > 0, F.substring(F.col("block"), F.lit(1), F.col("body_at") - 1)).otherwise(F.col("block")), CRLF)
    df = df.withColumn("http", http)
    length = F.expr("try_cast(n as bigint)")
    df = df.withColumn("n", _header(F.col("h"), "Content-Length"))
    return df.select(
        _header(F.col("h"), "WARC-Type").alias("type"), _header(F.col("h"), "WARC-Record-ID").alias("record_id"), _header(F.col("h"), "WARC-Target-URI").alias("target_uri"),
        _header(F.col("h"), "WARC-Date").alias("date"), _header(F.col("h"), "WARC-Payload-Digest").alias("payload_digest"), _header(F.col("h"), "Page-Id").try_cast("long").alias("page_id"),
        F.regexp_extract(F.get("http", F.lit(0)), r"^HTTP/\S+ (\d{3})", 1).alias("status"), _header(F.col("http"), "Content-Type").alias("content_type"),
        F.when(F.col("body_at") > 0, F.substring(F.col("block"), F.col("body_at") + 4, F.lit(1 << 30))).otherwise(F.lit("")).alias("body"),
        F.array_join(F.slice("http", 2, 1 << 30), CRLF).alias("http_headers"),
        F.coalesce(F.get("h", F.lit(0)).rlike(r"^WARC/1\.[01]$") & F.coalesce("complete", length == F.octet_length("block")), F.lit(False)).alias("well_formed"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """page_id, record_type, record_id, refers_to, target_uri, source_digest, block_digest, content_length, content, record."""
    r = responses(records).withColumn("ok", F.coalesce(F.col("well_formed") & (F.lower("type") == "response") & F.col("record_id").isNotNull(), F.lit(False)))
    title = F.trim(plain_text(F.regexp_extract("body", r"(?is)<title[^>]*>(.*?)</title", 1)))
    r = r.withColumn("plain", plain_text(F.col("body")))
    field = lambda k, v: F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit("")))
    meta = F.concat_ws(CRLF, field("http-status", F.col("status")), field("title", F.regexp_replace(title, r"\s+", " ")), field("payload-bytes", F.octet_length("body")),
                       field("text-chars", F.char_length("plain")), field("links", F.size(F.regexp_extract_all("body", F.lit(r"(?i)<a\s[^>]*href"), F.lit(0)))), field("source-payload-digest", F.col("payload_digest")), F.col("http_headers"))
    kinds = F.array(F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("mime"), meta.alias("content"), F.col("ok")),
                    F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("mime"), F.col("plain").alias("content"), F.col("ok")))
    # The test goes through the exploded rows: as a filter on the records it would be pushed below the parsing and repeat it.
    d = r.withColumn("k", F.explode(kinds)).drop("ok").select("*", "k.*").where("ok").withColumn("source_id", F.col("record_id"))
    d = d.withColumn("record_id", _uuid(F.concat("record_type", F.lit(":"), "source_id"))).withColumn("block_digest", _digest(F.col("content")))
    headers = [
        ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("source_id")), ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("date")),
        ("WARC-Block-Digest", F.col("block_digest")), ("Source-Payload-Digest", F.col("payload_digest")), ("Page-Id", F.col("page_id")), ("Content-Type", F.col("mime")), ("Content-Length", F.octet_length("content")),
    ]
    return d.select("page_id", "record_type", "record_id", F.col("source_id").alias("refers_to"), "target_uri", F.col("payload_digest").alias("source_digest"), "block_digest",
                    F.octet_length("content").cast("long").alias("content_length"), "content", _record(headers, F.col("content")).alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    records.select("record").write.option("lineSep", BLANK).text(path)


_LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)[ \t]*\r?$", re.I | re.M)


FIRST_STEP, LAST_STEP, MOST_OUT = 16 << 10, 1 << 20, 4 << 20


def inflated(raw: bytes) -> Iterator[bytes]:
    """A gzip file's members, one after another, in pieces of at most MOST_OUT bytes; a torn last member gives what it holds."""
    view, at = memoryview(raw), 0
    while view[at : at + 2] == b"\x1f\x8b":
        z, step = zlib.decompressobj(31), FIRST_STEP
        while not z.eof and at < len(view):
            rest = view[at : at + step]  # what a member leaves of a step is copied, so steps begin small
            at += len(rest)
            try:
                while len(rest):
                    yield z.decompress(rest, MOST_OUT)
                    rest = z.unconsumed_tail
            except zlib.error:
                return
            at -= len(z.unused_data)
            step = min(2 * step, LAST_STEP)
        if tail := z.flush():
            yield tail


def zipped_records(raw: bytes) -> Iterator[tuple[bytes, bool]]:
    """As :func:`split_records` of the unpacked file, holding one record at a time."""
    buffer, wanted = bytearray(), 0
    for piece in inflated(raw):
        buffer += piece
        if len(buffer) < wanted:
            continue
        at, wanted = 0, 0
        while at < len(buffer):
            if buffer[at : at + 2] == b"\r\n":
                at += 2
                continue
            head = buffer.find(b"\r\n\r\n", at)
            stated = _LENGTH.search(buffer, at, head + 2) if head >= 0 and buffer[at : at + 7] == b"WARC/1." else None
            end = head + 4 + int(stated[1]) if stated else buffer.find(b"\r\n\r\nWARC/1.", at + 1)
            if stated and end + 2 <= len(buffer) and buffer[end : end + 2] == b"\r\n":
                yield bytes(buffer[at:end]), True
            elif stated and end + 2 > len(buffer):  # not all here yet
                wanted = end + 2 - at
                break
            elif (end := buffer.find(b"\r\n\r\nWARC/1.", at + 1)) >= 0 and head >= 0:
                yield bytes(buffer[at:end]), False
            else:
                wanted = 2 * (len(buffer) - at)  # so that a long stretch without records is searched in linear time
                break
            at = end
        del buffer[:at]
    yield from split_records(bytes(buffer))


def split_records(raw: bytes) -> Iterator[tuple[bytes, bool]]:
    """(record, complete) of a WARC file, walked by Content-Length; after bytes that are no record, on from the next version line.

    A record is complete if its block has the stated number of bytes; what a block holds, blank lines and version lines too, parts nothing.
    """
    at = 0
    while at < len(raw):
        if raw[at : at + 2] == b"\r\n":  # between records
            at += 2
            continue
        head = raw.find(b"\r\n\r\n", at)
        stated = _LENGTH.search(raw, at, head + 2) if head >= 0 and raw[at : at + 7] == b"WARC/1." else None
        end = head + 4 + int(stated[1]) if stated else -1
        if stated and end <= len(raw) and (end == len(raw) or raw[end : end + 2] == b"\r\n"):
            yield raw[at:end], True
        else:
            end = raw.find(b"\r\n\r\nWARC/1.", at + 1)
            end = len(raw) if end < 0 else end
            yield raw[at:end], False
        at = end


def read_warc(spark: SparkSession, path: str, step: int = 16 << 20) -> DataFrame:
    """(record, complete): the records of WARC 1.0 and 1.1 files, plain or gzip by member. Bytes that are not UTF-8 become U+FFFD.

    A task holds one file at a time as it is stored (2 GB at most, Spark's bound for a file as a row), unpacks one record at a
    time, and gives its records on in steps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[str] = []
                whole: list[bool] = []
                size = 0
                raw = content.as_py() or b""
                for record, complete in (zipped_records if raw[:2] == b"\x1f\x8b" else split_records)(raw):
                    rows.append(record.decode("utf-8", "replace"))
                    whole.append(complete)
                    size += len(record)
                    if size >= step:
                        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(whole, pa.bool_())], names=["record", "complete"])
                        rows, whole, size = [], [], 0
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(whole, pa.bool_())], names=["record", "complete"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "record string, complete boolean")


def _sql_text(x: str) -> str:
    quoted = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for pattern, new in TAGS:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(new)}, 'g')"
    for name, new in REFERENCES:
        x = f"replace({x}, {quoted(name)}, {quoted(new)})"
    for blank in BLANKS:
        x = f"replace({x}, chr({ord(blank)}), ' ')"
    x = f"replace(regexp_replace({x}, ' {{2,}}', ' ', 'g'), ' ' || chr(10), chr(10))"
    return f"trim(regexp_replace({x}, chr(10) || '[ ' || chr(10) || ']+', chr(10), 'g'), ' ' || chr(10))"


def _sql_uuid(x: str) -> str:
    return f"'<urn:uuid:' || md5({x})[1:8] || '-' || md5({x})[9:12] || '-' || md5({x})[13:16] || '-' || md5({x})[17:20] || '-' || md5({x})[21:32] || '>'"


_N = "' || chr(13) || chr(10) || '"
SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS url FROM pages),
r AS (
  SELECT *, {_sql_uuid("'response:' || coalesce(CAST(page_id AS VARCHAR), '') || ':' || coalesce(url, '')")} AS rid, 'sha256:' || sha256(html) AS pd,
         {_sql_text("html")} AS plain, {_sql_text("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")} AS title FROM p),
k AS (
  SELECT *, 'conversion' AS record_type, plain AS content FROM r
  UNION ALL
  SELECT *, 'metadata', 'http-status: 200{_N}title: ' || trim(regexp_replace(title, '\\s+', ' ', 'g')) || '{_N}payload-bytes: ' || strlen(html) || '{_N}text-chars: ' || length(plain)
     || '{_N}links: ' || len(regexp_extract_all(html, '(?i)<a\\s[^>]*href')) || '{_N}source-payload-digest: ' || pd || '{_N}Content-Type: text/html; charset=utf-8{_N}Content-Length: ' || strlen(html) FROM r)
SELECT page_id, record_type, {_sql_uuid("record_type || ':' || rid")} AS record_id, rid AS refers_to, url AS target_uri, pd AS source_digest,
       'sha256:' || sha256(content) AS block_digest, CAST(strlen(content) AS BIGINT) AS content_length, content
FROM k
"""
