"""WARC derivatives: each response gives a metadata and a plain-text conversion record.

``responses`` wraps crawled pages as response records (id, target, date, HTTP
header block, payload, payload digest).  ``derivatives`` reads responses and
returns, for each, a ``metadata`` record (application/warc-fields with the
source's identifiers, HTTP headers and digests, the title, language and number of
links) and a ``conversion`` record (the page's text).  Both refer to the response
by ``refers_to`` and to each other by ``concurrent_to``.  ``write_warc`` writes
records in WARC/1.1 form with Spark's text writer.  Every record is made from its
own row: no shuffle, and a lost task is simply run again.

Record ids are hashes of what the record holds, so a retry gives the same ids and
equal pages (same id, address and content) the same records.

Defined results: a null page is an empty payload, whose conversion is empty; a
null address or id stays null and is left out of the written headers; unclosed
tags, comments and scripts end with the page; repeated rows return their records
each time; an empty table gives none.  Extra columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices
from .registry import query

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 9562
#: Date of records whose source names none.
NO_DATE = "1970-01-01T00:00:00Z"

_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)", re.S | re.I)
_BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|"
    r"body|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*(?:>|\Z)", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*(?:>|\Z)")
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*\bhref\s*=", re.I)


def _plain(markup: str) -> str:
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", markup)))
    return _LINES.sub("\n", _BLANK.sub(" ", text)).strip()


def html_to_text(page: str) -> str:
    """Text of a page: a line for each block, white space collapsed."""
    return _plain(_DROPPED.sub(" ", page))


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, kind + ' ' + source)}>"


def _one_line(x: str) -> str:
    return " ".join(x.split())


RECORD_SCHEMA = ("page_id long, record_type string, record_id string, refers_to string, concurrent_to string, "
                 "target_uri string, date string, content_type string, block_digest string, "
                 "source_payload_digest string, content_length long, block string")
RESPONSE_COLUMNS = ("page_id", "record_id", "target_uri", "date", "http_headers", "payload", "payload_digest")


def responses(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
              date: Column | None = None) -> DataFrame:
    """Pages as response records."""
    payload = F.coalesce(F.col(html_column).cast("string"), F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                       F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    # lengths before the parts, so that no two rows run together into the same name
    name = F.sha1(F.concat_ws(":", *[F.concat(F.length(x).cast("string"), F.lit("="), x) for x in
                                     (F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.coalesce(F.col(url_column), F.lit("")), F.sha1(payload))]))
    urn = F.concat(F.lit("<urn:uuid:"), F.substring(name, 1, 8), F.lit("-"), F.substring(name, 9, 4), F.lit("-8"), F.substring(name, 14, 3),
                   F.lit("-a"), F.substring(name, 18, 3), F.lit("-"), F.substring(name, 21, 12), F.lit(">"))
    no_digest = F.lit(None).cast("string")  # computed with the derivatives unless the source has one
    return pages.select(F.col(id_column).cast("long").alias("page_id"), urn.alias("record_id"), F.col(url_column).cast("string").alias("target_uri"),
                        (F.lit(NO_DATE) if date is None else date).alias("date"), headers.alias("http_headers"),
                        payload.alias("payload"), no_digest.alias("payload_digest"))


def _derive(page_id, record_id, target, date, headers, payload, source_digest) -> list[tuple]:
    raw = payload or ""
    source_digest = source_digest or digest(raw.encode())
    body = _DROPPED.sub(" ", raw)
    meta_id, text_id = _record_id(record_id, "metadata"), _record_id(record_id, "conversion")
    status, *lines = (headers or "").replace("\r\n", "\n").strip().split("\n")
    title, lang = _TITLE.search(body), _LANG.search(body)
    fields = [("refers-to", record_id), ("source-uri", target), ("source-date", date), ("source-payload-digest", source_digest),
              ("source-status", status), *(("source-header", x) for x in lines if x.strip()),
              ("title", _one_line(_plain(title[1])) if title else None), ("language", lang[1].lower() if lang else None),
              ("links", str(len(_LINK.findall(body))))]
    meta = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields if v)
    text = _plain(body)
    return [(page_id, kind, own, record_id, other, target, date, form, digest(data := block.encode()), source_digest, len(data), block)
            for kind, own, other, form, block in (("metadata", meta_id, text_id, "application/warc-fields", meta),
                                                  ("conversion", text_id, meta_id, "text/plain; charset=utf-8", text))]


def derivatives(source: DataFrame) -> DataFrame:
    """Metadata and conversion records of response records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in text_slices(batch, "payload"):
                columns = [c.to_pylist() for c in batch.slice(at, to - at).columns]
                rows = [r for x in zip(*columns, strict=True) for r in _derive(*x)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    types = [pa.int64() if x.endswith(" long") else pa.string() for x in RECORD_SCHEMA.split(", ")]
    return source.select(*RESPONSE_COLUMNS).mapInArrow(run, RECORD_SCHEMA)


def record_text(records: DataFrame) -> DataFrame:
    """One column ``value``: each record in WARC/1.1 form, without the two line ends after its block."""
    def header(name: str, value: Column) -> Column:
        text = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")  # a header is one line
        return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), text, F.lit("\r\n"))).otherwise("")

    c = F.col
    return records.select(F.concat(
        F.lit("WARC/1.1\r\n"), header("WARC-Type", c("record_type")), header("WARC-Record-ID", c("record_id")),
        header("WARC-Date", c("date")), header("WARC-Refers-To", c("refers_to")), header("WARC-Concurrent-To", c("concurrent_to")),
        header("WARC-Target-URI", c("target_uri")), header("WARC-Block-Digest", c("block_digest")),
        header("Content-Type", c("content_type")), header("Content-Length", c("content_length")),
        F.lit("\r\n"), c("block")).alias("value"))


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write WARC files, one for each partition."""
    record_text(records).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


@query("op2_warc")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))
