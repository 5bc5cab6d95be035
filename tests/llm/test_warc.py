import base64
import glob
import hashlib
from html.parser import HTMLParser

import pytest
from facsimile.llm import warc
from pyspark.sql import types as T

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                      T.StructField("block", T.StringType()), T.StructField("record_id", T.StringType())])
EDGE = [(1, "http://a.example/", None), (2, None, ""), (None, "http://b.example/", "<p>no id"), (4, "http://c.example/", "<p>x</p>" * 20_000),
        (5, "u", "<title>A &amp; B</title><script>var t='</p>'</script><p>one<br>two &lt;three&gt; &#233;&nbsp;x<!-- gone"),
        (6, "u", "<script>never closed <p>x"), (7, "u", "a < b and <b>bold</b><"), (7, "u", "a < b and <b>bold</b><")]


@pytest.fixture()
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)


class Plain(HTMLParser):
    BREAKS = {"br", "p", "div", "h1", "li", "ul", "nav", "article", "footer", "title", "html", "head", "body"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.parts += ["\n"] * (tag in self.BREAKS)

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        self.parts += ["\n"] * (tag in self.BREAKS)

    def handle_data(self, data):
        self.parts += [] if self.skip else [data]


def parsed(page):
    p = Plain()
    p.feed(page)
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
    return "\n".join(x for x in lines if x)


def test_text_equals_that_of_a_parser():
    import pyarrow.parquet as pq
    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist():
        assert warc.html_to_text(page) == parsed(page)


def test_records_are_linked_and_digested(pages):
    rows = warc.derivatives(warc.responses(pages(EDGE))).collect()
    sources = {r.record_id: r for r in warc.responses(pages(EDGE)).collect()}
    assert len(rows) == 2 * len(EDGE) and len(sources) == len(EDGE) - 1  # equal pages are one response
    by_id = {r.record_id: r for r in rows}
    for r in rows:
        other = by_id[r.concurrent_to]
        source = sources[r.refers_to]
        assert other.concurrent_to == r.record_id and other.refers_to == r.refers_to and other.record_type != r.record_type
        assert r.target_uri == source.target_uri and r.date == source.date
        digest = "sha1:" + base64.b32encode(hashlib.sha1(r.block.encode()).digest()).decode()
        assert r.block_digest == digest and r.content_length == len(r.block.encode())
        assert r.source_payload_digest == warc.digest(source.payload.encode())
        if r.record_type == "metadata":
            fields = dict(x.split(": ", 1) for x in r.block.strip().split("\r\n"))
            assert fields["refers-to"] == r.refers_to and fields["source-payload-digest"] == r.source_payload_digest
            assert "source-header: Content-Type: text/html; charset=utf-8" in r.block
        else:
            assert r.block == warc.html_to_text(source.payload)
    text = next(r.block for r in rows if r.page_id == 5 and r.record_type == "conversion")
    assert text == "A & B\none\ntwo <three> é x"


def test_written_files_can_be_read_by_their_lengths(pages, tmp_path):
    records = warc.derivatives(warc.responses(pages(EDGE)))
    warc.write_warc(records, str(tmp_path / "out"))
    found = []
    for path in glob.glob(str(tmp_path / "out/part-*")):
        data = open(path, "rb").read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            n = int(fields["Content-Length"])
            assert version == "WARC/1.1" and rest[n:n + 4] == b"\r\n\r\n"
            found.append((fields["WARC-Record-ID"], rest[:n].decode()))
            data = rest[n + 4:]
    assert sorted(found) == sorted((r.record_id, r.block) for r in records.collect())


def test_no_pages(pages):
    assert warc.derivatives(warc.responses(pages([]))).count() == 0
