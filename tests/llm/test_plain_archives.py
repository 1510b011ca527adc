"""Archives read by a plain reader of the format, and archives of other writers."""

from __future__ import annotations

import glob
import gzip

from pyspark.sql import functions as F

from veilframe.llm import warc
from veilframe.session import work_path


def parse(data: bytes):
    """Records (headers, block) by version line, headers, Content-Length and two line breaks; anything else is an error."""
    out, at = [], 0
    while at < len(data):
        assert data.startswith(b"WARC/1.1\r\n", at), data[at : at + 40]
        end = data.index(b"\r\n\r\n", at)
        headers = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        begin = end + 4
        stop = begin + int(headers["Content-Length"])
        assert data[stop : stop + 4] == b"\r\n\r\n"
        out.append((headers, data[begin:stop]))
        at = stop + 4
    return out


def test_files_are_archives(spark):
    html = [None, "", "x" * 150, "x" * 150, "é" * 90 + "WARC/1.1\r\n", "\r\n\r\n", "end\r\n"]
    pages = spark.createDataFrame([(i, f"http://h/{i}", t) for i, t in enumerate(html)], "page_id long, url string, html string").repartition(3)
    path = work_path(spark, "archive")
    warc.write_pages(pages, path)
    found = []
    for name in glob.glob(f"{path}/part-*"):
        with gzip.open(name) as f:
            found += parse(f.read())
    assert len(found) == 3 * len(html)
    assert {h["WARC-Type"] for h, _ in found} == {"request", "response", "revisit", "metadata"}
    answers = [h["WARC-Record-ID"] for h, _ in found if h["WARC-Type"] in ("response", "revisit")]
    assert all(h["WARC-Concurrent-To"] in answers for h, _ in found if h["WARC-Type"] in ("request", "metadata"))
    assert warc.read_records(spark, path).where("complete").count() == 3 * len(html)


def _record(kind, ident, to=None, block=""):
    named = f"WARC-Concurrent-To: {to}\r\n" if to else ""
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {ident}\r\n{named}Content-Length: {len(block.encode())}\r\n\r\n{block}\r\n\r\n"


def test_archives_of_other_writers(spark):
    page = "HTTP/1.1 200 OK\r\n\r\nhello"
    text = "".join([
        _record("warcinfo", "<i>"),
        _record("response", "<r1>", "<q1>", page), _record("request", "<q1>"), _record("metadata", "<m1>", "<q1>"),
        _record("request", "<q2>", "<r2>"), _record("response", "<r2>", "<q2>", page), _record("metadata", "<m2>", "<r2>"),
        _record("request", "<q3>"), _record("request", "<q4>"), _record("metadata", "<m5>", "<gone>"), _record("response", "<r6>", None, page),
    ])
    path = work_path(spark, "foreign")
    spark.createDataFrame([(text[:-2],)], "value string").coalesce(1).write.option("lineSep", "\r\n").text(path)
    got = warc.captures(warc.read_records(spark, path)).select(
        "capture_id", F.col("request.record_id").alias("q"), F.col("response.record_id").alias("r"), F.col("metadata.record_id").alias("m")).collect()
    assert {tuple(r) for r in got} == {
        ("<i>", None, None, None), ("<r1>", "<q1>", "<r1>", "<m1>"), ("<r2>", "<q2>", "<r2>", "<m2>"), ("<q3>", "<q3>", None, None),
        ("<q4>", "<q4>", None, None), ("<gone>", None, None, "<m5>"), ("<r6>", None, "<r6>", None)}
