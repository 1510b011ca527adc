"""Web archives: writing pages as WARC records, reading them back, and transaction assembly.

Every page becomes a request, a response (or a revisit) and a metadata record; request and
metadata name the response in WARC-Concurrent-To. Reading parses records one at a time and
assembles transactions: records meet under the id of their response (their concurrent-to id, or
their own for responses and revisits) in one shuffle, and each capture comes out as one nested
row. That grouping is the three-way join on concurrent-to; it reads the archive once.

Archives are text files, each record with its version line, headers, block and two line breaks, written
and read by Spark's own text source (reading takes the version line as the separator of records), so they can lie in any store that Spark reaches and records
are read as a stream. A payload that contains the version line itself is stored with chunked
transfer coding, with a chunk border inside each such line, so no payload can be mistaken for a
record border. Reading checks every Content-Length.

Revisits. Of records with equal payloads of at least ``LEAST_BYTES`` bytes, those of the smallest
page id are responses and all others revisits, without payload; digests of repeated payloads are
found first, and joined to the pages behind a check of their number.

Defined results: null html is an empty payload; null ids and urls are written as empty fields and
read back as null; repeated rows are separate captures (ids of records hold the row's place);
of repeated payloads whose ids are all null every record is a response; line breaks in a url are
percent-encoded; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import sized_join, written

LEAST_BYTES = 100
VERSION = "WARC/1.1\r\n"
_BREAK = "\r\n"
_END = _BREAK * 2


def _urn(kind: str, key: Column) -> Column:
    """A record id in the form of a UUID, derived from a key."""
    h = F.md5(F.concat(F.lit(kind), F.lit(":"), key))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """Headers and block; headers that are null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in headers]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    # The line separator of the text source is the second of the two line breaks after a block.
    return F.concat(F.lit(VERSION), *[F.coalesce(x, F.lit("")) for x in lines], size, F.lit(_END), block, F.lit(_BREAK))


def _http(payload: Column) -> Column:
    """A response with the payload, in chunks if the payload holds a version line."""
    mark = VERSION.strip()
    plain = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(payload).cast("string"), F.lit(_END), payload,
    )
    # A chunk ends between the first half of each version line and the rest.
    pieces = F.split(payload, f"(?<={mark[:4]})(?={mark[4:]})", -1)
    chunk = F.transform(pieces, lambda p: F.concat(F.lower(F.hex(F.octet_length(p))), F.lit("\r\n"), p, F.lit("\r\n")))
    chunked = F.concat(
        F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked{_END}"),
        F.array_join(chunk, ""), F.lit(f"0{_END}"),
    )
    return F.when(F.contains(payload, F.lit(mark)), chunked).otherwise(plain)


def write_pages(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write pages (page_id, url, html) as compressed WARC files below ``path``."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
        payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"),
    )
    firsts = base.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("keep"), F.count("*").alias("n"))
    repeated = written(firsts.where("n > 1 and keep is not null").select("digest", "keep"), "payloads")
    marked = sized_join(base, repeated, "digest", "left").withColumn("place", F.monotonically_increasing_id())
    revisit = F.coalesce(F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep")), F.lit(False))
    key = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "place")
    response_id, target = _urn("response", key), F.nullif(F.col("url"), F.lit(""))
    when = F.lit(date)
    named = F.concat(F.lit("sha256:"), F.col("digest"))
    body = F.when(revisit, F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8{_END}")).otherwise(_http(F.col("payload")))
    about = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\npayloadLength: "), F.col("size").cast("string"), F.lit("\r\n"))
    request = F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(" HTTP/1.1"), F.lit(_END))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    profile = F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    http = lambda what: F.lit(f"application/http;msgtype={what}")
    records = F.array(
        _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn("request", key)), ("WARC-Date", when), ("WARC-Target-URI", target),
                 ("WARC-Concurrent-To", response_id), ("Content-Type", http("request"))], request),
        _record([("WARC-Type", kind), ("WARC-Record-ID", response_id), ("WARC-Date", when), ("WARC-Target-URI", target),
                 ("WARC-Payload-Digest", named), ("WARC-Profile", profile), ("Content-Type", http("response"))], body),
        _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn("metadata", key)), ("WARC-Date", when), ("WARC-Target-URI", target),
                 ("WARC-Concurrent-To", response_id), ("Content-Type", F.lit("application/warc-fields"))], about),
    )
    lines = marked.select(F.explode(records).alias("value"))
    lines.write.option("lineSep", _BREAK).option("compression", "gzip").text(path)


def _header(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*$", 1), F.lit(""))


def _unchunk(body: Column) -> Column:
    """The payload of a body in chunks. A border stands only where ``write_pages`` puts it."""
    mark = VERSION.strip()
    inner = F.regexp_replace(body, f"(?<={mark[:4]})\r\n[0-9a-f]+\r\n(?={mark[4:]})", "")
    inner = F.regexp_replace(inner, "^[0-9a-f]+\r\n", "")
    return F.substr(inner, F.lit(1), F.length(inner) - F.lit(len("\r\n0\r\n\r\n")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: type, ids, target, digests, and of responses the payload with what it measures."""
    lines = spark.read.option("lineSep", VERSION).text(path).where(F.col("value") != "")
    head = F.substring_index("value", _END, 1)
    cut = lines.select(head.alias("head"), F.substr("value", F.length(head) + F.lit(len(_END) + 1)).alias("rest"))
    cut = cut.select("head", F.expr(f"substr(rest, 1, length(rest) - {len(_END)})").alias("block"))
    named = cut.select(
        _header(F.col("head"), "WARC-Type").alias("type"),
        _header(F.col("head"), "WARC-Record-ID").alias("record_id"),
        _header(F.col("head"), "WARC-Concurrent-To").alias("concurrent_to"),
        _header(F.col("head"), "WARC-Target-URI").alias("target"),
        F.substring_index(_header(F.col("head"), "WARC-Payload-Digest"), ":", -1).alias("digest"),
        _header(F.col("head"), "Content-Length").cast("long").alias("content_length"),
        "block",
    )
    http = F.substring_index("block", _END, 1)
    body = F.substr("block", F.length(http) + F.lit(len(_END) + 1))
    payload = F.when(F.col("type") == "response", F.when(F.contains(http, F.lit("Transfer-Encoding: chunked")), _unchunk(body)).otherwise(body))
    return named.select(
        "type", "record_id", "concurrent_to", "target", "digest",
        (F.octet_length("block") == F.col("content_length")).alias("complete"),
        payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"),
        F.when(F.col("type") == "metadata", F.col("block")).alias("fields"),
    )


def captures(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """One nested row per capture: page_id, target, request, response and metadata.

    Requests and metadata may name their response in concurrent-to, or a response its request; a record that is
    named by none and names none is a capture of its own. A record that is missing leaves its struct null.
    ``record_type`` is response or revisit.
    """
    answer = F.col("type").isin("response", "revisit")
    # Responses that name another record (its id stands for theirs then); none in archives of ``write_pages``.
    named = records.where(answer & F.col("concurrent_to").isNotNull())
    named = written(named.groupBy(F.col("concurrent_to").alias("named_id")).agg(F.min("record_id").alias("answer_id")), "named-records")
    own = F.when(answer, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    records = sized_join(records.withColumn("own_id", own), named, F.col("own_id") == F.col("named_id"), "left")
    group = F.when(answer, F.col("record_id")).otherwise(F.coalesce("answer_id", "own_id"))
    response = F.struct("record_id", "type", "target", "digest", "complete", "payload_bytes", "payload_digest", *(["payload"] if with_payload else []))
    other = F.struct("record_id", "target", "complete")
    told = lambda name: F.regexp_extract("fields", rf"(?m)^{name}:[ \t]*([0-9-]+)", 1)
    about = F.struct("record_id", "complete", told("pageId").try_cast("long").alias("page_id"), told("payloadLength").try_cast("long").alias("payload_length"))
    pick = lambda test, what, name: F.first(F.when(test, what), ignorenulls=True).alias(name)
    return records.groupBy(group.alias("capture_id")).agg(
        pick(F.col("type") == "request", other, "request"),
        pick(answer, response, "response"),
        pick(F.col("type") == "metadata", about, "metadata"),
    ).withColumns({"page_id": F.col("metadata.page_id"), "record_type": F.col("response.type")})


def resolved(assembled: DataFrame) -> DataFrame:
    """Per capture page_id, payload_bytes, payload_digest, record_type and, of revisits, the page they refer to."""
    flat = written(assembled.select(
        "page_id", "record_type", F.col("response.digest").alias("payload_digest"),
        F.coalesce("response.payload_bytes", "metadata.payload_length").alias("payload_bytes"),
        (F.col("response.complete") & (F.coalesce("response.payload_digest", "response.digest") == F.col("response.digest"))).alias("sound"),
    ), "captures")
    broken = flat.where("not sound").limit(1).count()
    if broken:
        raise ValueError("an archive holds a record whose length or payload digest does not agree")
    asked = flat.where("record_type = 'revisit'").select("payload_digest").distinct()
    known = flat.where("record_type = 'response'").join(asked, "payload_digest", "left_semi").groupBy("payload_digest").agg(F.min("page_id").alias("first_page"))
    joined = sized_join(flat, written(known, "originals"), "payload_digest", "left")
    return joined.select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("first_page")).alias("refers_to"))
