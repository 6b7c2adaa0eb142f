"""WARC archives: write captures, read records, assemble transactions.

A capture is three records: a request, a response (or a revisit of an equal, earlier payload) and metadata.
Request and metadata name the response in WARC-Concurrent-To; assembly joins the records through it and
emits one nested row per capture.

The reader takes archives with or without gzip, in one member or in one per record, inflates them piece by piece
and holds one record at a time. Header names are read in any case, with or without blanks after the colon and with
continued lines. Equal payloads are found by digest; the pages of a hot digest, and the revisits of a hot response,
are dealt over many tasks. Payloads under ``least`` bytes take no part in that join.

Cases: null html is an empty payload; a null url is left out of the headers and kept as null in the metadata;
pages whose payload equals that of a smaller page_id are revisits when it has ``least`` bytes; a null page_id
is never the response others refer to unless no other is there; repeated rows are captures of their own with
equal record ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoline.llm.common import spread
from echoline.session import shared_dir, stored

HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Bytes inflated at a time; the blank line that ends a header.
PIECE, END = 1 << 20, re.compile(rb"\r?\n\r?\n")
RECORDS = (
    "type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, "
    "declared_digest string, payload_bytes long, payload_digest string, payload binary, meta string"
)


def _urn(kind: str, page_id: Column, digest: Column, url: Column) -> Column:
    """Record id made from what identifies a capture, so that reruns and retries agree."""
    h = F.md5(F.concat_ws("\n", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("")), digest, F.coalesce(url, F.lit(""))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """Header lines, a blank line and the block; a null header is left out. The writer's separator ends it."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.0"), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block))), F.lit("\r\n\r\n"), block)


def write_archives(pages: DataFrame, path: str, least: int = 100, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 64 << 20) -> None:
    """Write pages (page_id, url, html) as gzipped WARC files of about ``file_bytes`` before compression."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    # Only ids and digests are gathered; html is joined once, to the few digests that occur more than once.
    found = stored(rows.select("digest", "page_id", "url", F.octet_length("html").alias("bytes")), "warc-digests")
    first = (
        found.filter(F.col("bytes") >= least)
        .groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first is not null")
    )
    first = stored(first, "warc-first")
    mean = found.agg(F.coalesce(F.avg("bytes"), F.lit(0.0))).first()[0]
    small = F.octet_length("html") < least
    large = spread(rows.filter(~small), first, "digest", "n", "page_id", "left")
    rows = large.unionByName(rows.filter(small).withColumn("first", F.lit(None).cast(large.schema["first"].dataType)))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    own = _urn("response", F.col("page_id"), F.col("digest"), F.col("url"))
    # A header line must stay one line: anything but printable ASCII is percent-encoded there; metadata has the exact url.
    uri = F.when(F.col("url").rlike(r"[^\x21-\x7E]"), F.url_encode("url")).otherwise(F.col("url"))
    when = F.lit(date)

    def side(kind: str, content: str, block: Column) -> Column:
        return _record(
            [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", _urn(kind, F.col("page_id"), F.col("digest"), F.col("url"))), ("WARC-Date", when),
             ("WARC-Target-URI", uri), ("WARC-Concurrent-To", own), ("Content-Type", F.lit(content))], block)

    main = _record(
        [("WARC-Type", F.when(again, "revisit").otherwise("response")), ("WARC-Record-ID", own), ("WARC-Date", when), ("WARC-Target-URI", uri),
         ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
         ("WARC-Profile", F.when(again, F.lit(PROFILE))),
         ("WARC-Refers-To", F.when(again, _urn("response", F.col("first.page_id"), F.col("digest"), F.col("first.url")))),
         ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.when(again, F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), F.col("html"))))
    request = side("request", "application/http; msgtype=request", F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")))
    meta = side("metadata", "application/json", F.to_json(F.struct("page_id", "url"), {"ignoreNullFields": "false"}))
    records = rows.select(F.explode(F.array(request, main, meta)).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, int(file_bytes / (mean / 3 + 700)))).text(path)


def inflated(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The archive's bytes from its pieces: every gzip member in turn, or the pieces themselves if it is not gzipped."""
    held, zipped, member = b"", None, None
    for piece in pieces:
        held += piece
        if zipped is None:
            if len(held) < 2:
                continue
            zipped = held[:2] == b"\x1f\x8b"
        if not zipped:
            yield held
            held = b""
        full = False  # whether inflating stopped at PIECE bytes, with more to come
        while zipped and (held or full):
            if member is None:
                held = held.lstrip(b"\0")  # padding between members
                if not held:
                    break
                member = zlib.decompressobj(31)
            out = member.decompress(held, PIECE)
            held, full = member.unconsumed_tail, len(out) == PIECE and not member.eof
            if out:
                yield out
            if member.eof:
                held, member = member.unused_data, None
    if member is not None and not member.eof:
        raise ValueError("the archive ends inside a gzip member")
    if zipped is None and held:
        yield held


def headers(lines: list[str]) -> dict[str, str]:
    """Named fields by lower-case name; a line that begins with a blank goes on the line before it."""
    out, last = {}, None
    for line in lines:
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
        elif line:
            name, colon, value = line.partition(":")
            if not colon:
                raise ValueError(f"no header line: {line[:80]!r}")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive by their declared lengths, whatever the blocks contain; blank lines before a record are skipped."""
    data, parts = bytearray(), iter(pieces)

    def more() -> bool:
        piece = next(parts, None)
        if piece is not None:
            data.extend(piece)
        return piece is not None

    while True:
        while True:
            n = next((i for i, c in enumerate(data) if c not in b"\r\n"), len(data))
            del data[:n]
            if data or not more():
                break
        if not data:
            return
        at = 0
        while (found := END.search(data, at)) is None:
            at = max(0, len(data) - 3)
            if not more():
                raise ValueError("the archive ends inside a record's headers")
        version, *lines = data[: found.start()].decode("utf-8", "replace").splitlines()
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record: {version[:80]!r}")
        fields = headers(lines)
        end = found.end() + int(fields["content-length"])
        while len(data) < end:
            if not more():
                raise ValueError("the archive ends inside a record's block")
        yield fields, bytes(data[found.end() : end])
        del data[:end]


def _payload(block: bytes) -> bytes:
    """What follows the HTTP header; the whole block if there is none."""
    found = END.search(block)
    return block[found.end() :] if found and block[:5] == b"HTTP/" else block


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record of the archives in ``path``; digest and length are of the payload as read."""

    def rows(batches):
        names = [x.split(" ")[0] for x in RECORDS.split(", ")]
        types = [pa.int64() if x.endswith(" long") else pa.binary() if x.endswith("binary") else pa.string() for x in RECORDS.split(", ")]
        out, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names)

        for files in batches:
            for content in files.column("content"):
                raw = memoryview(content.as_buffer())
                for h, block in parse(inflated(bytes(raw[i : i + PIECE]) for i in range(0, len(raw), PIECE))):
                    kind = h.get("warc-type", "")
                    payload = _payload(block) if kind == "response" else None
                    out.append((
                        kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"),
                        h.get("warc-payload-digest"), None if payload is None else len(payload), None if payload is None else hashlib.sha256(payload).hexdigest(),
                        payload if payloads else None, block.decode("utf-8", "replace") if kind == "metadata" else None,
                    ))
                    held += len(block) if payloads else 500
                    if held > 8 << 20:
                        yield batch()
                        out, held = [], 0
        if out:
            yield batch()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (page_id, url, capture struct<request, main, metadata>).

    Equal record ids come only from repeated rows, so one request and one metadata record per response is kept.
    """
    main = records.filter("type in ('response', 'revisit')").drop("concurrent_to", "meta")
    side = lambda kind, *cols: records.filter(F.col("type") == kind).select(F.col("concurrent_to").alias("record_id"), F.struct("record_id", "target_uri", "date", *cols).alias(kind)).dropDuplicates(["record_id"])
    joined = main.join(side("request"), "record_id", "left").join(side("metadata", "meta"), "record_id", "left")
    page = F.from_json("metadata.meta", "page_id long, url string")
    return joined.select(page["page_id"].alias("page_id"), page["url"].alias("url"), F.struct("request", F.struct(*main.columns).alias("main"), "metadata").alias("capture"))


def captures(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Captures with every revisit resolved: ``payload_*`` and ``refers_page`` come from the response it refers to.

    The archives are parsed once, into a table in the shared folder. A revisit whose response is not there stays, with nulls.
    """
    nested = stored(assemble(stored(read_records(spark, path, payloads), "warc-records")), "warc-captures")
    whole = lambda c: F.col(f"capture.main.{c}").alias(c)
    parts = ["payload_bytes", "payload_digest", "payload"]
    answers = nested.filter("capture.main.type = 'response'").select(F.col("capture.main.record_id").alias("refers_to"), F.col("page_id").alias("refers_page"), *map(whole, parts)).dropDuplicates(["refers_to"])
    again = nested.filter("capture.main.type = 'revisit' and capture.main.refers_to is not null").withColumn("refers_to", F.col("capture.main.refers_to"))
    asked = again.groupBy("refers_to").agg(F.count(F.lit(1)).alias("n"))
    answers = stored(asked.join(answers, "refers_to"), "warc-answers")
    names = ["page_id", "url", "capture", *parts, "refers_page"]
    met = spread(again.withColumn("own", F.col("capture.main.record_id")), answers, "refers_to", "n", "own", "left")
    alone = nested.filter("not (capture.main.type = 'revisit' and capture.main.refers_to is not null)")
    return met.select(names).unionByName(alone.select("page_id", "url", "capture", *map(whole, parts), F.lit(None).cast("long").alias("refers_page")))


def page_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and tell each page's record."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least)
    return captures(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", F.col("capture.main.type").alias("record_type"), F.col("refers_page").alias("refers_to")
    )


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first_id FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT p.page_id, strlen(p.html)::BIGINT AS payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""
