"""WARC archives: writing, and reading with segment reassembly.

Writing: one HTTP response per page with chunked transfer framing. A block of more than ``SEGMENT`` bytes becomes a first
record and continuation records (WARC-Segment-Number, WARC-Segment-Origin-ID, on the last WARC-Segment-Total-Length). Of
pages with equal payloads of at least ``REVISIT_BYTES`` the one with the least page_id is a response, the others are
revisit records that name it. Archives are gzipped WARC/1.1 files written by Spark's text writer, whose line separator is
the record separator; records are cut between characters so that each is valid UTF-8.

Reading: records are found by Content-Length. Segments are grouped by origin identifier, ordered by segment number, and
put together if the numbers have no gap and the length is the stated total; then the chunked framing is decoded and the
digest compared. What fails a check is returned with ``intact`` false, not dropped.

Defined cases: null html counts as empty; null urls have no target line; null page_ids are kept, compare as greater than
all others, and refers_to is null where only such pages share a payload; repeated rows are records of their own, and all
that carry the least page_id are responses; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

SEGMENT, CHUNK, REVISIT_BYTES = 64 * 1024, 8 * 1024, 100
RECORDS_PER_FILE = 2048
SALTS = 16
_END = "\r\n\r\n"
_STAMP = "2024-01-01T00:00:00Z"


def cuts(data: bytes, size: int) -> list[bytes]:
    """Pieces of at most ``size`` bytes (4 at least) that don't split a UTF-8 character."""
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return out


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in cuts(payload, size)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if its framing is broken or cut short."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _head(kind: str, record_id: str, url: str | None, digest: str | None, length: int, more: dict[str, str]) -> str:
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": _STAMP}
    if url is not None:
        lines["WARC-Target-URI"] = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    if digest is not None:
        lines["WARC-Payload-Digest"] = f"sha256:{digest}"
    lines |= more
    if kind != "continuation":
        lines["Content-Type"] = "application/http;msgtype=response"
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + f"Content-Length: {length}{_END}"


def records(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment: int = SEGMENT) -> list[str]:
    """The records of one page, without the separator after each."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\n"
    if refers_to is not None:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload)
        more = {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        return [_head("revisit", record_id, url, digest, len(block), more) + block.decode()]
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = cuts(block, segment)
    out = []
    for number, part in enumerate(parts, 1):
        more = {"WARC-Segment-Number": str(number)} if len(parts) > 1 else {}
        if number > 1:
            more["WARC-Segment-Origin-ID"] = f"<{record_id}>"
        if 1 < number == len(parts):
            more["WARC-Segment-Total-Length"] = str(len(block))
        first = number == 1
        out.append(_head("response" if first else "continuation", record_id if first else f"{record_id}:{number}", url, digest if first else None, len(part), more) + part.decode())
    return out


def _write_rows(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for r in batch.to_pylist():
                name = f"urn:page:{'' if r['page_id'] is None else r['page_id']}:{r['row']}"
                refers = None if r["record_type"] == "response" else f"urn:page:{'' if r['first_id'] is None else r['first_id']}"
                payload = r["payload"].encode()
                out += records(name, r["url"], payload, r["digest"], refers, segment)
                held += len(payload)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return run


def write(pages: DataFrame, at: str, segment: int = SEGMENT) -> None:
    """Write the archives of ``pages(page_id, url, html)`` below the new folder ``at``."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("salt", F.when(F.octet_length("payload") >= REVISIT_BYTES, F.pmod(F.xxhash64("row"), F.lit(SALTS))))
    digests = pages.select("page_id", F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= REVISIT_BYTES)
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Only payloads that repeat are spread over the salts, so that a payload of a third of all pages meets many tasks.
    firsts = firsts.select("digest", "first_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    kind = F.when(F.col("first_id").isNull() | F.col("page_id").eqNullSafe(F.col("first_id")), "response").otherwise("revisit")
    marked = rows.join(firsts, ["digest", "salt"], "left").withColumn("record_type", kind)
    lines = marked.select("page_id", "row", "url", "payload", "digest", "first_id", "record_type").mapInArrow(_write_rows(segment), "value string")
    lines.write.option("lineSep", _END).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(at)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; stops where a record is cut short."""
    at = 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(head.get("content-length", "-1"))
        if not lines[0].startswith("WARC/") or size < 0 or end + 4 + size > len(data):
            return
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


_PARSED = "record_id string, origin string, segment int, total long, record_type string, refers_to string, digest string, block binary"


def _parse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _PARSED.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    for batch in batches:
        for data in batch.column(0):
            rows, held = [], 0
            raw = data.as_py()
            for head, block in parse(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                bare = lambda name: head[name].strip("<>") if name in head else None  # noqa: B023, E731
                number = head.get("warc-segment-number")
                rows.append((bare("warc-record-id"), bare("warc-segment-origin-id") or (bare("warc-record-id") if number else None), int(number or 0), int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None, head.get("warc-type"), bare("warc-refers-to"), head.get("warc-payload-digest", "").removeprefix("sha256:") or None, block))
                held += len(block)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


_DECODED = "record_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, segments int, intact boolean"


def _decode_rows(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                head, _, body = r["block"].partition(b"\r\n\r\n")
                fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
                whole = r["whole"]
                if r["record_type"] == "revisit":
                    n, digest, payload = int(fields.get(b"content-length", b"-1")), r["digest"], None
                    whole = whole and n >= 0
                else:
                    payload = unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
                    n, digest = (len(payload), hashlib.sha256(payload).hexdigest()) if payload is not None else (None, None)
                    whole = whole and digest is not None and r["digest"] in (None, digest)
                out.append((r["record_id"], n, digest, r["record_type"], r["refers_to"], r["segments"], whole, *([payload] if payloads else [])))
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.binary()]
            names = [x.split()[0] for x in _DECODED.split(", ")] + ["payload"]
            columns = list(zip(*out, strict=True)) if out else [[]] * (7 + payloads)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=False)], names=names[: len(columns)])

    return run


def read(spark: SparkSession, at: str, payloads: bool = False) -> DataFrame:
    """The records of the archives below ``at``, reassembled and decoded; with ``payloads``, their payload too.

    Only segments are shuffled. A group is one page's block.
    """
    parsed = spark.read.format("binaryFile").load(at).select("content").mapInArrow(_parse_rows, _PARSED)
    parts = parsed.where(F.col("origin").isNotNull()).groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"),
        F.max(F.when(F.col("segment") == 1, F.col("record_type"))).alias("record_type"), F.max("refers_to").alias("refers_to"), F.max(F.when(F.col("segment") == 1, F.col("digest"))).alias("digest"),
    )
    # A reader may meet a segment twice; the array_sort keeps equal numbers side by side and only the first is used.
    first = F.filter("parts", lambda p, i: (i == 0) | (p["segment"] != F.get(F.col("parts"), i - 1)["segment"]))
    joined = parts.withColumn("parts", first).withColumn("block", F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["block"])))
    gapless = (F.element_at("parts", 1)["segment"] == 1) & (F.element_at("parts", -1)["segment"] == F.size("parts"))
    multi = joined.select(F.col("origin").alias("record_id"), "record_type", "refers_to", "digest", "block", F.size("parts").alias("segments"), F.coalesce(gapless & (F.octet_length("block") == F.col("total")), F.lit(False)).alias("whole"))
    single = parsed.where(F.col("origin").isNull()).select("record_id", "record_type", "refers_to", "digest", "block", F.lit(1).alias("segments"), F.lit(True).alias("whole"))
    return single.unionByName(multi).mapInArrow(_decode_rows(payloads), _DECODED + (", payload binary" if payloads else ""))


def round_trip(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back: a row per page."""
    spark = pages.sparkSession
    at = scratch.path(spark, "warc")
    write(pages, at, segment)
    number = lambda name: F.element_at(F.split(name, ":"), 3).try_cast("long")
    return read(spark, at).select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"), "segments", "intact")
