"""WARC archives: writing with segmented and chunked records, reading by reassembly.

Writing gives each page one record - a response, or a revisit of the page with the same
payload and the largest id - whose block is an HTTP message in chunked transfer framing.
A block longer than ``SEGMENT`` bytes becomes a response record and continuation
records that name it as their origin.  That bounds every record, and with a fixed number
of records a file every file, so a file can be read whole by one task.  Pages are joined
with the choice of responses on the payload's digest; a digest that very many pages
share is an ordinary skewed join, which Spark splits.

Reading parses files where they lie, groups records by the identifier of their origin,
orders them by segment number, checks the total length, decodes the chunked framing and
checks the payload's digest.  Both directions use Spark's own readers and writers, so any
file system does.  Archives lie in a fresh folder below ``spark.checkpoint.dir``.

Defined cases: a null html is an empty payload; a null page id is kept, and largest ids
are sought among the others; repeated rows are written each, all of one id alike;
records with missing segments or a wrong length or digest come back with ``intact``
false and null payload fields; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberspark.llm.common import gathered, scratch, table, utf8

SEGMENT = 16 << 10
CHUNK = 4096
RECORDS_A_FILE = 2000
CRLF = b"\r\n"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at:at + size]
        parts += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*parts, b"0", CRLF, CRLF])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped.  ValueError if it is cut short."""
    parts, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(bytes(body[at:end]).split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        at = end + 2 + size
        parts.append(body[end + 2:at])
        if body[at:at + 2] != CRLF:
            raise ValueError("chunk without end")
        at += 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record without the two line ends behind it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block


def page_records(number: int, page: str | None, payload: bytes, refers: str | None, is_response: bool,
                 segment: int = SEGMENT) -> list[bytes]:
    """The records of one page; ``number`` is unique in the archive."""
    name = f"<urn:record:{number}>"
    fields = [("WARC-Record-ID", name), ("WARC-Page-ID", "" if page is None else quote(page)),
              ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    if not is_response:
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
        return [record([("WARC-Type", "revisit"), *fields, ("WARC-Refers-To-Page-ID", quote(refers))], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    cuts = [block[at:at + segment] for at in range(0, len(block), segment)]
    if len(cuts) == 1:
        return [record([("WARC-Type", "response"), *fields], block)]
    out = [record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", "1")], cuts[0])]
    for k, part in enumerate(cuts[1:], 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:record:{number}:{k}>"),
               ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k))]
        if k == len(cuts):
            own.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record(own, part))
    return out


def parse_records(data: bytes):
    """(fields, block) of every record of an archive, framed by Content-Length alone."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not at the start of a record")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        size = int(fields["content-length"])
        yield fields, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def read_message(fields: dict, block: bytes) -> dict:
    """type, page, refers_to, size and digest of a whole record; ``intact`` false if it does not hold."""
    out = {"page": unquote(fields["warc-page-id"]) or None, "type": fields["warc-type"],
           "refers": unquote(fields.get("warc-refers-to-page-id", "")) or None, "name": fields["warc-record-id"], "size": None, "digest": None, "intact": False}
    told = fields["warc-payload-digest"].removeprefix("sha1:")
    head, _, body = block.partition(b"\r\n\r\n")
    http = {k.lower(): v for k, v in (x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:])}
    if out["type"] == "revisit":
        return {**out, "size": int(http["content-length"]), "digest": told, "intact": True}
    try:
        payload = dechunked(body) if http.get("transfer-encoding") == "chunked" else body
    except ValueError:
        return out
    if digest32(payload) == told:
        out.update(size=len(payload), digest=told, intact=True)
    return out


def reassemble(parts: list[tuple]) -> tuple[dict, bytes] | None:
    """Fields and block from (number, total length, fields, block) parts; None unless complete."""
    parts = sorted(parts, key=lambda p: p[0])
    block = b"".join(p[3] for p in parts)
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1][1] != len(block):
        return None
    return parts[0][2], block


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", html: str = "html", least: int = 0,
                   segment: int = SEGMENT) -> None:
    """Write one record a page; payloads of at least ``least`` bytes are written once, and revisited."""
    own = pages.select(F.col(page_id).alias("page"), utf8(html).alias("payload")).withColumn("sha", F.sha1("payload"))
    chosen = own.where(F.length("payload") >= least).groupBy("sha").agg(F.max("page").alias("first"))
    told = own.join(chosen, "sha", "left").select(
        F.monotonically_increasing_id().alias("number"), F.col("page").cast("string").alias("page"), "payload",
        F.col("first").cast("string").alias("first"),
        (F.col("first").isNull() | F.coalesce(F.col("page") == F.col("first"), F.lit(False))).alias("is_response"))

    def run(batches):
        for b in batches:
            held, size = [], 0
            for number, page, payload, first, is_response in zip(*(b.column(c) for c in b.schema.names)):
                for one in page_records(number.as_py(), page.as_py(), payload.as_py(), first.as_py(), is_response.as_py(), segment):
                    held.append(one)
                    size += len(one)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])

    (told.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write
     .option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page, type, refers, size, digest, intact`` of every page in gzipped archives below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    parts = "origin string, number int, total long, fields map<string,string>, block binary"
    done = "page string, type string, refers string, size long, digest string, intact boolean"

    def parse(batches):
        schema = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()),
                            ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
        for b in batches:
            for content in b.column("content"):
                rows, size = [], 0
                for fields, block in parse_records(zlib.decompress(content.as_py(), 31)):
                    number = int(fields.get("warc-segment-number", 0))
                    if not number:  # a record in one part is read here, and only its findings are sent on
                        fields, block, total = read_message(fields, block), None, None
                    else:
                        total = fields.get("warc-segment-total-length")
                        size += len(block)
                    rows.append((fields.get("warc-segment-origin-id", fields.get("warc-record-id", fields.get("name"))), number,
                                 total, [(k, str(v)) for k, v in fields.items() if v is not None], block))
                    if size > 8 << 20:
                        yield pack(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pack(rows, schema)

    def pack(rows, schema):
        cols = list(zip(*rows))
        cols[2] = [None if x is None else int(x) for x in cols[2]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    def join(batches):
        """Rows come sorted by origin and number; number 0 is a record in one part."""
        schema = pa.schema([("page", pa.string()), ("type", pa.string()), ("refers", pa.string()), ("size", pa.int64()),
                            ("digest", pa.string()), ("intact", pa.bool_())])
        held, last = [], None

        def whole():
            if held[0][0] == 0:
                told = held[0][2]
                size = told.get("size")
                return {**{k: told.get(k) for k in ("page", "type", "refers", "digest")}, "size": None if size is None else int(size),
                        "intact": told["intact"] == "True"}
            found = reassemble(held)
            if found:
                told = read_message(*found)
                return {k: told[k] for k in schema.names}
            fields = {"warc-page-id": "", "warc-type": "response", **held[0][2]}
            return {"page": unquote(fields["warc-page-id"]) or None, "type": "response", "refers": None, "size": None,
                    "digest": None, "intact": False}

        for b in batches:
            out = []
            for origin, number, total, fields, block in zip(*(b.column(c) for c in b.schema.names)):
                origin = origin.as_py()
                if held and origin != last:
                    out.append(whole())
                    held = []
                last = origin
                held.append((number.as_py(), total.as_py(), dict(fields.as_py()), block.as_py()))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([whole()], schema=schema)

    return gathered(files.mapInArrow(parse, parts), ["origin"], ["number"]).mapInArrow(join, done)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    pages = table(spark, sf_dir, "pages", "page_id", "html")
    path = scratch(spark, "warc")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    return read_archives(spark, path).select(
        F.col("page").cast(kind).alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers").cast(kind).alias("refers_to"))


SQL = {"op6_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST((CAST('0x' || substr(h, 1 + 10 * CAST(i // 8 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT), 1)), '')
        AS payload_digest,
    CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM m
"""}
