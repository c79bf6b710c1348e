"""Legacy web archives: ARC records parsed and converted to WARC, archives written and read back.

``read_arc`` follows the URL record definition of the archive's own version line: version 1 has five fields, version 2 ten; either way the
last field is the declared length, which alone says where a record ends. ``to_warc`` synthesises what WARC needs and ARC lacks: a record id
from the record's content, an ISO timestamp from the 14-digit date, the record type, and SHA-1 digests; a revisit names its response by
WARC-Refers-To. Everything is bytes: legacy records are in any encoding.

``archive_pages`` writes pages through that converter into WARC files in the shared folder and reads them back. A file begins with a warcinfo
record, every record is a gzip member of its own, and files are cut by bytes (ARCHIVE_BYTES of records before compression; a longer record is
a file of its own). Files are written by Spark's own text writer, one row a file, so a lost task leaves no partial archive; the separator that
it puts at the end is an empty gzip member. Records with equal payloads are stored once, by the largest page_id; the others are revisits. A
payload's hash is summed before it is shuffled and goes back to its rows by a salted key, so a payload that a third of all pages share stays
spread.

Defined cases: a null html is an empty payload; a null url is stored as ``urn:none``; a null page_id counts as the smallest; repeated rows of
the largest page_id are all responses; rows repeated in full are the same record and have the same id; payloads of any length are read whole;
of equal payloads with one page_id but several urls the revisits name the largest url; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialize, only, shared_dir, table

QUERY = "op5_arc_to_warc"

# The fields of a URL record by version.
FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "result", "checksum", "location", "offset", "filename", "length"),
}
END = b"\r\n\r\n"
DATE = "20000101000000"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: A gzip member without content.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000030300000000000000" + "0000")
ARCHIVE_BYTES = 16 << 20
SALTS = 64
#: Revisits are broadcast to the pages up to this many rows (about 100 bytes each); more are joined by shuffling.
MOST_BROADCAST = 100_000
SAFE_URL = "%:/?#[]@!$&'()*+,;=~-._"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_arc(records: list[tuple[str, str, str, str, bytes]], version: int = 1, name: str = "legacy.arc") -> bytes:
    """An ARC file of (url, ip, 14-digit date, content type, network document) records."""
    names = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    body = f"{version} 0 millrace\n{names[version]}\n".encode()
    middle = "" if version == 1 else " 200 - - 0 " + name
    out = [f"filedesc://{name} 0.0.0.0 {DATE} text/plain{middle} {len(body)}\n".encode(), body, b"\n"]
    for url, ip, date, mime, document in records:
        out += [f"{url} {ip} {date} {mime}{middle} {len(document)}\n".encode(), document, b"\n"]
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[dict]:
    """The records after the version block: the fields of their line, and ``content``."""
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        parts = data[at:end].decode("utf-8", "replace").split(" ")
        length = int(parts[-1])
        content = data[end + 1 : end + 1 + length]
        if len(content) < length:
            raise ValueError(f"record at byte {at} declares {length} bytes; {len(content)} are left")
        at = end + 1 + length
        if version is None:
            if not parts[0].startswith("filedesc://"):
                raise ValueError("no version block")
            version = int(content.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"unknown version {version}")
            continue
        if len(parts) != len(FIELDS[version]):
            raise ValueError(f"{len(parts)} fields in a record of version {version}")
        yield dict(zip(FIELDS[version], parts, strict=True)) | {"content": content, "version": version}


def record_id(url: str, date: str, content: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {hashlib.sha1(content).hexdigest()}')}>"


def iso_date(date: str) -> str:
    """A 14-digit date; shorter ones, as old archives have them, are filled up."""
    d = (date + DATE[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def warcinfo(date: str = DATE) -> bytes:
    block = b"software: millrace\r\nformat: WARC File Format 1.0\r\n"
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", date, block)), ("WARC-Date", iso_date(date)), ("Content-Type", "application/warc-fields")], block)


def to_warc(arc: dict, refers_to: str | None = None, more: tuple[tuple[str, str], ...] = ()) -> bytes:
    """The WARC record for a parsed ARC record; a revisit, of the record with the id ``refers_to``, keeps the HTTP headers and drops the payload.

    ``more`` are extension fields.
    """
    content, date = arc["content"], arc["date"]
    head, gap, payload = content.partition(END) if arc["url"].startswith("http") or content.startswith(b"HTTP/") else (b"", b"", content)
    block = content if refers_to is None else head + gap
    kind = ("response" if gap else "resource") if refers_to is None else "revisit"
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(arc["url"], date, content)),
        ("WARC-Date", iso_date(date)),
        ("WARC-Target-URI", arc["url"]),
        ("WARC-IP-Address", arc["ip"]),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)]
    return record([*headers, *more, ("Content-Type", "application/http; msgtype=response" if gap else arc["mime"])], block)


def member(data: bytes) -> bytes:
    """One gzip member, the same whenever it is made."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(data: bytes) -> Iterator[bytes]:
    """What each gzip member holds, one at a time; data that is not gzip is taken as it is."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(data):
        reader, out = zlib.decompressobj(31), []
        while not reader.eof:
            fed = view[at : at + (1 << 16)]
            if not fed:
                raise ValueError("a gzip member is cut short")
            out.append(reader.decompress(fed))
            at += len(fed) - len(reader.unused_data)
        yield b"".join(out)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"the record at byte {at} declares {size} bytes; {len(block)} are left")
        yield headers, block
        at = end + 4 + size + len(END)


PARSED = "page_id long, payload_bytes long, payload_digest string, record_type string, target_uri string, record_id string, refers_to_id string, refers_to long"


def stored_url(url: str | None) -> str:
    return quote(url, safe=SAFE_URL) if url else "urn:none"


def http_document(page_id: int | None, payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n\r\n".encode() + payload


def convert(archive_bytes: int):
    """For mapInArrow: rows of (page_id, url, html, refers_to, refers_url) through ARC files of both versions in turn to WARC files, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, turn = [member(warcinfo())], 0, 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.large_binary())], names=["value"])
            held[1:] = []
            return out

        for batch in batches:
            for part in slices(batch, 1 << 20):
                ids, urls, html, refers, refers_urls = (c.to_pylist() for c in part.columns)
                documents = [http_document(i, (h or "").encode()) for i, h in zip(ids, html, strict=True)]
                turn += 1
                arc = write_arc([(stored_url(u), "0.0.0.0", DATE, "text/html", d) for u, d in zip(urls, documents, strict=True)], 1 + turn % 2)
                for k, x in enumerate(read_arc(arc)):
                    target = None if refers[k] is None else record_id(stored_url(refers_urls[k]), DATE, http_document(refers[k], (html[k] or "").encode()))
                    made = to_warc(x, target, () if target is None else (("X-Refers-To-Page", str(refers[k])),))
                    if size and size + len(made) > archive_bytes:
                        yield flush()
                        size = 0
                    held.append(member(made))
                    size += len(made)
        if size:
            yield flush()

    return run


def slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about so many bytes of html each."""
    size = [0 if x is None else x for x in pc.binary_length(batch.column(2)).to_pylist()]
    a = total = 0
    for b, n in enumerate(size):
        if b > a and total + n > most:
            yield batch.slice(a, b - a)
            a, total = b, 0
        total += n
    if a < len(size):
        yield batch.slice(a)


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of an archive's bytes as the rows of its records; the digest of a response is taken from its payload."""
    kinds = (pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64())
    for batch in batches:
        for blob in batch.column(0):
            rows = []
            for held in members(blob.as_buffer().to_pybytes()):
                for headers, block in read_warc(held):
                    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    if kind not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(END)
                    http = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                    if kind == "response" and sha1_base32(payload) != digest:
                        raise ValueError(f"the payload of {headers['warc-record-id']} does not have its digest")
                    page = http["X-Page-Id"].strip()
                    size = len(payload) if kind == "response" else int(http["Content-Length"])
                    rows.append((int(page) if page else None, size, digest, kind, headers["warc-target-uri"], headers["warc-record-id"], headers.get("warc-refers-to"), int(headers["x-refers-to-page"]) if kind == "revisit" else None))
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split(" ")[0] for x in PARSED.split(", ")])


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, sha, refers_to, refers_url) of pages whose payload a larger page_id has too."""
    html = F.coalesce("html", F.lit(""))
    keys = pages.select("page_id", F.struct("page_id", "url").alias("named"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("n")).where(F.col("n") >= min_bytes)
    keys = keys.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    part = keys.groupBy("sha", "salt").agg(F.max("named").alias("top"), F.count("*").alias("n"))
    whole = part.groupBy("sha").agg(F.max("top").alias("top"), F.sum("n").alias("n")).where(F.col("n") > 1).select("sha", F.col("top.page_id").alias("refers_to"), F.col("top.url").alias("refers_url"))
    told = part.select("sha", "salt").join(whole, "sha")
    out = keys.join(told, ["sha", "salt"]).where(F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to")))
    return materialize(out.where(F.col("refers_to").isNotNull()).select("page_id", "sha", "refers_to", "refers_url").distinct(), "revisits")


def archive_pages(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives, then reads them: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, record_id, refers_to_id."""
    spark = pages.sparkSession
    pages = only(pages, "page_id", "url", "html")
    again = revisits(pages, min_bytes)
    n = again.count()
    if n:
        r = again.select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "refers_to", "refers_url")
        sha = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
        rows = pages.join(F.broadcast(r) if n <= MOST_BROADCAST else r, pages["page_id"].eqNullSafe(r["_id"]) & (sha == r["_sha"]), "left").select("page_id", "url", "html", "refers_to", "refers_url")
    else:
        rows = pages.withColumns({"refers_to": F.lit(None).cast("long"), "refers_url": F.lit(None).cast("string")})
    at = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    # A cast from binary keeps the bytes as they are, and so does the writer.
    archives = rows.mapInArrow(convert(archive_bytes), "value binary").select(F.col("value").cast("string"))
    archives.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", 1).text(at)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(at).select("content")
    return files.mapInArrow(parse, PARSED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, array_to_string(list_transform(string_split(sha1(h), ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), '') AS bits FROM p),
d AS (SELECT page_id, n, s, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
  + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS INT), 1)), '') AS digest, max(page_id) OVER (PARTITION BY s) AS top FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM d"""
