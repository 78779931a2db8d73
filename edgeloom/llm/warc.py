"""WARC records, and the normaliser of archives that were compressed as one gzip stream.

An archive is a row of a table in the shared folder, so it can live in any store that Spark writes; ``export`` hands out the
bytes as files.  ``write_monolithic`` packs records into archives of one whole-file gzip stream each, as many tools do by
mistake.  ``normalise`` inflates such a stream once, front to back, rewrites every record as a gzip member of its own, and
makes the sidecar index of offsets.  ``read_records`` then reaches each record by its offset alone.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import materialise, salted_left_join

#: Uncompressed bytes after which a new archive begins; a record is never split.
ARCHIVE_BYTES = 8 << 20
#: Bytes of gzip that are inflated at a time, and bytes that one step may inflate to.
PIECE, CHUNK = 1 << 20, 8 << 20
LEVEL = 3
ID = "urn:x-page:"
DATE = "1970-01-01T00:00:00Z"  # pages have no time; a fixed one keeps archives reproducible


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """A response, or a revisit of ``refers_to``, whose block has the HTTP header but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return head, raw[end + 4 : end + 4 + int(head["content-length"])]


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def inflate(data: bytes) -> Iterator[bytes]:
    return inflate_stream(data[at : at + PIECE] for at in range(0, len(data), PIECE))


def inflate_stream(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The whole stream once, a bounded chunk at a time; further members of a file follow on.  A stream that ends early raises."""
    z, begun = zlib.decompressobj(31), False
    for piece in pieces:
        while piece:
            begun = True
            yield z.decompress(piece, CHUNK)
            piece = z.unconsumed_tail
            while z.eof:
                piece, z, begun = z.unused_data, zlib.decompressobj(31), False
                if not piece:
                    break
    if begun:
        yield z.flush()
        if not z.eof:
            raise ValueError("the gzip stream ends early")


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a stream; memory holds one record and one chunk."""
    held = bytearray()
    need = None
    for chunk in chunks:
        held += chunk
        at = 0
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                length = next(int(x.partition(b":")[2]) for x in bytes(held[at:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                need = end - at + 4 + length + 4
            if len(held) - at < need:
                break
            yield bytes(held[at : at + need])
            at, need = at + need, None
        del held[:at]
    if held:
        raise ValueError(f"the archive ends within a record ({len(held)} bytes left)")


def normalised_parts(chunks: Iterator[bytes], part_bytes: int) -> Iterator[tuple[bytes, list[tuple[int, int, str]]]]:
    """Archives with a member a record, and (offset, length, record id) of each; a new one begins after ``part_bytes``."""
    out, index, at = [], [], 0
    for record in split_records(chunks):
        member = _member(record)
        index.append((at, len(member), parse_record(record)[0]["warc-record-id"].strip("<>")))
        out.append(member)
        at += len(member)
        if at >= part_bytes:
            yield b"".join(out), index
            out, index, at = [], [], 0
    if index:
        yield b"".join(out), index


def normalise_bytes(data: bytes) -> tuple[bytes, list[tuple[int, int, str]]]:
    """The whole archive with a member a record, and its index."""
    return next(normalised_parts(inflate(data), 1 << 62), (b"", []))


def write_monolithic(records: DataFrame) -> DataFrame:
    """(page_id, url, payload, refers_to) -> archives (archive, data); data is one gzip stream of many records."""
    from pyspark import TaskContext

    def run(batches):
        n, size, z, out = 0, 0, zlib.compressobj(1, zlib.DEFLATED, 31), []
        part = TaskContext.get().partitionId()

        def close():
            nonlocal n, size, z, out
            row = pa.RecordBatch.from_arrays([pa.array([f"pages-{part:05d}-{n:05d}"]), pa.array([b"".join(out) + z.flush()], pa.binary())], names=["archive", "data"])
            n, size, z, out = n + 1, 0, zlib.compressobj(1, zlib.DEFLATED, 31), []
            return row

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*batch.columns):
                record = make_record(page_id.as_py(), url.as_py(), payload.as_py() or b"", refers_to.as_py())
                out.append(z.compress(record))
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield close()
        if size:
            yield close()

    return records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "archive string, data binary")


def normalise(archives: DataFrame, part_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, data) -> (archive, data, cdx); ``cdx`` is the sidecar: a line ``offset length record-id`` a record.

    A long archive becomes several, each of about ``part_bytes`` and with an index of its own (``<archive>``,
    ``<archive>-00001``, ...), so a task holds its input, one part and one record, whatever the stream inflates to."""

    def run(batches):
        for batch in batches:
            for name, data in zip(*batch.columns):
                for k, (body, index) in enumerate(normalised_parts(inflate(data.as_py()), part_bytes)):
                    cdx = "".join(f"{a} {n} {i}\n" for a, n, i in index)
                    own = name.as_py() if not k else f"{name.as_py()}-{k:05d}"
                    yield pa.RecordBatch.from_arrays([pa.array([own], pa.string()), pa.array([body], pa.binary()), pa.array([cdx], pa.string())], names=["archive", "data", "cdx"])

    return archives.select("archive", "data").mapInArrow(run, "archive string, data binary, cdx string")


def read_archives(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``archive, data`` of ``.warc.gz`` files in any store that Spark reads, whether one gzip stream or a member a record.

    A file is one value, so it may have up to 2 GB; ``normalise_file`` streams larger ones."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(\.warc)?(\.gz)?$", "")
    return files.select(name.alias("archive"), F.col("content").alias("data"))


def normalise_file(source, target, sidecar_target) -> int:
    """Normalise an archive from one open binary file into another, with its index as JSON lines; returns the number of records.

    For archives of any size: only a piece of gzip, a part and a record are in memory."""
    start = count = 0
    for body, index in normalised_parts(inflate_stream(iter(lambda: source.read(PIECE), b"")), ARCHIVE_BYTES):
        target.write(body)
        for a, n, i in index:
            sidecar_target.write((json.dumps({"offset": start + a, "length": n, "record_id": i}) + "\n").encode())
        start, count = start + len(body), count + len(index)
    return count


def read_records(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Records by their offsets: page_id, payload_bytes, payload_digest, record_type, refers_to (and the payload of responses).

    The digest and size of a response are computed from its payload (and must agree with its header); those of a revisit are
    in its headers.
    """
    number = lambda uri: int(x) if (x := uri.strip("<>").removeprefix(ID)) else None
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads

    def run(batches):
        for batch in batches:
            for data, cdx in zip(*batch.columns):
                data, rows = data.as_py(), []
                for line in cdx.as_py().splitlines():
                    at, n, _ = line.split(" ", 2)
                    head, block = parse_record(zlib.decompress(data[int(at) : int(at) + int(n)], 31))
                    cut = block.index(b"\r\n\r\n") + 4
                    digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                    length = next(int(x.partition(b":")[2]) for x in block[:cut].split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    payload = block[cut:] if kind == "response" else None
                    if payload is not None and (len(payload) != length or base32_sha1(payload) != digest):
                        raise ValueError(f"damaged record {head['warc-record-id']}")
                    rows.append((number(head["warc-record-id"]), length, digest, kind, number(head["warc-refers-to"]) if kind == "revisit" else None, payload))
                columns = list(zip(*rows)) if rows else [[]] * 6
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 5 + payloads]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[: len(names)], types)], names=names)

    return archives.select("data", "cdx").mapInArrow(run, schema)


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to``: of pages with equal payloads of at least ``least_bytes``, that with the largest
    page_id is the original and the others refer to it.  Equal by SHA-256: the SHA-1 of the header has known collisions, and
    such payloads both stay.  Only payloads that occur more than once enter the join's right side; rows of a very common one
    are spread over tasks."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    seen = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("original"))
    several = materialise(seen.filter("n > 1").select("digest", "original"))
    joined = salted_left_join(rows, several, "digest", F.xxhash64("page_id", "url"))
    refers = F.when(F.col("page_id").isNull() | (F.col("original") != F.col("page_id")), F.col("original"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write a record for each row of ``pages``, normalise the archives, and read every record back.

    Null html is an empty payload; a null url is left out, control characters of a url are percent-encoded.  Rows that repeat
    the largest page_id are all responses.  A null page_id never becomes an original unless no equal page has an id; then
    such rows are responses.  An empty table gives an empty result; other columns are not read.
    """
    archives = materialise(write_monolithic(with_originals(pages, least_bytes)))
    return read_records(materialise(normalise(archives)))


def sidecar(archives: DataFrame) -> DataFrame:
    """The index as a table: archive, offset, length, record_id."""
    line = F.explode(F.filter(F.split("cdx", "\n"), lambda x: x != "")).alias("line")
    part = F.split("line", " ", 3)
    return archives.select("archive", line).select("archive", part[0].cast("bigint").alias("offset"), part[1].cast("bigint").alias("length"), part[2].alias("record_id"))


def export(archives: DataFrame, folder: str) -> None:
    """Write ``<archive>.warc.gz`` and ``<archive>.cdx.json`` into a folder that all executors mount."""

    def put(rows):
        for r in rows:
            with open(f"{folder}/{r.archive}.warc.gz", "wb") as f:
                f.write(r.data)
            with open(f"{folder}/{r.archive}.cdx.json", "w") as f:
                for x in r.cdx.splitlines():
                    at, n, i = x.split(" ", 2)
                    f.write(json.dumps({"offset": int(at), "length": int(n), "record_id": i}) + "\n")

    archives.select("archive", "data", "cdx").foreachPartition(put)


# SHA-1 as base32: 5 hexadecimal digits are 4 letters
ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
o AS (SELECT sha256(body) AS k, max(page_id) AS original FROM p GROUP BY ALL),
r AS (SELECT p.page_id, octet_length(body)::BIGINT AS payload_bytes, upper(sha1(body)) AS x, CASE WHEN original IS DISTINCT FROM page_id THEN original END AS refers_to FROM p JOIN o ON o.k = sha256(body)),
v AS (SELECT *, list_transform(range(0, 40, 5), lambda i: list_reduce(list_transform(range(1, 6), lambda j: strpos('0123456789ABCDEF', substr(x, (i + j)::BIGINT, 1)) - 1), lambda a, b: a * 16 + b)) AS fives FROM r)
SELECT page_id, payload_bytes, array_to_string(list_transform(fives, lambda f: array_to_string(list_transform([32768, 1024, 32, 1], lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((f // d) % 32 + 1)::BIGINT, 1)), '')), '') AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM v
"""
