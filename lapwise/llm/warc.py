"""WARC archives from legacy ARC archives, with revisit records for equal payloads.

Pages become ARC files (version 1 or 2), a shard each partition; the converter parses the version's header lines, takes
each record's declared length, and synthesises the WARC equivalents: a record id (a name-based UUID of url, date and
digest), the 14-digit date as an ISO timestamp, the record type, and base32 SHA-1 digests of payload and block. Of equal
payloads of at least min_bytes the record with the smallest id is the response and the others are revisits that refer to
its record id; smaller payloads are all responses. Every ARC and WARC record is a gzip member of its own.

ARC header lines (fixed values of the format): version 1 has URL, IP, date, content type and length; version 2 has URL,
IP, date, content type, result code, checksum, location, offset, file name and length. The version block's third line
names the fields of its version.

Files go to the shared folder under names of their own per attempt; tables list the files that count. Which record is
the response comes from a grouping on digest and length, with the minimum taken before the shuffle, and a join that
Spark may split where a payload is very common.

Defined cases: null html is an empty payload; a null url is the empty url, and white space in a url is percent-encoded;
a null id is never referred to unless all of its group are null; rows that repeat an id are records of their own, one of
them the response (the first as Spark reads them, so the pages must come in the same order when they are read again, as
files do); an empty id stays empty; columns beside id, url and html are not archived; an empty table gives no file and an
empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lapwise.llm import textblocks as tb
from lapwise.llm.scratch import fresh_path, written
from lapwise.llm.token_files import open_at

ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
DATE = "20240101000000"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SPACE_FOR = "warc:"
SHARD_BYTES = 64 << 20


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- ARC ------------------------------------------------------------------------------------------------------------


def arc_version_block(version: int, name: str) -> bytes:
    """The first record of an ARC file, with the fields of its version."""
    body = f"{version} 0 lapwise\n{ARC_FIELDS[version]}\n\n".encode()
    head = [f"filedesc://{name}", "0.0.0.0", DATE, "text/plain", *(["200", "-", "-", "0", name] if version == 2 else []), str(len(body))]
    return " ".join(head).encode() + b"\n" + body


def arc_record(version: int, url: str, block: bytes, name: str, offset: int) -> bytes:
    """A record: the header line of the version, the block of the declared length, a line end."""
    head = [url, "0.0.0.0", DATE, "text/html", *(["200", digest(block), "-", str(offset), name] if version == 2 else []), str(len(block))]
    return " ".join(head).encode() + b"\n" + block + b"\n"


def read_arc(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields by name, and the block, of every record after the version block; source: a buffered binary file."""
    first = source.readline().decode()
    length = int(first.rsplit(" ", 1)[1])
    version_block = source.read(length)
    fields = version_block.decode().split("\n")[1].split(" ")
    if fields not in [v.split(" ") for v in ARC_FIELDS.values()]:
        raise ValueError(f"ARC fields not known: {fields}")
    while line := source.readline():
        if line == b"\n":
            continue
        parts = line.decode().rstrip("\n").split(" ")
        if len(parts) != len(fields):
            raise ValueError(f"an ARC header line has {len(parts)} fields, its version {len(fields)}")
        head = dict(zip(fields, parts, strict=True))
        block = source.read(int(head["Archive-length"]))
        if len(block) != int(head["Archive-length"]):
            raise ValueError("an ARC record is shorter than its declared length")
        yield head, block


# ---- WARC -----------------------------------------------------------------------------------------------------------


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    """A gzip member with one record."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", compresslevel=3, mtime=0)


def record_id(page: str | None, url: str, date: str, payload_digest: str, tag: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{SPACE_FOR}{page}|{url}|{date}|{payload_digest}|{tag}')}>"


def warc_fields(head: dict[str, str], payload: bytes, block: bytes, page: dict) -> dict[str, str]:
    """The WARC equivalents of an ARC header. page: id, tag, revisit and original (id, tag, url), as with_revisits has them."""
    d, own, original = head["Archive-date"], digest(payload), page["original"]
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    fields = {"WARC-Type": "response" if original is None else "revisit", "WARC-Record-ID": record_id(page["id"], head["URL"], d, own, page["tag"]), "WARC-Date": date, "WARC-Target-URI": head["URL"], "WARC-IP-Address": head["IP-address"], "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{own}", "WARC-Block-Digest": f"sha1:{digest(block)}", "X-Payload-Length": str(len(payload))}
    if page["id"] is not None:
        fields["X-Page-ID"] = quote(page["id"])
    if original is not None:
        url = _page_url(original["url"])
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(original["id"], url, d, own, original["tag"]), "WARC-Refers-To-Target-URI": url, "WARC-Refers-To-Date": date}
        if original["id"] is not None:
            fields["X-Refers-To-Page-ID"] = quote(original["id"])
    return fields


def read_warc(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of every record of a decompressed stream."""
    while line := source.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record does not begin with its version")
        fields = {}
        while (line := source.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            fields[k] = v
        block = source.read(int(fields["Content-Length"]))
        if f"sha1:{digest(block)}" != fields["WARC-Block-Digest"]:
            raise ValueError(f"{fields['WARC-Record-ID']}: the block digest is wrong")
        yield fields, block


class ShardWriter:
    """Files under a folder, a new one when shard_bytes are reached; remembers their URIs."""

    def __init__(self, folder: str, suffix: str, shard_bytes: int = SHARD_BYTES) -> None:
        self.folder, self.suffix, self.shard_bytes = folder, suffix, shard_bytes
        self.out, self.at, self.uris = None, 0, []

    def room(self) -> str:
        """Opens a file if none is open; its name."""
        if self.out is None or self.at >= self.shard_bytes:
            self.close()
            uri = f"{self.folder}/{uuid.uuid4().hex}{self.suffix}"
            fs, path = open_at(uri)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            self.out, self.at = fs.open_output_stream(path, compression=None), 0
            self.uris.append(uri)
        return self.uris[-1].rpartition("/")[2]

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _page_url(url: str | None) -> str:
    return quote(url or "", safe="/:?#[]@!$&'()*+,;=%~") or "-"


ORIGINAL = pa.struct([("id", pa.string()), ("tag", pa.int64()), ("url", pa.string())])
PAGE = pa.struct([("id", pa.string()), ("tag", pa.int64()), ("original", ORIGINAL)])
ARCS = pa.schema([("uri", pa.string()), ("pages", pa.list_(PAGE))])
ARCS_DDL = "uri string, pages array<struct<id: string, tag: long, original: struct<id: string, tag: long, url: string>>>"


def write_arc(pages: DataFrame, folder: str, *, version: int = 1) -> DataFrame:
    """ARC files of the pages (as with_revisits gives them); the table of their URIs, with what ARC has no field for in file order."""
    text = lambda c: F.col(c).cast("string").alias(c.rpartition(".")[2])
    original = F.when(F.col("original").isNotNull(), F.struct(text("original.id"), "original.tag", "original.url"))
    chosen = pages.select("url", "html", F.struct(text("id"), "tag", original.alias("original")).alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held = ShardWriter(folder, ".arc.gz"), {}
        for part, _, _ in tb.text_blocks(batches, "html"):
            for u, h, page in zip(*(part.column(c).to_pylist() for c in ("url", "html", "page")), strict=True):
                name = files.room()
                if not files.at:
                    files.write(gzip.compress(arc_version_block(version, name), compresslevel=1, mtime=0))
                files.write(gzip.compress(arc_record(version, _page_url(u), HTTP_HEAD + (h or "").encode(), name, files.at), compresslevel=1, mtime=0))
                held.setdefault(files.uris[-1], []).append(page)
        files.close()
        for uri, rows in held.items():
            yield pa.RecordBatch.from_pylist([{"uri": uri, "pages": rows}], schema=ARCS)

    return chosen.mapInArrow(run, ARCS_DDL)


def _dealt(files: DataFrame) -> DataFrame:
    """A task a file: Spark keeps a number of partitions that it is given."""
    return files.repartition(max(1, files.count()), "uri")


def convert_arc(arcs: DataFrame, folder: str) -> DataFrame:
    """WARC files from ARC files (uri, pages); the table of their URIs. A file is streamed record by record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                files = ShardWriter(folder, ".warc.gz")
                fs, path = open_at(batch.column("uri")[i].as_py())
                with gzip.open(io.BufferedReader(fs.open_input_file(path), 1 << 20)) as source:
                    for page, (head, block) in zip(batch.column("pages")[i].as_py(), read_arc(source), strict=True):
                        payload = block.partition(b"\r\n\r\n")[2]
                        kept = block if page["original"] is None else block[: len(block) - len(payload)]
                        files.room()
                        files.write(warc_record(warc_fields(head, payload, kept, page), kept))
                files.close()
                yield pa.RecordBatch.from_pydict({"uri": files.uris})

    return _dealt(arcs).mapInArrow(run, "uri string")


def read_warcs(files: DataFrame) -> DataFrame:
    """A row per record of the WARC files; sizes and digests of responses are those of the payloads that were read."""

    def row(f: dict[str, str], block: bytes) -> dict:
        page, target = f.get("X-Page-ID"), f.get("X-Refers-To-Page-ID")
        size, own = int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:")
        if f["WARC-Type"] == "response":  # a revisit's payload lies in the response it refers to
            payload = block.partition(b"\r\n\r\n")[2]
            if (size, own) != (len(payload), digest(payload)):
                raise ValueError(f"record {f['WARC-Record-ID']}: the payload is not the one that its header names")
            size, own = len(payload), digest(payload)
        return {"page_id": None if page is None else unquote(page), "payload_bytes": size, "payload_digest": own, "record_type": f["WARC-Type"], "refers_to": None if target is None else unquote(target), "record_id": f["WARC-Record-ID"], "refers_to_record": f.get("WARC-Refers-To"), "block_bytes": len(block)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                fs, path = open_at(uri)
                with gzip.open(io.BufferedReader(fs.open_input_file(path), 1 << 20)) as source:
                    rows = []
                    for f, block in read_warc(source):
                        rows.append(row(f, block))
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)

    return _dealt(files).mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, record_id string, refers_to_record string, block_bytes long")


RECORDS = pa.schema([("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("record_id", pa.string()), ("refers_to_record", pa.string()), ("block_bytes", pa.int64())])


def with_revisits(pages: DataFrame, *, min_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id, url, html, tag (a number of the row) and original: id, tag and url of the first record of an equal payload (same SHA-256 and length), null for that one."""
    named = pages.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"), F.monotonically_increasing_id().alias("tag"))
    body = F.coalesce("html", F.lit("")).cast("binary")
    named = named.withColumns({"sha": F.sha2(body, 256), "bytes": F.length(body)})
    turn = F.struct(F.col("id").isNull().alias("none"), "id", "tag", "url")
    first = named.where(F.col("bytes") >= min_bytes).groupBy("sha", "bytes").agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = named.join(first, ["sha", "bytes"], "left")
    original = F.when(F.col("first.tag") != F.col("tag"), F.struct("first.id", "first.tag", "first.url"))
    return joined.select("id", "url", "html", "tag", original.alias("original"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    arcs = written(write_arc(pages, fresh_path(spark, "arc"), version=2), "arc-files")
    warcs = written(convert_arc(arcs, fresh_path(spark, "warc")), "warc-files")
    kind = pages.schema["id"].dataType
    return read_warcs(warcs).select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first_id FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', CAST(4 * (strpos('0123456789abcdef', substr(h, i, 1)) - 1) + 1 AS BIGINT), 4)), '') AS bits FROM f)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS BIGINT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS BIGINT)
        + 4 * CAST(substr(bits, 5 * i + 3, 1) AS BIGINT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS BIGINT) + CAST(substr(bits, 5 * i + 5, 1) AS BIGINT), 1)), '') AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM b"""
