"""Token files: documents' token ids as independent zstandard frames with a trailing seek table.

File layout, all integers little-endian:
  a frame per document, in ascending order: a zstandard frame of the ids as unsigned 32-bit integers;
  a frame of the documents' keys: a JSON list of strings, null where a document has none;
  the seek table: per document uint64 offset of its frame, uint32 its compressed size, uint32 its number of ids, uint32 crc32
  of the uncompressed ids;
  the footer: uint64 number of documents, uint32 size of the frame of keys, uint32 crc32 of that frame and the seek table,
  8 bytes magic "LWTOKS02".
A reader takes the footer, then keys and table, then only the frames it is asked for, by place or by key, and checks each
against its checksum. The manifest names each shard's first and last key, so the shard of a key is found without opening any.

Documents are range-sorted by id, a shard being a part of a sorted partition. A shard file is written under a name of
its own per attempt to the shared folder, and only the files that the manifest (a table) lists are ever read, so lost
executors and repeated attempts leave nothing wrong behind. Starts are prefix sums over the shards' totals.

Defined cases: null texts count as empty and give the end id alone; rows that repeat an id are documents of their own,
ordered by text; null ids come first; an empty table gives no file and an empty result; an added token's string in a text
is that token, as the library has it; columns beside the id and the text are not read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lapwise.llm import textblocks as tb
from lapwise.llm.pieces import SPACES, PieceTable, gather
from lapwise.llm.scratch import fresh_path, written
from lapwise.llm.workers import held

MAGIC = b"LWTOKS02"
ENTRY = np.dtype([("offset", "<u8"), ("size", "<u4"), ("n", "<u4"), ("crc", "<u4")])
FOOTER = struct.Struct("<QII8s")
SHARD_BYTES = 32 << 20
WORDS_KEPT = 1_000_000
BLOCK_BYTES = 4 << 20


def open_at(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a URI of the shared folder."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class FileWriter:
    """Writes frames one by one to a URI; close() adds the seek table and the footer."""

    def __init__(self, uri: str, level: int = 3) -> None:
        fs, path = open_at(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path, compression=None)
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.entries: list[tuple] = []
        self.keys: list[str | None] = []
        self.at = 0

    def add(self, key: object, ids: bytes) -> None:
        frame = self.pack.compress(ids)
        self.keys.append(None if key is None else str(key))
        self.entries.append((self.at, len(frame), len(ids) // 4, zlib.crc32(ids)))
        self.out.write(frame)
        self.at += len(frame)

    def close(self) -> None:
        keys, table = self.pack.compress(json.dumps(self.keys).encode()), np.array(self.entries, dtype=ENTRY).tobytes()
        self.out.write(keys + table)
        self.out.write(FOOTER.pack(len(self.entries), len(keys), zlib.crc32(keys + table), MAGIC))
        self.out.close()


class FileReader:
    """Random access to a token file."""

    def __init__(self, uri: str) -> None:
        fs, path = open_at(uri)
        self.source = fs.open_input_file(path)
        size = self.source.size()
        n, key_size, crc, magic = FOOTER.unpack(self.source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        tail = key_size + n * ENTRY.itemsize
        both = self.source.read_at(tail, size - FOOTER.size - tail)
        if zlib.crc32(both) != crc:
            raise ValueError(f"{uri}: the seek table's checksum is wrong")
        self.unpack = zstandard.ZstdDecompressor()
        self.keys: list[str | None] = json.loads(self.unpack.decompress(both[:key_size]))
        self.entries = np.frombuffer(both[key_size:], dtype=ENTRY)

    def __len__(self) -> int:
        return len(self.entries)

    def find(self, key: object) -> list[int]:
        """Places of the documents of that key."""
        return [k for k, own in enumerate(self.keys) if own == (None if key is None else str(key))]

    def read(self, index: int) -> bytes:
        """The ids of one document; only its frame is read and decompressed."""
        entry = self.entries[index]
        ids = self.unpack.decompress(self.source.read_at(int(entry["size"]), int(entry["offset"])))
        if len(ids) != 4 * int(entry["n"]) or zlib.crc32(ids) != int(entry["crc"]):
            raise ValueError(f"frame {index}: the checksum is wrong")
        return ids


class PieceTokenizer:
    """The tokenizers library on pieces of texts, each piece once in a while; equal to encoding whole texts.

    New pieces that begin with white space are encoded many to a string, since the pre-tokenizer cuts between them; the ids
    of each are found by the byte lengths of the tokens. A text that holds an added token's string goes to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        vocabulary = self.tool.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        self.lengths[list(vocabulary.values())] = [len(t) for t in vocabulary]  # a character of a byte-level token is a byte
        self.added = [t.content.encode() for t in self.tool.get_added_tokens_decoder().values()]
        self.table = PieceTable(self._learn, WORDS_KEPT)

    def close(self) -> None:
        self.table.clear()

    def _one_by_one(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tool.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), dtype=np.int32), np.array(list(map(len, found)), dtype=np.int64)

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.tool.encode_batch_fast([b"".join(pieces).decode()], add_special_tokens=False)[0].ids, dtype=np.int32)
        known = ids < len(self.lengths)
        ends = np.cumsum(np.where(known, self.lengths[np.where(known, ids, 0)], 0))
        stops = np.cumsum(list(map(len, pieces)))
        cuts = np.searchsorted(ends, stops) + 1
        if not len(ends) or cuts[-1] != len(ends) or not np.array_equal(ends[cuts - 1], stops):
            return self._one_by_one(pieces)  # a tokenizer that changes its input
        return ids, np.diff(cuts, prepend=0)

    def _learn(self, pieces: list[bytes], count: int = 4000) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and how many each has."""
        apart = [k for k, p in enumerate(pieces) if not tb.WHITE[p[0]] or tb.WHITE[p[-1]] or p[-1] >= 0x80 and p.decode()[-1] in SPACES]
        joined = np.delete(np.arange(len(pieces)), apart).tolist()
        found = [encode([pieces[k] for k in places[at : at + count]]) for places, encode in ((joined, self._together), (apart, self._one_by_one)) for at in range(0, len(places), count)]
        flat, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
        place = np.argsort(np.array(joined + apart))
        return gather(flat, (np.cumsum(sizes) - sizes)[place], sizes[place]), sizes[place]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8 bytes and row offsets) one after another, and where each row's begin."""
        ids, cuts = self.table.encode(data, offsets)
        raw, whole = data.tobytes(), set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(token) <= offsets[row + 1]:
                    whole.add(row)
                at = raw.find(token, at + 1)
        if not whole:
            return ids, cuts
        rows = np.split(ids, cuts[1:-1])
        for row in whole:
            rows[row] = self._one_by_one([raw[offsets[row] : offsets[row + 1]]])[0]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes docs, in ascending order of key, and returns the manifest: part, shard, uri, documents, tokens, first and last (key).

    Range partitions keep equal keys together; sampling sets their bounds, so no key order passes through one task.
    """
    kind = docs.schema[key].dataType.simpleString()
    ordered = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text").withColumn("part", F.spark_partition_id())
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = held(f"tokenizer {tokenizer}", lambda: PieceTokenizer(tokenizer))
        attempt, shard = uuid.uuid4().hex, 0
        out, uri, tokens, first, rows = None, "", 0, None, []

        def closed() -> dict:
            out.close()
            return {"part": part_no, "shard": shard, "uri": uri, "documents": len(out.entries), "tokens": tokens, "first": first, "last": doc}

        part_no, doc = 0, None
        for part, data, offsets in tb.text_blocks(batches, "text", BLOCK_BYTES):
            part_no = part.column("part")[0].as_py()
            flat, cuts = tool.encode(data, offsets)
            raw, cuts = flat.astype("<u4").tobytes(), (4 * cuts).tolist()
            for doc, begin, stop in zip(part.column("id").to_pylist(), cuts[:-1], cuts[1:], strict=True):
                if out is None:
                    uri = f"{folder}/part-{part_no:06d}-{shard:05d}-{attempt}.lwtok"
                    out, tokens, first = FileWriter(uri), 0, doc
                out.add(doc, raw[begin:stop] + end)
                tokens += (stop - begin) // 4 + 1
                if out.at >= shard_bytes:
                    rows.append(closed())
                    out, shard = None, shard + 1
        if out is not None:
            rows.append(closed())
        for row in rows:
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("uri", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("first", part.schema.field("id").type), ("last", part.schema.field("id").type)]))

    return ordered.mapInArrow(run, f"part int, shard int, uri string, documents long, tokens long, first {kind}, last {kind}")


def read_token_files(manifest: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """A row per document, from the files alone: key, start, and its ids as bytes; each shard is read on its own."""
    totals = manifest.groupBy("part").agg(F.sum("tokens").alias("part_tokens"))
    parts = totals.withColumn("part_start", F.coalesce(F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("part_tokens")  # a row per partition
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.withColumn("inside", inside).join(parts, "part").select("uri", (F.col("part_start") + F.col("inside")).alias("start"))
    kind = manifest.schema["first"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                reader, start = FileReader(batch.column("uri")[i].as_py()), batch.column("start")[i].as_py()
                docs = pa.array(reader.keys, pa.string())
                for at in range(0, len(reader), 1000):
                    frames = [reader.read(k) for k in range(at, min(at + 1000, len(reader)))]
                    sizes = np.array([len(f) // 4 for f in frames], dtype=np.int64)
                    starts = start + np.concatenate([[0], np.cumsum(sizes)[:-1]])
                    start += int(sizes.sum())
                    yield pa.RecordBatch.from_arrays([docs.slice(at, len(frames)), pa.array(starts), pa.array(frames, pa.binary())], names=[key, "start", "ids"])

    spread = shards.repartition(max(1, manifest.count()), "uri")  # a number is kept: as many tasks as shards
    found = spread.mapInArrow(run, f"`{key}` string, start long, ids binary")
    return found.withColumn(key, F.col(f"`{key}`").cast(kind))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    manifest = written(write_token_files(docs, fresh_path(spark, "token-files"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2), "token-manifest")
    read = read_token_files(manifest)
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
