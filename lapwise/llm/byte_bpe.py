"""Byte-level BPE encoding and decoding with DuckDB queries inside tasks.

Encoding: texts are cut into pieces, and new pieces by the tokenizer's pattern into words. The words of a block of rows
become a table of token positions; a recursive query joins neighbouring tokens with the merge table and contracts each
word's leftmost pair of minimum rank until no pair is left. Pieces met are kept in a table of a bounded size, which keeps
those met most often when it is full, so that a common piece costs DuckDB once and a lookup otherwise. Decoding: the ids of a block of rows are token positions too,
joined with the vocabulary and put together by an ordered aggregation.

Words of over LONG_WORD bytes contract many pairs a round, those that the one-by-one order must contract as they stand: a
pair whose rank is the least within reach of it on both sides, reach being more bytes than any token has that can occur in
the word. A pair of lower rank beyond reach cannot come near before, since a token that grew that far would be longer. Of
pairs of equal rank within reach all count if the merged token makes no pair of lower rank with any token of the
vocabulary ("calm"), else the leftmost; of overlapping ones every other, from the left.

The vocabulary comes from a rank file whose path is a parameter; the driver reads it and broadcasts the merge table,
whose size is fixed by the vocabulary.

Defined cases: null texts count as empty, and give no ids; null ids decode to empty bytes, and an unknown id is an
error; a column of the input named like the output is replaced; repeated rows are encoded alike; a text of any length
is one row and stands alone in its block if it is long.
"""

from __future__ import annotations

import base64
import re
import tempfile
from collections.abc import Iterator
from functools import reduce
from itertools import chain, compress

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lapwise.llm import textblocks as tb
from lapwise.llm.pieces import OftenTable, gather
from lapwise.llm.scratch import small_batches, written
from lapwise.llm.workers import held

#: Two workers share an executor with a JVM: these bound what a worker holds beside its batch of rows. They change no result.
BLOCK_BYTES = 256 << 10
BATCH_ROWS = 256
PIECES_KEPT = 150_000
PIECES_OFTEN = 120_000
LONG_WORD = 200
BYTES_AT_ONCE = 50_000
GRAM = 6

#: A merged pair is the row of its right token; the row of its left token goes.
ENCODE_SQL = """
WITH RECURSIVE step(word, pos, token, following, done) AS (
    SELECT word, pos, token, following, false FROM seed
    UNION ALL
    SELECT s.word, CASE WHEN s.pos > b.at THEN s.pos - 1 ELSE s.pos END, CASE WHEN s.pos = b.at + 1 THEN b.merged ELSE s.token END,
        CASE WHEN s.pos = b.at - 1 THEN b.merged ELSE s.following END, b.at IS NULL
    FROM step s LEFT JOIN (
        SELECT word, (min(key) % 1048576)::INTEGER AS at, (min(key) // 1048576)::INTEGER AS merged
        FROM (SELECT word, merged::BIGINT * 1048576 + pos AS key FROM step JOIN merges ON l = token AND r = following WHERE NOT done) GROUP BY word) b ON b.word = s.word
    WHERE NOT s.done AND (b.at IS NULL OR s.pos <> b.at))
SELECT word, token FROM step WHERE done ORDER BY word, pos"""

LONG_SQL = """
WITH RECURSIVE step(word, pos, token, following, reach, done) AS (
    SELECT word, pos, token, following, reach, false FROM seed
    UNION ALL
    SELECT word, pos, CASE WHEN chosen THEN merged ELSE token END,
        CASE WHEN chosen AND coalesce(lead(chosen, 2) OVER w, false) THEN lead(merged, 2) OVER w WHEN chosen THEN lead(following) OVER w
            WHEN coalesce(lead(chosen) OVER w, false) THEN lead(merged) OVER w ELSE following END, reach, quiet
    FROM (
        SELECT *, clear AND last_value(CASE WHEN head THEN clear END IGNORE NULLS) OVER before AND (n - last_value(CASE WHEN head THEN n END IGNORE NULLS) OVER before) % 2 = 0 AS chosen
        FROM (
            SELECT *, row_number() OVER w AS n, min(merged) OVER (PARTITION BY word) IS NULL AS quiet, merged IS DISTINCT FROM lag(merged) OVER w AS head,
                coalesce(merged = min(merged) OVER (w ROWS BETWEEN reach PRECEDING AND reach FOLLOWING)
                    AND (calm OR coalesce(merged < min(merged) OVER (w ROWS BETWEEN reach PRECEDING AND 1 PRECEDING), true)), false) AS clear
            FROM (SELECT s.*, m.merged, m.calm FROM step s LEFT JOIN merges m ON m.l = s.token AND m.r = s.following WHERE NOT s.done)
            WINDOW w AS (PARTITION BY word ORDER BY pos))
        WINDOW before AS (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING))
    WINDOW w AS (PARTITION BY word ORDER BY pos)
    QUALIFY NOT coalesce(lag(chosen) OVER w, false))
SELECT word, token FROM step WHERE done ORDER BY word, pos"""

MERGES_SQL = """
SELECT *, merged NOT IN (SELECT l FROM given WHERE merged < l UNION ALL SELECT r FROM given WHERE merged < r) AS calm FROM given"""

DECODE_SQL = """
SELECT row, string_agg(piece, '' ORDER BY pos) AS piece, count(*) AS n FROM tokens JOIN vocabulary USING (token) GROUP BY row"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens whose bytes together are a token: l, r and merged (its id, which is its rank)."""
    found = [(ranks[t[:k]], ranks[t[k:]], n) for t, n in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    return pa.table([pa.array(c, pa.int32()) for c in (zip(*found, strict=True) if found else ([], [], []))], names=["l", "r", "merged"])


def _connect(**tables: pa.Table) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "100MB", "temp_directory": tempfile.mkdtemp(prefix="bpe-")})  # spills stay on the executor
    for name, table in tables.items():
        con.register("given", table)
        con.execute(f"CREATE TABLE {name} AS {MERGES_SQL if name == 'merges' else 'SELECT * FROM given'}")
        con.unregister("given")
    return con


def grams(data: np.ndarray) -> np.ndarray:
    """The runs of GRAM bytes as integers."""
    n = max(len(data) - GRAM + 1, 0)
    return sum((data[k : k + n].astype(np.int64) << 8 * k for k in range(GRAM)), np.zeros(n, dtype=np.int64))


class Reach:
    """Over how many tokens a merge can depend on another one: one more than the bytes of the longest token that can occur."""

    def __init__(self, tokens: list[bytes]) -> None:
        tokens = [t for t in tokens if len(t) >= GRAM]
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes - GRAM + 1)])[:-1]
        self.grams = np.concatenate([grams(np.frombuffer(t, dtype=np.uint8)) for t in tokens]) if tokens else np.zeros(0, dtype=np.int64)

    def of(self, word: bytes) -> int:
        """A token whose runs of GRAM bytes all lie in the word may occur in it; so may any shorter token."""
        if not len(self.sizes):
            return GRAM + 2
        whole = np.logical_and.reduceat(np.isin(self.grams, grams(np.frombuffer(word, dtype=np.uint8))), self.begin)
        return int(self.sizes[whole].max(initial=GRAM)) + 2


def _splitter(pattern: str):
    """A function that cuts a text by the pattern.

    Texts of the basic plane go to the standard library's matcher, with the character classes written out as ranges;
    other texts, and patterns with other classes, to the regex module.
    """
    exact = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
    plane = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000))))
    ranges = {}
    for name, inside in ((r"\p{L}", r"\p{L}"), (r"\p{N}", r"\p{N}"), (r"\s", r"\p{White_Space}")):
        ranges[name] = "".join(f"{chr(92)}u{ord(m[0]):04x}-{chr(92)}u{ord(m[-1]):04x}" for run in regex.findall(f"{inside}+", plane) for m in regex.findall(r"[\x00-\uD7FF]+|[\uE000-\uFFFF]+", run))
    plain = re.sub(r"\[\^?(?:\\s|\\p\{[LN]\})+\]", lambda m: reduce(lambda found, c: found.replace(c, ranges[c]), ranges, m[0]), pattern)
    for name, found in ranges.items():
        plain = plain.replace(name, f"[{found}]")
    plain = plain.replace(r"\S", f"[^{ranges[chr(92) + 's']}]")
    if r"\p" in plain:
        return exact
    fast = re.compile(plain).findall
    return lambda text: fast(text) if not text or max(text) <= "\uffff" else exact(text)


#: Letters with one space before them or none, which no pattern for such vocabularies cuts; Latin letters only.
ONE_WORD = r"\A ?[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+\z"


class Encoder:
    """Encodes texts in one task; keeps the pieces it has met, up to a bound. cut_first: the pattern never joins pieces (module pieces)."""

    def __init__(self, merges: pa.Table, byte_ids: np.ndarray, vocabulary: pa.Table, pattern: str, cut_first: bool) -> None:
        self.con = _connect(merges=merges, vocabulary=vocabulary)
        self.decoder = Decoder(self.con)
        self.byte_ids = byte_ids
        self.split = _splitter(pattern)
        self.reach = Reach([t.encode("latin-1") for t in vocabulary.column("piece").to_pylist()])
        self.cut_first = cut_first
        self.table = OftenTable(self._learn, PIECES_KEPT, PIECES_OFTEN)

    def close(self) -> None:
        self.con.close()

    def _contract(self, words: list[bytes], sql: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        sizes = np.array(list(map(len, words)), dtype=np.int64)
        token = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ends = np.cumsum(sizes)
        last = np.zeros(len(token), dtype=bool)
        last[ends - 1] = True
        seed = {"word": pa.array(np.repeat(np.arange(len(words), dtype=np.int32), sizes)), "pos": pa.array((np.arange(len(token)) - np.repeat(ends - sizes, sizes)).astype(np.int32)), "token": pa.array(token), "following": pa.array(np.append(token[1:], 0).astype(np.int32), mask=last)}
        if sql == LONG_SQL:
            seed["reach"] = pa.array(np.repeat(np.array([self.reach.of(w) for w in words], dtype=np.int32), sizes))
        self.con.register("seed", pa.table(seed))
        got = self.con.sql(sql).to_arrow_table()
        self.con.unregister("seed")
        return got.column("token").to_numpy().astype(np.int32), np.bincount(got.column("word").to_numpy(), minlength=len(words))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has; a bounded number at a time."""
        sizes = np.array(list(map(len, words)), dtype=np.int64)
        short, long = np.flatnonzero(sizes <= LONG_WORD), np.flatnonzero(sizes > LONG_WORD)
        groups = [(g, sql) for part, sql in ((short, ENCODE_SQL), (long, LONG_SQL)) if len(part) for g in np.split(part, np.flatnonzero(np.diff(np.cumsum(sizes[part]) // BYTES_AT_ONCE)) + 1)]
        flat, counts = (np.concatenate(x) for x in zip(*(self._contract([words[k] for k in g], sql) for g, sql in groups), strict=True))
        place = np.argsort(np.concatenate([g for g, _ in groups]))
        return gather(flat, (np.cumsum(counts) - counts)[place], counts[place]), counts[place]

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = pc.match_substring_regex(pa.array(pieces, pa.string()), ONE_WORD).to_numpy(zero_copy_only=False).astype(bool) if self.cut_first else np.zeros(len(pieces), dtype=bool)
        words: dict[str, int] = {}
        found, parts = [], np.ones(len(pieces), dtype=np.int64)
        for k in np.flatnonzero(~whole).tolist():
            cut = self.split(pieces[k].decode())
            found.extend([words.setdefault(w, len(words)) for w in cut])
            parts[k] = len(cut)
        unsplit = list(compress(pieces, whole))
        if not unsplit and not words:
            return np.zeros(0, dtype=np.int32), np.zeros(len(pieces), dtype=np.int64)
        number = np.zeros(parts.sum(), dtype=np.int64)
        alone = np.repeat(whole, parts)
        number[alone], number[~alone] = np.arange(len(unsplit)), np.array(found, dtype=np.int64) + len(unsplit)
        flat, counts = self.encode_words([*unsplit, *(w.encode() for w in words)])
        sizes = counts[number]
        total = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(parts)])]
        return gather(flat, (np.cumsum(counts) - counts)[number], sizes), np.diff(total)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8 bytes and row offsets) one after another, and where each row's begin."""
        if self.cut_first:
            return self.table.encode(data, offsets)
        raw = data.tobytes()
        ids, sizes = self._learn([raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        return ids, np.concatenate([[0], np.cumsum(sizes)])


class Decoder:
    """Decodes id arrays in one task."""

    def __init__(self, con: duckdb.DuckDBPyConnection) -> None:
        self.con = con

    def close(self) -> None:
        self.con.close()

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each row, given the ids of all rows and how many each has."""
        self.con.register("tokens", pa.table({"row": pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)), "pos": pa.array(np.arange(len(ids), dtype=np.int32)), "token": pa.array(ids)}))
        got = self.con.sql(DECODE_SQL).to_arrow_table()
        self.con.unregister("tokens")
        if (pc.sum(got.column("n")).as_py() or 0) != len(ids):
            raise ValueError("ids that the vocabulary does not have")
        found = [b""] * len(sizes)
        for row, piece in zip(got.column("row").to_pylist(), got.column("piece").to_pylist(), strict=True):
            found[row] = piece.encode("latin-1")
        return found


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def _vocabulary(ranks: dict[bytes, int]) -> pa.Table:
    return pa.table({"token": pa.array(list(ranks.values()), pa.int32()), "piece": [t.decode("latin-1") for t in ranks]})


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, text: str = "text", out: str = "ids", decoded: str | None = None, cut_first: bool = True) -> DataFrame:
    """docs with out: the token ids of each whole text, without special tokens; decoded: a column for what they decode to.

    cut_first: texts are cut into pieces before the pattern is applied; set it to False for a pattern that matches across
    the beginning of white space, or across a letter and a stop.
    """
    docs = docs.drop(out, decoded or out)
    ranks = read_ranks(vocabulary)
    byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((merge_table(ranks), byte_ids, _vocabulary(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = held(f"bpe {vocabulary} {pattern} {cut_first}", lambda: Encoder(*shared.value, pattern, cut_first))
        back = tool.decoder if decoded else None
        for part, data, offsets in tb.text_blocks(batches, text, BLOCK_BYTES):
            flat, cuts = tool.encode(data, offsets)
            part = _with_column(part, out, pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat)))
            yield _with_column(part, decoded, pa.array(back.decode(flat, np.diff(cuts)), pa.binary())) if back else part
            pa.default_memory_pool().release_unused()

    fields = [T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.BinaryType())] if decoded else [])]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def decode(docs: DataFrame, vocabulary: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with out: the bytes of each row's ids."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(_vocabulary(read_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = held(f"bpe-decoder {vocabulary}", lambda: Decoder(_connect(vocabulary=shared.value)))
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            at = 0
            while at < len(sizes):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_BYTES // 4, side="right")) - 1)
                part = batch.slice(at, to - at)
                yield _with_column(part, out, pa.array(tool.decode(part.column(ids).flatten().to_numpy(), sizes[at:to]), pa.binary()))
                at = to

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())]))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN, decoded="decoded")
    with small_batches(spark, BATCH_ROWS):
        return written(encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")), "byte-bpe")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: doc_id, source, ids, their number, and the SHA-256 of the bytes that they decode to."""
    import public_tokenizers

    encoded = encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    with small_batches(spark, BATCH_ROWS):
        return written(encoded.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256")), "stage-ids")
