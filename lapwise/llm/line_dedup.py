"""Line dedup by winnowing: repeated runs of lines are found across all texts, and the later ones deleted.

Two kinds of line are winnowed. Text lines end at a line break; they are compared word by word, whatever the white space,
and lines of under min_line_words words (a brace, a heading's number) are left alone. A passage pasted into other text
rarely begins or ends at a break, so there are rolling lines too: half of min_words consecutive words, wherever they begin.
A repeated run is min_lines text lines (one by default) or min_words words.

The hash of every line is taken; of each window of consecutive hashes the minimum (the rightmost on ties) is a
fingerprint. A run holds exactly one window, so each run has one fingerprint, and equal runs have equal ones. The runs of
a fingerprint are neighbours, and its span are the lines that they cover.

A run that has an earlier occurrence (smallest id, then position) is deleted, whatever the first text that shares its
fingerprint holds. Of equal spans all but the first lose all their runs. Where a fingerprint occurs with several spans
(at the ends of passages), the first of each is resolved run by run: equal runs are in spans of one fingerprint, so the
first occurrence of a run is in the first occurrence of some span. Overlapping deletions merge, so longer runs go whole.
Fingerprint and span are two 64-bit hashes, and only what agrees in both is deleted. Nothing else is changed: a text
without such a run keeps its bytes, and only the white space before a deleted run (after it, at the beginning) goes too.

Defined cases: null texts stay null and empty texts empty; rows with a null id take no part and keep their text; rows
that repeat an id and a text count as one text, other rows of one id come in the order of their texts' hashes; runs
repeated inside a text lose their later occurrences; ids are of any type that can be ordered; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lapwise.llm import textblocks as tb
from lapwise.llm.scratch import temporary, written

#: A place in a text: the low bits of a hash of the text above the bits of the element's number.
DIGEST_BITS, POS_BITS = 35, 28
STEP, OTHER_STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Sizes:
    """Least lengths of a repeated run: text lines (0: none are looked for), words of a text line, words."""

    min_lines: int = 1
    min_line_words: int = 2
    min_words: int = 50


@dataclass
class Level:
    """Consecutive elements (words or text lines) of the rows of a block.

    seq and check are two hashes of each element, first the index of each row's first element (one more at the end), run and
    line the elements of a run and of a line; begin and end are the words that an element covers.
    """

    seq: np.ndarray
    check: np.ndarray
    first: np.ndarray
    run: int
    begin: np.ndarray
    end: np.ndarray

    @property
    def line(self) -> int:
        return max(1, self.run // 2)


def stretches(values: np.ndarray, begin: np.ndarray, end: np.ndarray, step: np.uint64 = STEP) -> np.ndarray:
    """Hash of values[begin : end] of every begin and end: a polynomial taken from prefix sums, then mixed."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * tb.powers(step, len(values)), out=sums[1:])
    down = tb.powers(np.uint64(pow(int(step), -1, 1 << 64)), len(values))
    return tb.mix((sums[end] - sums[begin]) * down[begin]) if len(begin) else np.zeros(0, dtype=np.uint64)


def levels_of(data: np.ndarray, offsets: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[Level]]:
    """Start and end byte of each word, the first word of each row, and the levels of lines."""
    starts, ends, first = tb.word_spans(data, offsets)
    words = tb.word_hashes(data, starts, ends)
    every = np.arange(len(words))
    found = [Level(words, words, first, sizes.min_words, every, every + 1)]
    if sizes.min_lines:
        breaks = np.flatnonzero(data == 0x0A)
        opens = np.zeros(len(words) + 1, dtype=bool)
        opens[1:-1] = np.diff(np.searchsorted(breaks, starts)) > 0
        opens[first] = True
        begin = np.flatnonzero(opens[:-1])
        end = np.append(begin[1:], len(words))[: len(begin)]
        full = end - begin >= sizes.min_line_words
        begin, end = begin[full], end[full]
        seq = tb.mix(stretches(words, begin, end) + (end - begin).astype(np.uint64) + np.uint64(1))
        found.append(Level(seq, stretches(words, begin, end, OTHER_STEP), np.searchsorted(begin, first), sizes.min_lines, begin, end))
    return starts, ends, first, found


def window_minima(level: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First element of each run, the element at which its window's least line begins, and the line hashes."""
    count, window = len(level.seq) - level.line + 1, level.run - level.line + 1
    if count < window:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0, dtype=np.uint64)
    at = np.arange(count)
    hashes = stretches(level.seq, at, at + level.line)
    low, place, span = hashes, at, 1

    def joined(shift: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        right = low[shift : shift + size] <= low[:size]  # the rightmost on ties
        return np.where(right, low[shift : shift + size], low[:size]), np.where(right, place[shift : shift + size], place[:size])

    while 2 * span <= window:  # sliding minimum by doubling
        low, place = joined(span, len(low) - span)
        span *= 2
    low, place = joined(window - span, count - window + 1)
    row_end = np.repeat(level.first[1:], np.diff(level.first))
    full = np.flatnonzero(at[: count - window + 1] + level.run <= row_end[: count - window + 1])
    return full, place[full], hashes


@dataclass
class Marks:
    """The fingerprints of a level: element, hash and span hash; of every run its first element and fingerprint."""

    at: np.ndarray
    hash: np.ndarray
    span: np.ndarray
    full: np.ndarray
    which: np.ndarray


def marks_of(level: Level) -> Marks:
    full, lowest, hashes = window_minima(level)
    at, begin, which, count = np.unique(lowest, return_index=True, return_inverse=True, return_counts=True)
    start = full[begin]  # a fingerprint's runs are neighbours
    place = ((at - start) * (2 * level.run) + count).astype(np.uint64)
    return Marks(at, hashes[at], tb.mix(stretches(level.check, start, start + count - 1 + level.run, OTHER_STEP) + place), full, which)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _occurrences(part: pa.RecordBatch, level: Level, at: np.ndarray, found: np.ndarray, span: np.ndarray) -> pa.RecordBatch:
    row = np.searchsorted(level.first, at, side="right") - 1
    digest = part.column("digest").to_numpy()[row]
    return pa.RecordBatch.from_arrays([_signed(found), _signed(span), part.column("id").take(pa.array(row)), pa.array(digest << POS_BITS | at - level.first[row])], names=["hash", "span", "id", "place"])


def _digest(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit((1 << DIGEST_BITS) - 1))


def _schema(docs: DataFrame, key: str) -> str:
    return f"hash long, span long, id {docs.schema[key].dataType.simpleString()}, place long"


def fingerprints(docs: DataFrame, sizes: Sizes, *, key: str, text: str) -> DataFrame:
    """hash, span, id and place of the fingerprints of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in tb.text_blocks(batches, "text"):
            for level in levels_of(data, offsets, sizes)[3]:
                marks = marks_of(level)
                yield _occurrences(part, level, marks.at, marks.hash, marks.span)

    chosen = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where("id IS NOT NULL")
    return chosen.withColumn("digest", _digest(F.col("text"))).mapInArrow(run, _schema(docs, key))


def packed(rows: DataFrame) -> DataFrame:
    """rows with their text as zstandard bytes, half of what Spark's own shuffle compression makes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [None if t is None else pack(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield part.drop_columns(["text"]).append_column("packed", pa.array(texts, pa.binary()))

    return rows.mapInArrow(run, T.StructType([*(f for f in rows.schema.fields if f.name != "text"), T.StructField("packed", T.BinaryType())]))


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows of about BLOCK_BYTES of text (a longer text stands alone), with their UTF-8 bytes and row offsets."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        begin, size, texts = 0, 0, []
        for i, value in enumerate(batch.column("packed")):
            texts.append(unpack(value.as_py()) if value.is_valid else b"")
            size += len(texts[-1])
            if size >= tb.BLOCK_BYTES or i == batch.num_rows - 1:
                yield batch.slice(begin, i + 1 - begin), np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum(list(map(len, texts)))]).astype(np.int64)
                begin, size, texts = i + 1, 0, []


class Wanted:
    """Occurrences that a block's rows are asked for: lists of hash, span and place."""

    def __init__(self, part: pa.RecordBatch, column: str) -> None:
        lists = part.column(column)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        values = lists.flatten()
        self.row = np.repeat(np.arange(part.num_rows), sizes)
        self.hash, self.span, place = (values.field(n).to_numpy(zero_copy_only=False) for n in ("hash", "span", "place"))
        self.pos = place & ((1 << POS_BITS) - 1)

    def among(self, level: Level, at: np.ndarray, found: np.ndarray, span: np.ndarray) -> np.ndarray:
        """Which of the occurrences (ascending) are wanted."""
        out = np.zeros(len(at), dtype=bool)
        if len(at) and len(self.row):
            element = level.first[self.row] + self.pos
            k = np.minimum(np.searchsorted(at, element), len(at) - 1)
            out[k[(at[k] == element) & (element < level.first[self.row + 1]) & (found[k].view(np.int64) == self.hash) & (span[k].view(np.int64) == self.span)]] = True
        return out


def _runs(level: Level, marks: Marks, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First element and two hashes of the runs of the chosen fingerprints."""
    begin = marks.full[chosen[marks.which]] if len(marks.which) else marks.full
    return begin, stretches(level.seq, begin, begin + level.run), stretches(level.check, begin, begin + level.run, OTHER_STEP)


BY_TEXT = "id = w_id AND digest = w_digest"


def _by_text() -> list[Column]:
    return [F.col("id").alias("w_id"), F.shiftright("place", POS_BITS).alias("w_digest")]


def runs_of(rows: DataFrame, marks: DataFrame, sizes: Sizes) -> DataFrame:
    """hash, span (a second hash), id and place of every run of the marks; rows: id, text and digest."""
    lists = marks.groupBy(*_by_text()).agg(F.collect_set(F.struct("hash", "span", "place")).alias("at"))  # at most a text's fingerprints
    chosen = packed(rows.where("id IS NOT NULL")).join(lists, F.expr(BY_TEXT)).select("id", "digest", "packed", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in unpacked(batches):
            wanted = Wanted(part, "at")
            for level in levels_of(data, offsets, sizes)[3]:
                marks = marks_of(level)
                yield _occurrences(part, level, *_runs(level, marks, wanted.among(level, marks.at, marks.hash, marks.span)))

    return chosen.mapInArrow(run, _schema(rows, "id"))


def later_of(marks: DataFrame, name: str) -> DataFrame:
    """Those of marks (hash, span, id, place) that are not the first occurrence of their hashes."""
    firsts = marks.groupBy("hash", "span").agg(F.min(F.struct("id", "place")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = written(firsts.select("hash", "span", F.col("f.id").alias("first_id"), F.col("f.place").alias("first_place")), name)  # as a table, Spark can split the join of a very common line
    return marks.join(firsts, ["hash", "span"]).where("id <> first_id OR place <> first_place").select("hash", "span", "id", "place")


def covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in a stretch from begin to end."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def without(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, dead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes and offsets without the dead words and the white space before each run of them (after it, at the beginning)."""
    opening = np.zeros(len(dead) + 1, dtype=bool)
    opening[first] = True
    begin = np.flatnonzero(dead & (opening[:-1] | ~np.append(False, dead[:-1])))
    end = np.flatnonzero(dead & (opening[1:] | ~np.append(dead[1:], False))) + 1
    row = np.searchsorted(first, begin, side="right") - 1
    head, tail = begin == first[row], end == first[row + 1]
    left = np.where(head, offsets[row], ends[begin - 1])
    right = np.where(head, np.where(tail, offsets[row + 1], np.append(starts, 0)[end]), ends[end - 1])
    keep = ~covered(len(data), left, right)
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", sizes: Sizes = Sizes(), out_words: str | None = None) -> DataFrame:
    """docs without the later repeats; out_words: a column for the number of words deleted."""
    with temporary(docs.sparkSession):
        marks = written(fingerprints(docs, sizes, key=key, text=text), "line-fingerprints")
        shared = written(marks.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "line-shared")  # as a table, Spark can split the join of a very common line
        marks = written(marks.join(shared, "hash"), "line-spans", lasting=True)
    spans = marks.groupBy("hash", "span").agg(F.min(F.struct("id", "place")).alias("f"))
    mixed = spans.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    own = docs.columns
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in own if c != text] or [F.lit(True).alias("none")]).alias("row"), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    carried = carried.withColumn("digest", _digest(F.coalesce("text", F.lit(""))))
    with temporary(docs.sparkSession):
        mixed = written(spans.join(mixed, "hash").select("hash", "span", "f.*"), "line-mixed")
        runs = written(runs_of(carried.select("id", "text", "digest"), mixed, sizes), "line-runs", lasting=True)
    item = F.struct("hash", "span", "place")
    later = later_of(marks, "span-firsts").withColumn("whole", F.lit(True)).unionByName(later_of(runs, "run-firsts").withColumn("whole", F.lit(False)))
    lists = later.groupBy(*_by_text()).agg(F.collect_set(F.when(F.col("whole"), item)).alias("spans"), F.collect_set(F.when(~F.col("whole"), item)).alias("runs"))  # at most a text's words
    joined = packed(carried).join(lists, F.expr(BY_TEXT), "left").select("row", "packed", "spans", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in unpacked(batches):
            spans, runs = Wanted(part, "spans"), Wanted(part, "runs")
            gone = np.zeros(part.num_rows, dtype=np.int64)
            if len(spans.row) or len(runs.row):
                starts, ends, first, levels = levels_of(data, offsets, sizes)
                edge = np.zeros(len(starts) + 1, dtype=np.int32)
                for level in levels:
                    marks = marks_of(level)
                    begin, dead = marks.full, np.zeros(len(marks.full), dtype=bool)
                    if len(begin):
                        dead = spans.among(level, marks.at, marks.hash, marks.span)[marks.which]
                    if len(runs.row):
                        dead |= runs.among(level, *_runs(level, marks, np.ones(len(marks.at), dtype=bool)))
                    elements = covered(len(level.seq), begin[dead], begin[dead] + level.run)
                    np.add.at(edge, level.begin[elements], 1)
                    np.add.at(edge, level.end[elements], -1)
                dead = np.cumsum(edge[:-1]) > 0
                gone = np.diff(np.concatenate([[0], np.cumsum(dead)])[first])
                data, offsets = without(data, offsets, starts, ends, first, dead)
            texts = pa.Array.from_buffers(pa.large_string(), part.num_rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column("row"), pc.if_else(part.column("packed").is_valid(), texts, None), pa.array(gone)], names=["row", "text", "gone"])

    schema = T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), T.StructField("gone", T.LongType())])
    done = joined.mapInArrow(run, schema)
    columns = [F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in own if c != out_words]
    return done.select(*columns, *([F.col("gone").alias(out_words)] if out_words else []))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), out_words="removed_words")
    return cleaned.select("doc_id", "removed_words", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("text_sha256"), "text")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document with its later repeats deleted; one of which nothing is left goes."""
    own = docs.columns
    cleaned = remove_repeats(docs, out_words="lapwise_removed")
    if "n_chars" in own:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("lapwise_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleaned.where("lapwise_removed = 0 OR length(text) > 0").select(*[F.col(f"`{c}`") for c in own])
