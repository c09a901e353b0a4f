"""Pairs of texts whose sets of word shingles are similar: an exact join by prefix filtering, verified before it is thinned.

All shingles have one order, and a set's prefix is its first |A| - ceil(s |A|) + 1 shingles. Two sets of Jaccard similarity
s or more share a shingle of both prefixes, and the first that they share leaves room in both for the overlap that s
demands. So candidates are the pairs that share a prefix shingle and pass these bounds; none of similarity s is missed,
whatever the order is. The order puts shingles that are common in a sample of the rows last, so that they seldom lie in a
prefix; the sample decides the work only, not the result.

Rows of equal sets (a digest of 128 bits) have one representative. Candidates are verified on whole sets; only verified
pairs link. Before the sets are joined, a sketch (how many shingles fall into each of 256 buckets) bounds the overlap from
above and drops the pairs that cannot reach it. First each row meets the smallest row of each of its prefix shingles, and
the pairs that the caller proposes, and the components of those links are formed; then every pair of candidates that lies
in two components is verified. A pair inside one component cannot change the components, so the thinning loses nothing.

Defined cases: rows of less words than a shingle are one shingle, rows without words (null, empty, white space) are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lapwise.llm import textblocks as tb
from lapwise.llm.components import components
from lapwise.llm.scratch import written

NUM, DEN = 4, 5  # the similarity, 0.8, as whole numbers: no rounding at the border
SAMPLED, COMMON, MOST_COMMON = 16, 16, 1_000_000
BUCKETS = 256


def shingle_spans(first: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each shingle of every row, and the index of each row's first shingle (one more at the end)."""
    counts = np.diff(first)
    shingles = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(shingles)])
    return np.repeat(first[:-1] - offsets[:-1], shingles) + np.arange(offsets[-1]), offsets


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of every row in ascending order; letters are ASCII-lower-cased."""
    data = tb.LOWER[data]
    starts, ends, first = tb.word_spans(data, offsets)
    hashes = tb.word_hashes(data, starts, ends)
    at, cuts = shingle_spans(first, words)
    row_end = np.repeat(first[1:], np.diff(cuts))
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(words):
        inside = at + k < row_end
        total[inside] = tb.mix(total[inside] + hashes[at[inside] + k])
    total = total.view(np.int64)
    return [np.unique(total[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def sets_of(texts: DataFrame, words: int) -> DataFrame:
    """row and shingles of every row and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in tb.text_blocks(batches, "text"):
            yield pa.RecordBatch.from_pydict({"row": part.column("row"), "shingles": pa.array(shingle_sets(data, offsets, words), pa.list_(pa.int64()))})

    return texts.select("row", "text").mapInArrow(run, "row long, shingles array<long>")


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles common in a sixteenth of the rows, ascending, and their places by count; at most MOST_COMMON."""
    some = sets_of(texts.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLED)) == 0), words).select(F.explode("shingles").alias("h"))
    counts = some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    found = counts.orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    h, n = found.column("h").to_numpy(), found.column("n").to_numpy()
    by_hash = np.argsort(h)
    place = np.empty(len(h), dtype=np.int64)
    place[np.lexsort((h, n))] = np.arange(len(h))
    return h[by_hash], place[by_hash]


def prefixes(texts: DataFrame, words: int) -> DataFrame:
    """row, digest, size and sketch of the shingle set of every row, and its prefix."""
    shared = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, place = shared.value
        for part, data, offsets in tb.text_blocks(batches, "text"):
            sets = shingle_sets(data, offsets, words)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            kept = []
            for s in sets:
                size = len(s) - (NUM * len(s) + DEN - 1) // DEN + 1 if len(s) else 0
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    late = common[at] == s
                    if late.any():
                        s = np.concatenate([s[~late], s[late][np.argsort(place[at[late]])]])
                kept.append(s[:size])
            cuts = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(kept) if kept else np.zeros(0, dtype=np.int64), pa.int64()))
            sizes = pa.array([len(s) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(digests, pa.binary()), sizes, pa.array(map(sketch, sets), pa.binary()), lists], names=["row", "digest", "size", "sketch", "prefix"])

    return texts.select("row", "text").mapInArrow(run, "row long, digest binary, size int, sketch binary, prefix array<long>")


def sketch(shingles: np.ndarray) -> bytes | None:
    """The number of shingles in each bucket, a byte each; null where a byte is too small."""
    counts = np.bincount(shingles & (BUCKETS - 1), minlength=BUCKETS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def within_sketch(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs a, b whose sketches leave room for the overlap that the similarity demands."""
    side = lambda c: sketches.select(F.col("row").alias(c), F.col("sketch").alias(f"s{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [np.frombuffer(b"".join(x or bytes(BUCKETS) for x in batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, BUCKETS) for c in ("sa", "sb")]
            room, both = np.minimum(*sides).sum(axis=1, dtype=np.int64), sum(x.sum(axis=1, dtype=np.int64) for x in sides)
            unknown = pc.or_(batch.column("sa").is_null(), batch.column("sb").is_null())
            yield batch.select(["a", "b"]).filter(pc.or_(unknown, pa.array((NUM + DEN) * room >= NUM * both)))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def possible(size: Column, pos: Column, other_size: Column, other_pos: Column) -> Column:
    """True if sets of these sizes whose first common shingle lies at these places can be similar enough."""
    room = F.least(size - pos, other_size - other_pos)
    return (DEN * F.least(size, other_size) >= NUM * F.greatest(size, other_size)) & ((NUM + DEN) * room >= NUM * (size + other_size))


def similar(texts: DataFrame, pairs: DataFrame, sketches: DataFrame, words: int) -> DataFrame:
    """The pairs a, b of rows whose sets are similar enough."""
    pairs = written(within_sketch(pairs, sketches), "close-pairs")
    wanted = pairs.select(F.col("a").alias("w")).unionByName(pairs.select(F.col("b").alias("w"))).distinct()
    sets = written(sets_of(texts.join(wanted, F.col("row") == F.col("w"), "left_semi"), words), "shingle-sets")
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(sets.select(F.col("row").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("row").alias("b"), F.col("shingles").alias("sb")), "b")
    return joined.where(DEN * both >= NUM * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def similar_groups(texts: DataFrame, *, words: int = 5, propose: Callable[[DataFrame], DataFrame] | None = None, among: DataFrame | None = None) -> DataFrame:
    """row and component (a row of the same component) of every row (unique) and text.

    propose: more candidate pairs a, b, given head, a row of each set. among: the rows (row) that take part, if not all.
    """
    found = prefixes(texts, words)
    found = written(found if among is None else found.join(among, "row", "left_semi"), "prefixes")
    sketches = found.select("row", "sketch")
    heads = written(found.groupBy("digest").agg(F.min("row").alias("head")), "equal-sets")
    marks = found.join(heads, F.col("row") == F.col("head"), "left_semi").select("row", "size", F.posexplode("prefix").alias("pos", "h"))
    firsts = written(marks.groupBy("h").agg(F.min(F.struct("row", "size", "pos")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "f"), "prefix-firsts")
    marks = written(marks.join(firsts, "h"), "prefix-marks")
    stars = marks.where(F.col("row") != F.col("f.row")).where(possible(F.col("size"), F.col("pos"), F.col("f.size"), F.col("f.pos"))).select(F.col("f.row").alias("a"), F.col("row").alias("b"))
    if propose:
        stars = stars.unionByName(propose(heads.select("head")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b"))
    stars = written(stars.distinct(), "star-pairs")
    linked = written(similar(texts, stars, sketches, words), "star-links")
    groups = written(components(linked), "star-components")
    placed = marks.drop("f").join(groups, F.col("row") == F.col("node"), "left").select("h", "row", "size", "pos", F.coalesce("component", "row").alias("c"))
    other = placed.select("h", *[F.col(c).alias(f"other_{c}") for c in ("row", "size", "pos", "c")])
    apart = placed.join(other, "h").where("row < other_row AND c <> other_c").where(possible(F.col("size"), F.col("pos"), F.col("other_size"), F.col("other_pos")))
    apart = apart.select(F.col("row").alias("a"), F.col("other_row").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    linked = linked.unionByName(similar(texts, written(apart, "other-pairs"), sketches, words))
    groups = components(linked)
    known = heads.join(groups, F.col("head") == F.col("node"), "left").select(F.col("digest").alias("d"), F.coalesce("component", "head").alias("component"))
    return found.select("row", "digest").join(known, F.col("digest") == F.col("d")).select("row", "component")
