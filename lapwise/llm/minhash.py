"""MinHash near-duplicates with min-max hashing: banded signatures propose pairs, whole shingle sets confirm them.

Texts are ASCII-lower-cased; a document's set holds its distinct shingles of consecutive words (64-bit hashes). Under each
permutation both the smallest and the largest hash are kept: either agrees between two sets with the probability of their
Jaccard similarity, so PERMUTATIONS evaluations give twice as many values. A band is ROWS values of one kind, the minima or
the maxima of ROWS permutations, so that the values of a band are independent; the two bands of the same permutations are
not, but hinder each other, which only helps. Two sets of similarity 0.8 miss all BANDS bands with a probability of
(1 - 0.8**ROWS)**BANDS, under 1e-10.

Equal sets (a digest of 128 bits) are one node. Each node first meets the first node (in one order of all) of each of its
buckets; those pairs are verified on the whole sets (similar_sets.similar), and the components of the links are formed. Then
only buckets with nodes of several components are left. Their nodes are dealt into tiles, and a task compares the pairs of two
tiles by sketches: how many shingles of a set fall into each of about as many places as it has shingles. The smaller counts
of two sketches add up to at least what the sets have in common, so a pair without room for the similarity is dropped for
good, in arithmetic, not in rows; what a sketch leaves (few pairs below 0.75) is verified on the whole sets in turn. A pair
of one component cannot change the components, so nothing is lost by leaving it out. In ROUNDS rounds, each on a few bands, a
tile first puts out only its best pairs that join its nodes (a spanning forest by the room they have), which after
verification leave few components even of a large group without a centre that all are like; then all pairs of all bands
that still lie in two components follow.

Defined cases: a text of fewer words than a shingle is one shingle; one without words (null, empty, white space) has no
shingle and links with nothing, not even its like; a null id takes part by its text but is never a component's id unless
the group holds no other (then kept is true for it); rows that repeat an id are documents of their own, by their texts;
an empty table gives an empty result; columns beside the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lapwise.llm import textblocks as tb
from lapwise.llm.components import components, forest
from lapwise.llm.scratch import temporary, written
from lapwise.llm.similar_sets import BUCKETS, DEN, NUM, shingle_sets, similar, sketch

PERMUTATIONS, ROWS = 88, 4
BANDS = 2 * PERMUTATIONS // ROWS
TILE_ROWS, TILE_BYTES = 1024, 1 << 20
PLACES, AT_ONCE, ROWS_AT_ONCE = 1 << 16, 1 << 21, 64
ROUNDS, BANDS_A_ROUND = 2, 4
_MAKE = np.random.default_rng(20240229)
#: A permutation of 64-bit hashes: an exclusive-or, then a product with an odd number.
TURNS = _MAKE.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64)
FACTORS = _MAKE.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row for each (nonempty) set: the minimum under every permutation, then the maximum under every permutation."""
    flat = np.concatenate(sets).view(np.uint64)
    begin = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), 2 * PERMUTATIONS), dtype=np.uint64)
    for k in range(PERMUTATIONS):
        turned = (flat ^ TURNS[k]) * FACTORS[k]
        out[:, k] = np.minimum.reduceat(turned, begin)
        out[:, PERMUTATIONS + k] = np.maximum.reduceat(turned, begin)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A row for each signature: a 64-bit key for each band; keys of different bands differ."""
    grouped = values.reshape(len(values), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(values), BANDS)).copy()
    for k in range(ROWS):
        keys = tb.mix(keys + grouped[:, :, k])
    return keys.view(np.int64)


def mark_of(shingles: np.ndarray) -> bytes | None:
    """The number of shingles at each place, a byte each: at least as many places as shingles, a power of two; null where a byte is too small."""
    places = min(PLACES, BUCKETS << max(0, (len(shingles) - 1) // BUCKETS).bit_length())
    counts = np.bincount(shingles & (places - 1), minlength=places)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def signed(texts: DataFrame, words: int) -> DataFrame:
    """row, digest, size, sketch, mark and band keys of every row (unique) and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in tb.text_blocks(batches, "text"):
            sets = shingle_sets(data, offsets, words)
            full = [k for k, s in enumerate(sets) if len(s)]
            keys: list[np.ndarray | None] = [None] * len(sets)
            if full:
                for k, own in zip(full, band_keys(signatures([sets[k] for k in full])), strict=True):
                    keys[k] = own
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), pa.array(map(mark_of, sets), pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["row", "digest", "size", "sketch", "mark", "keys"],
            )

    return texts.select("row", "text").mapInArrow(run, "row long, digest binary, size long, sketch binary, mark binary, keys array<long>")


def room(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """At least the number of elements that each set of the left and each of the right have in common, by their marks."""
    if len(left) * len(right) * left.shape[1] <= AT_ONCE:
        return np.minimum(left[:, None, :], right[None, :, :]).sum(axis=2, dtype=np.int64)
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for at in range(0, len(left), ROWS_AT_ONCE):
        part = left[at : at + ROWS_AT_ONCE]
        total = np.zeros((len(part), len(right)), dtype=np.int32)
        for k in range(left.shape[1]):
            total += np.minimum(part[:, k, None], right[None, :, k])
        out[at : at + ROWS_AT_ONCE] = total
    return out


def marks_of(members: pa.StructArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of places (0: no mark): the members' indices and their marks as a matrix."""
    marks = members.field("mark").to_pylist()
    sizes = np.array([len(m or b"") for m in marks])
    return {int(p): (at := np.flatnonzero(sizes == p), np.frombuffer(b"".join(marks[k] or b"" for k in at), dtype=np.uint8).reshape(len(at), p)) for p in np.unique(sizes)}


def fold(marks: np.ndarray, places: int) -> np.ndarray:
    """Marks on fewer places: each place takes those that are equal to it modulo the new number, as far as a count goes."""
    return np.minimum(marks.reshape(len(marks), -1, places).sum(axis=1, dtype=np.int64), 65535).astype(np.uint16)


def close_pairs(left: pa.StructArray, right: pa.StructArray | None, thin: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of different groups whose marks leave room for the similarity; thin: only the roomiest that join the same nodes."""
    other = left if right is None else right
    found = []
    sizes, groups = zip(*((x.field("size").to_numpy(), x.field("c").to_numpy()) for x in (left, other)), strict=True)
    for p, (rows, marks) in marks_of(left).items():
        for q, (cols, other_marks) in marks_of(other).items():
            both = sizes[0][rows][:, None] + sizes[1][cols][None, :]
            near = groups[0][rows][:, None] != groups[1][cols][None, :]
            near &= DEN * np.minimum(sizes[0][rows][:, None], sizes[1][cols][None, :]) >= NUM * np.maximum(sizes[0][rows][:, None], sizes[1][cols][None, :])
            free = np.zeros(near.shape)
            if p and q and near.any():
                least = min(p, q)
                bound = room(fold(marks, least) if p > least else marks, fold(other_marks, least) if q > least else other_marks)
                near &= (NUM + DEN) * bound >= NUM * both
                free = bound / both
            a, b = np.nonzero(near)
            found.append((rows[a], cols[b], free[a, b]))
    a, b, free = (np.concatenate(x) for x in zip(*found, strict=True))
    if right is None:
        a, b, free = a[a < b], b[a < b], free[a < b]
    if thin:
        use = forest(len(left), a, b, -free)
        a, b = a[use], b[use]
    return left.field("row").to_numpy()[a], other.field("row").to_numpy()[b]


def crossing(members: DataFrame, *, thin: bool = False) -> DataFrame:
    """a, b: pairs of nodes of one bucket and different groups that can be similar enough. members: key, row, c, size, mark.

    A large bucket is dealt into tiles by hash, and each pair of its tiles is a row: no task holds a bucket. thin: of each
    tile's own pairs those that join its nodes, and none between tiles.
    """
    wanted = F.greatest(F.ceil(F.count(F.lit(1)) / TILE_ROWS), F.ceil(F.sum(F.coalesce(F.length("mark"), F.lit(0))) / TILE_BYTES))
    sizes = written(members.groupBy("key").agg(wanted.cast("int").alias("tiles")), "bucket-sizes")
    placed = members.join(sizes, "key").withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int"))
    tiles = written(placed.groupBy("key", "tile").agg(F.collect_list(F.struct("row", "c", "size", "mark")).alias("members")), "bucket-tiles")
    near = sizes.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("other", F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)))
    own = tiles.select(F.col("members").alias("left"), F.lit(None).cast(tiles.schema["members"].dataType).alias("right"))
    left = tiles.select("key", "tile", F.col("members").alias("left"))
    right = tiles.select("key", F.col("tile").alias("other"), F.col("members").alias("right"))
    pairs = own if thin else own.unionByName(near.where("other > tile").select("key", "tile", "other").join(left, ["key", "tile"]).join(right, ["key", "other"]).select("left", "right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                other = batch.column("right")[i]
                a, b = close_pairs(batch.column("left")[i].values, other.values if other.is_valid else None, thin)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").distinct()


def near_nodes(found: DataFrame, texts: DataFrame, met: DataFrame) -> DataFrame:
    """row, size, sketch, mark and text of the nodes that share a bucket: the only ones that later steps ask for.

    Texts and marks of all rows cross a shuffle here once, however many rounds follow. The hint keeps it so at every size:
    a small table's rows would be broadcast instead.
    """
    wanted = met.select("row").distinct().hint("merge")
    return written(found.select("row", "size", "sketch", "mark").join(wanted, "row", "left_semi").join(texts.select("row", "text").hint("merge"), "row"), "near-nodes")


def minhash_groups(texts: DataFrame, *, words: int = 4) -> DataFrame:
    """row, size (of the shingle set) and component (a row of the same component) of every row (unique) and text."""
    found = written(signed(texts, words), "signatures", lasting=True)
    heads = written(found.where("size > 0").groupBy("digest").agg(F.min("row").alias("head")), "equal-sets", lasting=True)
    marks = written(found.select("row", "keys").join(heads, F.col("row") == F.col("head"), "left_semi"), "node-keys").select("row", F.posexplode("keys").alias("band", "key"))
    turn = F.struct(F.xxhash64("row").alias("turn"), "row")
    firsts = written(marks.groupBy("key").agg(F.min(turn).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("f.row").alias("centre")), "bucket-centres")
    met = written(marks.join(firsts, "key"), "bucket-rows")
    stars = written(met.where("row <> centre").select(F.least("row", "centre").alias("a"), F.greatest("row", "centre").alias("b")).distinct(), "star-pairs")
    nodes = near_nodes(found, texts, met)
    texts, sketches = nodes.select("row", "text"), nodes.select("row", "sketch")
    linked, seen = written(similar(texts, stars, sketches, words), "star-links"), stars
    for step in range(ROUNDS + 1):
        groups = written(components(linked), "node-components")
        bands = met if step == ROUNDS else met.where(F.col("band").between(step * BANDS_A_ROUND, (step + 1) * BANDS_A_ROUND - 1))
        placed = written(bands.select("key", "row").join(groups, F.col("row") == F.col("node"), "left").select("key", "row", F.coalesce("component", "row").alias("c")), "placed-rows")
        mixed = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
        members = placed.join(mixed, "key").join(nodes.select("row", "size", "mark"), "row")
        apart = written(crossing(members, thin=step < ROUNDS).join(seen, ["a", "b"], "left_anti"), "other-pairs")
        linked, seen = written(linked.unionByName(similar(texts, apart, sketches, words)), "links-so-far"), seen.unionByName(apart)
    groups = components(linked)
    known = heads.join(groups, F.col("head") == F.col("node"), "left").select(F.col("digest").alias("d"), F.coalesce("component", "head").alias("component"))
    return found.join(known, (F.col("digest") == F.col("d")) & (F.col("size") > 0), "left").select("row", "size", F.coalesce("component", "row").alias("component"))


def group_by_minhash(docs: DataFrame, *, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (the smallest id that links reach) and kept (the row's id is the component's)."""
    spark = docs.sparkSession
    rows = written(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id()), "minhash-rows")
    with temporary(spark):
        groups = written(minhash_groups(rows.select("row", "text"), words=words), "minhash-groups", lasting=True)
    placed = rows.select("row", "id").join(groups, "row")
    least = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    joined = placed.join(least, "component")
    return joined.select(F.col("id").alias(key), F.col("size").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_by_minhash(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
