"""SimHash near-duplicates: fingerprints, tiled exact comparison, components.

Fingerprints: texts are ASCII-lower-cased; shingles of consecutive words, repeats included, are hashed by XXH64 with seed
42; a bit is 1 if it is set in over half of the hashes. A text of fewer words than a shingle is one shingle; one without
words (null, empty, white space) has fingerprint zero.

Links: distinct fingerprints lie in tiles by the population counts of their parts (two halves, or four quarters for
large tables). Two tiles are compared only if the counts differ by no more than the radius in sum, since a differing bit
moves one count by one. Inside a pair of tiles numpy compares all fingerprints by exclusive-or and bit counts, and passes
on the cheapest links that join the same fingerprints as all links found (a spanning forest). So copies meet as one
fingerprint, and a group of near copies costs links in proportion to its size.

Defined cases: a null id takes part by its text but is never a component's id (a group of null ids alone has a null
component); rows that repeat an id and a text are alike; an empty table gives an empty result; columns beside the id and
the text are not read by the grouping.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from lapwise.llm import textblocks as tb
from lapwise.llm.components import components, forest
from lapwise.llm.scratch import forget_shuffles, small_batches, temporary, written
from lapwise.llm.similar_sets import shingle_spans, similar_groups

SEED = 42
TILE = 4096
ROWS_AT_ONCE = 128
QUARTERS_FROM = 1_000_000
BATCH_ROWS = 256


def _compact(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words' bytes, each word followed by one space, and the new starts and ends."""
    sizes = ends - starts
    new_ends = np.cumsum(sizes + 1) - 1
    out = np.full(new_ends[-1] + 1 if len(sizes) else 0, 0x20, dtype=np.uint8)
    shift = new_ends - ends  # of each word's bytes
    solid = np.flatnonzero(~tb.WHITE[data])
    out[solid + np.repeat(shift, sizes)] = data[solid]
    return out.tobytes(), starts + shift, new_ends


def fingerprints(docs: DataFrame, *, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_digest
        for part, data, offsets in tb.text_blocks(batches, "text"):
            data = tb.LOWER[data]
            starts, ends, first = tb.word_spans(data, offsets)
            buffer, begin, end = _compact(data, starts, ends)
            at, cuts = shingle_spans(first, words)
            row_end = np.repeat(first[1:], np.diff(cuts))
            last = np.minimum(at + words, row_end) - 1
            hashes = b"".join([digest(buffer[a:b], SEED) for a, b in zip(begin[at].tolist(), end[last].tolist(), strict=True)])
            out = np.zeros(part.num_rows, dtype=np.int64)
            sizes = np.diff(cuts)
            if full := np.flatnonzero(sizes).tolist():
                bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
                counts = np.add.reduceat(bits, cuts[:-1][full], axis=0, dtype=np.int32)
                out[full] = np.packbits(2 * counts > sizes[full][:, None], axis=1).view(">i8").ravel()
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "fingerprint": pa.array(out)})

    chosen = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def tile_pairs(prints: DataFrame, radius: int, parts: int) -> DataFrame:
    """Pairs of tiles that can hold linked fingerprints, each tile an array of (f, id). prints: fingerprint, id."""
    width = 64 // parts
    mask = (1 << width) - 1
    counts = [F.bit_count(F.shiftrightunsigned("fingerprint", width * i).bitwiseAND(F.lit(mask))).cast("int") for i in range(parts)]
    code = sum((c * F.lit((width + 1) ** i) for i, c in enumerate(counts)), F.lit(0))
    placed = prints.withColumn("bucket", code)
    sizes = written(placed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")), "tile-counts")  # (width + 1) ** parts rows at most
    placed = placed.join(F.broadcast(sizes), "bucket").withColumn("tile", F.pmod(F.xxhash64("fingerprint"), F.col("tiles")).cast("int"))
    tiles = written(placed.groupBy("bucket", "tile").agg(F.collect_list(F.struct(F.col("fingerprint").alias("f"), "id")).alias("members")), "tiles")
    steps = [s for s in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, s)) <= radius]
    own = [F.floor(F.col("bucket") / (width + 1) ** i).cast("int") % (width + 1) for i in range(parts)]
    moves = F.array(*[F.struct(*[F.lit(x).alias(f"s{i}") for i, x in enumerate(s)]) for s in steps])
    near = sizes.select("bucket", "tiles", *[o.alias(f"p{i}") for i, o in enumerate(own)], F.explode(moves).alias("m"))
    inside = [(F.col(f"p{i}") + F.col(f"m.s{i}")).between(0, width) for i in range(parts)]
    other = sum(((F.col(f"p{i}") + F.col(f"m.s{i}")) * F.lit((width + 1) ** i) for i in range(parts)), F.lit(0))
    for test in inside:
        near = near.where(test)
    near = near.select("bucket", "tiles", other.alias("other")).where("other >= bucket")
    near = near.join(F.broadcast(sizes.select(F.col("bucket").alias("other"), F.col("tiles").alias("other_tiles"))), "other")
    near = near.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("other_tile", F.explode(F.sequence(F.lit(0), F.col("other_tiles") - 1)))
    near = near.where("other > bucket OR other_tile >= tile").select("bucket", "tile", "other", "other_tile")
    left = tiles.select("bucket", "tile", F.col("members").alias("left"))
    right = tiles.select(F.col("bucket").alias("other"), F.col("tile").alias("other_tile"), F.col("members").alias("right"))
    return near.join(left, ["bucket", "tile"]).join(right, ["other", "other_tile"]).select((F.expr("bucket = other AND tile = other_tile")).alias("same"), "left", "right")


def compare_tiles(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices into left and right of links that join what all links within the radius join, the closest first."""
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    shift = 0 if same else len(left)

    def reduce() -> None:
        a, b, d = (np.concatenate(x) for x in zip(*kept, strict=True))
        use = forest(len(left) + (0 if same else len(right)), a, b + shift, d)
        kept[:] = [(a[use], b[use], d[use])]

    for at in range(0, len(left), ROWS_AT_ONCE):
        apart = np.bitwise_count(left[at : at + ROWS_AT_ONCE, None] ^ right[None, :])
        a, b = np.nonzero(apart <= radius)
        if same:
            a, b = a[a + at < b], b[a + at < b]
        if len(a):
            kept.append((a + at, b, apart[a, b]))
            held += len(a)
            if held > 500_000:
                reduce()
                held = len(kept[0][0])
    if not kept:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty
    reduce()
    return kept[0][0], kept[0][1]


def links(prints: DataFrame, *, radius: int, parts: int | None = None) -> DataFrame:
    """a, b: ids of fingerprints at most radius bits apart; a spanning forest of all such links within each pair of tiles.

    prints: fingerprint (distinct) and id. A forest of forests still joins all that the links join.
    """
    kind = prints.schema["id"].dataType.simpleString()
    if parts is None:
        parts = 4 if radius <= 3 and prints.count() >= QUARTERS_FROM else 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_ids, b_ids = [], []
            same, (left, right) = batch.column("same").to_pylist(), (batch.column(c) for c in ("left", "right"))
            for i in range(batch.num_rows):
                x, y = left[i].values, right[i].values
                a, b = compare_tiles(*(v.field("f").to_numpy().view(np.uint64) for v in (x, y)), same[i], radius)
                if len(a):
                    a_ids.append(x.field("id").take(pa.array(a)))
                    b_ids.append(y.field("id").take(pa.array(b)))
            if a_ids:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(a_ids), pa.concat_arrays(b_ids)], names=["a", "b"])

    return tile_pairs(prints, radius, parts).mapInArrow(run, f"a {kind}, b {kind}")


def group_near_duplicates(docs: DataFrame, *, words: int = 3, radius: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id that links reach."""
    prints = written(fingerprints(docs, words=words, key=key, text=text), "fingerprints")
    with temporary(docs.sparkSession):
        distinct = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("id")), "distinct-fingerprints")
        groups = components(links(distinct.select("fingerprint", F.col("fingerprint").alias("id")), radius=radius))
        placed = written(distinct.join(groups, F.col("fingerprint") == F.col("node"), "left").select(F.col("fingerprint").alias("f"), "id", F.coalesce("component", "fingerprint").alias("c")), "placed-fingerprints", lasting=True)
    least = placed.groupBy("c").agg(F.min("id").alias("component_id"))
    known = placed.select("f", "c").join(least, "c").select("f", "component_id")
    joined = prints.join(known, F.col("fingerprint") == F.col("f"))
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), words=3, radius=3)


def close_pairs(texts: DataFrame, heads: DataFrame, *, words: int, radius: int) -> DataFrame:
    """a, b: pairs of those rows (row, text) that heads (head) names; they join all whose fingerprints are equal or linked."""
    prints = written(fingerprints(texts, words=words, key="row").join(heads, F.col("doc_id") == F.col("head"), "left_semi"), "fingerprints")
    distinct = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("id")), "distinct-fingerprints")
    equal = prints.join(distinct, "fingerprint").where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    return equal.unionByName(links(distinct, radius=radius))


def later_copies(docs: DataFrame, whole: DataFrame) -> DataFrame:
    """gone: ids of docs whose text in whole (doc_id, text) is a near copy of that of a smaller id of docs.

    An id takes part if docs and whole hold it once, and counts only if its text in whole has all words of that in docs, so
    that the one can be what is left of the other.
    """
    texts = whole.select(F.col("doc_id").cast("long").alias("row"), "text")
    left = docs.select(F.col("doc_id").cast("long").alias("row"), F.col("text").alias("left"))
    once = lambda rows: rows.where("row IS NOT NULL").groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("row")
    ids = written(once(left).join(once(texts), "row"), "near-ids")
    groups = written(similar_groups(texts, words=5, propose=lambda heads: close_pairs(texts, heads, words=5, radius=3), among=ids), "whole-groups")
    crowds = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    members = written(groups.join(crowds, "component", "left_semi"), "whole-members")
    words = lambda c: F.array_remove(F.split(F.coalesce(c, F.lit("")), r"[\x09-\x0D ]+"), "")
    known = members.join(left, "row").join(texts, "row").where(F.size(F.array_except(words("left"), words("text"))) == 0).select("row", "component")
    known = written(known, "whole-known")
    first = known.groupBy("component").agg(F.min("row").alias("first"))
    return known.join(first, "component").where("row > first").select(F.col("row").alias("gone"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies (five words, similarity 0.8), the document with the smallest id stays.

    Line dedup has by then cut from a near copy all that it shares in long runs, and what is left of it is no near copy of
    anything. So documents that have come this far are first compared by the whole texts that the input has for them
    (later_copies), and those that remain by the texts as they are now.

    SimHash fingerprints and their tiles propose pairs, and every pair counts only if its shingle sets are that similar.
    No fingerprint distance of use bounds that similarity (half of the pairs at 0.8 differ in more than nine bits), so an
    exact join on the shingle sets (similar_sets) adds the pairs that the fingerprints miss. A row counts by its text, also
    where its id is null (last in order) or repeated: one row of each group stays.
    """
    with temporary(spark), small_batches(spark, BATCH_ROWS):
        gone = written(later_copies(docs, spark.read.parquet(f"{sf_dir}/documents.parquet")), "near-gone", lasting=True).withColumnRenamed("gone", "lapwise_gone")
    forget_shuffles(spark)
    left = docs.join(gone, F.col("doc_id") == F.col("lapwise_gone"), "left_anti")
    rows = written(left.withColumn("lapwise_row", F.monotonically_increasing_id()), "near-rows")
    texts = rows.select(F.col("lapwise_row").alias("row"), "text")
    with temporary(spark), small_batches(spark, BATCH_ROWS):
        groups = written(similar_groups(texts, words=5, propose=lambda heads: close_pairs(texts, heads, words=5, radius=3)), "near-groups", lasting=True)
    ranked = rows.select("lapwise_row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "lapwise_row").alias("turn")).join(groups, F.col("lapwise_row") == F.col("row"))
    kept = ranked.groupBy("component").agg(F.min("turn").alias("first")).select(F.col("first.lapwise_row").alias("kept_row"))
    return rows.join(kept, F.col("lapwise_row") == F.col("kept_row"), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
