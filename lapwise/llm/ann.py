"""Approximate nearest neighbours by largest inner product: a robust-pruned directed graph per shard.

Vectors are spread over shards by bands of their norms, and by hash inside a band. In each shard a graph is grown in
batches: greedy beam searches of the graph so far propose neighbours for the new vectors, and relaxed distance pruning
keeps diverse edges (a candidate goes if a kept neighbour is closer to it than the vector is, by the factor alpha); edges
get reverse edges, pruned alike where a list overflows. Inner products become distances by one more dimension that lifts
all vectors of a shard to the norm of its longest. Lifts are held as what they lack to that norm, and vectors relative to
it, so that a very long vector beside short ones does not round their distances away.

Each shard measures itself: for a sample of its vectors the beam search is compared with all inner products of the shard,
and the beam doubles until the wanted recall is reached; a shard that needs a beam of over a sixteenth of its vectors is
searched by comparing all, which is then cheaper. Queries are files of blocks. A job is a block and a group of shards, a task
of its own; it searches shard by shard and keeps the best k + 1 of each query, so what is shuffled grows with queries times
groups, not with vectors. Blocks and groups are smaller where there would be fewer jobs than the cores need, which changes the
work's dealing only. The vectors found are scored exactly in double precision.

Equal vectors are one node that knows its k + 1 smallest ids, which is all that the k nearest of any query can need; so a
very common vector makes neither a dense knot in the graph nor a large group. Graphs and blocks are files in the shared
folder, listed by tables. A shard has about shard_rows distinct vectors, which bounds a task's memory.

Defined cases: ids are integers; vectors that are null, zero, hold null or non-finite components, or have another number of
components than most, take no part; a query is never its own neighbour, and rows that repeat its id are the same row; an id
that repeats on different vectors counts once, with its best score; fewer candidates than k are all returned; an empty
table gives an empty result.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from lapwise.llm.scratch import fresh_path, written
from lapwise.llm.token_files import open_at

DEGREE, BEAM, ALPHA = 32, 96, 1.2
SHARD_ROWS = 100_000
BLOCK_ROWS, LEAST_BLOCK = 20_000, 2_000
GROUP_SHARDS = 16
JOBS_PER_CORE = 4
AT_ONCE = 512
FIRST = 256
RECALL, SAMPLE = 0.97, 64
CHEAPER = 16


@dataclass
class Points:
    """Vectors relative to the longest one, their squared norms, and what their lifts lack to it."""

    unit: np.ndarray
    square: np.ndarray
    lack: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray) -> Points:
        exact = vectors.astype(np.float64)
        exact = exact / np.abs(exact).max(initial=1e-300)  # squares do not overflow
        exact = exact / np.sqrt((exact**2).sum(axis=1)).max(initial=1e-300)
        square = (exact**2).sum(axis=1)
        return cls(exact.astype(np.float32), square.astype(np.float32), (square / (1 + np.sqrt(np.maximum(1 - square, 0)))).astype(np.float32))

    def __len__(self) -> int:
        return len(self.unit)


def beam_search(points: Points, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int, lack: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (-1: none) and nearness of each query's beam, best first. All queries step together.

    Nearness is the inner product; with lack (of queries that are points) it falls with the distance of the lifted points.
    """

    def near(nodes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        found = np.einsum("ij,ij->i", points.unit[nodes], queries[rows])
        return found if lack is None else found - (points.square[nodes] + (points.lack[nodes] - lack[rows]) ** 2) / 2

    m, width = len(queries), len(entries)
    ids = np.full((m, beam), -1, dtype=np.int64)
    sims = np.full((m, beam), -np.inf, dtype=np.float32)
    done = np.ones((m, beam), dtype=bool)
    ids[:, :width], done[:, :width] = entries, False
    sims[:, :width] = near(np.tile(entries, m), np.repeat(np.arange(m), width)).reshape(m, width)
    seen = np.zeros((m, len(points)), dtype=bool)
    seen[:, entries] = True
    live = np.arange(m)
    while len(live):
        open_sims = np.where(done[live], -np.inf, sims[live])
        best = open_sims.argmax(axis=1)
        more = open_sims[np.arange(len(live)), best] > -np.inf
        live, best = live[more], best[more]
        if not len(live):
            break
        done[live, best] = True
        nodes = graph[ids[live, best]]
        fresh = (nodes >= 0) & ~seen[live[:, None], nodes]
        row, col = np.nonzero(fresh)
        seen[live[row], nodes[row, col]] = True
        found = np.full(nodes.shape, -np.inf, dtype=np.float32)
        found[row, col] = near(nodes[row, col], live[row])
        all_sims = np.concatenate([sims[live], found], axis=1)
        all_ids = np.concatenate([ids[live], np.where(fresh, nodes, -1)], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        take = lambda x: np.take_along_axis(x, top, axis=1)  # noqa: B023, E731
        ids[live], sims[live], done[live] = take(all_ids), take(all_sims), take(all_done)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)


def robust_prune(points: Points, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most degree diverse neighbours of each node from its row of candidates (-1: none)."""
    gone = (candidates < 0) | (candidates == nodes[:, None])
    square, lack = points.square[candidates], points.lack[candidates]
    apart = square + points.square[nodes, None] - 2 * np.einsum("mkd,md->mk", points.unit[candidates], points.unit[nodes]) + (lack - points.lack[nodes, None]) ** 2
    order = np.argsort(np.where(gone, np.inf, apart), axis=1, kind="stable")
    candidates, apart, gone, square, lack = (np.take_along_axis(x, order, axis=1) for x in (candidates, apart, gone, square, lack))
    own = points.unit[candidates]
    between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(own, own.transpose(0, 2, 1)) + (lack[:, :, None] - lack[:, None, :]) ** 2
    kept = np.full((len(nodes), degree), -1, dtype=np.int32)
    rows = np.arange(len(nodes))
    for k in range(degree):
        first = np.argmin(gone, axis=1)
        some = ~gone[rows, first]
        if not some.any():
            break
        kept[some, k] = candidates[some, first[some]]
        gone |= (alpha * alpha * between[rows, first] <= apart) & some[:, None]
        gone[rows, first] = True
    return kept


def build_graph(points: Points, *, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The neighbour lists (-1: none) and the entry nodes of the points."""
    n = len(points)
    graph = np.full((n, degree), -1, dtype=np.int32)
    order = np.random.default_rng(seed).permutation(n)
    centre = int(np.argmax(points.unit @ points.unit.mean(axis=0))) if n else 0
    order = np.concatenate([[centre], order[order != centre]]) if n else order
    first = order[:FIRST]
    graph[first] = robust_prune(points, first, np.tile(first, (len(first), 1)), degree, alpha)
    entries, at = order[: min(n, 8)], len(first)
    while at < n:
        new = order[at : at + min(AT_ONCE, at)]
        found, _ = beam_search(points, graph, entries, points.unit[new], beam, points.lack[new])
        graph[new] = robust_prune(points, new, found, degree, alpha)
        source, slot = np.nonzero(graph[new] >= 0)
        target, source = graph[new][source, slot], new[source]
        by = np.argsort(target, kind="stable")
        target, source = target[by], source[by]
        nodes, start, counts = np.unique(target, return_index=True, return_counts=True)
        for lower, size in ((0, 8), (8, 64), (64, int(counts.max(initial=0)))):  # nodes with few new edges are not padded to the most
            part = np.flatnonzero((counts > lower) & (counts <= size))
            for block in range(0, len(part), AT_ONCE):
                use = part[block : block + AT_ONCE]
                place = start[use][:, None] + np.arange(int(counts[use].max()))
                extra = np.where(np.arange(place.shape[1]) < counts[use][:, None], source[np.minimum(place, len(source) - 1)], -1)
                both = np.concatenate([graph[nodes[use]], extra], axis=1)
                full = (both >= 0).sum(axis=1) > degree
                packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)[:, :degree]
                graph[nodes[use][~full]] = packed[~full]
                if full.any():
                    graph[nodes[use][full]] = robust_prune(points, nodes[use][full], both[full], degree, alpha)
        at += len(new)
    return graph, entries


def wanted_beam(points: Points, graph: np.ndarray, entries: np.ndarray, k: int, *, least: int = BEAM, recall: float = RECALL, sample: int = SAMPLE) -> int:
    """The first beam, doubling from the least, that finds the wanted share of the k nearest of a sample; 0: none of under a CHEAPER-th of the points does, compare all."""
    n, beam = len(points), max(least, 2 * k)
    chosen = points.unit[np.random.default_rng(7).permutation(n)[:sample]]
    exact = chosen @ points.unit.T
    floor = np.partition(exact, -min(k, n), axis=1)[:, -min(k, n)]
    while True:
        _, sims = beam_search(points, graph, entries, chosen, beam)
        if np.minimum((sims >= floor[:, None] - 1e-6).sum(axis=1), k).mean() >= recall * min(k, n):
            return beam
        beam *= 2
        if beam * CHEAPER > n:
            return 0


def _save(uri: str, **arrays: np.ndarray) -> None:
    packed = io.BytesIO()
    np.savez(packed, **arrays)
    fs, path = open_at(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        out.write(packed.getbuffer())


def _load(uri: str) -> dict[str, np.ndarray]:
    fs, path = open_at(uri)
    with fs.open_input_file(path) as source:
        return dict(np.load(io.BytesIO(source.read())))


def usable(rows: DataFrame, *, key: str, vector: str) -> DataFrame:
    """id, vec (floats, or doubles where the column has other numbers) and vkey (equal for equal vectors) of the rows that take part."""
    kind = "float" if rows.schema[vector].dataType.elementType == T.FloatType() else "double"
    good = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    good = good.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    sizes = good.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    if not sizes:
        return good.withColumn("vkey", F.lit("")).limit(0)
    good = good.where(F.size("vec") == sizes[0]["n"]).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0).cast(kind)))
    return good.withColumn("vkey", F.md5(F.array_join(F.transform("vec", lambda x: x.cast("string")), ",")))


def with_shard(nodes: DataFrame, shards: int) -> DataFrame:
    """nodes (vkey, vec) with shard: bands of equal numbers of rows by norm; a band that equal norms make large is split by hash."""
    normed = nodes.withColumn("norm", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    marks, n = normed.agg(F.percentile_approx("norm", [i / shards for i in range(1, shards)] or [0.5], 10_000), F.count(F.lit(1))).first()
    band = F.size(F.filter(F.lit(sorted(set(marks or []))).cast("array<double>"), lambda m: m < F.col("norm")))
    banded = normed.withColumn("band", band)
    parts = banded.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / max(1, -(-n // shards) * 3 // 2)).cast("int").alias("parts"))  # a row per band, at most one per shard
    return banded.join(parts, "band").withColumn("shard", F.col("band") * 1_000_000 + F.pmod(F.xxhash64("vkey"), F.col("parts")).cast("int")).drop("norm", "band", "parts")


def build_index(vectors: DataFrame, folder: str, *, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Graph files of all vectors (id, vec, vkey); the table of shard, uri, vectors and the beam that the shard needs."""
    spark = vectors.sparkSession
    ranked = vectors.withColumn("place", F.row_number().over(Window.partitionBy("vkey").orderBy("id"))).where(F.col("place") <= k + 1)
    nodes = written(ranked.groupBy("vkey").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_set("id")).alias("ids")), "ann-nodes")  # k + 1 ids at most
    shards = max(spark.sparkContext.defaultParallelism, -(-nodes.count() // shard_rows))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vkey").combine_chunks()
        vec = table.column("vec").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        lists = table.column("ids").combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy()
        ids = np.full((len(sizes), int(sizes.max())), -1, dtype=np.int64)
        ids[np.arange(ids.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
        points = Points.of(vec)
        graph, entries = build_graph(points)
        beam = wanted_beam(points, graph, entries, k)
        uri = f"{folder}/shard-{table.column('shard')[0].as_py():012d}-{uuid.uuid4().hex}.npz"
        _save(uri, vec=vec, graph=graph, entries=entries, ids=ids)
        return pa.table({"shard": table.column("shard")[:1], "uri": [uri], "vectors": pa.array([table.num_rows], pa.int64()), "beam": pa.array([beam], pa.int32())})

    dealt = with_shard(nodes, shards).repartitionByRange(4 * shards, "shard")  # a task per shard, which is minutes of work: by hash some would get two, and small ones would be put together
    return dealt.groupBy("shard").applyInArrow(run, "shard int, uri string, vectors long, beam int")


def best_of(scores: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The keep best of each row, best first, ties to the smaller id, an id once; -inf and -1 where there are fewer."""
    order = np.lexsort((ids, -scores), axis=1)
    scores, ids = np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)
    by_id = np.argsort(ids, axis=1, kind="stable")  # the better score of an id first
    ranked = np.take_along_axis(ids, by_id, axis=1)
    again = np.zeros(ids.shape, dtype=bool)
    np.put_along_axis(again, by_id[:, 1:], (ranked[:, 1:] == ranked[:, :-1]), axis=1)
    if again.any():
        scores, ids = np.where(again, -np.inf, scores), np.where(again, -1, ids)
        order = np.argsort(again | (scores == -np.inf), axis=1, kind="stable")
        scores, ids = np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)
    return scores[:, :keep], ids[:, :keep]


def search_shard(shard: dict[str, np.ndarray], points: Points, beam: int, queries: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores in double precision and ids of the keep best of the shard for each query."""
    if not beam:
        count = min(len(points), 2 * keep)
        nodes = np.argpartition(-(queries.astype(np.float64) @ shard["vec"].astype(np.float64).T), count - 1, axis=1)[:, :count]
    else:
        longest = np.abs(queries).max(axis=1, keepdims=True).astype(np.float64)
        nodes = beam_search(points, shard["graph"], shard["entries"], (queries / longest).astype(np.float32), beam)[0][:, : 2 * keep]
    exact = np.einsum("mkd,md->mk", shard["vec"][nodes].astype(np.float64), queries.astype(np.float64))
    ids = np.where(nodes[:, :, None] >= 0, shard["ids"][nodes], -1).reshape(len(nodes), -1)
    each = np.repeat(exact, shard["ids"].shape[1], axis=1)
    return best_of(np.where(ids >= 0, each, -np.inf), ids, keep)


def dealing(queries: int, shards: int, cores: int, *, block_rows: int = BLOCK_ROWS, group_shards: int = GROUP_SHARDS) -> tuple[int, int]:
    """Blocks of queries and groups of shards; where they make too few jobs for the cores, first smaller blocks, then smaller groups."""
    blocks, groups = max(1, -(-queries // block_rows)), max(1, -(-shards // group_shards))
    wanted = JOBS_PER_CORE * cores
    blocks = max(blocks, min(-(-wanted // groups), -(-queries // LEAST_BLOCK)))
    return blocks, max(groups, min(shards, -(-wanted // blocks)))


def search(index: DataFrame, queries: DataFrame, folder: str, *, k: int, block_rows: int = BLOCK_ROWS, group_shards: int = GROUP_SHARDS) -> DataFrame:
    """vkey and hits, the best k + 1 (score, id) over all shards, for each distinct vector of queries (vec, vkey)."""
    distinct = written(queries.groupBy("vkey").agg(F.first("vec").alias("vec")), "ann-queries")
    cores = queries.sparkSession.sparkContext.defaultParallelism
    blocks, groups = dealing(distinct.count(), index.count(), cores, block_rows=block_rows, group_shards=group_shards)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vkey").combine_chunks()
        uri = f"{folder}/block-{uuid.uuid4().hex}.npz"
        _save(uri, vec=table.column("vec").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1), vkey=np.array(table.column("vkey").to_pylist(), dtype="S32"))
        return pa.table({"block": table.column("block")[:1], "queries": [uri]})

    packed = distinct.withColumn("block", F.pmod(F.xxhash64("vkey"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(pack, "block int, queries string")
    grouped = index.withColumn("group", F.pmod(F.row_number().over(Window.orderBy("shard")), F.lit(groups))).groupBy("group").agg(F.collect_list(F.struct("uri", "beam")).alias("shards"))  # a row per shard; group_shards of them
    jobs = written(packed, "ann-blocks").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(grouped, "group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.to_pylist():
                block = _load(job["queries"])
                best = np.full((len(block["vec"]), k + 1), -np.inf), np.full((len(block["vec"]), k + 1), -1, dtype=np.int64)
                for item in job["shards"]:
                    shard = _load(item["uri"])
                    points = Points.of(shard["vec"])
                    for at in range(0, len(block["vec"]), AT_ONCE):
                        part = slice(at, at + AT_ONCE)
                        found = search_shard(shard, points, item["beam"], block["vec"][part], k + 1)
                        merged = best_of(*(np.concatenate([b[part], f], axis=1) for b, f in zip(best, found, strict=True)), k + 1)
                        for b, m in zip(best, merged, strict=True):
                            b[part] = m
                row, col = np.nonzero(best[1] >= 0)
                yield pa.RecordBatch.from_pydict({"vkey": pa.array(block["vkey"][row].astype(str)), "score": pa.array(best[0][row, col]), "id": pa.array(best[1][row, col])})

    dealt = jobs.select("queries", "shards").coalesce(1).repartition(blocks * groups)  # a row per job, dealt in turn: by hash some tasks would get two
    hits = dealt.mapInArrow(run, "vkey string, score double, id long")
    hits = hits.groupBy("vkey", "id").agg(F.max("score").alias("score"))
    best = hits.withColumn("place", F.row_number().over(Window.partitionBy("vkey").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k + 1)
    return best.groupBy("vkey").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("hits"))  # k + 1 at most


def nearest(rows: DataFrame, *, k: int = 20, key: str = "vec_id", vector: str = "embedding", query_divisor: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for every row whose id query_divisor divides."""
    folder = fresh_path(rows.sparkSession, "ann")
    vectors = written(usable(rows, key=key, vector=vector), "ann-vectors")
    index = written(build_index(vectors, folder, k=k, shard_rows=shard_rows), "ann-index")
    queries = vectors.where(F.col("id") % query_divisor == 0)
    found = written(search(index, queries, folder, k=k), "ann-hits")
    joined = queries.select(F.col("id").alias("query_id"), "vkey").distinct().join(found, "vkey")
    others = joined.select("query_id", F.explode(F.filter("hits", lambda h: h["id"] != F.col("query_id"))).alias("hit"))
    once = others.groupBy("query_id", F.col("hit.id").alias("vec_id")).agg(F.min("hit.minus").alias("minus"))  # an id that repeats on several vectors
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("minus", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", (-F.col("minus")).alias("score"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
