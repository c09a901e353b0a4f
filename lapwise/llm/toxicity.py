"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Tokens are runs of letters, digits and non-ASCII bytes, ASCII-lower-cased. Features are the distinct unigrams, bigrams and
one-gap skip-grams of a text, and the first prefix_bytes bytes of longer words, so that inflected and compound forms share
weight (prefix_bytes=() leaves these out), hashed to 2**bits buckets. L1 keeps the weight vector sparse: only its non-zero
weights travel to the tasks (at most one per feature of the bounded training sample).

Defined cases: a null or empty text has no feature and gets the score of the bias alone; rows of labels whose label is
null count as unlabelled; a document labelled twice takes the larger label; with no label of one class, or no document of one,
the score is the share of class 1 among the labels (0.5 without labels); columns of the input named like an output are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lapwise.llm import textblocks as tb
from lapwise.llm.quality_classifier import one_text
from lapwise.llm.workers import release

TOKEN_BYTES = np.full(256, 0x20, dtype=np.uint8)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    TOKEN_BYTES[_low:_high] = tb.LOWER[_low:_high]

@dataclass
class ToxicityModel:
    """Sparse weights by ascending bucket, and the bias; the features' number of bits and prefixes."""

    bits: int
    prefix_bytes: tuple[int, ...]
    bias: float
    buckets: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)


def features(data: np.ndarray, offsets: np.ndarray, bits: int, prefix_bytes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every unigram, prefix, bigram and skip-gram, repeats included."""
    data = TOKEN_BYTES[data]
    starts, ends, first = tb.word_spans(data, offsets)
    hashes = tb.word_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    rows, keys = [row], [hashes]
    for length in prefix_bytes:
        long = ends - starts > length
        rows.append(row[long])
        keys.append(tb.mix(tb.word_hashes(data, starts[long], starts[long] + length) + np.uint64(length)))
    for gap, salt in ((1, 3), (2, 5)):
        same = row[:-gap] == row[gap:]
        rows.append(row[:-gap][same])
        keys.append(tb.mix(hashes[:-gap] * np.uint64(salt) + hashes[gap:])[same])
    return np.concatenate(rows), (np.concatenate(keys) >> np.uint64(64 - bits)).astype(np.int64)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def ftrl(examples: list[tuple[int, np.ndarray]], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, float]:
    """FTRL-proximal with per-coordinate rates; returns the dense weights and the unpenalised bias."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    weigh = lambda z, n: np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    for _ in range(epochs):
        for label, at in examples:
            zi, ni = z[at], n[at]
            w, bias = weigh(zi, ni), -zb * alpha / (beta + math.sqrt(nb))
            g = _sigmoid(float(w.sum()) + bias) - label
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * bias
            nb += g * g
    return weigh(z, n), -zb * alpha / (beta + math.sqrt(nb))


def fit(documents: DataFrame, labels: DataFrame, *, label: str = "toxic", per_class: int = 3000, bits: int = 22, min_documents: int = 3, epochs: int = 6, alpha: float = 0.3, beta: float = 1.0, l1: float = 9.0, l2: float = 1.0, prefix_bytes: tuple[int, ...] = (4, 5)) -> ToxicityModel:
    """Fit on at most per_class labelled documents of each class, those first by hash of doc_id.

    The bound makes the training set fit one task; scores are put back to the class shares of all labels.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
        return ToxicityModel(bits, prefix_bytes, math.log((share + 1e-6) / (1 - share + 1e-6)), np.zeros(0, dtype=np.int64), np.zeros(0))
    order = F.xxhash64("doc_id")
    chosen = marked.where("y = 0").orderBy(order, "doc_id").limit(per_class).unionByName(marked.where("y = 1").orderBy(order, "doc_id").limit(per_class))
    sample = one_text(documents, chosen)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part, data, offsets in tb.text_blocks(batches, "text"):
            row, bucket = features(data, offsets, bits, prefix_bytes)
            found = np.unique((row << bits) | bucket)
            cuts = np.searchsorted(found, np.arange(part.num_rows + 1) << bits)
            found = (found & ((1 << bits) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "y": part.column("y"), "buckets": [found[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen = [(zlib.crc32(str(d).encode()), str(d), y, b) for batch in batches for d, y, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "y", "buckets")), strict=True)]
        seen.sort()  # the same order in every run
        examples = [(y, np.frombuffer(b, dtype=np.int32)) for *_, y, b in seen]
        if len({y for y, _ in examples}) < 2:
            return
        often = np.zeros(1 << bits, dtype=np.int32)
        for _, at in examples:
            often[at] += 1
        dense, bias = ftrl([(y, at[often[at] >= min_documents]) for y, at in examples], bits, epochs, alpha, beta, l1, l2)
        at = np.flatnonzero(dense)
        for k in range(0, len(at) + 1, 50_000):
            part = at[k : k + 50_000]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(part, -1) if not k else part, pa.int64()), "weight": pa.array(np.append(dense[part], bias) if not k else dense[part], pa.float64())})

    kept = {k: min(n, per_class) for k, n in counts.items()}
    got = sample.mapInArrow(extract, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, y int, buckets binary").repartition(1).mapInArrow(train, "bucket long, weight double").toArrow()
    bucket, weight = got.column("bucket").to_numpy(), got.column("weight").to_numpy()
    if not len(weight):  # labelled documents of both classes are not there
        return ToxicityModel(bits, prefix_bytes, math.log(counts[1] / counts[0]), np.zeros(0, dtype=np.int64), np.zeros(0))
    shift = math.log(counts[1] / counts[0]) - math.log(kept[1] / kept[0])
    order_by = np.argsort(bucket, kind="stable")
    bucket, weight = bucket[order_by], weight[order_by]
    return ToxicityModel(bits, prefix_bytes, float(weight[0]) + shift, bucket[1:].astype(np.int64), weight[1:])


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text", out: str = "score") -> DataFrame:
    """docs with out: the probability of class 1. The sparse weights are broadcast; their number is bounded by the fit."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = shared.value
        dense = np.zeros(1 << m.bits, dtype=np.float32)
        dense[m.buckets] = m.weights
        for part, data, offsets in tb.text_blocks(batches, text):
            row, bucket = features(data, offsets, m.bits, m.prefix_bytes)
            live = dense[bucket] != 0
            found = np.unique((row[live] << m.bits) | bucket[live])
            total = np.bincount(found >> m.bits, weights=dense[found & ((1 << m.bits) - 1)].astype(np.float64), minlength=part.num_rows)
            p = 1 / (1 + np.exp(-np.clip(total + m.bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=[*part.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def held_out(column: str = "doc_id", modulus: int = 4, remainder: int = 2):
    """True where crc32 of the id as text leaves the remainder (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus == remainder


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(documents, labels.where(~held_out()))
    return score(documents.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored at 0.3 or more go."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, out="lapwise_toxicity").where("lapwise_toxicity < 0.3").drop("lapwise_toxicity")
