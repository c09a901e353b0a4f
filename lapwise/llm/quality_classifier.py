"""Quality classifier by compression: zstandard dictionaries of good and bad text, and a calibrated score.

A text that resembles good text compresses better under the dictionary built from good text. The difference of the two
compressed sizes over the size of the text goes through a logistic calibration that is fitted on other labelled rows than
the dictionaries. Scored texts are compressed whole; the dictionaries are trained on their texts whole, cut into pieces of
piece_bytes, since the trainer wants many short samples (where it finds too few, the samples themselves are the dictionary).

Defined cases: null texts count as empty; an empty text, and every text when one class has no labelled row, gets the
share of class 1 among the labels (0.5 without labels); a document labelled twice takes the larger label; columns of
the input named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

LEVEL = 3


@dataclass
class CompressionModel:
    """Two dictionaries of a fixed size, calibration weights and the share of class 1."""

    prior: float
    good: bytes = field(default=b"", repr=False)
    bad: bytes = field(default=b"", repr=False)
    weights: tuple = ()


def _compressors(model: CompressionModel) -> list:
    found = []
    for content in (model.good, model.bad):
        table = zstandard.ZstdCompressionDict(content)
        table.precompute_compress(level=LEVEL)
        found.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=table))
    return found


def _measures(text: bytes, compressors: list) -> tuple[float, ...]:
    good, bad = (len(c.compress(text)) for c in compressors)
    return (1.0, (good - bad) / len(text))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps for a weighted logistic regression."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * beta
        curve = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def one_text(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, y and text of the chosen (doc_id, y), a row each: of the texts that repeat an id, the first by hash."""
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.max("y").alias("y"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def fit(documents: DataFrame, labels: DataFrame, *, label: str = "quality", per_class: int = 2000, dictionary_bytes: int = 112 << 10, piece_bytes: int = 1000, class_bytes: int = 32 << 20) -> CompressionModel:
    """Fit on at most per_class labelled documents of each class, those first by hash of doc_id, in one task.

    Of those, as many as begin within the first class_bytes of their class's texts, so that the task's memory is bounded.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if len(counts) < 2:
        return CompressionModel(prior)
    order = F.xxhash64("doc_id")
    chosen = marked.where("y = 0").orderBy(order, "doc_id").limit(per_class).unionByName(marked.where("y = 1").orderBy(order, "doc_id").limit(per_class))
    sample = one_text(documents, chosen).select("y", order.alias("turn"), "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    before = F.sum("size").over(Window.partitionBy("y").orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")  # per_class rows at most
    sample = sample.withColumn("before", before).where(F.col("before") < class_bytes).select("y", "turn", "text")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((t, y, (s or "").encode()) for b in batches for y, t, s in zip(*(b.column(c).to_pylist() for c in ("y", "turn", "text")), strict=True))
        rows = [r for r in rows if r[2]]
        first = rows[::2]
        model = CompressionModel(prior, *(_dictionary([s[at : at + piece_bytes] for _, y, s in first if y == k for at in range(0, len(s), piece_bytes)], dictionary_bytes) for k in (1, 0)))
        if model.good and model.bad:
            tools = _compressors(model)
            rest = rows[1::2]
            x, y = np.array([_measures(s, tools) for _, _, s in rest]).reshape(-1, 2), np.array([y for _, y, _ in rest], dtype=float)
            ones = max(1.0, y.sum())
            weight = np.where(y == 1, prior / ones, (1 - prior) / max(1.0, len(y) - ones)) * len(y)
            model.weights = tuple(_logistic(x, y, weight)) if 0 < y.sum() < len(y) else ()
        yield pa.RecordBatch.from_pydict({"good": pa.array([model.good], pa.binary()), "bad": pa.array([model.bad], pa.binary()), "weights": pa.array([list(model.weights)], pa.list_(pa.float64()))})

    got = sample.repartition(1).mapInArrow(train, "good binary, bad binary, weights array<double>").collect()
    return CompressionModel(prior, bytes(got[0]["good"]), bytes(got[0]["bad"]), tuple(got[0]["weights"])) if got else CompressionModel(prior)


def score(docs: DataFrame, model: CompressionModel, *, text: str = "text", out: str = "score") -> DataFrame:
    """docs with out: the probability of class 1. The broadcast model holds two dictionaries of a fixed size."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tools = _compressors(m) if m.weights else []
        for batch in batches:
            found = np.full(batch.num_rows, m.prior)
            for i, value in enumerate(batch.column(text)):
                if m.weights and (s := value.as_py()):
                    found[i] = 1 / (1 + np.exp(-np.clip(np.dot(m.weights, _measures(s.encode(), tools)), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def held_out(column: str = "doc_id", modulus: int = 3, remainder: int = 1):
    """True where crc32 of the id as text leaves the remainder (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus == remainder


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(documents, labels.where(~held_out()))
    return score(documents.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
