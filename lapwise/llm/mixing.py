"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Each source has a weight that moves linearly over training time u from start to end. Its integral is the source's
weight; all sources share the words of the corpus by weight, a source's target stopping at max_repeats times its size
with the excess reshared. A source is read in hash order, whole passes first and then a part of a pass; the words read
before a copy's middle, over the target, are a share of the source's demand, and the inverse of the cumulative
schedule at that share is the copy's position in training, by which the copies are range-sorted.

Prefix sums take two levels: sums of hash bins within a source, then a window inside each bin, so that a source that
holds a third of all rows is spread over all tasks.

Defined cases: null texts have size 0; sizes of 0 take 0 words in as many copies as the source has whole passes; a null
source is a source, sorted last; repeated rows are separate rows; an empty table gives an empty result; helper columns
are kept in structs, so other columns of the input may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lapwise.llm.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
BIN_DIGITS = 3
#: A part of a pass reads documents of over a LARGE_SHARE-th of the target last, the smaller first, so that they do not overshoot it.
LARGE_SHARE = 40
LARGE_BIN = "z"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def source_targets(sizes: DataFrame, start: Column, end: Column, *, max_repeats: int = 3) -> DataFrame:
    """One row per source: key, source_size, target, start and end weight.

    sizes has source and source_size. start and end are expressions over rank, the source's place by code point from 1.
    Filling by weight up to the caps is solved in one pass over the sources ordered by cap over weight.
    """
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumns({"start": start.cast("double"), "end": end.cast("double")})
    filled = (
        ranked.withColumn("weight", (F.col("start") + F.col("end")) / 2)
        .withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
        .withColumns({"total": F.sum("source_size").over(everything).cast("double"), "weights": F.sum("weight").over(everything), "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
        .withColumn("capped", F.col("cap") * (F.col("weights") - F.col("weight_before")) <= F.col("weight") * (F.col("total") - F.col("cap_before")))
        .withColumns({"left": F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0)), "open_weight": F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)})
    )
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("left") * F.col("weight") / F.col("open_weight"))
    return filled.select("source", "source_size", target.alias("target"), "start", "end")


def inverse_schedule(share: Column, start: Column, end: Column) -> Column:
    """The time at which a weight moving linearly from start to end has used up this share of its integral."""
    tilt = (end - start) / (start + end)
    root = F.sqrt(F.greatest((1 - tilt) * (1 - tilt) + 4 * tilt * share, F.lit(0.0)))
    return F.when(F.abs(tilt) < 1e-9, share).otherwise((root - (1 - tilt)) / F.nullif(2 * tilt, F.lit(0.0)))


def thirds_weight(tilt: float = 0.5) -> tuple[Column, Column]:
    """Weights 1, 2, 3, repeating by rank; the first falls over time, the second is constant, the third rises."""
    turn = (F.col("rank") - 1) % 3
    return (turn + 1) * (1 - (turn - 1) * tilt), (turn + 1) * (1 + (turn - 1) * tilt)


def plan_mix(docs: DataFrame, *, weights: tuple[Column, Column] | None = None, max_repeats: int = 3, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """docs with a struct column mix: size, source_size, target, copies, taken, and positions of the copies.

    A source's taken words differ from its target by half of one document at most: a document of under a fortieth of
    the target, unless the source has not enough of those. The table of targets has a row per source; Spark broadcasts
    it where its written size is under spark.sql.autoBroadcastJoinThreshold and sorts otherwise.
    """
    start, end = weights or thirds_weight()
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    own = docs.columns
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(f"`{source}`").alias("source"), F.col(f"`{key}`").alias("key"), word_count(F.col(f"`{text}`")).alias("size"), digest.alias("digest"))
    base = base.withColumns({"bin": F.substring("digest", 1, BIN_DIGITS), "class": F.length(F.bin("size"))})
    sums = written(base.groupBy("source", "bin", "class").agg(F.sum("size").alias("words")), "mix-bins")  # rows: sources x bins x size classes at most
    targets = written(source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), start, end, max_repeats=max_repeats).withColumnRenamed("source", "t_source"), "mix-targets")
    same_source = F.col("source").eqNullSafe(F.col("t_source"))
    large = F.pow(F.lit(2.0), F.col("class") - 1) * LARGE_SHARE > F.col("target")
    bin_of = F.when(large, F.lit(LARGE_BIN)).otherwise(F.col("bin"))
    by_source = Window.partitionBy("b_source").orderBy("b_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.join(targets, same_source).groupBy(F.col("source").alias("b_source"), bin_of.alias("b_bin")).agg(F.sum("words").alias("words"))
    offsets = offsets.withColumn("bin_start", F.coalesce(F.sum("words").over(by_source), F.lit(0))).drop("words")
    in_bin = Window.partitionBy("source", "bin").orderBy("late", "digest", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.join(targets, same_source).withColumns({"bin": bin_of, "late": F.when(large, F.col("class")).otherwise(F.lit(0))}).withColumn("within", F.coalesce(F.sum("size").over(in_bin), F.lit(0)))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bin") == F.col("b_bin")))
    middle = F.col("bin_start") + F.col("within") + F.col("size") / 2
    passes = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("int")
    placed = placed.withColumns({"middle": middle, "passes": passes})
    extra = (F.col("middle") <= F.col("target") - F.col("passes") * F.col("source_size")) & (F.col("size") > 0)
    placed = placed.withColumn("copies", F.col("passes") + extra.cast("int"))
    share = lambda i: F.least(F.coalesce(F.try_divide(i * F.col("source_size") + F.col("middle"), F.col("target")), F.lit(0.0)), F.lit(1.0))
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda i: inverse_schedule(share(i), F.col("start"), F.col("end")))).otherwise(F.array().cast("array<double>"))
    mix = F.struct("size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), positions.alias("positions"))
    return placed.select("row", mix.alias("mix")).select(*[F.col("row").getField(c).alias(c) for c in own if c != "mix"], "mix")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The training order: a row per copy with the columns of docs, range-sorted by position."""
    own = docs.columns
    held = "mix" + "_" * max(map(len, own))  # longer than any name; an input column called mix is kept under it
    copies = plan_mix(docs.withColumnRenamed("mix", held), **options)
    copies = copies.select(F.struct(*[F.col(f"`{held if c == 'mix' else c}`").alias(c) for c in own]).alias("row"), F.explode("mix.positions").alias("position"))
    return copies.sort("position", F.xxhash64("row")).select(*[F.col("row").getField(c).alias(c) for c in own])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    found = planned.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", F.get("mix.positions", F.lit(0)).alias("position"))
    return found.sort(F.col("position").asc_nulls_last(), "doc_id")


OP3_SQL = r"""
WITH base AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sizes),
weighted AS (SELECT *, CAST(turn + 1 AS DOUBLE) AS weight, (turn + 1) * (1 - (turn - 1) * 0.5::DOUBLE) AS w_start, (turn + 1) * (1 + (turn - 1) * 0.5::DOUBLE) AS w_end,
    CAST(source_size * 3 AS DOUBLE) AS cap FROM ranked),
sums AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(weight) OVER () AS weights,
    coalesce(sum(cap) OVER b, 0.0) AS cap_before, coalesce(sum(weight) OVER b, 0.0) AS weight_before
    FROM weighted WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, cap * (weights - weight_before) <= weight * (total - cap_before) AS is_capped FROM sums),
targets AS (SELECT source, source_size, w_start, w_end, CASE WHEN is_capped THEN cap ELSE
    (total - coalesce(sum(CASE WHEN is_capped THEN cap END) OVER (), 0.0)) * weight / sum(CASE WHEN NOT is_capped THEN weight END) OVER () END AS target FROM capped),
placed AS (SELECT b.doc_id, b.size, t.source_size, t.target, t.w_start, t.w_end,
    coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY CASE WHEN pow(2.0, length(bin(b.size)) - 1) * 40 > t.target THEN length(bin(b.size)) ELSE 0 END, b.digest, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + b.size / 2 AS middle,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS INTEGER) ELSE 0 END AS passes
    FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
chosen AS (SELECT *, passes + CAST(middle <= target - passes * source_size AND size > 0 AS INTEGER) AS copies,
    (w_end - w_start) / (w_start + w_end) AS tilt, least(CASE WHEN target > 0 THEN middle / target ELSE 0 END, 1.0) AS share FROM placed)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
    CASE WHEN copies > 0 THEN CASE WHEN abs(tilt) < 1e-9 THEN share ELSE (sqrt(greatest((1 - tilt) * (1 - tilt) + 4 * tilt * share, 0.0)) - (1 - tilt)) / (2 * tilt) END END AS position
FROM chosen"""


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the copies of the mix in training order, with the columns of documents."""
    return mix(docs)
