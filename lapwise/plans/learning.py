"""Queries of model preparation, evaluation and training."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from lapwise.operators import estimators as A, mlprep as M, windows as W
from lapwise.plans.registration import query
from lapwise.plans.testbed import E, O, panel_e, panel_o
from lapwise.sources.scratch import settled

FEATURES = ["pos", "load", "code", "grp"]
SPEC = M.FeatureSpec({"state": ["pos", "load"], "who": ["code", "grp"]}, leaky=frozenset({"next_jump", "remaining", "bucket"}), masks={"remaining": []})


def frame(panel: DataFrame) -> DataFrame:
    """Causal features and targets of panel E; split by week."""
    rows = W.event_bucket(W.forward_targets(M.remaining_life(panel, ["unit_id"], "pos"), ["unit_id"], ["step"], "value"), ["unit_id"], ["step"], "value", 60)
    rows = rows.withColumn("load", W.ew_load(F.col("value"), ["unit_id"], ["step"], [0.5, 0.3, 0.2]))
    rows = M.period_split(rows, "context")
    encoder = M.fit_encoder(rows.where("split = 'train'"), "compound")
    return M.encode_frame(M.encode(rows, encoder, "compound", "code"), ["load"])


#: Rows of one task of a fit, which holds several copies of them as objects.
FIT_ROWS, LEAST_PARTS = 200_000, 8


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows written once, for several fits, and dealt by hash to tasks of about FIT_ROWS, in order of the key.

    Spark's trees cache a task's rows whole, and draw the rows for their splits by task: so its size is bounded here, and
    its content does not depend on how the rows were made.
    """
    kept = settled(rows, "fit-rows")
    return kept.repartition(max(LEAST_PARTS, -(-kept.count() // FIT_ROWS)), key).sortWithinPartitions(key)


def fitted(model, train: DataFrame):
    """The model fitted to rows that are held while the fit reads them again and again."""
    held = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return model.fit(held)
    finally:
        held.unpersist()


@query("ml01_split", f"SELECT CASE WHEN period = (SELECT max(period) FROM {O}) THEN 'holdout' ELSE 'train' END AS split, count(*) AS n FROM {O} GROUP BY 1")
def ml01(spark, d):
    return M.period_split(panel_o(spark, d), "period").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("ml02_remaining_life", f"SELECT event_id, max(pos) OVER (PARTITION BY unit_id) - pos AS remaining FROM {E}")
def ml02(spark, d):
    return M.remaining_life(panel_e(spark, d), ["unit_id"], "pos").select("event_id", "remaining")


@query("ml03_ml04_encoding", f"WITH t AS (SELECT DISTINCT priority FROM {O} WHERE period < 1996 AND priority <> '5-LOW'), c AS (SELECT priority, row_number() OVER (ORDER BY priority) - 1 AS code FROM t) SELECT o_orderkey, CAST(coalesce(code, -1) AS INTEGER) AS code, CAST(CAST(value > 100 AS INTEGER) AS FLOAT) AS big FROM {O} LEFT JOIN c USING (priority)")
def ml03(spark, d):
    panel = panel_o(spark, d)
    encoder = M.fit_encoder(panel.where("period < 1996 AND priority <> '5-LOW'"), "priority")
    return M.encode_frame(M.encode(panel, encoder, "priority", "code").withColumn("big", F.col("value") > 100), ["big"]).select("o_orderkey", F.col("code").cast("int").alias("code"), "big")


@query("ml06_fingerprint")
def ml06(spark, d):
    return M.fingerprint(panel_o(spark, d).select("o_orderkey", "entity", "period"))


@query("ml07_folds", f"WITH p AS (SELECT DISTINCT period FROM {O}), r AS (SELECT period, row_number() OVER (ORDER BY period) AS r, count(*) OVER () AS m FROM p), f AS (SELECT period AS v, r - m + 3 AS fold FROM r WHERE r > m - 3) SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN period = v THEN 'valid' ELSE 'train' END AS role, count(*) AS n FROM {O} JOIN f ON period <= v GROUP BY 1, 2")
def ml07(spark, d):
    return M.period_folds(panel_o(spark, d), "period", 3).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query("ml08_class_weights", f"SELECT priority, count(*) AS n, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM {O} GROUP BY priority", "weight")
def ml08(spark, d):
    return M.class_weights(panel_o(spark, d), "priority")


SCORED = f"(SELECT *, avg(value) OVER (PARTITION BY entity) AS p FROM {O})"


@query("ml09_metrics", f"SELECT grp, sqrt(avg((value - p) ** 2)) AS rmse, avg(abs(value - p)) AS mae, avg(greatest(0.9 * (value - p), -0.1 * (value - p))) AS pinball, count(*) AS n FROM {SCORED} GROUP BY grp", "rmse mae pinball")
def ml09(spark, d):
    rows = panel_o(spark, d).withColumn("p", F.avg("value").over(W.over(["entity"])))
    return M.regression_metrics(rows, "value", "p", 0.9, ["grp"])


@query("ml09_macro_f1", f"WITH x AS (SELECT compound AS y, CASE WHEN value > 66 THEN 'SOFT' WHEN value > 33 THEN 'MEDIUM' ELSE 'HARD' END AS p FROM {E}), c AS (SELECT unnest(['SOFT', 'MEDIUM', 'HARD']) AS c) SELECT avg(2.0 * (SELECT count(*) FROM x WHERE y = c AND p = c) / ((SELECT count(*) FROM x WHERE y = c) + (SELECT count(*) FROM x WHERE p = c))) AS macro_f1 FROM c", "macro_f1")
def ml09_f1(spark, d):
    rows = panel_e(spark, d).select(F.col("compound").alias("y"), F.when(F.col("value") > 66, "SOFT").when(F.col("value") > 33, "MEDIUM").otherwise("HARD").alias("p"))
    return M.macro_f1(rows, "y", "p")


@query("ml10_cell_baseline", f"WITH t AS (SELECT * FROM {O} WHERE period < 2000), c AS (SELECT entity, priority, avg(value) AS c FROM t WHERE entity > 3 GROUP BY ALL), k AS (SELECT priority, avg(value) AS k FROM t WHERE entity > 3 GROUP BY 1), w AS (SELECT avg(value) AS w FROM t WHERE entity > 3) SELECT o_orderkey, coalesce(c, k, w) AS baseline FROM (SELECT * FROM {O} WHERE period >= 2000) o LEFT JOIN c USING (entity, priority) LEFT JOIN k USING (priority), w", "baseline")
def ml10(spark, d):
    panel = panel_o(spark, d)
    return M.cell_baseline(panel.where("period < 2000 AND entity > 3"), panel.where("period >= 2000"), ["entity", "priority"], "priority", "value").select("o_orderkey", "baseline")


@query("ml11_cohort_metrics", f"WITH s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY context) >= 185 THEN context ELSE '_other' END AS cohort FROM {SCORED}), a AS (SELECT sqrt(avg((value - p) ** 2)) AS r FROM s) SELECT cohort, sqrt(avg((value - p) ** 2)) AS rmse, avg(abs(value - p)) AS mae, avg(greatest(0.5 * (value - p), -0.5 * (value - p))) AS pinball, count(*) AS n, sqrt(avg((value - p) ** 2)) > any_value(r) AS under FROM s, a GROUP BY cohort", "rmse mae pinball")
def ml11(spark, d):
    rows = panel_o(spark, d).withColumn("p", F.avg("value").over(W.over(["entity"])))
    return M.cohort_metrics(rows, "context", "value", "p", least=185)


@query("ml12_conformal")
def ml12(spark, d):
    w = W.over(["entity"])
    rows = panel_o(spark, d).withColumns({"m": F.avg("value").over(w), "s": F.stddev_samp("value").over(w)})
    return M.conformal(rows.withColumns({"lo": F.col("m") - F.col("s") / 2, "hi": F.col("m") + F.col("s") / 2}), "value", "lo", "hi", "o_orderkey")


@query("ml14_ordered_quantiles", f"SELECT event_id, list_sort([value, 50.0, CAST(pos AS DOUBLE)])[1] AS p10, list_sort([value, 50.0, CAST(pos AS DOUBLE)])[2] AS p50, list_sort([value, 50.0, CAST(pos AS DOUBLE)])[3] AS p90, NOT (value <= 50.0 AND 50.0 <= pos) AS crossed FROM {E} WHERE value IS NOT NULL", "p10 p50 p90")
def ml14(spark, d):
    rows = panel_e(spark, d).where("value IS NOT NULL").select("event_id", F.col("value").alias("p10"), F.lit(50.0).alias("p50"), F.col("pos").cast("double").alias("p90"))
    return M.ordered_quantiles(rows, ["p10", "p50", "p90"])


def assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(rows)


@query("ml13_m43_predictions")
def ml13(spark, d):
    """Remaining life by boosted trees, the bucket by a forest, an interval from residual quantiles, on the pinned schema."""
    built = dealt(frame(panel_e(spark, d)), "event_id")
    rows = assembled(built, SPEC.features(built, "remaining"))
    train = rows.where("split = 'train' AND next_jump IS NOT NULL AND bucket IS NOT NULL")
    life = fitted(GBTRegressor(labelCol="remaining", maxIter=8, maxDepth=3, seed=1), train.select("remaining", "features"))
    jump = fitted(GBTRegressor(labelCol="next_jump", predictionCol="p50", lossType="absolute", maxIter=8, maxDepth=3, seed=1), train.select("next_jump", "features"))
    classes = M.fit_encoder(train, "bucket")
    kinds = classes.withColumnRenamed("value", "bucket").join(M.class_weights(train, "bucket").select("bucket", "weight"), "bucket").withColumnRenamed("code", "label")
    labelled = train.join(F.broadcast(kinds), "bucket").select("label", "weight", "features")  # a row per bucket: the rows stay where they were dealt
    forest = fitted(RandomForestClassifier(labelCol="label", weightCol="weight", probabilityCol="probability", predictionCol="class", rawPredictionCol="raw", numTrees=10, maxDepth=4, seed=1), labelled)
    scored = jump.transform(life.transform(rows).withColumnRenamed("prediction", "life"))
    errors = scored.where("split = 'train' AND next_jump IS NOT NULL").withColumn("e", F.col("next_jump") - F.col("p50")).groupBy("compound").agg(F.percentile("e", 0.1).alias("e10"), F.percentile("e", 0.9).alias("e90"))
    scored = forest.transform(scored).withColumn("best", F.array_position(vector_to_array("probability"), F.array_max(vector_to_array("probability"))) - 1)
    named = scored.join(errors, "compound", "left").join(classes.select(F.col("code").cast("long").alias("best"), F.col("value").alias("guess")), "best", "left")
    out = M.ordered_quantiles(named.withColumns({"p10": F.col("p50") + F.col("e10"), "p90": F.col("p50") + F.col("e90")}), ["p10", "p50", "p90"], floor=0.0)
    out = out.select(F.col("event_id").alias("row_id"), "unit_id", "entity", "grp", "context", "period", "step", "pos", "compound", "p10", "p50", "p90", F.greatest("life", F.lit(0.0)).alias("remaining"), F.col("guess").alias("bucket"), (F.col("split") == "holdout").alias("is_holdout"), F.coalesce(F.col("pos") > 1, F.lit(False)).alias("in_envelope"), F.lit("boosted-1").alias("model"))
    return M.enforce_schema(out)


def jump_error(train: DataFrame, test: DataFrame, features: list[str], variant: str, **options) -> tuple[DataFrame, object]:
    """Holdout metrics of a small boosted-tree model of the next jump, and the model."""
    model = fitted(GBTRegressor(labelCol="next_jump", seed=1, **{"maxIter": 4, "maxDepth": 3, **options}), assembled(train, features).select("next_jump", "features"))
    return M.regression_metrics(model.transform(assembled(test, features)), "next_jump", "prediction").withColumn("variant", F.lit(variant)), model


def jump_rows(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Training and holdout rows with a next jump, read by several fits."""
    rows = dealt(frame(panel_e(spark, d)).where("next_jump IS NOT NULL").select("event_id", "split", "next_jump", *FEATURES), "event_id")
    return rows.where("split = 'train'"), rows.where("split = 'holdout'")


@query("ml17_ml18_ablation")
def ml17(spark, d):
    """Holdout error with all features, without each group, and with each feature permuted inside hashed bins."""
    train, test = jump_rows(spark, d)
    out, whole = jump_error(train, test, FEATURES, "all")
    for group, columns in SPEC.groups.items():
        out = out.unionByName(jump_error(train, test, [f for f in FEATURES if f not in columns], f"without_{group}")[0])
    for f in FEATURES:
        found = whole.transform(assembled(M.permuted(test, f, "event_id"), FEATURES))
        out = out.unionByName(M.regression_metrics(found, "next_jump", "prediction").withColumn("variant", F.lit(f"permuted_{f}")))
    return out


@query("ml17_learning_curve")
def ml17_curve(spark, d):
    """Holdout error by the share of training rows, drawn by hash so that larger shares hold the smaller ones."""
    train, test = jump_rows(spark, d)
    place, out = F.pmod(F.xxhash64("event_id", F.lit(3)), F.lit(100)), None
    for share in (10, 25, 50, 100):
        found = jump_error(train.where(place < share), test, FEATURES, f"share_{share:03d}")[0]
        out = found if out is None else out.unionByName(found)
    return out


@query("ml15_flags", f"WITH t AS (SELECT *, context = (SELECT max(context) FROM {E}) AS is_holdout FROM {E}) SELECT event_id, is_holdout, coalesce(value BETWEEN (SELECT min(value) FROM t WHERE NOT is_holdout) AND (SELECT max(value) FROM t WHERE NOT is_holdout) AND step BETWEEN (SELECT min(step) FROM t WHERE NOT is_holdout) AND (SELECT max(step) FROM t WHERE NOT is_holdout), false) AS in_envelope FROM t")
def ml15(spark, d):
    rows = M.period_split(panel_e(spark, d), "context")
    flagged = M.envelope(rows, rows.where("split = 'train'"), ["value", "step"])
    return flagged.select("event_id", (F.col("split") == "holdout").alias("is_holdout"), "in_envelope")


@query("ml19_leakage_probe", f"SELECT context, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM {E} GROUP BY context", "share")
def ml19(spark, d):
    """Shares of the periods: the majority share that a probe of the period must beat to show a leak."""
    return M.shares(panel_e(spark, d), ["context"])


@query("ml19_leakage_model")
def ml19_model(spark, d):
    """One row: the share of held-out rows whose period a forest finds from the features, and the majority share it must not beat by much."""
    rows = assembled(dealt(frame(panel_e(spark, d)).where("next_jump IS NOT NULL").select("event_id", "context", *FEATURES), "event_id"), FEATURES)
    classes = M.fit_encoder(rows, "context")
    marked = M.encode(rows, F.broadcast(classes), "context", "label").withColumn("test", M.half("event_id"))
    forest = fitted(RandomForestClassifier(labelCol="label", numTrees=10, maxDepth=4, seed=1), marked.where("NOT test").select("label", "features"))
    found = forest.transform(marked.where("test")).select("label", (F.col("prediction") == F.col("label")).cast("double").alias("hit"))
    by_class = found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    total = by_class.agg(F.sum("n").alias("rows"), (F.sum("hits") / F.sum("n")).alias("accuracy"), (F.max("n") / F.sum("n")).alias("majority"))
    return total.withColumn("leaks", F.col("accuracy") > F.col("majority") + 0.1)


@query("ml20_response_sweep", f"WITH m AS (SELECT median(value) AS v FROM {E}) SELECT CAST(pos AS BIGINT) AS pos, 0.05 * pos + v / 100 AS response, coalesce(0.05 * pos + v / 100 >= lag(0.05 * pos + v / 100) OVER (ORDER BY pos), true) AS rising FROM m, range(1, 21) t(pos)", "response")
def ml20(spark, d):
    base = panel_e(spark, d).agg(F.median("value").alias("v"))
    grid = base.withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(20)))).withColumn("response", 0.05 * F.col("pos") + F.col("v") / 100)
    return grid.select(F.col("pos").cast("long").alias("pos"), "response", F.coalesce(F.col("response") >= F.lag("response").over(W.over(["v"], ["pos"])), F.lit(True)).alias("rising"))


@query("ml20_fitted_response")
def ml20_fitted(spark, d):
    """The fitted model's answer along pos, the other features at their medians over the training rows; rising: not below the one before."""
    train, test = jump_rows(spark, d)
    model = jump_error(train, test, FEATURES, "all")[1]
    others = {f: A.exact_quantile(train, f, 0.5) for f in FEATURES if f != "pos"}
    grid = spark.range(1, 21).select(F.col("id").alias("pos")).withColumns({f: F.lit(v).cast("double") for f, v in others.items()})
    found = model.transform(assembled(grid, FEATURES)).select("pos", F.col("prediction").alias("response"))
    return found.withColumn("rising", F.coalesce(F.col("response") >= F.lag("response").over(W.over([], ["pos"])), F.lit(True)))  # twenty rows


@query("ml21_biggest_misses", f"SELECT o_orderkey, abs(value - p) AS miss FROM {SCORED} WHERE abs(value - p) > 100 ORDER BY miss DESC, o_orderkey LIMIT 100", "miss")
def ml21(spark, d):
    rows = panel_o(spark, d).withColumn("p", F.avg("value").over(W.over(["entity"]))).withColumn("miss", F.abs(F.col("value") - F.col("p")))
    return rows.where("miss > 100").orderBy(F.desc("miss"), "o_orderkey").limit(100).select("o_orderkey", "miss")


#: The grid of the search, on the parameters that the boosted trees have.
GRID = [{"maxDepth": depth, "stepSize": rate, "maxIter": trees, "subsamplingRate": part, "minInstancesPerNode": least} for depth, rate, trees, part, least in ((2, 0.1, 4, 1.0, 1), (4, 0.1, 4, 1.0, 1), (3, 0.3, 4, 0.8, 1), (3, 0.1, 8, 0.8, 10), (4, 0.3, 8, 0.6, 10))]


@query("ml22_grid_search")
def ml22(spark, d):
    """Mean error of each parameter set over the last two weekly folds; best: the set of the least."""
    rows = dealt(frame(panel_e(spark, d)).where("next_jump IS NOT NULL").select("event_id", "context", "next_jump", *FEATURES), "event_id")
    folds, out = M.period_folds(rows, "context", 2), None
    for options in GRID:
        for fold in (1, 2):
            part = folds.where(F.col("fold") == fold)
            found = jump_error(part.where("role = 'train'"), part.where("role = 'valid'"), FEATURES, "", **options)[0].drop("variant").withColumns({k: F.lit(v) for k, v in options.items()})
            out = found if out is None else out.unionByName(found)
    means = out.groupBy(*GRID[0]).agg(F.avg("rmse").alias("rmse"), F.count(F.lit(1)).alias("folds"))
    return means.withColumn("best", F.rank().over(W.over([], ["rmse"])) == 1)  # a row per parameter set
