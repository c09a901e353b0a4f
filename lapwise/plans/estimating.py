"""Queries of the estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwise.functions import exprs as X
from lapwise.operators import estimators as A
from lapwise.operators.joins import pairs
from lapwise.operators.windows import over
from lapwise.plans.registration import query, table
from lapwise.plans.testbed import E, O, panel_e, panel_o

CELL = ["grp", "compound"]


@query("a10_weighted_mean", "WITH m AS (SELECT l_returnflag, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS w_mean FROM lineitem GROUP BY 1) SELECT l_returnflag, any_value(w_mean) AS w_mean, sqrt(sum(l_quantity * (l_extendedprice - w_mean) ** 2) / sum(l_quantity)) AS w_std FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1", "w_mean w_std")
def a10(spark, d):
    return A.wstd(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")


CURVE = f"(SELECT *, avg(field_raw) OVER (PARTITION BY context ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS field_pace FROM (SELECT context, step, avg(value) FILTER (WHERE r BETWEEN 0.1 AND 0.9) AS field_raw, count(value) AS n FROM (SELECT *, percent_rank() OVER (PARTITION BY context, step ORDER BY value) AS r FROM {E}) GROUP BY context, step))"


@query("a11_field_curve", f"SELECT context, step, n, field_raw, field_pace FROM {CURVE}", "field_raw field_pace")
def a11(spark, d):
    return A.field_curve(panel_e(spark, d), ["context"], "step", "value")


@query("a12_two_level", "SELECT o_orderstatus, max(n) AS most, avg(n) AS mean FROM (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1", "mean")
def a12(spark, d):
    counts = table(spark, d, "orders").groupBy("o_orderstatus", "o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("o_orderstatus").agg(F.max("n").alias("most"), F.avg("n").alias("mean"))


@query("a13_global_stats", f"SELECT count(*) AS n, avg(value) AS mean, stddev_samp(value) / sqrt(count(*)) AS se, count(*) < 30 AS low_sample FROM {O}", "mean se")
def a13(spark, d):
    n = F.count(F.lit(1))
    return panel_o(spark, d).agg(n.alias("n"), F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(n)).alias("se"), (n < 30).alias("low_sample"))


@query("a14_share", f"SELECT entity, round(avg(CASE WHEN status = 'F' THEN 1.0 ELSE 0 END), 3) AS share FROM {O} GROUP BY entity", "share")
def a14(spark, d):
    return panel_o(spark, d).groupBy("entity").agg(F.round(F.avg((F.col("status") == "F").cast("double")), 3).alias("share"))


@query("a15_ols_slope", f"SELECT unit_id, CASE WHEN var_pop(pos) > 0 THEN least(regr_slope(value, pos), 2.0) END AS slope, count(*) AS n FROM {E} GROUP BY unit_id", "slope")
def a15(spark, d):
    return A.ols_slope(panel_e(spark, d), ["unit_id"], "pos", "value", cap=2.0)


@query("a16_trend_components", f"""WITH e AS (SELECT *, CAST(pos AS DOUBLE) AS cov FROM {E}), s AS (SELECT entity, context, least(coalesce(CASE WHEN var_pop(step) > 0 THEN regr_slope(value, step) END, 0), 0) AS b, avg(step) AS mt, avg(cov) AS mc, avg(value) AS my FROM e GROUP BY ALL),
f AS (SELECT e.*, s.mc, b * (step - mt) AS trend, value - my - b * (step - mt) AS lft FROM e JOIN s USING (entity, context)), g AS (SELECT entity, context, coalesce(CASE WHEN var_pop(cov) > 0 THEN regr_slope(lft, cov) END, 0) AS g FROM f GROUP BY ALL)
SELECT event_id, trend, g * (cov - mc) AS covariate_part, lft - g * (cov - mc) AS remainder FROM f JOIN g USING (entity, context)""", "trend covariate_part remainder")
def a16(spark, d):
    rows = panel_e(spark, d).withColumn("cov", F.col("pos").cast("double"))
    return A.trend_components(rows, ["entity", "context"], "step", "value", "cov").select("event_id", "trend", "covariate_part", "remainder")


@query("a17_global_slope", f"SELECT coalesce(covar_pop(value, x) / nullif(var_pop(x), 0), 0.5) AS slope, count(value) AS n FROM (SELECT value, lag(value, 1, 0.0) OVER (PARTITION BY unit_id ORDER BY step) AS x FROM {E})", "slope")
def a17(spark, d):
    rows = panel_e(spark, d).withColumn("x", F.lag("value", 1, 0.0).over(over(["unit_id"], ["step"])))
    return A.global_slope(rows, "value", "x", 0.5)


FE = f"""(SELECT grp, compound, count(*) AS n, count(DISTINCT unit_id) AS units, sum(dx * dx) AS sxx, sum(dx * dy) AS sxy, sum(dy * dy) AS syy FROM
(SELECT *, pos - avg(pos) OVER (PARTITION BY unit_id) AS dx, value - avg(value) OVER (PARTITION BY unit_id) AS dy FROM {E}) GROUP BY grp, compound)"""
FE_FIT = f"(SELECT grp, compound, n, units, sxy / sxx AS slope, greatest(sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - units - 1) / sxx), 0.001) AS se FROM {FE})"


@query("a18_fe_slope", f"SELECT grp, compound, n, units, slope, se, n >= 20 AND units >= 2 AS qualified FROM {FE_FIT}", "slope se")
def a18(spark, d):
    return A.fe_slope(panel_e(spark, d), ["unit_id"], CELL, "pos", "value")


@query("a19_fe_slope2", f"""WITH d AS (SELECT grp, compound, unit_id, pos - avg(pos) OVER u AS x, greatest(pos - 12, 0) - avg(greatest(pos - 12, 0)) OVER u AS z, value - avg(value) OVER u AS y FROM {E} WINDOW u AS (PARTITION BY unit_id)),
s AS (SELECT grp, compound, count(*) AS n, count(DISTINCT unit_id) AS units, sum(x*x) AS xx, sum(z*z) AS zz, sum(x*z) AS xz, sum(x*y) AS xy, sum(z*y) AS zy, sum(y*y) AS yy FROM d GROUP BY ALL),
b AS (SELECT *, xx*zz - xz*xz AS det, (xy*zz - zy*xz) / (xx*zz - xz*xz) AS bx, (zy*xx - xy*xz) / (xx*zz - xz*xz) AS bz FROM s)
SELECT grp, compound, n, units, bx AS slope_x, bz AS slope_z, greatest(sqrt(greatest(yy - bx*xy - bz*zy, 0) / (n - units - 2) * zz / det), 0.001) AS se_x, greatest(sqrt(greatest(yy - bx*xy - bz*zy, 0) / (n - units - 2) * xx / det), 0.001) AS se_z FROM b""", "slope_x slope_z se_x se_z")
def a19(spark, d):
    rows = panel_e(spark, d).withColumn("hinge", F.greatest(F.col("pos") - 12, F.lit(0)))
    return A.fe_slope2(rows, ["unit_id"], CELL, "pos", "hinge", "value")


@query("a20_deconfounded", f"""WITH d AS (SELECT compound, pos - avg(pos) OVER u AS x, step - avg(step) OVER u AS z, ln(1 + value) - avg(ln(1 + value)) OVER u AS y FROM {E} WINDOW u AS (PARTITION BY entity, context)),
s AS (SELECT compound, sum(x*x) AS xx, sum(z*z) AS zz, sum(x*z) AS xz, sum(x*y) AS xy, sum(z*y) AS zy, corr(x, z) AS r FROM d GROUP BY ALL)
SELECT compound, xy / xx AS plain, (xy*zz - zy*xz) / (xx*zz - xz*xz) AS controlled, r FROM s""", "plain controlled r")
def a20(spark, d):
    rows = panel_e(spark, d).withColumn("y", F.ln(1 + F.col("value")))
    unit = ["entity", "context"]
    plain = A.fe_slope(rows, unit, ["compound"], "pos", "y").select("compound", F.col("slope").alias("plain"))
    both = A.fe_slope2(rows, unit, ["compound"], "pos", "step", "y").select("compound", F.col("slope_x").alias("controlled"))
    moved = A.demean(rows, unit, ["pos", "step"]).groupBy("compound").agg(F.corr("d_pos", "d_step").alias("r"))
    return plain.join(both, "compound").join(moved, "compound")


@query("a21_a23_empirical_bayes", f"""WITH f AS {FE_FIT}, c AS (SELECT *, slope - sum(slope / (se*se)) OVER (PARTITION BY compound) / sum(1 / (se*se)) OVER (PARTITION BY compound) AS dev FROM f),
t AS (SELECT compound, greatest(coalesce((sum(dev*dev/(se*se)) - (count(*) - 1)) / nullif(sum(1/(se*se)) - sum(1/(se*se*se*se)) / sum(1/(se*se)), 0), 0), 0) AS tau2 FROM c GROUP BY compound)
SELECT grp, compound, dev, tau2, coalesce(tau2 / nullif(tau2 + se*se, 0), 0) * dev AS shrunk, sqrt(coalesce(tau2 / nullif(tau2 + se*se, 0), 0)) * se AS post_sd FROM c JOIN t USING (compound)""", "dev tau2 shrunk post_sd")
def a21(spark, d):
    fits = A.precision_center(A.fe_slope(panel_e(spark, d), ["unit_id"], CELL, "pos", "value"), ["compound"], "slope", "se")
    joined = fits.join(A.dl_tau2(fits, ["compound"], "dev", "se"), "compound")
    shrunk, sd = A.eb_shrink(F.col("dev"), F.col("se"), F.col("tau2"), F.col("qualified"))
    return joined.select("grp", "compound", "dev", "tau2", shrunk.alias("shrunk"), sd.alias("post_sd"))


@query("a24_onset_shift", f"WITH f AS {FE_FIT}, g AS (SELECT compound, median(se) AS sev, avg(units) AS depth FROM f GROUP BY compound) SELECT grp, compound, greatest(-3, least(-slope * depth / sev * 0.01, 3)) AS shift, abs(depth / sev) * se AS shift_se FROM f JOIN g USING (compound)", "shift shift_se")
def a24(spark, d):
    fits = A.fe_slope(panel_e(spark, d), ["unit_id"], CELL, "pos", "value").withColumn("small", F.col("slope") * 0.01)
    return A.onset_shift(fits, ["compound"], "small", "se", "se", "units").select("grp", "compound", "shift", "shift_se")


CELLS = f"(SELECT entity, priority, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM {O} GROUP BY ALL)"


@query("a25_a26_shrunk_means", f"""WITH c AS {CELLS}, p AS (SELECT entity, avg(value) AS prior FROM {O} GROUP BY 1), k AS (SELECT sum((n - 1) * v) / sum(n - 1) AS within, var_samp(m) AS between_var FROM c)
SELECT entity, priority, (n * m + 10 * prior) / (n + 10.0) AS shrunk, sqrt(1 / (n / within + 1 / between_var)) AS se FROM c JOIN p USING (entity), k""", "shrunk se")
def a25(spark, d):
    panel = panel_o(spark, d)
    cells = panel.groupBy("entity", "priority").agg(F.count("value").alias("n"), F.avg("value").alias("m"))
    prior = panel.groupBy("entity").agg(F.avg("value").alias("prior"))
    joined = cells.join(prior, "entity").crossJoin(F.broadcast(A.variance_components(panel, ["entity", "priority"], "value")))
    return joined.select("entity", "priority", X.bayes_shrink(F.col("n"), F.col("m"), F.col("prior"), 10).alias("shrunk"), F.sqrt(X.posterior_var(F.col("n"), F.col("within"), F.col("between"))).alias("se"))


@query("a27_group_effect", f"WITH m AS (SELECT context, grp, median(value) AS mid, stddev_samp(value) AS sd, count(*) AS n FROM {O} GROUP BY ALL HAVING count(*) >= 5) SELECT context, grp, n, mid - avg(mid) OVER (PARTITION BY context) AS effect, sd / sqrt(n) AS se, mid - avg(mid) OVER (PARTITION BY context) - 1.96 * sd / sqrt(n) AS lo, mid - avg(mid) OVER (PARTITION BY context) + 1.96 * sd / sqrt(n) AS hi FROM m", "effect se lo hi")
def a27(spark, d):
    return A.group_effect(panel_o(spark, d), ["context"], "grp", "value")


@query("a28_interaction", f"WITH c AS (SELECT period, grp, context, avg(value) AS m, count(*) AS n FROM {O} GROUP BY ALL), w AS (SELECT period, grp, avg(value) AS a FROM {O} GROUP BY ALL) SELECT period, grp, context, n, n * (m - a) / (n + 5.0) AS interaction FROM c JOIN w USING (period, grp)", "interaction")
def a28(spark, d):
    return A.interaction(panel_o(spark, d), "grp", "context", "period", "value")


RATED = f"(SELECT entity, period, avg(value) AS rating, stddev_samp(value) / sqrt(count(*)) AS se FROM {O} GROUP BY ALL)"


@query("a29_era_adjust", f"""WITH r AS {RATED}, a AS (SELECT entity, avg(rating) FILTER (WHERE period >= 1998) - avg(rating) FILTER (WHERE period < 1998) AS d FROM r GROUP BY entity HAVING count(*) FILTER (WHERE period < 1998) >= 2 AND count(*) FILTER (WHERE period >= 1998) >= 2),
o AS (SELECT avg(d) AS off, stddev_samp(d) / sqrt(count(*)) AS off_se FROM a) SELECT entity, period, CASE WHEN period >= 1998 THEN rating - off ELSE rating END AS adjusted, CASE WHEN period >= 1998 THEN sqrt(se*se + off_se*off_se) ELSE se END AS adjusted_se FROM r, o""", "adjusted adjusted_se")
def a29(spark, d):
    rated = panel_o(spark, d).groupBy("entity", "period").agg(F.avg("value").alias("rating"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("se"))
    return A.era_adjust(rated, "entity", "period", "rating", "se", boundary=1998, min_n=2).select("entity", "period", "adjusted", "adjusted_se")


@query("a30_a31_first_breach", f"WITH b AS (SELECT *, min(CASE WHEN value > 90 THEN pos END) OVER (PARTITION BY unit_id) AS b FROM {E}) SELECT unit_id, min(b) AS breach, coalesce(sum(CASE WHEN pos >= b THEN greatest(value - 50, 0) END), 0) AS overrun FROM b GROUP BY unit_id", "overrun")
def a30(spark, d):
    return A.first_breach(panel_e(spark, d).withColumn("cost", F.col("value") - 50), ["unit_id"], "pos", F.col("value") > 90, "cost")


@query("a32_leave_one_out", f"WITH m AS (SELECT entity, period, avg(value) AS v FROM {O} GROUP BY ALL) SELECT entity, period, (sum(v) OVER (PARTITION BY entity) - v) / nullif(count(v) OVER (PARTITION BY entity) - 1, 0) AS loo FROM m", "loo")
def a32(spark, d):
    means = panel_o(spark, d).groupBy("entity", "period").agg(F.avg("value").alias("v"))
    return A.loo_mean(means, ["entity"], "v").select("entity", "period", "loo")


@query("a33_two_step_collapse", f"WITH s AS (SELECT entity, context, unit, max(value) AS top, sum(value) AS total, min(value) AS low FROM {E} GROUP BY ALL) SELECT entity, context, max(top) AS top, sum(total) AS total, min(low) AS low, count(*) AS units FROM s GROUP BY ALL", "top total low")
def a33(spark, d):
    units = panel_e(spark, d).groupBy("entity", "context", "unit").agg(F.max("value").alias("top"), F.sum("value").alias("total"), F.min("value").alias("low"))
    return units.groupBy("entity", "context").agg(F.max("top").alias("top"), F.sum("total").alias("total"), F.min("low").alias("low"), F.count(F.lit(1)).alias("units"))


#: Fixed values of the approximation of the normal distribution function.
UPPER = "0.3989422804014327 * exp(-x * x / 2) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))"


def probs_sql(inflations: str = "1.0") -> str:
    """Pair probabilities as SQL, for each factor on the standard errors."""
    return f"""(WITH m AS (SELECT context, entity, avg(value) AS mu, stddev_samp(value) / sqrt(count(*)) AS se FROM {E} GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY context ORDER BY mu) AS place FROM m),
x AS (SELECT a.context, a.entity, a.place, b.place AS other, k, (b.mu - a.mu) / (k * sqrt(a.se*a.se + b.se*b.se)) AS x FROM r a JOIN r b ON a.context = b.context AND a.entity <> b.entity, (SELECT unnest([{inflations}])::DOUBLE AS k)), t AS (SELECT *, 1 / (1 + 0.2316419 * abs(x)) AS t FROM x)
SELECT context, entity, place, other, k, CASE WHEN x >= 0 THEN 1 - {UPPER} ELSE {UPPER} END AS p FROM t WHERE x IS NOT NULL)"""


PROBS = probs_sql()


def pair_probabilities(panel, inflations=(1.0,)):
    """Probability that each entity of a context has a smaller mean than each other one, for each factor k on the standard errors."""
    means = panel.groupBy("context", "entity").agg(F.avg("value").alias("mu"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("se"))
    ranked = means.withColumn("place", F.rank().over(over(["context"], ["mu"])))
    both = pairs(ranked, ["context"], "entity", ["mu", "se", "place"]).withColumn("k", F.explode(F.array(*map(F.lit, inflations))))
    gap = A.ratio(F.col("b_mu") - F.col("a_mu"), F.col("k") * F.sqrt(F.col("a_se") ** 2 + F.col("b_se") ** 2))
    return both.withColumn("p", X.normal_cdf(gap)).where("p IS NOT NULL").select("context", F.col("a_entity").alias("entity"), F.col("a_place").alias("place"), F.col("b_place").alias("other"), "k", "p")


@query("a34_a35_order_uncertainty", f"SELECT context, entity, sqrt(sum(p * (1 - p))) AS rank_sd, max(CASE WHEN other = place + 1 THEN p END) AS p_beats_next FROM {PROBS} GROUP BY ALL", "rank_sd p_beats_next")
def a34(spark, d):
    return A.order_uncertainty(pair_probabilities(panel_e(spark, d)), ["context"], "entity", "place", "other", "p")


@query("a43_component_means", "SELECT l_returnflag, l_linestatus, avg(coalesce(l_discount, 0)) AS discount, avg(coalesce(l_tax, 0)) AS tax, count(*) AS n FROM lineitem GROUP BY ALL", "discount tax")
def a43(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg(F.coalesce("l_discount", F.lit(0.0))).alias("discount"), F.avg(F.coalesce("l_tax", F.lit(0.0))).alias("tax"), F.count(F.lit(1)).alias("n"))


@query("a44_verdict_summary", f"WITH v AS (SELECT unit_id, CASE WHEN count(*) > 15 THEN 'long' ELSE 'short' END AS verdict, avg(value) - 50 AS cost FROM {E} GROUP BY unit_id) SELECT verdict, count(*) AS n, sum(greatest(cost, 0)) AS cost FROM v GROUP BY verdict", "cost")
def a44(spark, d):
    units = panel_e(spark, d).groupBy("unit_id").agg(F.when(F.count(F.lit(1)) > 15, "long").otherwise("short").alias("verdict"), (F.avg("value") - 50).alias("cost"))
    return units.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest("cost", F.lit(0.0))).alias("cost"))


@query("a45_confusion", f"WITH x AS (SELECT compound AS actual, CASE WHEN value > 66 THEN 'SOFT' WHEN value > 33 THEN 'MEDIUM' ELSE 'HARD' END AS predicted FROM {E}), c AS (SELECT unnest(['SOFT', 'MEDIUM', 'HARD', 'WET']) AS c), g AS (SELECT a.c AS actual, b.c AS predicted, (SELECT count(*) FROM x WHERE x.actual = a.c AND x.predicted = b.c) AS n FROM c a, c b) SELECT actual, predicted, n, n / nullif(sum(n) OVER (PARTITION BY actual), 0) AS share FROM g", "share")
def a45(spark, d):
    rows = panel_e(spark, d).select(F.col("compound").alias("actual"), F.when(F.col("value") > 66, "SOFT").when(F.col("value") > 33, "MEDIUM").otherwise("HARD").alias("predicted"))
    return A.confusion(rows, "predicted", "actual", ["SOFT", "MEDIUM", "HARD", "WET"])


@query("a46_coverage", f"SELECT compound, avg(CASE WHEN value BETWEEN m - 1.28 * s AND m + 1.28 * s THEN 1.0 ELSE 0 END) AS coverage, count(*) AS n FROM (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM {E} WINDOW w AS (PARTITION BY context)) GROUP BY compound", "coverage")
def a46(spark, d):
    w = over(["context"])
    rows = panel_e(spark, d).withColumns({"m": F.avg("value").over(w), "s": F.stddev_samp("value").over(w)})
    return A.coverage(rows.withColumns({"lo": F.col("m") - 1.28 * F.col("s"), "hi": F.col("m") + 1.28 * F.col("s")}), "value", "lo", "hi", ["compound"])
