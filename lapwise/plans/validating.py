"""Queries of the validation statistics: signal to noise, bootstrap, rank agreement, calibration, simulated finishing orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lapwise.functions import exprs as X
from lapwise.operators import estimators as A, joins as J, shaping as S
from lapwise.operators.windows import over
from lapwise.plans.estimating import PROBS, pair_probabilities, probs_sql
from lapwise.plans.registration import query
from lapwise.plans.testbed import E, O, panel_e, panel_o


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number above 0 and below 1 that depends on the keys and the seed alone, whatever the partitioning."""
    return (F.pmod(F.xxhash64(*[F.col(k) if isinstance(k, str) else k for k in keys], F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)


def normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal draw by Box and Muller from two hashed uniforms."""
    return F.sqrt(-2 * F.ln(uniform(seed, *keys))) * F.cos(2 * 3.141592653589793 * uniform(seed + 1, *keys))


def rank_distribution(df: DataFrame, scenario: Sequence[str], entity: str, mu: str, se: str, draws: int, *, seed: int = 7) -> DataFrame:
    """P(position) of each entity: draws of its value, ranked within each draw; counts, so rows stay entities x positions."""
    placed = finishes(df, scenario, entity, mu, se, draws, seed)
    return placed.groupBy(*scenario, entity, "position").agg((F.count(F.lit(1)) / draws).alias("p"))


def finishes(df: DataFrame, scenario: Sequence[str], entity: str, mu: str, se: str, draws: int, seed: int) -> DataFrame:
    """position of each entity in each draw."""
    drawn = df.select(*scenario, entity, mu, se, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_draw"))
    value = F.col(mu) + F.coalesce(F.col(se), F.lit(0.0)) * normal(seed, *scenario, entity, "_draw")
    return drawn.withColumn("_v", value).withColumn("position", F.row_number().over(over([*scenario, "_draw"], ["_v", entity])))


def finish_summary(df: DataFrame, scenario: Sequence[str], entity: str, mu: str, se: str, draws: int, *, seed: int = 7) -> DataFrame:
    """Expected position, its sd, P(win), P(podium) and P(beats next) of each entity; next: the entity after it by mu, null for the last."""
    order = over(scenario, [mu, entity])
    ranked = df.withColumn("_next", F.lead(entity).over(order))
    placed = finishes(df, scenario, entity, mu, se, draws, seed).select(*scenario, entity, "_draw", "position")
    whole = placed.groupBy(*scenario, entity).agg(F.avg("position").alias("expected"), F.stddev_pop("position").alias("sd"), F.avg((F.col("position") == 1).cast("double")).alias("p_win"), F.avg((F.col("position") <= 3).cast("double")).alias("p_podium"))
    rival = placed.select(*scenario, F.col(entity).alias("_next"), "_draw", F.col("position").alias("_rival"))
    pairs = placed.join(ranked.select(*scenario, entity, "_next").where("_next IS NOT NULL"), [*scenario, entity]).join(rival, [*scenario, "_next", "_draw"])
    beats = pairs.groupBy(*scenario, entity).agg(F.avg((F.col("position") < F.col("_rival")).cast("double")).alias("p_beats_next"))
    return whole.join(beats, [*scenario, entity], "left")


def bootstrap_mean_gap(df: DataFrame, unit: str, flag: str, error: str, draws: int, *, seed: int = 11) -> DataFrame:
    """One row: gap of the mean errors with the flag and without, and the 2.5 to 97.5 percentile of Poisson bootstraps."""
    drawn = df.select(unit, flag, error, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_draw"))
    u = uniform(seed, unit, "_draw")
    # Cumulative probabilities of a Poisson variable of mean 1.
    weight = sum(((u > p).cast("int") for p in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)), F.lit(0))
    means = drawn.withColumn("_w", weight).groupBy("_draw").agg((A.wmean(F.when(F.col(flag), F.col(error)), F.col("_w")) - A.wmean(F.when(~F.col(flag), F.col(error)), F.col("_w"))).alias("g"))
    ci = means.agg(F.percentile("g", 0.025).alias("lo"), F.percentile("g", 0.975).alias("hi"))
    gap = df.agg((F.avg(F.when(F.col(flag), F.col(error))) - F.avg(F.when(~F.col(flag), F.col(error)))).alias("gap"))
    return gap.crossJoin(ci)


def rank_agreement(df: DataFrame, by: Sequence[str], entity: str, a: str, b: str) -> DataFrame:
    """Spearman's rho (average ranks) and Kendall's tau-b of two scores per group of two rows or more."""
    average = lambda c: F.rank().over(over(by, [c])) + (F.count(F.lit(1)).over(over([*by, c])) - 1) / 2
    rho = df.withColumns({"_ra": average(a), "_rb": average(b)}).groupBy(*by).agg(F.corr("_ra", "_rb").alias("rho"), F.count(F.lit(1)).alias("n"))
    return rho.join(A.kendall_tau(df, by, a, b), list(by))


MEANS = f"(SELECT context, entity, avg(value) AS mu, stddev_samp(value) / sqrt(count(*)) AS se, count(*) AS n FROM {E} GROUP BY ALL)"


def means(panel: DataFrame) -> DataFrame:
    return panel.groupBy("context", "entity").agg(F.avg("value").alias("mu"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("se"), F.count(F.lit(1)).alias("n"))


@query("v01_signal_to_noise", f"""WITH p AS (SELECT a.grp, a.context, a.entity AS a_entity, b.entity AS b_entity, regr_slope(a.value - b.value, a.step) AS slope, count(*) AS n FROM {E} a JOIN {E} b ON a.grp = b.grp AND a.context = b.context AND a.step = b.step AND a.entity < b.entity GROUP BY ALL HAVING count(*) > 2)
SELECT grp, sum(n * slope) / sum(n) AS mean, count(*) AS pairs, stddev_samp(slope) AS noise, abs(sum(n * slope) / sum(n)) / stddev_samp(slope) AS snr FROM p GROUP BY grp""", "mean noise snr")
def v01(spark, d):
    rows = J.pairs(panel_e(spark, d), ["grp", "context", "step"], "entity", ["value"], ordered=False).withColumn("gap", F.col("a_value") - F.col("b_value"))
    slopes = A.ols_slope(rows, ["grp", "context", "a_entity", "b_entity"], "step", "gap").where("n > 2")
    mean = A.wmean(F.col("slope"), F.col("n"))
    return slopes.groupBy("grp").agg(mean.alias("mean"), F.count(F.lit(1)).alias("pairs"), F.stddev_samp("slope").alias("noise"), A.ratio(F.abs(mean), F.stddev_samp("slope")).alias("snr"))


def transfer(panel: DataFrame) -> DataFrame:
    """Absolute change of each entity's mean to the next period; moved: its group's mean fell."""
    years = panel.groupBy("entity", "grp", "period").agg(F.avg("value").alias("mu"))
    group = panel.groupBy("grp", "period").agg(F.avg("value").alias("g"))
    joined = J.next_period(years.join(group, ["grp", "period"]), ["entity"], "period", "mu").join(J.next_period(group, ["grp"], "period", "g").select("grp", "period", "next_g"), ["grp", "period"])
    return joined.select(X.key("entity", "period").alias("unit"), (F.col("next_g") < F.col("g")).alias("moved"), F.abs(F.col("next_mu") - F.col("mu")).alias("error"))


@query("v02_transfer_bootstrap")
def v02(spark, d):
    return bootstrap_mean_gap(transfer(panel_o(spark, d)), "unit", "moved", "error", 200)


@query("v02_transfer_gap", f"""WITH y AS (SELECT entity, grp, period, avg(value) AS mu FROM {O} GROUP BY ALL), g AS (SELECT grp, period, avg(value) AS g FROM {O} GROUP BY ALL)
SELECT h.g < g.g AS moved, avg(abs(z.mu - y.mu)) AS mae, count(*) AS n FROM y JOIN y z ON z.entity = y.entity AND z.period = y.period + 1 JOIN g ON g.grp = y.grp AND g.period = y.period JOIN g h ON h.grp = y.grp AND h.period = y.period + 1 GROUP BY 1""", "mae")
def v02_gap(spark, d):
    return transfer(panel_o(spark, d)).groupBy("moved").agg(F.avg("error").alias("mae"), F.count(F.lit(1)).alias("n"))


@query("v03_order_backtest", f"""WITH m AS (SELECT context, entity, avg(value) AS b, (sum(avg(value)) OVER w - avg(value)) / nullif(count(*) OVER w - 1, 0) AS a FROM {E} GROUP BY context, entity WINDOW w AS (PARTITION BY entity)),
r AS (SELECT *, rank() OVER (PARTITION BY context ORDER BY a) + (count(*) OVER (PARTITION BY context, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY context ORDER BY b) + (count(*) OVER (PARTITION BY context, b) - 1) / 2 AS rb FROM m WHERE a IS NOT NULL),
t AS (SELECT x.context, sum(sign(x.a - y.a) * sign(x.b - y.b)) / sqrt(sum(abs(sign(x.a - y.a))) * sum(abs(sign(x.b - y.b)))) AS tau FROM r x JOIN r y ON x.context = y.context AND x.entity < y.entity GROUP BY 1)
SELECT context, corr(ra, rb) AS rho, count(*) AS n, any_value(tau) AS tau FROM r JOIN t USING (context) GROUP BY context""", "rho tau")
def v03(spark, d):
    return rank_agreement(loo_scores(panel_e(spark, d)), ["context"], "entity", "a", "b")


def loo_scores(panel: DataFrame) -> DataFrame:
    """b, each entity's mean in a context, and a, its mean over its other contexts."""
    scored = panel.groupBy("context", "entity").agg(F.avg("value").alias("b"))
    return A.loo_mean(scored, ["entity"], "b", out="a").where("a IS NOT NULL")


@query("v03_top_three", f"""WITH m AS (SELECT context, entity, avg(value) AS b, (sum(avg(value)) OVER w - avg(value)) / nullif(count(*) OVER w - 1, 0) AS a FROM {E} GROUP BY context, entity WINDOW w AS (PARTITION BY entity)),
r AS (SELECT *, count(*) OVER (PARTITION BY context) AS n, row_number() OVER (PARTITION BY context ORDER BY a DESC, entity) AS ra, row_number() OVER (PARTITION BY context ORDER BY b DESC, entity) AS rb FROM m WHERE a IS NOT NULL)
SELECT context, sum(CASE WHEN ra <= 3 AND rb <= 3 THEN 1 ELSE 0 END) / 3.0 AS hit, any_value(n) AS n FROM r WHERE n >= 6 GROUP BY context""", "hit")
def v03_top(spark, d):
    scored = loo_scores(panel_e(spark, d))
    sizes = scored.groupBy("context").agg(F.count(F.lit(1)).alias("n")).where("n >= 6")
    return S.topk_overlap(scored, ["context"], "entity", "a", "b", 3).withColumnRenamed("overlap", "hit").join(sizes, "context")


@query("v03_gap_bootstrap")
def v03_gap(spark, d):
    """One row: by how much the leave-one-out order agrees better than the order of entity numbers, with a bootstrap interval over contexts."""
    scored = loo_scores(panel_e(spark, d)).withColumn("plain", F.col("entity").cast("double"))
    rho = [rank_agreement(scored, ["context"], "entity", c, "b").where("n >= 6").select("context", F.lit(c == "a").alias("structural"), "rho") for c in ("a", "plain")]
    return bootstrap_mean_gap(rho[0].unionByName(rho[1]), "context", "structural", "rho", 2000)


@query("v04_calibration", f"""WITH p AS (SELECT p, CASE WHEN place < other THEN 1.0 ELSE 0.0 END AS won FROM {PROBS}) SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, avg(p) AS predicted, avg(won) AS observed, avg((p - won) ** 2) AS brier FROM p GROUP BY 1""", "predicted observed brier")
def v04(spark, d):
    rows = pair_probabilities(panel_e(spark, d)).withColumn("won", (F.col("place") < F.col("other")).cast("double"))
    return rows.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("predicted"), F.avg("won").alias("observed"), F.avg((F.col("p") - F.col("won")) ** 2).alias("brier"))


@query("v04_calibration_slope", f"WITH p AS (SELECT p, CASE WHEN place < other THEN 1.0 ELSE 0.0 END AS won FROM {PROBS}) SELECT regr_slope(won, p) AS slope, regr_intercept(won, p) AS intercept, avg((p - won) ** 2) AS brier FROM p", "slope intercept brier")
def v04_slope(spark, d):
    rows = pair_probabilities(panel_e(spark, d)).withColumn("won", (F.col("place") < F.col("other")).cast("double"))
    return rows.agg(F.regr_slope("won", "p").alias("slope"), F.regr_intercept("won", "p").alias("intercept"), F.avg((F.col("p") - F.col("won")) ** 2).alias("brier"))


INFLATIONS = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0)


@query("v04_inflation_grid", f"WITH b AS (SELECT k, avg((p - CASE WHEN place < other THEN 1.0 ELSE 0.0 END) ** 2) AS brier, count(*) AS n FROM {probs_sql(', '.join(map(str, INFLATIONS)))} GROUP BY k) SELECT *, k = (SELECT arg_min(k, brier) FROM b) AS best FROM b", "brier")
def v04_grid(spark, d):
    """Brier score of the pair probabilities for each factor on the standard errors; best: the factor of the least."""
    rows = pair_probabilities(panel_e(spark, d), INFLATIONS).withColumn("won", (F.col("place") < F.col("other")).cast("double"))
    scores = rows.groupBy("k").agg(F.avg((F.col("p") - F.col("won")) ** 2).alias("brier"), F.count(F.lit(1)).alias("n"))
    return scores.withColumn("best", F.col("k") == F.min_by("k", "brier").over(over([])))  # a row per factor


@query("v05_rank_distribution")
def v05(spark, d):
    return rank_distribution(means(panel_e(spark, d)), ["context"], "entity", "mu", "se", 200)


@query("v05_finish_summary")
def v05_summary(spark, d):
    return finish_summary(means(panel_e(spark, d)), ["context"], "entity", "mu", "se", 5000)


@query("v06_case_study", f"SELECT context, sum(CASE WHEN entity = 3 THEN value END) AS a_total, sum(CASE WHEN entity = 7 THEN value END) AS b_total, count(*) FILTER (WHERE entity = 3) AS a_n, count(*) FILTER (WHERE entity = 7) AS b_n FROM {E} WHERE entity IN (3, 7) AND step BETWEEN 1 AND 30 GROUP BY context", "a_total b_total")
def v06(spark, d):
    rows = panel_e(spark, d).where(F.col("entity").isin(3, 7) & F.col("step").between(1, 30))
    of = lambda e: F.when(F.col("entity") == e, F.col("value"))
    return rows.groupBy("context").agg(F.sum(of(3)).alias("a_total"), F.sum(of(7)).alias("b_total"), F.count_if(F.col("entity") == 3).alias("a_n"), F.count_if(F.col("entity") == 7).alias("b_n"))
