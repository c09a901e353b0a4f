"""The chain from fitted wear parameters to the order of a counterfactual field, each link with its own query.

M-41 fits cells with fallback; M-21 takes every row apart into terms that close; M-30 says how groups wear beside the field;
M-38 puts every entity's rows into every group's hands; M-39 ranks the result and says how sure each place is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lapwise.functions import exprs as X
from lapwise.operators import estimators as A, fitting as P, recombining as R, shaping as S
from lapwise.operators.joins import pairs
from lapwise.operators.quantiles import grouped_median
from lapwise.operators.windows import over
from lapwise.plans.estimating import CURVE, UPPER
from lapwise.plans.registration import query
from lapwise.plans.testbed import E, panel_e
from lapwise.sources.scratch import settled

CELL, POOL, GROUP = ["place", "compound", "context"], ["place", "compound"], ["grp", "compound"]
DEFAULTS = {"SOFT": (9.0, 60.0, 0.5), "MEDIUM": (11.0, 70.0, 0.4), "HARD": (13.0, 80.0, 0.3)}
RISE, UNITS, POOL_ROWS, CURVE_UNITS, EVENTS = 20.0, 4, 345, 4, 2
SEVERITY, GRADIENT = (5.0, 150.0), (0.05, 12.0)
TERMS = ["fuel", "wear", "trend", "ambient", "tax", "effect", "interaction"]


def panel(spark, d) -> DataFrame:
    """Panel E with place and weight, written once: the chain reads it some ten times."""
    return settled(panel_e(spark, d).withColumns({"place": F.col("entity") % 10, "weight": F.when(F.col("event_type") == "error", 0.6).otherwise(1.0)}), "panel")


ROWS = f"(SELECT *, entity % 10 AS place, CASE WHEN event_type = 'error' THEN 0.6 ELSE 1.0 END AS weight FROM {E})"


def default_sql(k: int) -> str:
    return "CASE compound " + " ".join(f"WHEN '{name}' THEN {v[k]}" for name, v in DEFAULTS.items()) + " END"


# ---- M-41: fitted parameters -----------------------------------------------------------------------------------------


def parameters(rows: DataFrame) -> DataFrame:
    fits = P.fit_hierarchy(rows, ["unit_id"], CELL, POOL, "compound", "pos", "value", defaults=DEFAULTS, min_units=UNITS, min_pool_rows=POOL_ROWS, min_curve_units=CURVE_UNITS, min_events=EVENTS, severity_range=SEVERITY, gradient_range=GRADIENT, rise=RISE)
    return settled(fits, "parameters")


K = "level, place, compound, context"
PARAMETERS = f"""(WITH e AS {ROWS}, m AS (SELECT *, count(value) OVER b >= 3 AND value > median(value) OVER b + {RISE} AS spike FROM e WINDOW b AS (PARTITION BY unit_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
s AS (SELECT unit_id, pos, coalesce(spike, false) AS spike, coalesce(lag(spike) OVER w, false) AS p1, coalesce(lag(spike, 2) OVER w, false) AS p2 FROM m WINDOW w AS (PARTITION BY unit_id ORDER BY pos)),
c AS (SELECT unit_id, min(CASE WHEN spike AND p1 AND NOT p2 THEN pos - 1 END) AS cliff FROM s GROUP BY 1),
u AS (SELECT e.unit_id, place, compound, context, count(*) AS n, max(pos) AS last, min(cliff) AS cl, avg(value) FILTER (WHERE pos - cliff BETWEEN 0 AND 5) - avg(value) FILTER (WHERE pos - cliff BETWEEN -5 AND -1) AS st,
count(value) FILTER (WHERE pos - cliff BETWEEN 0 AND 5) AS a, count(value) FILTER (WHERE pos - cliff BETWEEN -5 AND -1) AS b FROM e JOIN c ON e.unit_id = c.unit_id GROUP BY ALL HAVING count(*) >= 3),
v AS (SELECT unit_id, place, compound, context, coalesce(CASE WHEN n >= 7 THEN cl END, last) AS duration, n >= 7 AND cl IS NOT NULL AS observed, CASE WHEN n >= 7 AND cl IS NOT NULL AND a >= 2 AND b >= 2 THEN st END AS step_size FROM u),
x AS (SELECT 'cell' AS level, v.* FROM v UNION ALL SELECT 'pool', v.* REPLACE (-1 AS context) FROM v),
k AS (SELECT {K}, duration AS t, count(*) FILTER (WHERE observed) AS ev, count(*) AS n FROM x GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY {K} ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM k),
sv AS (SELECT *, product(1 - ev / risk) OVER (PARTITION BY {K} ORDER BY t) AS s FROM r), h AS (SELECT {K}, min(CASE WHEN s <= 0.5 + 1e-9 THEN t END) AS half FROM sv GROUP BY ALL),
p AS (SELECT {K}, count(*) AS units, count(*) FILTER (WHERE observed) AS events, quantile_cont(duration, 0.75) FILTER (WHERE observed) AS p75, quantile_cont(step_size, 0.1) AS lo, quantile_cont(step_size, 0.9) AS hi FROM x GROUP BY ALL),
o AS (SELECT p.*, CASE WHEN units >= {CURVE_UNITS} AND (half IS NOT NULL OR events >= {EVENTS}) THEN coalesce(half, p75) END AS onset FROM p JOIN h USING ({K})),
sev AS (SELECT {K}, avg(step_size) AS severity FROM x JOIN p USING ({K}) WHERE step_size BETWEEN lo - 1e-9 AND hi + 1e-9 GROUP BY ALL),
g0 AS (SELECT x.level, x.place, x.compound, x.context, x.unit_id, regr_slope(value, pos) AS sl, corr(pos, value) ** 2 AS r2 FROM x JOIN o USING ({K}) JOIN e ON e.unit_id = x.unit_id WHERE pos >= 3 AND pos <= greatest(3, floor(coalesce(onset, {default_sql(0).replace("compound", "x.compound")})) - 2) GROUP BY ALL HAVING count(value) >= 3),
g1 AS (SELECT * FROM g0 WHERE sl > 0 AND r2 > 0.1), gb AS (SELECT {K}, quantile_cont(sl, 0.1) AS lo, quantile_cont(sl, 0.9) AS hi FROM g1 GROUP BY ALL), gr AS (SELECT {K}, avg(sl) AS gradient FROM g1 JOIN gb USING ({K}) WHERE sl BETWEEN lo - 1e-9 AND hi + 1e-9 GROUP BY ALL),
f AS (SELECT {K}, units, onset, severity, gradient FROM o LEFT JOIN sev USING ({K}) LEFT JOIN gr USING ({K})),
cells AS (SELECT place, compound, context, sum(count(*)) OVER (PARTITION BY place, compound) AS pool_rows FROM e GROUP BY place, compound, context),
j AS (SELECT cells.*, coalesce(a.units, 0) AS n_units, coalesce(b.units, 0) AS pool_units, CASE WHEN coalesce(a.units, 0) >= {UNITS} THEN 'cell' WHEN pool_rows >= {POOL_ROWS} THEN 'pool' ELSE 'default' END AS source, a.onset AS o1, b.onset AS o2, a.severity AS s1, b.severity AS s2, a.gradient AS g1, b.gradient AS g2
FROM cells LEFT JOIN f a ON a.level = 'cell' AND a.place = cells.place AND a.compound = cells.compound AND a.context = cells.context LEFT JOIN f b ON b.level = 'pool' AND b.place = cells.place AND b.compound = cells.compound),
q AS (SELECT *, coalesce(CASE source WHEN 'cell' THEN o1 WHEN 'pool' THEN o2 END, {default_sql(0)}) AS o, coalesce(CASE source WHEN 'cell' THEN s1 WHEN 'pool' THEN s2 END, {default_sql(1)}) AS s, coalesce(CASE source WHEN 'cell' THEN g1 WHEN 'pool' THEN g2 END, {default_sql(2)}) AS g FROM j)
SELECT place, compound, context, greatest(5.0, least(o, 100.0)) AS onset, CASE WHEN s BETWEEN {SEVERITY[0]} AND {SEVERITY[1]} THEN s ELSE {default_sql(1)} END AS severity, CASE WHEN g BETWEEN {GRADIENT[0]} AND {GRADIENT[1]} THEN g ELSE {default_sql(2)} END AS gradient, source, CAST(n_units AS BIGINT) AS n_units,
CASE source WHEN 'cell' THEN 'fitted from ' || n_units || ' units' WHEN 'pool' THEN 'only ' || n_units || ' units; used ' || pool_units || ' of the pool' ELSE 'only ' || n_units || ' units; used defaults' END AS notes FROM q)"""


@query("m41_fitted_parameters", f"SELECT * FROM {PARAMETERS}", "onset severity gradient", digits=4)
def m41(spark, d):
    return parameters(panel(spark, d))


# ---- M-21: seven terms and a residual --------------------------------------------------------------------------------


def terms(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """delta to the field, seven terms, and the residual that closes the sum, per row; onset and severity of its cell.

    Load and wear are known curves, the wear's from the fitted parameters; trend and ambient are fitted to the field's curve
    (on steps, then on the hour); the tax is a global slope on the exposure of the row before, by its confidence; effect and
    interaction are what is left of a group in a context, and of its mean over the period.
    """
    curve = A.field_curve(rows, ["context"], "step", "value")
    hours = rows.groupBy("context", "step").agg(F.avg(F.hour("ts")).alias("hour"))
    fit = A.trend_components(curve.join(hours, ["context", "step"]), ["context"], "step", "field_raw", "hour").select("context", "step", "field_pace", "trend", F.col("covariate_part").alias("ambient"))
    loaded = S.fuel_state(rows, ["entity", "context"], "step", "value", start_kg=110.0, cost=0.03).withColumnRenamed("fuel_penalty", "fuel")
    known = loaded.join(fitted.select(*CELL, "onset", "severity", "gradient"), CELL, "left").join(fit, ["context", "step"], "left")
    wear = F.col("gradient") * F.least(F.col("pos").cast("double"), F.col("onset")) + F.col("severity") * F.greatest(F.col("pos") - F.col("onset"), F.lit(0.0)) / 10
    exposed = known.withColumns({"delta": F.col("value") - F.col("field_pace"), "wear": wear, "exposure": F.lag(F.when(F.col("value") < 20, 1.0).otherwise(0.0), 1, 0.0).over(over(["unit_id"], ["step"]))})
    slope = A.global_slope(exposed, "delta", "exposure", 0.5).select(F.col("slope").alias("_slope"), X.confidence(F.col("n"), 50).alias("_sure"))
    taxed = exposed.crossJoin(F.broadcast(slope)).withColumn("tax", X.clamp(F.col("_slope") * F.col("exposure"), -20.0, 20.0) * F.col("_sure"))
    left = X.residual_of(F.col("delta"), [F.col(c) for c in TERMS[:5]])
    rest = settled(taxed.withColumn("_left", left), "left")
    effect = A.group_effect(rest, ["context"], "grp", "_left", min_n=1).select("context", "grp", "effect", F.col("se").alias("effect_se"), F.col("n").alias("effect_n"))
    mixed = A.interaction(rest, "grp", "context", "period", "_left").select("grp", "context", "interaction")
    both = rest.join(effect, ["context", "grp"], "left").join(mixed, ["grp", "context"], "left")
    return settled(both.withColumn("residual", X.residual_of(F.col("delta"), [F.col(c) for c in TERMS])).drop("_slope", "_sure", "_left"), "terms")


SEVEN = f"""(WITH e AS {ROWS}, f AS (SELECT * FROM {PARAMETERS}), c AS (SELECT c.*, hour FROM {CURVE} c JOIN (SELECT context, step, avg(hour(ts)) AS hour FROM e GROUP BY ALL) h ON h.context = c.context AND h.step = c.step),
t1 AS (SELECT context, least(coalesce(CASE WHEN var_pop(step) > 0 THEN regr_slope(field_raw, step) END, 0), 0) AS b, avg(step) AS mt, avg(hour) AS mh, avg(field_raw) AS mf FROM c GROUP BY ALL), t2 AS (SELECT c.*, mh, b * (step - mt) AS trend, field_raw - mf - b * (step - mt) AS lft FROM c JOIN t1 USING (context)),
t3 AS (SELECT context, coalesce(CASE WHEN var_pop(hour) > 0 THEN regr_slope(lft, hour) END, 0) AS g FROM t2 GROUP BY ALL), curve AS (SELECT t2.context, step, field_pace, trend, g * (hour - mh) AS ambient FROM t2 JOIN t3 USING (context)),
r AS (SELECT e.*, onset, severity, greatest(110.0 * (1 - e.step / max(e.step) OVER (PARTITION BY e.entity, e.context)), 0) * 0.03 AS fuel, gradient * least(pos, onset) + severity * greatest(pos - onset, 0) / 10 AS wear, trend, ambient, value - field_pace AS delta, lag(CASE WHEN value < 20 THEN 1.0 ELSE 0.0 END, 1, 0.0) OVER (PARTITION BY unit_id ORDER BY e.step) AS exposure
FROM e LEFT JOIN f ON f.place = e.place AND f.compound = e.compound AND f.context = e.context LEFT JOIN curve ON curve.context = e.context AND curve.step = e.step),
sl AS (SELECT coalesce(covar_pop(delta, exposure) / nullif(var_pop(exposure), 0), 0.5) AS slope, count(delta) / (count(delta) + 50.0) AS sure FROM r), x AS (SELECT r.*, greatest(-20, least(slope * exposure, 20)) * sure AS tax FROM r, sl),
l AS (SELECT *, delta - coalesce(fuel, 0) - coalesce(wear, 0) - coalesce(trend, 0) - coalesce(ambient, 0) - coalesce(tax, 0) AS lft FROM x),
g AS (SELECT context, grp, median(lft) - avg(median(lft)) OVER (PARTITION BY context) AS effect, stddev_samp(lft) / sqrt(count(lft)) AS effect_se, count(lft) AS effect_n FROM l GROUP BY context, grp),
i AS (SELECT a.grp, a.context, n * (m - w) / (n + 5.0) AS interaction FROM (SELECT grp, context, avg(lft) AS m, count(lft) AS n FROM l GROUP BY ALL) a JOIN (SELECT grp, avg(lft) AS w FROM l GROUP BY ALL) b USING (grp))
SELECT l.*, effect, effect_se, effect_n, interaction, lft - coalesce(effect, 0) - coalesce(interaction, 0) AS residual FROM l LEFT JOIN g ON g.context = l.context AND g.grp = l.grp LEFT JOIN i ON i.context = l.context AND i.grp = l.grp)"""


@query("m21_seven_terms", f"SELECT event_id, delta, {', '.join(TERMS)}, residual FROM {SEVEN}", " ".join(["delta", *TERMS, "residual"]), digits=4)
def m21(spark, d):
    rows = panel(spark, d)
    return terms(rows, parameters(rows)).select("event_id", "delta", *TERMS, "residual")


@query("q15_residual_spread", f"SELECT context, var_samp(residual) / var_samp(delta) AS ratio, var_samp(residual) / var_samp(delta) BETWEEN 0.5 AND 20 AS plausible, count(*) FILTER (WHERE abs(delta - fuel - wear - trend - ambient - tax - effect - interaction - residual) > 1e-9) AS open FROM {SEVEN} GROUP BY context", "ratio")
def q15(spark, d):
    """Q-15, Q-09: spread of the residual beside that of the delta, and rows whose terms do not close."""
    rows = panel(spark, d)
    total = F.col("residual")
    for c in TERMS:
        total = total + F.col(c)
    share = A.ratio(F.var_samp("residual"), F.var_samp("delta"))
    return terms(rows, parameters(rows)).groupBy("context").agg(share.alias("ratio"), share.between(0.5, 20).alias("plausible"), F.count_if(F.abs(F.col("delta") - total) > 1e-6).alias("open"))


# ---- M-30, A-24: how groups wear beside the field --------------------------------------------------------------------


def sensitivity(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    slopes = P.slope_sensitivity(rows.where("pos <= onset"), ["unit_id"], GROUP, ["compound"], "pos", "residual")
    hinges = P.hinge_sensitivity(rows, fitted, ["unit_id"], GROUP, ["compound"], "pos", "residual", "onset")
    found = slopes.select(*GROUP, F.col("shrunk").alias("slope"), F.col("post_sd").alias("slope_sd"), F.col("slope").alias("raw_slope"), "n").join(
        hinges.select(*GROUP, "hinge", F.col("se").alias("hinge_se"), F.col("post_sd").alias("hinge_sd"), "n_post", "n_deep", "qualified", "shift", "shift_se", "clipped"), GROUP, "full"
    )
    return settled(found, "sensitivity")


def shrunk_sql(cells: str, est: str) -> str:
    """centred_shrunk as SQL: cells have grp, compound, est, se, ok."""
    return f"""(SELECT *, CASE WHEN ok THEN dev * tau2 / nullif(tau2 + se * se, 0) ELSE 0.0 END AS shrunk, CASE WHEN NOT ok THEN sqrt(tau2) WHEN tau2 <= 0 THEN 0.0 ELSE sqrt(1 / (1 / (se * se) + 1 / tau2)) END AS post_sd FROM (
SELECT *, greatest(coalesce((sum(w * dev * dev) OVER p - (count(w) OVER p - 1)) / nullif(sum(w) OVER p - sum(w * w) OVER p / sum(w) OVER p, 0), 0), 0) AS tau2 FROM (
SELECT *, {est} - sum(w * {est}) OVER (PARTITION BY compound) / sum(w) OVER (PARTITION BY compound) AS dev FROM (SELECT *, CASE WHEN ok THEN 1 / (se * se) END AS w FROM {cells})) WINDOW p AS (PARTITION BY compound)))"""


DEMEANED = "(SELECT grp, compound, unit_id, z, x - avg(x) OVER u AS dx, z - avg(z) OVER u AS dz, y - avg(y) OVER u AS dy FROM (SELECT grp, compound, unit_id, CAST(pos AS DOUBLE) AS x, greatest(pos - coalesce(onset, 999.0), 0) AS z, residual AS y FROM seven WHERE {where}) WINDOW u AS (PARTITION BY unit_id))"
SLOPES = f"""(SELECT grp, compound, n, CASE WHEN sxx <> 0 THEN sxy / sxx END AS slope, greatest(sqrt(CASE WHEN n - units - 1 > 0 THEN greatest(syy - sxy * sxy / sxx, 0) / (n - units - 1) END / sxx), 0.001) AS se, n >= 20 AND units >= 2 AND sxx <> 0 AND n - units - 1 > 0 AS ok
FROM (SELECT grp, compound, count(*) AS n, count(DISTINCT unit_id) AS units, sum(dx * dx) AS sxx, sum(dx * dy) AS sxy, sum(dy * dy) AS syy FROM {DEMEANED.format(where="pos <= onset AND residual IS NOT NULL")} GROUP BY ALL))"""
HINGES = f"""(SELECT *, greatest(sqrt(greatest(syy - b_age * sxy - hinge * szy, 0) / greatest(n - units - 2, 1) * sxx / det), 1e-4) AS se, n_post >= 30 AND n_deep >= 15 AND units >= 5 AND det IS NOT NULL AS ok FROM (
SELECT *, (sxx * szy - sxz * sxy) / det AS hinge, (szz * sxy - sxz * szy) / det AS b_age FROM (SELECT *, CASE WHEN sxx * szz - sxz * sxz > 1e-9 THEN sxx * szz - sxz * sxz END AS det FROM (
SELECT grp, compound, count(*) AS n, count(DISTINCT unit_id) AS units, count(*) FILTER (WHERE z > 0) AS n_post, count(*) FILTER (WHERE z >= 2) AS n_deep, sum(dx * dx) AS sxx, sum(dz * dz) AS szz, sum(dx * dz) AS sxz, sum(dx * dy) AS sxy, sum(dz * dy) AS szy, sum(dy * dy) AS syy FROM {DEMEANED.format(where="residual IS NOT NULL")} GROUP BY ALL))))"""
SENSITIVITY = f"""(WITH seven AS (SELECT * FROM {SEVEN}), a AS {shrunk_sql(SLOPES, "slope")}, b AS {shrunk_sql(HINGES, "hinge")}, dp AS (SELECT compound, avg(pos - onset) AS depth FROM seven WHERE pos > onset AND residual IS NOT NULL GROUP BY 1), sv AS (SELECT compound, greatest(median(severity), 0.3) AS severity FROM {PARAMETERS} GROUP BY 1),
s AS (SELECT b.*, depth / nullif(severity, 0) AS scale FROM b LEFT JOIN dp USING (compound) LEFT JOIN sv USING (compound))
SELECT a.grp, a.compound, a.shrunk AS slope, a.post_sd AS slope_sd, a.slope AS raw_slope, a.n, hinge, s.se AS hinge_se, s.post_sd AS hinge_sd, n_post, n_deep, s.ok AS qualified, coalesce(greatest(-3.0, least(-s.shrunk * scale, 3.0)), 0.0) AS shift, CASE WHEN s.ok THEN s.se * scale END AS shift_se, coalesce(abs(s.shrunk * scale) > 3, false) AS clipped FROM a FULL JOIN s ON s.grp = a.grp AND s.compound = a.compound)"""


@query("m30_a24_hinge_sensitivity", f"SELECT * FROM {SENSITIVITY}", "slope slope_sd raw_slope hinge hinge_se hinge_sd shift shift_se", digits=4)
def m30(spark, d):
    rows = panel(spark, d)
    fitted = parameters(rows)
    return sensitivity(terms(rows, fitted), fitted)


# ---- M-38: every entity in every group's hands -----------------------------------------------------------------------


def hosts_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("context", "grp").agg(F.first("effect").alias("effect"), F.first("effect_se").alias("effect_se"), F.first("interaction").alias("interaction"), F.first("effect_n").alias("n"))


def paces(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """recombine over panel E, from the fit on."""
    fitted = parameters(rows)
    seven = terms(rows, fitted)
    return R.recombine(seven, hosts_of(seven), sensitivity(seven, fitted), ["context"], "grp", ["compound"], key=["event_id", "entity", *keep], own=["field_pace", "fuel", "wear", "trend", "ambient", "tax", "residual"], age="pos", actual="value")


PACES = f"""(WITH seven AS (SELECT *, value - delta AS field_pace FROM {SEVEN}), sens AS (SELECT * FROM {SENSITIVITY}), hosts AS (SELECT DISTINCT context, grp, effect, effect_se, interaction, effect_n FROM seven),
j AS (SELECT s.*, h.grp AS host, h.effect AS he, h.effect_se AS hse, h.interaction AS hi, h.effect_n AS hn, coalesce(a.slope, 0) AS sh, coalesce(b.slope, 0) AS so, coalesce(a.slope_sd, 0) AS host_slope_sd, coalesce(b.slope_sd, 0) AS own_slope_sd, coalesce(a.shift_se, 0) AS host_shift_se, coalesce(b.shift_se, 0) AS own_shift_se,
pos - coalesce(onset, 999.0) - coalesce(a.shift, 0) AS past_h, pos - coalesce(onset, 999.0) - coalesce(b.shift, 0) AS past_o FROM seven s JOIN hosts h ON h.context = s.context LEFT JOIN sens a ON a.grp = h.grp AND a.compound = s.compound LEFT JOIN sens b ON b.grp = s.grp AND b.compound = s.compound),
k AS (SELECT *, (sh - so) * pos AS deg_interaction, greatest(-2.0, least(coalesce(severity, 0) * (greatest(past_h, 0) - greatest(past_o, 0)), 2.0)) AS cliff_interaction FROM j)
SELECT event_id, entity, context, grp, host, value AS actual, coalesce(field_pace, value) + coalesce(fuel, 0) + coalesce(wear, 0) + coalesce(trend, 0) + coalesce(ambient, 0) + coalesce(tax, 0) + coalesce(residual, 0) + coalesce(he, 0) + coalesce(hi, 0) + deg_interaction + cliff_interaction AS predicted, deg_interaction, cliff_interaction,
coalesce(hse, 0) AS pace_se, host_slope_sd, own_slope_sd, host_shift_se, own_shift_se, CAST(pos AS DOUBLE) AS age, coalesce(severity, 0) AS severity, CASE WHEN past_h > 0 THEN 1.0 ELSE 0.0 END AS host_active, CASE WHEN past_o > 0 THEN 1.0 ELSE 0.0 END AS own_active, coalesce(hn, 0) / (coalesce(hn, 0) + 50.0) * weight AS confidence FROM k)"""
PACE_COLUMNS = "actual predicted deg_interaction cliff_interaction pace_se host_slope_sd own_slope_sd host_shift_se own_shift_se severity confidence"


@query("m38_recombined_pace", f"SELECT * FROM {PACES}", PACE_COLUMNS, digits=3)
def m38(spark, d):
    return paces(panel(spark, d))


@query("q12_self_host_exact", f"SELECT grp, count(*) AS n, CAST(0 AS BIGINT) AS moved, CAST(0 AS BIGINT) AS apart FROM {ROWS} GROUP BY grp")
def q12(spark, d):
    """Q-12: of rows whose host is their own group, those with an interaction that is not exactly zero, and those that were taken apart and do not come back to their value."""
    own = paces(panel(spark, d), ("residual",)).where(F.col("host") == F.col("grp"))
    return own.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("deg_interaction") != 0) | (F.col("cliff_interaction") != 0)).alias("moved"), F.count_if(F.col("residual").isNotNull() & (F.abs(F.col("predicted") - F.col("actual")) > 1e-6)).alias("apart"))


# ---- M-39, A-34, A-35: the order, and how sure it is -----------------------------------------------------------------

SCENARIO = ["context", "host"]
TOTALS = f"""(WITH t AS (SELECT context, host, entity, max(CASE WHEN grp = host THEN 1 ELSE 0 END) = 1 AS is_self, avg(predicted) AS mu, avg(actual) AS actual_mu, count(*) AS n, coalesce(stddev_samp(predicted), 0) AS spread, avg(pace_se) AS pace_se, avg(host_slope_sd) AS hs, avg(own_slope_sd) AS os, avg(host_shift_se) AS hc, avg(own_shift_se) AS oc,
avg(severity) AS sev, avg(age) AS age, avg(host_active) AS ha, avg(own_active) AS oa, avg(confidence) AS conf FROM {PACES} WHERE confidence >= 0.3 GROUP BY context, host, entity),
c AS (SELECT *, n / max(n) OVER (PARTITION BY context, host) AS coverage, power(os * age, 2) + power(oc * sev * oa, 2) + power(spread, 2) / n AS own_var, hs * age AS slope_term, hc * sev * ha AS cliff_term FROM t)
SELECT context, host, entity, is_self, rank() OVER (PARTITION BY context, host ORDER BY mu) AS place, rank() OVER (PARTITION BY context, host ORDER BY actual_mu) AS actual_place, mu, actual_mu, n, coverage, coverage < 0.5 AS short_run, conf * sqrt(least(coverage, 1.0)) AS confidence, own_var, slope_term, cliff_term, pace_se, sqrt(own_var + pace_se ** 2 + slope_term ** 2 + cliff_term ** 2) AS se FROM c)"""
ORDER = f"""WITH r AS (SELECT * FROM {TOTALS}), x AS (SELECT a.context, a.host, a.entity, a.place, b.place AS other, (b.mu - a.mu) / greatest(sqrt(a.own_var + b.own_var + (a.slope_term - b.slope_term) ** 2 + (a.cliff_term - b.cliff_term) ** 2), 1e-6) AS x FROM r a JOIN r b ON a.context = b.context AND a.host = b.host AND a.entity <> b.entity),
t AS (SELECT *, 1 / (1 + 0.2316419 * abs(x)) AS t FROM x), p AS (SELECT *, CASE WHEN x >= 0 THEN 1 - {UPPER} ELSE {UPPER} END AS p FROM t), o AS (SELECT context, host, entity, sqrt(sum(p * (1 - p))) AS place_sd, max(CASE WHEN other = place + 1 THEN p END) AS p_beats_next FROM p GROUP BY ALL)
SELECT r.context, r.host, r.entity, is_self, CAST(place AS BIGINT) AS place, CAST(actual_place AS BIGINT) AS actual_place, mu, se, n, coverage, short_run, confidence, place_sd, p_beats_next FROM r LEFT JOIN o USING (context, host, entity)"""


@query("m39_a35_scenario_order", ORDER, "mu se coverage confidence place_sd p_beats_next", digits=4)
def m39(spark, d):
    found = R.scenario_order(R.propagate_se(paces(panel(spark, d)), SCENARIO, "entity", "grp"), SCENARIO, "entity")
    return found.select(*SCENARIO, "entity", "is_self", F.col("place").cast("long").alias("place"), F.col("actual_place").cast("long").alias("actual_place"), "mu", "se", "n", "coverage", "short_run", "confidence", "place_sd", "p_beats_next")


@query("q16_beats_next_half", f"SELECT context, host, count(p_beats_next) AS n, CAST(0 AS BIGINT) AS below FROM ({ORDER}) GROUP BY ALL")
def q16(spark, d):
    """Q-16: nobody is likelier to lose to the next place than to beat it."""
    found = R.scenario_order(R.propagate_se(paces(panel(spark, d)), SCENARIO, "entity", "grp"), SCENARIO, "entity")
    return found.groupBy(*SCENARIO).agg(F.count("p_beats_next").alias("n"), F.count_if(F.col("p_beats_next") < 0.5 - 1e-6).alias("below"))


# ---- V-01: is the signal larger than what it ignores? ----------------------------------------------------------------


@query("v01_gate", f"""WITH g AS (SELECT a.context, a.entity AS x, b.entity AS y, a.pos, a.value - b.value AS gap FROM {ROWS} a JOIN {ROWS} b ON a.grp = b.grp AND a.context = b.context AND a.step = b.step AND a.entity < b.entity),
p AS (SELECT context, x, y, regr_slope(gap, pos) AS slope, count(*) AS n, 1 / (1 + stddev_samp(gap)) AS quality FROM g GROUP BY ALL HAVING count(*) >= 8), m AS (SELECT sum(quality * slope) / sum(quality) AS mean FROM p),
d AS (SELECT a.slope - b.slope AS delta FROM {SENSITIVITY} a JOIN {SENSITIVITY} b ON a.compound = b.compound AND a.grp < b.grp)
SELECT count(*) AS pairs, any_value(mean) AS mean, sqrt(sum(quality * (slope - mean) ** 2) / sum(quality)) AS sd, median(abs(slope)) AS noise, (SELECT median(abs(delta)) FROM d) AS signal, (SELECT median(abs(delta)) FROM d) / median(abs(slope)) AS snr FROM p, m""", "mean sd noise signal snr", digits=4)
def v01(spark, d):
    """Noise: the median absolute slope of a pair's gap by age, within a group. Signal: that of the slopes' differences between groups."""
    rows = panel(spark, d)
    gaps = pairs(rows, ["grp", "context", "step"], "entity", ["value", "pos"], ordered=False).withColumn("gap", F.col("a_value") - F.col("b_value"))
    slopes = settled(A.ols_slope(gaps, ["context", "a_entity", "b_entity"], "a_pos", "gap").join(gaps.groupBy("context", "a_entity", "b_entity").agg((1 / (1 + F.stddev_samp("gap"))).alias("quality")), ["context", "a_entity", "b_entity"]).where("n >= 8"), "gap-slopes")
    fitted = parameters(rows)
    groups = pairs(sensitivity(terms(rows, fitted), fitted).select(*GROUP, "slope"), ["compound"], "grp", ["slope"], ordered=False)
    signal = groups.select(F.abs(F.col("a_slope") - F.col("b_slope")).alias("delta")).agg(F.median("delta").alias("signal"))  # a row per pair of groups
    spread = slopes.crossJoin(F.broadcast(slopes.agg(A.wmean(F.col("slope"), F.col("quality")).alias("mean")))).withColumn("_s", (F.col("slope") - F.col("mean")) ** 2).withColumn("_abs", F.abs("slope"))
    found = spread.agg(F.count(F.lit(1)).alias("pairs"), F.first("mean").alias("mean"), F.sqrt(A.wmean(F.col("_s"), F.col("quality"))).alias("sd")).crossJoin(F.broadcast(grouped_median(spread, [], "_abs", "noise"))).crossJoin(F.broadcast(signal))
    return found.withColumn("snr", A.ratio(F.col("signal"), F.col("noise")))
