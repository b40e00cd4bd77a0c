"""Power-law calibration rr = a * C ** b: fits, leave-one-out tests, inversion, tabulated laws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vapora.functions import arrays as A
from vapora.functions import sensors
from vapora.plans import views


class CalibrationError(ValueError):
    """The points don't determine a fit."""


def ratio_of(normalised: Column) -> Column:
    return normalised + 1.0


def concentration(rr: Column, a: Column, b: Column) -> Column:
    """(rr / a) ** (1 / b); NaN where rr or a isn't positive or b is 0, NULL where a or b is NULL."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when((rr > 0) & (a > 0) & (b != 0), F.pow(rr / a, 1.0 / F.when(b != 0, b))).otherwise(F.lit(float("nan")))


def two_point(rr1: Column, c1: Column, rr2: Column, c2: Column) -> tuple[Column, Column]:
    """Exact a and b through two points; NULL for values that aren't positive and for equal ones."""
    ok = (rr1 > 0) & (c1 > 0) & (rr2 > 0) & (c2 > 0) & (c1 != c2) & (rr1 != rr2)
    b = F.when(ok, F.log(rr1 / rr2) / F.log(c1 / c2))
    return F.when(ok, rr1 / F.pow(c1, b)), b


def two_point_values(rr1: float, c1: float, rr2: float, c2: float) -> tuple[float, float]:
    if not min(rr1, c1, rr2, c2) > 0 or c1 == c2 or rr1 == rr2:
        raise CalibrationError("two points need positive, distinct responses and concentrations")
    b = math.log(rr1 / rr2) / math.log(c1 / c2)
    return rr1 / c1**b, b


def valid(points: DataFrame) -> DataFrame:
    """Points (rr, c) that a fit can use, with their logarithms."""
    finite = lambda c: (F.col(c) > 0) & (F.col(c) < float("inf"))
    return points.where(finite("rr") & finite("c")).withColumns({"y": F.log("rr"), "x": F.log("c")})


def fit_power_law(points: DataFrame, *keys: str) -> DataFrame:
    """Least squares of log rr on log c by keys: n_points, a, b, r2, rmse_log_rr and the range of c. Fewer than two points, or one concentration, give a NULL fit."""
    v = valid(points)
    g = v.groupBy(*keys).agg(
        F.count("*").alias("n_points"), F.expr("regr_slope(y, x)").alias("b"), F.expr("regr_intercept(y, x)").alias("i"), F.expr("regr_syy(y, x)").alias("syy"),
        F.expr("regr_sxy(y, x)").alias("sxy"), F.min("c").alias("min_ppm"), F.max("c").alias("max_ppm"),
    )
    rest = F.greatest(F.lit(0.0), F.col("syy") - F.col("b") * F.col("sxy"))
    return g.select(*keys, "n_points", F.exp("i").alias("a"), "b", F.when(F.col("syy") > 0, 1 - rest / F.when(F.col("syy") > 0, F.col("syy"))).otherwise(F.when(F.col("b").isNotNull(), 0.0)).alias("r2"), F.sqrt(rest / F.col("n_points")).alias("rmse_log_rr"), "min_ppm", "max_ppm")


def loocv_power_law(points: DataFrame, *keys: str) -> DataFrame:
    """Each point predicted from the fit of its key's others, from sums less its own terms; keys with under 3 points are left out."""
    v = valid(points)
    # Sums of whole keys are aggregated and joined back, so that no task holds all points of a key.
    sums = v.groupBy(*keys).agg((F.count("*") - 1).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.var_pop("x") * F.count("*")).alias("xx"), (F.covar_pop("x", "y") * F.count("*")).alias("xy")).where("n >= 2")
    v = v.join(sums, list(keys)) if keys else v.join(F.broadcast(sums))
    v = v.withColumns({"dx": F.col("x") - F.col("mx"), "dy": F.col("y") - F.col("my")})
    v = v.withColumns({"sx": -F.col("dx"), "sy": -F.col("dy"), "sxx": F.col("xx") - F.col("dx") * F.col("dx"), "sxy": F.col("xy") - F.col("dx") * F.col("dy")})
    den = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    v = v.withColumn("b", (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.when(den != 0, den))
    v = v.withColumn("a", F.exp(F.col("my") + F.col("sy") / F.col("n") - F.col("b") * (F.col("mx") + F.col("sx") / F.col("n"))))
    v = v.withColumn("pred_ppm", concentration(F.col("rr"), F.col("a"), F.col("b")))
    return v.withColumn("rel_error", (F.col("pred_ppm") - F.col("c")) / F.col("c")).drop("n", "mx", "my", "dx", "dy", "sx", "sy", "sxx", "sxy", "xx", "xy", "x", "y")


def loocv_summary(points: DataFrame, *keys: str) -> DataFrame:
    e = loocv_power_law(points, *keys)
    p = F.abs("rel_error") * 100.0
    return e.groupBy(*keys).agg(F.count("*").alias("n_folds"), F.avg(p).alias("mean_abs_pct_error"), F.median(p).alias("median_abs_pct_error"), F.max(p).alias("max_abs_pct_error"), (F.avg("rel_error") * 100.0).alias("bias_pct"))


def payload(fits: DataFrame, label: str = "reference", date: str | None = None) -> DataFrame:
    """fits with a struct as recordings' calibration entries hold it; the date is given, so outputs repeat. Fits without a or b are left out."""
    ref = F.sqrt(F.greatest(F.col("min_ppm"), F.lit(1.0)) * F.greatest(F.col("max_ppm"), F.lit(1.0)))
    entry = F.struct("a", "b", F.lit(label).alias("referenceSubstance"), ref.alias("referencePpm"), F.lit(date).alias("date"), F.lit("multi-point").alias("method"))
    return fits.where("a IS NOT NULL AND b IS NOT NULL").withColumn("calibration", entry)


def calibrate_precise(points: DataFrame, *keys: str, gas: str = "reference", date: str | None = None) -> DataFrame:
    """Fit, leave-one-out test and calibration entry of every key in one row; keys that don't determine a fit are left out."""
    made = payload(fit_power_law(points, *keys), gas, date)
    tests = loocv_summary(points, *keys)
    return made.join(tests, list(keys), "left") if keys else made.join(F.broadcast(tests))


def concentration_series(channels: DataFrame, calibration: DataFrame) -> DataFrame:
    """channels (recording_id, channel, x) with conc, the concentration of every value; all NaN for a channel without calibration (channel, a, b)."""
    joined = channels.join(calibration.select("channel", "a", "b"), "channel", "left")
    return joined.withColumn("conc", F.expr("transform(x, y -> CASE WHEN a > 0D AND b <> 0D AND y + 1D > 0D THEN pow((y + 1D) / a, 1D / b) ELSE double('NaN') END)")).drop("a", "b")


def calibrate_quick(names: DataFrame, sensor: str = "sensor", gas: str = "gas", a: str | None = None, b: str | None = None) -> DataFrame:
    """names with the tabulated a and b, or the given columns' where not NULL; error says why a law can't be used."""
    out = sensors.power_law_of(names, sensor, gas)
    out = out.withColumns({"a": F.coalesce(F.col(a), F.col("a")) if a else F.col("a"), "b": F.coalesce(F.col(b), F.col("b")) if b else F.col("b")})
    return out.withColumn("error", F.expr("CASE WHEN a IS NULL OR b IS NULL THEN 'not tabulated' WHEN a <= 0D OR b = 0D THEN 'not invertible' END"))


def lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calibration points around rr = 2 * c ** -0.6, by priority and customer group."""
    o = views.table(spark, sf_dir, "orders")
    return o.selectExpr("o_orderkey", "o_orderpriority AS batch", "cast(o_custkey % 8 AS int) AS rig", "o_totalprice / 1000D AS c", "2D * pow(o_totalprice / 1000D, -0.6D) * (1D + (o_orderkey % 11 - 5) / 100D) AS rr")


def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part rows as sensor and gas names in several spellings."""
    p = views.table(spark, sf_dir, "part")
    return p.selectExpr("p_partkey", "element_at(array('mq', 'MQ-', 'Mq_', 'mq '), cast(p_size % 4 + 1 AS int)) || element_at(array('2', '3', '135', '8', '99', '309a', '7'), cast(p_partkey % 7 + 1 AS int)) AS sensor", "element_at(array('lpg', 'CO', 'Ethanol', 'h2', 'C2H5OH', 'smoke', 'CH-4'), cast(p_partkey div 7 % 7 + 1 AS int)) AS gas")


def _q_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_power_law(lab(spark, sf_dir), "batch", "rig").selectExpr("batch", "rig", "n_points", *(f"{A.snap(c, 6)} AS {c}" for c in ("a", "b", "r2", "rmse_log_rr")), "min_ppm", "max_ppm")


def _q_loocv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loocv_summary(lab(spark, sf_dir), "batch", "rig").selectExpr("batch", "rig", "n_folds", *(f"{A.snap(c, 6)} AS {c}" for c in ("mean_abs_pct_error", "median_abs_pct_error", "max_abs_pct_error", "bias_pct")))


def _q_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lab(spark, sf_dir).withColumn("ppm", concentration(F.col("rr"), F.lit(2.0), F.lit(-0.6)))
    return out.selectExpr("o_orderkey", f"{A.snap('ppm', 5)} AS ppm")


def _q_two_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = lab(spark, sf_dir).groupBy("batch", "rig").agg(F.min(F.struct("c", "o_orderkey", "rr")).alias("lo"), F.max(F.struct("c", "o_orderkey", "rr")).alias("hi"))
    a, b = two_point(F.col("lo.rr"), F.col("lo.c"), F.col("hi.rr"), F.col("hi.c"))
    return g.select("batch", "rig", a.alias("a"), b.alias("b")).selectExpr("batch", "rig", f"{A.snap('a', 6)} AS a", f"{A.snap('b', 6)} AS b")


def _q_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensors.normalise_sensor(spellings(spark, sf_dir), "sensor").select("p_partkey", "sensor", "model", "family", "clean_air_ratio")


def _q_quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate_quick(spellings(spark, sf_dir)).select("p_partkey", "sensor", "gas", "model", "gas_name", "a", "b", "error")


def _q_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = views.wave(spark, sf_dir).selectExpr("recording_id", "cast(recording_id % 3 AS string) AS channel", "transform(v, x -> (x - 1000D) / 1000D) AS x")
    cal = spark.createDataFrame([("0", 2.0, -0.5), ("1", 1.5, -0.8)], "channel string, a double, b double")
    out = concentration_series(w, cal).selectExpr("recording_id", "channel", "posexplode(conc) AS (idx, c)")
    return out.selectExpr("recording_id", "channel", "idx", f"CASE WHEN NOT isnan(c) THEN {A.snap('c', 5)} END AS conc")


def _q_precise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = calibrate_precise(lab(spark, sf_dir), "batch", "rig", gas="CO", date="2024-01-01")
    return p.selectExpr("batch", "rig", f"{A.snap('calibration.a', 6)} AS a", f"{A.snap('calibration.b', 6)} AS b", f"{A.snap('calibration.referencePpm', 6)} AS reference_ppm", "calibration.referenceSubstance AS gas", "calibration.date AS date", "n_folds", f"{A.snap('bias_pct', 6)} AS bias_pct")


QUERIES = {"calibrate_precise": _q_precise, "concentration_series": _q_series, "power_law_fit": _q_fit, "power_law_loocv": _q_loocv, "invert_concentration": _q_invert, "two_point": _q_two_point, "sensor_name_normalise": _q_normalise, "quick_calibration": _q_quick}

_s = A.snap
_LAB = "lab AS (SELECT o_orderkey, o_orderpriority AS batch, (o_custkey % 8)::INT AS rig, o_totalprice / 1000::DOUBLE AS c, 2::DOUBLE * pow(o_totalprice / 1000::DOUBLE, -0.6::DOUBLE) * (1::DOUBLE + (o_orderkey % 11 - 5) / 100::DOUBLE) AS rr FROM orders)"
_SPELL = "sp AS (SELECT p_partkey, ['mq', 'MQ-', 'Mq_', 'mq '][p_size % 4 + 1] || ['2', '3', '135', '8', '99', '309a', '7'][p_partkey % 7 + 1] AS sensor, ['lpg', 'CO', 'Ethanol', 'h2', 'C2H5OH', 'smoke', 'CH-4'][p_partkey // 7 % 7 + 1] AS gas FROM part)"
_MODELS = "md(model, family, ratio) AS (VALUES " + ", ".join(f"('{m}', '{f}', {'NULL' if r is None else r}::DOUBLE)" for m, f, r, _ in sensors._rows()) + ")"
_LAWS = "lw(model, gas, a, b) AS (VALUES " + ", ".join(f"('{m}', '{g}', {a}::DOUBLE, {b}::DOUBLE)" for m, _, _, gs in sensors._rows() for g, a, b in gs) + ")"
_KEY = "regexp_replace(upper({}), '[^A-Z0-9]', '', 'g')"
ORACLE_SQL = {
    "concentration_series": f"""WITH {views.WAVE}, x AS (SELECT recording_id, (recording_id % 3)::VARCHAR AS channel, idx, (v - 1000) / 1000::DOUBLE + 1 AS rr FROM wave)
SELECT recording_id, channel, idx::INT AS idx, CASE WHEN rr <= 0 THEN NULL WHEN channel = '0' THEN {_s('pow(rr / 2, -2)', 5)} WHEN channel = '1' THEN {_s('pow(rr / 1.5::DOUBLE, 1 / -0.8::DOUBLE)', 5)} END AS conc FROM x""",
    "power_law_fit": f"""WITH {_LAB}, g AS (SELECT batch, rig, count(*) AS n, regr_slope(ln(rr), ln(c)) AS b, regr_intercept(ln(rr), ln(c)) AS i, min(c) AS lo, max(c) AS hi, regr_r2(ln(rr), ln(c)) AS r2 FROM lab GROUP BY 1, 2),
r AS (SELECT batch, rig, sqrt(avg(pow(ln(rr) - i - b * ln(c), 2))) AS rmse FROM lab JOIN g USING (batch, rig) GROUP BY 1, 2)
SELECT batch, rig, n AS n_points, {_s('exp(i)', 6)} AS a, {_s('b', 6)} AS b, {_s('r2', 6)} AS r2, {_s('rmse', 6)} AS rmse_log_rr, lo AS min_ppm, hi AS max_ppm FROM g JOIN r USING (batch, rig)""",
    "power_law_loocv": f"""WITH {_LAB}, l AS (SELECT batch, rig, o_orderkey, c, rr, ln(c) AS x, ln(rr) AS y FROM lab), f AS (SELECT a.batch, a.rig, a.o_orderkey, any_value(a.c) AS c, any_value(a.rr) AS rr, regr_slope(o.y, o.x) AS b, regr_intercept(o.y, o.x) AS i FROM l a JOIN l o ON a.batch = o.batch AND a.rig = o.rig AND a.o_orderkey <> o.o_orderkey GROUP BY 1, 2, 3),
e AS (SELECT batch, rig, (pow(rr / exp(i), 1 / b) - c) / c AS e FROM f)
SELECT batch, rig, count(*) AS n_folds, {_s('avg(abs(e)) * 100', 6)} AS mean_abs_pct_error, {_s('median(abs(e) * 100)', 6)} AS median_abs_pct_error, {_s('max(abs(e)) * 100', 6)} AS max_abs_pct_error, {_s('avg(e) * 100', 6)} AS bias_pct FROM e GROUP BY 1, 2""",
    "calibrate_precise": f"""WITH {_LAB}, l AS (SELECT batch, rig, o_orderkey, c, rr, ln(c) AS x, ln(rr) AS y FROM lab), f AS (SELECT a.batch, a.rig, a.o_orderkey, any_value(a.c) AS c, any_value(a.rr) AS rr, regr_slope(o.y, o.x) AS b, regr_intercept(o.y, o.x) AS i FROM l a JOIN l o ON a.batch = o.batch AND a.rig = o.rig AND a.o_orderkey <> o.o_orderkey GROUP BY 1, 2, 3),
e AS (SELECT batch, rig, count(*) AS n_folds, avg((pow(rr / exp(i), 1 / b) - c) / c) * 100 AS bias FROM f GROUP BY 1, 2), g AS (SELECT batch, rig, regr_slope(y, x) AS b, regr_intercept(y, x) AS i, min(c) AS lo, max(c) AS hi FROM l GROUP BY 1, 2)
SELECT batch, rig, {_s('exp(i)', 6)} AS a, {_s('b', 6)} AS b, {_s('sqrt(greatest(lo, 1) * greatest(hi, 1))', 6)} AS reference_ppm, 'CO' AS gas, '2024-01-01' AS date, n_folds, {_s('bias', 6)} AS bias_pct FROM g JOIN e USING (batch, rig)""",
    "invert_concentration": f"WITH {_LAB} SELECT o_orderkey, {_s('pow(rr / 2, 1 / -0.6::DOUBLE)', 5)} AS ppm FROM lab",
    "two_point": f"""WITH {_LAB}, g AS (SELECT batch, rig, arg_min(rr, (c, o_orderkey)) AS r1, min(c) AS c1, arg_max(rr, (c, o_orderkey)) AS r2, max(c) AS c2 FROM lab GROUP BY 1, 2), h AS (SELECT *, ln(r1 / r2) / ln(c1 / c2) AS b FROM g WHERE true)
SELECT batch, rig, {_s('r1 / pow(c1, b)', 6)} AS a, {_s('b', 6)} AS b FROM h""",
    "sensor_name_normalise": f"WITH {_SPELL}, {_MODELS} SELECT p_partkey, sensor, model, family, ratio AS clean_air_ratio FROM sp LEFT JOIN md ON {_KEY.format('sensor')} = {_KEY.format('model')}",
    "quick_calibration": f"""WITH {_SPELL}, {_LAWS}, k AS (SELECT *, {_KEY.format('sensor')} AS sk, {_KEY.format('gas')} AS gk FROM sp), j AS (SELECT k.p_partkey, k.sensor, k.gas, lw.model, lw.gas AS gas_name, lw.a, lw.b, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN {_KEY.format('lw.gas')} = gk THEN 0 ELSE 1 END) AS r
FROM k LEFT JOIN lw ON {_KEY.format('lw.model')} = sk AND ({_KEY.format('lw.gas')} = gk OR (gk IN ('C2H5OH', 'ETHANOL', 'ETHYLALCOHOL') AND lw.gas = 'Alcohol')))
SELECT p_partkey, sensor, gas, model, gas_name, a, b, CASE WHEN a IS NULL THEN 'not tabulated' END AS error FROM j WHERE r = 1""",
}
