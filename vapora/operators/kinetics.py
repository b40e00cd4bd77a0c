"""Kinetic features of whole recordings over their own time stamps, one row per channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vapora.functions import arrays as A
from vapora.operators.baseline import R0_STREAM, channel_stats, r0_view_b
from vapora.plans import views


def kinetics(series: DataFrame, declared: int | None = None) -> DataFrame:
    """series (keys, t, v, n) with amplitude, direction, rise and decay in ms, signed area, endpoint and saturation.

    A dead channel, and one without a finite value, has amplitude, area and endpoint 0, direction 1 and no times.
    """
    s = channel_stats(r0_view_b(series, declared))
    s = s.withColumn("ok", F.expr("coalesce(NOT dead AND size(f) > 0 AND r0 > 0D, false)")).withColumn("x", F.expr(f"CASE WHEN ok THEN {A.relative('v', 'r0')} END"))
    s = s.withColumns({"hi": F.expr("array_max(filter(x, y -> NOT isnan(y)))"), "lo": F.expr("array_min(filter(x, y -> NOT isnan(y)))"), "pk": F.expr(A.first_largest(A.absolute("x")))})
    s = s.withColumns({"peak": F.expr("CASE WHEN abs(hi) >= abs(lo) THEN hi ELSE lo END"), "top": F.expr("element_at(x, cast(pk + 1 AS int))")})
    s = s.withColumns({f"i{p}": F.expr(A.first_where("x", f"x >= lo + 0.{p // 10}D * (hi - lo)")) for p in (10, 90)})
    back = A.first_where("slice(x, cast(pk + 1 AS int), cast(n - pk AS int))", "CASE WHEN top >= 0D THEN x <= 0.1D * top ELSE x >= 0.1D * top END")
    s = s.withColumn("ret", F.expr(f"CASE WHEN n - pk > 2 AND top <> 0D THEN {back} ELSE -1 END"))
    area = f"zip_with({A.steps('t')}, zip_with(slice(x, 1, size(x) - 1), slice(x, 2, size(x) - 1), (p, q) -> p + q), (d, y) -> CASE WHEN d > 0D THEN y * d * 0.5D ELSE 0D END)"
    s = s.withColumns({"resp": F.expr("array_max(transform(x, y -> abs(y)))"), "nf": F.expr(A.std("slice(x, 1, k)"))})
    at = lambda i: f"element_at(t, cast({i} + 1 AS int))"
    out = {
        "relative_amplitude": "CASE WHEN ok THEN abs(peak) ELSE 0D END",
        "direction": "CASE WHEN ok AND peak < 0D THEN -1 ELSE 1 END",
        "rise_time_ms": f"CASE WHEN ok AND i10 >= 0 AND i90 >= 0 THEN {at('i90')} - {at('i10')} END",
        "decay_time_ms": f"CASE WHEN ok AND ret >= 0 THEN {at('pk + ret')} - {at('pk')} END",
        "auc": f"CASE WHEN NOT ok OR n < 2 THEN 0D ELSE {A.total(area)} END",
        "endpoint_delta": "CASE WHEN ok THEN element_at(x, -1) ELSE 0D END",
        "saturation_index": "CASE WHEN NOT ok OR n < k + 5 OR resp < nf * 2D OR resp + nf * 10D = 0D THEN 0D ELSE least(1D, resp / (resp + nf * 10D)) END",
    }
    return s.withColumns({c: F.expr(e) for c, e in out.items()}).drop("ok", "hi", "lo", "pk", "peak", "top", "i10", "i90", "ret", "resp", "nf")


def _q_view_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kinetics(views.stream(spark, sf_dir))
    cols = ("relative_amplitude", "rise_time_ms", "decay_time_ms", "auc", "endpoint_delta", "saturation_index", "r0")
    return out.selectExpr("recording_id", "channel", "direction", "dead", *(f"{A.snap(c, 2 if c == 'auc' else 6)} AS {c}" for c in cols))


QUERIES = {"view_b_kinetics": _q_view_b}

_s = A.snap
ORACLE_SQL = {
    "view_b_kinetics": f"""WITH {views.STREAM}, {R0_STREAM},
x AS (SELECT s.recording_id, s.channel, idx, t, s.n, k, r0, (v - r0) / r0 AS x, (v - r0) / r0 + lag((v - r0) / r0) OVER w AS pair, t - lag(t) OVER w AS dt FROM stream s JOIN r0 USING (recording_id, channel) WINDOW w AS (PARTITION BY s.recording_id, s.channel ORDER BY idx)),
g AS (SELECT recording_id, channel, any_value(n) AS n, any_value(k) AS k, any_value(r0) AS r0, max(x) AS hi, min(x) AS lo, arg_min(idx, (-abs(x), idx)) AS pk, arg_min(x, (-abs(x), idx)) AS top, arg_min(t, (-abs(x), idx)) AS t_pk, coalesce(sum(pair * dt * 0.5::DOUBLE) FILTER (dt > 0), 0) AS auc, arg_max(x, idx) AS last_x, max(abs(x)) AS resp, stddev_pop(x) FILTER (idx < k) AS nf, stddev_pop(x) < 0.001 AS dead FROM x GROUP BY 1, 2),
h AS (SELECT recording_id, channel, arg_min(t, idx) FILTER (x >= lo + 0.1::DOUBLE * (hi - lo)) AS t10, arg_min(t, idx) FILTER (x >= lo + 0.9::DOUBLE * (hi - lo)) AS t90, arg_min(t, idx) FILTER (idx >= pk AND CASE WHEN top >= 0 THEN x <= 0.1::DOUBLE * top ELSE x >= 0.1::DOUBLE * top END) AS t_back
  FROM (SELECT recording_id, channel, idx, t, x FROM x) JOIN g USING (recording_id, channel) GROUP BY 1, 2)
SELECT recording_id, channel, CASE WHEN NOT dead AND CASE WHEN abs(hi) >= abs(lo) THEN hi ELSE lo END < 0 THEN -1 ELSE 1 END AS direction, dead,
  {_s('CASE WHEN dead THEN 0 ELSE greatest(abs(hi), abs(lo)) END', 6)} AS relative_amplitude, {_s('CASE WHEN dead THEN NULL ELSE t90 - t10 END', 6)} AS rise_time_ms,
  {_s('CASE WHEN dead OR n - pk <= 2 OR top = 0 THEN NULL ELSE t_back - t_pk END', 6)} AS decay_time_ms, {_s('CASE WHEN dead THEN 0 ELSE auc END', 2)} AS auc, {_s('CASE WHEN dead THEN 0 ELSE last_x END', 6)} AS endpoint_delta,
  {_s('CASE WHEN dead OR n < k + 5 OR resp < nf * 2 THEN 0 ELSE least(1, resp / (resp + nf * 10)) END', 6)} AS saturation_index, {_s('r0', 6)} AS r0
FROM g JOIN h USING (recording_id, channel)""",
}
