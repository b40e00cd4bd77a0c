"""Features of overlapping windows in one Arrow pass: a recording's rows are cut in chunks, never copied once per window.

A window overlaps nine others, so copying it to a row of its own costs ten times the recording. Here a chunk of CHUNK rows and the
rows that its last windows reach into are one row; a task views its windows in place, computes all features of thousands of windows
at once, and gives sums over the chunk's windows. Sums of a recording's chunks are added up, so a long recording is many tasks' work.
The features are those of operators.features and operators.signal, of every channel, with pairs of channels and the rig as a whole.

Cases: a recording without rows has no windows and no result; one shorter than a window is one window, filled with its last value.
Values that aren't finite leave the baseline to the others and go through all else as numbers do. Channels of a recording have equal
lengths; those that are shorter are filled with NaN. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vapora.functions import arrays as A
from vapora.operators import features, signal
from vapora.operators.baseline import STRIDE, WINDOW
from vapora.plans import views

NAMES = tuple(f for b in features.BLOCKS.values() for f in b)
#: Rows of a chunk, a multiple of the stride; windows that are computed at once.
CHUNK, AT_ONCE = 50_000, 8192
assert CHUNK % STRIDE == 0


def _first(hit: np.ndarray) -> np.ndarray:
    """Place of each row's first True, -1 without one."""
    return np.where(hit.any(axis=1), hit.argmax(axis=1), -1)


def _trapezoid(x: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Sums over the steps whose both ends are kept."""
    return np.where(keep[:, 1:] & keep[:, :-1], (x[:, 1:] + x[:, :-1]) / 2, 0.0).sum(axis=1)


def _baselines(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Baseline and dead flag of each window, from its finite values."""
    n = w.shape[1]
    length = lambda m: 5 if m <= 0 else min(30, max(5, int(m * 0.15)))
    m = np.median(w[:, : length(n)], axis=1)
    positive = np.where(w > 0, w, 0.0).sum(axis=1) / np.maximum((w > 0).sum(axis=1), 1)
    r0 = np.where(m > 0, m, np.where((w > 0).any(axis=1), positive, 1.0))
    dead = w.std(axis=1) / r0 < 0.001
    for k in np.flatnonzero(~np.isfinite(w).all(axis=1)):
        f = w[k][np.isfinite(w[k])]
        head = f[: length(len(f))]
        m = np.median(head) if len(head) else 0.0
        r0[k] = m if m > 0 else f[f > 0].mean() if (f > 0).any() else 1.0
        dead[k] = len(f) < 2 or f.std() / r0[k] < 0.001
    return r0, dead


def window_features(w: np.ndarray, sr: float = 10.0, decay: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A column for each of NAMES, and dead flags, of windows of at least 20 rows each, a row of w each."""
    m, n = w.shape
    with np.errstate(all="ignore"):
        k = min(30, max(5, int(n * 0.15)))
        r0, dead = _baselines(w)
        col = r0[:, None]
        at = np.arange(n)
        hi, lo = w.max(axis=1), w.min(axis=1)
        sign = np.where(np.abs(hi - r0) >= np.abs(lo - r0), 1.0, -1.0)
        reach = np.abs(np.where(sign > 0, hi, lo) - r0)
        edge = {p: np.maximum(lo, np.minimum(hi, r0 + p * reach * sign)) for p in (0.1, 0.9)}
        turned = w * sign[:, None]
        i10, i90 = (_first(turned >= (edge[p] * sign)[:, None]) for p in (0.1, 0.9))
        dev = np.abs(w - col)
        peak = dev.argmax(axis=1)
        behind = at >= peak[:, None]
        si, ei = (_first(behind & (turned <= (edge[p] * sign)[:, None])) for p in (0.9, 0.1))
        rel = dev / np.abs(col)
        raw = w[:, -10:].mean(axis=1)
        ratio = raw / r0
        steps = np.abs(np.diff(w, axis=1))
        head = w[:, :10]
        late = _first((np.abs(w - head.mean(axis=1, keepdims=True)) > 3 * head.std(axis=1, keepdims=True)) & (at >= 10))
        x = at - (n - 1) / 2
        third = n // 3
        ads, des = _trapezoid(dev, at <= peak[:, None]), _trapezoid(dev, behind)
        five = (w[:, :-4] + w[:, 1:-3] + w[:, 2:-2] + w[:, 3:-1] + w[:, 4:]) / 5
        signed = dev / col
        resp, noise = signed.max(axis=1), signed[:, :k].std(axis=1)
        y = w - w.mean(axis=1, keepdims=True)
        slope = (y @ x) / (x @ x)
        y = y - x * slope[:, None]
        density = np.abs(np.fft.rfft(np.nan_to_num(y), axis=1)) ** 2 / (sr * n)
        density[:, 1 : -1 if n % 2 == 0 else None] *= 2
        top = density[:, 1:].argmax(axis=1) + 1
        value = {
            "saturation_index": np.where((resp < noise * 2) | (resp + noise * 10 == 0), 0.0, np.minimum(1.0, resp / (resp + noise * 10))),
            "relative_amplitude": np.where(dead, 0.0, reach / r0),
            "direction": np.where(dead, 0.0, sign),
            "rise_time": np.where(~dead & (i10 >= 0) & (i90 >= 0) & (i10 < n - 1) & (i90 < n - 1), np.abs(i90 - i10) / sr, -1.0),
            "decay_time": np.where(~dead & (n - peak > 2) & (si >= 0) & (ei >= 0), (ei - peak) / sr, -1.0),
            "auc": np.where(dead, 0.0, (rel.sum(axis=1) - (rel[:, 0] + rel[:, -1]) / 2) / sr),
            "endpoint_delta": np.where(dead, 0.0, (w[:, -1] - r0) / r0),
            "raw_resistance": raw,
            "baseline_resistance": r0,
            "voltage": raw,
            "calibrated_concentration": np.where(ratio > 0, np.power(np.where(ratio > 0, ratio, 1.0) / features.NOMINAL[0], 1 / features.NOMINAL[1]), 0.0),
            "hf_transient": steps.mean(axis=1) * sr,
            "oscillation_freq": top * sr / n,
            "oscillation_amp": np.sqrt(density[np.arange(m), top]),
            "response_latency": np.where(late < 0, -1.0, late / sr),
            "drift_rate": slope * sr,
            "sensitivity_decay": (w[:, n - third :].mean(axis=1) - w[:, :third].mean(axis=1)) / r0,
            "noise_floor": w[:, :k].std(axis=1) / r0,
            "hysteresis": np.where((peak > 5) & (peak < n - 5), np.abs(ads - des) / np.maximum(ads, 1e-10), 0.0),
            "circuit_response": w.mean(axis=1),
            "thermal_profile": w.std(axis=1),
            "adc_noise": (w[:, 2:-2] - five).std(axis=1),
        }
        fits = signal.decays(list(w), peak.tolist(), sr) if decay else np.full((m, 7), np.nan)
        value |= {name: fits[:, i] for i, name in enumerate(signal.NAMES)}
    return np.stack([value[name] for name in NAMES], axis=1), dead


AMPLITUDE, AREA = NAMES.index("relative_amplitude"), NAMES.index("auc")


def rig_features(per: list[np.ndarray], dead: list[np.ndarray]) -> np.ndarray:
    """The vector of features.feature_names(): channels after each other, ratios of pairs, then the rig as a whole."""
    c = len(per)
    with np.errstate(all="ignore"):
        amp, live = np.stack([p[:, AMPLITUDE] for p in per], 1), ~np.stack(dead, 1)
        pairs = [np.where(live[:, i] & live[:, j] & (amp[:, i] > 0) & (amp[:, j] > 0), amp[:, i] / amp[:, j], 0.0) for i in range(c) for j in range(i + 1, c)]
        some = live.any(axis=1)
        largest = np.where(some, np.where(live, amp, -np.inf).max(axis=1), 0.0)
        mean = np.where(some, np.where(live, amp, 0.0).sum(axis=1) / np.maximum(live.sum(axis=1), 1), 0.0)
        area = np.where(live, np.stack([p[:, AREA] for p in per], 1), 0.0).sum(axis=1)
    return np.column_stack([*per, *pairs, largest, mean, live.sum(axis=1).astype(float), area])


def chunks(series: DataFrame, matrix: str = "matrix", rows: int = CHUNK, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """series (keys, n, and a matrix of an array per channel) as chunks: the matrix cut to the rows that the chunk's windows need.

    Windows start at multiples of the stride; a chunk has those that start in its rows.
    """
    keys = [c for c in series.columns if c not in (matrix, "n", "t")]
    starts = F.greatest(F.lit(0), F.floor((F.col("n") - size) / stride)) * stride  # of the last window
    some = series.where("n > 0").select(*keys, matrix, "n", F.explode(F.sequence(F.lit(0), F.floor(starts / rows).cast("int"))).alias("chunk"))
    part = F.transform(matrix, lambda v: F.slice(v, F.col("chunk") * rows + 1, F.lit(rows + size - stride)))
    return some.select(*keys, "chunk", part.alias(matrix))


def _padded(channels: list[np.ndarray], size: int) -> np.ndarray:
    n = max(size, *map(len, channels))
    out = np.full((len(channels), n), np.nan)
    longest = max(map(len, channels))
    for row, v in zip(out, channels):
        row[: len(v)] = v
        if longest < size and len(v):
            row[longest:] = v[-1] if len(v) == longest else np.nan
    return out


def vector_sums(parts: DataFrame, rig: bool, sr: float = 10.0, decay: bool = True, matrix: str = "matrix", size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """chunks() with n_windows and sums, the sums of its windows' vectors: those of the whole rig, or of the first channel alone."""
    keys = [c for c in parts.columns if c != matrix]

    def vectors(windows: list[np.ndarray]) -> np.ndarray:
        w = np.concatenate(windows, axis=1)
        found = [window_features(w[c], sr, decay) for c in range(w.shape[0])]
        return rig_features([f for f, _ in found], [d for _, d in found]) if rig else found[0][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: list[np.ndarray | None] = [None] * b.num_rows
            counts = [0] * b.num_rows
            pending: dict[int, list[tuple[int, np.ndarray]]] = {}  # by number of channels

            def settle(c: int) -> None:
                held = pending.pop(c)
                v = vectors([w for _, w in held])
                ends = np.cumsum([0, *(w.shape[1] for _, w in held)])
                for (row, _), lo, hi in zip(held, ends, ends[1:]):
                    more = v[lo:hi].sum(axis=0)
                    sums[row] = more if sums[row] is None else sums[row] + more
                    counts[row] += int(hi - lo)

            for row, channels in enumerate(b.column(matrix).to_pylist() if b.num_rows else []):
                m = _padded([np.array([np.nan if x is None else x for x in v], float) for v in channels], size)
                view = np.lib.stride_tricks.sliding_window_view(m, size, axis=1)[:, ::stride]
                for lo in range(0, view.shape[1], AT_ONCE):
                    pending.setdefault(len(m), []).append((row, view[:, lo : lo + AT_ONCE]))
                    if sum(w.shape[1] for _, w in pending[len(m)]) >= AT_ONCE:
                        settle(len(m))
            for c in list(pending):
                settle(c)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(counts, pa.int64()), pa.array([None if s is None else s.tolist() for s in sums], pa.list_(pa.float64()))], names=[*keys, "n_windows", "sums"])

    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in parts.select(*keys).dtypes), "n_windows long, sums array<double>"])
    return parts.select(*keys, matrix).mapInArrow(run, schema)


def mean_vectors(series: DataFrame, rig: bool = True, sr: float = 10.0, decay: bool = True, matrix: str = "matrix") -> DataFrame:
    """series (keys, n, matrix) with n_windows and vector, the mean over windows: named by features.feature_names(), or by NAMES without rig."""
    keys = [c for c in series.columns if c not in (matrix, "n", "t")]
    sums = vector_sums(chunks(series, matrix), rig, sr, decay, matrix)
    # a recording's chunks are few; each is one vector
    g = sums.groupBy(*keys).agg(F.sum("n_windows").alias("n_windows"), F.collect_list("sums").alias("s"))
    zero = F.transform(F.col("s")[0], lambda x: F.lit(0.0))
    total = F.aggregate("s", zero, lambda a, s: F.zip_with(a, s, lambda x, y: x + y))
    return g.select(*keys, "n_windows", F.transform(total, lambda x: x / F.col("n_windows")).alias("vector"))


def mean_features(series: DataFrame, sr: float = 10.0, wanted: Sequence[str] = NAMES) -> DataFrame:
    """Means over the windows of a single-channel series (keys, v, n): keys, feature, value."""
    keys = [c for c in series.columns if c not in ("v", "t", "n")]
    decay = any(f in signal.NAMES for f in wanted)
    means = mean_vectors(series.select(*keys, "n", F.array("v").alias("matrix")), False, sr, decay)
    named = F.array(*(F.struct(F.lit(f).alias("feature"), F.col("vector")[NAMES.index(f)].alias("value")) for f in wanted))
    return means.select(*keys, F.inline(named))


def rigs(series: DataFrame, keys: Sequence[str] = ("recording_id",)) -> DataFrame:
    """series (keys, ch_idx, v, n) as one row per recording: keys, n, matrix in the channels' order."""
    g = series.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ch_idx", "v"))).alias("s"), F.max("n").alias("n"))
    return g.select(*keys, "n", F.col("s.v").alias("matrix"))


def steady(x: str) -> str:
    """SQL of x to six decimals, and to nine places beyond 10,000: means of ratios may be of any size."""
    scale = f"pow(10, floor(log10(abs({x}))))"
    return f"CASE WHEN abs({x}) < 1e4 THEN {A.snap(x, 6)} ELSE {A.snap(f'({x}) / {scale}', 8)} * {scale} END"


CHECKED = tuple(f for f in NAMES if f not in signal.NAMES)


def _legacy(series: DataFrame) -> DataFrame:
    return features.r0_legacy_normalised(series)


def _q_feature_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of every feature but the decays' over the windows of suppliers' recordings; tests hold the decays' against the fit of each window."""
    out = mean_features(_legacy(views.longrun(spark, sf_dir)), wanted=CHECKED)
    return out.selectExpr("recording_id", "feature", f"{steady('value')} AS value")


QUERIES = {"feature_vector_mean": _q_feature_mean}


def _oracle() -> str:
    names = ", ".join(CHECKED)
    f = {name: f"avg({name})::DOUBLE AS {name}" for name in CHECKED}
    return f"""WITH {views.LONGRUN}, lr AS (SELECT recording_id, median(v) FILTER (idx < greatest(5, floor(n * 0.15::DOUBLE))) AS m, list(v ORDER BY idx) AS l, any_value(n) AS n FROM longrun GROUP BY recording_id),
z AS (SELECT recording_id, n, list_transform(l, lambda x: (x - CASE WHEN m < 1 THEN 1 ELSE m END) / CASE WHEN m < 1 THEN 1 ELSE m END) AS l FROM lr),
pz AS (SELECT recording_id, n, CASE WHEN n < 100 THEN list_concat(l, list_transform(range(100 - n), lambda i: l[n])) ELSE l END AS l FROM z),
sg AS (SELECT recording_id, l, unnest(range(greatest(0, n - 100) // 10 + 1)) AS w FROM pz),
rows_of AS (SELECT recording_id, w, unnest(range(100)) AS idx, unnest(l[w * 10 + 1 : w * 10 + 100]) AS v, 100 AS n FROM sg), {features._agnostic('rows_of', 'recording_id, w')},
jr AS (SELECT o.recording_id, w, idx, v, r0, peak, abs(v - r0) AS dev FROM rows_of o JOIN da USING (recording_id, w)),
ws AS (SELECT *, lag(v) OVER q AS before, lag(dev) OVER q AS dev_before, avg(v) OVER (PARTITION BY recording_id, w ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS five, avg(CASE WHEN idx < 10 THEN v END) OVER p AS m10, stddev_pop(CASE WHEN idx < 10 THEN v END) OVER p AS s10, v - avg(v) OVER p - (idx - 49.5::DOUBLE) * regr_slope(v, idx) OVER p AS y
  FROM jr WINDOW q AS (PARTITION BY recording_id, w ORDER BY idx), p AS (PARTITION BY recording_id, w)),
g AS (SELECT recording_id, w, any_value(r0) AS baseline_resistance, avg(v) FILTER (idx >= 90) AS raw_resistance, avg(abs(v - before)) * 10 AS hf_transient, coalesce(min(idx) FILTER (idx >= 10 AND abs(v - m10) > 3 * s10) / 10::DOUBLE, -1) AS response_latency, regr_slope(v, idx) * 10 AS drift_rate,
    (avg(v) FILTER (idx >= 67) - avg(v) FILTER (idx < 33)) / any_value(r0) AS sensitivity_decay, stddev_pop(v) FILTER (idx < 15) / any_value(r0) AS noise_floor, avg(v) AS circuit_response, stddev_pop(v) AS thermal_profile, stddev_pop(v - five) FILTER (idx BETWEEN 2 AND 97) AS adc_noise,
    CASE WHEN any_value(peak) > 5 AND any_value(peak) < 95 THEN abs(coalesce(sum((dev + dev_before) / 2) FILTER (idx <= peak), 0) - coalesce(sum((dev + dev_before) / 2) FILTER (idx > peak), 0)) / greatest(coalesce(sum((dev + dev_before) / 2) FILTER (idx <= peak), 0), 1e-10) ELSE 0 END AS hysteresis,
    max(dev / r0) AS resp, stddev_pop(dev / r0) FILTER (idx < 15) AS nf FROM ws GROUP BY recording_id, w),
fk AS (SELECT unnest(range(1, 51)) AS k), fd AS (SELECT recording_id, w, k, CASE WHEN k = 50 THEN 1 ELSE 2 END * (pow(sum(y * cos(2 * pi() * k * idx / 100)), 2) + pow(sum(y * sin(2 * pi() * k * idx / 100)), 2)) / 1000 AS d FROM ws, fk GROUP BY recording_id, w, k),
fo AS (SELECT recording_id, w, arg_max(k, d) / 10::DOUBLE AS oscillation_freq, sqrt(max(d)) AS oscillation_amp FROM fd GROUP BY recording_id, w),
fx AS (SELECT *, raw_resistance AS voltage, CASE WHEN raw_resistance / baseline_resistance > 0 THEN pow(raw_resistance / baseline_resistance, -2) ELSE 0 END AS calibrated_concentration, CASE WHEN resp < nf * 2 OR resp + nf * 10 = 0 THEN 0 ELSE least(1, resp / (resp + nf * 10)) END AS saturation_index
  FROM (SELECT recording_id, w, relative_amplitude, direction, rise_time, decay_time, auc, endpoint_delta FROM da) JOIN g USING (recording_id, w) JOIN fo USING (recording_id, w)),
fm AS (SELECT recording_id, {", ".join(f.values())} FROM fx GROUP BY recording_id)
SELECT recording_id, feature, {steady('value')} AS value FROM (UNPIVOT fm ON {names} INTO NAME feature VALUE value)"""


ORACLE_SQL = {"feature_vector_mean": _oracle()}
