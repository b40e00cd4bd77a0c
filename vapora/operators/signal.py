"""Features that need a numeric routine per channel: the spectral peak and the exponential decay fit, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vapora.operators.baseline import r0_view_a
from vapora.plans import views

#: Start points of log tau. Most steps of a fit, which ends before when its cost stands still, and the bound of log tau.
STARTS = {1: [np.log(3.0)], 2: [np.log(2.0), np.log(10.0)], 3: [np.log(1.5), np.log(5.0), np.log(20.0)]}
STEPS, LOG_TAU = 400, 20.0
#: Values of a batch of fits.
BATCH = 200_000


def peak(v: np.ndarray, sr: float) -> tuple[float, float]:
    """Frequency and root density of the largest peak of the detrended periodogram, the mean left out; zeros up to 20 values."""
    n = len(v)
    if n <= 20:
        return 0.0, 0.0
    x = np.arange(n) - (n - 1) / 2
    y = v - v.mean()
    y = y - x * (x @ y) / (x @ x)
    density = np.abs(np.fft.rfft(y)) ** 2 / (sr * n)
    density[1 : -1 if n % 2 == 0 else None] *= 2
    k = int(np.argmax(density[1:])) + 1
    return k * sr / n, float(np.sqrt(density[k]))


def _exponentials(t: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """exp(-t / tau) for even t from 0, each as a product of one of every 32nd place and one of the first 32."""
    n, (rows, c) = len(t), tau.shape
    coarse, fine = (np.exp(-some / tau[:, :, None]) for some in (t[::32], t[:32]))
    return (coarse[:, :, :, None] * fine[:, :, None, :]).reshape(rows, c, -1)[:, :, :n]


def _decayed(log_tau: np.ndarray, t: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Amplitudes and constant that fit best given the time constants, the residuals, and their derivatives by log tau.

    Amplitudes are linear and so eliminated: a step only moves the time constants. Derivatives are those of the projected residual
    with the change of the projection left out.
    """
    tau = np.exp(log_tau)
    e = _exponentials(t, tau) * mask[:, None, :]
    late = e * t
    late /= tau[:, :, None]
    basis = np.concatenate([e, mask[:, None, :]], axis=1)
    gram = basis @ basis.transpose(0, 2, 1)
    gram += np.eye(gram.shape[1]) * 1e-13 * np.einsum("ikk->ik", gram).max(axis=1)[:, None, None]
    both = np.concatenate([basis @ y[:, :, None], basis @ late.transpose(0, 2, 1)], axis=2)
    solved = np.linalg.solve(gram, both)
    linear = solved[:, :, 0]
    residual = y - np.einsum("bk,bkn->bn", linear, basis)
    slope = (late - solved[:, :, 1:].transpose(0, 2, 1) @ basis) * linear[:, :-1, None]
    return linear, residual, slope


def fit(t: np.ndarray, y: np.ndarray, mask: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variable projection of all rows of y at once, from the fixed start points: log tau, amplitudes with the constant, costs.

    t is even from 0. mask is 1 where a row has a value, so rows may differ in length. A cost that isn't finite marks a failure, and so does one that
    still falls when the steps are used up.
    """
    n = len(y)
    best = np.tile(np.array(STARTS[components]), (n, 1))
    damping, live = np.full(n, 1e-3), np.arange(n)
    with np.errstate(all="ignore"):
        linear, r, slope = _decayed(best, t, y, mask)
        amounts, costs, floor = linear.copy(), (r**2).sum(axis=1), 1e-22 * (y**2).sum(axis=1)
        for _ in range(STEPS):
            if not len(live):
                break
            normal = slope @ slope.transpose(0, 2, 1)
            diag = np.maximum(np.einsum("ikk->ik", normal), 1e-300)
            damped = normal + np.eye(components) * (damping[live, None] * diag + 1e-12 * diag.max(axis=1, keepdims=True))[:, None, :]
            step = np.linalg.solve(damped, slope @ r[:, :, None])[:, :, 0]
            moved = np.clip(best[live] + np.clip(step, -1.0, 1.0), -LOG_TAU, LOG_TAU)
            new_linear, new_r, new_slope = _decayed(moved, t, y[live], mask[live])
            new = (new_r**2).sum(axis=1)
            better = np.isfinite(new) & (new < costs[live])
            still = np.where(better, costs[live] - new <= 1e-10 * costs[live], damping[live] > 1e8) | (costs[live] <= floor[live])
            damping[live] *= np.where(better, 1 / 4, 4)
            at = live[better]
            best[at], amounts[at], costs[at] = moved[better], new_linear[better], new[better]
            keep = ~still
            r, slope = np.where(better[:, None], new_r, r)[keep], np.where(better[:, None, None], new_slope, slope)[keep]
            live = live[keep]
    costs[live] = np.inf  # out of steps: no fit
    costs[~(np.isfinite(best).all(axis=1) & np.isfinite(amounts).all(axis=1))] = np.inf
    return best, amounts, costs


def decays(series: list[np.ndarray], at: list[int], sr: float, components: int = 2) -> np.ndarray:
    """Rows of tau1..3, a1..3 and cost for each series' recovery after its peak; -1 where there is none to fit.

    Recoveries are fitted together, padded to the longest of a batch of similar lengths; fewer components only where more give no fit.
    """
    out = np.full((len(series), 7), -1.0)
    parts: list[tuple[int, np.ndarray]] = []
    for k, (v, peak_at) in enumerate(zip(series, at, strict=True)):
        part = v[max(5, min(peak_at, len(v) - 10)) :] if len(v) >= 20 else v[:0]
        if len(part) >= 10 and np.std(part) >= 1e-8 and np.isfinite(part).all():
            parts.append((k, part - part[-1]))
    parts.sort(key=lambda p: len(p[1]))
    while parts:
        longest = len(parts[-1][1])
        some = parts[-max(1, BATCH // longest) :]
        del parts[-len(some) :]
        which, sizes = np.array([k for k, _ in some]), np.array([len(x) for _, x in some])
        t = np.arange(longest) / sr
        mask = (np.arange(longest) < sizes[:, None]).astype(float)
        y = np.zeros((len(some), longest))
        for row, (_, x) in zip(y, some):
            row[: len(x)] = x
        open_ = np.ones(len(some), bool)
        for c in range(components, 0, -1):
            fits = open_ & (sizes >= 30) if c == 3 else open_
            if not fits.any():
                continue
            log_tau, linear, cost = fit(t, y[fits], mask[fits], c)
            good = np.isfinite(cost)
            rows = which[fits][good]
            out[rows, 0:c], out[rows, 3 : 3 + c], out[rows, 6] = np.exp(log_tau[good]), linear[good, :-1], cost[good]
            open_[np.flatnonzero(fits)[good]] = False
    return out


NAMES = ("tau1", "tau2", "tau3", "a1", "a2", "a3", "cost")


def decay(v: np.ndarray, at: int, sr: float, components: int = 2) -> dict[str, float]:
    """decays() of one series."""
    return dict(zip(NAMES, decays([np.asarray(v, float)], [at], sr, components)[0].tolist(), strict=True))


def _rows(batch: pa.RecordBatch, column: str = "v") -> Iterator[np.ndarray]:
    a = batch.column(column)
    flat, ends = a.values.to_numpy(zero_copy_only=False), a.offsets.to_numpy()
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        yield flat[lo:hi]


def spectral_peak(series: DataFrame, sr: float = 10.0) -> DataFrame:
    """series (keys, v) without its arrays, with oscillation_freq and oscillation_amp."""
    keys = [c for c, kind in series.dtypes if not kind.startswith(("array", "map", "struct"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [peak(v, sr) for v in _rows(b)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array([f for f, _ in found], pa.float64()), pa.array([a for _, a in found], pa.float64())], names=[*keys, "oscillation_freq", "oscillation_amp"])

    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in series.select(*keys).dtypes), "oscillation_freq double", "oscillation_amp double"])
    return series.select(*keys, "v").mapInArrow(run, schema)


def decay_fit(series: DataFrame, sr: float = 10.0, components: int = 2) -> DataFrame:
    """series (keys, v, r0) without its arrays, with tau1..3, a1..3 and cost; the recovery starts at the largest deviation from r0."""
    keys = [c for c, kind in series.dtypes if not kind.startswith(("array", "map", "struct"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(_rows(b))
            peaks = [int(np.argmax(np.abs(v - r0))) if len(v) else 0 for v, r0 in zip(rows, b.column("r0").to_pylist(), strict=True)]
            found = decays(rows, peaks, sr, components)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], names=[*keys, *NAMES])

    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in series.select(*keys).dtypes), *(f"{n} double" for n in NAMES)])
    return series.select(*keys, "v").mapInArrow(run, schema)


def spectrum_and_decay(series: DataFrame, sr: float = 10.0, components: int = 2) -> DataFrame:
    """spectral_peak() and decay_fit() of series (keys, v, r0) in one pass; all other columns that aren't arrays are carried along."""
    keys = [c for c, kind in series.dtypes if not kind.startswith(("array", "map", "struct"))]
    more = ("oscillation_freq", "oscillation_amp", *NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(_rows(b))
            peaks = [int(np.argmax(np.abs(v - r0))) if len(v) else 0 for v, r0 in zip(rows, b.column("r0").to_pylist(), strict=True)]
            found = np.concatenate([np.array([peak(v, sr) for v in rows]).reshape(-1, 2), decays(rows, peaks, sr, components)], axis=1)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], names=[*keys, *more])

    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in series.select(*keys).dtypes), *(f"{n} double" for n in more)])
    return series.select(*keys, "v").mapInArrow(run, schema)


def _q_spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral_peak(views.wave(spark, sf_dir)).select("recording_id", F.round("oscillation_freq", 6).alias("oscillation_freq"), F.round("oscillation_amp", 6).alias("oscillation_amp"))


def _q_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decay_fit(r0_view_a(views.wave(spark, sf_dir))).select("recording_id", "tau1", "tau2", "a1", "a2", "cost")


QUERIES = {"spectral_peak": _q_spectral, "decay_fit": _q_decay}
#: The periodogram as sums of sines: every frequency of every series, for the oracle.
ORACLE_SQL = {
    "spectral_peak": f"""WITH {views.WAVE}, d AS (SELECT recording_id, idx, n, v - avg(v) OVER w - (idx - (n - 1) / 2::DOUBLE) * regr_slope(v, idx) OVER w AS y FROM wave WINDOW w AS (PARTITION BY recording_id)),
k(k) AS (SELECT unnest(range(1, 33))), p AS (SELECT recording_id, k, any_value(n) AS n, CASE WHEN k = 32 THEN 1 ELSE 2 END * (pow(sum(y * cos(2 * pi() * k * idx / n)), 2) + pow(sum(y * sin(2 * pi() * k * idx / n)), 2)) / (10 * any_value(n)) AS p FROM d, k GROUP BY recording_id, k)
SELECT recording_id, round(arg_max(k, p) * 10::DOUBLE / any_value(n), 6) AS oscillation_freq, round(sqrt(max(p)), 6) AS oscillation_amp FROM p GROUP BY recording_id""",
}
