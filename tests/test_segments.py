"""Segmented scans against the array forms, with one recording that holds a third of all samples."""

import random

import pytest
from pyspark.sql import functions as F

from vapora.operators import baseline, features, quality, segments, timing
from vapora.plans import views

KEYS = ["recording_id", "channel"]


@pytest.fixture(scope="module")
def samples(spark):
    draw = random.Random(9)
    rows = []
    for rec, n in [("hot", 4000), *((f"r{k}", draw.randrange(1, 160)) for k in range(90)), (None, 40)]:
        t = 0.0
        level = draw.choice([50.0, 300.0, 0.0])
        for k in range(n):
            t += draw.choice([100.0, 100.0, 100.0, 104.0, 0.0, 300.0])
            value = level + (draw.random() - 0.5) * 8 + (90 if n / 3 < k < n / 2 else 0)
            rows.append((rec, "a", t, k, float("nan") if draw.random() < 0.01 and rec != "hot" else value))
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "recording_id string, channel string, t double, tie int, value double")
    return df.repartition(4).cache()


@pytest.fixture(scope="module")
def series(samples):
    return views.gather(samples, *KEYS).cache()


def test_no_segment_holds_a_long_recording(samples):
    parts = segments.cut(samples, KEYS, 200, 64)
    sizes = {(r.recording_id, r.seg): r.n for r in parts.groupBy("recording_id", "seg").agg(F.count("*").alias("n")).collect()}
    hot = [n for (rec, _), n in sizes.items() if rec == "hot"]
    assert len(hot) > 40 and max(hot) < 250 and len({rec for rec, _ in sizes}) == 92
    edges = parts.where("recording_id = 'hot'").groupBy("seg").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("seg").collect()
    assert all(a.hi < b.lo for a, b in zip(edges, edges[1:]))
    assert segments.cut(samples, KEYS).select("seg").distinct().count() == 1


@pytest.mark.parametrize("rows", [200, 10_000])
def test_places_and_samples_before(samples, series, rows):
    got = {(r.recording_id, r.idx): r for r in segments.placed(samples, KEYS, rows, 64).collect()}
    for r in series.collect():
        seen = 0
        for k, (t, v) in enumerate(zip(r.t, r.v)):
            g = got[r.recording_id, k]
            assert (g.n, g.t, g.finite_idx) == (r.n, t, seen) and (g.value == v or v != v)
            assert (g.prev_t, g.prev_value) == (None, None) if k == 0 else g.prev_t == r.t[k - 1]
            seen += v == v
    assert len(got) == samples.count()


def close(a, b):
    return a == b or a is None and b is None or (a is not None and b is not None and (abs(a - b) <= 1e-9 * max(1, abs(b)) or (a != a and b != b)))


def same_columns(got, want, key, columns):
    mine, theirs = ({tuple(r[k] for k in key): r for r in df.select(*key, *columns).collect()} for df in (got, want))
    assert set(mine) == set(theirs)
    for k, r in mine.items():
        for c in columns:
            assert close(r[c], theirs[k][c]) if isinstance(r[c], float) or isinstance(theirs[k][c], float) else r[c] == theirs[k][c], (k, c, r[c], theirs[k][c])


def test_periods_and_continuity(spark, samples, series):
    want = quality.gaps(series).withColumn("non_positive", F.expr("cast(size(filter(g, x -> x <= 0D)) AS bigint)"))
    same_columns(segments.periods(samples, KEYS, 200, 64), want, KEYS, ["n", "median_gap", "non_positive"])
    for rate in ("CAST(NULL AS double)", "10D", "0.01D"):
        declared = quality.declare(samples.select("recording_id").distinct(), rate=rate)
        got = segments.continuity(samples.drop("channel"), declared, rows=200, ranges=64)
        same_columns(got, quality.continuity(quality.declare(series.drop("channel", "v"), rate=rate)), ["recording_id"], ["continuity", "continuity_reason", "time_unit_mismatch"])


def test_crossings_area_and_extreme(samples, series):
    got = segments.device_agnostic(samples.where("NOT isnan(value)"), KEYS, rows=200, ranges=64)
    clean = series.withColumn("t", F.lit(None)).withColumn("v", F.filter("v", lambda x: ~F.isnan(x))).withColumn("n", F.size("v").cast("long"))
    want = features.device_agnostic(baseline.r0_view_a(clean)).withColumn("peak", F.col("peak").cast("long"))
    same_columns(got, want, KEYS, ["n", "r0", "peak", "is_dead", "relative_amplitude", "direction", "rise_time", "decay_time", "auc", "endpoint_delta"])


@pytest.mark.parametrize("source", ["auto", "explicit", "none"])
def test_channel_scores(samples, series, source):
    declared = quality.declare(samples.select("recording_id").distinct().where("recording_id IS NOT NULL"), adc_max="350D", baseline=f"'{source}'", r0_samples="CASE WHEN recording_id LIKE '%3' THEN 7 END")
    # an explicit baseline is all of the channel, and only here its finite values alone
    named = samples.where("recording_id IS NOT NULL" + (" AND NOT isnan(value)" if source == "explicit" else ""))
    got = segments.channel_scores(named, declared, 200, 64)
    want = quality.channel_scores(views.gather(named, *KEYS), declared)
    same_columns(got, want, KEYS, ["n", "r0", "cv", "dead", "net_span", "clipped", "range_score", "free_score", "signal_score", "recovery_score"])


@pytest.mark.parametrize(("sweep", "period"), [(0.25, 0.1), (0.0, 1.0), (1e6, 1.0)])
def test_deskew(samples, series, sweep, period):
    s = samples.withColumn("ch_idx", F.length("recording_id") % 4).where("recording_id IS NOT NULL AND NOT isnan(value)")
    got = {(r.recording_id, r.idx): r.value for r in segments.deskew(s, ["recording_id", "ch_idx"], sweep, period, 200, 64).collect()}
    clean = views.gather(s, "recording_id", "ch_idx")
    want = {(r.recording_id, k): v for r in timing.deskew(clean, sweep, period).collect() for k, v in enumerate(r.v)}
    assert got == want


@pytest.mark.parametrize("few", [10, 10_000])
def test_ranks_are_exact(spark, few):
    draw = random.Random(2)
    rows = [("a", float(draw.randrange(500))) for _ in range(6000)] + [("b", draw.gauss(0, 1)) for _ in range(3000)] + [("c", 5.0)] * 700 + [("d", None), ("e", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    asked = {"low": "cast(floor(0.05D * (m - 1)) AS bigint)", "below": "(m - 1) div 2", "above": "m div 2", "first": "0", "last": "m - 1"}
    got = {r.k: r for r in segments.order_statistics(df, ["k"], "v", asked, few=few).collect()}
    for k in "abce":
        v = sorted(x for key, x in rows if key == k)
        m = len(v)
        assert (got[k].low, got[k].below, got[k].above, got[k]["first"], got[k].last) == (v[int(0.05 * (m - 1))], v[(m - 1) // 2], v[m // 2], v[0], v[-1])
    assert "d" not in got


def test_empty_tables(spark, samples):
    none = samples.where("false")
    assert segments.placed(none, KEYS).count() == 0 and segments.device_agnostic(none, KEYS).count() == 0
    assert segments.periods(none, KEYS).count() == 0 and segments.medians(none, KEYS, "value").count() == 0
    assert segments.quality(none, quality.declare(none.select("recording_id"))).count() == 0


def test_short_keys_are_not_sketched(spark, samples):
    """Without long keys nothing is sketched or joined; long ones beside short ones give the same."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    values = samples.withColumn("value", F.nanvl("value", F.lit(None)))
    ranks = {"low": "m div 20", "below": "(m - 1) div 2", "above": "m div 2"}
    short, mixed = (segments.order_statistics(values, KEYS, "value", ranks, few=few) for few in (10_000, 60))
    assert not any(w in plan(short) for w in ("percentile_approx", "Join", "Generate"))
    assert sorted(map(str, short.collect())) == sorted(map(str, mixed.collect()))
    short, cut = (segments.placed(values, KEYS, rows, 32) for rows in (10_000, 60))
    assert not any(w in plan(short) for w in ("percentile_approx", "Join"))
    assert short.dtypes == cut.dtypes
    assert sorted(map(str, short.collect())) == sorted(map(str, cut.collect()))
