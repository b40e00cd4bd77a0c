"""Stated results of the engine's operators."""

import io
import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vapora import queries
from vapora.functions import arrays as A
from vapora.functions import catalogue, sensors, smiles
from vapora.operators import baseline, calibration, feasibility, features, hardware, kinetics, molecules, presets, quality, search, signal, study, timing
from vapora.sources import cells, recordings


def one(spark, v, t=None, **more):
    return spark.createDataFrame([("r", list(map(float, v)), list(map(float, t if t is not None else range(0, 100 * len(v), 100))), len(v))], "recording_id string, v array<double>, t array<double>, n long").withColumns({k: F.lit(x) for k, x in more.items()})


@pytest.mark.parametrize(("n", "k"), [(0, 5), (1, 5), (20, 5), (60, 9), (100, 15), (200, 30), (600, 30), (18000, 30)])
def test_window_of_baseline(spark, n, k):
    assert spark.sql(f"SELECT {A.window_length(str(n))} AS k").first().k == k


def test_declared_window_and_guards(spark):
    step = [1000] * 7 + [2000] * 8 + [1500] * 86
    assert baseline.r0_view_b(one(spark, step), 7).first().r0 == 1000
    assert baseline.r0_view_b(one(spark, step), 15).first().r0 == 2000
    zeros = [0.0] * 20 + [5.0, 7.0]
    assert baseline.r0_view_a(one(spark, zeros)).first().r0 == 6.0  # positive values of the whole series
    assert baseline.r0_view_b(one(spark, zeros)).first().r0 == 1.0  # positive values of the window
    assert baseline.r0_view_b(one(spark, [float("nan")] * 3)).first().r0 is None


def test_window_rules_differ_on_long_series(spark):
    ramp = list(range(1, 1001))
    assert baseline.r0_view_a(one(spark, ramp)).first().r0 == 15.5
    assert baseline.r0_legacy(one(spark, ramp)).first().r0 == 75.5


def test_segments(spark):
    assert baseline.segment(one(spark, range(115))).count() == 2
    short = baseline.segment(one(spark, [1, 2, 3])).first()
    assert len(short.w) == 100 and short.w[-1] == 3.0


@pytest.mark.parametrize(("channels", "n"), [(1, 32), (3, 91), (4, 122), (6, 187), (12, 406)])
def test_feature_names(channels, n):
    names = features.feature_names(channels)
    assert len(names) == n == len(set(names))


def test_dead_and_short_channels(spark):
    dead = features.device_agnostic(baseline.r0_view_a(one(spark, [100.0] * 50))).first()
    assert dead.is_dead and dead.relative_amplitude == 0 and dead.rise_time == -1
    short = features.device_agnostic(baseline.r0_view_a(one(spark, [1.0, 2.0]))).first()
    assert short.relative_amplitude == -1 and short.is_dead


def test_saturation_and_health_of_short_series_are_zero(spark):
    row = features.health(features.saturation(baseline.r0_view_a(one(spark, [1, 2, 3])))).first()
    assert row.saturation_index == 0 and row.drift_rate == 0


def exposure(n=600, base=100, amp=600):
    i = np.arange(n) / n
    return base + amp * np.clip(np.where(i < 0.45, (i - 0.15) / 0.3, np.where(i < 0.55, 1, (0.9 - i) / 0.35)), 0, 1)


def scored(spark, channels, rate="10D", adc="4095D", base="'auto'", role="'exposure'", t=None):
    n = len(next(iter(channels.values())))
    rec = spark.createDataFrame([("r", [float(x) for x in (t if t is not None else range(0, 100 * n, 100))], n)], "recording_id string, t array<double>, n long")
    rows = spark.createDataFrame([("r", c, [float(x) for x in v], n) for c, v in channels.items()], "recording_id string, channel string, v array<double>, n long")
    return quality.quality(rows, quality.declare(rec, rate=rate, adc_max=adc, role=role, baseline=base)).first()


def test_clean_exposure_is_excellent(spark):
    q = scored(spark, {f"c{k}": exposure(base=100 + 30 * k) for k in range(6)})
    assert q.total >= 90 and q.badge == "Excellent" and q.baselineStability == 50


def test_quality_falls_with_defects(spark):
    clean = {f"c{k}": exposure(base=100 + 30 * k) for k in range(3)}
    base = scored(spark, clean)
    dead = scored(spark, clean | {"c2": np.full(600, 100.0)})
    both = scored(spark, clean | {"c1": np.full(600, 90.0), "c2": np.full(600, 100.0)})
    assert base.total > dead.total > both.total and dead.dead_sensors == ["c2"]
    rail = dict(clean)
    rail["c0"] = rail["c0"].copy()
    rail["c0"][300:360] = 4095
    railed = scored(spark, rail)
    assert railed.saturationFree < base.saturationFree and railed.dynamicRange <= base.dynamicRange
    assert scored(spark, clean, t=range(600)).continuity is None  # seconds where milliseconds are due
    assert scored(spark, clean, role="'single'").signalStrength is None
    assert scored(spark, clean, base="'none'").baselineStability == 0


def test_kinetics_of_a_pulse(spark):
    k = kinetics.kinetics(one(spark, exposure(), channel="c")).first()
    assert k.direction == 1 and k.relative_amplitude == pytest.approx(6.0, rel=0.02) and k.rise_time_ms > 0 and k.decay_time_ms > 0 and k.auc > 0


def test_two_point_and_inversion(spark):
    a, b = calibration.two_point_values(2 * 3**-0.7, 3, 2 * 50**-0.7, 50)
    assert (a, b) == (pytest.approx(2), pytest.approx(-0.7))
    with pytest.raises(calibration.CalibrationError):
        calibration.two_point_values(1, 3, 1, 50)
    row = spark.range(1).select(calibration.concentration(F.lit(1.5), F.lit(2.0), F.lit(-0.5)).alias("a"), calibration.concentration(F.lit(-1.0), F.lit(2.0), F.lit(-0.5)).alias("b")).first()
    assert row.a == pytest.approx(0.75**-2) and math.isnan(row.b)


def test_fit_recovers_a_power_law(spark):
    rng = np.random.default_rng(1)
    c = np.logspace(0, 2, 6)
    points = spark.createDataFrame([(float(x), float(2 * x**-0.6 * math.exp(rng.normal(0, 0.03)))) for x in c], "c double, rr double")
    f = calibration.fit_power_law(points).first()
    assert f.a == pytest.approx(2, rel=0.1) and f.b == pytest.approx(-0.6, rel=0.05) and f.r2 > 0.98
    assert calibration.loocv_summary(points).first().median_abs_pct_error < 20
    assert calibration.fit_power_law(points.limit(1)).first().b is None


def test_series_without_calibration_is_nan(spark):
    ch = spark.createDataFrame([("r", "a", [0.5, 0.9]), ("r", "b", [0.5])], "recording_id string, channel string, x array<double>")
    cal = spark.createDataFrame([("a", 2.0, -0.5)], "channel string, a double, b double")
    got = {r.channel: r.conc for r in calibration.concentration_series(ch, cal).collect()}
    assert got["a"] == [pytest.approx(0.75**-2), pytest.approx(0.95**-2)] and math.isnan(got["b"][0])


def test_deskew(spark):
    ramp = spark.createDataFrame([(k, [float(k + i) for i in range(10)], 10) for k in range(3)], "ch_idx int, v array<double>, n long")
    got = {r.ch_idx: r.v for r in timing.deskew(ramp, 0.5, 0.5).collect()}
    assert [got[k][0] for k in range(3)] == [0, 2, 4] and got[2][-2:] == [None, None]
    far = {r.ch_idx: r.v for r in timing.deskew(ramp, 100, 0.5).collect()}
    assert far[1][0] == 10 and far[1][1:] == [None] * 9
    with pytest.raises(ValueError):
        timing.deskew(ramp, 0.5, 0)


def test_gate(spark):
    rows = spark.createDataFrame([(n,) for n in (32, 91, 122, 154, 187, 188, 100, 0)], "n int").select("n", hardware.implied_channels(F.col("n")).alias("c")).collect()
    assert [r.c for r in rows] == [1, 3, 4, 5, 6, None, None, None]
    dims = [r.d for r in spark.range(1, 7).select(hardware.effective_dims(F.col("id")).alias("d")).collect()]
    assert dims == [0.5, 1.0, 1.5, 2.0, 2.5, 2.5]
    alike = spark.createDataFrame([([float(i)] * 10,) for i in range(20)], "v array<double>")
    assert hardware.effective_rank(alike, "v") == 1.0
    assert hardware.effective_rank(alike.limit(1), "v") == 1.0


#: Recorded masses and boiling points in K.
MOLECULES = [("c1ccc2c(c1)oc1ccccc12", 168.19, 567.3), ("CCOC(=S)[S-].[K+]", 160.29, 291.2), ("O=COCCc1ccccc1", 150.18, 408.6), ("O=c1ccc2ccccc2o1", 146.15, 501.7), ("CC12OCCC1SCS2", 162.27, 481.75), ("c1ccc(SSc2ccccc2)cc1", 218.33, 665.1), ("c1ccc(Oc2ccccc2)cc1", 170.21, 549.9), ("S=C=Nc1ccccc1", 135.18, 463.6)]


def test_group_contributions(spark):
    got = {r.smiles: r.d for r in smiles.describe(spark.createDataFrame([(text,) for text, _, _ in MOLECULES], "smiles string")).collect()}
    for text, mw, tb in MOLECULES:
        assert got[text].molecular_weight == pytest.approx(mw, abs=0.011) and got[text].boiling_point_c + 273.15 == pytest.approx(tb, abs=0.101), text


def test_molecule_descriptions(spark):
    texts = ["CCO", "  CCO ", "O=C=O", "C(", "C)", "CC1", "C1=CC=CC=C1", "C1=CC2=C(C=C1)C=CC=C2", "C1CC1CC2CCC2", "[Xx]", "", None, "O", "C%10CCCCC%10", "CCO", "[NH4+].[Cl-]", "C1CC(C1"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, smiles string").withColumn("text", F.lit("x"))
    got = [r.d for r in smiles.describe(rows).orderBy("k").collect()]
    assert len(got) == len(texts)
    assert got[0].molecular_weight == 46.07 and got[0].boiling_point_c == 64.4 and got[0].groups == ["alcohol"] and got[0].redox_active and not got[0].gas
    assert got[0] == got[14] == got[1] and got[2].non_redox and got[12].non_redox is False
    assert [k for k, d in enumerate(got) if d.error] == [3, 4, 5, 9, 10, 11, 16]
    assert got[6].groups == got[7].groups == ["aromatic"] and got[8].groups == ["alkane"] and got[13].molecular_weight == 84.16
    assert smiles.describe(rows.where("false")).count() == 0
    made = molecules.from_smiles(spark.createDataFrame([("CCO",), ("nonsense",)], "smiles string"))
    assert made.count() == 1 and feasibility.constituent_chain(made).first().verdict == "green"


def test_rings_are_what_closing_bonds_go_round(spark):
    texts = ["C1CC1CC2CCC2", "c1ccc2ccccc2c1", "CC(C1CC1)C", "C12CCC(CC1)C2", "CCO"]
    atoms, bonds, _ = smiles.graph(spark.createDataFrame([(t,) for t in texts], "smiles string"))
    sizes = {r.smiles: r.n for r in smiles.ring_atoms(atoms, bonds).groupBy("smiles").agg(F.count("*").alias("n")).collect()}
    assert sizes == {texts[0]: 7, texts[1]: 10, texts[2]: 3, texts[3]: 7}


def test_verdicts(spark):
    v = {r.id: r for r in feasibility.constituent_chain(catalogue.compounds(spark)).collect()}
    for i in ("ethanol", "acetone", "hydrogen-sulfide"):
        assert (v[i].verdict, v[i].signal_strength, v[i].response_speed) == ("green", "strong", "fast")
    assert v["ethanol"].confidence == "high" and v["isoamyl-acetate"].confidence == "medium" and v["isoamyl-acetate"].signal_strength == "strong"
    assert v["carbon-dioxide"].verdict == v["nitrogen"].verdict == v["carbon-dioxide"].g_reactivity == "red"
    assert all((v[i].verdict, v[i].signal_strength, v[i].response_speed) == ("yellow", "weak", "slow") for i in ("eugenol", "cinnamaldehyde"))
    assert (v["water"].verdict, v["water"].signal_strength) == ("yellow", "strong")
    m = {r.id: (r.verdict, r.signal_strength) for r in feasibility.composite_verdict(catalogue.composites(spark), catalogue.compounds(spark)).collect()}
    assert m["banana"] == ("green", "strong") and m["cinnamon"] == ("yellow", "weak") and m["sewer"] == ("green", "strong")
    c = feasibility.resolve(spark, "class:alcohol", "class").first()
    assert (c.verdict, c.confidence) == ("yellow", "low")


@pytest.mark.parametrize(("weights", "verdict"), [((0.5, 0.5), "yellow"), ((0.1, 0.9), "red")])
def test_mixtures_with_inert_gas(spark, weights, verdict):
    mix = spark.createDataFrame([(0, "m", "M", "mix", [], [("ethanol", weights[0], "measured"), ("carbon-dioxide", weights[1], "measured"), ("missing", 1.0, "measured")])], catalogue.composites(spark).schema)
    got = feasibility.composite_verdict(mix, catalogue.compounds(spark)).first()
    assert got.verdict == verdict and got.n_resolved == 2
    none = feasibility.composite_verdict(mix.withColumn("constituents", F.array().cast(mix.schema["constituents"].dataType)), catalogue.compounds(spark)).first()
    assert (none.verdict, none.confidence, none.n_resolved) == ("green", "high", 0)


def test_search(spark):
    entries = search.dictionary(spark)
    q = spark.createDataFrame([("  Ethyl   ALCOHOL ",), ("64-17-5",), ("",)], "q string")
    got = search.search(q, entries).where("rank = 1").collect()
    assert {r.q.strip(): (r.id, r.score) for r in got} == {"Ethyl   ALCOHOL": ("ethanol", 100), "64-17-5": ("ethanol", 95)}
    assert search.exact_resolve(q, entries).count() == 1


def test_spearman(spark):
    df = spark.createDataFrame([("a", float(i), float(i * i)) for i in range(5)] + [("b", 1.0, float(i)) for i in range(5)], "k string, x double, y double")
    got = {r.k: r.rho for r in study.spearman(df, "x", "y", "k").collect()}
    assert got["a"] == pytest.approx(1) and got["b"] is None


def test_sensor_names():
    assert sensors.lookup_model("mq_135") == "MQ-135" and sensors.lookup_power_law("MQ3", "ethanol") == (0.537784, -0.664894)
    for args, error in ((("nope", "CO"), sensors.UnknownSensorError), (("BME680", "CO"), sensors.UnknownSensorError), (("MQ-9", "H2"), sensors.UnknownGasError)):
        with pytest.raises(error):
            sensors.lookup_power_law(*args)


# --- files -------------------------------------------------------------------


def test_csv_cases():
    r = recordings.parse_text("# c\n\ntimestamp_ms,VOC,Alcohol\n0,1,2\n100,3,4\n")
    assert (r["channel_ids"], r["rate_hz"], r["unsorted"], r["sensor_type"]) == (["VOC", "Alcohol"], 10.0, False, "mox")
    r = recordings.parse_text("timestamp_ms,VOC\n200,2\n100,1\n300,3")
    assert r["t"] == [100, 200, 300] and r["unsorted"] and r["channels"]["VOC"] == [1, 2, 3]
    r = recordings.parse_text("VOC,Alcohol\n1,2\n3,4")
    assert r["t"] == [0, 100] and r["time_source"] == "synthetic"
    r = recordings.parse_text("time,VOC,note\n1700000000,1,x\n1700000001,2,y")
    assert r["skipped"] == ["note"] and r["t"][0] == 1.7e12
    assert len(recordings.parse_text('time,VOC\n0,"1,000"\n100,5')["t"]) == 1
    r = recordings.parse_text("time;VOC;Humidity\n0;1;\n100;2;40")
    assert r["context_ids"] == ["Humidity"] and r["context"]["Humidity"] == [None, 40]
    assert recordings.parse_text("timestamp_ms,wavelength_600\n0,1\n1,2")["sensor_type"] == "miris"
    for bad in ("", "a,b"):
        with pytest.raises(ValueError):
            recordings.parse_text(bad)


def test_cells():
    assert cells.number(" 1_000 ") == 1000 and cells.number("1d") is None and math.isnan(cells.number("nan"))
    assert cells.time_ms("1:02:03.5") == 3723500 and cells.time_ms("2024-01-01T00:00:01+05:00") == 1704067201000 and cells.time_ms("2", True) == 2000 and cells.time_ms("x") is None
    assert cells.split_row('a,"b ""c"", d",e', ",") == ["a", 'b "c", d', "e"] and cells.delimiter("abc") == "|"
    assert cells.time_column(["x", "Time (ms)"]) is None and cells.time_column(["x", "Time [_ms]"]) == (1, False)
    assert cells.time_column(["x", "time (s)"]) == cells.time_column(["x", "time_s"]) == (1, True)


def test_time_columns_agree(spark):
    texts = ["12.5", " 7 ", "1_0", "1d", "0:00:59,25", "1:60:00", "2024-02-03T04:05:06", "2024-02-03 04:05:06.250", "2024-02-03T04:05:06Z", "2024-02-03T04:05:06+02:00", "", "x"]
    got = spark.createDataFrame([(x,) for x in texts], "c string").select("c", cells.time_ms_column(F.col("c")).alias("t")).collect()
    assert [r.t for r in got] == [cells.time_ms(x) for x in texts]


def test_folder_and_bundle(spark, tmp_path):
    for sub in ("coffee", "tea"):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / "a.csv").write_text("timestamp_ms,VOC\n0,1\n100,2\n")
    (tmp_path / "tea" / "bad.txt").write_text("only a header")
    manifest = {"sensor": {"sensorType": "mox", "channels": [{"id": "VOC"}], "samplingRateHz": 5}, "session": {"label": "x"}}
    (tmp_path / "tea" / "b.zip").write_bytes(recordings.to_bundle(manifest, [0, 200], {"VOC": [1, float("nan")]}, [{"label": "on", "startMs": 0}]))
    r = recordings.read_recordings(spark, str(tmp_path))
    got = {x.substance: (x.session_count, x.ok_count) for x in study.substance_rollup(r).collect()}
    assert got == {"coffee": (1, 1), "tea": (3, 2)}
    assert recordings.series(r).count() == 3 and recordings.samples(r).count() == 5  # the row with an empty cell is dropped
    back = recordings.reparse(recordings.bundles(r)).where("manifest LIKE '%samplingRateHz%'").first()
    assert json.loads(back.manifest)["session"]["label"] == "x" and json.loads(back.events)[0]["label"] == "on"


@pytest.mark.parametrize("members", [{"data.csv": "timestamp_ms,VOC\n0,1\n1,2"}, {"manifest.json": '{"sensor": {"channels": []}}', "data.csv": "timestamp_ms,VOC\n0,1\n1,2"}, {"manifest.json": '{"sensor": {"channels": [{"id": "VOC"}, {"id": "CO"}]}}', "data.csv": "timestamp_ms,VOC\n0,1\n1,2"}])
def test_bundles_that_are_refused(members):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    with pytest.raises(recordings.BundleError):
        recordings.parse_bundle(raw.getvalue())


def test_plain_matrix_keeps_bad_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,VOC,CO\n2,1,x\n1,3,4\n")
    m = recordings.read_matrix(spark, str(tmp_path / "a.csv")).collect()
    assert math.isnan(m[0].CO) and m[1].VOC == 3
    with pytest.raises(ValueError):
        recordings.read_matrix(spark, str(tmp_path / "a.csv"), ["nope"])


# --- presets, signal ----------------------------------------------------------


def test_presets(capsys):
    assert len(presets.shipped()) == 12
    text = """
id: demo
cadence_hz: 10   # ten
description: >
  two
  lines
sensors:
  - id: a
    model: MQ-2
    targets: [LPG, CO]
    clean_air_ratio: 9.83
feature_groups: [absolute, global]
provisional:
  - sensors[0].model
"""
    p = presets.build(presets.parse_yaml(text))
    assert p.description == "two lines" and p.r0_samples == 18000 and len(p.feature_names()) == 8
    for old, new in (("MQ-2", "MQ-77"), ("9.83", "9.0"), ("[LPG, CO]", "[Ozone]"), ("absolute", "nope"), ("sensors[0].model", "sensors[3].model"), ("cadence_hz: 10", "cadence_hz: -1"), ("id: demo", "ID: demo"), ("absolute, global", "selectivity")):
        with pytest.raises(presets.PresetError):
            presets.build(presets.parse_yaml(text.replace(old, new)))
    with pytest.raises(presets.PresetError, match=":2"):
        presets.parse_yaml("a: 1\nnonsense", "f")
    assert presets.main(["validate", "food_freshness"]) == 0 and presets.main(["validate", "food_freshness", "--strict"]) == 1
    assert presets.main(["show", "nope"]) == 1 and presets.main(["field", "food_freshness", "sensors[0].model"]) == 0 and presets.main([]) == 2
    assert "MQ-136" in capsys.readouterr().out


def test_fewer_components_only_where_more_give_no_fit(monkeypatch):
    t = np.arange(300) / 10
    series = [np.r_[np.zeros(5), a * np.exp(-t / 1) + 30 * np.exp(-t / 8)] for a in (70, 50)]
    asked, fit = [], signal.fit
    monkeypatch.setattr(signal, "fit", lambda t, y, mask, c: asked.append((len(y), c)) or fit(t, y, mask, c))
    assert signal.decays(series, [5, 5], 10.0, 2)[:, :2] == pytest.approx(np.array([[1.0, 8.0]] * 2), rel=1e-4)
    assert asked == [(2, 2)]
    monkeypatch.setattr(signal, "fit", lambda t, y, mask, c: asked.append((len(y), c)) or (*fit(t, y, mask, c)[:2], np.where((c == 2) & (y[:, 0] > 90), np.inf, 1.0)))
    got = signal.decays(series, [5, 5], 10.0, 2)
    assert asked[1:] == [(2, 2), (1, 1)] and got[0, 1] == -1 and got[1, :2] == pytest.approx([1.0, 8.0], rel=1e-4)


def test_parts_of_one_shape_are_fitted_once(spark, tmp_path, monkeypatch):
    rows = spark.range(1400).selectExpr("id AS p_partkey", "cast(id % 2 + 1 AS int) AS p_size")
    rows.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    seen, fit = [], signal.decay_fit
    monkeypatch.setattr(signal, "decay_fit", lambda series, **more: seen.append((series.count(), series.rdd.getNumPartitions())) or fit(series, **more))
    for query, shapes in (("decay_recovery", 40), ("decays_recovery", 350)):
        out = queries.QUERIES[query](spark, str(tmp_path))
        assert out.where("NOT " + " AND ".join(c for c, kind in out.dtypes if kind == "boolean")).count() == 0
        assert out.count() == (1400 if query == "decay_recovery" else 2800)
        assert all(n == shapes and tasks > 1 for n, tasks in seen)
        seen.clear()


def test_decay_and_spectrum():
    t = np.arange(200) / 10
    got = signal.decay(np.r_[np.zeros(5), 100 * np.exp(-t / 3)], 5, 10.0)
    assert min(got["tau1"], got["tau2"]) == pytest.approx(3, rel=0.35) or max(got["tau1"], got["tau2"]) == pytest.approx(3, rel=0.35)
    assert got["cost"] < 50 and got["tau3"] == -1
    two = signal.decay(np.r_[np.zeros(5), 70 * np.exp(-t / 1) + 30 * np.exp(-t / 8)], 5, 10.0)
    assert two["cost"] < 1
    assert signal.decay(np.ones(50), 5, 10.0)["tau1"] == -1
    f, a = signal.peak(np.sin(2 * np.pi * 2 * np.arange(100) / 10), 10.0)
    assert f == 2.0 and a > 0 and signal.peak(np.ones(5), 10.0) == (0.0, 0.0)
