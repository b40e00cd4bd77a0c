import numpy as np
import pytest
from pyspark.sql import functions as F

from vapora import lookup
from vapora.functions import catalogue
from vapora.operators import baseline, channels, enrichment, feasibility, features, molecules, quality, study
from vapora.plans import generators, manifest, views
from vapora.streaming import live


def gathered(samples, *keys):
    return views.gather(samples.select(*keys, F.col("t_ms").alias("t"), F.col("idx").alias("tie"), "value"), *keys)


def test_framework_of_synthetic_recordings(spark):
    s = gathered(generators.exposure_samples(spark, 2, 120), "recording_id", "channel", "ch_idx")
    long = channels.framework(s)
    names = {r.feature for r in long.select("feature").distinct().collect()}
    assert names == set(features.feature_names(6)) and long.count() == 2 * 187
    assert channels.of_groups(long, ["selectivity"]).count() == 2 * 15
    v = channels.legacy_vector(long, "recording_id").first()
    assert len(v.vector) == 187 and v.names == sorted(v.names)


def test_defects_lower_their_subscores(spark):
    s = generators.stress_corpus(spark, 3)
    chan = gathered(s, "recording_id", "defect", "channel").withColumn("recording_id", F.concat_ws("/", "recording_id", "defect")).drop("defect", "t")
    times = gathered(s.where("channel = 'CO'"), "recording_id", "defect").withColumn("recording_id", F.concat_ws("/", "recording_id", "defect")).drop("defect", "v")
    q = quality.quality(chan, quality.declare(times, rate="1D", adc_max="4095D", role="'exposure'", baseline="'auto'"))
    scores = study.subscores_long(q, "recording_id").withColumn("defect", F.split("recording_id", "/")[1])
    got = {r.subscore: r.sensitivity for r in study.sensitivity(scores).collect()}
    assert got["continuity"] > 5 and got["saturationFree"] > 1 and got["durationAdequacy"] > 5
    assert generators.stress_corpus(spark, 3).exceptAll(s).isEmpty()


def test_expansion_and_dispatch(spark):
    s = spark.createDataFrame([("r", 0, [1.0, 2.0]), ("r", 1, [3.0, 4.0])], "recording_id string, ch_idx int, v array<double>")
    assert {r.ch_idx: r.v for r in channels.expand_channels(s, 3, [(0, 2)]).collect()} == {0: [0.0, 0.0], 1: [0.0, 0.0], 2: [1.0, 2.0]}
    assert channels.canonical_order(["x", "CO", "NO2"]) == ["NO2", "CO", "x"]
    two = spark.createDataFrame([("a", "c", "mox", [1.0, 2.0, 3.0], [0.0, 1.0, 2.0], 3), ("b", "c", "miris", [1.0], [0.0], 1)], "recording_id string, channel string, sensor_type string, v array<double>, t array<double>, n long")
    assert {r.recording_id: r.error for r in channels.run_processor(two).collect()} == {"a": None, "b": "unsupported sensor type miris"}
    with pytest.raises(channels.UnsupportedSensorTypeError):
        channels.run_processor(two, strict=True)


def test_records(spark):
    df = spark.createDataFrame([("Boils at 78.3 ± 0.2 °C", '{"a": ["x", {"b": "999 °C"}, "80 °C"]}'), ("none", "not json")], "t string, j string")
    got = df.select(enrichment.boiling_point(F.col("t")).alias("t"), enrichment.boiling_point_of_json(F.col("j")).alias("j")).collect()
    assert (got[0].t, got[0].j, got[1].t, got[1].j) == (78.3, 80.0, None, None)


def test_manifest(spark):
    text = '{"sensor": {"sensorType": "mox", "channels": [{"id": "a"}], "samplingRateHz": 5, "calibration": {"a": {"a": 1, "b": -0.5}}}, "session": {"role": "exposure"}, "other": {"k": 1}}'
    r = spark.createDataFrame([("p", text)], "path string, manifest string")
    d = manifest.declarations(r).first()
    assert (d.rate, d.role, d.baseline) == (5.0, "exposure", "none")
    assert manifest.calibration_of(r).first().b == -0.5
    assert r.select(manifest.extra(F.col("manifest")).alias("e")).first().e == {"other": '{"k":1}'}
    assert "adcMax" not in r.select(manifest.to_json(manifest.from_json(F.col("manifest"))).alias("j")).first().j


def test_user_dictionary(spark):
    mine = molecules.from_smiles(spark.createDataFrame([("CCO",), ("CCCCO",)], "smiles string"))
    saved = molecules.save_user_entries(mine, mine.where("name = 'CCO'"))
    assert saved.count() == 2 and molecules.save_user_entries(mine, saved, 1).count() == 1


def test_lookup(spark, capsys):
    assert lookup.main(["ethanol", "--library", "Ethyl alcohol, tea"], spark) == 0 and lookup.main(["CCCO"], spark) == 0
    assert lookup.main(["--mix", "ethanol:0.5,CCCO:0.5"], spark) == 0 and lookup.main(["qqq zzz"], spark) == 3
    assert lookup.main(["--mix", "x"], spark) == 2 and lookup.main([], spark) == 2
    assert "green" in capsys.readouterr().out


def test_catalogue_is_whole(spark):
    ids = {r[1] for r in catalogue.compound_rows()}
    assert len(ids) == 48 and len(catalogue.composite_rows()) == 26 and catalogue.technologies(spark).count() == 7
    assert all(c in ids for row in catalogue.composite_rows() for c, _, _ in row[-1])
    assert feasibility.with_reasons(feasibility.constituent_chain(catalogue.compounds(spark))).where("id = 'water'").first().r_reactivity.count("baseline shift")


def test_streams(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("recording_id"), F.col("event_type").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), "value")
    e.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    for name, out in (("stats", live.windowed_stats(src, length="1 day")), ("sessions", live.sessions(src))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() > 0


def test_normalised_without_baseline_is_nan(spark):
    s = spark.createDataFrame([("r", [1.0, 2.0], None)], "recording_id string, v array<double>, r0 double")
    assert all(x != x for x in baseline.normalised(s).first().x)


def test_recognition_of_recordings(spark, sf):
    """The full vector of rigs with decays and spectra: the one pass equals window by window, and the model names every rig."""
    from vapora.operators import learning, signal, windows
    from vapora.operators.baseline import segment

    w = views.wave(spark, sf).selectExpr("recording_id div 2 AS recording_id", "cast(recording_id % 2 AS int) AS ch_idx", "cast(recording_id % 2 AS string) AS channel", "v", "n").where("recording_id < 12")
    long = w.withColumn("v", F.expr("concat(v, reverse(v), slice(v, 1, 20))")).withColumn("n", F.size("v").cast("long"))
    rows = learning.window_vectors(long, 2)
    got = {r.recording_id: r.asDict() for r in rows.collect()}
    each = segment(features.r0_legacy_normalised(long)).withColumnRenamed("w", "v").withColumn("n", F.size("v").cast("long"))
    each = each.withColumn("recording_id", F.concat_ws("/", "recording_id", "window_id")).drop("window_id")
    stage = channels.framework(each).groupBy(F.split("recording_id", "/")[0].cast("long").alias("recording_id"), "feature").agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    seen = 0
    for r in stage.collect():
        mine = got[r.recording_id]
        assert mine["n_windows"] == r.n == 5
        assert mine[r.feature] == pytest.approx(r.value, rel=1e-5, abs=1e-7), r.feature
        seen += 1
    assert seen == 12 * len(features.feature_names(2)) and signal.NAMES[0] in windows.NAMES
    examples = rows.withColumn("substance", F.when(F.col("recording_id") % 2 == 0, "tea").otherwise("coffee"))
    model = learning.train(examples, "substance", features.feature_names(2), trees=3)
    found = learning.recognise(model, long, 2, needed=2.0).collect()
    assert len(found) == 12 and all(r.substance in ("tea", "coffee") and 0.5 <= r.confidence <= 1 and r.rig_warning for r in found)


def test_window_means_do_not_depend_on_chunks(spark):
    from vapora.operators import windows

    s = spark.createDataFrame([("a", [float((k * 37) % 101) for k in range(1234)]), ("b", [1.0] * 30), ("c", [5.0, float("nan")] * 80), ("d", [])], "k string, v array<double>").withColumn("n", F.size("v").cast("long"))
    m = s.select("k", "n", F.array("v").alias("matrix"))
    whole = {r.k: r for r in windows.mean_vectors(m, False).collect()}
    cut = windows.vector_sums(windows.chunks(m, rows=50), False).groupBy("k").agg(F.sum("n_windows").alias("n"), F.collect_list("sums").alias("s")).collect()
    assert {r.k: r.n_windows for r in whole.values()} == {"a": 114, "b": 1, "c": 7} == {r.k: r.n for r in cut}
    for r in cut:
        for k, x in enumerate(whole[r.k].vector):
            total = sum(v[k] for v in r.s) / r.n
            assert total == pytest.approx(x, rel=1e-9, abs=1e-12) or total != total and x != x
    assert windows.mean_features(s.where("false"), wanted=["auc"]).count() == 0


def test_every_recording_gets_a_prediction(spark, sf):
    from vapora.operators import learning

    got = learning.QUERIES["train_predict"](spark, sf).collect()
    assert sorted(r.recording_id for r in got) == sorted(r.recording_id for r in views.wave(spark, sf).select("recording_id").collect())
    assert all(r.held_out == (r.recording_id % 4 == 0) and r.substance is not None for r in got)


def test_boundaries(spark):
    assert feasibility.boundaries(spark).where("capability").count() == 4
    mixes = feasibility.composite_verdict(catalogue.composites(spark), catalogue.compounds(spark)).withColumn("kind", F.lit("composite"))
    assert feasibility.relevant_boundaries(mixes).first().boundaries == ["mixture"]


def test_quality_cases(spark):
    channels, recordings = generators.quality_cases(spark)
    got = {r.recording_id: r for r in quality.quality(channels, recordings).collect()}
    ideal = got["ideal_exposure_auto"]
    assert len(got) == 12 and all(r.total is not None for r in got.values())
    assert got["dead_channel"].dead_sensors == ["NO2"] and got["dead_channel"].total < ideal.total
    assert got["no_baseline"].signalStrength is None and "no_baseline" in got["no_baseline"].flags and got["single_role"].recoveryCompleteness is None
    assert "used_default_adc_max" in got["ideal_exposure_auto_no_adcmax"].flags and "used_median_sampling_rate" in got["ideal_exposure_auto_no_rate"].flags
    assert got["clipped_signal"].saturationFree < ideal.saturationFree and got["no_recovery"].recoveryCompleteness < ideal.recoveryCompleteness
    assert got["low_span"].dynamicRange < ideal.dynamicRange and got["irregular_gaps"].continuity < ideal.continuity and got["short_exposure"].durationAdequacy < ideal.durationAdequacy


def test_files_are_inspected(spark, tmp_path):
    from vapora.operators import inspection, study
    from vapora.sources import recordings

    rows = "\n".join(f"{k * 100},{100 + k % 7},{50 + k}" for k in range(40))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "good.csv").write_text(f"timestamp_ms,MQ-3,extra\n{rows}\n")
    (tmp_path / "a" / "bad.csv").write_text("# nothing\n")
    r = recordings.read_recordings(spark, str(tmp_path)).cache()
    m = {x.path.rsplit("/", 1)[1]: x for x in inspection.channel_matrix(r, ["extra", "MQ-3"]).collect()}
    assert m["good.csv"].columns == ["extra", "MQ-3"] and m["good.csv"].matrix[0][:2] == [50.0, 51.0] and m["good.csv"].error is None and "ingest failed" in m["bad.csv"].error
    assert "missing channels: nope" in inspection.channel_matrix(r.where("ok"), ["nope"]).first().error
    i = inspection.inspect(r).first()
    assert i.models == {"MQ-3": "MQ-3"} and i.unmodeled == ["extra"] and i.feature_family == "mox"
    v = {x.path.rsplit("/", 1)[1]: x for x in inspection.validate(r).collect()}
    assert v["good.csv"].valid and not v["bad.csv"].valid and len(v["bad.csv"].errors) == 1
    a = {x.path.rsplit("/", 1)[1]: x for x in inspection.analyze(r).collect()}
    assert [f.channel for f in a["good.csv"].features] == ["MQ-3", "extra"] and a["bad.csv"].features is None
    assert inspection.health(r).count() == 2
    with pytest.raises(ValueError):
        inspection.health(r, 0)
    assert {x.half for x in study.half_scores(r).collect()} == {0, 1}


def test_ranks_and_quantiles(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k % 3), float(x)) for k, x in enumerate(rng.integers(0, 50, 2000))]
    df = spark.createDataFrame(rows, "k int, v double")
    got = study_ranks(df)
    for k in range(3):
        v = np.array([x for i, x in rows if i == k])
        want = {x: (v < x).sum() + ((v == x).sum() + 1) / 2 for x in v}
        assert got[k] == want
        q = {r.k: r for r in study.quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.9}).collect()}[k]
        assert q.a == pytest.approx(np.quantile(v, 0.25)) and q.b == pytest.approx(np.quantile(v, 0.9))


def study_ranks(df):
    out = {}
    for r in study.average_rank(df, ["k"], "v", "r").collect():
        out.setdefault(r.k, {})[r.v] = r.r
    return out


def test_user_dictionary_of_names(spark):
    from vapora.operators import hardware, molecules

    rows = lambda ids: spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "ord int, id string")
    saved = molecules.save_user_entries(rows(["a", "b", "a"]), rows(["b"]))
    assert sorted(r.id for r in saved.collect()) == ["a", "b"]
    assert molecules.save_user_entries(rows("abcdef"), rows([]).where("false"), most=4).count() == 4
    assert [r.id for r in molecules.remove_user_entries(saved, rows(["b"])).collect()] == ["a"] and molecules.user_entry(saved, "a").count() == 1
    x = np.random.default_rng(1).normal(size=(200, 6)) * np.array([5, 4, 3, 0.01, 0.01, 0.01])
    assert hardware.effective_rank(spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>"), "v") == 3


def test_singular_values_of_long_and_of_badly_conditioned_vectors(spark):
    from vapora.operators import hardware

    draw = np.random.default_rng(4)
    long = draw.normal(size=(90, 3)) @ draw.normal(size=(3, 5000))
    df = spark.createDataFrame([(r.tolist(),) for r in long], "v array<double>").repartition(3)
    assert hardware.effective_rank(df, "v", 1 - 1e-12) == 3
    q, _ = np.linalg.qr(draw.normal(size=(400, 4)) - 0.0)
    skew = (q - q.mean(axis=0)) * np.array([1.0, 1e-3, 1e-6, 1e-9])
    rows = [("a", r.tolist()) for r in skew] + [("b", [1.0, 2.0, 3.0, 4.0])] + [("c", [1.0, None]), ("c", [3.0, 4.0]), ("c", None), ("c", [5.0])]
    got = {r.k: r for r in hardware.singular_values(spark.createDataFrame(rows, "k string, v array<double>").repartition(5), "v", "k").collect()}
    want = np.linalg.svd(skew - skew.mean(axis=0), compute_uv=False)
    assert np.allclose(got["a"]["values"], want, rtol=1e-6) and got["b"]["values"] == [0.0]
    assert (got["c"].n, got["c"]["values"][0]) == (3, pytest.approx(8**0.5))
    assert hardware.singular_values(df.where("false"), "v").count() == 0 and hardware.effective_rank(df.where("false"), "v") == 1.0


def test_collection_is_parsed_once(spark, sf, monkeypatch):
    """Its recordings are written once and its aggregates read that, not the files."""
    from vapora.sources import recordings as R

    given, report = [], study.collection_report
    monkeypatch.setattr(study, "collection_report", lambda r: given.append(r) or report(r))
    study.QUERIES["collection_report"](spark, sf)
    assert all("/vapora/recordings-" in f for f in given[0].inputFiles()) and given[0].columns == [c.split()[0] for c in R.RECORDING.split(", ")]
