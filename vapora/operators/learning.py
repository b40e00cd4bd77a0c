"""Recognition of substances from feature vectors: a pipeline of standardisation and a random forest."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vapora.operators import windows
from vapora.operators.features import CLOSED, closed_form, feature_names, r0_legacy_normalised
from vapora.plans import views
from vapora.sources import scratch

LOW, MODERATE = 0.5, 0.7


def vectors(series: DataFrame, sr: float = 10.0) -> DataFrame:
    """series (keys, v, n) with its closed-form features as columns."""
    keys = [c for c in series.columns if c not in ("t", "v", "n")]
    return closed_form(series, sr).select(*keys, *CLOSED)


def train(examples: DataFrame, label: str, features: list[str], trees: int = 200, seed: int = 42) -> PipelineModel:
    """A fitted pipeline; classes weigh alike, whatever their counts."""
    counts = examples.groupBy(label).count()
    total = counts.agg(F.sum("count").alias("total"), F.count("*").alias("classes"))
    weights = counts.join(F.broadcast(total)).select(label, (F.col("total") / (F.col("classes") * F.col("count"))).alias("weight"))
    stages = [StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=features, outputCol="raw_vector", handleInvalid="keep"), StandardScaler(inputCol="raw_vector", outputCol="vector", withMean=True), RandomForestClassifier(labelCol="label_index", featuresCol="vector", weightCol="weight", numTrees=trees, seed=seed)]
    return Pipeline(stages=stages).fit(examples.join(F.broadcast(weights), label))


def predict(model: PipelineModel, rows: DataFrame, *keys: str) -> DataFrame:
    """keys, substance, confidence and a warning below the confidence limits."""
    labels = F.array(*(F.lit(x) for x in model.stages[0].labels))
    unlabelled = PipelineModel(stages=model.stages[1:])
    p = unlabelled.transform(rows).withColumn("p", vector_to_array("probability"))
    out = p.select(*keys, labels[F.col("prediction").cast("int")].alias("substance"), F.array_max("p").alias("confidence"))
    return out.withColumn("warning", F.when(F.col("confidence") < LOW, "Low confidence").when(F.col("confidence") < MODERATE, "Moderate confidence"))


def window_vectors(series: DataFrame, channels: int, sr: float = 10.0) -> DataFrame:
    """Recordings (recording_id, ch_idx, v, n) with as many channels: n_windows and the full mean vector over their windows, a column for each feature.

    Every channel is taken relative to its legacy baseline first; a mean that isn't a number is 0.
    """
    rigs = windows.rigs(r0_legacy_normalised(series)).where(F.size("matrix") == channels)
    means = windows.mean_vectors(rigs, True, sr)
    clean = lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    return means.select("recording_id", "n_windows", *(clean(F.col("vector")[k]).alias(f) for k, f in enumerate(feature_names(channels))))


def recognise(model: PipelineModel, series: DataFrame, channels: int, needed: float | None = None, sr: float = 10.0) -> DataFrame:
    """Recordings (recording_id, ch_idx, v, n) through normalisation, windows, the full mean vector and the model, with the rig's warning.

    The windows and all their features are one Arrow pass; only a vector for each recording is shuffled.
    """
    from vapora.operators import hardware

    rigs = series.groupBy("recording_id").agg(F.count("*").alias("n_channels")).withColumns({"stored_dims": F.lit(needed).cast("double"), "n_features": F.lit(None).cast("int"), "n_classes": F.lit(len(model.stages[0].labels))})
    rows = window_vectors(series, channels, sr)
    return predict(model, rows, "recording_id", "n_windows").join(hardware.rig_gate(rigs).select("recording_id", F.col("warning").alias("rig_warning")), "recording_id")


def _q_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("recording_id"), F.col("label").cast("string").alias("substance"))
    rows = vectors(views.wave(spark, sf_dir)).join(labels, "recording_id")
    rows = rows.withColumn("held_out", F.col("recording_id") % 4 == 0)
    model = train(rows.where("not held_out"), "substance", list(CLOSED))
    return predict(model, rows.drop("substance"), "recording_id", "held_out")


def _q_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rigs of four channels, each with its spectrum and decay, named by a forest that three quarters of them have trained."""
    w = views.wave(spark, sf_dir).selectExpr("recording_id div 4 AS recording_id", "cast(recording_id % 4 AS int) AS ch_idx", "v", "n")
    labels = views.table(spark, sf_dir, "embeddings").where("vec_id % 4 = 0").select((F.col("vec_id") / 4).cast("long").alias("recording_id"), F.col("label").cast("string").alias("substance"))
    examples = scratch.stored(window_vectors(w.where("recording_id % 4 <> 0"), 4).join(labels, "recording_id"), "examples")
    model = train(examples, "substance", feature_names(4), 50)
    return recognise(model, w, 4).select("recording_id", "n_windows", "substance", "confidence", (F.col("recording_id") % 4 == 0).alias("held_out"), F.col("rig_warning").isNotNull().alias("warned"))


QUERIES = {"train_predict": _q_train, "recognition": _q_recognition}
ORACLE_SQL: dict[str, str] = {}
