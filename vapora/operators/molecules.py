"""Queries over molecules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vapora.functions import catalogue
from vapora.functions.smiles import describe


def from_smiles(rows: DataFrame, smiles: str = "smiles", name: str | None = None) -> DataFrame:
    """Provisional compounds of rows' SMILES, in the catalogue's schema; rows that can't be read are left out."""
    d = describe(rows.select(F.col(smiles).alias("_s"), F.col(name or smiles).cast("string").alias("_n")), "_s").where("d.error IS NULL")
    prop = lambda c, source: F.struct(c.alias("value"), F.lit(source).alias("source"))
    return d.select(
        F.lit(0).alias("ord"), F.col("d.id").alias("id"), F.col("_n").alias("name"), F.array("_n").alias("synonyms"), prop(F.col("d.molecular_weight"), "estimated").alias("molecular_weight"), prop(F.col("d.boiling_point_c"), "estimated").alias("boiling_point"),
        prop(F.lit(None).cast("double"), "unknown").alias("vapor_pressure"), F.lit(None).cast("struct<a:double,b:double,c:double>").alias("antoine"), F.col("d.groups").alias("groups"), F.col("d.gas").alias("gas"), F.col("d.redox_active").alias("redox_active"),
        F.col("d.non_redox").alias("non_redox"), F.lit(None).cast("string").alias("odor"), F.lit(None).cast("string").alias("cas"), F.col("_s").alias("smiles"), F.lit(True).alias("provisional"),
    )


def save_user_entries(entries: DataFrame, saved: DataFrame, most: int = 200) -> DataFrame:
    """A user dictionary after saving entries: one row per id, what is saved already first, the last `most` kept."""
    both = saved.withColumn("_new", F.lit(0)).unionByName(entries.withColumn("_new", F.lit(1)))
    once = both.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("_new", "ord"))).where("_r = 1")
    return once.orderBy(F.desc("_new"), F.desc("ord")).limit(most).drop("_new", "_r")


def read_user_entries(spark: SparkSession, path: str) -> DataFrame:
    """A user dictionary that was written as Parquet."""
    return spark.read.schema(catalogue.COMPOUND_SCHEMA).parquet(path)


def remove_user_entries(saved: DataFrame, ids: DataFrame) -> DataFrame:
    """saved without the entries of the given ids (id)."""
    return saved.join(ids.select("id").distinct(), "id", "left_anti").select(*saved.columns)


def user_entry(saved: DataFrame, id: str) -> DataFrame:
    """The entry of an id, or no row."""
    return saved.where(F.col("id") == id)


QUERIES: dict = {}  # see applied.py
ORACLE_SQL: dict[str, str] = {}
