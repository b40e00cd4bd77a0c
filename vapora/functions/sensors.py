"""Sensor models with their power laws, as DataFrames and lookups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Model, family, clean-air ratio, and gas a b of rr = a * C ** b.
MODELS = """
MQ-2|mox|9.83|LPG 17.446954 -0.450045, H2 24.27599 -0.462535, CO 29.461131 -0.321647, Alcohol 21.388648 -0.373832, Propane 19.95886 -0.461255
MQ-3|mox|60.0|Benzene 1.800926 -0.373134, LPG 27.119457 -0.308166, CH4 0.022565 0.052604, CO 31.358021 -0.261712, Alcohol 0.537784 -0.664894, Hexane 23.007626 -0.351
MQ-4|mox|4.4|CH4 11.988916 -0.358938, LPG 14.13783 -0.321234, CO 5.632617 -0.052493, Alcohol 5.879203 -0.071378, Smoke 7.943109 -0.120366
MQ-5|mox|6.5|H2 6.185839 -0.258131, LPG 6.093045 -0.411353, CH4 7.563737 -0.390625, CO 9.481411 -0.171644, Alcohol 10.329909 -0.203335
MQ-6|mox|10.0|CH4 20.769313 -0.395883, H2 23.704429 -0.278009, LPG 18.97965 -0.425532, CO 12.915497 -0.074074, Alcohol 19.034274 -0.166196
MQ-7|mox|27.5|CO 20.642821 -0.658762, H2 21.796273 -0.727802, LPG 14.069111 -0.12982, CH4 20.287334 -0.094877, Alcohol 22.09512 -0.080972
MQ-8|mox|70.0|H2 22169.586802 -1.453488, LPG 174.355045 -0.320205, CH4 121.806949 -0.150015, CO 184.783047 -0.123854, Alcohol 421.117628 -0.537634
MQ-9|mox|9.6|LPG 23.575936 -0.457457, CH4 23.495903 -0.377644, CO 17.295073 -0.445633
MQ-135|mox|3.6|CO 5.088621 -0.254001, Alcohol 3.923626 -0.314465, CO2 5.175137 -0.349406, Toluene 3.018137 -0.290276, NH4 6.494653 -0.404367, Acetone 2.864757 -0.296824
MQ-136|mox|3.6|H2S 2.770893 -0.282805, NH4 6.390276 -0.40404, CO 5.198937 -0.264971
MQ-131|mox|15.0|CL2 25.792179 -0.84317, O3 17.478462 -0.900901
MQ-303A|mox|1.0|Isobutane 1.87998 -0.345543, Hydrogen 1.688527 -0.368189, Ethanol 1.67218 -0.411184
MQ-309A|mox|11.0|H2 42.929865 -0.512558, CH4 60.333013 -0.595238, CO 31.351574 -0.249377, Alcohol 35.990833 -0.274198
TGS8100|mox||
SGP30|cmos_mems||
SGP40|cmos_mems||
BME680|mox||
"""
#: Where the laws of a model were taken from, by rule, and what is published about models without a law.
LAW_SOURCE = "https://github.com/miguel5612/MQSensorsLib/blob/master/examples/{0}/{0}.ino"
DATASHEETS = """
TGS8100 https://www.figarosensor.com/product/docs/TGS8100%280914%29.pdf
TGS8100 http://www.figarosensor.com/feature/tgs8100.html
SGP30 https://sensirion.com/products/catalog/SGP30
SGP40 https://www.sensirion.com/products/catalog/SGP40
BME680 https://www.bosch-sensortec.com/media/boschsensortec/downloads/datasheets/bst-bme680-ds001.pdf
BME680 https://www.bosch-sensortec.com/en/products/environmental-sensors/gas-sensors/bme680
"""
#: Spellings that name a tabulated gas.
GAS_ALIASES = {"C2H5OH": "Alcohol", "ETHANOL": "Alcohol", "ETHYLALCOHOL": "Alcohol"}


class UnknownSensorError(KeyError):
    """No tabulated model has this name, or it has no power law."""


class UnknownGasError(KeyError):
    """The model has no tabulated response to this gas."""


def key(name: str) -> str:
    return re.sub(r"[^A-Z0-9]", "", name.upper())


def _rows() -> list[tuple[str, str, float | None, list[tuple[str, float, float]]]]:
    out = []
    for line in MODELS.strip().splitlines():
        model, family, ratio, gases = line.split("|")
        out.append((model, family, float(ratio) if ratio else None, [(g, float(a), float(b)) for g, a, b in (x.split() for x in gases.split(", ") if x)]))
    return out


def models(spark: SparkSession) -> DataFrame:
    """model, family, clean_air_ratio, power_law, key: 17 rows."""
    return spark.createDataFrame([(m, f, r, bool(g), key(m)) for m, f, r, g in _rows()], "model string, family string, clean_air_ratio double, power_law boolean, key string")


def power_laws(spark: SparkSession) -> DataFrame:
    """model, gas, a, b, key, gas_key: 57 rows."""
    return spark.createDataFrame([(m, g, a, b, key(m), key(g)) for m, _, _, gases in _rows() for g, a, b in gases], "model string, gas string, a double, b double, key string, gas_key string")


def source_rows() -> list[tuple[str, int, str]]:
    sheets = [line.split(" ") for line in DATASHEETS.strip().splitlines()]
    by_law = [(m, LAW_SOURCE.format(m)) for m, _, _, gases in _rows() if gases]
    listed = [*by_law, *sheets]
    return [(m, sum(x == m for x, _ in listed[:k]), url) for k, (m, url) in enumerate(listed)]


def sources(spark: SparkSession) -> DataFrame:
    """model, place and source: what its constants, or their absence, can be verified by."""
    return spark.createDataFrame(source_rows(), "model string, place int, source string")


def key_column(name: Column) -> Column:
    """The spelling-insensitive key of a sensor or gas name."""
    return F.regexp_replace(F.upper(name), "[^A-Z0-9]", "")


def normalise_sensor(names: DataFrame, column: str) -> DataFrame:
    """names with model, family and clean_air_ratio, NULL where no model has that name."""
    table = F.broadcast(models(names.sparkSession)).select("model", "family", "clean_air_ratio", "power_law", F.col("key").alias("_key"))
    return names.withColumn("_key", key_column(F.col(column))).join(table, "_key", "left").drop("_key")


def power_law_of(names: DataFrame, sensor: str, gas: str) -> DataFrame:
    """names with model, gas_name, a and b: the gas by its own spelling, else by its alias; NULL where not tabulated."""
    laws = F.broadcast(power_laws(names.sparkSession)).select("model", F.col("gas").alias("gas_name"), "a", "b", F.col("key").alias("_key"), F.col("gas_key").alias("_gas"))
    alias = F.create_map(*(F.lit(x) for k, v in GAS_ALIASES.items() for x in (k, key(v))))
    rows = names.withColumns({"_key": key_column(F.col(sensor)), "_own": key_column(F.col(gas))}).withColumn("_alias", F.element_at(alias, F.col("_own")))
    own = rows.join(laws.withColumnRenamed("_gas", "_own"), ["_key", "_own"], "left")
    other = laws.select("_key", F.col("_gas").alias("_alias"), *(F.col(c).alias(f"_{c}") for c in ("model", "gas_name", "a", "b")))
    both = own.join(other, ["_key", "_alias"], "left")
    return both.select(*names.columns, *(F.coalesce(c, f"_{c}").alias(c) for c in ("model", "gas_name", "a", "b")))


def model_names() -> list[str]:
    return [m for m, *_ in _rows()]


def lookup_model(name: str) -> str:
    found = {key(m): m for m in model_names()}.get(key(str(name)))
    if found is None:
        raise UnknownSensorError(f"{name!r} is none of {', '.join(model_names())}")
    return found


def lookup_power_law(sensor: str, gas: str) -> tuple[float, float]:
    model = lookup_model(sensor)
    gases = {g: (a, b) for m, _, _, gs in _rows() if m == model for g, a, b in gs}
    if not gases:
        raise UnknownSensorError(f"{model} is a relative channel without a power law")
    by_key = {key(g): v for g, v in gases.items()}
    wanted = key(str(gas))
    found = by_key.get(wanted) or by_key.get(key(GAS_ALIASES.get(wanted, "")))
    if found is None:
        raise UnknownGasError(f"{model} has {', '.join(sorted(gases))}, not {gas!r}")
    return found
