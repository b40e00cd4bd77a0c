"""Parsing of looked-up property records; fetching them is left to the caller, off by default."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plausible boiling points in C, exclusive.
BOUNDS = (-200.0, 600.0)
_BOIL = r"(-?\d+(?:\.\d+)?)\s*(?:±\s*\d+(?:\.\d+)?\s*)?°?\s*C\b"


def boiling_point(text: Column) -> Column:
    """The first temperature in C of a text, which may carry a tolerance; NULL without one."""
    return F.regexp_extract(text, f"(?i){_BOIL}", 1).try_cast("double")


def find_boiling_point(document: object) -> float | None:
    """The first plausible temperature in C among a JSON document's strings, in document order."""
    todo = [document]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            todo += list(x.values())[::-1]
        elif isinstance(x, list):
            todo += x[::-1]
        elif isinstance(x, str) and (m := re.search(_BOIL, x, re.IGNORECASE)) and BOUNDS[0] < float(m[1]) < BOUNDS[1]:
            return float(m[1])
    return None


def boiling_point_of_json(document: Column) -> Column:
    """find_boiling_point() of JSON texts; NULL for what isn't JSON."""

    def one(text: str | None) -> float | None:
        try:
            return find_boiling_point(json.loads(text)) if text else None
        except ValueError:
            return None

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one).astype("float64")

    return F.nanvl(run(document), F.lit(None).cast("double"))


def vapor_pressure_from_boiling_point(celsius: Column) -> Column:
    """Pressure at 25 C by Clausius and Clapeyron with Trouton's enthalpy; NULL unless positive."""
    from vapora.functions import physics

    k = celsius + 273.15
    pa = physics.clausius_clapeyron(physics.AMBIENT_K, k, physics.trouton(k))
    return F.when(pa > 0, pa)
