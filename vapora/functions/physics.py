"""Vapour transport and headspace chemistry as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gas constant, atmosphere in Pa, Pa per mmHg, air's molar mass and diffusion volume, ambient K.
R, ATM, MMHG, AIR_M, AIR_V, AMBIENT_K = 8.314, 101325.0, 133.322, 28.97, 20.1, 298.15


def antoine(a: Column, b: Column, c: Column, celsius: Column | float) -> Column:
    return F.pow(F.lit(10.0), a - b / (F.lit(celsius) + c if isinstance(celsius, float) else celsius + c)) * MMHG


def clausius_clapeyron(kelvin: Column | float, boiling_k: Column, enthalpy: Column) -> Column:
    t = F.lit(kelvin) if isinstance(kelvin, float) else kelvin
    return F.exp(-(enthalpy / R) * (1.0 / t - 1.0 / boiling_k)) * ATM


def trouton(boiling_k: Column) -> Column:
    return boiling_k * 88.0


def evaporation_flux(pa: Column, kg_mol: Column, kelvin: float = AMBIENT_K) -> Column:
    return pa / F.sqrt(kg_mol * (2 * math.pi * R * kelvin))


def fuller(molar_mass: Column, volume: Column, kelvin: float = AMBIENT_K, atm: float = 1.0) -> Column:
    """Diffusion coefficient in air, m2/s."""
    mixed = F.pow(F.lit(AIR_V ** (1 / 3)) + F.pow(volume, F.lit(1 / 3)), F.lit(2.0)) * atm
    return F.lit(0.00143 * kelvin**1.75) / mixed * F.sqrt(F.lit(1 / AIR_M) + 1.0 / molar_mass) * 1e-4


def diffusion_volume(molar_mass: Column) -> Column:
    return molar_mass * 1.1


def concentration_at(rate: Column, diffusion: Column, metres: Column) -> Column:
    return rate / (diffusion * metres * (4 * math.pi))


def incident_flux(concentration: Column, kg_mol: Column, kelvin: float = AMBIENT_K) -> Column:
    return concentration * F.sqrt(F.lit(R * kelvin) / (kg_mol * (2 * math.pi)))


def flux_share(pa: Column, molar_mass: Column) -> Column:
    """Incident flux up to a factor that all compounds share; an unknown molar mass counts as 50 g/mol."""
    m = F.coalesce(molar_mass, F.lit(50.0))
    volume = F.coalesce(diffusion_volume(molar_mass), F.lit(55.0))
    return pa / (m / 1000.0 * fuller(m, volume))


def band(value: Column, bands: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first lower bound that value reaches."""
    out = F.when(F.lit(False), "")
    for low, label in bands:
        out = out.when(value >= low, label)
    return out.otherwise(otherwise)


#: Lower bounds of the bands.
VOLATILITY = [(10000.0, "very high"), (1000.0, "high"), (100.0, "moderate"), (1.0, "low"), (0.0, "negligible")]
HEADSPACE = [(1000.0, "strong"), (100.0, "moderate"), (10.0, "weak"), (1.0, "marginal"), (0.0, "none")]
SIGNAL = [(1.0, "strong"), (0.1, "moderate"), (0.01, "weak"), (0.001, "marginal"), (0.0, "none")]


def volatility_label(pa: Column) -> Column:
    return F.when(pa.isNull(), "unknown").otherwise(band(pa, VOLATILITY, "unknown"))


def headspace_band(ppm: Column) -> Column:
    return band(ppm, HEADSPACE, "none")


def signal_band(ratio: Column) -> Column:
    return band(ratio, SIGNAL, "none")
