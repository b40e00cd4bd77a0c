"""Registry of the engine's own queries and their oracle SQL."""

from __future__ import annotations

from vapora.operators import applied, baseline, calibration, channels, feasibility, features, hardware, inspection, kinetics, learning, molecules, presets, quality, search, segments, signal, study, timing, windows
from vapora.sources import files, recordings

_PARTS = (baseline, features, windows, signal, kinetics, quality, segments, timing, calibration, hardware, feasibility, molecules, search, study, recordings, files, presets, channels, inspection, learning, applied)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in _PARTS:
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
