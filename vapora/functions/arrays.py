"""Spark SQL fragments over a channel's values as an array; every argument is SQL text.

A recording's channel is one array in time order, so per-channel functions need no shuffle beyond the one that gathers it.
"""

from __future__ import annotations

#: Rounding that two engines agree on: floor of the scaled value plus a half, moved off the ties of decimal inputs.
HALF = 0.50037


def snap(x: str, digits: int) -> str:
    """x rounded to digits, the same text in Spark and in the oracle's SQL; never minus zero."""
    return f"(floor(CAST({x} AS DOUBLE) * 1e{digits} + CAST({HALF} AS DOUBLE)) / CAST(1e{digits} AS DOUBLE))"


def bind(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def total(a: str) -> str:
    return f"aggregate({a}, 0D, (s, x) -> s + x)"


def mean(a: str) -> str:
    """Mean, NULL if empty."""
    return f"({total(a)} / nullif(size({a}), 0))"


def std(a: str) -> str:
    """Population standard deviation in one pass, NULL if empty."""
    return (
        f"aggregate({a}, named_struct('n', 0D, 'm', 0D, 'q', 0D), (s, x) -> named_struct('n', s.n + 1D, 'm', s.m + (x - s.m) / (s.n + 1D), "
        "'q', s.q + (x - s.m) * (x - s.m) * s.n / (s.n + 1D)), s -> sqrt(s.q / nullif(s.n, 0D)))"
    )


def median(a: str) -> str:
    """Mean of the middle values, NULL if empty."""
    return bind(f"sort_array({a})", "o", "CASE WHEN size(o) = 0 THEN NULL ELSE (element_at(o, cast((size(o) + 1) div 2 AS int)) + element_at(o, cast(size(o) div 2 + 1 AS int))) / 2D END")


def finite(a: str) -> str:
    return f"filter({a}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"


def absolute(a: str) -> str:
    return f"transform({a}, x -> abs(x))"


def relative(a: str, r0: str) -> str:
    return f"transform({a}, x -> (x - {r0}) / {r0})"


def trapezoid(a: str) -> str:
    """Trapezoid sum over unit steps."""
    return bind(a, "z", f"CASE WHEN size(z) < 2 THEN 0D ELSE {total('z')} - (element_at(z, 1) + element_at(z, -1)) / 2D END")


def steps(a: str) -> str:
    """Differences of neighbours."""
    return bind(a, "z", "CASE WHEN size(z) < 2 THEN cast(array() AS array<double>) ELSE zip_with(slice(z, 2, size(z) - 1), slice(z, 1, size(z) - 1), (p, q) -> p - q) END")


def first_where(a: str, condition: str) -> str:
    """Place from 0 of the first value x that meets the condition, -1 if none does."""
    return f"(array_position(transform({a}, x -> coalesce({condition}, false)), true) - 1)"


def first_largest(a: str) -> str:
    """Place from 0 of the first largest value."""
    return bind(a, "z", "array_position(z, array_max(z)) - 1")


def clamp(x: str) -> str:
    return f"greatest(0D, least(1D, {x}))"


def window_length(n: str) -> str:
    """Rows of the baseline window: 15 % of n, from 5 to 30; 5 without rows."""
    return f"CASE WHEN {n} <= 0 THEN 5 ELSE cast(least(30, greatest(5, floor({n} * 0.15D))) AS int) END"
