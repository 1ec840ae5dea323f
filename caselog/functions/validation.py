"""Checks of user parameters, made before any plan is built."""

from __future__ import annotations

from numbers import Real


def non_blank(value, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must be a non-empty string, got: {value!r}")
    return value.strip()


def model_version(value: str | None) -> str | None:
    return None if value is None else non_blank(value, "model_version")


def one_of(value, allowed: tuple[str, ...], name: str) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {allowed}, got: {value!r}")
    return value


def probability(value, name: str = "min_probability") -> float:
    if isinstance(value, bool) or not isinstance(value, Real) or not 0.0 <= float(value) <= 1.0:
        raise ValueError(f"{name} must be a number between 0.0 and 1.0, got: {value!r}")
    return float(value)


def positive_int(value, name: str = "limit") -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{name} must be a positive integer, got: {value!r}")
    return value


def row_limit(value) -> int | None:
    """Optional limit of the report functions: None and 0 both mean all rows."""
    if not value:
        return None
    return positive_int(value)
