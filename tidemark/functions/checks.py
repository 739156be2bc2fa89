"""Argument checks on the driver."""

from __future__ import annotations

import math
from datetime import datetime


def whole(value: object, name: str, low: int = 1, high: int | None = None) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be a whole number of at least {low}" + (f" and at most {high}" if high is not None else ""))
    return value


def finite(value: object, name: str, low: float = -math.inf, high: float = math.inf) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value) or not low <= value <= high:
        raise ValueError(f"{name} must be a finite number between {low} and {high}")
    return float(value)


def text(value: object, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must not be blank")
    return value


def utc(value: str, name: str) -> datetime:
    found = datetime.fromisoformat(value)
    if found.tzinfo is None or found.utcoffset().total_seconds():
        raise ValueError(f"{name} must be a UTC time")
    return found
