"""Checks of options and inputs at the boundary (driver side)."""

from __future__ import annotations

import math
import os
import re
import unicodedata

HINTS = ("freeform", "double_diamond", "lean_canvas", "retro", "user_journey")
MODES = ("balanced", "max_quality", "max_speed")
MAX_SAFE = 2**53 - 1


def positive_integer(name: str, value) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= MAX_SAFE:
        raise ValueError(f"{name} must be a positive integer")
    return value


def gap(value) -> float:
    if not isinstance(value, (int, float)) or not math.isfinite(value) or value < 0:
        raise ValueError("gap threshold must be finite and not negative")
    return float(value)


def text(name: str, value: str, longest: int) -> str:
    value = value.strip()
    if not 1 <= len(value) <= longest:
        raise ValueError(f"{name} must have 1 to {longest} characters")
    return value


def question(value: str) -> str:
    return text("question", value, 2000)


def topic(value: str) -> str:
    return text("topic", value, 200)


def board_key(value: str) -> str:
    value = value.strip()
    if not re.fullmatch(r"[A-Za-z0-9]{6,128}", value):
        raise ValueError("a board key is 6 to 128 ASCII letters and digits")
    return value


def custom_phases(values: list[str]) -> list[str]:
    """1 to 12 names of 1 to 80 characters, distinct after NFKC and lower case."""
    if not 1 <= len(values) <= 12:
        raise ValueError("between 1 and 12 phases")
    out, seen = [], set()
    for v in values:
        v = text("phase", v, 80)
        canonical = unicodedata.normalize("NFKC", v).lower()
        if canonical in seen:
            raise ValueError(f"phase names must be unique: {v}")
        seen.add(canonical)
        out.append(v)
    return out


def choice(name: str, value: str, of: tuple[str, ...]) -> str:
    if value not in of:
        raise ValueError(f"{name} must be one of {', '.join(of)}")
    return value


def compare_to(value: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= 19:
        raise ValueError("compare_to must be 1 to 19")
    return value


def read_int(name: str, fallback: int, least: int) -> int:
    """An integer setting from the environment; the fallback if absent, malformed or too small."""
    raw = os.environ.get(name, "").strip()
    return int(raw) if re.fullmatch(r"[+-]?\d+", raw) and int(raw) >= least else fallback


def read_bool(name: str, fallback: bool) -> bool:
    raw = os.environ.get(name, "").strip().lower()
    return True if raw in ("1", "true", "yes", "on") else False if raw in ("0", "false", "no", "off") else fallback
