"""Sizes as text."""

from __future__ import annotations

import re


def human_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024 or unit == "TB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    raise AssertionError


def memory_list(text: str) -> list[float]:
    """MB of each size in a list such as "512MB,1GB,2048"; a bare number is MB."""
    out = []
    for part in filter(None, (x.strip() for x in text.split(","))):
        m = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)\s*(KB|MB|GB|TB)?", part, re.I)
        if not m:
            raise ValueError(f"{part!r} is no size")
        out.append(float(m[1]) * {"KB": 1 / 1024, "MB": 1.0, "GB": 1024.0, "TB": 1024.0**2}[(m[2] or "MB").upper()])
    return out
