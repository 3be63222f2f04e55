"""Conversion of the units that signal axes have."""

from __future__ import annotations

# fixed values: size in the base unit, and dimension (time, or its inverse, or other)
_UNITS = {
    "s": (1.0, "time"), "ms": (1e-3, "time"), "us": (1e-6, "time"), "ns": (1e-9, "time"), "min": (60.0, "time"), "hour": (3600.0, "time"), "day": (86400.0, "time"),
    "Hz": (1.0, "rate"), "kHz": (1e3, "rate"), "MHz": (1e6, "rate"), "GHz": (1e9, "rate"), "THz": (1e12, "rate"),
    "m": (1.0, "length"), "km": (1e3, "length"), "cm": (1e-2, "length"), "mm": (1e-3, "length"),
    "pc cm^-3": (1.0, "dispersion"), "rad": (1.0, "angle"), "deg": (0.017453292519943295, "angle"),
}
_INVERSE = {"s": "Hz", "ms": "kHz", "us": "MHz", "ns": "GHz", "Hz": "s", "kHz": "ms", "MHz": "us", "GHz": "ns"}


def convert(value: float, old: str | None, new: str | None) -> float:
    """``value`` of unit ``old`` in ``new``; ValueError if they measure different things."""
    if old == new:
        return value
    if old not in _UNITS or new not in _UNITS or _UNITS[old][1] != _UNITS[new][1]:
        raise ValueError(f"cannot convert {old!r} to {new!r}")
    return value * _UNITS[old][0] / _UNITS[new][0]


def inverse(unit: str | None) -> str | None:
    """The unit of one over a quantity, as a transform's axis has it."""
    if unit is None:
        return None
    if unit in _INVERSE:
        return _INVERSE[unit]
    return unit[: -len("^-1")] if unit.endswith("^-1") else f"{unit}^-1"
