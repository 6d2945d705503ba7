"""Pixel conversions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelith.sources.errors import UnsupportedError


def _float_level(value: Column, top: int) -> Column:
    """trunc(clamp(v * top, 0, top)) in the value's own precision; not-a-number is 0."""
    scaled = value * F.lit(top).cast("float")
    held = F.when(scaled < 0, F.lit(0)).when(scaled > top, F.lit(top)).otherwise(scaled)
    return F.when(F.isnan(value), F.lit(0)).otherwise(held.cast("int"))


def gray8(value: Column, dtype: str) -> Column:
    """0 to 255: the top byte of unsigned integers, floats from 0 to 1; other types give 0."""
    if dtype in ("uint8", "uint16", "uint32"):
        return F.shiftrightunsigned(value.cast("long"), {"uint8": 0, "uint16": 8, "uint32": 24}[dtype]).cast("int")
    if dtype in ("float32", "float64"):
        return _float_level(value, 255)
    return F.when(value.isNotNull(), F.lit(0))


def gray16(value: Column, dtype: str) -> Column:
    """0 to 65535: unsigned integers shifted to 16 bits, floats from 0 to 1; other types give 0."""
    if dtype == "uint8":
        return F.shiftleft(value.cast("int"), 8)
    if dtype == "uint16":
        return value.cast("int")
    if dtype == "uint32":
        return F.shiftrightunsigned(value.cast("long"), 16).cast("int")
    if dtype in ("float32", "float64"):
        return _float_level(value, 65535)
    return F.when(value.isNotNull(), F.lit(0))


def bgr24(value: Column, dtype: str) -> Column:
    g = gray8(value, dtype)
    return F.array(g, g, g)


def bgra32(value: Column, dtype: str) -> Column:
    g = gray8(value, dtype)
    return F.array(g, g, g, F.lit(255))


FORMATS = {"native": lambda value, dtype: value, "gray8": gray8, "gray16": gray16, "bgr24": bgr24, "bgra32": bgra32}


def convert(value: Column, dtype: str, format: str = "native") -> Column:
    """A value in one of FORMATS."""
    if format.lower() not in FORMATS:
        raise UnsupportedError(f"pixel format {format!r}")
    return FORMATS[format.lower()](value, dtype)
