"""Coordinate transforms between indices and physical units: exact IEEE doubles, in a fixed order of operations."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelith.sources.errors import MetadataError, RegionError, UnsupportedError
from voxelith.sources.metadata import Axis, Dataset, Multiscale, Transform


@dataclass(frozen=True)
class PixelRegion:
    """A half-open box of indices."""

    start: tuple[int, ...]
    end: tuple[int, ...]

    def __post_init__(self):
        if len(self.start) != len(self.end) or not self.start:
            raise RegionError("start and end must have one value for each axis")
        if any(e <= s for s, e in zip(self.start, self.end, strict=True)):
            raise RegionError(f"an empty axis in {self}")

    def __str__(self) -> str:
        return "[" + ", ".join(f"{s}:{e}" for s, e in zip(self.start, self.end, strict=True)) + "]"


@dataclass(frozen=True)
class PhysicalROI:
    """A box in physical units: its origin and sizes, which are positive."""

    origin: tuple[float, ...]
    size: tuple[float, ...]

    def __post_init__(self):
        if len(self.origin) != len(self.size) or not self.origin:
            raise RegionError("origin and size must have one value for each axis")
        if not all(s > 0 for s in self.size):
            raise RegionError(f"a size of {self} is not positive")

    def __str__(self) -> str:
        return "[" + ", ".join(f"{o}+{s}" for o, s in zip(self.origin, self.size, strict=True)) + "]"


def composed(dataset: Dataset, scale: Multiscale | None) -> tuple[Transform, ...]:
    """A level's own transforms first, then the pyramid's."""
    return dataset.transforms + (scale.transforms if scale else ())


def flatten(transforms: Sequence[Transform], rank: int) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """(scale, translation) that a list of transforms amounts to."""
    k, t = [1.0] * rank, [0.0] * rank
    for step in transforms:
        if step.type == "identity":
            continue
        if step.type not in ("scale", "translation"):
            raise UnsupportedError(f"transform {step.type!r}")
        if step.values is None or len(step.values) != rank or None in step.values:
            raise MetadataError(f"a {step.type} needs {rank} values, not {step.values}")
        if step.type == "scale":
            t, k = [a * s for a, s in zip(t, step.values, strict=True)], [a * s for a, s in zip(k, step.values, strict=True)]
        else:
            t = [a + v for a, v in zip(t, step.values, strict=True)]
    return tuple(k), tuple(t)


def to_physical(index, scale: float, translation: float):
    """Index to physical position; numbers or Columns."""
    return index * scale + translation


def to_index(position, scale: float, translation: float):
    return (position - translation) / scale


def pixel_range(origin: float, size: float, scale: float, translation: float, length: int) -> tuple[int, int]:
    """Pixels that a physical interval touches, clipped to the axis and never empty: outside, it snaps to the nearest."""
    start = max(0, math.floor(to_index(origin, scale, translation)))
    end = min(length, math.ceil(to_index(origin + size, scale, translation)))
    if end <= start:
        end = min(start + 1, length)
        if end <= start:
            start = max(0, end - 1)
    return start, end


def pixel_range_columns(origin: Column, size: Column, scale: Column, translation: Column, length: Column) -> tuple[Column, Column]:
    """pixel_range for rows of ROIs."""
    first = F.greatest(F.lit(0).cast("long"), F.floor(to_index(origin, scale, translation)))
    last = F.least(length.cast("long"), F.ceil(to_index(origin + size, scale, translation)))
    widened = F.when(last <= first, F.least(first + 1, length.cast("long"))).otherwise(last)
    return F.when(widened <= first, F.greatest(F.lit(0).cast("long"), widened - 1)).otherwise(first), widened


def physical_to_pixel(roi: PhysicalROI, scale: Sequence[float], translation: Sequence[float], shape: Sequence[int]) -> PixelRegion:
    if len(roi.origin) != len(shape):
        raise RegionError(f"an ROI of {len(roi.origin)} axes for an array of {len(shape)}")
    ranges = [pixel_range(*v) for v in zip(roi.origin, roi.size, scale, translation, shape, strict=True)]
    return PixelRegion(tuple(s for s, _ in ranges), tuple(e for _, e in ranges))


def pixel_to_physical(region: PixelRegion, scale: Sequence[float], translation: Sequence[float]) -> PhysicalROI:
    origin = [to_physical(s, k, t) for s, k, t in zip(region.start, scale, translation, strict=True)]
    size = [abs(to_physical(e, k, t) - o) for e, k, t, o in zip(region.end, scale, translation, origin, strict=True)]
    return PhysicalROI(tuple(origin), tuple(size))


def axis_pixel_sizes(axes: Sequence[Axis], scale: Sequence[float]) -> dict[str, float]:
    """Pixel sizes by axis name; 1 for axes that are not space."""
    return {a.name: (s if a.type in (None, "space") and a.name in "zyx" or a.type == "space" else 1.0) for a, s in zip(axes, scale, strict=True)}


#: Names and signs of units. Fixed values.
UNITS = {
    "angstrom": "angstrom å",
    "nanometer": "nm nanometer nanometers nanometre nanometres",
    "micrometer": "µm μm um micrometer micrometers micrometre micrometres micron microns",
    "millimeter": "mm millimeter millimeters millimetre millimetres",
    "centimeter": "cm centimeter centimeters centimetre centimetres",
    "meter": "m meter meters metre metres",
    "inch": "in inch inches",
    "foot": "ft foot feet",
    "nanosecond": "ns nanosecond nanoseconds",
    "microsecond": "µs μs us microsecond microseconds",
    "millisecond": "ms millisecond milliseconds",
    "second": "s sec second seconds",
    "minute": "min minute minutes",
    "hour": "h hr hour hours",
    "day": "d day days",
}
_BY_SIGN = {sign: name for name, signs in UNITS.items() for sign in signs.split()}


def parse_unit(text: str | None) -> str:
    """A unit's name; dimensionless for none, unknown for others."""
    return "dimensionless" if not text else _BY_SIGN.get(text.strip().lower(), "unknown")


def unit_column(unit: Column) -> Column:
    """parse_unit of a column, by a literal map."""
    known = F.create_map(*[F.lit(x) for pair in _BY_SIGN.items() for x in pair])
    return F.when(F.coalesce(unit, F.lit("")) == "", "dimensionless").otherwise(F.coalesce(known[F.lower(F.trim(unit))], F.lit("unknown")))
