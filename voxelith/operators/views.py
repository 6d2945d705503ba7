"""Array views: cells with axes, shape and transforms, and the region, plane and tile operators over them.

A view's cells are any DataFrame of one BIGINT column an axis and ``value``: an array of a
store, or a table seen as one. Regions are checked when the plan is built; a predicate then
prunes chunks and Spark filters the rest.
"""

from __future__ import annotations

import dataclasses
import functools
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.functions.pixels import convert
from voxelith.functions.transforms import PhysicalROI, PixelRegion, axis_pixel_sizes, physical_to_pixel, pixel_to_physical
from voxelith.sources.errors import RegionError
from voxelith.sources.metadata import TYPES, Axis
from voxelith.sources.store import store_or_new
from voxelith.sources.zarr import chunk_range, validate_region


@dataclass(frozen=True)
class ArrayView:
    """``start`` and ``end`` bound the view within the array's shape; ``load`` reads a box of a store, if it comes from one."""

    cells: DataFrame
    axes: tuple[Axis, ...]
    shape: tuple[int, ...]
    dtype: str
    chunks: tuple[int, ...]
    scale: tuple[float, ...]
    translation: tuple[float, ...]
    start: tuple[int, ...] = ()
    end: tuple[int, ...] = ()
    load: Callable[[tuple, tuple], DataFrame] | None = None
    #: Partial aggregates of a box by some axes, made where chunks are read, if the view comes from a store: see ``partials``.
    summary: Callable[[tuple, tuple, dict[str, int]], DataFrame] | None = None
    #: The cells as they came from the store; a view whose cells were replaced is read no other way.
    origin: DataFrame | None = None
    #: The store and array that a whole view shows, and sums under a label array of the same store: see ``under``.
    source: tuple[str, str] | None = None
    masked: Callable[[tuple, tuple, str], DataFrame] | None = None

    def __post_init__(self):
        if not self.start:
            object.__setattr__(self, "start", (0,) * len(self.shape))
            object.__setattr__(self, "end", self.shape)

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(a.name for a in self.axes)

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def extent(self) -> tuple[int, ...]:
        return tuple(e - s for s, e in zip(self.start, self.end, strict=True))

    @property
    def element_count(self) -> int:
        return math.prod(self.extent)

    @property
    def width(self) -> int:
        """Cells along x, else along the last axis."""
        return self.extent[self.names.index("x") if "x" in self.names else -1]

    @property
    def height(self) -> int:
        return self.extent[self.names.index("y") if "y" in self.names else max(-2, -self.rank)]

    def __str__(self) -> str:
        return f"{self.dtype} " + " x ".join(f"{n}={e}" for n, e in zip(self.names, self.extent, strict=True))

    # --- regions

    def region(self, start, end) -> ArrayView:
        """The half-open box [start, end)."""
        start, end = validate_region(self.shape, start, end)
        stored = self.cells is self.origin
        cells = self.load(start, end) if self.load and (stored or self.origin is None) else self.cells
        box = [(F.col(n) >= s) & (F.col(n) < e) for n, s, e, size in zip(self.names, start, end, self.shape, strict=True) if s > 0 or e < size]
        cells = cells.where(functools.reduce(lambda a, b: a & b, box)) if box else cells
        return dataclasses.replace(self, cells=cells, origin=cells if stored else self.origin, start=start, end=end)

    def pixel_region(self, box: PixelRegion) -> ArrayView:
        return self.region(box.start, box.end)

    def physical_roi(self, roi: PhysicalROI) -> ArrayView:
        """The pixels that a box in physical units touches; outside, the nearest."""
        return self.pixel_region(physical_to_pixel(roi, self.scale, self.translation, self.shape))

    def physical_extent(self) -> PhysicalROI:
        return pixel_to_physical(PixelRegion((0,) * self.rank, self.shape), self.scale, self.translation)

    def pixel_sizes(self) -> dict[str, float]:
        return axis_pixel_sizes(self.axes, self.scale)

    def _picked(self, **index: int | None) -> tuple[list[int], list[int]]:
        start, end = [0] * self.rank, list(self.shape)
        for name, i in index.items():
            if i is not None and name in self.names:
                k = self.names.index(name)
                start[k], end[k] = i, i + 1
        return start, end

    def plane(self, t: int | None = 0, c: int | None = 0, z: int | None = 0) -> ArrayView:
        """One index of t, c and z, or all of an axis for None; other axes whole. The rank stays."""
        return self.region(*self._picked(t=t, c=c, z=z))

    def plane_5d(self, t: int, c: int, z: int) -> ArrayView:
        return self.plane(t, c, z)

    def plane_4d(self, c: int, z: int) -> ArrayView:
        return self.plane(None, c, z)

    def plane_3d(self, z: int) -> ArrayView:
        return self.plane(None, None, z)

    def plane_2d(self) -> ArrayView:
        return self.plane(None, None, None)

    def tile(self, *, y: int, x: int, height: int, width: int, t: int | None = 0, c: int | None = 0, z: int | None = 0, mode: str = "clamp") -> ArrayView:
        """A tile of y and x. ``clamp`` moves everything into the array and is never empty; ``strict`` refuses what lies outside."""
        if mode not in ("clamp", "strict"):
            raise ValueError(f"mode {mode!r}")
        if mode == "strict" and (height <= 0 or width <= 0):
            raise RegionError(f"a tile of {height} x {width}")
        if mode == "clamp":
            hold = lambda i, n: None if i is None or n not in self.names else max(0, min(i, self.shape[self.names.index(n)] - 1))
            t, c, z = hold(t, "t"), hold(c, "c"), hold(z, "z")
        start, end = self._picked(t=t, c=c, z=z)
        for name, at, size in (("y", y, height), ("x", x, width)):
            if name not in self.names:
                continue
            k = self.names.index(name)
            n = self.shape[k]
            if mode == "clamp":
                start[k] = max(0, min(at, n - 1))
                end[k] = min(n, max(start[k] + 1, at + size))
            else:
                start[k], end[k] = max(0, at), min(n, at + size)
        return self.region(start, end)

    def plane_physical(self, t: float | None = None, c: float | None = None, z: float | None = None, y: float | None = None, x: float | None = None, height: float | None = None, width: float | None = None) -> ArrayView:
        """By physical origin: one pixel's size of t, c and z from 0 or the given origin; y and x from 0, whole unless sized."""
        whole = self.physical_extent()
        given, sizes = {"t": t, "c": c, "z": z, "y": y, "x": x}, {"y": height, "x": width}
        origin, size = [], []
        for k, n in enumerate(self.names):
            origin.append(float(given.get(n) or 0.0))
            size.append(self.scale[k] if n in ("t", "c", "z") else float(whole.size[k] if sizes.get(n) is None else sizes[n]))
        return self.physical_roi(PhysicalROI(tuple(origin), tuple(size)))

    def partials(self, by: dict[str, int]) -> DataFrame | None:
        """(<axis> div <size> of ``by``, min_v, max_v, sum_v, n): one row for each chunk and group, to be aggregated again; none if cells are all there is."""
        return self.summary(self.start, self.end, by) if self.summary and self.cells is self.origin else None

    def under(self, labels: ArrayView) -> DataFrame | None:
        """(label, sum_v, n) of each chunk's values under labels that lie on the same grid of the same store, read chunk by chunk with them; none otherwise."""
        if not (self.masked and self.cells is self.origin and labels.origin is not None and labels.cells is labels.origin):
            return None
        if self.source[0] != labels.source[0] or labels.extent != labels.shape:
            return None
        size = dict(zip(self.names, self.shape, strict=True))
        if any(size.get(n) != k for n, k in zip(labels.names, labels.shape, strict=True)):
            return None
        return self.masked(self.start, self.end, labels.source[1])

    # --- shapes of the result

    def squeeze(self) -> ArrayView:
        """Without the axes of one cell."""
        keep = [k for k, n in enumerate(self.extent) if n > 1] or [self.rank - 1]
        pick = lambda x: tuple(x[k] for k in keep)
        names = [self.names[k] for k in keep]
        return dataclasses.replace(self, cells=self.cells.select(*names, "value"), axes=pick(self.axes), shape=pick(self.shape), chunks=pick(self.chunks), scale=pick(self.scale), translation=pick(self.translation), start=pick(self.start), end=pick(self.end), load=None, summary=None, origin=None, source=None, masked=None)

    def densify(self, fill: float | int = 0) -> DataFrame:
        """Every cell of the view, absent ones with ``fill``: the grid of axes, left-joined to the cells."""
        spark = self.cells.sparkSession
        grid = spark.range(self.start[0], self.end[0]).select(F.col("id").alias(self.names[0]))
        for n, s, e in zip(self.names[1:], self.start[1:], self.end[1:], strict=True):
            grid = grid.withColumn(n, F.explode(F.sequence(F.lit(s).cast("long"), F.lit(e - 1).cast("long"))))
        kind = dict(self.cells.dtypes)["value"]
        return grid.join(self.cells, list(self.names), "left").select(*self.names, F.coalesce("value", F.lit(fill).cast(kind)).alias("value"))

    def flat_index(self) -> Column:
        """A cell's position in the whole array, last axis fastest."""
        out, stride = F.lit(0).cast("long"), 1
        for n, size in reversed(list(zip(self.names, self.shape, strict=True))):
            out, stride = out + F.col(n) * stride, stride * size
        return out

    def chunk_columns(self) -> list[Column]:
        """The chunk of a cell: one column c<axis> an axis."""
        return [F.expr(f"`{n}` div {c}").alias(f"c{n}") for n, c in zip(self.names, self.chunks, strict=True)]

    def chunk_cells(self) -> DataFrame:
        """Chunks that the view touches, with how many of its cells each has."""
        return self.cells.groupBy(*self.chunk_columns()).agg(F.count(F.lit(1)).alias("n_cells"))

    def chunk_count(self) -> int:
        lo, hi = chunk_range(self.start, self.end, self.chunks)
        return math.prod(b - a for a, b in zip(lo, hi, strict=True))

    def as_1d(self) -> DataFrame:
        """One row with all values in order: for results of a size that one row can hold."""
        ordered = F.sort_array(F.collect_list(F.struct(self.flat_index().alias("i"), "value")))
        return self.cells.agg(F.transform(ordered, lambda s: s["value"]).alias("values"))

    def as_2d(self) -> DataFrame:
        """One row for each index of the first of two axes, values in order of the second."""
        if self.rank != 2:
            raise RegionError(f"a view of rank {self.rank}; squeeze() drops single axes")
        y, x = self.names
        ordered = F.sort_array(F.collect_list(F.struct(F.col(x).alias("i"), "value")))
        return self.cells.groupBy(y).agg(F.transform(ordered, lambda s: s["value"]).alias("values"))

    def to_pixels(self, format: str = "native", name: str = "pixel") -> DataFrame:
        """Cells with their value in a pixel format."""
        return self.cells.select(*self.names, convert(F.col("value"), self.dtype, format).alias(name))

    def to_raw(self, folder: str, part_cells: int = 1 << 24) -> DataFrame:
        """Writes the view's bytes, little-endian, last axis fastest, as files part-000000000000.raw and on of ``part_cells`` cells each; (part, n_bytes) of each.

        Each part is one task's, so that a view of any size is exported without the driver; absent
        cells are 0. The files in order of their names make up the whole. The folder must be there.
        """
        kind, total, names = TYPES[self.dtype].numpy, self.element_count, self.names
        at, stride = F.lit(0).cast("long"), 1
        for n, s, size in reversed(list(zip(names, self.start, self.extent, strict=True))):
            at, stride = at + (F.col(n) - s) * stride, stride * size
        spark = self.cells.sparkSession
        parts = spark.range(-(-total // part_cells)).select(F.col("id").alias("part"), F.lit(None).cast("long").alias("at"), F.lit(None).cast(dict(self.cells.dtypes)["value"]).alias("value"))
        cells = self.cells.select(F.lit(0).cast("long").alias("part"), at.alias("at"), "value").withColumn("part", F.floor(F.col("at") / part_cells))

        def write(table: pa.Table) -> pa.Table:
            part = table["part"][0].as_py()
            table = table.filter(table["at"].is_valid())
            out = np.zeros(min(part_cells, total - part * part_cells), kind)
            if len(table):
                values = table["value"].combine_chunks()
                values = values.cast(pa.uint64()) if pa.types.is_decimal(values.type) else values
                out[np.asarray(table["at"]) - part * part_cells] = np.asarray(values).astype(kind)
            store_or_new(folder).write(f"part-{part:012d}.raw", out.tobytes())
            return pa.table({"part": pa.array([part], pa.int64()), "n_bytes": pa.array([out.nbytes], pa.int64())})

        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return parts.unionByName(cells).repartition(n, "part").groupBy("part").applyInArrow(write, "part long, n_bytes long")

    def to_dense(self):
        """A NumPy array of the view on the driver: for small views."""
        out = np.zeros(self.extent, TYPES[self.dtype].numpy)
        rows = self.cells.toPandas()
        if len(rows):
            out[tuple(rows[n].to_numpy() - s for n, s in zip(self.names, self.start, strict=True))] = rows["value"].astype(TYPES[self.dtype].numpy)
        return out

    def to_bytes(self) -> bytes:
        """The view's bytes, little-endian, last axis fastest: for small views."""
        return self.to_dense().tobytes()
