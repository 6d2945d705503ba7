"""The Spark data source "zarr": an array's cells or chunks as rows, and cells written back into chunks.

    spark.read.format("zarr").load("/data/image.zarr/0")

Options: ``path`` (store, or store and array), ``array`` (array within the store), ``start`` and
``end`` (comma-separated region), ``axes`` (comma-separated names), ``mode`` (cells, chunks,
partials or masked), ``by`` (for partials: axis:size, comma-separated), ``labels`` (for masked: the
label array in the same store), ``wells`` and ``level`` (cells of a plate's fields), ``fillMode`` (declared or zero), ``partitionBytes`` (decoded bytes of a task) and
``cacheBytes`` (encoded chunks that a worker keeps of a store that is not local; 0 for none).
"""

from __future__ import annotations

import itertools
import json
import math
import urllib.parse
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from voxelith.sources.codecs import EMPTY
from voxelith.sources.errors import CodecError, MetadataError, NodeNotFoundError, RegionError, UnsupportedError
from voxelith.sources.metadata import ArrayMeta, effective_axes, multiscales, node_type, open_array, open_group, well
from voxelith.sources.store import CACHE_BYTES, Store, cached_store, is_metadata_key, join_key, open_store

PARTITION_BYTES = 8 << 20
#: Tasks of a read, at most: beyond, each reads more.
MOST_PARTITIONS = 100_000
BATCH_CELLS = 1 << 18
CHUNKS_SCHEMA = "array_path string, chunk_coord array<bigint>, store_key string, payload binary, present boolean"


def validate_region(shape, start, end) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """A region of the array's rank with 0 <= start < end <= shape on every axis, or an error."""
    start, end = tuple(map(int, start)), tuple(map(int, end))
    if len(start) != len(shape) or len(end) != len(shape):
        raise RegionError(f"a region of {len(start)} axes for an array of {len(shape)}")
    for k, (s, e, n) in enumerate(zip(start, end, shape, strict=True)):
        if not 0 <= s < n or not s < e <= n:
            raise RegionError(f"[{s}, {e}) on axis {k} of length {n}")
    return start, end


def chunk_range(start, end, chunks) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The box of chunks that a region touches."""
    return tuple(s // c for s, c in zip(start, chunks, strict=True)), tuple(-(-e // c) for e, c in zip(end, chunks, strict=True))


def chunk_coordinates(start, end, chunks) -> Iterator[tuple[int, ...]]:
    """Coordinates of the chunks that a region touches, last axis fastest."""
    lo, hi = chunk_range(start, end, chunks)
    return itertools.product(*[range(a, b) for a, b in zip(lo, hi, strict=True)])


def fit_chunk(raw: bytes, meta: ArrayMeta, chunks, origin, zero: bool) -> np.ndarray:
    """A decoded chunk in full shape.

    Exactly sized ones are taken as they are. A shorter one that has just the cells within the
    array is spread over its place; another shorter one is a prefix; longer ones are an error.
    """
    kind, order = meta.type.numpy, "F" if meta.fortran else "C"
    want = math.prod(chunks) * meta.type.size
    if len(raw) == want:
        return np.frombuffer(raw, kind).reshape(chunks, order=order)
    if len(raw) > want:
        raise CodecError(f"a chunk of {len(raw)} bytes where {want} belong")
    if len(raw) % meta.type.size:
        raise CodecError(f"{len(raw)} bytes are no whole number of elements")
    out = meta.filled(chunks, zero)
    inside = tuple(min(c, n - o) for c, n, o in zip(chunks, meta.shape, origin, strict=True))
    values = np.frombuffer(raw, kind)
    if len(values) == math.prod(inside):
        out[tuple(slice(0, n) for n in inside)] = values.reshape(inside, order=order)
    else:
        flat = out.ravel().copy()
        flat[: len(values)] = values
        out = flat.reshape(chunks, order=order)
    return out


def read_key(store: Store, meta: ArrayMeta, coord) -> bytes | None:
    raw = store.read(meta.key(coord))
    if raw is None and (other := meta.other_key(coord)):
        raw = store.read(other)
    return raw


def read_chunk(store: Store, meta: ArrayMeta, coord, zero: bool = False) -> np.ndarray:
    """One unsharded chunk in full shape; an absent one is all fill value."""
    raw = read_key(store, meta, coord)
    if raw is None:
        return meta.filled(meta.chunks, zero)
    origin = tuple(c * n for c, n in zip(coord, meta.chunks, strict=True))
    return fit_chunk(meta.pipeline.decode(raw, math.prod(meta.chunks) * meta.type.size), meta, meta.chunks, origin, zero)


def shard_index(store: Store, meta: ArrayMeta, coord) -> tuple[str, np.ndarray] | None:
    """The key of a shard and its index, by one ranged read; none if the shard is absent."""
    s = meta.sharding
    if s.wrapped:
        raise UnsupportedError("codecs around sharding_indexed")
    size = s.index_bytes(meta.chunks)
    for key in filter(None, (meta.key(coord), meta.other_key(coord))):
        raw = store.read_range(key, -size if s.at_end else 0, size)
        if raw is not None:
            if len(raw) != size:
                raise CodecError(f"the shard {key} is too short for its index")
            return key, s.parse_index(raw, meta.chunks)
    return None


def read_inner(store: Store, meta: ArrayMeta, found, shard, inner, zero: bool = False) -> np.ndarray:
    """One inner chunk of a shard in full shape; ``inner`` counts from the shard's first."""
    s = meta.sharding
    per = s.per_shard(meta.chunks)
    if found is None:
        return meta.filled(s.inner, zero)
    offset, size = (int(x) for x in found[1][int(np.ravel_multi_index(inner, per))])
    if offset == EMPTY and size == EMPTY:
        return meta.filled(s.inner, zero)
    raw = store.read_range(found[0], offset, size)
    if raw is None or len(raw) != size:
        raise CodecError(f"the shard {found[0]} ends within an inner chunk")
    origin = tuple(c * n + i * m for c, n, i, m in zip(shard, meta.chunks, inner, s.inner, strict=True))
    return fit_chunk(s.pipeline.decode(raw, math.prod(s.inner) * meta.type.size), meta, s.inner, origin, zero)


def read_blocks(store: Store, meta: ArrayMeta, coord, start, end, zero: bool) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """(origin, values) of the parts of a chunk or shard within a region, one for each chunk that is decoded."""

    def part(values: np.ndarray, origin) -> tuple[tuple[int, ...], np.ndarray] | None:
        lo = tuple(max(o, s) for o, s in zip(origin, start, strict=True))
        hi = tuple(min(o + n, e) for o, n, e in zip(origin, values.shape, end, strict=True))
        if any(h <= x for x, h in zip(lo, hi, strict=True)):
            return None
        return lo, values[tuple(slice(x - o, h - o) for x, h, o in zip(lo, hi, origin, strict=True))]

    corner = tuple(c * n for c, n in zip(coord, meta.chunks, strict=True))
    if not meta.sharding:
        if cut := part(read_chunk(store, meta, coord, zero), corner):
            yield cut
        return
    found, inner = shard_index(store, meta, coord), meta.sharding.inner
    lo = tuple(max(0, s - c) for s, c in zip(start, corner, strict=True))
    hi = tuple(min(n, e - c) for n, e, c in zip(meta.chunks, end, corner, strict=True))
    for i in chunk_coordinates(lo, hi, inner):
        origin = tuple(c + k * n for c, k, n in zip(corner, i, inner, strict=True))
        if cut := part(read_inner(store, meta, found, coord, i, zero), origin):
            yield cut


def read_region(store: Store, meta: ArrayMeta, start, end, zero: bool = False) -> np.ndarray:
    """A region as one dense array in this process. For small regions; large ones belong in Spark."""
    start, end = validate_region(meta.shape, start, end)
    out = np.empty([e - s for s, e in zip(start, end, strict=True)], meta.type.numpy)
    for coord in chunk_coordinates(start, end, meta.chunks):
        for origin, values in read_blocks(store, meta, coord, start, end, zero):
            out[tuple(slice(o - s, o - s + n) for o, s, n in zip(origin, start, values.shape, strict=True))] = values
    return out


def resolve(path: str, array: str | None = None) -> tuple[str, ArrayMeta]:
    """(store URI, array) of a path that may lead into a store: the array is sought at the path itself."""
    if array:
        return path, open_array(open_store(path), array)
    try:
        return path, open_array(open_store(path), "")
    except (NodeNotFoundError, MetadataError, NotADirectoryError) as e:
        if isinstance(e, MetadataError) and "not an array" in str(e):
            raise MetadataError(f"{path} is a group; name one of its arrays") from e
        raise


def axis_names(uri: str, meta: ArrayMeta, given: str | None) -> tuple[str, ...]:
    """Given names, else those of the image that the array is a level of, else the last of t, c, z, y, x, else d0, d1, ..."""
    if given:
        names = tuple(n.strip().lower() for n in given.split(","))
        if len(names) != meta.rank or len(set(names)) != meta.rank:
            raise MetadataError(f"{len(names)} axis names for an array of rank {meta.rank}")
        return names
    parent, _, _ = (join_key(meta.path) or "").rpartition("/")
    scale = None
    try:
        if meta.path:
            attributes = open_group(open_store(uri), parent).attributes
        else:
            above, _, _ = uri.rstrip("/").rpartition("/")
            attributes = open_group(open_store(above), "").attributes if above else {}
        if node_type(attributes) in ("image", "label"):
            scale = multiscales(attributes)[0]
    except (NodeNotFoundError, MetadataError, OSError):
        scale = None
    try:
        return tuple(a.name for a in effective_axes(scale, meta.rank))
    except MetadataError:
        return tuple(f"d{k}" for k in range(meta.rank))


@dataclass
class BoxPart(InputPartition):
    """A run of chunks of a box of the chunk grid, by position, last axis fastest."""

    first: int
    last: int


class ZarrReader(DataSourceReader):
    def __init__(self, uri: str, meta: ArrayMeta, axes: tuple[str, ...], options):
        self.uri, self.meta, self.axes = uri, meta, axes
        self.mode = options.get("mode", "cells")
        self.zero = options.get("fillMode", "declared") == "zero"
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.cache = int(options.get("cacheBytes", CACHE_BYTES))
        ints = lambda name: tuple(int(x) for x in options[name].split(",")) if options.get(name) else None
        start, end = ints("start") or (0,) * meta.rank, ints("end") or meta.shape
        if ints("start") or ints("end"):
            start, end = validate_region(meta.shape, start, end)
        self.start, self.end = list(start), list(end)
        self.only: dict[int, np.ndarray] = {}
        self.labels = options.get("labels")
        self.by = [(axes.index(n), int(k)) for n, _, k in (x.partition(":") for x in options.get("by", "").split(",") if x)]

    def pushFilters(self, filters: list) -> Iterable:
        """Comparisons of axes with numbers narrow the box; Spark still checks every filter."""
        for f in filters:
            name = f.attribute[0].lower() if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if self.mode == "cells" and name in self.axes:
                k = self.axes.index(name)
                if isinstance(f, (EqualTo, In)):
                    values = [v for v in (f.value if isinstance(f, In) else (f.value,)) if v is not None]
                    if isinstance(f, In) and all(isinstance(v, int) for v in values):
                        known = np.unique(np.array(values, np.int64))
                        self.only[k] = np.intersect1d(self.only[k], known) if k in self.only else known
                    lo, hi = (min(values), max(values) + 1) if values else (self.end[k], self.end[k])
                elif isinstance(f, GreaterThanOrEqual):
                    lo, hi = f.value, self.end[k]
                elif isinstance(f, GreaterThan):
                    lo, hi = f.value + 1, self.end[k]
                elif isinstance(f, LessThan):
                    lo, hi = self.start[k], f.value
                elif isinstance(f, LessThanOrEqual):
                    lo, hi = self.start[k], f.value + 1
                else:
                    lo, hi = self.start[k], self.end[k]
                self.start[k], self.end[k] = max(self.start[k], math.floor(lo)), min(self.end[k], math.ceil(hi))
            yield f

    def _box(self):
        lo, hi = chunk_range(self.start, self.end, self.meta.chunks)
        return lo, tuple(max(0, b - a) for a, b in zip(lo, hi, strict=True))

    def partitions(self) -> list[BoxPart]:
        _, size = self._box()
        total = math.prod(size) if all(e > s for s, e in zip(self.start, self.end, strict=True)) else 0
        each = max(1, self.bytes // max(1, math.prod(self.meta.chunks) * self.meta.type.size), -(-total // MOST_PARTITIONS))
        return [BoxPart(a, min(total, a + each)) for a in range(0, total, each)] or [BoxPart(0, 0)]

    def read(self, part: BoxPart) -> Iterator[pa.RecordBatch]:
        lo, size = self._box()
        store = cached_store(self.uri, self.cache)
        for flat in range(part.first, part.last):
            coord = tuple(int(a + i) for a, i in zip(lo, np.unravel_index(flat, size), strict=True))
            if self.mode == "chunks":
                yield self._chunk_row(store, coord)
            elif all(np.diff(np.searchsorted(known, [coord[k] * self.meta.chunks[k], (coord[k] + 1) * self.meta.chunks[k]]))[0] for k, known in self.only.items()):
                for origin, values in read_blocks(store, self.meta, coord, self.start, self.end, self.zero):
                    if self.mode == "cells":
                        yield from cell_batches(origin, values, self.axes)
                    else:
                        yield partials(origin, values, self.axes, self.by) if self.mode == "partials" else self._under_labels(store, origin, values)

    def _under_labels(self, store: Store, origin, values: np.ndarray) -> pa.RecordBatch:
        """Sum and number of a block's values under each label but 0: the labels' part of the same box is read here."""
        meta = open_array(store, self.labels)
        names = axis_names(self.uri, meta, None)
        at = [self.axes.index(n) for n in names]
        part = read_region(store, meta, [origin[k] for k in at], [origin[k] + values.shape[k] for k in at], self.zero)
        order = np.argsort(at)
        part = part.transpose(order).reshape([values.shape[k] if k in at else 1 for k in range(values.ndim)])
        known, of = np.unique(part, return_inverse=True)
        of = np.broadcast_to(of.reshape(part.shape), values.shape).ravel()
        sums, n = np.bincount(of, values.ravel().astype(np.float64), len(known)), np.bincount(of, minlength=len(known))
        some = known != 0
        return pa.RecordBatch.from_arrays([spark_values(known[some]), pa.array(sums[some]), pa.array(n[some])], ["label", "sum_v", "n"])

    def _chunk_row(self, store: Store, coord) -> pa.RecordBatch:
        raw = read_key(store, self.meta, coord)
        columns = [[self.meta.path], [list(coord)], [self.meta.key(coord)], [raw], [raw is not None]]
        kinds = [pa.string(), pa.list_(pa.int64()), pa.string(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["array_path", "chunk_coord", "store_key", "payload", "present"])


def spark_values(values: np.ndarray) -> pa.Array:
    """Values in the Arrow type of their Spark type: unsigned ones are widened."""
    flat = np.ascontiguousarray(values).ravel()
    kind = flat.dtype.kind + str(flat.dtype.itemsize)
    if kind == "b1":
        return pa.array(flat.astype(bool))
    if kind == "u8":
        return pa.array(flat.astype(np.uint64)).cast(pa.decimal128(20, 0))
    wider = {"u1": np.int16, "u2": np.int32, "u4": np.int64}.get(kind)
    return pa.array(flat.astype(wider) if wider else flat)


def partials(origin, values: np.ndarray, axes, by: list[tuple[int, int]]) -> pa.RecordBatch:
    """Least, greatest, sum and number of a block's values in each group of ``by``: indices of axes divided by a size."""
    wide = values.astype(np.float64 if values.dtype.kind == "f" or values.dtype.itemsize == 8 else np.int64)
    least = most = values.astype(np.uint8) if values.dtype.kind == "b" else values
    sums, numbers = wide, np.ones((), np.int64)
    order, lines = [k for k, _ in by], []
    for k in range(values.ndim):
        size = dict(by).get(k)
        cells = np.arange(origin[k], origin[k] + values.shape[k])
        groups, first = np.unique(cells // size if size else np.zeros_like(cells), return_index=True)
        least, most, sums = (f.reduceat(x, first, axis=k) for f, x in ((np.minimum, least), (np.maximum, most), (np.add, sums)))
        each = np.diff(np.append(first, len(cells))).reshape([-1 if j == k else 1 for j in range(values.ndim)])
        numbers = numbers * each
        lines.append(groups.reshape(each.shape))
    shape = least.shape
    columns = [pa.array(np.broadcast_to(lines[k], shape).ravel().astype(np.int64)) for k in order]
    total = sums.ravel().astype(np.float64) if values.dtype.kind == "f" or values.dtype.itemsize == 8 else sums.ravel()
    return pa.RecordBatch.from_arrays([*columns, spark_values(least.astype(values.dtype)), spark_values(most.astype(values.dtype)), pa.array(total), pa.array(np.broadcast_to(numbers, shape).ravel())], [*[axes[k] for k in order], "min_v", "max_v", "sum_v", "n"])


def cell_batches(origin, values: np.ndarray, axes) -> Iterator[pa.RecordBatch]:
    """A block's cells as batches of one row each, cut along the first axis."""
    rest = max(1, values.size // max(1, values.shape[0])) if values.ndim else 1
    step = max(1, BATCH_CELLS // rest)
    for a in range(0, values.shape[0], step):
        block = values[a : a + step]
        corner = (origin[0] + a, *origin[1:])
        columns = []
        for k, (o, n) in enumerate(zip(corner, block.shape, strict=True)):
            line = np.arange(o, o + n, dtype=np.int64).reshape([-1 if j == k else 1 for j in range(block.ndim)])
            columns.append(pa.array(np.broadcast_to(line, block.shape).ravel()))
        yield pa.RecordBatch.from_arrays([*columns, spark_values(block)], [*axes, "value"])


@dataclass
class FieldsPart(InputPartition):
    """A run of a plate's wells."""

    wells: list[str]


class FieldsReader(DataSourceReader):
    """The cells of all fields of some wells, with well and field. Each task reads its wells' metadata; fields must have the axes and type of the first."""

    def __init__(self, uri: str, wells: list[str], strip: int, level: int, axes: tuple[str, ...], kind: str, options):
        self.uri, self.wells, self.strip, self.level, self.axes, self.kind = uri, wells, strip, level, axes, kind
        self.zero = options.get("fillMode", "declared") == "zero"

    def partitions(self) -> list[FieldsPart]:
        each = max(1, -(-len(self.wells) // MOST_PARTITIONS))
        return [FieldsPart(self.wells[a : a + each]) for a in range(0, len(self.wells), each)] or [FieldsPart([])]

    def read(self, part: FieldsPart) -> Iterator[pa.RecordBatch]:
        store = open_store(self.uri)
        for path in part.wells:
            for k, (_, name) in enumerate(well(open_group(store, path).attributes)):
                meta, scale = level_array(store, join_key(path, name), self.level)
                if tuple(a.name for a in effective_axes(scale, meta.rank)) != self.axes or meta.type.name != self.kind:
                    raise MetadataError(f"{path}/{name} has other axes or another type than the first field")
                whole = (0,) * meta.rank, meta.shape
                for coord in chunk_coordinates(*whole, meta.chunks):
                    for origin, values in read_blocks(store, meta, coord, *whole, self.zero):
                        for batch in cell_batches(origin, values, self.axes):
                            n = batch.num_rows
                            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([path[self.strip :]] * n), pa.array(np.full(n, k, np.int32))], [*self.axes, "value", "well", "field"])


def level_array(store: Store, path: str, level: int):
    """The array of an image's level, and the pyramid that it belongs to."""
    scale = multiscales(open_group(store, path).attributes)[0]
    if not 0 <= level < len(scale.datasets):
        raise IndexError(f"no level {level}")
    return open_array(store, join_key(path, scale.datasets[level].path)), scale


@dataclass
class Written(WriterCommitMessage):
    keys: list[str]


class ZarrWriter(DataSourceArrowWriter):
    """Lays cells over chunks. A chunk must be one task's; voxelith.operators.write sees to that."""

    def __init__(self, uri: str, meta: ArrayMeta, axes, overwrite: bool):
        if meta.sharding:
            raise UnsupportedError("writing sharded arrays")
        if not hasattr(open_store(uri), "write") or urllib.parse.urlsplit(uri).scheme in ("http", "https"):
            raise UnsupportedError("writing over HTTP")
        self.uri, self.meta, self.axes, self.overwrite = uri, meta, axes, overwrite
        #: Chunks that an overwriting write finds, and deletes unless it wrote them.
        self.old = [k for k in open_store(uri).list(meta.path) if not is_metadata_key(k)] if overwrite else []

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, held, cells, seen = open_store(self.uri), {}, 0, set()

        def flush() -> None:
            for coord, parts in held.items():
                place, values = np.concatenate([p for p, _ in parts]), np.concatenate([v for _, v in parts])
                if len(np.unique(place)) != len(place):
                    raise ValueError(f"two rows for one cell of chunk {coord}")
                fresh = self.overwrite and coord not in seen
                chunk = self.meta.filled(self.meta.chunks, False) if fresh else read_chunk(store, self.meta, coord).copy()
                flat = np.ascontiguousarray(chunk).ravel()
                flat[place] = values
                seen.add(coord)
                data = flat.reshape(self.meta.chunks).tobytes("F" if self.meta.fortran else "C")
                store.write(self.meta.key(coord), self.meta.pipeline.encode(data))
            held.clear()

        for batch in iterator:
            if not batch.num_rows:
                continue
            index = np.stack([np.asarray(batch.column(a)).astype(np.int64) for a in self.axes])
            limit = np.array(self.meta.shape)[:, None]
            if (index < 0).any() or (index >= limit).any():
                raise RegionError("a cell lies outside the array")
            if batch.column("value").null_count:
                raise ValueError("a cell has no value")
            values = column_values(batch.column("value"), self.meta)
            chunks = np.array(self.meta.chunks)[:, None]
            number = np.ravel_multi_index(index // chunks, self.meta.grid)
            place = np.ravel_multi_index(index % chunks, self.meta.chunks)
            order = np.argsort(number, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
                coord = tuple(int(x) for x in np.unravel_index(number[own[0]], self.meta.grid))
                held.setdefault(coord, []).append((place[own], values[own]))
            cells += batch.num_rows
            if cells > 1 << 22 and len(held) > 1:
                last = coord
                keep = held.pop(last)
                flush()
                held[last], cells = keep, sum(len(p) for p, _ in keep)
        flush()
        return Written([self.meta.key(c) for c in seen] if self.overwrite else [])

    def commit(self, messages) -> None:
        """An overwritten array has the written chunks alone; all else is fill value."""
        if self.overwrite:
            store, new = open_store(self.uri), {k for m in messages if m for k in m.keys}
            for key in self.old:
                if key not in new:
                    store.delete(key)

    def abort(self, messages) -> None:
        """Chunks are replaced one by one, each as a whole. A failed write leaves those that it finished, and is to be run again: cells laid over twice are the same."""


def column_values(column: pa.Array, meta: ArrayMeta) -> np.ndarray:
    """Spark's values in the array's own type; those that don't fit are an error."""
    kind = meta.type.numpy
    if pa.types.is_decimal(column.type):
        return np.asarray(column.cast(pa.uint64())).astype(kind)
    values = np.asarray(column)
    if meta.type.is_float or meta.type.name == "bool":
        return values.astype(kind)
    out = values.astype(kind)
    if not (out.astype(values.dtype) == values).all():
        raise ValueError(f"a value doesn't fit {meta.type.name}")
    return out


_SUMS = {"float32": "double", "float64": "double", "int64": "double", "uint64": "double"}


class ZarrSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zarr"

    def __init__(self, options):
        super().__init__(options)
        if not options.get("path"):
            raise MetadataError("the path is missing")
        self.wells = json.loads(options["wells"]) if options.get("wells") else None
        if self.wells is not None:
            self.uri, self.level, store = options["path"], int(options.get("level", 0)), open_store(options["path"])
            first = next((join_key(w, f[0][1]) for w in self.wells if (f := well(open_group(store, w).attributes))), None)
            if first is None:
                raise MetadataError("a plate without fields has no axes")
            self.meta, scale = level_array(store, first, self.level)
            self.axes = tuple(a.name for a in effective_axes(scale, self.meta.rank))
            return
        self.uri, self.meta = resolve(options["path"], options.get("array"))
        self.axes = axis_names(self.uri, self.meta, options.get("axes"))

    def schema(self) -> str:
        mode = self.options.get("mode", "cells")
        if mode == "chunks":
            return CHUNKS_SCHEMA
        if mode == "partials":
            by = [x.partition(":")[0] for x in self.options.get("by", "").split(",") if x]
            kind = self.meta.type.spark
            return ", ".join([*[f"`{a}` bigint" for a in by], f"min_v {kind}, max_v {kind}, sum_v {_SUMS.get(self.meta.type.name, 'bigint')}, n bigint"])
        if mode == "masked":
            return f"label {open_array(open_store(self.uri), self.options['labels']).type.spark}, sum_v double, n bigint"
        if mode != "cells":
            raise UnsupportedError(f"mode {mode!r}")
        return ", ".join([*[f"`{a}` bigint" for a in self.axes], f"value {self.meta.type.spark}", *(["well string", "field int"] if self.wells is not None else [])])

    def reader(self, schema: StructType) -> DataSourceReader:
        if self.wells is not None:
            return FieldsReader(self.uri, self.wells, int(self.options.get("strip", 0)), self.level, self.axes, self.meta.type.name, self.options)
        return ZarrReader(self.uri, self.meta, self.axes, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ZarrWriter:
        return ZarrWriter(self.uri, self.meta, self.axes, overwrite)


def register(spark: SparkSession) -> None:
    """Makes format("zarr") known to a session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZarrSource)


def read_cells(spark: SparkSession, uri: str, array: str | None = None, start=None, end=None, axes=None, **options) -> DataFrame:
    """Cells of an array, or of a region; regions are checked before any job runs."""
    register(spark)
    given = {"array": array, "axes": ",".join(axes) if axes else None, **options}
    given |= {"start": ",".join(map(str, start)) if start is not None else None, "end": ",".join(map(str, end)) if end is not None else None}
    found, meta = resolve(uri, array)
    axis_names(found, meta, given["axes"])
    if start is not None or end is not None:
        validate_region(meta.shape, start if start is not None else (0,) * meta.rank, end if end is not None else meta.shape)
    return spark.read.format("zarr").options(**{k: str(v) for k, v in given.items() if v is not None}).load(uri)


def read_fields(spark: SparkSession, uri: str, wells: list[str], strip: int = 0, level: int = 0) -> DataFrame:
    """Cells of all fields of a plate's wells with well, its path less ``strip`` characters, and field."""
    register(spark)
    return spark.read.format("zarr").options(wells=json.dumps(wells), strip=str(strip), level=str(level)).load(uri)


def read_chunks(spark: SparkSession, uri: str, array: str | None = None) -> DataFrame:
    """The encoded chunks or shards of an array, absent ones too."""
    return read_cells(spark, uri, array, mode="chunks")


def write_cells(cells: DataFrame, uri: str, array: str | None = None, overwrite: bool = False) -> None:
    """Lays cells over an existing array's chunks, each by one task: read, overlay, replace."""
    spark = cells.sparkSession
    register(spark)
    _, meta = resolve(uri, array)
    axes = [c for c in cells.columns if c != "value"]
    if len(axes) != meta.rank:
        raise RegionError(f"{len(axes)} axis columns for an array of rank {meta.rank}")
    if meta.sharding:
        raise UnsupportedError("writing sharded arrays")
    chunk = [F.floor(F.col(a) / c).alias(f"__{k}") for k, (a, c) in enumerate(zip(axes, meta.chunks, strict=True))]
    keys = [f"__{k}" for k in range(meta.rank)]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.select("*", *chunk).repartition(n, *keys).sortWithinPartitions(*keys).select(*[F.col(a).cast("bigint") for a in axes], "value")
    options = {"axes": ",".join(axes)} | ({"array": array} if array else {})
    dealt.write.format("zarr").mode("overwrite" if overwrite else "append").options(**options).save(uri)


__all__ = ["ZarrSource", "read_cells", "read_chunks", "read_fields", "read_region", "register", "validate_region", "write_cells"]
