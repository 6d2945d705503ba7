"""Array, group and OME metadata: JSON documents to plain records. No Spark here."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from voxelith.sources.codecs import Pipeline, Sharding, pipeline_v2, pipeline_v3
from voxelith.sources.errors import MetadataError, NodeNotFoundError, UnsupportedError
from voxelith.sources.store import Store, join_key

# --- lenient JSON ---------------------------------------------------------------------------

_LOOSE = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/|,(?=\s*(?:(?://[^\n]*\n|/\*.*?\*/)\s*)*[}\]])', re.S)


def loads(data: bytes | str, strict: bool = False) -> Any:
    """JSON; unless strict, with comments and trailing commas."""
    text = data.decode("utf-8-sig") if isinstance(data, bytes) else data
    try:
        return json.loads(text)
    except ValueError as e:
        if strict:
            raise MetadataError(f"bad JSON: {e}") from e
    try:
        return json.loads(_LOOSE.sub(lambda m: m[0] if m[0][0] == '"' else " ", text))
    except ValueError as e:
        raise MetadataError(f"bad JSON: {e}") from e


def get(doc: Any, name: str, default: Any = None) -> Any:
    """A property by name, whatever its case; null counts as absent."""
    if not isinstance(doc, dict):
        return default
    if name in doc:
        found = doc[name]
    else:
        found = next((v for k, v in doc.items() if k.lower() == name.lower()), None)
    return default if found is None else found


def number(x: Any) -> float | None:
    """A number, also one in quotes."""
    try:
        return None if x is None or isinstance(x, bool) else float(x)
    except (TypeError, ValueError):
        return None


def integer(x: Any) -> int | None:
    n = number(x)
    return None if n is None or math.isnan(n) or n != int(n) else int(n)


# --- data types -----------------------------------------------------------------------------


@dataclass(frozen=True)
class DataType:
    """An element type: its name, NumPy code, bytes and the Spark type that holds every value."""

    name: str
    code: str
    size: int
    spark: str

    @property
    def is_float(self) -> bool:
        return self.code[0] == "f"

    @property
    def is_integer(self) -> bool:
        return not self.is_float

    @property
    def is_signed(self) -> bool:
        return self.code[0] in "if"

    @property
    def numpy(self) -> np.dtype:
        return np.dtype(f"<{self.code}" if self.size > 1 else self.code)


#: The closed set of element types. Fixed values of the format; Spark has no unsigned types, so those widen.
TYPES = {
    t.name: t
    for t in (
        DataType("bool", "b1", 1, "boolean"),
        DataType("int8", "i1", 1, "tinyint"),
        DataType("uint8", "u1", 1, "smallint"),
        DataType("int16", "i2", 2, "smallint"),
        DataType("uint16", "u2", 2, "int"),
        DataType("int32", "i4", 4, "int"),
        DataType("uint32", "u4", 4, "bigint"),
        DataType("int64", "i8", 8, "bigint"),
        DataType("uint64", "u8", 8, "decimal(20,0)"),
        DataType("float32", "f4", 4, "float"),
        DataType("float64", "f8", 8, "double"),
    )
}


def data_type(name: str) -> DataType:
    if name not in TYPES:
        raise UnsupportedError(f"data type {name!r}")
    return TYPES[name]


def parse_numpy_code(code: str) -> tuple[DataType, bool]:
    """A v2 type such as '<u2': the type, and whether it is big-endian."""
    if len(code) < 2:
        raise ValueError(f"data type {code!r} is too short")
    order, rest = (code[0], code[1:]) if code[0] in "<>|=" else ("", code) if code[0].isalpha() else (code[0], code[1:])
    if order not in ("<", ">", "|", "=", ""):
        raise UnsupportedError(f"byte order {order!r}")
    if not rest[1:].isdigit():
        raise ValueError(f"no size in data type {code!r}")
    found = next((t for t in TYPES.values() if t.code == rest), None)
    if found is None:
        raise UnsupportedError(f"data type {code!r}")
    return found, order == ">"


# --- arrays and groups ----------------------------------------------------------------------


@dataclass(frozen=True)
class ArrayMeta:
    """What a reader needs to know of an array; small, and sent to every task."""

    path: str
    version: int
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    type: DataType
    fill: Any
    separator: str
    encoding: str
    fortran: bool
    pipeline: Pipeline
    sharding: Sharding | None
    dimension_names: tuple[str | None, ...] | None
    attributes: dict = field(hash=False, compare=False)
    codecs: str = "[]"

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def grid(self) -> tuple[int, ...]:
        return tuple(-(-s // c) for s, c in zip(self.shape, self.chunks, strict=True))

    @property
    def read_chunks(self) -> tuple[int, ...]:
        """The grid that is read: inner chunks of shards, else chunks."""
        return self.sharding.inner if self.sharding else self.chunks

    def key(self, coord: tuple[int, ...]) -> str:
        """The key of a chunk or shard: with a 'c' in front in the default encoding, and '0' for no axes in v2's."""
        name = self.separator.join(map(str, coord))
        if self.version == 2 or self.encoding == "v2":
            return join_key(self.path, name or "0")
        return join_key(self.path, f"c{self.separator}{name}" if name else "c")

    def other_key(self, coord: tuple[int, ...]) -> str | None:
        """The key that some writers use instead: 'c/' before names joined by another separator."""
        name = f"c/{self.separator.join(map(str, coord))}"
        return join_key(self.path, name) if self.version == 3 and self.key(coord) != join_key(self.path, name) else None

    def filled(self, shape: tuple[int, ...], zero: bool) -> np.ndarray:
        return np.full(shape, 0 if zero else self.fill, self.type.numpy)


def _fill(value: Any, kind: DataType) -> Any:
    if value is None:
        return 0
    if kind.is_float:
        if isinstance(value, str):
            names = {"nan": math.nan, "infinity": math.inf, "-infinity": -math.inf}
            if value.lower() in names:
                return names[value.lower()]
            if value.lower().startswith("0x"):
                return np.array([int(value, 16)], f"<u{kind.size}").view(kind.numpy)[0].item()
        return number(value) or 0.0
    if kind.name == "bool":
        return bool(value)
    n = integer(value)
    return 0 if n is None else n


def _sizes(x: Any, what: str) -> tuple[int, ...]:
    if not isinstance(x, list) or any(integer(v) is None for v in x):
        raise MetadataError(f"{what} is missing or no list of integers")
    return tuple(integer(v) for v in x)


def array_v3(doc: dict, path: str = "") -> ArrayMeta:
    if get(doc, "node_type", "array") != "array":
        raise MetadataError(f"{path or '/'} is a {get(doc, 'node_type')}, not an array")
    shape = _sizes(get(doc, "shape"), "shape")
    if not isinstance(get(doc, "data_type"), str):
        raise MetadataError("data_type is missing")
    kind, grid = data_type(get(doc, "data_type")), get(doc, "chunk_grid", {})
    if get(grid, "name") != "regular":
        raise UnsupportedError(f"chunk grid {get(grid, 'name')!r}")
    chunks = _sizes(get(get(grid, "configuration", {}), "chunk_shape"), "chunk_shape")
    if not chunks or len(chunks) != len(shape) or min(chunks) < 1:
        raise MetadataError(f"chunk_shape {chunks} doesn't suit shape {shape}")
    codecs = get(doc, "codecs", [])
    pipeline, sharding = pipeline_v3(codecs, kind.size)
    encoding = get(doc, "chunk_key_encoding", {})
    name = get(encoding, "name", "default")
    separator = get(get(encoding, "configuration", {}), "separator", "." if name == "v2" else "/")
    names = get(doc, "dimension_names")
    return ArrayMeta(path, 3, shape, chunks, kind, _fill(get(doc, "fill_value"), kind), separator, name, False, pipeline, sharding, tuple(names) if names else None, get(doc, "attributes", {}), json.dumps(codecs))


def array_v2(doc: dict, attributes: dict, path: str = "", separator: str | None = None) -> ArrayMeta:
    if integer(get(doc, "zarr_format")) != 2:
        raise MetadataError("zarr_format is not 2")
    shape, chunks = _sizes(get(doc, "shape"), "shape"), _sizes(get(doc, "chunks"), "chunks")
    if len(shape) != len(chunks) or any(c < 1 for c in chunks):
        raise MetadataError(f"chunks {chunks} don't suit shape {shape}")
    if not isinstance(get(doc, "dtype"), str):
        raise UnsupportedError(f"data type {get(doc, 'dtype')!r}")
    if get(doc, "filters"):
        raise UnsupportedError("filters")
    kind, big = parse_numpy_code(get(doc, "dtype"))
    compressor = get(doc, "compressor")
    separator = separator or get(doc, "dimension_separator") or "."
    return ArrayMeta(path, 2, shape, chunks, kind, _fill(get(doc, "fill_value"), kind), separator, "v2", get(doc, "order", "C") == "F", pipeline_v2(compressor, kind.size, big), None, None, attributes, json.dumps([compressor]))


@dataclass(frozen=True)
class GroupMeta:
    path: str
    version: int
    attributes: dict = field(hash=False, compare=False)


def _attributes_v2(store: Store, path: str) -> dict:
    raw = store.read(join_key(path, ".zattrs"))
    return {} if raw is None else loads(raw, strict=True)


def open_group(store: Store, path: str = "") -> GroupMeta:
    """A group: zarr.json first, then .zgroup. An array at that path is refused."""
    if (raw := store.read(join_key(path, "zarr.json"))) is not None:
        doc = loads(raw)
        if get(doc, "node_type") != "group":
            raise MetadataError(f"{path or '/'} is no group but {get(doc, 'node_type')!r}")
        return GroupMeta(path.strip("/"), 3, get(doc, "attributes", {}))
    if (raw := store.read(join_key(path, ".zgroup"))) is not None:
        loads(raw)
        return GroupMeta(path.strip("/"), 2, _attributes_v2(store, path))
    raise NodeNotFoundError(f"no group at {path or '/'}")


def open_array(store: Store, path: str = "") -> ArrayMeta:
    """An array: zarr.json first, then .zarray. A v2 array that names no separator is probed for '/'."""
    path = path.strip("/")
    if (raw := store.read(join_key(path, "zarr.json"))) is not None:
        return array_v3(loads(raw), path)
    if (raw := store.read(join_key(path, ".zarray"))) is not None:
        doc, separator = loads(raw), None
        if get(doc, "dimension_separator") is None and isinstance(get(doc, "shape"), list) and len(get(doc, "shape")) > 1:
            if store.exists(join_key(path, "/".join("0" for _ in get(doc, "shape")))):
                separator = "/"
        return array_v2(doc, _attributes_v2(store, path), path, separator)
    raise NodeNotFoundError(f"no array at {path or '/'}")


def has_child(store: Store, path: str, name: str) -> bool:
    """A child has a metadata file; a bare folder, or .zattrs alone, is none."""
    return any(store.exists(join_key(path, name, m)) for m in ("zarr.json", ".zarray", ".zgroup"))


def child_names(store: Store, path: str = "") -> list[str]:
    """Names of the children, sorted; none where the store can't list."""
    if hasattr(store, "children"):
        return [n for n in store.children(path) if has_child(store, path, n)]
    try:
        keys = store.list(path)
    except UnsupportedError:
        return []
    top = f"{path.strip('/')}/" if path.strip("/") else ""
    parts = [k.removeprefix(top).split("/") for k in keys if k.startswith(top)]
    return sorted({p[0] for p in parts if len(p) == 2 and p[1] in ("zarr.json", ".zarray", ".zgroup")})


# --- OME attributes -------------------------------------------------------------------------


def ome_attributes(attributes: dict) -> dict:
    """What lies under 'ome' since NGFF 0.5, else the attributes themselves."""
    inner = get(attributes, "ome")
    return inner if isinstance(inner, dict) else attributes or {}


def node_type(attributes: dict) -> str:
    """plate, bioformats2raw, well, labels, label, image or unknown: the first that applies."""
    ome = ome_attributes(attributes)
    if get(ome, "plate") is not None:
        return "plate"
    if get(ome, "bioformats2raw.layout") is not None or get(attributes, "bioformats2raw.layout") is not None:
        return "bioformats2raw"
    if get(ome, "well") is not None:
        return "well"
    if get(ome, "labels") is not None:
        return "labels"
    if get(ome, "multiscales") is not None:
        return "label" if get(ome, "image-label") is not None else "image"
    return "unknown"


def ngff_version(attributes: dict) -> str | None:
    version = get(get(attributes, "ome"), "version")
    if isinstance(version, str):
        return version
    scales = get(ome_attributes(attributes), "multiscales")
    version = get(scales[0], "version") if isinstance(scales, list) and scales else None
    return version if isinstance(version, str) else None


@dataclass(frozen=True)
class Axis:
    name: str
    type: str | None = None
    unit: str | None = None


@dataclass(frozen=True)
class Transform:
    type: str
    values: tuple[float, ...] | None


@dataclass(frozen=True)
class Dataset:
    path: str
    transforms: tuple[Transform, ...] = ()


@dataclass(frozen=True)
class Channel:
    label: str | None
    color: str | None
    active: bool | None
    window: dict | None = field(hash=False, compare=False, default=None)


@dataclass(frozen=True)
class Multiscale:
    name: str | None
    version: str | None
    axes: tuple[Axis, ...]
    datasets: tuple[Dataset, ...]
    transforms: tuple[Transform, ...]
    channels: tuple[Channel, ...] = ()
    default_z: int | None = None
    default_t: int | None = None


def _transforms(x: Any) -> tuple[Transform, ...]:
    out = []
    for t in x or []:
        kind = get(t, "type")
        values = get(t, kind) if isinstance(kind, str) else None
        out.append(Transform(str(kind), tuple(number(v) for v in values) if isinstance(values, list) else None))
    return tuple(out)


def _axes(x: Any) -> tuple[Axis, ...]:
    return tuple(Axis(a) if isinstance(a, str) else Axis(str(get(a, "name", "")), get(a, "type"), get(a, "unit")) for a in x or [])


def _channels(omero: Any) -> tuple[Channel, ...]:
    return tuple(Channel(get(c, "label"), get(c, "color"), get(c, "active"), get(c, "window")) for c in get(omero, "channels", []))


def multiscales(attributes: dict) -> tuple[Multiscale, ...]:
    """The pyramids of an image; rendering settings are read within the entry or beside it."""
    ome = ome_attributes(attributes)
    entries = get(ome, "multiscales")
    if not isinstance(entries, list):
        raise MetadataError("no multiscales")
    out = []
    for m in entries:
        omero = get(m, "omero", get(ome, "omero", get(attributes, "omero")))
        defaults = get(omero, "rdefs")
        sets = tuple(Dataset(str(get(d, "path", "")), _transforms(get(d, "coordinateTransformations"))) for d in get(m, "datasets", []))
        out.append(Multiscale(get(m, "name"), get(m, "version"), _axes(get(m, "axes")), sets, _transforms(get(m, "coordinateTransformations")), _channels(omero), integer(get(defaults, "defaultZ")), integer(get(defaults, "defaultT"))))
    return tuple(out)


AXES = ("t", "c", "z", "y", "x")


def effective_axes(scale: Multiscale | None, rank: int) -> tuple[Axis, ...]:
    """Declared axes, else the last of t, c, z, y, x. Names are in lower case."""
    if scale and scale.axes:
        if len(scale.axes) != rank:
            raise MetadataError(f"{len(scale.axes)} axes for an array of rank {rank}")
        return tuple(Axis(a.name.lower(), a.type, a.unit) for a in scale.axes)
    if rank > len(AXES):
        raise MetadataError(f"no names for {rank} axes")
    kinds = {"t": "time", "c": "channel"}
    return tuple(Axis(n, kinds.get(n, "space")) for n in AXES[len(AXES) - rank :])


@dataclass(frozen=True)
class WellRef:
    path: str
    row_index: int | None
    column_index: int | None


@dataclass(frozen=True)
class Acquisition:
    id: int | None
    name: str | None
    maximum_field_count: int | None
    start_time: int | None
    end_time: int | None


@dataclass(frozen=True)
class Plate:
    name: str | None
    version: str | None
    field_count: int | None
    rows: tuple[str, ...]
    columns: tuple[str, ...]
    wells: tuple[WellRef, ...]
    acquisitions: tuple[Acquisition, ...]


def plate(attributes: dict) -> Plate:
    p = get(ome_attributes(attributes), "plate")
    if not isinstance(p, dict):
        raise MetadataError("no plate")
    names = lambda key: tuple(str(get(r, "name", "")) for r in get(p, key, []))
    wells = tuple(WellRef(str(get(w, "path", "")), integer(get(w, "rowIndex")), integer(get(w, "columnIndex"))) for w in get(p, "wells", []))
    runs = tuple(Acquisition(integer(get(a, "id")), get(a, "name"), integer(get(a, "maximumfieldcount")), integer(get(a, "starttime")), integer(get(a, "endtime"))) for a in get(p, "acquisitions", []))
    return Plate(get(p, "name"), get(p, "version"), integer(get(p, "field_count")), names("rows"), names("columns"), wells, runs)


def well(attributes: dict) -> tuple[tuple[int, str], ...]:
    """(acquisition, path) of a well's fields; acquisition 0 if none is named."""
    w = get(ome_attributes(attributes), "well")
    if not isinstance(w, dict):
        raise MetadataError("no well")
    return tuple((integer(get(i, "acquisition")) or 0, str(get(i, "path", ""))) for i in get(w, "images", []))


def label_names(attributes: dict) -> tuple[str, ...]:
    names = get(ome_attributes(attributes), "labels")
    if not isinstance(names, list):
        raise MetadataError("no labels")
    return tuple(str(n) for n in names)


@dataclass(frozen=True)
class ImageLabel:
    version: str | None
    colors: tuple[tuple[float, tuple[int, ...] | None], ...]
    properties: tuple[dict, ...] = field(hash=False, compare=False, default=())
    source: str | None = None


def image_label(attributes: dict) -> ImageLabel:
    found = get(ome_attributes(attributes), "image-label")
    if not isinstance(found, dict):
        raise MetadataError("no image-label")
    colors = tuple((number(get(c, "label-value")) or 0, tuple(integer(v) for v in get(c, "rgba")) if get(c, "rgba") else None) for c in get(found, "colors", []))
    return ImageLabel(get(found, "version"), colors, tuple(get(found, "properties", [])), get(get(found, "source"), "image"))


@dataclass(frozen=True)
class Bioformats2Raw:
    layout: int
    series: tuple[str, ...] | None


def bioformats2raw(attributes: dict, ome_group: dict | None = None) -> Bioformats2Raw:
    """The layout number, 0 if absent, and the series that the OME group lists, with or without the envelope."""
    layout = integer(get(ome_attributes(attributes), "bioformats2raw.layout", get(attributes, "bioformats2raw.layout"))) or 0
    series = get(ome_attributes(ome_group), "series") if ome_group else None
    return Bioformats2Raw(layout, tuple(map(str, series)) if isinstance(series, list) else None)
