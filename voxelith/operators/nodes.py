"""Navigation: from a store's root to plates, wells, fields, series, labels and resolution levels."""

from __future__ import annotations

import decimal
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.functions.transforms import PixelRegion, composed, flatten
from voxelith.operators.views import ArrayView
from voxelith.sources import metadata as M
from voxelith.sources.errors import MetadataError, NodeNotFoundError, UnsupportedError
from voxelith.sources.omexml import Image, OmeXml, try_parse
from voxelith.sources.store import Store, join_key, open_store
from voxelith.sources.zarr import read_cells, read_fields, read_region, validate_region, write_cells


@dataclass
class Node:
    """A group of a store, with its attributes."""

    spark: SparkSession
    uri: str
    store: Store
    group: M.GroupMeta

    @property
    def attributes(self) -> dict:
        return self.group.attributes

    @property
    def path(self) -> str:
        return self.group.path

    @property
    def type(self) -> str:
        return M.node_type(self.attributes)

    @property
    def version(self) -> str | None:
        return M.ngff_version(self.attributes)

    def _open(self, *path: str) -> M.GroupMeta:
        return M.open_group(self.store, join_key(self.path, *path))

    def children(self) -> list[str]:
        return M.child_names(self.store, self.path)

    def has_child(self, name: str) -> bool:
        return M.has_child(self.store, self.path, name)


@dataclass
class Level:
    """One array of a pyramid."""

    image: ImageNode
    dataset: M.Dataset
    scale_of: M.Multiscale
    array: M.ArrayMeta
    index: int

    @property
    def path(self) -> str:
        return self.array.path

    @property
    def shape(self) -> tuple[int, ...]:
        return self.array.shape

    @property
    def rank(self) -> int:
        return self.array.rank

    @property
    def data_type(self) -> M.DataType:
        return self.array.type

    @property
    def axes(self) -> tuple[M.Axis, ...]:
        return M.effective_axes(self.scale_of, self.rank)

    @property
    def transform(self) -> tuple[tuple[float, ...], tuple[float, ...]]:
        return flatten(composed(self.dataset, self.scale_of), self.rank)

    @property
    def pixel_size(self) -> tuple[float, ...]:
        return self.transform[0]

    def view(self, **options) -> ArrayView:
        """The level's cells; regions of the view read only the chunks that they touch."""
        names = [a.name for a in self.axes]
        load = lambda start, end: read_cells(self.image.spark, self.image.uri, self.path, start, end, names, **options)
        summary = lambda start, end, by: read_cells(self.image.spark, self.image.uri, self.path, start, end, names, mode="partials", by=",".join(f"{n}:{k}" for n, k in by.items()), **options)
        masked = lambda start, end, labels: read_cells(self.image.spark, self.image.uri, self.path, start, end, names, mode="masked", labels=labels, **options)
        scale, translation = self.transform
        cells = read_cells(self.image.spark, self.image.uri, self.path, axes=names, **options)
        return ArrayView(cells, self.axes, self.shape, self.data_type.name, self.array.read_chunks, scale, translation, load=load, summary=summary, origin=cells, source=(self.image.uri, self.path), masked=masked)

    def read(self, start, end, zero: bool = False):
        """A small region as a NumPy array, read in this process."""
        return read_region(self.image.store, self.array, start, end, zero)

    def write(self, cells: DataFrame, overwrite: bool = False) -> None:
        write_cells(cells, self.image.uri, self.path, overwrite)

    def write_region(self, region: PixelRegion, data: bytes) -> None:
        """Bytes of a small region, little-endian, last axis fastest."""
        write_bytes(self.image.spark, self.image.uri, self.array, region, data)


def write_bytes(spark: SparkSession, uri: str, array: M.ArrayMeta, region: PixelRegion, data: bytes) -> None:
    """Lays a region's bytes over the array, each chunk by one task."""
    start, end = validate_region(array.shape, region.start, region.end)
    shape = [e - s for s, e in zip(start, end, strict=True)]
    if len(data) != math.prod(shape) * array.type.size:
        raise ValueError(f"{len(data)} bytes for a region of {math.prod(shape) * array.type.size}")
    values = np.frombuffer(data, array.type.numpy)
    index = np.indices(shape).reshape(len(shape), -1) + np.array(start)[:, None]
    names = [f"d{k}" for k in range(len(shape))]
    frame = pd.DataFrame({n: index[k] for k, n in enumerate(names)})
    if array.type.name == "uint64":
        frame["value"] = [decimal.Decimal(int(v)) for v in values]
    else:
        frame["value"] = values.astype({"uint8": "int16", "uint16": "int32", "uint32": "int64"}.get(array.type.name, values.dtype))
    write_cells(spark.createDataFrame(frame, ", ".join([*[f"{n} bigint" for n in names], f"value {array.type.spark}"])), uri, array.path)


class ImageNode(Node):
    """A pyramid of resolution levels, plain or of labels."""

    @property
    def multiscales(self) -> tuple[M.Multiscale, ...]:
        return M.multiscales(self.attributes)

    def level(self, index: int = 0, multiscale: int = 0) -> Level:
        scales = self.multiscales
        if not 0 <= multiscale < len(scales):
            raise IndexError(f"no multiscale {multiscale}")
        sets = scales[multiscale].datasets
        if not 0 <= index < len(sets):
            raise IndexError(f"no level {index}")
        array = M.open_array(self.store, join_key(self.path, sets[index].path))
        return Level(self, sets[index], scales[multiscale], array, index)

    def levels(self, multiscale: int = 0) -> list[Level]:
        """In declared order, finest first by convention."""
        return [self.level(k, multiscale) for k in range(len(self.multiscales[multiscale].datasets))]

    def progressive(self, region: Callable[[ArrayView], ArrayView] | None = None, multiscale: int = 0) -> Iterator[tuple[Level, ArrayView]]:
        """Levels from the coarsest to the finest with their views, or a part of each: the first is there soon, each next one is sharper."""
        for level in reversed(self.levels(multiscale)):
            view = level.view()
            yield level, region(view) if region else view

    def all_cells(self, multiscale: int = 0) -> DataFrame:
        """Cells of all levels with their level's index."""
        out = None
        for lv in self.levels(multiscale):
            cells = lv.view().cells.withColumn("level", F.lit(lv.index))
            out = cells if out is None else out.unionByName(cells)
        return out

    def has_labels(self) -> bool:
        return self.has_child("labels")

    def labels(self) -> LabelsNode:
        return LabelsNode(self.spark, self.uri, self.store, self._open("labels"))

    def channels(self) -> DataFrame:
        rows = [(k, c.label, c.color, c.active) for k, c in enumerate(self.multiscales[0].channels)]
        return self.spark.createDataFrame(rows, "c long, label string, color string, active boolean")


class LabelNode(ImageNode):
    @property
    def image_label(self) -> M.ImageLabel:
        return M.image_label(self.attributes)

    def colors(self) -> DataFrame:
        rows = [(float(v), list(c) if c else None) for v, c in self.image_label.colors]
        return self.spark.createDataFrame(rows, "label_value double, rgba array<int>")


class LabelsNode(Node):
    @property
    def names(self) -> tuple[str, ...]:
        return M.label_names(self.attributes)

    def open(self, name: str) -> LabelNode:
        node = LabelNode(self.spark, self.uri, self.store, self._open(name))
        if node.type != "label":
            raise MetadataError(f"{node.path} is no label image")
        return node


class WellNode(Node):
    @property
    def fields(self) -> tuple[tuple[int, str], ...]:
        return M.well(self.attributes)

    def field(self, at: int | str = 0) -> ImageNode:
        path = self.fields[at][1] if isinstance(at, int) else at
        return ImageNode(self.spark, self.uri, self.store, self._open(path))


class PlateNode(Node):
    @property
    def plate(self) -> M.Plate:
        return M.plate(self.attributes)

    def well(self, row_or_path: str, column: str | None = None) -> WellNode:
        path = row_or_path if column is None else f"{row_or_path}/{column}"
        return WellNode(self.spark, self.uri, self.store, self._open(path))

    def wells_table(self) -> DataFrame:
        """(path, row_name, column_name, row_index, column_index) of every well."""
        rows = []
        for w in self.plate.wells:
            row, _, column = w.path.partition("/")
            rows.append((w.path, row, column, w.row_index, w.column_index))
        return self.spark.createDataFrame(rows, "path string, row_name string, column_name string, row_index int, column_index int")

    def fields_table(self) -> DataFrame:
        """(well, field, acquisition, path) of every field."""
        rows = [(w.path, k, a, join_key(w.path, p)) for w in self.plate.wells for k, (a, p) in enumerate(self.well(w.path).fields)]
        return self.spark.createDataFrame(rows, "well string, field int, acquisition int, path string")

    def cells(self, level: int = 0) -> DataFrame:
        """All fields' cells with well and field, to be grouped by them: one source, whose tasks read the wells' metadata themselves."""
        return read_fields(self.spark, self.uri, [join_key(self.path, w.path) for w in self.plate.wells], len(self.path) + 1 if self.path else 0, level)


class CollectionNode(Node):
    """A bioformats2raw layout: numbered series and their OME-XML."""

    def _ome(self) -> dict | None:
        try:
            return self._open("OME").attributes
        except (NodeNotFoundError, MetadataError):
            return None

    @property
    def ome_xml(self) -> OmeXml | None:
        return try_parse(self.store.read(join_key(self.path, "OME", "METADATA.ome.xml")))

    def series_paths(self, probe: int | None = None) -> list[str]:
        """Listed series; else as many as the OME-XML has images; else those found by number, up to the first gap or ``probe`` of them."""
        listed = M.bioformats2raw(self.attributes, self._ome()).series
        if listed is not None:
            return list(listed)
        xml = self.ome_xml
        if xml is not None and xml.images:
            return [str(k) for k in range(len(xml.images))]
        out: list[str] = []
        while (probe is None or len(out) < probe) and self.has_child(str(len(out))):
            out.append(str(len(out)))
        return out

    def series(self, at: int | str = 0) -> ImageNode:
        if isinstance(at, int):
            paths = self.series_paths()
            at = paths[at] if at < len(paths) else str(at)
        return ImageNode(self.spark, self.uri, self.store, self._open(at))

    def series_xml(self, index: int) -> Image | None:
        xml = self.ome_xml
        return xml.images[index] if xml and 0 <= index < len(xml.images) else None

    def series_table(self) -> DataFrame:
        xml, rows = self.ome_xml, []
        for k, path in enumerate(self.series_paths()):
            image = xml.images[k] if xml and k < len(xml.images) else None
            lens = xml.objective_of(image) if image else None
            px = image.pixels if image else None
            rows.append((k, path, image.name if image else None, px.size_x if px else None, px.size_y if px else None, px.physical_size_x if px else None, lens.model if lens else None))
        return self.spark.createDataFrame(rows, "series int, path string, name string, size_x int, size_y int, physical_size_x double, objective string")


_KINDS = {"image": ImageNode, "label": LabelNode, "labels": LabelsNode, "plate": PlateNode, "well": WellNode, "bioformats2raw": CollectionNode}


def open_zarr(spark: SparkSession, where: str | Store, path: str = "") -> Node:
    """The node at a store's root, or at a group within: its class follows its attributes."""
    store = open_store(where) if isinstance(where, str) else where
    group = M.open_group(store, path)
    kind = M.node_type(group.attributes)
    return _KINDS.get(kind, Node)(spark, store.uri, store, group)


def _typed(node: Node, kind: type, name: str):
    if not isinstance(node, kind):
        raise MetadataError(f"{node.path or node.uri} is {'of no known type' if node.type == 'unknown' else 'a ' + node.type}, not a {name}; its children: {', '.join(node.children()[:10]) or 'none'}")
    return node


def as_image(node: Node) -> ImageNode:
    """The node as an image: label images are images too, and of a collection it is the first series."""
    return node.series(0) if isinstance(node, CollectionNode) else _typed(node, ImageNode, "image")


def as_plate(node: Node) -> PlateNode:
    return _typed(node, PlateNode, "plate")


def as_well(node: Node) -> WellNode:
    return _typed(node, WellNode, "well")


def as_collection(node: Node) -> CollectionNode:
    return _typed(node, CollectionNode, "collection of series")


# --- relations ------------------------------------------------------------------------------

NODES = "path string, name string, parent string, zarr_version int, node_type string, ome_type string, ngff_version string, attributes string, shape array<bigint>, chunk_shape array<int>, inner_chunk_shape array<int>, dtype string, separator string, codecs string, dimension_names array<string>"


def _walk(store: Store, path: str) -> Iterator[tuple]:
    parent, _, name = path.rpartition("/")
    base = (path, name, parent if path else None)
    try:
        g = M.open_group(store, path)
        yield (*base, g.version, "group", M.node_type(g.attributes), M.ngff_version(g.attributes), json.dumps(g.attributes), None, None, None, None, None, None, None)
        for child in M.child_names(store, path):
            yield from _walk(store, join_key(path, child))
    except (NodeNotFoundError, MetadataError):
        try:
            a = M.open_array(store, path)
        except UnsupportedError as e:
            yield (*base, None, "array", None, None, json.dumps({"unsupported": str(e)}), None, None, None, None, None, None, None)
            return
        except NodeNotFoundError:
            return
        inner = list(a.sharding.inner) if a.sharding else None
        yield (*base, a.version, "array", None, None, json.dumps(a.attributes), list(a.shape), list(a.chunks), inner, a.type.name, a.separator, a.codecs, list(a.dimension_names) if a.dimension_names else None)


def nodes(spark: SparkSession, uri: str) -> DataFrame:
    """Every group and array of a store that can list, one row each."""
    return spark.createDataFrame(list(_walk(open_store(uri), "")), NODES)


def child_rows(tree: DataFrame, parent: str = "") -> DataFrame:
    """Distinct names of a node's children, sorted."""
    return tree.where(F.col("parent") == parent).select("name").distinct().orderBy("name")


def _property(entries: Column, name: str) -> Column:
    """A property's JSON text by name, whatever its case; an exact name first; null counts as absent."""
    of = lambda same: F.get(F.filter(entries, same), F.lit(0))["value"]
    exact, loose = of(lambda e: e["key"] == name), of(lambda e: F.lower(e["key"]) == name.lower())
    return F.when(F.exists(entries, lambda e: e["key"] == name), exact).otherwise(loose)


def ome_type_column(attributes: Column) -> Column:
    """metadata.node_type of attributes as JSON text, in the JVM: the document and its envelope are parsed once each."""
    entries = lambda text: F.map_entries(F.from_json(text, "map<string,string>"))
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def inside(own: Column) -> Column:
        envelope = _property(own, "ome")

        def kind(ome: Column) -> Column:
            has = lambda name: _property(ome, name).isNotNull()
            image = F.when(has("image-label"), "label").otherwise("image")
            layout = has("bioformats2raw.layout") | _property(own, "bioformats2raw.layout").isNotNull()
            return F.when(has("plate"), "plate").when(layout, "bioformats2raw").when(has("well"), "well").when(has("labels"), "labels").when(has("multiscales"), image).otherwise("unknown")

        return once(F.when(F.substring(F.ltrim(envelope), 1, 1) == "{", entries(envelope)).otherwise(own), kind)

    return F.coalesce(once(entries(attributes), inside), F.lit("unknown"))
