"""Creating 5-D images, and writing planes and regions of them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from voxelith.functions.transforms import PixelRegion
from voxelith.operators.nodes import ImageNode, open_zarr
from voxelith.sources.errors import MetadataError, UnsupportedError
from voxelith.sources.metadata import data_type
from voxelith.sources.store import store_or_new

AXES = "tczyx"


@dataclass(frozen=True)
class LevelShape:
    """A coarser level: its y and x, and how many times coarser they are."""

    size_y: int
    size_x: int
    downsample: float = 2.0


@dataclass(frozen=True)
class ZCT:
    z: int
    c: int
    t: int

    def __str__(self) -> str:
        return f"Z={self.z}, C={self.c}, T={self.t}"


@dataclass(frozen=True)
class ImageShape:
    """What a new image is: five axes, element type, chunks and pixel sizes in micrometres."""

    size_x: int
    size_y: int
    size_z: int = 1
    size_c: int = 1
    size_t: int = 1
    dtype: str = "uint16"
    name: str = "image"
    chunk_y: int = 512
    chunk_x: int = 512
    pixel_x: float = 1.0
    pixel_y: float = 1.0
    pixel_z: float = 1.0
    levels: tuple[LevelShape, ...] = field(default=())

    @classmethod
    def from_zct(cls, size_x: int, size_y: int, zct: ZCT, **given) -> ImageShape:
        return cls(size_x, size_y, zct.z, zct.c, zct.t, **given)

    def all_levels(self) -> list[LevelShape]:
        return [LevelShape(self.size_y, self.size_x, 1.0), *self.levels]


def root_document(image: ImageShape) -> dict:
    """The group's zarr.json; each level's scale is its own, and the pyramid adds none."""
    axes = [{"name": "t", "type": "time"}, {"name": "c", "type": "channel"}, *[{"name": n, "type": "space", "unit": "micrometer"} for n in "zyx"]]
    sets = []
    for k, level in enumerate(image.all_levels()):
        scale = [1.0, 1.0, image.pixel_z, image.pixel_y * level.downsample, image.pixel_x * level.downsample]
        sets.append({"path": str(k), "coordinateTransformations": [{"type": "scale", "scale": scale}]})
    ome = {"version": "0.5", "multiscales": [{"name": image.name, "axes": axes, "datasets": sets}]}
    return {"zarr_format": 3, "node_type": "group", "attributes": {"ome": ome}}


def array_document(image: ImageShape, level: LevelShape) -> dict:
    kind = data_type(image.dtype)
    chunk = [1, 1, 1, min(image.chunk_y, level.size_y), min(image.chunk_x, level.size_x)]
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "blosc", "configuration": {"cname": "lz4", "clevel": 5, "shuffle": "shuffle" if kind.size > 1 else "noshuffle", "typesize": kind.size, "blocksize": 0}}]
    return {
        "zarr_format": 3,
        "node_type": "array",
        "shape": [image.size_t, image.size_c, image.size_z, level.size_y, level.size_x],
        "data_type": image.dtype,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "fill_value": False if image.dtype == "bool" else 0,
        "codecs": codecs,
        "dimension_names": list(AXES),
        "attributes": {},
    }


@dataclass
class ImageWriter:
    """An image that was created; pixels are written by cells or by bytes. Coarser levels are the caller's."""

    node: ImageNode
    image: ImageShape

    def _level(self, index: int):
        return self.node.level(index)

    def write_cells(self, cells: DataFrame, level: int = 0, overwrite: bool = False) -> None:
        """Rows (t, c, z, y, x, value) of any part of a level."""
        self._level(level).write(cells.select(*AXES, "value"), overwrite)

    def write_pixels(self, data: bytes) -> None:
        """All of the finest level."""
        shape = self._level(0).shape
        self._level(0).write_region(PixelRegion((0,) * 5, shape), data)

    def write_plane(self, z: int, data: bytes) -> None:
        """All times and channels at one z of the finest level."""
        t, c, _, y, x = self._level(0).shape
        self._level(0).write_region(PixelRegion((0, 0, z, 0, 0), (t, c, z + 1, y, x)), data)

    def write_region(self, t: int, c: int, z: int, y: int, x: int, height: int, width: int, data: bytes, level: int = 0) -> None:
        """A rectangle of one t, c and z, of any level."""
        self._level(level).write_region(PixelRegion((t, c, z, y, x), (t + 1, c + 1, z + 1, y + height, x + width)), data)


def create_image(spark: SparkSession, uri: str, image: ImageShape, levels: Sequence[LevelShape] | None = None) -> ImageWriter:
    """Writes the metadata of a new image at once, in a local folder or an S3 prefix."""
    if uri.lower().startswith(("http://", "https://")):
        raise UnsupportedError("creating images over HTTP")
    if levels is not None:
        if not levels:
            raise MetadataError("an image needs a level")
        image = ImageShape(**{**image.__dict__, "size_y": levels[0].size_y, "size_x": levels[0].size_x, "levels": tuple(levels[1:])})
    if min(image.size_x, image.size_y, image.size_z, image.size_c, image.size_t) < 1:
        raise MetadataError("every axis needs a cell")
    store = store_or_new(uri)
    store.write("zarr.json", json.dumps(root_document(image), indent=1).encode())
    for k, level in enumerate(image.all_levels()):
        store.write(f"{k}/zarr.json", json.dumps(array_document(image, level), indent=1).encode())
    return ImageWriter(open_zarr(spark, uri), image)
