"""Queries over stores: driver tables are written as Zarr arrays of many layouts in the shared folder, and read again.

The SQL says the same of the tables themselves, so that opening, metadata, codecs, reads, writes
and navigation are each held against rows that never were in a store.
"""

from __future__ import annotations

import functools
import http.server
import json
import os
import threading
import urllib.parse
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.functions.transforms import PhysicalROI, PixelRegion
from voxelith.operators import analytics as A
from voxelith.operators import nodes as N
from voxelith.operators import writer as W
from voxelith.operators.views import ArrayView
from voxelith.plans.tables import embeddings, events, labels, table
from voxelith.session import shared_folder
from voxelith.sources.codecs import CODECS, EMPTY
from voxelith.sources.errors import CodecError, RegionError, UnsupportedError
from voxelith.sources.metadata import open_array
from voxelith.sources.store import HttpStore, join_key, open_store, store_or_new
from voxelith.sources.zarr import chunk_coordinates, read_cells, read_chunks, read_region, validate_region, write_cells

QUERIES: dict = {}
ORACLE_SQL: dict = {}

EMB = "(SELECT vec_id AS y, CAST(i - 1 AS BIGINT) AS x, embedding[i] AS value FROM embeddings, range(1, 65) r(i))"
N_VECTORS = "(SELECT max(vec_id) + 1 FROM embeddings)"
#: Events by type, hour, user div 10 and user mod 10, all days at t = 0.
IMG = """(SELECT 0::BIGINT AS t, CAST(list_position(['click','error','purchase','signup','view'], event_type) - 1 AS BIGINT) AS c, CAST(hour(ts) AS BIGINT) AS z,
  CAST(user_id // 10 AS BIGINT) AS y, CAST(user_id % 10 AS BIGINT) AS x, CAST(count(*) AS INTEGER) AS value FROM events GROUP BY ALL)"""
IMG_SIZE = "(5 * 24 * (max(user_id) // 10 + 1) * 10)"
CHUNK = (50, 16)


def query(sql: str, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__], ORACLE_SQL[name or f.__name__] = f, sql
        return f

    return add


def new_store(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see."""
    where = urllib.parse.urlsplit(shared_folder(spark)).path
    path = os.path.join(where, f"stores-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    return path


def put(uri: str, key: str, document) -> None:
    store_or_new(uri).write(key, document if isinstance(document, bytes) else json.dumps(document).encode())


def array_v3(shape, chunk, dtype: str, codecs: list, separator: str = "/", encoding: str = "default", fill=0, names=("y", "x")) -> dict:
    return {
        "zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": dtype, "fill_value": fill, "attributes": {}, "dimension_names": list(names), "codecs": codecs,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunk)}}, "chunk_key_encoding": {"name": encoding, "configuration": {"separator": separator}},
    }


def array_v2(shape, chunk, code: str, compressor=None, separator: str | None = ".", order: str = "C") -> dict:
    doc = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunk), "dtype": code, "compressor": compressor, "fill_value": 0, "order": order, "filters": None}
    return doc | ({"dimension_separator": separator} if separator else {})


def emb_v3(spark: SparkSession, sf_dir: str, codecs: list, **given) -> str:
    """The embeddings as one array of a new store, written through its codecs by Spark."""
    view, uri = embeddings(spark, sf_dir), new_store(spark)
    put(uri, "zarr.json", array_v3(view.shape, given.pop("chunk", CHUNK), "float32", codecs, **given))
    write_cells(view.cells, uri)
    return uri


def emb_v2(spark: SparkSession, sf_dir: str, code: str = "<f4", **given) -> str:
    view, uri = embeddings(spark, sf_dir), new_store(spark)
    put(uri, ".zarray", array_v2(view.shape, CHUNK, code, **given))
    write_cells(view.cells, uri)
    return uri


_BYTES = {"name": "bytes", "configuration": {"endian": "little"}}
_BLOSC = {"cname": "lz4", "clevel": 5, "shuffle": "shuffle", "typesize": 4, "blocksize": 0}
_blosc = lambda **x: [_BYTES, {"name": "blosc", "configuration": _BLOSC | x}]

#: Layouts that hold the same cells: name, codecs and what else is different.
LAYOUTS_V3 = {
    "C1_C3_pipeline_bytes": ([_BYTES], {}),
    "C3_bytes_big_endian": ([{"name": "bytes", "configuration": {"endian": "big"}}], {}),
    "C4_gzip": ([_BYTES, {"name": "gzip", "configuration": {"level": 5}}], {}),
    "C5_zstd": ([_BYTES, {"name": "zstd", "configuration": {"level": 3}}], {}),
    "C6_crc32c": ([_BYTES, {"name": "zstd"}, {"name": "crc32c"}], {}),
    "C7_C9_C10_blosc_lz4_shuffled": (_blosc(), {}),
    "C8_blosc_zstd": (_blosc(cname="zstd"), {}),
    "C8_blosc_zlib": (_blosc(cname="zlib"), {}),
    "C12_blosc_not_shuffled": (_blosc(shuffle="noshuffle"), {}),
    "A4_keys_with_dots": ([_BYTES], {"separator": "."}),
    "A4_keys_of_version_2": ([_BYTES], {"encoding": "v2", "separator": "."}),
    "A8_uneven_chunks": ([_BYTES], {"chunk": (37, 29)}),
}
LAYOUTS_V2 = {
    "M2_M4_version_2": {},
    "M4_big_endian": {"code": ">f4"},
    "M4_fortran_order": {"order": "F"},
    "C2_gzip": {"compressor": {"id": "gzip", "level": 4}},
    "C2_zstd": {"compressor": {"id": "zstd", "level": 2}, "separator": "/"},
    "C2_blosc": {"compressor": {"id": "blosc", "cname": "lz4", "clevel": 5, "shuffle": 1}},
}


def _of_layouts() -> None:
    for name, (codecs, given) in LAYOUTS_V3.items():
        query(f"SELECT * FROM {EMB}", name)(lambda spark, sf_dir, c=codecs, g=given: read_cells(spark, emb_v3(spark, sf_dir, c, **g)))
    for name, given in LAYOUTS_V2.items():
        query(f"SELECT * FROM {EMB}", name)(lambda spark, sf_dir, g=given: read_cells(spark, emb_v2(spark, sf_dir, **g)))


_of_layouts()


def sharded(spark: SparkSession, sf_dir: str, at_end: bool = True) -> str:
    """The embeddings in shards, each made by one task; inner chunks of nothing but 0 are left out."""
    view, uri = embeddings(spark, sf_dir), new_store(spark)
    shard, inner = (100, 32), (25, 16)
    config = {"chunk_shape": list(inner), "codecs": [_BYTES, {"name": "zstd"}], "index_codecs": [_BYTES, {"name": "crc32c"}], "index_location": "end" if at_end else "start"}
    put(uri, "zarr.json", array_v3(view.shape, shard, "float32", [{"name": "sharding_indexed", "configuration": config}]))

    def write(cells: pa.Table) -> pa.Table:
        store, meta = open_store(uri), open_array(open_store(uri))
        y, x = (np.asarray(cells[c]) for c in "yx")
        coord = int(y[0]) // shard[0], int(x[0]) // shard[1]
        full = meta.filled(shard, True)
        full[y % shard[0], x % shard[1]] = np.asarray(cells["value"])
        parts = [full[tuple(slice(i * n, (i + 1) * n) for i, n in zip(at, inner, strict=True))] for at in chunk_coordinates((0, 0), shard, inner)]
        store.write(meta.key(coord), meta.sharding.encode([meta.sharding.pipeline.encode(p.tobytes()) if p.any() else None for p in parts]))
        return pa.table({"n": pa.array([1], pa.int64())})

    cells = view.cells.where("y >= 25 OR x >= 16").select("*", F.expr(f"y div {shard[0]}").alias("a"), F.expr(f"x div {shard[1]}").alias("b"))
    cells.groupBy("a", "b").applyInArrow(write, "n long").agg(F.sum("n")).collect()
    return uri


@query(f"SELECT y, x, CASE WHEN y < 25 AND x < 16 THEN 0 ELSE value END AS value FROM {EMB}")
def C13_C14_A6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_cells(spark, sharded(spark, sf_dir))


@query(f"SELECT y, x, CASE WHEN y < 25 AND x < 16 THEN 0 ELSE value END AS value FROM {EMB} WHERE y >= 10 AND y < 130 AND x >= 5 AND x < 40")
def A6_shards_index_first_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_cells(spark, sharded(spark, sf_dir, at_end=False), start=(10, 5), end=(130, 40))


@query("SELECT * FROM (VALUES ('bitshuffle', true), ('blosclz', true), ('snappy', true), ('lz4', false), ('codec', true), ('filters', true)) t(what, refused)")
def C11_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can't be read is refused when it is met, never misread."""
    frame = CODECS["blosc"]({"cname": "lz4", "clevel": 5, "shuffle": "shuffle", "typesize": 4}, 4).encode(bytes(range(256)) * 8)
    altered = lambda flags: bytes([*frame[:2], flags, *frame[3:]])
    tries = {"bitshuffle": altered(frame[2] & ~1 | 4), "blosclz": altered(frame[2] & 0x1F), "snappy": altered(frame[2] & 0x1F | 2 << 5), "lz4": frame}
    rows = []
    for what, data in tries.items():
        try:
            CODECS["blosc"]({}, 4).decode(data, 2048)
            rows.append((what, False))
        except (UnsupportedError, CodecError):
            rows.append((what, True))
    uri = new_store(spark)
    put(uri, "a/zarr.json", array_v3((4,), (2,), "uint8", [{"name": "unheard of"}], names=("x",)))
    put(uri, "b/.zarray", array_v2((4,), (2,), "|u1") | {"filters": [{"id": "delta"}]})
    for what, path in (("codec", "a"), ("filters", "b")):
        try:
            open_array(open_store(uri), path)
            rows.append((what, False))
        except UnsupportedError:
            rows.append((what, True))
    return spark.createDataFrame(rows, "what string, refused boolean")


# --- stores ---------------------------------------------------------------------------------

_KEYS = f"SELECT 'c/' || (y // 50) || '/' || (x // 16) AS k FROM {EMB} GROUP BY ALL"


@query(f"{_KEYS} UNION ALL SELECT 'zarr.json'")
def S1_S2_S6_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in open_store(emb_v3(spark, sf_dir, [_BYTES])).list()], "k string")


@query(f"SELECT k, 3200::BIGINT AS n_bytes, true AS there FROM ({_KEYS}) UNION ALL SELECT 'c/9999/0', NULL, false")
def S3_S5_read_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys read and sought by the executors."""
    uri = emb_v3(spark, sf_dir, [_BYTES])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = open_store(uri)
        for b in batches:
            keys = b.column("k").to_pylist()
            raw = [store.read(k) for k in keys]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([r and len(r) for r in raw], pa.int64()), pa.array([store.exists(k) for k in keys])], ["k", "n_bytes", "there"])

    keys = read_chunks(spark, uri).select(F.col("store_key").alias("k")).unionByName(spark.createDataFrame([("c/9999/0",)], "k string"))
    return keys.mapInArrow(look, "k string, n_bytes long, there boolean")


@query(f"SELECT y, x, CASE WHEN (y // 50 + x // 16) % 2 = 0 THEN 0 ELSE value END AS value FROM {EMB}")
def S4_S7_A7_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other chunk is deleted and reads as fill value."""
    uri = emb_v3(spark, sf_dir, [_BYTES])
    store = open_store(uri)
    for key in store.list("c"):
        y, x = map(int, key.split("/")[1:])
        if (y + x) % 2 == 0:
            store.delete(key)
    return read_cells(spark, uri)


@query("SELECT * FROM (VALUES ('../other', true), ('a/../../b', true), ('a/../b', false), ('c/0/0', false)) t(k, refused)")
def S8_traversal_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, rows = open_store(new_store(spark)), []
    for key in ("../other", "a/../../b", "a/../b", "c/0/0"):
        try:
            store.read(key)
            rows.append((key, False))
        except PermissionError:
            rows.append((key, True))
    return spark.createDataFrame(rows, "k string, refused boolean")


@functools.cache
def served(root: str) -> str:
    """A folder over HTTP, from the driver, for as long as it lives."""

    class Quiet(http.server.SimpleHTTPRequestHandler):
        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Quiet, directory=root))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return f"http://127.0.0.1:{server.server_port}"


@query(f"SELECT * FROM {EMB} WHERE y >= 60 AND y < 200 AND x >= 20")
def S9_S10_S13_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region over HTTP; the server is the driver's, so on a cluster its host must be named instead."""
    return read_cells(spark, served(emb_v3(spark, sf_dir, [_BYTES, {"name": "zstd"}])), start=(60, 20), end=(200, 64))


@query("SELECT * FROM (VALUES ('there', true), ('absent', false), ('write', false), ('list', false), ('delete', false)) t(what, ok)")
def S11_S12_http_exists_and_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = new_store(spark)
    put(uri, "zarr.json", {})
    store, rows = HttpStore(served(uri)), []
    rows += [("there", store.exists("zarr.json")), ("absent", store.exists("other.json"))]
    for what, act in (("write", lambda: store.write("a", b"")), ("list", lambda: store.list()), ("delete", lambda: store.delete("a"))):
        try:
            act()
            rows.append((what, True))
        except UnsupportedError:
            rows.append((what, False))
    return spark.createDataFrame(rows, "what string, ok boolean")


# --- reads ----------------------------------------------------------------------------------


@query(f"SELECT y // 50 AS cy, x // 16 AS cx, 'c/' || (y // 50) || '/' || (x // 16) AS store_key, 3200::BIGINT AS n_bytes FROM {EMB} GROUP BY ALL")
def A3_E14_chunk_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read_chunks(spark, emb_v3(spark, sf_dir, [_BYTES]))
    return chunks.where("present").select(F.get("chunk_coord", F.lit(0)).alias("cy"), F.get("chunk_coord", F.lit(1)).alias("cx"), "store_key", F.octet_length("payload").cast("long").alias("n_bytes"))


@query(f"SELECT * FROM {EMB} WHERE y IN (3, 77, 401) AND x >= 7 AND x <= 40")
def A1_pushed_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_cells(spark, emb_v3(spark, sf_dir, [_BYTES])).where("y IN (3, 77, 401) AND x >= 7 AND x <= 40")


@query("SELECT * FROM (VALUES ('inside', true), ('start at the end', false), ('empty', false), ('negative', false), ('too long', false), ('wrong rank', false)) t(what, ok)")
def A2_validate_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = {"inside": ((0, 0), (5, 7)), "start at the end": ((5, 0), (6, 1)), "empty": ((1, 1), (1, 2)), "negative": ((-1, 0), (1, 1)), "too long": ((0, 0), (5, 8)), "wrong rank": ((0,), (1,))}
    rows = []
    for what, (start, end) in boxes.items():
        try:
            validate_region((5, 7), start, end)
            rows.append((what, True))
        except RegionError:
            rows.append((what, False))
    return spark.createDataFrame(rows, "what string, ok boolean")


@query(f"SELECT y, x, value FROM {EMB} WHERE y >= 40 AND y < 60 AND x >= 10 AND x < 20")
def A5_A8_chunk_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region across four chunks, copied together in this process."""
    store = open_store(emb_v3(spark, sf_dir, [_BYTES, {"name": "gzip"}]))
    block = read_region(store, open_array(store), (40, 10), (60, 20))
    return spark.createDataFrame([(40 + y, 10 + x, float(v)) for (y, x), v in np.ndenumerate(block)], "y long, x long, value float")


@query(f"SELECT y, x, CASE WHEN y >= 45 AND y < 105 AND x >= 14 AND x < 34 THEN (y * 64 + x)::FLOAT ELSE value END AS value FROM {EMB}")
def A10_A11_write_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box laid over chunks that are there: read, overlay, replace."""
    uri = emb_v3(spark, sf_dir, _blosc())
    box = embeddings(spark, sf_dir).region((45, 14), (105, 34))
    write_cells(box.cells.select("y", "x", (F.col("y") * 64 + F.col("x")).cast("float").alias("value")), uri)
    return read_cells(spark, uri)


@query(f"SELECT y, x, CASE WHEN y < 50 THEN value ELSE 0 END AS value FROM {EMB}")
def A10_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An overwriting write leaves nothing of the array before."""
    uri = emb_v3(spark, sf_dir, [_BYTES])
    write_cells(embeddings(spark, sf_dir).cells.where("y < 50"), uri, overwrite=True)
    return read_cells(spark, uri)


@query(f"SELECT 0::BIGINT AS part, 4 * 64 * {N_VECTORS} AS n_bytes")
def E10_X3_raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_store(spark)
    return _stored(spark, emb_v3(spark, sf_dir, [_BYTES]), embeddings(spark, sf_dir)).to_raw(folder)


def _stored(spark: SparkSession, uri: str, like: ArrayView) -> ArrayView:
    """A table's view with its cells from a store."""
    return ArrayView(read_cells(spark, uri), like.axes, like.shape, like.dtype, like.chunks, like.scale, like.translation, load=lambda s, e: read_cells(spark, uri, start=s, end=e))


# --- groups and metadata --------------------------------------------------------------------


def tree(spark: SparkSession, sf_dir: str) -> str:
    """A root with an image of two levels and labels, in version 0.5, and a version 2 image without declared separator."""
    uri, view, lab = new_store(spark), embeddings(spark, sf_dir), labels(spark, sf_dir)
    n = view.shape[0]
    axes = [{"name": "y", "type": "space", "unit": "um"}, {"name": "x", "type": "space", "unit": "um"}]
    scale = lambda k, y, x: {"path": str(k), "coordinateTransformations": [{"type": "scale", "scale": [y, x]}, {"type": "translation", "translation": [0.5 * k, 0.25]}]}
    ome = {"version": "0.5", "multiscales": [{"name": "emb", "axes": axes, "datasets": [scale(0, 0.5, 0.25), scale(1, 1.0, 0.5)]}], "omero": {"channels": [{"label": "only", "color": "FF0000", "active": True}]}}
    put(uri, "zarr.json", {"zarr_format": 3, "node_type": "group", "attributes": {}})
    put(uri, "image/zarr.json", {"zarr_format": 3, "node_type": "group", "attributes": {"ome": ome}})
    put(uri, "image/0/zarr.json", array_v3(view.shape, CHUNK, "float32", _blosc()))
    put(uri, "image/1/zarr.json", array_v3((-(-n // 2), 32), CHUNK, "float64", [_BYTES]))
    put(uri, "image/labels/zarr.json", {"zarr_format": 3, "node_type": "group", "attributes": {"ome": {"labels": ["cells"]}}})
    painted = {"version": "0.5", "image-label": {"colors": [{"label-value": 1, "rgba": [255, 0, 0, 255]}, {"label-value": 2, "rgba": [0, 0, 255, 255]}]}, "multiscales": [{"axes": axes[:1], "datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [0.5]}]}]}]}
    put(uri, "image/labels/cells/zarr.json", {"zarr_format": 3, "node_type": "group", "attributes": {"ome": painted}})
    put(uri, "image/labels/cells/0/zarr.json", array_v3((n,), (50,), "int32", [_BYTES], names=("y",)))
    put(uri, "old/.zgroup", {"zarr_format": 2})
    put(uri, "old/.zattrs", {"multiscales": [{"version": "0.4", "axes": ["y", "x"], "datasets": [{"path": "0"}]}]})
    put(uri, "old/0/.zarray", array_v2(view.shape, CHUNK, "<f4", separator="/"))
    write_cells(view.cells, uri, "image/0")
    write_cells(view.cells.groupBy(F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).agg(F.sum(F.col("value").cast("double")).alias("value")), uri, "image/1")
    write_cells(lab.cells, uri, "image/labels/cells/0")
    write_cells(view.cells, uri, "old/0")
    put(uri, "old/0/.zarray", array_v2(view.shape, CHUNK, "<f4", separator=None))
    return uri


@query(
    f"""SELECT * FROM (VALUES ('', NULL, 3, 'group', 'unknown', NULL, NULL, NULL), ('image', '', 3, 'group', 'image', '0.5', NULL, NULL), ('image/labels', 'image', 3, 'group', 'labels', NULL, NULL, NULL),
 ('image/labels/cells', 'image/labels', 3, 'group', 'label', '0.5', NULL, NULL), ('old', '', 2, 'group', 'image', '0.4', NULL, NULL)) t(path, parent, zarr_version, node_type, ome_type, ngff_version, dtype, n_rows)
UNION ALL SELECT p, parent, v, 'array', NULL, NULL, d, CASE WHEN half THEN ({N_VECTORS} + 1) // 2 ELSE {N_VECTORS} END
FROM (VALUES ('image/0', 'image', 3, 'float32', false), ('image/1', 'image', 3, 'float64', true), ('image/labels/cells/0', 'image/labels/cells', 3, 'int32', false), ('old/0', 'old', 2, 'float32', false)) a(p, parent, v, d, half)"""
)
def G1_G2_G3_G7_M2_M3_M4_M5_M7_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.nodes(spark, tree(spark, sf_dir)).select("path", "parent", "zarr_version", "node_type", "ome_type", "ngff_version", "dtype", F.get("shape", F.lit(0)).alias("n_rows"))


@query(f"SELECT * FROM {EMB}")
def G4_M9_separator_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.as_image(N.open_zarr(spark, tree(spark, sf_dir), "old")).level().view().cells


@query("SELECT * FROM (VALUES ('', 'image'), ('', 'old'), ('image', '0'), ('image', '1'), ('image', 'labels')) t(parent, name)")
def G5_G6_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = N.open_zarr(spark, tree(spark, sf_dir))
    assert root.has_child("image") and not root.has_child("other")
    image = N.open_zarr(spark, root.store, "image")
    return spark.createDataFrame([("", c) for c in root.children()] + [("image", c) for c in image.children()], "parent string, name string")


@query("SELECT r_regionkey AS k, r_name AS name, true AS strict_refuses FROM region")
def M1_lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with comments, trailing commas and names in other cases, one a region, read as metadata; strictly read they are refused."""
    from voxelith.sources.errors import MetadataError
    from voxelith.sources.metadata import loads, open_group

    uri, rows = new_store(spark), []
    for r in table(spark, sf_dir, "region").collect():
        text = f'{{ // a comment\n "Zarr_Format": 3, /* more */ "NODE_TYPE": "group",\n "Attributes": {{"own": [{r.r_regionkey}, "{r.r_name}",],}}, }}'.encode()
        put(uri, f"{r.r_regionkey}/zarr.json", text)
        k, name = open_group(open_store(uri), str(r.r_regionkey)).attributes["own"]
        try:
            loads(text, strict=True)
            rows.append((k, name, False))
        except MetadataError:
            rows.append((k, name, True))
    return spark.createDataFrame(rows, "k int, name string, strict_refuses boolean")


@query("SELECT * FROM (VALUES (0, '0', 0.5::DOUBLE, 0.25::DOUBLE, 0.0::DOUBLE, 'y,x', 'micrometer'), (1, '1', 1.0, 0.5, 0.5, 'y,x', 'micrometer')) t(lvl, path, size_y, size_x, at_y, axes, unit)")
def M8_T1_T2_N5_N6_N13_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelith.functions.transforms import parse_unit

    image = N.as_image(N.open_zarr(spark, tree(spark, sf_dir), "image"))
    rows = [(lv.index, lv.dataset.path, *lv.pixel_size, lv.transform[1][0], ",".join(a.name for a in lv.axes), parse_unit(lv.axes[0].unit)) for lv in image.levels()]
    return spark.createDataFrame(rows, "lvl int, path string, size_y double, size_x double, at_y double, axes string, unit string")


@query(f"SELECT y // 2 AS y, x // 2 AS x, round(sum(CAST(value AS DOUBLE)), 4) + 0.0 AS value FROM {EMB} GROUP BY ALL")
def N1_N3_N5_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = N.as_image(N.open_zarr(spark, tree(spark, sf_dir), "image")).level(1).view().cells
    return cells.select("y", "x", (F.round("value", 4) + F.lit(0.0)).alias("value"))


@query(f"SELECT 1::INTEGER AS lvl, round(max(v), 3) + 0.0 AS max_v, count(*) AS n FROM (SELECT sum(CAST(value AS DOUBLE)) AS v FROM {EMB} GROUP BY y // 2, x // 2) UNION ALL SELECT 0, round(max(CAST(value AS DOUBLE)), 3) + 0.0, count(*) FROM {EMB}")
def E9_progressive_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    image, out = N.as_image(N.open_zarr(spark, tree(spark, sf_dir), "image")), None
    for level, view in image.progressive():
        rows = A.stats(view).select(F.lit(level.index).alias("lvl"), (F.round(F.col("max_v").cast("double"), 3) + F.lit(0.0)).alias("max_v"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT 'cells' AS name, label::INTEGER AS label, count(*) AS n FROM embeddings WHERE label <> 0 GROUP BY ALL")
def N7_N8_M12_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = N.as_image(N.open_zarr(spark, tree(spark, sf_dir), "image"))
    names = image.labels().names
    cells = image.labels().open(names[0]).level().view().cells
    return cells.where("value <> 0").groupBy(F.col("value").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(names[0]).alias("name"), "label", "n")


@query("SELECT * FROM (VALUES (1.0::DOUBLE, [255, 0, 0, 255]), (2.0::DOUBLE, [0, 0, 255, 255])) t(label_value, rgba)")
def M13_label_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.as_image(N.open_zarr(spark, tree(spark, sf_dir), "image")).labels().open("cells").colors()


@query("SELECT 0::BIGINT AS c, 'only' AS label, 'FF0000' AS color, true AS active")
def E12_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.as_image(N.open_zarr(spark, tree(spark, sf_dir), "image")).channels()


@query(f"SELECT label, round(avg(CAST(e.value AS DOUBLE)), 4) + 0.0 AS mean_v FROM {EMB} e JOIN embeddings ON vec_id = y WHERE label <> 0 GROUP BY label")
def N8_masked_mean_of_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = N.as_image(N.open_zarr(spark, tree(spark, sf_dir), "image"))
    made = A.masked_mean(image.level().view(), image.labels().open("cells").level().view())
    return made.select("label", (F.round("mean_v", 4) + F.lit(0.0)).alias("mean_v"))


# --- plates and series ----------------------------------------------------------------------


def plate(spark: SparkSession, sf_dir: str) -> str:
    """Wells by nation, fields by market segment: customers' balances, rounded down, at y = key div 64, x = key mod 64. Each field is written by one task."""
    uri = new_store(spark)
    customers = table(spark, sf_dir, "customer")
    side = int(customers.agg(F.max("c_custkey")).first()[0] or 0) // 64 + 1
    segments = [r[0] for r in customers.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]
    wells = [f"{'ABCD'[k % 4]}/{k // 4 + 1}" for k in sorted({r[0] for r in customers.select("c_nationkey").distinct().collect()})]
    at = lambda p: {"path": p, "rowIndex": "ABCD".index(p[0]), "columnIndex": int(p[2:]) - 1}
    put(uri, ".zgroup", {"zarr_format": 2})
    put(uri, ".zattrs", {"plate": {"name": "customers", "rows": [{"name": r} for r in "ABCD"], "columns": [{"name": str(k + 1)} for k in range(7)], "wells": [at(p) for p in wells], "version": "0.4"}})
    for p in wells:
        put(uri, f"{p}/.zgroup", {"zarr_format": 2})
        put(uri, f"{p}/.zattrs", {"well": {"images": [{"path": str(k)} for k in range(len(segments))], "version": "0.4"}})
    image = {"multiscales": [{"version": "0.4", "axes": [{"name": "y", "type": "space"}, {"name": "x", "type": "space"}], "datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [1.0, 1.0]}]}]}]}

    def write(cells: pa.Table) -> pa.Table:
        field = f"{cells['well'][0].as_py()}/{cells['field'][0].as_py()}"
        put(uri, f"{field}/.zgroup", {"zarr_format": 2})
        put(uri, f"{field}/.zattrs", image)
        put(uri, f"{field}/0/.zarray", array_v2((side, 64), (64, 64), "<i4", {"id": "zstd", "level": 1}))
        store, meta = open_store(uri), open_array(open_store(uri), f"{field}/0")
        cells = cells.filter(cells["v"].is_valid())
        y, x, v = (np.asarray(cells[c]) for c in ("y", "x", "v"))
        for k in np.unique(y // 64):
            full, own = meta.filled(meta.chunks, True), y // 64 == k
            full[y[own] % 64, x[own]] = v[own]
            store.write(meta.key((int(k), 0)), meta.pipeline.encode(full.tobytes()))
        return pa.table({"n": pa.array([len(y)], pa.int64())})

    key, fields = F.col("c_custkey"), F.array(*[F.lit(s) for s in segments])
    well = F.concat(F.substring(F.lit("ABCD"), F.col("c_nationkey") % 4 + 1, F.lit(1)), F.lit("/"), F.expr("CAST(c_nationkey div 4 + 1 AS string)"))
    rows = customers.select(well.alias("well"), (F.array_position(fields, F.col("c_mktsegment")) - 1).cast("int").alias("field"), F.expr("c_custkey div 64").alias("y"), (key % 64).alias("x"), F.floor("c_acctbal").cast("int").alias("v"))
    every = spark.createDataFrame([(w, f) for w in wells for f in range(len(segments))], "well string, field int")
    empty = every.select("well", "field", *[F.lit(None).cast(t).alias(c) for c, t in (("y", "long"), ("x", "long"), ("v", "int"))])
    rows.unionByName(empty).groupBy("well", "field").applyInArrow(write, "n long").agg(F.sum("n")).collect()
    return uri


_WELL = "substr('ABCD', CAST(c_nationkey % 4 + 1 AS BIGINT), 1) || '/' || (c_nationkey // 4 + 1)"
_FIELD = "CAST((SELECT count(DISTINCT o.c_mktsegment) FROM customer o WHERE o.c_mktsegment < c.c_mktsegment) AS INTEGER)"


@query(f"SELECT DISTINCT {_WELL} AS path, substr('ABCD', CAST(c_nationkey % 4 + 1 AS BIGINT), 1) AS row_name, CAST(c_nationkey // 4 + 1 AS VARCHAR) AS column_name, CAST(c_nationkey % 4 AS INTEGER) AS row_index, CAST(c_nationkey // 4 AS INTEGER) AS column_index FROM customer")
def M10_N9_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.as_plate(N.open_zarr(spark, plate(spark, sf_dir))).wells_table()


@query(f"SELECT DISTINCT w.well, f.field, w.well || '/' || f.field AS path FROM (SELECT {_WELL} AS well FROM customer) w, (SELECT {_FIELD} AS field FROM customer c) f")
def M11_N10_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.as_plate(N.open_zarr(spark, plate(spark, sf_dir))).fields_table().select("well", "field", "path")


@query(f"SELECT {_WELL} AS well, {_FIELD} AS field, count(*) AS n, CAST(sum(CAST(floor(c_acctbal) AS INTEGER)) AS BIGINT) AS total FROM customer c WHERE CAST(floor(c_acctbal) AS INTEGER) <> 0 GROUP BY ALL")
def E7_E11_plate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = N.as_plate(N.open_zarr(spark, plate(spark, sf_dir))).cells()
    return cells.where("value <> 0").groupBy("well", "field").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query(f"SELECT c_custkey // 64 AS y, c_custkey % 64 AS x, CAST(floor(c_acctbal) AS INTEGER) AS value FROM customer c WHERE c_nationkey = 6 AND {_FIELD} = 1 AND CAST(floor(c_acctbal) AS INTEGER) <> 0")
def N2_N4_N10_one_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.as_plate(N.open_zarr(spark, plate(spark, sf_dir))).well("C", "2").field(1).level().view().plane().cells.where("value <> 0")


def collection(spark: SparkSession, sf_dir: str, listed: bool) -> str:
    """Regions as numbered series, with their OME-XML."""
    uri = new_store(spark)
    names = [(r.r_regionkey, r.r_name) for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    put(uri, ".zgroup", {"zarr_format": 2})
    put(uri, ".zattrs", {"bioformats2raw.layout": 3} | ({"series": [str(k) for k, _ in names]} if listed else {}))
    images = "".join(
        f'<Image ID="Image:{k}" Name="{n}"><InstrumentRef ID="Instrument:0"/><ObjectiveSettings ID="Objective:0"/>'
        f'<Pixels ID="Pixels:{k}" Type="uint8" DimensionOrder="XYZCT" SizeX="{k + 2}" SizeY="3" SizeZ="1" SizeC="1" SizeT="1" PhysicalSizeX="{0.5 * (k + 1)}"/></Image>'
        for k, n in names
    )
    put(uri, "OME/METADATA.ome.xml", f'<OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Instrument ID="Instrument:0"><Objective ID="Objective:0" Model="Plan" NominalMagnification="20"/></Instrument>{images}</OME>'.encode())
    put(uri, "OME/.zgroup", {"zarr_format": 2})
    for k, n in names:
        put(uri, f"{k}/.zgroup", {"zarr_format": 2})
        put(uri, f"{k}/.zattrs", {"multiscales": [{"version": "0.4", "datasets": [{"path": "0"}]}]})
        put(uri, f"{k}/0/.zarray", array_v2((3, k + 2), (3, k + 2), "|u1"))
        put(uri, f"{k}/0/0.0", bytes([len(n)]) * (3 * (k + 2)))
    return uri


@query("SELECT r_regionkey AS series, CAST(r_regionkey AS VARCHAR) AS path, r_name AS name, CAST(r_regionkey + 2 AS INTEGER) AS size_x, 3 AS size_y, 0.5 * (r_regionkey + 1)::DOUBLE AS physical_size_x, 'Plan' AS objective FROM region")
def M14_M15_M16_N11_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.as_collection(N.open_zarr(spark, collection(spark, sf_dir, True))).series_table()


@query("SELECT r_regionkey AS series, CAST(length(r_name) * 3 * (r_regionkey + 2) AS BIGINT) AS total FROM region")
def N12_M18_series_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    node, out = N.as_collection(N.open_zarr(spark, collection(spark, sf_dir, False))), None
    for k in range(len(node.series_paths())):
        rows = node.series(k).level().view().cells.agg(F.sum("value").alias("total")).select(F.lit(k).alias("series"), "total")
        out = rows if out is None else out.unionByName(rows)
    return out


# --- the writer -----------------------------------------------------------------------------


def written(spark: SparkSession, sf_dir: str) -> tuple[W.ImageWriter, ArrayView]:
    """The events as a five-dimensional image of two levels."""
    like = events(spark, sf_dir)
    _, c, z, y, x = like.shape
    shape = W.ImageShape(x, y, z, c, 1, name="events", chunk_y=64, chunk_x=64, pixel_x=0.5, pixel_y=0.5, levels=(W.LevelShape(-(-y // 2), -(-x // 2)),))
    made = W.create_image(spark, os.path.join(new_store(spark), "image.zarr"), shape)
    cells = like.cells.groupBy(F.lit(0).cast("long").alias("t"), "c", "z", "y", "x").agg(F.sum("value").cast("int").alias("value"))
    made.write_cells(cells)
    made.write_cells(cells.groupBy("t", "c", "z", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).agg(F.sum("value").cast("int").alias("value")), level=1)
    return made, made.node.level().view()


@query(f"SELECT * FROM {IMG}")
def W1_W2_W5_written_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir)[1].cells.where("value > 0")


@query(f"SELECT t, c, z, y // 2 AS y, x // 2 AS x, CAST(sum(value) AS INTEGER) AS value FROM {IMG} GROUP BY ALL")
def W5_coarser_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir)[0].node.level(1).view().cells.where("value > 0")


@query(
    "SELECT 'image' AS node, '0.5' AS ngff_version, NULL AS shape, NULL AS chunk UNION ALL SELECT 'array', NULL, [1, 5, 24, max(user_id) // 10 + 1, 10]::BIGINT[], [1, 1, 1, least(64, max(user_id) // 10 + 1), 10]::INTEGER[] FROM events "
    "UNION ALL SELECT 'array', NULL, [1, 5, 24, (max(user_id) // 10 + 2) // 2, 5]::BIGINT[], [1, 1, 1, least(64, (max(user_id) // 10 + 2) // 2), 5]::INTEGER[] FROM events"
)
def W3_W4_written_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.nodes(spark, written(spark, sf_dir)[0].node.uri)
    return found.select(F.coalesce("ome_type", "node_type").alias("node"), "ngff_version", "shape", F.col("chunk_shape").alias("chunk"))


@query(f"SELECT z, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM (SELECT * FROM {IMG} WHERE z <> 7 AND NOT (z = 3 AND c = 2 AND y = 0 AND x < 4)) GROUP BY z UNION ALL SELECT 7, {IMG_SIZE} // 24, 9 * {IMG_SIZE} // 24 FROM events")
def W6_W7_W8_planes_and_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One z written over with nines, a strip of another with zeros."""
    made, view = written(spark, sf_dir)
    _, c, _, y, x = view.shape
    made.write_plane(7, np.full(c * y * x, 9, "<u2").tobytes())
    made.write_region(0, 2, 3, 0, 0, 1, 4, np.zeros(4, "<u2").tobytes())
    return view.cells.where("value > 0").groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query(f"SELECT z, round(CAST(sum(value) AS DOUBLE) / (SELECT {IMG_SIZE} // 24 FROM events), 6) AS mean_v FROM {IMG} GROUP BY z")
def E2_mean_per_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all cells, absent ones too, which are 0; aggregated where chunks are read."""
    return A.stats(written(spark, sf_dir)[1], by=["z"]).select("z", F.round("mean_v", 6).alias("mean_v"))


@query(f"SELECT min(0) AS min_v, max(value) AS max_v, round(CAST(sum(value) AS DOUBLE) / (SELECT {IMG_SIZE} FROM events), 6) AS mean_v, (SELECT {IMG_SIZE} FROM events) AS n FROM {IMG}")
def E1_image_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.stats(written(spark, sf_dir)[1]).select("min_v", "max_v", F.round("mean_v", 6).alias("mean_v"), "n")


@query(f"SELECT y // 4 AS ty, x // 4 AS tx, CAST(sum(value) AS BIGINT) AS total FROM {IMG} GROUP BY ALL")
def E8_tile_sums_of_a_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tile_sums(written(spark, sf_dir)[1], 4, 4)


@query(f"SELECT c, max(value) AS max_v, (SELECT {IMG_SIZE} // 120 FROM events) AS n FROM {IMG} WHERE z = 6 GROUP BY c")
def E3_channel_planes_of_a_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.channel_planes(written(spark, sf_dir)[1], 0, 6).select("c", "max_v", "n")


@query(f"SELECT * FROM {IMG} WHERE c = 1 AND z = 5 AND y < 2 AND x >= 1 AND x < 6")
def P1_P2_P6_tile_of_a_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = written(spark, sf_dir)[1]
    same = view.tile(t=0, c=1, z=5, y=0, x=1, height=2, width=5, mode="strict")
    roi = view.physical_roi(PhysicalROI((0.0, 1.0, 5.0, 0.0, 0.5), (1.0, 1.0, 1.0, 1.0, 2.5)))
    assert (same.start, same.end) == (roi.start, roi.end) == ((0, 1, 5, 0, 1), (1, 2, 6, 2, 6)) and view.pixel_region(PixelRegion(same.start, same.end)).extent == same.extent
    return same.cells.where("value > 0")


@query(f"SELECT 'uint16 t=1 x c=5 x z=24 x y=' || (max(user_id) // 10 + 1) || ' x x=10' AS summary, 10 AS width, CAST(max(user_id) // 10 + 1 AS INTEGER) AS height, {IMG_SIZE} AS n FROM events")
def X9_P9_P10_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = written(spark, sf_dir)[1]
    return spark.createDataFrame([(str(view), view.width, view.height, view.element_count)], "summary string, width int, height int, n long")
