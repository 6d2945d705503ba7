import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.s3stub import Stub
from tests.stores import put, sharded, v3_array
from voxelith.functions.transforms import parse_unit, unit_column
from voxelith.operators import analytics as A
from voxelith.operators import nodes as N
from voxelith.operators.views import ArrayView
from voxelith.sources import metadata as M
from voxelith.sources.errors import UnsupportedError
from voxelith.sources.metadata import Axis
from voxelith.sources.store import CachedStore, ChunkCache, S3Store, Store, cached_store
from voxelith.sources.zarr import ZarrReader, partials, read_cells, write_cells

GRID = np.arange(64, dtype="<u2").reshape(8, 8)


def view(spark, root, dtype="uint16", **given):
    axes = (Axis("y", "space"), Axis("x", "space"))
    summary = lambda s, e, by: read_cells(spark, root, start=s, end=e, mode="partials", by=",".join(f"{n}:{k}" for n, k in by.items()))
    cells = read_cells(spark, root)
    return ArrayView(cells, axes, (8, 8), dtype, (3, 4), (0.5, 0.5), (0.0, 0.0), load=lambda s, e: read_cells(spark, root, start=s, end=e), summary=summary, origin=cells, **given)


def test_overwrite_leaves_nothing_else(spark, tmp_path):
    v3_array(str(tmp_path), "", GRID, (3, 4))
    cells = spark.range(16).selectExpr("id div 4 AS y", "id % 4 AS x", "CAST(id + 100 AS INT) AS value")
    write_cells(cells, str(tmp_path), overwrite=True)
    got = {(r.y, r.x): r.value for r in read_cells(spark, str(tmp_path)).collect()}
    assert len(got) == 64 and all(got[y, x] == (100 + 4 * y + x if y < 4 and x < 4 else 0) for y, x in got)
    assert not os.path.exists(tmp_path / "c" / "2" / "1") and os.path.exists(tmp_path / "zarr.json")


def test_partials_like_cells(spark, tmp_path):
    v3_array(str(tmp_path), "", GRID, (3, 4), skip=[(1, 1)])
    whole = view(spark, str(tmp_path))
    for part in (whole, whole.region((1, 2), (7, 7)), whole.tile(y=5, x=6, height=9, width=9)):
        plain = ArrayView(part.cells, part.axes, part.shape, part.dtype, part.chunks, part.scale, part.translation, part.start, part.end)
        for f in (A.stats, lambda v: A.stats(v, by=["y"]), lambda v: A.stats(v, by=["x", "y"]), lambda v: A.tile_sums(v, 3, 2), A.any_nonzero):
            assert sorted(map(tuple, f(part).collect())) == sorted(map(tuple, f(plain).collect()))


def test_replaced_cells_are_the_view(spark, tmp_path):
    """A view whose cells were replaced is aggregated and cut by these, not by the store's."""
    import dataclasses

    v3_array(str(tmp_path), "", GRID, (3, 4))
    whole = view(spark, str(tmp_path))
    other = dataclasses.replace(whole, cells=whole.cells.selectExpr("y", "x", "CAST(1 AS INT) AS value"))
    assert whole.partials({}) is not None and whole.region((1, 1), (3, 3)).partials({}) is not None and other.partials({}) is None
    assert A.stats(other).first().max_v == A.stats(other.region((0, 0), (2, 2))).first().max_v == 1


def test_partials_of_types():
    for kind in ("u1", "i8", "f4", "?"):
        b = partials((2, 4), np.array([[1, 0, 1], [0, 1, 1]], kind), ("y", "x"), [(1, 2)])
        assert b.column("x").to_pylist() == [2, 3] and [float(v) for v in b.column("sum_v").to_pylist()] == [2.0, 2.0] and b.column("n").to_pylist() == [4, 2]


def test_means_under_labels_chunk_by_chunk(spark, tmp_path):
    """A mask of fewer axes and other chunks, over the whole image and a region; against the join of cells."""
    import dataclasses

    root, rng = str(tmp_path), np.random.default_rng(2)
    image, mask = rng.integers(0, 900, (3, 7, 9)).astype("<u2"), rng.integers(0, 4, (7, 9)).astype("<i4")
    axes = [{"name": n, "type": "space"} for n in "zyx"]
    sets = [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [1, 1, 1]}]}]
    put(root, "zarr.json", {"zarr_format": 3, "node_type": "group", "attributes": {"ome": {"version": "0.5", "multiscales": [{"axes": axes, "datasets": sets}]}}})
    put(root, "labels/zarr.json", {"zarr_format": 3, "node_type": "group", "attributes": {"ome": {"labels": ["m"]}}})
    put(root, "labels/m/zarr.json", {"zarr_format": 3, "node_type": "group", "attributes": {"ome": {"image-label": {}, "multiscales": [{"axes": axes[1:], "datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [1, 1]}]}]}]}}})
    v3_array(root, "0", image, (1, 3, 4))
    v3_array(root, "labels/m/0", mask, (4, 4))
    node = N.as_image(N.open_zarr(spark, root))
    labels = node.labels().open("m").level().view()
    for part in (node.level().view(), node.level().view().region((1, 2, 1), (3, 6, 8))):
        assert part.under(labels) is not None
        got = {r.label: r.mean_v for r in A.masked_mean(part, labels).collect()}
        assert got == pytest.approx({r.label: r.mean_v for r in A.masked_mean(dataclasses.replace(part, masked=None), labels).collect()}) and set(got) == {1, 2, 3}


def test_sets_of_indices_prune(spark, tmp_path):
    v3_array(str(tmp_path), "", GRID, (2, 8))
    (tmp_path / "c" / "1" / "0").write_bytes(bytes(999))  # an error if it is read
    assert read_cells(spark, str(tmp_path)).where("y IN (0, 5, 7)").count() == 24


def test_partitions_are_bounded(tmp_path):
    shape = (1 << 20, 1 << 20)
    put(str(tmp_path), "zarr.json", {"zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": "uint8", "fill_value": 0, "codecs": ["bytes"], "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [64, 64]}}, "chunk_key_encoding": {"name": "default"}})
    from voxelith.sources.metadata import open_array
    from voxelith.sources.store import LocalStore

    assert len(ZarrReader(str(tmp_path), open_array(LocalStore(str(tmp_path))), ("y", "x"), {}).partitions()) <= 100_000


def test_boxes_without_cells_count_none(spark, tmp_path):
    v3_array(str(tmp_path), "", GRID, (3, 4))
    rois = spark.createDataFrame([(1, 0, 2, 0, 2), (2, 90, 99, 0, 1), (3, 3, 3, 0, 8)], "roi_id int, y_start int, y_end int, x_start int, x_end int")
    assert sorted(map(tuple, A.by_roi(view(spark, str(tmp_path)), rois).collect())) == [(1, 4, 18), (2, 0, None), (3, 0, None)]


def test_a_plane_of_no_size_is_refused(spark, tmp_path):
    v3_array(str(tmp_path), "", GRID, (3, 4))
    for size in ({"height": 0.0}, {"width": 0.0}):
        with pytest.raises(ValueError):
            view(spark, str(tmp_path)).plane_physical(**size)


def test_raw_export(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "out").mkdir()
    v3_array(str(tmp_path / "a"), "", GRID, (3, 4), skip=[(0, 1)])
    part = view(spark, str(tmp_path / "a")).region((1, 2), (7, 7))
    rows = part.to_raw(str(tmp_path / "out"), part_cells=7).collect()
    want = GRID.copy()
    want[:3, 4:] = 0
    assert sum(r.n_bytes for r in rows) == 60 and b"".join((tmp_path / "out" / f).read_bytes() for f in sorted(os.listdir(tmp_path / "out"))) == want[1:7, 2:7].tobytes()


def test_codecs_around_shards_are_refused(spark, tmp_path):
    import json

    sharded(str(tmp_path), "", GRID, (4, 4), (2, 2))
    doc = json.loads((tmp_path / "zarr.json").read_text())
    doc["codecs"].append({"name": "gzip"})
    put(str(tmp_path), "zarr.json", doc)
    with pytest.raises(Exception, match="around sharding"):
        read_cells(spark, str(tmp_path)).count()


def test_units(spark):
    assert [parse_unit(u) for u in ("ft", "Feet", "foot", "in")] == ["foot", "foot", "foot", "inch"]
    assert spark.range(1).select(unit_column(F.lit(" FT ")).alias("u")).first().u == "foot"


DOCUMENTS = [
    {"ome": {"multiscales": [{}]}, "plate": {}},
    {"ome": {"version": "0.5"}, "multiscales": [{}]},
    {"OME": {"Plate": {}}},
    {"ome": {"multiscales": [{}], "image-label": {}}},
    {"multiscales": [{}], "image-label": None},
    {"ome": "text", "well": {}},
    {"ome": {}, "bioformats2raw.layout": 3},
    {"ome": None, "LABELS": []},
    {"plate": None, "well": {"images": []}},
    {},
]


def test_node_types_as_column_and_as_function(spark):
    import json

    rows = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(DOCUMENTS)] + [(90, "no json"), (91, None)], "k int, a string")
    got = {r.k: r.t for r in rows.select("k", N.ome_type_column(F.col("a")).alias("t")).collect()}
    assert got == {k: M.node_type(d) for k, d in enumerate(DOCUMENTS)} | {90: "unknown", 91: "unknown"}
    assert got[0] == "image" and got[1] == "unknown" and got[2] == "plate"


class Counted(Store):
    def __init__(self, data):
        self.uri, self.data, self.reads = "counted", data, 0

    def read(self, key):
        self.reads += 1
        return self.data.get(key)

    def write(self, key, data):
        self.data[key] = data


def test_chunk_cache():
    """Chunks are read once until they are pushed out, changed or too large; metadata and absent chunks each time."""
    inner = Counted({"c/0": b"a" * 40, "c/1": b"b" * 40, "c/2": b"c" * 40, "c/3": b"d" * 200, "zarr.json": b"{}"})
    store = CachedStore(inner, ChunkCache(100))
    assert [store.read("c/0") for _ in range(3)] == [b"a" * 40] * 3 and inner.reads == 1
    store.read("c/1"), store.read("c/0"), store.read("c/2")  # the third pushes out the longest unused: c/1
    assert inner.reads == 3 and store.read("c/0") and inner.reads == 3 and store.read("c/1") and inner.reads == 4
    for key, more in (("c/3", 2), ("zarr.json", 2), ("c/9", 2)):
        before = inner.reads
        store.read(key), store.read(key)
        assert inner.reads == before + more
    store.write("c/1", b"new")
    assert store.read("c/1") == b"new" and store.read_range("c/1", 1, 1) == b"e" and store.cache.bytes <= 100


def test_cached_reads_over_http(tmp_path):
    """Tiles that overlap fetch a chunk once."""
    from voxelith.plans.stores import served
    from voxelith.sources.metadata import open_array
    from voxelith.sources.zarr import ZarrReader

    v3_array(str(tmp_path), "", GRID, (4, 4))
    url = served(str(tmp_path))
    meta = open_array(cached_store(url))
    for _ in range(2):
        for start in ("0,0", "1,1", "2,3"):
            reader = ZarrReader(url, meta, ("y", "x"), {"start": start, "end": "4,4"})
            rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
            y, x = map(int, start.split(","))
            assert rows == (4 - y) * (4 - x)
            (tmp_path / "c" / "0" / "0").unlink(missing_ok=True)


def test_s3_store():
    """Reads, ranges, writes, existence, lists and deletes against an endpoint of our own."""
    s = S3Store("s3://bucket/some/prefix", endpoint=Stub().url, region="us-east-1", access_key="a", secret_key="b")
    assert s.read("a/b") is None and not s.exists("a/b") and s.list() == [] and s.read_range("a/b", 0, 1) is None
    s.write("a/b", b"hello world")
    s.write("c", b"x" * 100)
    assert s.read("a/b") == b"hello world" and s.read_range("a/b", 6, 3) == b"wor" and s.read_range("a/b", -3, 3) == b"rld"
    assert s.exists("a/b") and s.list() == ["a/b", "c"] and s.list("a") == ["a/b"]
    s.delete("a/b"), s.delete("a/b")
    assert s.read("a/b") is None and s.list() == ["c"]


def test_an_array_in_s3(spark, monkeypatch):
    """An image created, written and read in S3, its settings from the environment."""
    from voxelith.operators import writer as W

    for k, v in {"AWS_ENDPOINT_URL": Stub().url, "AWS_REGION": "us-east-1", "AWS_ACCESS_KEY_ID": "a", "AWS_SECRET_ACCESS_KEY": "b"}.items():
        monkeypatch.setenv(k, v)
    made = W.create_image(spark, "s3://bucket/image.zarr", W.ImageShape(8, 8, chunk_y=4, chunk_x=4))
    level = made.node.level()
    for y, x in ((0, 0), (0, 1), (1, 1)):
        made.node.store.write(level.array.key((0, 0, 0, y, x)), level.array.pipeline.encode(GRID[4 * y : 4 * y + 4, 4 * x : 4 * x + 4].tobytes()))
    want = GRID.copy()
    want[4:, :4] = 0
    assert level.read((0, 0, 0, 0, 0), (1, 1, 1, 8, 8)).reshape(8, 8).tolist() == want.tolist() and made.node.children() == ["0"]
