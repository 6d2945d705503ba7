import dataclasses
import itertools

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.stores import put, sharded, v2_array, v3_array
from voxelith.functions.transforms import PhysicalROI, PixelRegion
from voxelith.operators import analytics as A
from voxelith.operators import nodes as N
from voxelith.operators import writer as W
from voxelith.operators.views import ArrayView
from voxelith.sources.errors import CodecError, MetadataError, NodeNotFoundError, RegionError, UnsupportedError
from voxelith.sources.metadata import TYPES, open_array
from voxelith.sources.store import LocalStore
from voxelith.sources.zarr import ZarrReader, chunk_coordinates, read_cells, read_chunks, read_region, write_cells


def dense(df, shape, dtype="int64"):
    rows = df.toPandas()
    out = np.full(shape, -1 if np.dtype(dtype).kind != "u" else 0, dtype)
    axes = [c for c in df.columns if c != "value"]
    assert not rows.duplicated(axes).any() and len(rows) == out.size
    out[tuple(rows[a] for a in axes)] = rows["value"].astype(dtype)
    return out


GRID = np.arange(35, dtype="<u2").reshape(5, 7) * 1000


@pytest.mark.parametrize(
    "given_",
    [{}, {"big": True}, {"codecs": [{"name": "bytes"}, {"name": "gzip"}]}, {"codecs": [{"name": "bytes"}, {"name": "zstd"}, {"name": "crc32c"}]}, {"separator": "."}, {"encoding": "v2", "separator": "."}, {"truncated": True}],
)
def test_v3(spark, tmp_path, given_):
    v3_array(str(tmp_path), "", GRID, (2, 3), **given_)
    assert (dense(read_cells(spark, str(tmp_path)), (5, 7)) == GRID).all()


@pytest.mark.parametrize("given_", [{}, {"separator": "/", "declared": False, "compressor": {"id": "gzip"}, "code": ">i4"}, {"order": "F"}])
def test_v2(spark, tmp_path, given_):
    values = np.arange(16, dtype="<u2").reshape(4, 4)
    v2_array(str(tmp_path), "img", values, (2, 2), **given_)
    df = read_cells(spark, str(tmp_path), "img")
    assert df.columns == ["y", "x", "value"] and (dense(df, (4, 4)) == values).all()


@pytest.mark.parametrize("kind", list(TYPES.values()), ids=lambda t: t.name)
def test_types(spark, tmp_path, kind):
    top = {"b": [0, 1, 1], "f": [-1.5, 0.0, 2.5]}.get(kind.code[0]) or [0, 1, np.iinfo(kind.code).max]
    values = np.array(top, kind.numpy)
    v3_array(str(tmp_path), "", values, (2,), dtype=kind.name)
    df = read_cells(spark, str(tmp_path))
    assert dict(df.dtypes)["value"] == kind.spark
    assert [r["value"] for r in df.orderBy("x").collect()] == values.tolist()


def test_missing_chunks_and_bad_ones(spark, tmp_path):
    values = np.arange(36, dtype="u1").reshape(6, 6)
    v3_array(str(tmp_path), "a", values, (3, 3), fill=7, skip=[(0, 1)])
    got = dense(read_cells(spark, str(tmp_path), "a"), (6, 6))
    assert (got[:3, 3:] == 7).all() and (got[3:] == values[3:]).all()
    assert (dense(read_cells(spark, str(tmp_path), "a", fillMode="zero"), (6, 6))[:3, 3:] == 0).all()
    chunks = {tuple(r["chunk_coord"]): r for r in read_chunks(spark, str(tmp_path), "a").collect()}
    assert len(chunks) == 4 and not chunks[0, 1]["present"] and len(chunks[1, 1]["payload"]) == 9 and chunks[1, 0]["store_key"] == "a/c/1/0"
    put(str(tmp_path), "a/c/0/0", bytes(10))
    with pytest.raises(CodecError):
        read_region(LocalStore(str(tmp_path)), open_array(LocalStore(str(tmp_path)), "a"), (0, 0), (1, 1))
    put(str(tmp_path), "a/c/0/0", bytes([1, 2]))
    assert read_region(LocalStore(str(tmp_path)), open_array(LocalStore(str(tmp_path)), "a"), (0, 0), (2, 2)).tolist() == [[1, 2], [7, 7]]


@pytest.mark.parametrize("at_end, crc", [(True, True), (False, False)])
def test_shards(spark, tmp_path, at_end, crc):
    values = np.arange(64, dtype="<u2").reshape(8, 8)
    sharded(str(tmp_path), "", values, (4, 4), (2, 2), at_end, crc, empty=[(0, 1, 0, 1)])
    want = values.copy()
    want[0:2, 6:8] = 0
    assert (dense(read_cells(spark, str(tmp_path)), (8, 8)) == want).all()
    assert [r["value"] for r in read_cells(spark, str(tmp_path), start=(3, 3), end=(5, 5)).orderBy("y", "x").collect()] == want[3:5, 3:5].ravel().tolist()
    with pytest.raises(UnsupportedError):
        write_cells(read_cells(spark, str(tmp_path)), str(tmp_path))


def test_pruning_by_filter(spark, tmp_path):
    v3_array(str(tmp_path), "", GRID, (2, 3))
    for bad in ("0/1", "1/1", "2/2"):
        (tmp_path / "c" / bad).write_bytes(bytes(99))  # too long: an error if it is read
    df = read_cells(spark, str(tmp_path))
    assert df.where("y = 4 AND x < 3").count() == 3
    assert df.where("y >= 2 AND y <= 3 AND x > 5").select("value").count() == 2
    assert df.where("x IN (0, 2)").count() == 10
    with pytest.raises(Exception, match="99 bytes"):
        df.where("x = 4").count()
    assert read_cells(spark, str(tmp_path), start=(0, 6), end=(2, 7)).count() == 2
    meta = open_array(LocalStore(str(tmp_path)))
    reader = ZarrReader(str(tmp_path), meta, ("y", "x"), {"start": "0,0", "end": "2,4", "partitionBytes": "1"})
    assert len(reader.partitions()) == 2


@pytest.mark.parametrize("start, end", [((5, 0), (6, 1)), ((0, 0), (0, 1)), ((0,), (1,)), ((-1, 0), (1, 1)), ((0, 0), (6, 1)), ((3, 3), (2, 4))])
def test_bad_regions(spark, tmp_path, start, end):
    v3_array(str(tmp_path), "", GRID, (2, 3))
    with pytest.raises(RegionError):
        read_cells(spark, str(tmp_path), start=start, end=end)


@given(st.data())
@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_regions_like_numpy(tmp_path_factory, data):
    root = str(tmp_path_factory.mktemp("a"))
    shape = data.draw(st.lists(st.integers(1, 6), min_size=1, max_size=4))
    chunk = [data.draw(st.integers(1, 7)) for _ in shape]
    values = np.arange(int(np.prod(shape)), dtype="<i4").reshape(shape)
    v3_array(root, "", values, chunk)
    start = [data.draw(st.integers(0, n - 1)) for n in shape]
    end = [data.draw(st.integers(s + 1, n)) for s, n in zip(start, shape)]
    meta = open_array(LocalStore(root))
    assert (read_region(LocalStore(root), meta, start, end) == values[tuple(map(slice, start, end))]).all()
    want = {tuple(i // c for i, c in zip(p, chunk)) for p in itertools.product(*map(range, start, end))}
    assert list(chunk_coordinates(start, end, chunk)) == sorted(want)


def image(tmp_path, version=3, **more):
    root, values = str(tmp_path), []
    rng = np.random.default_rng(1)
    axes = [{"name": n, "type": k} for n, k in zip("tczyx", ["time", "channel", "space", "space", "space"])]
    sets = []
    for k in range(3):
        a = rng.integers(0, 60000, (2, 2, 3, 8 >> k, 8 >> k)).astype("<u2")
        values.append(a)
        (v3_array if version == 3 else v2_array)(root, str(k), a, (1, 1, 3, 3, 3))
        sets.append({"path": str(k), "coordinateTransformations": [{"type": "scale", "scale": [1, 1, 2, 0.5 * 2**k, 0.5 * 2**k]}, {"type": "translation", "translation": [0, 0, 0, 1, 0]}]})
    attributes = {"multiscales": [{"version": "0.4", "axes": axes, "datasets": sets, "coordinateTransformations": [{"type": "scale", "scale": [1, 1, 1, 1, 1]}], "omero": {"channels": [{"label": "a", "color": "FF0000", "active": True}, {"label": "b"}]}}], **more}
    if version == 3:
        put(root, "zarr.json", {"zarr_format": 3, "node_type": "group", "attributes": {"ome": attributes}})
    else:
        put(root, ".zgroup", {"zarr_format": 2})
        put(root, ".zattrs", attributes)
    return root, values


@pytest.mark.parametrize("version", [2, 3])
def test_image(spark, tmp_path, version):
    root, values = image(tmp_path, version)
    node = N.as_image(N.open_zarr(spark, root))
    assert node.type == "image" and len(node.levels()) == 3 and [r.label for r in node.channels().collect()] == ["a", "b"]
    level = node.level(0)
    view = level.view()
    assert level.path == "0" and level.pixel_size == (1, 1, 2, 0.5, 0.5) and view.names == tuple("tczyx") and view.translation[3] == 1
    plane = view.plane(1, 0, 2)
    assert plane.extent == (1, 1, 1, 8, 8) and (plane.width, plane.height, plane.element_count) == (8, 8, 64)
    assert (plane.squeeze().to_dense() == values[0][1, 0, 2]).all()
    rows = plane.squeeze().as_2d().orderBy("y").collect()
    assert [r["values"] for r in rows] == values[0][1, 0, 2].tolist()
    assert view.plane(0, 0, 0).as_1d().first()["values"] == values[0][0, 0, 0].ravel().tolist()
    assert plane.to_bytes() == values[0][1, 0, 2].tobytes()
    with pytest.raises(RegionError):
        plane.as_2d()
    with pytest.raises(RegionError):
        view.plane(2, 0, 0)
    assert view.plane(None, None, None).cells.count() == values[0].size
    tile = view.tile(y=6, x=-3, height=5, width=5, t=9, z=-4)
    assert (tile.start, tile.end) == ((1, 0, 0, 6, 0), (2, 1, 1, 8, 2))
    strict = view.tile(y=6, x=-3, height=5, width=5, mode="strict")
    assert strict.extent == (1, 1, 1, 2, 2)
    for bad in ({"y": 8, "x": 0, "height": 2, "width": 2}, {"y": 0, "x": 0, "height": 0, "width": 2}, {"y": 0, "x": 0, "height": 2, "width": 2, "t": 5}):
        with pytest.raises(RegionError):
            view.tile(mode="strict", **bad)
    roi = view.physical_roi(PhysicalROI((0, 0, 0, 2, 0), (1, 1, 2, 1, 1)))
    assert (roi.start, roi.end) == ((0, 0, 0, 2, 0), (1, 1, 1, 4, 2))
    assert view.plane_physical(z=3.0, y=1.0).extent == (1, 1, 2, 8, 8)  # off the grid, z spans two slices
    assert view.physical_extent().size == (2, 2, 6, 4, 4) and view.pixel_sizes()["z"] == 2
    assert node.all_cells().groupBy("level").count().orderBy("level").collect()[2]["count"] == values[2].size
    crop = A.crop_elsewhere(node.level(2).view().plane().squeeze(), view, 2)
    assert crop.load and all(1 <= n <= 2 for n in crop.extent[3:])
    best = A.argmax(view).first()
    assert values[0][tuple(best[n] for n in "tczyx")] == values[0].max() == best["value"]
    assert A.best_level([0.5, 1.0, 2.0], 0.75) == 0
    stats = A.stats(view, by=["z"]).orderBy("z").collect()
    assert stats[1]["mean_v"] == pytest.approx(values[0][:, :, 1].mean())
    gray = view.plane().to_pixels("gray8").agg({"pixel": "max"}).first()[0]
    assert gray == int(values[0][0, 0, 0].max()) >> 8
    with pytest.raises(IndexError):
        node.level(3)
    for convert in (N.as_plate, N.as_well, N.as_collection):
        with pytest.raises(MetadataError):
            convert(node)


def test_float_pixels(spark):
    rows = [(0, float("nan")), (1, -1.0), (2, 0.5), (3, 2.0), (4, 1.0)]
    view = ArrayView(spark.createDataFrame(rows, "x bigint, value float"), (), (5,), "float32", (5,), (1.0,), (0.0,))
    view = dataclasses.replace(view, axes=(__import__("voxelith.sources.metadata", fromlist=["Axis"]).Axis("x"),))
    assert [r.pixel for r in view.to_pixels("gray8").orderBy("x").collect()] == [0, 0, 127, 255, 255]
    assert [r.pixel for r in view.to_pixels("gray16").orderBy("x").collect()] == [0, 0, 32767, 65535, 65535]
    assert view.to_pixels("bgra32").orderBy("x").collect()[4].pixel == [255, 255, 255, 255]
    with pytest.raises(UnsupportedError):
        view.to_pixels("cmyk")


def test_labels(spark, tmp_path):
    root, _ = image(tmp_path)
    node = N.open_zarr(spark, root)
    assert not node.has_labels()
    put(root, "labels/zarr.json", {"node_type": "group", "attributes": {"ome": {"labels": ["cells"]}}})
    mask = np.array([[0, 1], [4_000_000_000, 1]], "<u4")
    scale = {"axes": ["y", "x"], "datasets": [{"path": "0"}]}
    put(root, "labels/cells/zarr.json", {"node_type": "group", "attributes": {"ome": {"multiscales": [scale], "image-label": {"colors": [{"label-value": 1, "rgba": [1, 2, 3, 4]}]}}}})
    v3_array(root, "labels/cells/0", mask, (2, 2))
    assert node.has_labels() and node.labels().names == ("cells",)
    cells = node.labels().open("cells")
    view = cells.level().view()
    assert A.distinct_labels(view).first()[0] == 2 and cells.colors().first().rgba == [1, 2, 3, 4]
    assert N.as_image(N.open_zarr(spark, root, "labels/cells")).type == "label"
    img = dataclasses.replace(view, cells=view.cells.selectExpr("y", "x", "y * 10 + x AS value"))
    assert {r.label: r.mean_v for r in A.masked_mean(img, view).collect()} == {1: 6.0, 4_000_000_000: 10.0}
    with pytest.raises(NodeNotFoundError):
        node.labels().open("none")


def test_plate(spark, tmp_path):
    root = str(tmp_path)
    wells = [("A", "1"), ("A", "2"), ("B", "1"), ("B", "2")]
    put(root, ".zgroup", {"zarr_format": 2})
    put(root, ".zattrs", {"plate": {"rows": [{"name": "A"}, {"name": "B"}], "columns": [{"name": "1"}, {"name": "2"}], "wells": [{"path": "/".join(w), "rowIndex": str(k // 2), "columnIndex": k % 2} for k, w in enumerate(wells)]}})
    for k, (r, c) in enumerate(wells):
        put(root, f"{r}/.zgroup", {"zarr_format": 2})
        put(root, f"{r}/{c}/.zgroup", {"zarr_format": 2})
        put(root, f"{r}/{c}/.zattrs", {"well": {"images": [{"path": "0"}, {"path": "1", "acquisition": 2}][: 1 + k % 2]}})
        for f in range(1 + k % 2):
            put(root, f"{r}/{c}/{f}/.zgroup", {"zarr_format": 2})
            put(root, f"{r}/{c}/{f}/.zattrs", {"multiscales": [{"datasets": [{"path": "0"}]}]})
            v2_array(root, f"{r}/{c}/{f}/0", np.full((1, 2, 4, 4), k * 10 + f, "<u2"), (1, 1, 4, 4))
    plate = N.as_plate(N.open_zarr(spark, root))
    assert plate.wells_table().count() == 4 and plate.fields_table().count() == 6
    assert plate.well("B", "2").field(1).level().view().plane_3d(0).cells.first().value == 31
    assert plate.well("A/1").field("0").level().axes[0].name == "c"
    got = {(r.well, r.field): r.v for r in plate.cells().groupBy("well", "field").agg({"value": "max"}).withColumnRenamed("max(value)", "v").collect()}
    assert got["B/2", 1] == 31 and len(got) == 6
    tree = N.nodes(spark, root)
    assert tree.where("ome_type = 'well'").count() == 4 and tree.where("node_type = 'array'").count() == 6
    assert [r.name for r in N.child_rows(tree).collect()] == ["A", "B"]


XML = '<OME><Image Name="one"><Pixels SizeX="2" PhysicalSizeX="0.5"/></Image><Image Name="two"/></OME>'


@pytest.mark.parametrize("way", ["listed", "xml", "probed"])
def test_series(spark, tmp_path, way):
    root = str(tmp_path)
    put(root, "zarr.json", {"node_type": "group", "attributes": {"bioformats2raw.layout": 3}})
    if way != "probed":
        put(root, "OME/METADATA.ome.xml", XML.encode())
        put(root, "OME/zarr.json", {"node_type": "group", "attributes": {"ome": {"series": ["0", "1"]}} if way == "listed" else {}})
    for k in ("0", "1", "3"):
        put(root, f"{k}/zarr.json", {"node_type": "group", "attributes": {"ome": {"multiscales": [{"datasets": [{"path": "0"}]}]}}})
        v3_array(root, f"{k}/0", np.array([[1, 2], [3, int(k)]], "u1"), (2, 2))
    node = N.as_collection(N.open_zarr(spark, root))
    assert node.series_paths() == ["0", "1"] and N.as_image(node).path == "0"
    assert node.series(1).level().read((1, 1), (2, 2)).item() == 1
    image = node.series_xml(0)
    assert (image.name if image else None) == (None if way == "probed" else "one") and node.series_xml(9) is None
    assert node.series_table().count() == 2


def test_writer(spark, tmp_path):
    shape = W.ImageShape(size_x=7, size_y=5, size_z=2, size_c=2, chunk_y=4, chunk_x=3, pixel_x=0.5, levels=(W.LevelShape(3, 4, 2.0),))
    w = W.create_image(spark, str(tmp_path / "new"), shape)
    values = np.arange(140, dtype="<u2").reshape(1, 2, 2, 5, 7) * 400
    w.write_pixels(values.tobytes())
    level = w.node.level(0)
    assert level.pixel_size == (1.0, 1.0, 1.0, 1.0, 0.5) and w.node.level(1).pixel_size[4] == 1.0 and w.node.level(1).shape == (1, 2, 2, 3, 4)
    assert (level.read((0,) * 5, level.shape) == values).all()
    w.write_plane(1, bytes(2 * 2 * 35))
    w.write_region(0, 1, 0, 1, 2, 3, 4, np.full(12, 9, "<u2").tobytes())
    values[:, :, 1] = 0
    values[0, 1, 0, 1:4, 2:6] = 9
    assert (level.read((0,) * 5, level.shape) == values).all()
    assert (level.view().to_dense() == values).all()
    w.write_cells(spark.createDataFrame([(0, 0, 0, 4, 6, 77)], "t bigint, c bigint, z bigint, y bigint, x bigint, value int"))
    assert level.read((0, 0, 0, 4, 6), (1, 1, 1, 5, 7)).item() == 77
    with pytest.raises(ValueError):
        w.write_pixels(b"1")
    with pytest.raises(RegionError):
        w.write_region(0, 0, 0, 4, 0, 2, 2, bytes(8))
    twice = spark.createDataFrame([(0, 0, 0, 0, 0, 1), (0, 0, 0, 0, 0, 2)], "t bigint, c bigint, z bigint, y bigint, x bigint, value int")
    with pytest.raises(Exception, match="two rows for one cell"):
        w.write_cells(twice)
    big = spark.createDataFrame([(0, 0, 0, 0, 0, 70000)], "t bigint, c bigint, z bigint, y bigint, x bigint, value int")
    with pytest.raises(Exception, match="doesn't fit"):
        w.write_cells(big)
    with pytest.raises(UnsupportedError):
        W.create_image(spark, "http://h/x", shape)
    with pytest.raises(MetadataError):
        W.create_image(spark, str(tmp_path / "none"), shape, levels=[])
    assert W.ImageShape.from_zct(4, 4, W.ZCT(1, 2, 3)).size_t == 3


def test_tables_as_stores(spark, tmp_path):
    """The embeddings written to a store and read back give the rows that the table gives."""
    from voxelith.plans.tables import embeddings

    view = embeddings(spark, "/root/testdata/sf0.001")
    v3_array(str(tmp_path), "", np.zeros(view.shape, "<f4"), view.chunks)
    write_cells(view.cells, str(tmp_path), overwrite=True)
    back = dataclasses.replace(view, cells=read_cells(spark, str(tmp_path)), load=lambda s, e: read_cells(spark, str(tmp_path), start=s, end=e))
    same = lambda a, b: a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert same(back.cells, view.cells)
    assert same(back.region((100, 4), (110, 12)).cells, view.region((100, 4), (110, 12)).cells)
    assert same(back.tile(y=495, x=60, height=9, width=9).cells, view.tile(y=495, x=60, height=9, width=9).cells)
    assert same(A.argmax(back), A.argmax(view)) and same(back.chunk_cells(), view.chunk_cells()) and back.chunk_count() == 40


def test_group_paths(spark, tmp_path):
    root, _ = image(tmp_path)
    with pytest.raises(MetadataError, match="name one of its arrays"):
        read_cells(spark, root)
    with pytest.raises(NodeNotFoundError):
        N.open_zarr(spark, root, "none")
    with pytest.raises(MetadataError):
        read_cells(spark, f"{root}/0", axes=["y"])
    assert read_cells(spark, f"{root}/0").columns == [*"tczyx", "value"]
    assert PixelRegion((0,), (1,)) == PixelRegion((0,), (1,))
