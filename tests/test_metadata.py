import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tests.stores import put, v2_array
from voxelith.functions import transforms as F
from voxelith.sources import metadata as M
from voxelith.sources import omexml
from voxelith.sources.errors import MetadataError, NodeNotFoundError, RegionError, UnsupportedError
from voxelith.sources.store import HttpStore, LocalStore, is_metadata_key, is_s3_uri, open_store, parse_s3_uri, s3_settings


def test_lenient_json():
    doc = M.loads(b'{"a": [1, 2,], // note\n /* more */ "b": "x // y", }')
    assert doc == {"a": [1, 2], "b": "x // y"} and M.get(doc, "B") == "x // y"
    with pytest.raises(MetadataError):
        M.loads("{\"a\" 1}")
    with pytest.raises(MetadataError):
        M.loads('{"a":1,}', strict=True)


def test_types():
    assert {c: M.parse_numpy_code(c)[0].name for c in ("|b1", "<u2", ">i4", "=f8", "|u1")} == {"|b1": "bool", "<u2": "uint16", ">i4": "int32", "=f8": "float64", "|u1": "uint8"}
    assert M.parse_numpy_code(">f4")[1] and not M.parse_numpy_code("<f4")[1]
    for bad in ("<f2", "<c8", "!u2"):
        with pytest.raises(UnsupportedError):
            M.parse_numpy_code(bad)
    for bad in ("u", "<ux"):
        with pytest.raises(ValueError):
            M.parse_numpy_code(bad)
    assert M.TYPES["uint64"].spark == "decimal(20,0)" and M.TYPES["float32"].is_float and not M.TYPES["uint8"].is_signed


def test_array_documents():
    doc = {"node_type": "array", "shape": [4], "data_type": "uint8", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [2]}}, "codecs": ["bytes"]}
    assert M.array_v3(doc, "a").key((1,)) == "a/c/1"
    dotted = doc | {"chunk_key_encoding": {"name": "default", "configuration": {"separator": "."}}}
    assert M.array_v3(dotted).key((1,)) == "c.1" and M.array_v3(dotted).other_key((1,)) == "c/1"
    assert M.array_v3(doc | {"chunk_key_encoding": {"name": "v2"}}).key((1,)) == "1"
    assert math.isnan(M.array_v3(doc | {"data_type": "float32", "fill_value": "NaN"}).fill)
    for change in ({"node_type": "group"}, {"shape": None}, {"data_type": None}, {"chunk_grid": {"name": "regular", "configuration": {"chunk_shape": []}}}):
        with pytest.raises(MetadataError):
            M.array_v3(doc | change)
    for change in ({"data_type": "float16"}, {"chunk_grid": {"name": "rectangular"}}):
        with pytest.raises(UnsupportedError):
            M.array_v3(doc | change)
    with pytest.raises(MetadataError):
        M.array_v2({"zarr_format": 3}, {})
    with pytest.raises(UnsupportedError):
        M.array_v2({"zarr_format": 2, "shape": [1], "chunks": [1], "dtype": "|u1", "filters": [{"id": "delta"}]}, {})


@pytest.mark.parametrize(
    "keys, kind",
    [(["plate", "bioformats2raw.layout"], "plate"), (["bioformats2raw.layout", "well"], "bioformats2raw"), (["well", "labels"], "well"), (["labels", "multiscales"], "labels"), (["multiscales", "image-label"], "label"), (["multiscales"], "image"), ([], "unknown")],
)
def test_node_types(spark, keys, kind):
    import json

    from pyspark.sql import functions as S

    from voxelith.operators.nodes import ome_type_column

    own = {k: {} for k in keys}
    assert M.node_type(own) == kind and M.node_type({"ome": own} if own else {}) == kind
    rows = spark.createDataFrame([(json.dumps(own),), (json.dumps({"ome": own}),)], "a string")
    assert [r[0] for r in rows.select(ome_type_column(S.col("a"))).collect()] == [kind, kind]


def test_ome_documents():
    attrs = {"ome": {"version": "0.5", "multiscales": [{"version": "0.4", "axes": ["Y", {"name": "x", "type": "space", "unit": "micrometer"}], "datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": ["0.5", 2]}]}], "coordinateTransformations": [{"type": "identity"}]}], "omero": {"channels": [{"label": "DAPI"}], "rdefs": {"defaultZ": "3"}}}}
    m = M.multiscales(attrs)[0]
    assert M.ngff_version(attrs) == "0.5" and M.ngff_version({"multiscales": [{"version": "0.2"}]}) == "0.2"
    assert m.datasets[0].transforms[0].values == (0.5, 2.0) and m.channels[0].label == "DAPI" and m.default_z == 3
    assert [a.name for a in M.effective_axes(m, 2)] == ["y", "x"] and [a.name for a in M.effective_axes(None, 3)] == ["z", "y", "x"]
    with pytest.raises(MetadataError):
        M.effective_axes(None, 6)
    p = M.plate({"plate": {"rows": [{"name": "A"}], "columns": [{"name": "1"}], "field_count": 2, "wells": [{"path": "A/1", "rowIndex": "0", "columnIndex": 0}], "acquisitions": [{"id": 1, "starttime": 5}]}})
    assert p.wells[0].row_index == 0 and p.wells[0].column_index == 0 and p.field_count == 2 and p.acquisitions[0].start_time == 5
    assert M.well({"well": {"images": [{"path": "0"}, {"path": "1", "acquisition": 4}]}}) == ((0, "0"), (4, "1"))
    label = M.image_label({"image-label": {"colors": [{"label-value": 1, "rgba": [1, 2, 3, 4]}], "properties": [{"label-value": 1, "class": "cell"}], "source": {"image": "../../"}}})
    assert label.colors == ((1, (1, 2, 3, 4)),) and label.properties[0]["class"] == "cell" and label.source == "../../"
    assert M.bioformats2raw({"bioformats2raw.layout": 3}, {"ome": {"series": ["0", "1"]}}).series == ("0", "1")


XML = """<OME xmlns="http://www.openmicroscopy.org/Schemas/OME/{v}">
<Instrument ID="I:0"><Objective ID="O:0" Model="old" /></Instrument>
<Instrument ID="I:0"><Objective ID="O:0" Model="Plan" NominalMagnification="63" LensNA="x" /></Instrument><Instrument/>
<Image ID="Image:0" Name="a"><AcquisitionDate>2020-01-01</AcquisitionDate><InstrumentRef ID="I:0"/><ObjectiveSettings ID="O:0"/>
<Pixels SizeX="5" SizeY="bad" PhysicalSizeX="0.5" PhysicalSizeXUnit="nm"><Channel ID="C:0" Name="red" Color="-1"/></Pixels></Image></OME>"""


@pytest.mark.parametrize("version", ["2013-06", "2016-06"])
def test_ome_xml(version):
    x = omexml.parse(XML.format(v=version))
    p = x.images[0].pixels
    assert (p.size_x, p.size_y, p.physical_size_x, p.physical_size_x_unit, p.physical_size_y_unit, p.time_increment_unit) == (5, None, 0.5, "nm", "µm", "s")
    lens = x.objective_of(x.images[0])
    assert (lens.model, lens.nominal_magnification, lens.lens_na) == ("Plan", 63.0, None) and p.channels[0].color == -1
    assert omexml.try_parse("<OME") is None and omexml.try_parse(None) is None
    with pytest.raises(ValueError):
        omexml.parse("nothing")


@pytest.mark.parametrize(
    "k, t, n, origin, size, want",
    [(0.5, 0, 500, 10.3, 7.0, (20, 35)), (0.25, 0, 64, 1.0, 2.0, (4, 12)), (0.5, 0, 500, 1e6, 1, (499, 500)), (0.5, 0, 500, -10, 1, (0, 1)), (0.1, 0, 64, 0, 0.1 * 3, (0, 4)), (0.1, 0, 64, 0, 0.3, (0, 3)), (1.0, 0, 10, 3.2, 0.1, (3, 4)), (0.5, 5, 100, 6, 1, (2, 4))],
)
def test_golden_ranges(spark, k, t, n, origin, size, want):
    from pyspark.sql import functions as S

    assert F.pixel_range(origin, size, k, t, n) == want
    columns = F.pixel_range_columns(*[S.lit(float(v)) for v in (origin, size, k, t)], S.lit(n))
    assert tuple(spark.range(1).select(*columns).first()) == want


@given(st.floats(0.01, 100), st.floats(-50, 50), st.integers(1, 1000), st.floats(-1e5, 1e5), st.floats(0.01, 1e4))
def test_ranges_are_never_empty(k, t, n, origin, size):
    s, e = F.pixel_range(origin, size, k, t, n)
    assert 0 <= s < e <= n


def test_transforms():
    steps = (M.Transform("translation", (1.0, 2.0)), M.Transform("scale", (2.0, 3.0)), M.Transform("identity", None), M.Transform("translation", (0.5, 0.0)))
    assert F.flatten(steps, 2) == ((2.0, 3.0), (2.5, 6.0))
    with pytest.raises(UnsupportedError):
        F.flatten([M.Transform("affine", None)], 2)
    with pytest.raises(MetadataError):
        F.flatten([M.Transform("scale", (1.0,))], 2)
    for bad in (lambda: F.PhysicalROI((0.0,), (0.0,)), lambda: F.PixelRegion((1,), (1,)), lambda: F.PixelRegion((), ())):
        with pytest.raises(RegionError):
            bad()
    roi = F.pixel_to_physical(F.PixelRegion((2, 0), (4, 5)), (0.5, -1.0), (1.0, 0.0))
    assert roi.origin == (2.0, 0.0) and roi.size == (1.0, 5.0) and str(F.PixelRegion((0,), (3,))) == "[0:3]"
    axes = M.effective_axes(None, 5)
    assert F.axis_pixel_sizes(axes, (9.0, 9.0, 3.0, 2.0, 1.0)) == {"t": 1.0, "c": 1.0, "z": 3.0, "y": 2.0, "x": 1.0}


def test_stores(tmp_path):
    with pytest.raises(NotADirectoryError):
        LocalStore(str(tmp_path / "none"))
    s = open_store(f"file://{tmp_path}")
    s.write("a/b", b"1")
    put(str(tmp_path), "a/.zattrs", {})
    assert s.read("a/b") == b"1" and s.read("a") is None and s.read("x") is None and s.exists("a") and not s.exists("q")
    assert s.list() == ["a/.zattrs", "a/b"] and s.list("none") == [] and s.read_range("a/b", -1, 1) == b"1"
    s.delete("a/b")
    s.delete("a/b")
    (tmp_path.parent / f"{tmp_path.name}2").mkdir()
    for key in ("../x", f"../{tmp_path.name}2/x"):
        with pytest.raises(PermissionError):
            s.read(key)
    assert is_metadata_key("a/ZARR.JSON") and not is_metadata_key("c/0") and is_s3_uri("S3://x/y")
    assert parse_s3_uri("s3://bucket/a/b/") == ("bucket", "a/b")
    assert s3_settings("IDR", {})["endpoint_override"].startswith("https://uk1s3") and s3_settings("b", {"AWS_ACCESS_KEY_ID": "k", "AWS_SECRET_ACCESS_KEY": "s", "AWS_SESSION_TOKEN": "t", "AWS_REGION": "r"})["session_token"] == "t"
    with pytest.raises(UnsupportedError):
        open_store("ftp://x/y")


def test_groups(tmp_path):
    root = str(tmp_path)
    s = LocalStore(root)
    with pytest.raises(NodeNotFoundError):
        M.open_group(s)
    put(root, ".zgroup", {"zarr_format": 2})
    put(root, ".zattrs", {"k": 1})
    v2_array(root, "img", np.arange(16, dtype="<u2").reshape(4, 4), (2, 2), separator="/", declared=False)
    put(root, "only/.zattrs", {})
    assert M.open_group(s).attributes == {"k": 1} and M.child_names(s) == ["img"] and not M.has_child(s, "", "only")
    assert M.open_array(s, "img").separator == "/"
    put(root, "zarr.json", {"zarr_format": 3, "node_type": "array"})
    with pytest.raises(MetadataError):
        M.open_group(s)


def test_http(tmp_path):
    import functools
    import http.server
    import threading

    put(str(tmp_path), "a b/c", b"0123456789")
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path))
    handler.log_message = None
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        s = HttpStore(f"http://127.0.0.1:{server.server_port}/", pause=0.01)
        assert s.read("a b/c") == b"0123456789" and s.read("a b/none") is None and s.exists("a b/c") and not s.exists("none")
        assert s.read_range("a b/c", -3, 3) == b"789" and s.read_range("a b/c", 2, 4) == b"2345"
        with pytest.raises(UnsupportedError):
            s.write("x", b"")
        server.shutdown()
    with pytest.raises(OSError):
        HttpStore("http://127.0.0.1:1", pause=0.001).read("x")
    assert HttpStore("http://h/x/").url_of("a b/ü") == "http://h/x/a%20b/%C3%BC"
