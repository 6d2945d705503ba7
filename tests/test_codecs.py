import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.stores import blosc_frame, slow_crc32c
from voxelith.sources import codecs as C
from voxelith.sources.errors import CodecError, MetadataError, UnsupportedError


@given(st.binary(max_size=3000), st.sampled_from([1, 2, 4, 8]), st.sampled_from(["lz4", "zstd", "zlib"]), st.booleans(), st.sampled_from([0, 64, 1000]))
@settings(max_examples=80, deadline=None)
def test_blosc_round_trip(data, item, name, shuffled, block):
    assert C.blosc_decode(C.blosc_encode(data, item, name, 5, shuffled, block)) == data


@given(st.binary(max_size=40_000))
@settings(max_examples=30, deadline=None)
def test_crc32c(data):
    assert C.crc32c(data) == slow_crc32c(data)
    assert C.Crc32c().decode(C.Crc32c().encode(data), len(data)) == data


def test_crc32c_known_and_mismatch():
    assert C.crc32c(b"123456789") == 0xE3069283
    bad = bytearray(C.Crc32c().encode(b"hello"))
    bad[0] ^= 1
    for data in (bytes(bad), b"abc"):
        with pytest.raises(CodecError):
            C.Crc32c().decode(data, 5)


@pytest.mark.parametrize("codec", [C.Gzip(0), C.Gzip(9), C.Zstd(3), C.Zstd(99), C.Bytes(4, True), C.Bytes(2)])
def test_round_trips(codec):
    data = np.arange(1000, dtype="<u4").tobytes()
    assert codec.decode(codec.encode(data), len(data)) == data


def test_bytes_swap_and_bad_length():
    assert C.Bytes(2, True).decode(b"\x01\x02\x03\x04", 4) == b"\x02\x01\x04\x03"
    with pytest.raises(CodecError):
        C.Bytes(4, True).decode(b"12345", 5)
    for codec in (C.Gzip(), C.Zstd()):
        with pytest.raises(CodecError):
            codec.decode(b"no frame at all", 5)


def test_blosc_branches():
    raw = np.arange(4000, dtype="<u2").tobytes()
    lz4 = pa.Codec("lz4_raw")
    by_lz4 = lambda b: ((p := lz4.compress(b, asbytes=True)), len(p))
    by_zstd = lambda b: ((p := zstandard.ZstdCompressor().compress(b)), len(p))
    by_zlib = lambda b: ((p := zlib.compress(b)), len(p))
    by_deflate = lambda b: ((p := zlib.compress(b)[2:-4]), len(p))
    stored = lambda b: (b, len(b))
    assert C.blosc_decode(blosc_frame(raw, 2, 1, 0x10 | 1 << 5, by_lz4)) == raw
    assert C.blosc_decode(blosc_frame(raw, 2, 2, 1 << 5, by_lz4)) == raw
    assert C.blosc_decode(blosc_frame(raw, 2, 2, 1 << 5, by_lz4, block=1600)) == raw
    assert C.blosc_decode(blosc_frame(raw, 2, 1, 0x10 | 4 << 5, by_zstd)) == raw
    assert C.blosc_decode(blosc_frame(raw, 2, 1, 0x10 | 3 << 5, by_zlib)) == raw
    assert C.blosc_decode(blosc_frame(raw, 2, 1, 0x10 | 3 << 5, by_deflate)) == raw
    assert C.blosc_decode(blosc_frame(raw, 2, 2, 1 << 5, stored)) == raw
    assert C.blosc_decode(blosc_frame(bytes(800), 2, 1, 0x10 | 1 << 5, lambda b: (b"", 0))) == bytes(800)
    assert C.blosc_decode(struct.pack("<BBBBIII", 2, 1, 2, 2, 4, 4, 20) + b"abcd") == b"abcd"
    assert C.blosc_encode(b"", 2) and C.blosc_decode(C.blosc_encode(b"", 2)) == b""


def test_blosc_refused_and_broken():
    raw = np.arange(400, dtype="<u2").tobytes()
    for flags in (4 | 1 << 5, 0 << 5, 2 << 5):
        with pytest.raises(UnsupportedError):
            C.blosc_decode(blosc_frame(raw, 2, 1, flags, lambda b: (b[:-1], len(b) - 1), shuffled=False))
    with pytest.raises(CodecError):
        C.blosc_decode(blosc_frame(raw, 2, 1, 0x10 | 1 << 5, lambda b: (b"\xff" * 20, 20)))
    with pytest.raises(CodecError):
        C.blosc_decode(b"short")


def test_pipelines():
    pipe, none = C.pipeline_v3(["bytes", {"name": "gzip", "configuration": {"level": 1}}, {"name": "crc32c"}], 2)
    assert none is None and pipe.decode(pipe.encode(b"abcd"), 4) == b"abcd"
    with pytest.raises(UnsupportedError):
        C.pipeline_v3([{"name": "transpose"}], 2)
    for name in ("zlib", "lz4", "bz2"):
        with pytest.raises(UnsupportedError):
            C.pipeline_v2({"id": name}, 2, False)
    with pytest.raises(MetadataError):
        C.pipeline_v3([{"name": "sharding_indexed", "configuration": {}}], 2)
    _, s = C.pipeline_v3([{"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 2], "index_codecs": ["bytes", "crc32c"]}}, {"name": "gzip"}], 2)
    assert s.per_shard((4, 5)) == (2, 3) and s.index_bytes((4, 5)) == 100 and s.at_end
    shard = s.encode([b"ab", None, b"c", None, None, None])
    assert s.parse_index(shard[-100:], (4, 5)).tolist()[:3] == [[0, 2], [2**64 - 1] * 2, [2, 1]]
    assert [C.parse_shuffle(x) for x in (0, 1, "noshuffle", "shuffle", "odd", None)] == [False, True, False, True, True, True]
    with pytest.raises(UnsupportedError):
        C.parse_shuffle(2)
