"""A minimal encoder of Zarr stores for tests: it shares no code with the engine."""

import gzip
import itertools
import json
import os
import struct
import zlib

import numpy as np
import zstandard


def put(root, key, data):
    path = os.path.join(root, *key.split("/"))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else json.dumps(data).encode())


def slow_crc32c(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def chunks_of(values, shape, fill=0):
    for c in itertools.product(*[range(-(-n // k)) for n, k in zip(values.shape, shape)]):
        part = values[tuple(slice(i * k, (i + 1) * k) for i, k in zip(c, shape))]
        full = np.full(shape, fill, values.dtype)
        full[tuple(slice(0, n) for n in part.shape)] = part
        yield c, full, part


def encoder(codecs):
    def run(b):
        for c in codecs:
            name, conf = c["name"], c.get("configuration", {})
            if name == "gzip":
                b = gzip.compress(b)
            elif name == "zstd":
                b = zstandard.ZstdCompressor().compress(b)
            elif name == "crc32c":
                b += struct.pack("<I", slow_crc32c(b))
        return b

    return run


def v3_array(root, path, values, chunk, dtype=None, codecs=None, separator="/", encoding="default", fill=0, skip=(), big=False, truncated=False, attributes=None):
    codecs = codecs if codecs is not None else [{"name": "bytes", "configuration": {"endian": "big" if big else "little"}}]
    doc = {
        "zarr_format": 3, "node_type": "array", "shape": list(values.shape), "data_type": dtype or values.dtype.name,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunk)}},
        "chunk_key_encoding": {"name": encoding, "configuration": {"separator": separator}}, "fill_value": fill, "codecs": codecs, "attributes": attributes or {},
    }
    put(root, f"{path}/zarr.json".lstrip("/"), doc)
    run = encoder(codecs)
    for c, full, part in chunks_of(values, chunk, fill):
        if c not in skip:
            body = (part if truncated else full)
            name = separator.join(map(str, c))
            key = name if encoding == "v2" else f"c{separator}{name}"
            put(root, f"{path}/{key}".lstrip("/"), run(body.astype(body.dtype.newbyteorder(">" if big else "<")).tobytes()))


def v2_array(root, path, values, chunk, code=None, separator=".", declared=True, compressor=None, order="C", skip=()):
    code = code or values.dtype.newbyteorder("<").str
    doc = {"zarr_format": 2, "shape": list(values.shape), "chunks": list(chunk), "dtype": code, "compressor": compressor, "fill_value": 0, "order": order, "filters": None}
    if declared:
        doc["dimension_separator"] = separator
    put(root, f"{path}/.zarray".lstrip("/"), doc)
    for c, full, _ in chunks_of(values, chunk):
        if c not in skip:
            body = full.astype(np.dtype(code)).tobytes(order)
            put(root, f"{path}/{separator.join(map(str, c))}".lstrip("/"), gzip.compress(body) if compressor else body)


def sharded(root, path, values, shard, inner, at_end=True, crc=True, empty=()):
    index_codecs = [{"name": "bytes"}, *([{"name": "crc32c"}] if crc else [])]
    conf = {"chunk_shape": list(inner), "codecs": [{"name": "bytes"}, {"name": "zstd"}], "index_codecs": index_codecs, "index_location": "end" if at_end else "start"}
    doc = {
        "zarr_format": 3, "node_type": "array", "shape": list(values.shape), "data_type": values.dtype.name,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(shard)}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0, "codecs": [{"name": "sharding_indexed", "configuration": conf}],
    }
    put(root, f"{path}/zarr.json".lstrip("/"), doc)
    for c, full, _ in chunks_of(values, shard):
        table, body, n = [], b"", int(np.prod([s // i for s, i in zip(shard, inner)]))
        at = 0 if at_end else 16 * n + 4 * crc
        for i, part, _ in chunks_of(full, inner):
            if (*c, *i) in empty:
                table += [2**64 - 1] * 2
                continue
            raw = zstandard.ZstdCompressor().compress(part.tobytes())
            table += [at + len(body), len(raw)]
            body += raw
        index = struct.pack(f"<{len(table)}Q", *table)
        index += struct.pack("<I", slow_crc32c(index)) if crc else b""
        put(root, f"{path}/c/" + "/".join(map(str, c)), body + index if at_end else index + body)


def blosc_frame(raw, item, streams, flags, squeeze, block=None, shuffled=True):
    """A Blosc frame by hand: ``streams`` streams a block; squeeze gives a stream's bytes and its stated size."""
    block = block or len(raw)
    parts = []
    for a in range(0, len(raw), block):
        b = raw[a : a + block]
        if shuffled:
            b = np.frombuffer(b, np.uint8).reshape(-1, item).T.tobytes()
        n = len(b) // streams
        out = b""
        for k in range(streams):
            piece = b[k * n : (k + 1) * n if k < streams - 1 else len(b)]
            data, size = squeeze(piece)
            out += struct.pack("<i", size) + data
        parts.append(out)
    starts, at = [], 16 + 4 * len(parts)
    for p in parts:
        starts.append(at)
        at += len(p)
    body = struct.pack(f"<{len(starts)}i", *starts) + b"".join(parts)
    return struct.pack("<BBBBIII", 2, 1, flags | (1 if shuffled else 0), item, len(raw), block, 16 + len(body)) + body


def deflated(b):
    return zlib.compress(b)
