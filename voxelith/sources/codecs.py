"""Chunk codecs: bytes, gzip, zstd, crc32c, blosc and sharding, after their public formats."""

from __future__ import annotations

import gzip
import math
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard

from voxelith.sources.errors import CodecError, MetadataError, UnsupportedError

EMPTY = (1 << 64) - 1


@dataclass(frozen=True)
class Codec:
    """One step of a pipeline over bytes."""

    def decode(self, data: bytes, size: int) -> bytes:
        """size: the bytes of the whole chunk, decoded."""
        raise NotImplementedError

    def encode(self, data: bytes) -> bytes:
        raise NotImplementedError


@dataclass(frozen=True)
class Bytes(Codec):
    """Byte order of elements."""

    item: int
    big: bool = False

    def _swap(self, data: bytes) -> bytes:
        if self.item <= 1 or not self.big:
            return data
        if len(data) % self.item:
            raise CodecError(f"{len(data)} bytes are no whole number of {self.item}-byte elements")
        return np.frombuffer(data, np.uint8).reshape(-1, self.item)[:, ::-1].tobytes()

    def decode(self, data: bytes, size: int) -> bytes:
        return self._swap(data)

    def encode(self, data: bytes) -> bytes:
        return self._swap(data)


@dataclass(frozen=True)
class Gzip(Codec):
    level: int = 6

    def decode(self, data: bytes, size: int) -> bytes:
        try:
            return gzip.decompress(data)
        except (OSError, EOFError, zlib.error) as e:
            raise CodecError(f"gzip: {e}") from e

    def encode(self, data: bytes) -> bytes:
        return gzip.compress(data, min(9, max(0, self.level)), mtime=0)


@dataclass(frozen=True)
class Zstd(Codec):
    level: int = 3

    def decode(self, data: bytes, size: int) -> bytes:
        try:
            return zstandard.ZstdDecompressor().decompressobj().decompress(data)
        except zstandard.ZstdError as e:
            raise CodecError(f"zstd: {e}") from e

    def encode(self, data: bytes) -> bytes:
        return zstandard.ZstdCompressor(level=min(22, max(1, self.level))).compress(data)


# --- CRC-32C --------------------------------------------------------------------------------

_POLYNOMIAL = 0x82F63B78  # Castagnoli, reflected


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1)
    return t.astype(np.uint32)


_CRC = _crc_table()
_LANES = 512


def _advance(crc: np.ndarray, n: int) -> np.ndarray:
    for _ in range(n):
        crc = _CRC[crc & 0xFF] ^ (crc >> np.uint32(8))
    return crc


def crc32c(data: bytes) -> int:
    """Long inputs run in lanes side by side; a lane's register moves past the next by linear maps of its bits."""
    raw = np.frombuffer(data, np.uint8)
    crc = 0xFFFFFFFF
    width = len(raw) // _LANES
    done = 0
    if width >= 16:
        lanes = raw[: width * _LANES].reshape(_LANES, width)
        own = np.zeros(_LANES, np.uint32)
        for k in range(width):
            own = _CRC[(own ^ lanes[:, k]) & 0xFF] ^ (own >> np.uint32(8))
        basis = [int(x) for x in _advance(np.uint32(1) << np.arange(32, dtype=np.uint32), width)]
        for x in own.tolist():
            moved, rest, k = 0, crc, 0
            while rest:
                if rest & 1:
                    moved ^= basis[k]
                rest >>= 1
                k += 1
            crc = moved ^ x
        done = width * _LANES
    table = _CRC.tolist()
    for b in raw[done:].tolist():
        crc = table[(crc ^ b) & 0xFF] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


@dataclass(frozen=True)
class Crc32c(Codec):
    """A checksum in the last four bytes, little-endian."""

    def decode(self, data: bytes, size: int) -> bytes:
        if len(data) < 4:
            raise CodecError("too short for a checksum")
        body = data[:-4]
        if crc32c(body) != struct.unpack("<I", data[-4:])[0]:
            raise CodecError("checksum mismatch")
        return body

    def encode(self, data: bytes) -> bytes:
        return data + struct.pack("<I", crc32c(data))


# --- Blosc ----------------------------------------------------------------------------------

_BLOSC_NAMES = {0: "blosclz", 1: "lz4", 2: "snappy", 3: "zlib", 4: "zstd"}
_SHUFFLED, _MEMCPY, _BITSHUFFLED, _WHOLE = 1, 2, 4, 0x10


def shuffle(data: bytes, item: int) -> bytes:
    if item <= 1 or len(data) % item:
        return data
    return np.frombuffer(data, np.uint8).reshape(-1, item).T.tobytes()


def unshuffle(data: bytes, item: int) -> bytes:
    if item <= 1 or len(data) % item:
        return data
    return np.frombuffer(data, np.uint8).reshape(item, -1).T.tobytes()


def _inflate(data: bytes) -> bytes:
    try:
        return zlib.decompress(data)
    except zlib.error:
        return zlib.decompress(data, -15)


def _blosc_inner(name: str, data: bytes, size: int) -> bytes:
    try:
        if name == "lz4":
            return pa.Codec("lz4_raw").decompress(data, size).to_pybytes()
        if name == "zstd":
            return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
        return _inflate(data)
    except (OSError, ValueError, zlib.error, zstandard.ZstdError) as e:
        raise CodecError(f"blosc {name}: {e}") from e


def _blosc_streams(data: bytes, at: int, end: int, size: int, n: int, name: str) -> bytes:
    """A block's n streams; the last has what is left of its size."""
    out = []
    each = size // n
    for k in range(n):
        room = each if k < n - 1 else size - each * (n - 1)
        if at + 4 > end:
            raise CodecError("blosc: a block ends early")
        packed = struct.unpack_from("<i", data, at)[0]
        at += 4
        if packed < 0 or at + packed > end:
            raise CodecError("blosc: a stream leaves its block")
        if packed == 0:
            part = bytes(room)
        elif packed >= room:
            part = data[at : at + room]
        else:
            part = _blosc_inner(name, data[at : at + packed], room)
        if len(part) != room:
            raise CodecError(f"blosc: {len(part)} bytes where {room} belong")
        out.append(part)
        at += packed
    return b"".join(out)


def blosc_decode(data: bytes) -> bytes:
    if len(data) < 16:
        raise CodecError("blosc: no header")
    _, _, flags, item, size, block, packed = struct.unpack_from("<BBBBIII", data)
    if flags & _MEMCPY:
        if len(data) < 16 + size:
            raise CodecError("blosc: stored bytes end early")
        return data[16 : 16 + size]
    if size == 0:
        return b""
    name = _BLOSC_NAMES.get(flags >> 5, "?")
    if flags & _BITSHUFFLED:
        raise UnsupportedError("blosc bit shuffle")
    if name not in ("lz4", "zlib", "zstd"):
        raise UnsupportedError(f"blosc compressor {name}")
    if not block:
        raise CodecError("blosc: blocks of no bytes")
    count = -(-size // block)
    if len(data) < 16 + 4 * count:
        raise CodecError("blosc: the table of blocks ends early")
    starts = list(struct.unpack_from(f"<{count}i", data, 16))
    if any(not 16 <= x <= len(data) for x in starts):
        raise CodecError("blosc: a block starts outside")
    bounds = sorted([*starts, max(len(data), 0)])
    out = []
    for k, at in enumerate(starts):
        room = min(block, size - k * block)
        end = next(x for x in bounds if x > at) if at < len(data) else len(data)
        ways = [1] if flags & _WHOLE or item <= 1 else [item, 1] if room == block else [1, item]
        failed: CodecError | None = None
        for n in ways:
            try:
                part = _blosc_streams(data, at, end, room, n, name)
                break
            except CodecError as e:
                failed = failed or e
        else:
            raise failed
        out.append(unshuffle(part, item) if flags & _SHUFFLED else part)
    return b"".join(out)


def blosc_encode(data: bytes, item: int, name: str = "lz4", level: int = 5, shuffled: bool = True, block: int = 0) -> bytes:
    """One stream a block, and says so; stored where compression doesn't pay."""
    if name in ("lz4", "lz4hc"):
        code, squeeze = 1, lambda b: pa.Codec("lz4_raw").compress(b, asbytes=True)
    elif name == "zstd":
        code, squeeze = 4, zstandard.ZstdCompressor(level=max(1, level)).compress
    elif name == "zlib":
        code, squeeze = 3, lambda b: zlib.compress(b, min(9, level))
    else:
        raise UnsupportedError(f"blosc compressor {name}")
    item = item if 0 < item < 256 else 1
    stored = struct.pack("<BBBBIII", 2, 1, _MEMCPY | code << 5, item, len(data), len(data), 16 + len(data)) + data
    if not data or level <= 0:
        return stored
    block = min(len(data), block or 256 * 1024)
    block = max(item, block - block % item)
    parts = []
    for a in range(0, len(data), block):
        raw = data[a : a + block]
        raw = shuffle(raw, item) if shuffled else raw
        packed = squeeze(raw)
        parts.append(struct.pack("<i", min(len(packed), len(raw))) + (packed if len(packed) < len(raw) else raw))
    starts = 16 + 4 * len(parts) + np.cumsum([0, *map(len, parts[:-1])])
    body = struct.pack(f"<{len(parts)}i", *starts.tolist()) + b"".join(parts)
    flags = (_SHUFFLED if shuffled and item > 1 else 0) | _WHOLE | code << 5
    out = struct.pack("<BBBBIII", 2, 1, flags, item, len(data), block, 16 + len(body)) + body
    return out if len(out) < len(stored) else stored


@dataclass(frozen=True)
class Blosc(Codec):
    item: int
    name: str = "lz4"
    level: int = 5
    shuffled: bool = True
    block: int = 0

    def decode(self, data: bytes, size: int) -> bytes:
        return blosc_decode(data)

    def encode(self, data: bytes) -> bytes:
        return blosc_encode(data, self.item, self.name, self.level, self.shuffled, self.block)


def parse_shuffle(value) -> bool:
    """Numbers and names; unknown names mean byte shuffle."""
    if isinstance(value, str):
        if value.lower() == "bitshuffle":
            raise UnsupportedError("blosc bit shuffle")
        return value.lower() not in ("noshuffle", "none")
    if value == 2:
        raise UnsupportedError("blosc bit shuffle")
    return value is None or value != 0


# --- pipelines ------------------------------------------------------------------------------


def _setting(config: dict, name: str, default):
    return next((v for k, v in config.items() if k.lower() == name), default)


#: name: maker of a codec from (configuration, bytes of an element). Others may be added.
CODECS: dict[str, Callable[[dict, int], Codec]] = {
    "bytes": lambda c, item: Bytes(item, str(_setting(c, "endian", "little")).lower() == "big"),
    "gzip": lambda c, item: Gzip(int(_setting(c, "level", 6))),
    "zstd": lambda c, item: Zstd(int(_setting(c, "level", 3))),
    "crc32c": lambda c, item: Crc32c(),
    "blosc": lambda c, item: Blosc(int(_setting(c, "typesize", item) or item), str(_setting(c, "cname", "lz4")), int(_setting(c, "clevel", 5)), parse_shuffle(_setting(c, "shuffle", None)), int(_setting(c, "blocksize", 0))),
}


@dataclass(frozen=True)
class Pipeline:
    """Codecs in the order of encoding; decoding runs backwards."""

    codecs: tuple[Codec, ...]

    def decode(self, data: bytes, size: int) -> bytes:
        for c in reversed(self.codecs):
            data = c.decode(data, size)
        return data

    def encode(self, data: bytes) -> bytes:
        for c in self.codecs:
            data = c.encode(data)
        return data


@dataclass(frozen=True)
class Sharding:
    """How a shard's file holds its inner chunks."""

    inner: tuple[int, ...]
    pipeline: Pipeline
    index: Pipeline
    at_end: bool
    wrapped: bool = False

    def per_shard(self, shard: tuple[int, ...]) -> tuple[int, ...]:
        return tuple(-(-s // i) for s, i in zip(shard, self.inner, strict=True))

    def index_bytes(self, shard: tuple[int, ...]) -> int:
        return 16 * math.prod(self.per_shard(shard)) + 4 * sum(isinstance(c, Crc32c) for c in self.index.codecs)

    def parse_index(self, data: bytes, shard: tuple[int, ...]) -> np.ndarray:
        """(offset, bytes) of every inner chunk, last axis fastest."""
        n = math.prod(self.per_shard(shard))
        raw = self.index.decode(data, 16 * n)
        if len(raw) != 16 * n:
            raise CodecError("the shard's index is of the wrong size")
        return np.frombuffer(raw, "<u8").reshape(n, 2)

    def encode(self, chunks: list[bytes | None]) -> bytes:
        """A whole shard from its encoded inner chunks in order."""
        size, at, table, body = 16 * len(chunks) + 4 * sum(isinstance(c, Crc32c) for c in self.index.codecs), 0, [], []
        at = 0 if self.at_end else size
        for c in chunks:
            table += [EMPTY, EMPTY] if c is None else [at, len(c)]
            at += len(c or b"")
            body.append(c or b"")
        index = self.index.encode(np.array(table, "<u8").tobytes())
        return b"".join([*body, index] if self.at_end else [index, *body])


def _made(entry, item: int) -> Codec:
    name = entry if isinstance(entry, str) else entry.get("name")
    config = {} if isinstance(entry, str) else entry.get("configuration") or {}
    if name not in CODECS:
        raise UnsupportedError(f"codec {name!r}")
    return CODECS[name](config, item)


def pipeline_v3(codecs: list, item: int) -> tuple[Pipeline, Sharding | None]:
    """A v3 array's pipeline, and its sharding if it has any. A shard can't be read in parts if another codec lies around it: reading one is an error."""
    for entry in codecs:
        if not isinstance(entry, str) and entry.get("name") == "sharding_indexed":
            config = entry.get("configuration") or {}
            inner = _setting(config, "chunk_shape", None)
            if not inner:
                raise MetadataError("sharding without chunk_shape")
            inside = Pipeline(tuple(_made(c, item) for c in _setting(config, "codecs", None) or ["bytes"]))
            index = Pipeline(tuple(_made(c, 8) for c in _setting(config, "index_codecs", None) or ["bytes"]))
            return inside, Sharding(tuple(int(x) for x in inner), inside, index, str(_setting(config, "index_location", "end")).lower() != "start", len(codecs) > 1)
    return Pipeline(tuple(_made(c, item) for c in codecs or ["bytes"])), None


def pipeline_v2(compressor: dict | None, item: int, big: bool) -> Pipeline:
    """A v2 array's pipeline: the byte order of its type, and gzip, zstd, blosc or nothing."""
    order = Bytes(item, big)
    if compressor is None:
        return Pipeline((order,))
    name = str(compressor.get("id", "")).lower()
    if name == "gzip":
        return Pipeline((order, Gzip(int(compressor.get("level", 6)))))
    if name == "zstd":
        return Pipeline((order, Zstd(int(compressor.get("level", 3)))))
    if name == "blosc":
        return Pipeline((order, CODECS["blosc"](compressor, item)))
    raise UnsupportedError(f"compressor {name!r}")
