"""Stores: flat maps from keys to bytes, on local disks, over HTTP or in S3.

Only a missing key is "absent". Any other failure is retried a bounded number of times and
then raised, so that a network fault never turns into zero pixels.
"""

from __future__ import annotations

import os
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections import OrderedDict
from collections.abc import Callable

from voxelith.sources.errors import MetadataError, UnsupportedError

METADATA_NAMES = ("zarr.json", ".zarray", ".zgroup", ".zattrs", ".zmetadata")
RETRIES = 4
#: Bytes of encoded chunks that a process keeps of one store.
CACHE_BYTES = 256 << 20


def is_metadata_key(key: str) -> bool:
    return key.lower().endswith(METADATA_NAMES)


def join_key(*parts: str) -> str:
    """Parts of a key joined by single slashes; empty parts vanish."""
    return "/".join(p for p in (x.strip("/") for x in parts) if p)


class Store:
    """Read gives None for an absent key; delete of one is no error."""

    uri: str

    def read(self, key: str) -> bytes | None:
        raise NotImplementedError

    def read_range(self, key: str, start: int, length: int) -> bytes | None:
        """``length`` bytes from ``start``, or from the end if start is negative."""
        data = self.read(key)
        if data is None:
            return None
        start = start if start >= 0 else len(data) + start
        return data[start : start + length]

    def write(self, key: str, data: bytes) -> None:
        raise UnsupportedError(f"{type(self).__name__} is read-only")

    def exists(self, key: str) -> bool:
        return self.read(key) is not None

    def list(self, prefix: str = "") -> list[str]:
        raise UnsupportedError(f"{type(self).__name__} can't list")

    def delete(self, key: str) -> None:
        raise UnsupportedError(f"{type(self).__name__} is read-only")


class LocalStore(Store):
    """Keys are files below an existing folder. Writes go to a temporary name first, then replace."""

    def __init__(self, root: str):
        self.root = os.path.abspath(root)
        self.uri = self.root
        if not os.path.isdir(self.root):
            raise NotADirectoryError(f"no such folder: {self.root}")

    def _path(self, key: str) -> str:
        path = os.path.abspath(os.path.join(self.root, *[p for p in key.split("/") if p]))
        if os.path.commonpath([self.root, path]) != self.root:
            raise PermissionError(f"{key!r} leaves the store")
        return path

    def read(self, key: str) -> bytes | None:
        try:
            with open(self._path(key), "rb") as f:
                return f.read()
        except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
            return None

    def read_range(self, key: str, start: int, length: int) -> bytes | None:
        try:
            with open(self._path(key), "rb") as f:
                f.seek(start, os.SEEK_SET if start >= 0 else os.SEEK_END)
                return f.read(length)
        except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
            return None

    def write(self, key: str, data: bytes) -> None:
        path = self._path(key)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)

    def exists(self, key: str) -> bool:
        """Folders count too."""
        return os.path.exists(self._path(key))

    def list(self, prefix: str = "") -> list[str]:
        top = self._path(prefix)
        found = [os.path.relpath(os.path.join(d, n), self.root).replace(os.sep, "/") for d, _, names in os.walk(top) for n in names if not n.endswith(".part")]
        return sorted(found)

    def children(self, prefix: str = "") -> list[str]:
        top = self._path(prefix)
        return sorted(e.name for e in os.scandir(top) if e.is_dir()) if os.path.isdir(top) else []

    def delete(self, key: str) -> None:
        try:
            os.remove(self._path(key))
        except FileNotFoundError:
            pass


class HttpStore(Store):
    """Read-only; 404 is absent, other faults are retried and then raised."""

    def __init__(self, url: str, timeout: float = 300, opener: Callable | None = None, pause: float = 0.5):
        self.uri = self.url = url.rstrip("/")
        self.timeout, self.pause = timeout, pause
        self._open = opener or urllib.request.urlopen

    def url_of(self, key: str) -> str:
        return "/".join([self.url, *[urllib.parse.quote(p, safe="") for p in key.split("/") if p]])

    def _ask(self, key: str, method: str = "GET", headers: dict | None = None) -> bytes | None:
        request = urllib.request.Request(self.url_of(key), method=method, headers=headers or {})
        for k in range(RETRIES):
            try:
                with self._open(request, timeout=self.timeout) as answer:
                    return answer.read()
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return None
                if e.code < 500 and e.code != 429 or k == RETRIES - 1:
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if k == RETRIES - 1:
                    raise
            time.sleep(self.pause * 2**k)
        return None

    def read(self, key: str) -> bytes | None:
        return self._ask(key)

    def read_range(self, key: str, start: int, length: int) -> bytes | None:
        span = f"bytes={start}-{start + length - 1}" if start >= 0 else f"bytes={start}"
        data = self._ask(key, headers={"Range": span})
        if data is None or len(data) <= length:
            return data
        return super_range(data, start, length)

    def exists(self, key: str) -> bool:
        try:
            return self._ask(key, "HEAD") is not None
        except urllib.error.HTTPError:
            probe = {} if is_metadata_key(key) else {"Range": "bytes=0-0"}
            return self._ask(key, headers=probe) is not None


def super_range(data: bytes, start: int, length: int) -> bytes:
    """The range of a whole answer, from servers that ignore Range."""
    start = start if start >= 0 else len(data) + start
    return data[start : start + length]


#: Buckets of public image archives that live behind another endpoint. Fixed values.
ARCHIVE_BUCKETS = {"idr": "https://uk1s3.embassy.ebi.ac.uk", "bia": "https://uk1s3.embassy.ebi.ac.uk", "ukbb": "https://uk1s3.embassy.ebi.ac.uk"}


def is_s3_uri(uri: str) -> bool:
    return uri.lower().startswith("s3://")


def parse_s3_uri(uri: str) -> tuple[str, str]:
    """(bucket, prefix); the prefix has no slash at its ends."""
    if not is_s3_uri(uri):
        raise ValueError(f"not an s3 URI: {uri}")
    bucket, _, prefix = uri[5:].partition("/")
    if not bucket:
        raise ValueError(f"no bucket in {uri}")
    return bucket, prefix.strip("/")


def s3_settings(bucket: str, environ=os.environ, endpoint: str | None = None, region: str | None = None, access_key: str | None = None, secret_key: str | None = None) -> dict:
    """Arguments of the S3 file system: given keys, else the environment's, else anonymous; path-style addressing."""
    endpoint = endpoint or ARCHIVE_BUCKETS.get(bucket.lower()) or environ.get("AWS_ENDPOINT_URL_S3") or environ.get("AWS_ENDPOINT_URL")
    region = region or environ.get("AWS_REGION") or environ.get("AWS_DEFAULT_REGION")
    out: dict = {"connect_timeout": 30, "request_timeout": 300, "force_virtual_addressing": False}
    access_key, secret_key = access_key or environ.get("AWS_ACCESS_KEY_ID"), secret_key or environ.get("AWS_SECRET_ACCESS_KEY")
    if access_key and secret_key:
        out |= {"access_key": access_key, "secret_key": secret_key}
        if token := environ.get("AWS_SESSION_TOKEN"):
            out["session_token"] = token
    elif not os.path.exists(os.path.expanduser("~/.aws/credentials")):
        out["anonymous"] = True
    if endpoint:
        out["endpoint_override"] = endpoint
    if region or endpoint:
        out["region"] = region or "us-east-1"
    return out


class S3Store(Store):
    """Keys are objects under a prefix, through Arrow's S3 file system."""

    def __init__(self, uri: str, **given):
        from pyarrow import fs

        self.uri = uri.rstrip("/")
        self.bucket, self.prefix = parse_s3_uri(uri)
        settings = s3_settings(self.bucket, **given)
        if "region" not in settings:
            try:
                settings["region"] = fs.resolve_s3_region(self.bucket)
            except OSError:
                settings["region"] = "us-east-1"
        self.fs = fs.S3FileSystem(**settings)

    def _path(self, key: str) -> str:
        return join_key(self.bucket, self.prefix, key)

    def _file(self, key: str):
        try:
            return self.fs.open_input_file(self._path(key))
        except FileNotFoundError:
            return None

    def read(self, key: str) -> bytes | None:
        f = self._file(key)
        return None if f is None else f.read()

    def read_range(self, key: str, start: int, length: int) -> bytes | None:
        f = self._file(key)
        return None if f is None else f.read_at(length, start if start >= 0 else max(0, f.size() + start))

    def write(self, key: str, data: bytes) -> None:
        with self.fs.open_output_stream(self._path(key)) as f:
            f.write(data)

    def exists(self, key: str) -> bool:
        return self.fs.get_file_info(self._path(key)).type.name != "NotFound"

    def list(self, prefix: str = "") -> list[str]:
        from pyarrow import fs

        top = self._path(prefix)
        found = self.fs.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        root = join_key(self.bucket, self.prefix)
        return sorted(f.path[len(root) :].strip("/") for f in found if f.is_file)

    def delete(self, key: str) -> None:
        try:
            self.fs.delete_file(self._path(key))
        except FileNotFoundError:
            pass


class ChunkCache:
    """Encoded chunks of one store in this process, up to a number of bytes; the longest unused go first. Absent chunks and metadata are never held."""

    def __init__(self, budget: int = CACHE_BYTES):
        self.budget, self.bytes = budget, 0
        self._held: OrderedDict[tuple, bytes] = OrderedDict()
        self._lock = threading.Lock()

    def get(self, key: tuple, load: Callable[[], bytes | None]) -> bytes | None:
        with self._lock:
            if key in self._held:
                self._held.move_to_end(key)
                return self._held[key]
        data = load()
        if data is not None and len(data) <= self.budget:
            with self._lock:
                self.bytes += len(data) - len(self._held.pop(key, b""))
                self._held[key] = data
                while self.bytes > self.budget:
                    self.bytes -= len(self._held.popitem(last=False)[1])
        return data

    def forget(self, name: str) -> None:
        with self._lock:
            for key in [k for k in self._held if k[0] == name]:
                self.bytes -= len(self._held.pop(key))


class CachedStore(Store):
    """A store whose chunks are read through a cache. Writes and deletes through it forget what they change; other writers are not seen."""

    def __init__(self, store: Store, cache: ChunkCache):
        self.store, self.cache, self.uri = store, cache, store.uri

    def read(self, key: str) -> bytes | None:
        return self.store.read(key) if is_metadata_key(key) else self.cache.get((key,), lambda: self.store.read(key))

    def read_range(self, key: str, start: int, length: int) -> bytes | None:
        return self.cache.get((key, start, length), lambda: self.store.read_range(key, start, length))

    def write(self, key: str, data: bytes) -> None:
        self.store.write(key, data)
        self.cache.forget(key)

    def delete(self, key: str) -> None:
        self.store.delete(key)
        self.cache.forget(key)

    def exists(self, key: str) -> bool:
        return self.store.exists(key)

    def list(self, prefix: str = "") -> list[str]:
        return self.store.list(prefix)


_caches: dict[str, ChunkCache] = {}


def cached_store(uri: str, budget: int = CACHE_BYTES) -> Store:
    """The store of a URI; its chunks come through this process' cache, which the next task of the same worker finds. Local files are the system's to cache."""
    store = open_store(uri)
    if not budget or isinstance(store, LocalStore):
        return store
    cache = _caches.setdefault(store.uri, ChunkCache(budget))
    cache.budget = budget
    return CachedStore(store, cache)


#: Store makers by URI scheme; others may be added.
SCHEMES: dict[str, Callable[[str], Store]] = {"s3": S3Store, "http": HttpStore, "https": HttpStore}


def open_store(uri: str) -> Store:
    """The store of a path or URI: s3, http, https and file, or a local path."""
    if not uri:
        raise MetadataError("an empty path")
    scheme = urllib.parse.urlsplit(uri).scheme.lower()
    if scheme in SCHEMES:
        return SCHEMES[scheme](uri)
    if scheme == "file":
        return LocalStore(urllib.parse.unquote(urllib.parse.urlsplit(uri).path))
    if len(scheme) > 1:
        raise UnsupportedError(f"no store for {scheme}://")
    return LocalStore(uri)


def store_or_new(uri: str) -> Store:
    """As open_store, but a local folder is made."""
    if len(urllib.parse.urlsplit(uri).scheme) <= 1 or urllib.parse.urlsplit(uri).scheme == "file":
        os.makedirs(urllib.parse.urlsplit(uri).path or uri, exist_ok=True)
    return open_store(uri)
