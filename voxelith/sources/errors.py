"""Errors of stores, metadata and codecs."""


class ZarrError(Exception):
    """Anything wrong with a store's contents."""


class NodeNotFoundError(ZarrError, FileNotFoundError):
    """A path holds neither a group nor an array."""


class MetadataError(ZarrError, ValueError):
    """Metadata that is missing, malformed or of the wrong kind."""


class UnsupportedError(ZarrError, NotImplementedError):
    """A data type, codec or operation that this engine doesn't have."""


class CodecError(ZarrError, ValueError):
    """Bytes that a codec can't decode."""


class RegionError(ValueError):
    """A region outside its array, or of the wrong rank."""
