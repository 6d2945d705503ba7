"""An exchange of hashes between blocks of documents and buckets of hashes.

A row for each word window or word pair of a corpus would be shuffled at many times the
size of the text. Here documents are gathered in blocks; a block sends each bucket one
packed run of its own sorted distinct keys, and gets back one packed answer in that order.
A very frequent key costs one entry a block, however many rows have it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.llm.common import pack, shuffle_partitions, unpack

#: A run should hold about so many keys; blocks and buckets grow with the root of the input for that, within these bytes of text.
RUN_KEYS, LEAST_BYTES, MOST_BYTES = 8000, 1 << 20, 12 << 20
#: A bucket has the keys of about so many blocks: fewer buckets make fewer runs, and keys take less room than texts.
BUCKET_BLOCKS = 4


def layout(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """Documents with a column ``block``; the number of partitions; the bits of a bucket's number.

    A document's block is a hash of its id and text, so a lost task makes the same block again.
    Blocks and buckets only say where work is done: no result depends on their numbers.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    each = min(MOST_BYTES, max(LEAST_BYTES, 4 * math.isqrt(RUN_KEYS * total // 4)))
    n = shuffle_partitions(docs.sparkSession)
    blocks = max(2 * n, math.ceil(total / each))
    bits = min(24, max(2, math.ceil(math.log2(blocks / BUCKET_BLOCKS))))
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))), n, bits


def bucket_bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket's run begins in sorted 64-bit keys, and the end."""
    firsts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, firsts), [len(keys)]])


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as packed differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)
