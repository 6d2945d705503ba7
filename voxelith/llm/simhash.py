"""SimHash near-dedup: fingerprints, bit-sliced comparison within blocks, and components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.llm.common import byte_buffer, checkpointed, lower_bytes, shuffle_partitions

BITS, SEED = 64, 42
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bits of each byte value, lowest first.
_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: In a run of so many equal block keys, the members' bit planes are stored once; shorter runs are compared side by side.
LONG_RUN = 48


def simhash(words: list[bytes], size: int) -> int:
    """The fingerprint of a word sequence: bit i is 1 if set in over half of the shingles' XXH64."""
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(words) - size + 1)
    spans = zip(starts[:k].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=True)
    h = np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in spans], repeat(SEED)), np.uint64, k)
    return _majority(h)


def _majority(h: np.ndarray) -> int:
    octets = h.view(np.uint8).reshape(-1, 8)
    if len(h) < 256:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BIT for k in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp, n_words) for every row; fp is the 64-bit fingerprint as a signed long, 0 for no words.

    A-Z in lower case, words split at ASCII white space, ``size``-word shingles with repeats,
    or the whole sequence if shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = byte_buffer(batch.column("text"))
            data = lower_bytes(raw).tobytes()
            fps, counts = np.empty(batch.num_rows, np.uint64), np.empty(batch.num_rows, np.int64)
            for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):  # one row's words at a time
                words = data[a:b].split()
                fps[k], counts[k] = simhash(words, size), len(words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64)), pa.array(counts)], ["doc_id", "fp", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long, n_words long")


# --- bit-sliced comparison -----------------------------------------------------------------


def planes(x: np.ndarray) -> np.ndarray:
    """Bit planes of 64-bit values, stored vertically: row b holds bit b of 64 values a word."""
    lanes = -(-len(x) // 64)
    padded = np.zeros(lanes * 64, np.uint64)
    padded[: len(x)] = x
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(vertical: np.ndarray, radius: int, block: int = 512) -> np.ndarray:
    """Flags of the lanes with at most ``radius`` bits set over all planes.

    Planes are added to carry-save counters, one counter bit a word; a lane that passes the
    radius stays out, and a block of lanes is abandoned once all have.
    """
    width = radius.bit_length() + 1
    start = (1 << width - 1) - 1 - radius  # so that the top counter bit is set at radius + 1
    out = np.zeros(vertical.shape[1], np.uint64)
    for a in range(0, vertical.shape[1], block):
        part = vertical[:, a : a + block]
        counter = [np.full(part.shape[1], _ALL if start >> k & 1 else np.uint64(0)) for k in range(width - 1)]
        over = np.zeros(part.shape[1], np.uint64)
        for b in range(len(part)):
            carry = part[b]
            for k in range(width - 1):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            if b & 7 == 7 and (over == _ALL).all():
                break
        out[a : a + block] = ~over
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _star(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, first member) that join each component of one run of distinct values.

    A member is compared with those not yet in any component; its hits join it and are
    compared in turn, so that no pair is needed twice and none is listed.
    """
    rest, left, right = x, [], []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        vertical = planes(rest)
        while queue and len(rest):
            q = queue.pop()
            flip = np.where((q >> np.arange(64, dtype=np.uint64)) & np.uint64(1), _ALL, np.uint64(0))
            hit = within(vertical ^ flip[:, None], radius)[: len(rest)]
            if hit.any():
                found = rest[hit]
                left.append(found)
                right.append(np.full(len(found), root))
                queue += list(found)
                rest = rest[~hit]
                vertical = planes(rest)
    return (np.concatenate(left), np.concatenate(right)) if left else (x[:0], x[:0])


def _links(keys: np.ndarray, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among values whose block keys are equal; keys are in runs."""
    if len(x) < 2:
        return x[:0], x[:0]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(first, len(x)))
    left, right = [], []
    for s, n in zip(first[size > LONG_RUN], size[size > LONG_RUN], strict=True):
        a, b = _star(x[s : s + n], radius)
        left.append(a)
        right.append(b)
    short = np.repeat(size <= LONG_RUN, size)
    number = np.repeat(np.arange(len(first)), size)
    for d in range(1, int(size[size <= LONG_RUN].max(initial=1))):
        i = np.flatnonzero(short[:-d] & (number[:-d] == number[d:]))
        if len(i):
            i = i[within(planes(x[i] ^ x[i + d]), radius)[: len(i)]]
            left.append(x[i + d])
            right.append(x[i])
    return (np.concatenate(left), np.concatenate(right)) if left else (x[:0], x[:0])


def _scan(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of a partition in order of block key; the last run of a batch waits for the next batch."""
    keep = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    for batch in batches:
        keys = np.concatenate([keep[0], np.asarray(batch.column("key"))])
        x = np.concatenate([keep[1], np.asarray(batch.column("fp")).view(np.uint64)])
        cut = len(keys) - int(np.argmax(np.append(keys[::-1] != keys[-1], True))) if len(keys) else 0
        keep = (keys[cut:], x[cut:])
        a, b = _links(keys[:cut], x[:cut], radius)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
    a, b = _links(*keep, radius)
    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def near_links(fps: DataFrame, radius: int = 2, exact_parts: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join all within ``radius`` bits.

    The bits are cut into ``radius + exact_parts`` parts. Two fingerprints within the radius
    agree in some ``exact_parts`` of them, so each choice of parts is a block key, and only
    equal keys are compared. Not every pair is listed: a run of equal keys gives the links
    that join its components, fewer than its members. Runs hold distinct values that agree in
    most bits, so copies of one text never fill them.
    """
    parts = radius + exact_parts
    edges = [BITS * k // parts for k in range(parts + 1)]
    masks = [sum(((1 << edges[p + 1]) - 1) ^ ((1 << edges[p]) - 1) for p in chosen) for chosen in combinations(range(parts), exact_parts)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    key = lambda k, m: F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("long")))
    keyed = fps.select("fp", F.explode(F.array(*[key(k, m) for k, m in enumerate(signed)])).alias("key"))
    dealt = keyed.repartition(shuffle_partitions(fps.sparkSession), "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(partial(_scan, radius=radius), "a long, b long").where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node reachable.

    Alternating large-star and small-star rounds over aggregates, until one changes nothing: some
    logarithm of the longest chain of them. Each round is checkpointed, and only a digest of it
    comes to the driver.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    digest = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    seen = digest(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(edges.join(least, "u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = digest(edges)
        if now == seen:
            break
        seen = now
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Rows link if their fingerprints differ in at most ``radius`` bits; component_id is the
    smallest doc_id reachable (null ids are passed over, null if there is none). Null and
    empty texts have fingerprint zero and link like any other; an empty table gives no rows.
    """
    rows = checkpointed(fingerprints(docs, size).drop("n_words"))
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(near_links(own.select("fp"), radius))
    rooted = own.join(found, own["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
