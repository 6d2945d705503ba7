"""SimHash near-dedup at a set similarity: wide fingerprints, compared bit-sliced within blocks that share least shingles, and
the similarity itself among the candidates so found."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelith.llm.common import byte_buffer, checkpointed, lower_bytes, mix, shuffle_partitions, unused
from voxelith.llm.simhash import _BIT, components, planes, within

#: 64-bit limbs of a fingerprint; block keys of a document and least shingle hashes that make one.
LIMBS, KEYS, LEAST = 16, 14, 4
#: The radius is what the similarity makes likely, and so many standard deviations more.
MARGIN = 2.5
_MULTIPLIERS = mix(np.arange(1, KEYS * LEAST + 1, dtype=np.uint64)) | np.uint64(1)
_OFFSETS = mix(np.arange(101, 101 + LIMBS, dtype=np.uint64))
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def radius_for(similarity: float, bits: int = 64 * LIMBS) -> int:
    """Differing bits to allow for a Jaccard similarity: two shingle sets at that angle, plus the margin."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + MARGIN * math.sqrt(bits * share * (1 - share)))


def _shingles(words: list[bytes], size: int) -> np.ndarray:
    """Distinct shingle hashes of a word sequence; the whole sequence if it is shorter; one constant for none."""
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n, out = len(words) - size + 1, np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(mix(out))


def signature(words: list[bytes], size: int) -> tuple[list[int], list[int]]:
    """A fingerprint's limbs and the block keys of a word sequence, as signed longs."""
    h = _shingles(words, size)
    limbs = []
    for offset in _OFFSETS:
        octets = mix(h + offset).view(np.uint8).reshape(-1, 8)
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BIT for k in range(8)])
        limbs.append(int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0]))
    least = np.full(len(_MULTIPLIERS), _ALL)
    for a in range(0, len(h), 2048):
        least = np.minimum(least, (h[a : a + 2048, None] * _MULTIPLIERS).min(axis=0))
    keys = np.arange(KEYS, dtype=np.uint64)
    for k in range(LEAST):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + least[k::LEAST])
    return limbs, keys.view(np.int64).tolist()


def _star(ids: np.ndarray, x: np.ndarray, radius: int) -> tuple[list, list]:
    """Links that join each component of one run: every member meets those not yet in any component."""
    left, right = [], []
    while len(ids) > 1:
        root, queue = ids[0], [x[0]]
        ids, x = ids[1:], x[1:]
        vertical = np.vstack([planes(x[:, k]) for k in range(x.shape[1])])
        while queue and len(ids):
            q = queue.pop()
            flip = np.where((q[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), _ALL, np.uint64(0)).ravel()
            hit = within(vertical ^ flip[:, None], radius)[: len(ids)]
            if hit.any():
                left += ids[hit].tolist()
                right += [root] * int(hit.sum())
                queue += list(x[hit])
                ids, x = ids[~hit], x[~hit]
                vertical = np.vstack([planes(x[:, k]) for k in range(x.shape[1])])
    return left, right


def _scan(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None

    def linked(keys: np.ndarray, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(keys)))
        left, right = [], []
        pairs = first[size == 2]
        if len(pairs):
            differ = np.vstack([planes(x[pairs, k] ^ x[pairs + 1, k]) for k in range(x.shape[1])])
            pairs = pairs[within(differ, radius)[: len(pairs)]]
            left, right = ids[pairs + 1].tolist(), ids[pairs].tolist()
        for s, n in zip(first[size > 2], size[size > 2], strict=True):
            a, b = _star(ids[s : s + n], x[s : s + n], radius)
            left += a
            right += b
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    for batch in batches:
        new = (np.asarray(batch.column("key")), np.asarray(batch.column("node")), np.stack([np.asarray(batch.column(f"f{k}")).view(np.uint64) for k in range(LIMBS)], axis=1))
        keys, ids, x = new if held is None else tuple(np.concatenate(p) for p in zip(held, new, strict=True))
        cut = len(keys) - int(np.argmax(np.append(keys[::-1] != keys[-1], True))) if len(keys) else 0
        held = (keys[cut:], ids[cut:], x[cut:])
        yield linked(keys[:cut], ids[:cut], x[:cut])
    if held is not None:
        yield linked(*held)


def confirmed(ids: list[int], sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links (member, root) that join the components of texts whose shingle sets have that Jaccard similarity or more.

    Every member meets those not yet in any component whose sizes allow the similarity.
    """
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    size, node = size[order], np.array(ids, np.int64)[order]
    codes = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1]
    mark = np.zeros(int(codes.max()) + 1, bool)
    left, right = [], []
    while len(node) > 1:
        root, queue = int(node[0]), [codes[: size[0]]]
        codes, node, size = codes[size[0] :], node[1:], size[1:]
        at = np.concatenate([[0], np.cumsum(size)])
        while queue and len(node):
            q = queue.pop()
            a, b = np.searchsorted(size, [similarity * len(q) - 1, len(q) / similarity + 1])
            if a == b:
                continue
            mark[q] = True
            common = np.add.reduceat(mark[codes[at[a] : at[b]]], at[a:b] - at[a], dtype=np.int64)
            mark[q] = False
            hit = np.zeros(len(node), bool)
            hit[a:b] = common / (size[a:b] + len(q) - common) >= similarity
            if hit.any():
                left += node[hit].tolist()
                right += [root] * int(hit.sum())
                queue += [codes[at[k] : at[k + 1]] for k in np.flatnonzero(hit)]
                codes, node, size = codes[np.repeat(~hit, size)], node[~hit], size[~hit]
                at = np.concatenate([[0], np.cumsum(size)])
    return left, right


def _confirm(batches: Iterator[pa.RecordBatch], size: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links (node, root) of a partition of candidates in order of group and node; a node may come more than once."""
    group, ids, sets = None, [], []

    def linked() -> pa.RecordBatch:
        a, b = confirmed(ids, sets, similarity) if len(ids) > 1 else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["node", "root"])

    for batch in batches:
        raw, at = byte_buffer(batch.column("text"))
        for k, (g, i) in enumerate(zip(batch.column("group").to_pylist(), batch.column("node").to_pylist(), strict=True)):
            if g != group:
                yield linked()
                group, ids, sets = g, [], []
            if not ids or ids[-1] != i:
                ids.append(i)
                sets.append(_shingles(lower_bytes(raw[at[k] : at[k + 1]]).tobytes().split(), size))
    yield linked()


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, tid, component_id, stays) for every row of docs; tid is the hash of its text.

    Rows link if their sets of ``size``-word shingles, A-Z in lower case, have that Jaccard
    similarity or more. Candidates are groups whose SimHashes are as near as such texts' are
    likely to be; blocks share a key of least shingle hashes, which texts of 0.8 fail to do once
    in a thousand times. Within a group the sets themselves decide. component_id is the
    smallest doc_id reachable. One row of a group stays: the one with the smallest doc_id, by
    text if ids are equal. Texts of no words are one group. Null ids come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = byte_buffer(batch.column("text"))
            data = lower_bytes(raw).tobytes()
            made, nodes, other = [], np.empty(batch.num_rows, np.uint64), np.empty(batch.num_rows, np.uint64)
            for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):  # one row's words at a time
                words = data[a:b].split()
                whole = b" ".join(words)
                made.append(signature(words, size))
                nodes[k], other[k] = (xxhash.xxh64_intdigest(whole, seed=s) for s in (0, 1))
            nodes, other = nodes.view(np.int64), other.view(np.int64)
            limbs = [pa.array([m[0][k] for m in made], pa.int64()) for k in range(LIMBS)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), pa.array(nodes), pa.array(other), *limbs, pa.array([m[1] for m in made], pa.list_(pa.int64()))], ["doc_id", "tid", "node", "other", *[f"f{k}" for k in range(LIMBS)], "keys"])

    limbs = [f"f{k}" for k in range(LIMBS)]
    rows = checkpointed(docs.select("doc_id", F.xxhash64("text").alias("tid"), "text").mapInArrow(run, f"doc_id long, tid long, node long, other long, {', '.join(f'{c} long' for c in limbs)}, keys array<long>"))
    pick = F.min(F.struct("other", "doc_id", "tid")).alias("least")
    own = rows.groupBy("node").agg(pick, *[F.min_by(c, "other").alias(c) for c in limbs], F.min_by("keys", "other").alias("keys"))
    keyed = own.select("node", *limbs, F.explode("keys").alias("key")).repartition(shuffle_partitions(docs.sparkSession), "key").sortWithinPartitions("key", "node")
    found = components(keyed.mapInArrow(partial(_scan, radius=radius_for(similarity)), "a long, b long").where("a <> b").distinct())
    grouped = found.select("node", F.col("root").alias("group")).unionByName(found.select(F.col("root").alias("node"), F.col("root").alias("group"))).distinct()
    wanted = own.select("node", F.col("least.doc_id").alias("__id"), F.col("least.tid").alias("__tid")).join(grouped, "node")
    texts = docs.select("doc_id", F.xxhash64("text").alias("tid"), "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tid") == F.col("__tid")))
    dealt = texts.select("group", "node", "text").repartition(shuffle_partitions(docs.sparkSession), "group").sortWithinPartitions("group", "node")
    sure = dealt.mapInArrow(partial(_confirm, size=size, similarity=similarity), "node long, root long")
    rooted = own.select("node", "least").join(sure, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rank = F.struct("least.doc_id", "least.tid")
    named = rooted.groupBy("root").agg(F.min(rank).alias("best"), F.min("least.doc_id").alias("component_id"))
    of = rooted.select("node", "root", F.col("least.other").alias("told")).join(named, "root").select("node", "told", "best", "component_id")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("tid") == F.col("best.tid"))
    # Another text of the same hash took no part in the search: it stays, and is its own group.
    lone = F.col("other") != F.col("told")
    return rows.select("doc_id", "tid", "node", "other").join(of, "node").select("doc_id", "tid", F.when(lone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (stays | lone).alias("stays"))


def drop_near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay, one of each group, with docs' own columns. Equal rows count as one."""
    id_, null, tid, row = unused(docs, "id", "null", "tid", "row")
    found = near_copies(docs.select("doc_id", "text"), size, similarity).where("stays")
    kept = found.select(F.coalesce("doc_id", F.lit(0)).alias(id_), F.col("doc_id").isNull().alias(null), F.col("tid").alias(tid)).distinct()
    own = docs.select("*", F.coalesce("doc_id", F.lit(0)).alias(id_), F.col("doc_id").isNull().alias(null), F.xxhash64("text").alias(tid))
    joined = own.join(kept, [id_, null, tid]).withColumn(row, F.row_number().over(Window.partitionBy(id_, null, tid).orderBy(id_)))
    return joined.where(F.col(row) == 1).select(*[F.col(c) for c in docs.columns])
