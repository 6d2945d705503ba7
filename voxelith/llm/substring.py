"""Substring dedup: Rabin-Karp hashes of all word windows, counted by bucket, merged into removal intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxelith.llm.blocks import bucket_bounds, layout, pack_bits, pack_keys, unpack_bits, unpack_keys
from voxelith.llm.common import byte_buffer, mix, pack, unpack, word_hashes, word_spans

_OTHER = np.uint64(0x94D049BB133111EB)  # makes other hashes of the words, for a window's check
_BASE = 0xB5AD4ECEDA1CE2A9  # odd; the hash of a window is a polynomial in it modulo 2**64


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of every ``length`` consecutive words: powers of two by doubling, joined by the binary digits of length."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, power, width = np.zeros(n, np.uint64), 0, words, 1
    while width <= length:
        if length & width:
            out = out * np.uint64(pow(_BASE, width, 1 << 64)) + power[at : at + n]
            at += width
        if 2 * width <= length:
            power = power[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + power[width:]
        width *= 2
    return mix(out)


def _block(table: pa.Table, length: int):
    """A block in its fixed order: table, bytes, words, windows' first words, distinct hashes, each window's place there, how often each is, and its check."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    raw, at = byte_buffer(table["text"])
    starts, ends, counts = word_spans(raw, at)
    row = np.repeat(np.arange(len(counts)), counts)
    tokens = word_hashes(raw, starts, ends)
    hashes = window_hashes(tokens, length)
    first = np.flatnonzero(row[: len(hashes)] == row[len(row) - len(hashes) :]) if len(hashes) else np.zeros(0, np.int64)
    keys, at, place, times = np.unique(hashes[first], return_index=True, return_inverse=True, return_counts=True)
    checks = (window_hashes(mix(tokens ^ _OTHER), length)[first][at] >> np.uint64(48)).astype(np.uint16)
    return table, raw, (starts, ends, counts), first, keys, place, times, checks


def _texts(raw, starts, ends, counts, keep) -> list[bytes]:
    """Each row's kept words joined by one space."""
    out, w, data = [], 0, raw.tobytes()
    for n in counts:
        k = keep[w : w + n]
        spans = zip(starts[w : w + n][k].tolist(), ends[w : w + n][k].tolist(), strict=True)
        out.append(b" ".join([data[a:b] for a, b in spans]))
        w += n
    return out


def dedup_substrings(docs: DataFrame, length: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, intervals, kept_text) for every row of docs.

    A window is ``length`` consecutive words of one row. Words that a window covers go if its
    word sequence starts anywhere else too, in the same row included. ``intervals`` are the
    maximal [start, end) runs of such words. Null and empty texts have no words; shorter texts
    lose nothing; repeated rows repeat each other, so all of theirs but the shortest lose all.
    Equal windows are told by 80 bits of two hashes. Other columns of docs are left out.
    """
    placed, n, bits = layout(docs.select("doc_id", "text"))
    dealt = placed.repartition(n, "block")

    def emit(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py() if len(table) else 0
        _, _, _, _, keys, _, times, checks = _block(table, length)
        at = bucket_bounds(keys, bits)
        runs = [(b, keys[x:y], times[x:y] > 1, checks[x:y]) for b, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)) if y > x]
        return pa.table(
            {
                "bucket": pa.array([r[0] for r in runs], pa.int32()),
                "block": pa.array([block] * len(runs), pa.int64()),
                "keys": pa.array([pack_keys(r[1]) for r in runs], pa.binary()),
                "twice": pa.array([pack_bits(r[2]) for r in runs], pa.binary()),
                "checks": pa.array([pack(r[3]) for r in runs], pa.binary()),
            }
        )

    def count(table: pa.Table) -> pa.Table:
        runs = [unpack_keys(b) for b in table["keys"].to_pylist()]
        own = [unpack_bits(b, len(k)) for b, k in zip(table["twice"].to_pylist(), runs, strict=True)]
        keys, checks = np.concatenate(runs), np.concatenate([unpack(b, np.uint16) for b in table["checks"].to_pylist()])
        order = np.lexsort((checks, keys))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (checks[order][1:] != checks[order][:-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(fresh) - 1
        again = np.bincount(place) > 1
        again[place[np.concatenate(own)]] = True
        ends = np.cumsum([len(k) for k in runs])[:-1]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "again": pa.array([pack_bits(x) for x in np.split(again[place], ends)], pa.binary())})

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"doc_id": [], "n_words": [], "n_removed": [], "intervals": [], "kept_text": []}, schema=out)
        table, raw, (starts, ends, counts), first, keys, place, _, _ = _block(table, length)
        at, again = bucket_bounds(keys, bits), np.zeros(len(keys), bool)
        for b, flags in zip(answers["bucket"].to_pylist(), answers["again"].to_pylist(), strict=True):
            again[at[b] : at[b + 1]] = unpack_bits(flags, at[b + 1] - at[b])
        edge = np.zeros(len(starts) + 1, np.int32)
        hits = first[again[place]]
        np.add.at(edge, hits, 1)
        np.add.at(edge, hits + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        bounds = np.concatenate([[0], np.cumsum(counts)])
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), bounds[:-1]) if len(counts) else np.zeros(0, np.int64)
        removed[counts == 0] = 0
        turns = gone.copy()
        turns[1:] ^= gone[:-1]
        heads = bounds[:-1][counts > 0]
        turns[heads] = gone[heads]
        shut = np.append(gone, False)
        stop = gone & ~shut[1:]
        tails = bounds[1:][counts > 0] - 1
        stop[tails] = gone[tails]
        begin, end = np.flatnonzero(turns & gone), np.flatnonzero(stop) + 1
        row = np.searchsorted(bounds, begin, "right") - 1
        base = bounds[row] if len(row) else row
        spans = pa.StructArray.from_arrays([pa.array(begin - base, pa.int64()), pa.array(end - base, pa.int64())], ["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(counts) + 1)), pa.int32()), spans)
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n_words": pa.array(counts, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "intervals": lists,
                "kept_text": pa.array(_texts(raw, starts, ends, counts, ~gone), pa.binary()).cast(pa.string()),
            },
            schema=out,
        )

    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("intervals", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())])
    sent = dealt.groupBy("block").applyInArrow(emit, "bucket int, block long, keys binary, twice binary, checks binary")
    answers = sent.groupBy("bucket").applyInArrow(count, "block long, bucket int, again binary").repartition(n, "block")
    schema = "doc_id long, n_words long, n_removed long, intervals array<struct<start:long,end:long>>, kept_text string"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove, schema)
