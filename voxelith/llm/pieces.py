"""SentencePiece encoding and decoding: N-best segmentation by A* with exact Viterbi heuristics."""

from __future__ import annotations

import gc
import math
import re
import zlib
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import nsmallest
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
MARK = "\ud800"  # stands for a SPACE of the text itself; no valid text holds it
#: Texts that are worked on at once, and chunks that a worker remembers.
ROWS, REMEMBERED = 512, 400_000

OTHERS = "array<struct<score:double,ids:array<int>>>"
CHANGES = "array<struct<score:double,changes:array<struct<start:int,end:int,ids:array<int>>>>>"


def changed(ids: np.ndarray, changes: list[tuple[int, int, tuple[int, ...]]]) -> np.ndarray:
    """Ids with others from start to end, for each of the changes."""
    parts, at = [], 0
    for start, end, instead in sorted(changes):
        parts += [ids[at:start], np.array(instead, np.int32)]
        at = end
    return np.concatenate([*parts, ids[at:]])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Segmented:
    """Texts' best scores, their ids in one row, where each text's end, and for each text the next best: scores, and where their ids differ (start, end, ids instead)."""

    score: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    others: list[list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]


class Memory:
    """What a worker remembers of chunks: the best segmentation and what the next best loses, in arrays. At REMEMBERED chunks it keeps the half that came again most."""

    held: tuple = (None, None)

    def __init__(self, pieces: Pieces, n: int):
        self.pieces, self.n = pieces, n
        self.index: dict[str, int] = {}
        self.fresh: list[tuple] = []
        self.score, self.loss = np.zeros(1024), np.zeros(1024)
        self.start, self.length, self.hits = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.end = np.zeros(4096, np.int32), 0

    @classmethod
    def of(cls, pieces: Pieces, n: int) -> Memory:
        key, memory = cls.held
        if key != (pieces.name, n):
            memory = cls(pieces, n)
            cls.held = ((pieces.name, n), memory)
        elif len(memory.index) > REMEMBERED:
            memory.forget()
        return memory

    def forget(self) -> None:
        count = len(self.index)
        hits = self.hits[:count]
        kept = np.flatnonzero(hits > 1)
        kept = np.sort(kept[np.argsort(-hits[kept], kind="stable")[: REMEMBERED // 2]])
        number = np.full(count, -1)
        number[kept] = np.arange(len(kept))
        self.index = {c: k for c, k in zip(self.index, number.tolist(), strict=True) if k >= 0}  # in order of their numbers
        size = max(1024, 1 << len(kept).bit_length())
        grown = lambda x: np.concatenate([x[kept], np.zeros(size - len(kept), x.dtype)])
        flat = self.flat[ragged(self.start[kept], self.length[kept])]
        self.flat, self.end = np.concatenate([flat, np.zeros(4096, np.int32)]), len(flat)
        self.score, self.loss, self.length, self.hits = grown(self.score), grown(self.loss), grown(self.length), grown(self.hits) // 2
        self.start = np.cumsum(self.length) - self.length

    def make(self, chunk: str) -> int:
        found, i = self.pieces.nbest(chunk, self.n), len(self.index)
        self.fresh.append((*found[0], found[0][0] - found[1][0] if len(found) > 1 else math.inf))
        self.index[chunk] = i
        return i

    def settle(self) -> None:
        """Numbers of the chunks made since the last time, laid into the arrays."""
        count, more = len(self.index), len(self.fresh)
        if not more:
            return
        ids = list(chain.from_iterable([f[1] for f in self.fresh]))
        while count > len(self.score):
            self.score, self.loss, self.start, self.length, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.score, self.loss, self.start, self.length, self.hits))
        while self.end + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        new = slice(count - more, count)
        self.flat[self.end : self.end + len(ids)] = ids
        self.score[new] = [f[0] for f in self.fresh]
        self.loss[new] = [f[2] for f in self.fresh]
        self.length[new] = [len(f[1]) for f in self.fresh]
        self.start[new] = self.end + np.cumsum(self.length[new]) - self.length[new]
        self.end += len(ids)
        self.fresh = []


@dataclass
class Pieces:
    """A vocabulary: pieces with scores, and one piece for each byte. Small enough to travel with a task."""

    scores: dict[str, tuple[int, float]]
    bytes_: list[int]
    table: list[bytes]
    longest: int
    byte_score: float
    pattern: str
    name: int
    matcher: ahocorasick.Automaton | None = field(default=None, repr=False)

    def __post_init__(self):
        self.letters = {p for p in self.scores if len(p) == 1}
        size = np.array([len(b) for b in self.table], np.int64)
        self.joined, self.spans = np.frombuffer(b"".join(self.table), np.uint8), (np.cumsum(size) - size, size)

    def __getstate__(self) -> dict:
        """Travels without what a worker makes for itself."""
        return self.__dict__ | {"matcher": None}

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Reads a SentencePiece model file with byte fallback, on the driver."""
        import sentencepiece

        with open(path, "rb") as f:
            proto = f.read()
        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = model.get_piece_size()
        by_byte = {int(model.id_to_piece(i)[3:-1], 16): i for i in range(n) if model.is_byte(i)}
        if len(by_byte) != 256:
            raise ValueError("the model has no piece for some byte")
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = {model.id_to_piece(i): (i, model.get_score(i)) for i in plain}
        table = [b""] * n
        for p, (i, _) in scores.items():
            table[i] = p.replace(SPACE, " ").encode()
        for b, i in by_byte.items():
            table[i] = bytes([b])
        # Where no piece goes on past a line end or over the start of a run of spaces, texts fall into chunks there.
        free = not any("\n" in p or SPACE in p.lstrip(SPACE) for p in scores if len(p) > 1)
        pattern = rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if free else r"(?s:.+)"
        return cls(scores, [by_byte[b] for b in range(256)], table, max(map(len, scores)), min(s for _, s in scores.values()) - 10, pattern, zlib.crc32(proto))

    def automaton(self) -> ahocorasick.Automaton:
        if self.matcher is None:
            self.matcher = ahocorasick.Automaton()
            for piece, (i, score) in self.scores.items():
                self.matcher.add_word(piece, (len(piece), score, (i,)))
            self.matcher.make_automaton()
        return self.matcher

    def lattice(self, chunk: str) -> tuple[list[list[tuple]], list[float], list[tuple]]:
        """The forward pass: for each position the edges (length, score, ids) that end there, the best score up to it and the edge it comes by."""
        size, none = len(chunk), -float("inf")
        into: list[list[tuple]] = [[] for _ in range(size + 1)]
        forward, back = [none] * (size + 1), [()] * (size + 1)
        forward[0] = 0.0
        if self.letters.issuperset(chunk):  # matches come in order of their ends
            for end, edge in self.automaton().iter(chunk):
                end += 1
                into[end].append(edge)
                if (s := forward[end - edge[0]] + edge[1]) > forward[end]:
                    forward[end], back[end] = s, edge
            return into, forward, back
        for end, edge in self.automaton().iter(chunk):
            into[end + 1].append(edge)
        for j, c in enumerate(chunk, 1):
            if c not in self.letters:  # a character that is no piece is a step of its bytes
                raw = (SPACE if c == MARK else c).encode()
                into[j].append((1, self.byte_score * len(raw), tuple(self.bytes_[b] for b in raw)))
            for edge in into[j]:
                if (s := forward[j - edge[0]] + edge[1]) > forward[j]:
                    forward[j], back[j] = s, edge
        return into, forward, back

    def nbest(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations with their scores, best first; fewer if there are fewer.

        Backward A* from the end: a hypothesis is a position and the path behind it, and its
        heuristic the forward score of that position. As that is exact, the successor by a
        position's best edge costs the same as the hypothesis itself, so it is opened at once
        and never waits in the queue; the queue holds the other successors by what they cost, no
        more of them than are still wanted.
        """
        into, forward, back = self.lattice(chunk)
        done: list[tuple[float, tuple[int, ...]]] = []
        best, order, left = forward[-1], 0, n - 1
        queue: list[tuple] = [(0.0, 0, len(chunk), None)]
        while queue:
            loss, _, at, path = queue.pop(0)
            limit = math.inf if len(queue) < left else queue[left - 1][0] if left else -math.inf
            while at:
                taken = back[at]
                if left and len(into[at]) > 1:
                    behind = loss + forward[at]
                    for edge in into[at]:
                        start = at - edge[0]
                        if (x := behind - forward[start] - edge[1]) < limit and edge is not taken:
                            order += 1
                            insort(queue, (x, order, start, (edge[2], path)))
                            if len(queue) >= left:
                                del queue[left:]
                                limit = queue[-1][0]
                path = (taken[2], path)
                at -= taken[0]
            ids: list[int] = []
            while path:
                ids += path[0]
                path = path[1]
            done.append((best - loss, tuple(ids)))
            if not left:
                break
            left -= 1
        return done

    def chunks(self, text: str) -> list[str]:
        """The text with spaces marked and one put in front, cut where no piece reaches over. A mark in the text itself gets a stand-in that is encoded as its bytes."""
        return re.findall(self.pattern, SPACE + text.replace(SPACE, MARK).replace(" ", SPACE)) if text else []

    def segment(self, texts: list[str], n: int) -> Segmented:
        """The n best segmentations of texts, joined from their chunks' n best, which a worker remembers by chunk."""
        known = Memory.of(self, n)
        lists = [self.chunks(t) for t in texts]
        get, make, chunks = known.index.get, known.make, list(chain.from_iterable(lists))
        at = np.array([i if (i := get(c)) is not None else make(c) for c in chunks], np.int64)
        known.settle()
        row = np.repeat(np.arange(len(texts)), [len(x) for x in lists])
        known.hits += np.bincount(at, minlength=len(known.hits))
        length = known.length[at]
        out = Segmented(np.bincount(row, known.score[at], len(texts)), np.cumsum(np.concatenate([[0], np.bincount(row, length, len(texts))])).astype(np.int64), known.flat[ragged(known.start[at], length)], [[] for _ in texts])
        if n == 1 or not len(at):
            return out
        # A text's n best differ from the best only in the n - 1 chunks that lose least by a change.
        loss, place = known.loss[at], np.cumsum(length) - length - out.ends[row]
        heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        apart: list[list[int]] = [[] for _ in texts]
        for _ in range(n - 1):
            least = np.repeat(np.minimum.reduceat(loss, heads), np.diff(np.append(heads, len(row))))
            hits = np.flatnonzero((loss == least) & (loss < np.inf))
            hits = hits[np.concatenate([[True], row[hits][1:] != row[hits][:-1]])] if len(hits) else hits
            for k in hits.tolist():
                apart[row[k]].append(k)
            loss[hits] = np.inf
        for r, chosen in enumerate(apart):
            mixes: list[tuple[float, list]] = [(0.0, [])]
            for k in chosen:
                i, p, size = at[k], int(place[k]), int(length[k])
                mixes = nsmallest(n, [*mixes, *[(x + known.score[i] - s, [*d, (p, p + size, other)]) for x, d in mixes for s, other in self.nbest(chunks[k], n)[1:]]], key=lambda m: m[0])
            out.others[r] = [(out.score[r] - x, d) for x, d in mixes[1:]]
        return out

    def encode(self, text: str, n: int = 1) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text: (score, ids), best first. An empty text has one, of no ids."""
        made = self.segment([text], n)
        return [(float(made.score[0]), made.ids.tolist()), *[(float(s), changed(made.ids, d).tolist()) for s, d in made.others[0]]]

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of segmentations, exactly: pieces' bytes joined, without the space put in front."""
        at, size = self.spans
        bounds = np.concatenate([[0], np.cumsum(size[ids])])[ends]
        data = self.joined[ragged(at[ids], size[ids])]
        lead = bounds[:-1][np.diff(bounds) > 0]
        bounds = bounds - np.searchsorted(lead, bounds)
        return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.delete(data, lead))).cast(pa.string())

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation, exactly: pieces' bytes joined, without the space put in front."""
        table = self.table
        return b"".join([table[i] for i in ids])[1:].decode()


def _lists(values: pa.Array, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)


def _others(made: Segmented, changes_only: bool) -> pa.Array:
    """The column of each text's next best segmentations."""
    rest = [(k, s, d) for k, more in enumerate(made.others) for s, d in more]
    scores = pa.array([float(s) for _, s, _ in rest], pa.float64())
    if changes_only:
        flat = [c for _, _, d in rest for c in sorted(d)]
        ids = _lists(pa.array(list(chain.from_iterable([c[2] for c in flat])), pa.int32()), [len(c[2]) for c in flat])
        spans = pa.StructArray.from_arrays([pa.array([c[0] for c in flat], pa.int32()), pa.array([c[1] for c in flat], pa.int32()), ids], ["start", "end", "ids"])
        body, name = _lists(spans, [len(d) for _, _, d in rest]), "changes"
    else:
        whole = [changed(made.ids[made.ends[k] : made.ends[k + 1]], d) for k, _, d in rest]
        body, name = _lists(pa.array(np.concatenate([np.zeros(0, np.int32), *whole])), [len(w) for w in whole]), "ids"
    return _lists(pa.StructArray.from_arrays([scores, body], ["score", name]), [len(m) for m in made.others])


def encode(docs: DataFrame, model_path: str, n: int = 2, changes_only: bool = False) -> DataFrame:
    """Every row of docs with ids array<int>, n_pieces, score, second_score, others and decoded.

    ids and score are the best segmentation's; ``others`` has the next ones up to the n-th, best
    first, as structs of score and ids, or with ``changes_only`` of score and where their ids
    differ from the best's: start, end and the ids instead. second_score is the first of these,
    null if there is none. Null text counts as empty: no ids, score 0. The model's scores rank segmentations as a
    unigram lattice, so ids differ from a library's that merges pairs; characters without a
    piece become bytes, so every text comes back exactly in ``decoded``. Columns of docs with
    these names are replaced, the others pass through.
    """
    pieces = Pieces.load(model_path)
    added = [("ids", "array<int>"), ("n_pieces", "bigint"), ("score", "double"), ("second_score", "double"), ("others", CHANGES if changes_only else OTHERS), ("decoded", "string")]
    own = docs.select(*[F.col(c) for c in docs.columns if c not in {a for a, _ in added}])
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in own.schema] + [f"{a} {t}" for a, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here is cyclic, and the remembered chunks are long to walk
        try:
            yield from encoded(batches)
        finally:
            gc.enable()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                made = pieces.segment([t or "" for t in batch.column("text").to_pylist()], n)
                columns = [
                    pa.ListArray.from_arrays(pa.array(made.ends, pa.int32()), pa.array(made.ids)),
                    pa.array(np.diff(made.ends), pa.int64()),
                    pa.array(made.score),
                    pa.array([m[0][0] if m else None for m in made.others], pa.float64()),
                    _others(made, changes_only),
                    pieces.texts(made.ids, made.ends),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *[a for a, _ in added]])

    return own.mapInArrow(run, schema)
