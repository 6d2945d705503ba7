"""A quality classifier by co-training: a view of the text and a view of the metadata teach each other.

Features of all documents are made once and checkpointed. In each round both views' models score
every document without a label, and the surest of each class, told apart by rank, go with their
calibrated confidence to the other view's training set. Only the bounded sample of labelled rows and
these few rows a round come to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.llm.common import byte_buffer, checkpointed, lower_bytes, word_hashes, word_spans

#: Rows with labels that fitting sees at most: the bounded sample. All rows are scored, and all without a label may become pseudo-labels.
LABELLED = 6000
WORDS, META = 1 << 16, 1 << 10
#: Rounds of exchange, and pseudo-labels that a view gives in each, dealt to the classes by their share.
ROUNDS, TAKEN = 3, 300
#: Weight of a pseudo-label of full confidence, next to a label's.
TRUST = 0.5
#: A word or metadata value takes part if its share of positives is so many standard errors from the expected one.
SURPRISE = 4.0
_SHAPES = 9


def text_view(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words of each text, once each, as CSR (starts, indices), and its shape: lengths and shares of kinds of bytes and words."""
    raw, at = byte_buffer(column)
    starts, ends, counts = word_spans(raw, at)
    row = np.repeat(np.arange(len(counts)), counts)
    hashes = word_hashes(lower_bytes(raw), starts, ends)
    keys = np.unique(row * WORDS + (hashes >> np.uint64(48)).astype(np.int64))
    first = np.searchsorted(keys, np.arange(len(counts) + 1) * WORDS)
    kind = np.zeros(256, np.int64)
    kind[[ord(c) for c in "#*$%&|<>"]] = 1
    kind[65:91], kind[48:58], kind[ord("!")], kind[10] = 2, 3, 4, 5
    of = kind[raw]
    per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    size, words = np.maximum(1, np.diff(at)), np.maximum(1, counts)
    distinct = np.diff(np.searchsorted(np.unique(row * (1 << 40) + (hashes >> np.uint64(24)).astype(np.int64)), np.arange(len(counts) + 1) * (1 << 40)))
    shape = np.stack([np.log1p(counts), size / words / 10, per(of == 1) / words, per(of == 2) / size, per(of == 3) / size, per(of == 4) / words, np.log1p(per(of == 5)), distinct / words, (counts == 0) * 1.0], axis=1)
    return first, (keys % WORDS).astype(np.int32), shape


def meta_view(frame: pd.DataFrame) -> np.ndarray:
    """One hashed index a metadata column; numbers count by their power of two."""
    out = []
    for k, c in enumerate(frame.columns):
        values = frame[c]
        if pd.api.types.is_numeric_dtype(values):
            values = np.floor(np.log2(values.astype(float).fillna(0).abs() + 1)).astype(int)
        codes, names = pd.factorize(values, use_na_sentinel=False)
        hashed = np.array([hash_text(f"{c}={v}") for v in names], np.int64) % META if len(names) else np.zeros(0, np.int64)
        out.append(hashed[codes] if len(names) else np.zeros(len(frame), np.int64))
    return np.stack(out, axis=1) if out else np.zeros((len(frame), 0), np.int64)


def hash_text(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "replace"))


@dataclass
class Linear:
    """A logistic model of sparse binary and dense features."""

    sparse: np.ndarray
    dense: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float

    def logits(self, first: np.ndarray, index: np.ndarray, shape: np.ndarray) -> np.ndarray:
        sums = np.diff(np.concatenate([[0.0], np.cumsum(self.sparse[index])])[first])
        return sums + np.clip((shape - self.mean) / self.scale, -8, 8) @ self.dense + self.bias


def fit(first, index, shape, y: np.ndarray, weight: np.ndarray, width: int, steps: int = 150) -> Linear:
    """Full-batch Adam on the weighted logistic loss with a small L2 term, over the sparse features that tell the labels apart."""
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    mean, scale = (shape.mean(axis=0), shape.std(axis=0) + 1e-6) if len(shape) else (np.zeros(shape.shape[1]), np.ones(shape.shape[1]))
    dense_x = np.clip((shape - mean) / scale, -8, 8)
    base = float(np.average(y, weights=weight)) if len(y) else 0.5
    base = min(max(base, 1e-3), 1 - 1e-3)
    seen, positive = np.bincount(index, weight[row], width), np.bincount(index, (weight * y)[row], width)
    telling = np.abs(positive - base * seen) > SURPRISE * np.sqrt(seen * base * (1 - base) + 0.5)
    chosen = telling[index]
    row, index = row[chosen], index[chosen]
    first = np.concatenate([[0], np.cumsum(chosen)])[first]
    w = np.concatenate([np.zeros(width + shape.shape[1]), [np.log(base / (1 - base))]])
    m, v, total = np.zeros_like(w), np.zeros_like(w), max(1e-9, weight.sum())
    for t in range(1, steps + 1):
        z = np.diff(np.concatenate([[0.0], np.cumsum(w[index])])[first]) + dense_x @ w[width:-1] + w[-1]
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
        g = np.concatenate([np.bincount(index, e[row], width), e @ dense_x, [e.sum()]]) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.15 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Linear(w[:width], w[width:-1], mean, scale, float(w[-1]))


@dataclass
class Rows:
    """Features of some rows: hashed words as CSR (first, index), shape, and a metadata index for each column."""

    first: np.ndarray
    index: np.ndarray
    shape: np.ndarray
    meta: np.ndarray

    def __len__(self) -> int:
        return len(self.meta)

    def take(self, rows: np.ndarray) -> Rows:
        n = np.diff(self.first)[rows]
        at = np.concatenate([[0], np.cumsum(n)])
        pick = np.repeat(self.first[:-1][rows] - at[:-1], n) + np.arange(at[-1])
        return Rows(at, self.index[pick], self.shape[rows], self.meta[rows])

    def plus(self, other: Rows) -> Rows:
        return Rows(np.concatenate([self.first, other.first[1:] + self.first[-1]]), np.concatenate([self.index, other.index]), np.concatenate([self.shape, other.shape]), np.concatenate([self.meta, other.meta]))

    def view(self, name: str):
        if name == "text":
            return self.first, self.index, self.shape
        return np.arange(len(self) + 1) * self.meta.shape[1], self.meta.ravel(), np.zeros((len(self), 0))

    @classmethod
    def read(cls, batch: pa.RecordBatch, columns: int) -> Rows:
        words = [np.frombuffer(b, np.uint16) for b in batch.column("words").to_pylist()]
        dense = lambda c, kind, width: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(batch.num_rows, width)
        return cls(np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64), np.concatenate([*words, np.zeros(0, np.uint16)]).astype(np.int32), dense("shape", np.float32, _SHAPES).astype(float), dense("meta", np.uint16, columns).astype(np.int32))


VIEWS = {"text": WORDS, "meta": META}


def _none(n: int):
    return np.zeros(n + 1, np.int64), np.zeros(0, np.int32)


@dataclass
class CoTrained:
    """Both views' models, each one's calibration, and the one that joins the calibrated logits."""

    models: dict[str, Linear]
    scales: dict[str, Linear]
    joined: Linear | None = None

    def logits(self, name: str, rows: Rows) -> np.ndarray:
        """A view's calibrated logits."""
        return self.scales[name].logits(*_none(len(rows)), self.models[name].logits(*rows.view(name))[:, None])

    def parts(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.logits("text", rows), self.logits("meta", rows)
        return a, b, self.joined.logits(*_none(len(rows)), np.stack([a, b], axis=1))


def _share(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Teaching:
    """The training sets of both views of one target; every fourth labelled row is kept for calibration."""

    def __init__(self, rows: Rows, y: np.ndarray):
        keep = np.arange(len(y)) % 4 != 0 if len(y) > 3 else np.ones(len(y), bool)
        self.held = (rows, y) if keep.all() else (rows.take(np.flatnonzero(~keep)), y[~keep])
        train = rows.take(np.flatnonzero(keep))
        self.sets = {k: (train, y[keep], np.ones(int(keep.sum()))) for k in VIEWS}
        self.base = float(np.mean(y)) if len(y) else 0.5

    def wanted(self, taken: int) -> tuple[int, int]:
        """How many rows of class 0 and of class 1 a view gives in a round."""
        ones = min(max(1, round(taken * self.base)), taken - 1) if 0 < self.base < 1 else round(taken * self.base)
        return taken - ones, ones

    def fitted(self) -> CoTrained:
        models, scales = {}, {}
        rows, y = self.held
        for k, width in VIEWS.items():
            own, labels, weights = self.sets[k]
            models[k] = fit(*own.view(k), labels, weights, width)
            scales[k] = fit(*_none(len(y)), models[k].logits(*rows.view(k))[:, None], y, np.ones(len(y)), 0, 300)
        made = CoTrained(models, scales)
        made.joined = fit(*_none(len(y)), np.stack([made.logits(k, rows) for k in VIEWS], axis=1), y, np.ones(len(y)), 0, 300)
        return made

    def learn(self, view: str, rows: Rows, label: int, sure: np.ndarray) -> None:
        """Rows for a view's training set, given by the other one; they weigh by how far their confidence is over the class' share."""
        own, labels, weights = self.sets[view]
        share = self.base if label else 1 - self.base
        trust = TRUST * np.clip((sure - share) / max(1e-9, 1 - share), 0, 1)
        self.sets[view] = own.plus(rows), np.concatenate([labels, np.full(len(rows), label)]), np.concatenate([weights, trust])


def _features(batch: pa.RecordBatch, meta: list[str]) -> list[pa.Array]:
    first, index, shape = text_view(batch.column("text"))
    m = meta_view(batch.select(meta).to_pandas()) if meta else np.zeros((batch.num_rows, 0), np.int64)
    index = index.astype(np.uint16)
    words = [index[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
    return [pa.array(words, pa.binary()), *[pa.array([r.tobytes() for r in x], pa.binary()) for x in (shape.astype(np.float32), m.astype(np.uint16))]]


def classify(
    docs: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("quality", "toxic"), meta: tuple[str, ...] = ("lang", "source", "n_chars"), labelled: int = LABELLED, rounds: int = ROUNDS, taken: int = TAKEN, history: list | None = None
) -> DataFrame:
    """(doc_id, then for each target <target>_score, <target>_text, <target>_meta and <target>) for every row of docs.

    ``labels`` holds doc_id and 0/1 targets. Fitting sees at most ``labelled`` rows with labels,
    those of the smallest id hashes, one row for an id; everything is scored. In each of
    ``rounds`` rounds each view gives the other its ``taken`` surest rows among all without that
    label, in the classes' shares; rows of equal text count once, and none is given twice.
    A score is the joined probability, <target> whether it is at least a half; _text and _meta are
    the views' own, calibrated. Null targets are no labels; several labels of a doc_id are
    averaged and rounded; a null doc_id has none. Null and empty texts count as texts without words.
    Without labels every score is a half; with one kind only, near it. Other columns of docs and
    of labels are left out, whatever their names. ``history`` gets (round, target, view, ids given).
    """
    meta = [c for c in meta if c in docs.columns]
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.round(F.avg(t)).alias(t) for t in targets])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *_features(batch, meta)], ["doc_id", "key", "words", "shape", "meta"])

    made = docs.select("doc_id", F.xxhash64("text").alias("key"), "text", *meta).mapInArrow(features, "doc_id long, key long, words binary, shape binary, meta binary")
    # A null id finds no label; its rows are dealt by their text.
    made = made.select("*", F.coalesce("doc_id", "key").alias("by"), F.col("doc_id").isNull().alias("lone"))
    told = known.select(F.col("doc_id").alias("by"), F.lit(False).alias("lone"), *[F.col(t).alias(f"label_{k}") for k, t in enumerate(targets)])
    rows = checkpointed(made.join(told, ["by", "lone"], "left").drop("by", "lone"))
    some = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)  # at most so many rows
    names = ["key", "words", "shape", "meta", *[f"label_{k}" for k in range(len(targets))]]
    sample = rows.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min(F.struct(*names)).alias("s")).select("doc_id", "s.*")
    got = sample.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow().combine_chunks()
    batch = got.to_batches()[0] if len(got) else None
    teaching = {}
    for k, t in enumerate(targets):
        y = got.column(f"label_{k}").to_numpy().astype(float) if batch is not None else np.zeros(0)
        if (has := np.flatnonzero(~np.isnan(y))).size:
            teaching[t] = Teaching(Rows.read(batch, len(meta)).take(has), y[has])
    given: dict[tuple, set[int]] = {(t, v): set() for t in teaching for v in VIEWS}

    # Equally sure rows are taken from opposite ends, so that no row is sure to be of both classes.
    def turned(key, label: int):
        return -key - 1 if label else key

    def ranked(held: dict[int, tuple], label: int) -> list[tuple]:
        return sorted(held.values(), key=lambda r: (-r[0], turned(r[1], label)))

    def surest(models: dict[str, CoTrained], before: dict, want: dict):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The surest rows of each target, view and class in a partition, each text once."""
            best: dict[tuple, dict[int, tuple]] = {}
            for batch in batches:
                x, keys = Rows.read(batch, len(meta)), np.asarray(batch.column("key"))
                for k, t in enumerate(targets):
                    free = np.flatnonzero(np.isnan(np.asarray(batch.column(f"label_{k}").to_numpy(zero_copy_only=False), float)))
                    for v in VIEWS if t in models else ():
                        p = _share(models[t].logits(v, x))
                        mine = free[~np.isin(keys[free], list(before[t, v]))]
                        for label in (0, 1):
                            sure, n = p if label else 1 - p, want[t][label]
                            held = best.setdefault((k, v, label), {})
                            order = mine[np.lexsort((turned(keys[mine], label), -sure[mine]))]
                            for i in order[np.sort(np.unique(keys[order], return_index=True)[1])][:n].tolist():
                                row = (float(sure[i]), int(keys[i]), *[batch.column(c)[i].as_py() for c in ("words", "shape", "meta")])
                                if row[1] not in held or held[row[1]][0] < row[0]:
                                    held[row[1]] = row
                            if len(held) > 4 * n:
                                best[k, v, label] = {r[1]: r for r in ranked(held, label)[:n]}
            out = [(k, v, label, *r) for (k, v, label), held in best.items() for r in ranked(held, label)[: want[targets[k]][label]]]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["target", "view", "label", "sure", "key", "words", "shape", "meta"])

        return run

    for turn in range(rounds if teaching else 0):
        models = {t: x.fitted() for t, x in teaching.items()}
        want = {t: x.wanted(taken) for t, x in teaching.items()}
        found = rows.mapInArrow(surest(models, given, want), "target int, view string, label int, sure double, key long, words binary, shape binary, meta binary")
        slot = ["target", "view", "label"]
        once = found.groupBy(*slot, "key").agg(F.max(F.struct("sure", "words", "shape", "meta")).alias("r")).select(*slot, "key", "r.*")
        once = checkpointed(once)
        for k, t in enumerate(targets):
            for v, other in (("text", "meta"), ("meta", "text")) if t in teaching else ():
                for label in (0, 1):
                    if not want[t][label]:
                        continue
                    top = once.where((F.col("target") == k) & (F.col("view") == v) & (F.col("label") == label)).orderBy(F.col("sure").desc(), F.col("key").desc() if label else F.col("key")).limit(want[t][label]).toArrow().combine_chunks()
                    top = top.filter(pc.invert(pc.is_in(top.column("key"), pa.array(list(given[t, v]), pa.int64()))))
                    if len(top):
                        batch = top.combine_chunks().to_batches()[0]
                        teaching[t].learn(other, Rows.read(batch, len(meta)), label, np.asarray(batch.column("sure")))
                        given[t, v] |= set(batch.column("key").to_pylist())
                        if history is not None:
                            history.append((turn, t, v, batch.column("key").to_pylist()))
    models = {t: x.fitted() for t, x in teaching.items()}

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, columns = Rows.read(batch, len(meta)), [batch.column("doc_id")]
            for t in targets:
                a, b, p = (_share(z) for z in (models[t].parts(x) if t in models else [np.zeros(batch.num_rows)] * 3))
                columns += [pa.array(p), pa.array(a), pa.array(b), pa.array(p >= 0.5)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[c for t in targets for c in (f"{t}_score", f"{t}_text", f"{t}_meta", t)]])

    ddl = "doc_id long" + "".join(f", `{t}_score` double, `{t}_text` double, `{t}_meta` double, `{t}` boolean" for t in targets)
    return rows.select("doc_id", "words", "shape", "meta").mapInArrow(scores, ddl)
