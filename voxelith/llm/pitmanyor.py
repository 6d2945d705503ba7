"""LM scoring by a hierarchical Pitman-Yor bigram model whose seating is sampled by Gibbs.

Every word is the context of one restaurant; all restaurants share one parent, whose customers
are their tables and whose base is uniform over the vocabulary and one unknown word. Nothing is
held for the whole vocabulary in one place: blocks of documents, and buckets that own words and
contexts, exchange packed runs. In each round contexts draw their tables given the parent's
probabilities, and the parent draws its own given these.

A restaurant's dishes depend on each other through its number of tables T alone. Given an
auxiliary x ~ Gamma(strength / discount + T) they are independent: a dish with c customers has t
tables with a probability in proportion to S(c, t) (discount * x * H)^t, where S are generalised
Stirling numbers and H is the dish's probability in the parent. So a round draws every x, every
t and every H from its own conditional: a Gibbs sampler that needs sums only, and whose draws
depend on the words and the round, not on where or in which order they are made.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.llm.blocks import bucket_bounds, layout, pack_keys, unpack_keys
from voxelith.llm.common import byte_buffer, lower_bytes, mix, pack, unpack, word_hashes, word_spans

#: Discount and strength of the contexts' restaurants and of their parent's.
DISCOUNT, STRENGTH, ROOT_DISCOUNT, ROOT_STRENGTH = 0.8, 1.0, 0.7, 1.0
#: Rounds of Gibbs sampling, and seatings of the last round whose predictive probabilities are averaged.
ROUNDS, SAMPLES = 4, 2
#: Customers up to which Stirling numbers are tabled; beyond, they follow by their scaling limit (see Stirling.weights).
TABLED = 1024
#: Bytes of text that a worker splits into words at once, but for a longer text.
SLICE = 4 << 20
END = np.uint64(0x656E64)  # the hash of the token that ends a text
_BOS = 1  # the number of the context that starts a text; words' numbers are larger
_BOS_KEY = 0x626F73


# --- draws by key: equal keys give equal draws wherever they are made ------------------------


def uniform(key: np.ndarray, *salt: int) -> np.ndarray:
    """Uniform variates in (0, 1) of 64-bit keys."""
    x = key
    for s in salt:
        x = mix(x ^ np.uint64((s + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gamma(shape: np.ndarray, key: np.ndarray, *salt: int) -> np.ndarray:
    """Gamma variates by squeezed normals; a shape under 1 goes by the next one up and a power."""
    small = shape < 1
    d = np.where(small, shape + 1, shape) - 1 / 3
    c, out, left = 1 / np.sqrt(9 * d), np.zeros(len(shape)), np.arange(len(shape))
    turn = 0
    while len(left):
        k = key[left]
        z = np.sqrt(-2 * np.log(uniform(k, *salt, turn, 0))) * np.cos(2 * math.pi * uniform(k, *salt, turn, 1))
        v = np.maximum(1 + c[left] * z, 0) ** 3
        ok = np.log(uniform(k, *salt, turn, 2)) < 0.5 * z * z + d[left] * (1 - v + np.log(np.maximum(v, 1e-300)))
        ok &= v > 0
        out[left[ok]] = (d[left] * v)[ok]
        left, turn = left[~ok], turn + 1
    return np.where(small, out * uniform(key, *salt, 99) ** (1 / np.maximum(shape, 1e-9)), out)


class Stirling:
    """Generalised Stirling numbers of one discount, and draws of the tables of dishes."""

    def __init__(self, discount: float, size: int = TABLED):
        self.discount, self.size = discount, size
        t = np.arange(size + 1.0)
        self.log = np.full((size + 1, size + 1), -np.inf)
        self.log[1, 1] = 0.0
        with np.errstate(divide="ignore"):
            for c in range(1, size):
                old = np.log(np.maximum(c - discount * t[1 : c + 2], 0)) + self.log[c, 1 : c + 2]
                self.log[c + 1, 1 : c + 2] = np.logaddexp(self.log[c, : c + 1], old)
        # The chance that t Sibuya variates add up to ``size``, over t: flat where t is small, so that it can be read between its points.
        t = t[1:]
        chance = self.log[size, 1:] + np.cumsum(np.log(t)) + t * math.log(discount) - np.log(t)
        self.at, self.chance = np.concatenate([[0.0], t]), np.concatenate([[2 * chance[0] - chance[1]], chance])

    def weights(self, c: int, rate: float) -> np.ndarray:
        """Logarithms, up to a constant, of the chances of 1, 2, ... tables of a dish with many customers.

        With y = discount * rate, S(c, t) y^t is Poisson(rate) at t times the chance that t Sibuya
        variates add up to c. That one depends on t / c^discount alone for large c, and is read
        off from the largest c in the table.
        """
        most = int(min(c, rate + 12 * math.sqrt(rate + 1) + 40))
        t = np.arange(1.0, most + 1)
        return t * math.log(rate) - np.cumsum(np.log(t)) + np.log(t) + np.interp(t * (self.size / c) ** self.discount, self.at, self.chance, right=-1e300)

    def draw(self, c: np.ndarray, rate: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Tables of dishes with c customers at rate x * H, by inversion of the exact conditional."""
        out = np.ones(len(c), np.int64)
        low = 2
        while low <= min(self.size, int(c.max(initial=0))):
            width = min(2 * low - 1, self.size)
            some = np.flatnonzero((c >= low) & (c <= width))
            step = max(1, (1 << 20) // width)
            for a in range(0, len(some), step):
                i = some[a : a + step]
                w = self.log[c[i], 1 : width + 1] + np.arange(1.0, width + 1) * np.log(self.discount * rate[i])[:, None]
                w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
                out[i] = 1 + (w < (u[i] * w[:, -1])[:, None]).sum(axis=1)
            low = width + 1
        for i in np.flatnonzero(c > self.size):
            w = self.weights(int(c[i]), float(rate[i]))
            w = np.cumsum(np.exp(w - w.max()))
            out[i] = 1 + int(np.searchsorted(w, u[i] * w[-1]))
        return np.minimum(out, np.maximum(c, 1))


@cache
def stirling(discount: float) -> Stirling:
    return Stirling(discount)


def seat(counts: np.ndarray, base: np.ndarray, context: np.ndarray, discount: float, strength: float, seed: int, rounds: int) -> Iterator[np.ndarray]:
    """Tables of each (context, dish), round by round, with the parent held at ``base``: the sampler without its exchange."""
    tables, key = np.ones(len(counts), np.int64), mix(np.arange(1, len(counts) + 1, dtype=np.uint64) + np.uint64(seed << 32))
    own = mix(np.arange(context.max(initial=0) + 1, dtype=np.uint64) + np.uint64((seed << 32) + (1 << 31)))
    for r in range(rounds):
        x = gamma(strength / discount + np.bincount(context, tables, len(own)), own, r)
        tables = stirling(discount).draw(counts, x[context] * base, uniform(key, r))
        yield tables


# --- blocks of documents ---------------------------------------------------------------------


def is_training(doc_id) -> bool:
    """Documents whose crc32 of the id as text leaves 2 on division by 7 are held out; a null id counts as no text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


_ROW = pa.schema([("to", pa.int64()), ("kind", pa.int32()), ("sender", pa.int64()), ("ids", pa.list_(pa.int64())), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])
_ROW_DDL = "to long, kind int, sender long, ids array<long>, a binary, b binary, c binary, x double, y double, z double"
_TEXT, _TOKENS, _WORDS, _COUNTS, _LEXICON, _PAIRS, _STATE, _FIRST, _UP, _DOWN, _SEATS, _ROOT = range(12)


def _rows(rows: list[tuple]) -> pa.Table:
    """Rows (to, kind, sender, a, b, c, x, y, z); trailing values may be left out."""
    full = [(*r[:3], None, *r[3:], *(b"", b"", b"", 0.0, 0.0, 0.0)[len(r) - 3 :]) if len(r) < len(_ROW) else r for r in rows]
    return pa.table([pa.array([r[k] for r in full], f.type) for k, f in enumerate(_ROW)], schema=_ROW)


def _of(table: pa.Table, kind: int) -> list[dict]:
    """The rows of a kind, by sender."""
    return sorted(table.filter(pc.equal(table["kind"], kind)).to_pylist(), key=lambda r: (r["sender"], r["a"]))


def _bucket(k: int) -> int:
    """A bucket's address; blocks have their numbers."""
    return -1 - k


def bundle(*arrays: np.ndarray) -> bytes:
    parts = [pack(a) for a in arrays]
    return b"".join([len(p).to_bytes(8, "little") + p for p in parts])


def unbundle(b: bytes, *types) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        n = int.from_bytes(b[at : at + 8], "little")
        out.append(unpack(b[at + 8 : at + 8 + n], t))
        at += 8 + n
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts gathered by block: ids, lengths in bytes, and their bytes in lower case, compressed."""
    compress = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        blocks = np.asarray(batch.column("block"))
        order = np.argsort(blocks, kind="stable")
        heads = np.flatnonzero(np.append(True, blocks[order][1:] != blocks[order][:-1])) if len(order) else order
        rows = []
        for own in np.split(order, heads[1:]) if len(order) else []:
            part = batch.take(pa.array(own))
            raw, at = byte_buffer(part.column("text"))
            rows.append((int(blocks[own[0]]), _TEXT, 0, part.column("doc_id").to_pylist(), bundle(np.diff(at)), compress(lower_bytes(raw).tobytes()), b"", 0.0, 0.0, 0.0))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ROW)], schema=_ROW)


def _tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts, an end after each text, and how many each has; SLICE bytes at once."""
    cuts, tokens, lengths = [0], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    while cuts[-1] < len(at) - 1:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(at, at[cuts[-1]] + SLICE, "right")) - 1))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        part = raw[at[i] : at[j]]
        starts, ends, counts = word_spans(part, at[i : j + 1] - at[i])
        made = np.full(len(starts) + len(counts), END, np.uint64)
        inner = np.ones(len(made), bool)
        inner[np.cumsum(counts + 1) - 1] = False
        made[inner] = word_hashes(part, starts, ends)
        tokens.append(made)
        lengths.append(counts + 1)
    return np.concatenate(tokens), np.concatenate(lengths)


def _read(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """A block's texts as ids, tokens of each text, distinct hashes in order, and each token's place among them."""
    expand = zstandard.ZstdDecompressor().decompress
    ids, sizes, data = [], [], []
    for r in _of(table, _TEXT):
        ids += r["ids"]
        sizes.append(unbundle(r["a"], np.int64)[0])
        data.append(expand(r["b"]))
    tokens, lengths = _tokens(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]))
    keys, place = np.unique(tokens, return_inverse=True)
    return ids, lengths, keys, place.astype(np.int32)


class _Block:
    """The tokens of one block, words numbered in order of their hashes; ``end`` is the number of the end of texts."""

    def __init__(self, number: int, ids: list, lengths: np.ndarray, words: int, place: np.ndarray, end: int):
        self.number, self.ids, self.lengths, self.words, self.place, self.end = number, pa.array(ids, pa.int64()), lengths, words, place, end
        self.train = np.array([is_training(i) for i in ids], bool)
        self.training = np.repeat(self.train, lengths)
        self.counts = np.bincount(place, self.training, words).astype(np.int64)
        self.first = np.cumsum(lengths) - lengths

    @classmethod
    def of(cls, table: pa.Table) -> _Block:
        row = _of(table, _TOKENS)[0]
        return cls(row["to"], row["ids"], *unbundle(row["a"], np.int64), int(row["x"]), *unbundle(row["c"], np.int32), int(row["y"]))

    def told(self, table: pa.Table, bits: int):
        """Counts and numbers of the block's words, and the training tokens and words of all. Every bucket answers in order of hashes, and buckets are ranges of these."""
        rows = _of(table, _COUNTS)
        made = [unbundle(r["a"], np.int64, np.int64) for r in rows]
        counts = np.concatenate([c for c, _ in made])
        numbers = np.concatenate([(rank << bits) + r["sender"] + _BOS + 1 for r, (_, rank) in zip(rows, made, strict=True)])
        return counts, numbers, int(sum(r["x"] for r in rows)), int(sum(r["y"] for r in rows))

    def before(self, of_words: np.ndarray, start) -> np.ndarray:
        """Each token's context's value, given the words' values and that of the start of a text."""
        out = np.empty(len(self.place), of_words.dtype)
        out[1:] = of_words[self.place[:-1]]
        out[self.first] = start
        return out

    def pairs(self, counts: np.ndarray, numbers: np.ndarray, total: int, bits: int):
        """Distinct (bucket, context, word, training count) of known tokens in known contexts, by bucket; each token's place there, or -1; tokens' contexts' counts.

        A context that would be more than a bucket's share is dealt to several buckets by word.
        """
        words = self.words
        known = np.flatnonzero((counts[self.place] > 0) & ((trained := self.before(counts, int(counts[self.end]))) > 0))
        local = self.before(np.arange(words), words)[known] * words + self.place[known]
        distinct, at = np.unique(local, return_inverse=True)
        context, word = distinct // words, distinct % words
        u, w = np.append(numbers, _BOS)[context], numbers[word]
        spread = np.maximum(1, -(-np.append(counts, trained[self.first[:1]])[context] * (1 << bits) // max(1, total)))
        home = (mix(u.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
        part = (mix(w.astype(np.uint64) * np.uint64(3)) % spread.astype(np.uint64)).astype(np.int64)
        bucket = (home + part) % (1 << bits)
        order = np.lexsort((u, bucket))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = np.full(len(self.place), -1, np.int64)
        place[known] = rank[at]
        own = np.bincount(at, self.training[known], len(distinct)).astype(np.int64)
        return (bucket[order], u[order], w[order], own[order]), place, trained


class _Pairs:
    """The (context, dish) pairs of a bucket, from its blocks' runs."""

    def __init__(self, table: pa.Table):
        self.senders, us, ws, cs = [], [], [], []
        for r in _of(table, _PAIRS):
            contexts, each, w, own = unbundle(r["a"], *[np.int64] * 4)
            self.senders.append(r["sender"])
            us.append(np.repeat(contexts, each))
            ws.append(w)
            cs.append(own)
        empty = [np.zeros(0, np.int64)]
        self.contexts, u = np.unique(np.concatenate(us + empty), return_inverse=True)
        self.dishes, w = np.unique(np.concatenate(ws + empty), return_inverse=True)
        width = max(1, len(self.dishes))
        pair, self.place = np.unique(u * width + w, return_inverse=True)
        self.ends = np.cumsum([len(x) for x in ws])[:-1] if ws else []
        c = np.bincount(self.place, np.concatenate(cs + empty), len(pair)).astype(np.int64)
        self.n, self.all = len(pair), c
        self.of_context, self.of_dish = pair // width, pair % width

    def again(self) -> tuple[_Again, np.ndarray]:
        """The pairs of two customers and more, and where they are: only these can sit otherwise than at one table."""
        at = np.flatnonzero(self.all > 1)
        (contexts, u), (dishes, w) = (np.unique(x[at], return_inverse=True) for x in (self.of_context, self.of_dish))
        return _Again(self.contexts[contexts], self.dishes[dishes], u, w, self.all[at]), at


def _dealt(ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order of the bucket that owns them, and where each bucket's begin."""
    home = (ids - _BOS - 1) % buckets
    order = np.argsort(home, kind="stable")
    return order, np.searchsorted(home[order], np.arange(buckets + 1))


class _Again:
    """Pairs of two customers and more; as a row they travel from round to round."""

    def __init__(self, contexts: np.ndarray, dishes: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray):
        self.contexts, self.dishes, self.u, self.w, self.c = contexts, dishes, u, w, c

    def packed(self) -> bytes:
        return bundle(self.contexts, self.dishes, self.u.astype(np.int32), self.w.astype(np.int32), self.c)

    @classmethod
    def of(cls, packed: bytes) -> _Again:
        return cls(*unbundle(packed, np.int64, np.int64, np.int32, np.int32, np.int64))


def _ups(kind: int, number: int, buckets: int, contexts: np.ndarray, dishes: np.ndarray, sums: list[tuple[np.ndarray, np.ndarray]], root_tables: float, vocabulary: float) -> list[tuple]:
    """A bucket's reports to all buckets of words: the tables of their dishes and contexts in each seating."""
    (by_dish, at), (by_context, ct) = _dealt(dishes, buckets), _dealt(contexts, buckets)
    rows = []
    for k in range(buckets):
        i, j = by_dish[at[k] : at[k + 1]], by_context[ct[k] : ct[k + 1]]
        rows.append((_bucket(k), kind, number, bundle(dishes[i], *[s[0][i] for s in sums]), bundle(contexts[j], *[s[1][j] for s in sums]), b"", root_tables, vocabulary))
    return rows


def _more(p: _Again, seatings: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each seating the tables beyond the first of every pair, by dish and by context."""
    return [(np.bincount(p.w, t - 1, len(p.dishes)).astype(np.int64), np.bincount(p.u, t - 1, len(p.contexts)).astype(np.int64)) for t in seatings]


def _rates(pairs: _Again, table: pa.Table, buckets: int, samples: int) -> tuple[list[np.ndarray], np.ndarray, float, float]:
    """From the parent's answers: x * H of each pair for each seating to come, the pairs' keys, the parent's tables and the vocabulary."""
    (dishes, at), (contexts, ct) = _dealt(pairs.dishes, buckets), _dealt(pairs.contexts, buckets)
    h, x = np.zeros(len(pairs.dishes)), np.zeros((samples, len(pairs.contexts)))
    dish_key, context_key = np.zeros(len(h), np.uint64), np.zeros(len(pairs.contexts), np.uint64)
    customers = tables = vocabulary = 0.0
    for r in _of(table, _DOWN):
        k = r["sender"]
        i, j = dishes[at[k] : at[k + 1]], contexts[ct[k] : ct[k + 1]]
        h[i], dish_key[i] = unbundle(r["a"], np.float32, np.uint32)
        context_key[j], *own = unbundle(r["b"], np.uint32, *[np.float32] * samples)
        for m in range(samples):
            x[m, j] = own[m]
        customers, tables, vocabulary = customers + r["x"], tables + r["y"], r["z"]
    h = (h + (ROOT_STRENGTH + ROOT_DISCOUNT * tables) / (vocabulary + 1)) / (ROOT_STRENGTH + customers)
    key = (context_key << np.uint64(32))[pairs.u] | dish_key[pairs.w]
    return [x[m][pairs.u] * h[pairs.w] for m in range(samples)], key, tables, vocabulary


def score(docs: DataFrame, discount: float = DISCOUNT, strength: float = STRENGTH, rounds: int = ROUNDS, samples: int = SAMPLES, seed: int = 7) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row of docs.

    A text's tokens are its words, A-Z in lower case, then one end; null counts as empty, so
    every row has a token. The model learns from all rows but the held-out ones. base_score
    adds log10((c + 1) / (N + V + 1)) over tokens; score adds the logarithms of predictive
    probabilities, averaged over the last ``samples`` seatings, which over the vocabulary and one
    unknown word add up to 1. With no training rows both are uniform over the unknown word.
    Draws depend on words, round and seed alone: neither blocks and buckets nor a task that runs
    again change a score. Words are told apart by 64-bit hashes. Other columns of docs are left out.
    """
    placed, n, bits = layout(docs.select("doc_id", "text"))
    buckets = 1 << bits

    def words(table: pa.Table) -> pa.Table:
        """A block's tokens, to itself, and its words, to their buckets."""
        ids, lengths, keys, place = _read(table)
        block = _Block(table["to"][0].as_py(), ids, lengths, len(keys), place, int(np.searchsorted(keys, END)))
        at = bucket_bounds(keys, bits)
        own = (block.number, _TOKENS, block.number, ids, bundle(lengths), b"", bundle(place), float(block.words), float(block.end), 0.0)
        return _rows([own, *[(_bucket(b), _WORDS, block.number, pack_keys(keys[x:y]), bundle(block.counts[x:y])) for b, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True))]])

    def merged(table: pa.Table):
        """A bucket's distinct words, each block's places in them, and their total counts."""
        runs = _of(table, _WORDS)
        each = [unpack_keys(r["a"]) for r in runs]
        keys, place = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(place, np.concatenate([unbundle(r["b"], np.int64)[0] for r in runs]), len(keys)).astype(np.int64)
        return keys, [(r["sender"], p) for r, p in zip(runs, np.split(place, np.cumsum([len(x) for x in each])[:-1]), strict=True)], total, np.lexsort((keys, -total))

    def count(table: pa.Table) -> pa.Table:
        """Each block's counts, and its words' numbers by frequency; the words in that order stay."""
        b = -1 - table["to"][0].as_py()
        keys, runs, total, order = merged(table)
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        tokens, known = float(total.sum()), float(np.count_nonzero(total))
        return _rows([(_bucket(b), _LEXICON, b, bundle(keys[order])), *[(k, _COUNTS, b, bundle(total[p], rank[p]), b"", b"", tokens, known) for k, p in runs]])

    def ask(table: pa.Table) -> pa.Table:
        block = _Block.of(table)
        counts, numbers, total, known = block.told(table, bits)
        (bucket, u, w, own), _, _ = block.pairs(counts, numbers, total, bits)
        at, rows = np.searchsorted(bucket, np.arange(buckets + 1)), []
        for b in range(buckets):
            i = slice(at[b], at[b + 1])
            if i.stop > i.start:
                contexts, each = np.unique(u[i], return_counts=True)
                rows.append((_bucket(b), _PAIRS, block.number, bundle(contexts, each, w[i], own[i]), b"", b"", 0.0, known))
        return _rows(rows)

    def begin(table: pa.Table) -> pa.Table:
        """A bucket's pairs from all blocks, and the first seating: each dish of a context at one table, the parent's tables as many as words."""
        b, p = -1 - table["to"][0].as_py(), _Pairs(table)
        vocabulary, some = table["y"][0].as_py(), p.all > 0
        ones = np.bincount(p.of_dish[some], minlength=len(p.dishes)), np.bincount(p.of_context[some], minlength=len(p.contexts))
        again, _ = p.again()
        return _rows([(_bucket(b), _STATE, b, again.packed()), *_ups(_FIRST, b, buckets, p.contexts, p.dishes, [ones], vocabulary, vocabulary), *_ups(_UP, b, buckets, again.contexts, again.dishes, _more(again, [np.ones(len(again.c))]), vocabulary, vocabulary)])

    def reports(table: pa.Table, words: int, n: int):
        """Customers of the parent and tables of the contexts, in n seatings, with the places that each sender asks for; the parent's tables so far and the vocabulary. The start of texts comes last."""
        b = -1 - table["to"][0].as_py()
        customers, tables, places = np.zeros((n, words), np.int64), np.zeros((n, words + 1), np.int64), []
        rows = _of(table, _UP)
        for r in _of(table, _FIRST) + rows:
            several = n if r["kind"] == _UP else 1
            dishes, *mine = unbundle(r["a"], *[np.int64] * (1 + several))
            contexts, *parts = unbundle(r["b"], *[np.int64] * (1 + several))
            i, j = (dishes - b - _BOS - 1) // buckets, (contexts - b - _BOS - 1) // buckets
            if r["kind"] == _UP:
                places.append((r["sender"], i, j))
            for k in range(n):
                customers[k][i] += mine[k % several]
                tables[k][j] += parts[k % several]
        return customers, tables, places, *((rows[0]["x"], rows[0]["y"]) if rows else (0.0, 0.0))

    def root_seating(customers: np.ndarray, keys: np.ndarray, tables: float, vocabulary: float, *salt: int) -> np.ndarray:
        """The parent's tables of each word given its customers."""
        x = gamma(np.array([ROOT_STRENGTH / ROOT_DISCOUNT + tables]), np.array([seed], np.uint64), *salt, 1)[0]
        out, some = np.zeros(len(customers), np.int64), np.flatnonzero(customers)
        out[some] = stirling(ROOT_DISCOUNT).draw(customers[some], np.full(len(some), x / (vocabulary + 1)), uniform(keys[some], seed, *salt, 2))
        return out

    def parent(turn: int, table: pa.Table) -> pa.Table:
        """The parent's tables and probabilities of a bucket's words, and the auxiliary draws of its contexts, for those that reported."""
        b = -1 - table["to"][0].as_py()
        keys = unbundle(_of(table, _LEXICON)[0]["a"], np.uint64)[0]
        (customers,), (tables,), places, before, vocabulary = reports(table, len(keys), 1)
        own = root_seating(customers, keys, before, vocabulary, turn)
        mass, some = np.zeros(len(keys)), np.flatnonzero(customers)
        mass[some] = gamma(customers[some] - ROOT_DISCOUNT * own[some], keys[some], seed, turn, 3)
        whole = np.append(keys, np.uint64(_BOS_KEY))
        x = [gamma(strength / discount + tables, whole, seed, turn, 4 + k).astype(np.float32) for k in range(samples if turn == rounds - 1 else 1)]
        short = (mix(whole) >> np.uint64(32)).astype(np.uint32)
        sums = float(customers.sum()), float(own.sum()), vocabulary
        return _rows([(_bucket(k), _DOWN, b, bundle(mass[i].astype(np.float32), short[i]), bundle(short[j], *[v[j] for v in x]), b"", *sums) for k, i, j in places])

    def seating(turn: int, table: pa.Table) -> pa.Table:
        b, p = -1 - table["to"][0].as_py(), _Again.of(_of(table, _STATE)[0]["a"])
        (rate,), key, tables, vocabulary = _rates(p, table, buckets, 1)
        drawn = stirling(discount).draw(p.c, rate, uniform(key, seed, turn))
        return _rows(_ups(_UP, b, buckets, p.contexts, p.dishes, _more(p, [drawn]), tables, vocabulary))

    def seatings(table: pa.Table) -> pa.Table:
        """The seatings that count: blocks get each pair's customers and tables, summed over them."""
        b, p = -1 - table["to"][0].as_py(), _Pairs(table)
        again, at = p.again()
        rates, key, tables, vocabulary = _rates(again, table, buckets, samples)
        drawn = [stirling(discount).draw(again.c, rate, uniform(key, seed, rounds, k)) for k, rate in enumerate(rates)]
        t = np.where(p.all > 0, samples, 0)
        t[at] = sum(drawn)
        answers = [(k, _SEATS, b, bundle(p.all[x], t[x])) for k, x in zip(p.senders, np.split(p.place, p.ends), strict=True)]
        return _rows([*answers, *_ups(_UP, b, buckets, again.contexts, again.dishes, _more(again, drawn), tables, vocabulary)])

    def root(table: pa.Table) -> pa.Table:
        """Each block's words: their customers and tables in the parent and the tables of their own restaurants, summed over the seatings."""
        b = -1 - table["to"][0].as_py()
        keys, runs, _, order = merged(table)
        customers, tables, _, before, vocabulary = reports(table, len(keys), samples)
        own = np.stack([root_seating(customers[k], keys[order], before, vocabulary, rounds, k) for k in range(samples)])
        made = np.empty((3, len(keys)), np.int64)
        made[:, order] = customers.sum(axis=0), own.sum(axis=0), tables[:, :-1].sum(axis=0)
        sums = customers.sum() / samples, own.sum() / samples, tables[:, -1].mean()
        return _rows([(k, _ROOT, b, bundle(*made[:, p]), b"", b"", *map(float, sums)) for k, p in runs])

    def finish(table: pa.Table) -> pa.Table:
        block = _Block.of(table)
        counts, numbers, total, known = block.told(table, bits)
        (bucket, *_), place, trained = block.pairs(counts, numbers, total, bits)
        share = np.zeros(len(bucket) + 1)
        for r in _of(table, _SEATS):
            i = slice(*np.searchsorted(bucket, [r["sender"], r["sender"] + 1]))
            c, t = unbundle(r["a"], np.int64, np.int64)
            share[i] = c - discount * t / samples
        rows = _of(table, _ROOT)
        made = [unbundle(r["a"], *[np.int64] * 3) for r in rows]
        own = np.concatenate([c - ROOT_DISCOUNT * t for c, t, _ in made]) / samples
        tables = np.concatenate([t for _, _, t in made]) / samples
        customers, root_tables, start = (sum(r[k] for r in rows) for k in "xyz")
        up = ((own + (ROOT_STRENGTH + ROOT_DISCOUNT * root_tables) / (known + 1)) / (ROOT_STRENGTH + customers))[block.place]
        seated = block.before(tables, start)
        p = np.where(trained > 0, (share[place] + (strength + discount * seated) * up) / (strength + trained), up)
        base = np.log10((counts[block.place] + 1) / (total + known + 1))
        add = lambda x: np.add.reduceat(x, block.first)
        scores = add(np.log10(p))
        return pa.table(
            [
                block.ids,
                pa.array(~block.train),
                pa.array(block.lengths, pa.int64()),
                pa.array(add((counts[block.place] > 0).astype(np.int64)), pa.int64()),
                pa.array([total] * len(scores), pa.int64()),
                pa.array(add(base)),
                pa.array(scores),
                pa.array(10 ** (-scores / block.lengths)),
            ],
            schema=out,
        )

    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])

    def in_turn(f, turn: int):
        return lambda table: f(turn, table)

    def sent(f, *parts: DataFrame) -> DataFrame:
        """What ``f`` makes of the rows at each address, sent on to theirs. Parts that were sent are not dealt again."""
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows.groupBy("to").applyInArrow(f, _ROW_DDL).repartition(n, "to")

    def only(df: DataFrame, kind: int) -> DataFrame:
        """Rows of a kind. The partition's number is there for the optimizer: it doesn't move this below an exchange, so that the exchange can be used again."""
        return df.where(F.when(F.spark_partition_id() >= 0, F.col("kind") == kind))

    texts = placed.mapInArrow(_packed, _ROW_DDL).repartition(n, "to")
    told = sent(words, texts)
    tokens = only(told, _TOKENS)
    counted = sent(count, only(told, _WORDS))
    asked = sent(ask, tokens, only(counted, _COUNTS))
    begun = sent(begin, asked)
    first, up = only(begun, _FIRST), only(begun, _UP)
    for turn in range(rounds):
        down = sent(in_turn(parent, turn), only(counted, _LEXICON), first, up)
        if turn < rounds - 1:
            up = sent(in_turn(seating, turn), only(begun, _STATE), down)
    final = sent(seatings, asked, down)
    roots = sent(root, only(told, _WORDS), first, only(final, _UP))
    everything = tokens.unionByName(only(counted, _COUNTS)).unionByName(only(final, _SEATS)).unionByName(roots)
    return everything.groupBy("to").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
