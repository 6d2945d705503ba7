"""Plain re-statements of the operators' contracts for small tables."""

import re
from collections import Counter, defaultdict

import xxhash

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def lower(s):
    return (s or "").translate(str.maketrans(UP, LOW))


def words(s):
    return [w for w in SPACE.split(s or "") if w]


def first(i):
    return (i is not None, i or 0)


def kept_lines(rows):
    holder = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = lower(x.strip(" \t\n\x0b\x0c\r"))
            if len(k) >= 10:
                holder[k] = min(holder.get(k, (True, 1 << 70)), first(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if holder.get(lower(x.strip(" \t\n\x0b\x0c\r")), first(i)) == first(i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def kept_windows(rows, n):
    seen = Counter(tuple(w[k : k + n]) for _, t in rows for w in [words(t)] for k in range(len(w) - n + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {p for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for p in range(k, k + n)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def fingerprint(s, n=3):
    w = words(lower(s))
    made = [" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in made]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, linked):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = defaultdict(list)
    for a in range(n):
        out[find(a)].append(a)
    return list(out.values())


def quality(t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = {p for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))


PIECE = re.compile("[^\\x20\\x09-\\x0DaeiouAEIOU0-9\\x80-\U0010ffff]{0,3}[^\\x20\\x09-\\x0D]")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(parts):
    """XXH64 of parts one after the other, each seeded by the hash so far."""
    seed = 42
    for x in parts:
        seed = xxhash.xxh64_intdigest(x, seed=seed)
    return seed


def syncmers(t, k=8, s=3):
    """The fingerprint string of a text, and the set of its links."""
    p = [x.encode() for x in PIECE.findall(t or "")]
    g = [signed(chained(p[i : i + s])) for i in range(len(p) - s + 1)]
    found = [i for i in range(len(p) - k + 1) if min(range(k - s + 1), key=lambda j, i=i: g[i + j]) in (0, k - s) or min(g[i], g[i + k - s]) == min(g[i : i + k - s + 1])]
    made = [(i, chained(v.to_bytes(8, "little", signed=True) for v in (g[i], g[i + 3], g[i + 5])) & 0xFFFFF) for i in found]
    if p and not made:
        made = [(0, xxhash.xxh64_intdigest(b" ".join(p), seed=42) & 0xFFFFF)]
    links, at, before = [], 0, 0
    for i, h in made:
        links.append((before, i - at, h))
        at, before = i, h
    return "".join(f"{gap:x}{h:05x}" for _, gap, h in links), set(links)


def targets(sizes, weights=(1, 2, 3), cap=3):
    """sizes by source in order: shares by weight, the excess over the cap shared again until none is above."""
    names, total, fixed = list(sizes), sum(sizes.values()), {}
    while True:
        free = [k for k in names if k not in fixed]
        left, w = total - sum(fixed.values()), sum(weights[names.index(k) % len(weights)] for k in free)
        got = {k: left * weights[names.index(k) % len(weights)] / w for k in free}
        over = [k for k in free if got[k] > cap * sizes[k]]
        if not over:
            return fixed | got
        fixed |= {k: cap * sizes[k] for k in over}
