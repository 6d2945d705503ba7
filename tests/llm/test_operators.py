import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from voxelith.llm import cotrain, html, mixing, nearcopies, pieces, pitmanyor, queries, simhash, syncmers
from voxelith.llm.lines import dedup_lines
from voxelith.llm.quality import quality_rules
from voxelith.llm.substring import dedup_substrings, window_hashes

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{k % 977}" for k in range(30_000))
PASSAGE = " ".join(f"p{k}" for k in range(60))
EDGE = [
    (1, "the Quick brown fox\nA shared LINE of text \nend", "en", "a"),
    (2, "something else\n  a shared line of text\nshort\nshort", "en", "a"),
    (2, "something else\n  a shared line of text\nshort\nshort", "en", "a"),
    (2, "same id, other text\na shared line of text", "de", "b"),
    (None, "no id at all\na shared line of text", None, None),
    (None, None, None, None),
    (3, None, "fr", None),
    (4, "", "", ""),
    (5, " \n\t\r\n ", "en", "c"),
    (6, LONG, "en", "c"),
    (7, LONG, "en", "c"),
    (8, f"start {PASSAGE} middle words É ñ {PASSAGE} end", "es", "c"),
    (9, f"{PASSAGE}\x0btail\x0cÉé", "es", "a"),
    (10, "ÀÉ à b c ퟿ \U0001f600 ▁ x", "xx", "b"),
    (11, "a a a a a a a a a a a a", "en", "b"),
]
NAMES = "doc_id bigint, text string, lang string, source string"
CLASH = ["n_words", "kept", "block", "salt", "fp", "size", "h1", "did", "words", "n_lines", "kept_text", "__row", "copies", "host", "ids", "node", "key"]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(EDGE, NAMES)
    for c in CLASH:
        plain = plain.selectExpr("*", f"'{c}' AS {c}")
    return plain


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], NAMES)


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id", ignore_index=True)


def pairs():
    return [(i, t) for i, t, _, _ in EDGE]


def test_quality(docs, empty):
    got = Counter(tuple(r) for r in quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == Counter((i, *brute.quality(t)) for i, t in pairs())
    assert quality_rules(empty).count() == 0 and quality_rules(docs, rules={}).where("kept = base_failed").count() == 0


def test_lines(docs, empty):
    got = Counter(tuple(r) for r in dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect())
    assert got == Counter(brute.kept_lines(pairs()))
    assert dedup_lines(empty).count() == 0


@given(st.lists(st.tuples(st.integers(0, 6), st.lists(st.sampled_from(["a line of ten", "A Line of ten ", "tiny", "", "another long line"]), max_size=4).map("\n".join)), max_size=8))
@settings(max_examples=6, deadline=None)
def test_lines_any(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(tuple(r) for r in dedup_lines(df).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()) == Counter(brute.kept_lines(rows))


def test_clashing_names(docs, spark):
    """Columns named like an operator's own, inner ones included, pass through or are replaced as stated; nothing is ambiguous."""
    from pyspark.sql import functions as F

    from voxelith.llm.quality import keep_quality

    for c in ("__n", "__did", "__tid", "__words", "__copies", "__row", "__in", "next_text", "counts", "count", "did", "tid", "found", "own_text", "row", "id", "null", "k1", "rank", "range", "ghost", "to", "kind", "label_0"):
        docs = docs.withColumn(c, F.lit("own"))
    n = len(EDGE)
    for made in (dedup_lines(docs), mixing.mix_documents(docs), nearcopies.drop_near_copies(docs), keep_quality(docs, min_words=0, max_repeat_percent=100, rules={})):
        rows = made.select("__n", "did", "n_words", "row", "k1").collect()
        assert 0 < len(rows) <= 3 * n and {tuple(r) for r in rows} == {("own", "own", "n_words", "own", "own")}
    assert quality_rules(docs).count() == syncmers.edited_pairs(docs).count() == pitmanyor.score(docs).count() == simhash.near_duplicates(docs).count() == dedup_substrings(docs).count() == n
    pages = docs.select("*", F.col("doc_id").alias("page_id"), F.lit("http://h").alias("url"), F.col("text").alias("html"))
    assert html.extract_main_text(pages).count() == n


def test_substrings(docs, empty):
    rows = dedup_substrings(docs, 35).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in rows) == Counter(brute.kept_windows(pairs(), 35))
    assert all(sum(s.end - s.start for s in r.intervals) == r.n_removed and all(a.end < b.start for a, b in zip(r.intervals, r.intervals[1:])) for r in rows)
    assert [(s.start, s.end) for r in rows if r.doc_id == 8 for s in r.intervals] == [(1, 61), (65, 125)]
    assert dedup_substrings(empty).count() == 0


def test_substrings_short_windows(spark):
    rows = [(k, t) for k, t in enumerate(["a b c d", "b c d e", "a b", "x y z x y z", ""])]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string"), 3).collect())
    assert got == Counter(brute.kept_windows(rows, 3))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 35, 64])
def test_window_hashes(n):
    w = np.random.default_rng(n).integers(0, 5, 300).astype(np.uint64)
    h = window_hashes(w, n)
    assert len(h) == 301 - n and len(set(h.tolist())) == len({tuple(w[k : k + n]) for k in range(301 - n)})


def test_simhash(docs, empty, sample, spark):
    for table, rows in ((docs, pairs()), (spark.createDataFrame(sample[["doc_id", "text"]]), list(zip(sample.doc_id, sample.text, strict=True)))):
        got = simhash.near_duplicates(table).collect()
        prints = [brute.fingerprint(t) for _, t in rows]
        want = Counter()
        for g in brute.groups(len(rows), lambda a, b, p=prints: (p[a] ^ p[b]).bit_count() <= 2):
            least = min((rows[k][0] for k in g if rows[k][0] is not None), default=None)
            want.update((rows[k][0], f"{prints[k]:016x}", least) for k in g)
        assert Counter(tuple(r) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


@given(st.integers(0, 2**64 - 1), st.lists(st.sets(st.integers(0, 63), max_size=6), min_size=1, max_size=300), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_bit_slices(base, flips, radius):
    x = np.array([base ^ sum(1 << b for b in f) for f in flips], np.uint64)
    hit = simhash.within(simhash.planes(x ^ np.uint64(base)), radius)[: len(x)]
    assert hit.tolist() == [len(f) <= radius for f in flips]


def test_near_links_join_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = [int(v) for v in rng.integers(0, 2**63, 40)]
    for v in x[:10]:  # chains and a large group
        for _ in range(30):
            v ^= 1 << int(rng.integers(0, 64))
            v ^= 1 << int(rng.integers(0, 64))
            x.append(v)
    x = list(set(x))
    signed = np.array(x, np.uint64).view(np.int64).tolist()
    found = simhash.components(simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp bigint"))).collect()
    got = defaultdict(set)
    for r in found:
        got[r.root] |= {r.node, r.root}
    want = {frozenset(signed[k] for k in g) for g in brute.groups(len(x), lambda a, b: (x[a] ^ x[b]).bit_count() <= 2) if len(g) > 1}
    assert {frozenset(g) for g in got.values()} == want and all(min(g) == r for r, g in got.items())


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert all(got.get(k, 0) == 0 for k in range(61)) and got[101] == 100


@pytest.mark.parametrize("table", ["edge", "sample"])
def test_near_copies(docs, sample, spark, table):
    rows = [(i, t) for i, t in pairs()] if table == "edge" else list(zip(sample.doc_id, sample.text, strict=True))
    df = docs if table == "edge" else spark.createDataFrame(sample[["doc_id", "text", "lang", "source"]])

    def shingles(t):
        w = words_of(t)
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    words_of = lambda t: brute.words(brute.lower(t))
    sets = [shingles(t) for _, t in rows]
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    got = nearcopies.near_copies(df).collect()
    assert len(got) == len(rows)
    kept = nearcopies.drop_near_copies(df)
    ids = Counter((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect())
    assert set(ids.values()) == {1} and kept.columns == df.columns
    near, some = brute.groups(len(rows), lambda a, b: like(a, b) >= 0.8), brute.groups(len(rows), lambda a, b: like(a, b) >= 0.5)
    assert all(len({rows[k] for k in g} & set(ids)) <= 1 for g in near)  # copies of 0.8 and more leave one
    assert all(len({rows[k] for k in g} & set(ids)) >= 1 for g in some)  # nothing unlike is lost


def test_near_copies_of_less_than_the_similarity_stay(spark):
    """Groups and lost rows are those of the exact similarity, also for pairs just under it."""
    rng, rows = np.random.default_rng(5), []
    for g in range(24):
        w = [f"g{g}w{k}" for k in rng.integers(0, 10**9, 300)]
        rows.append(" ".join(w))
        for at in rng.choice(59, 4 + g // 2, replace=False):  # one word for each, five shingles lost
            w[5 * at + 4] = f"other{at}"
        rows.append(" ".join(w))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, rows)]
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert sum(0.7 <= like(2 * g, 2 * g + 1) < 0.8 for g in range(24)) >= 6
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()}
    assert got == {k: min(g) for g in brute.groups(len(rows), lambda a, b: like(a, b) >= 0.8) for k in g}


@given(st.lists(st.sets(st.integers(0, 14), min_size=1), min_size=2, max_size=30), st.sampled_from([0.5, 0.75, 0.8, 1.0]))
@settings(max_examples=100, deadline=None)
def test_confirmed_like_brute_force(sets, similarity):
    root = dict(zip(*nearcopies.confirmed(list(range(len(sets))), [np.array(sorted(x), np.uint64) for x in sets], similarity), strict=True))
    got = {frozenset(k for k in range(len(sets)) if root.get(k, k) == r) for r in {root.get(k, k) for k in range(len(sets))}}
    assert got == {frozenset(g) for g in brute.groups(len(sets), lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity)}


def test_pieces_like_brute_force():
    p = pieces.Pieces.load(queries.PIECES_MODEL)

    def all_ways(c):
        done = []

        def go(i, s, ids):
            if i == len(c):
                done.append((s, ids))
            for j in range(i + 1, len(c) + 1):
                if c[i:j] in p.scores:
                    go(j, s + p.scores[c[i:j]][1], (*ids, p.scores[c[i:j]][0]))
            if i < len(c) and c[i] not in p.scores:
                raw = c[i].encode()
                go(i + 1, s + p.byte_score * len(raw), (*ids, *[p.bytes_[b] for b in raw]))

        go(0, 0.0, ())
        return sorted((s for s, _ in done), reverse=True)

    for c in ("▁the", "▁thereof", "▁über一x", "▁▁▁ab", "\n", "▁attioning"):
        assert [s for s, _ in p.nbest(c, 6)] == pytest.approx(all_ways(c)[:6])
        assert all(p.decode((0, *ids)) or ids for _, ids in p.nbest(c, 6)) and len({ids for _, ids in p.nbest(c, 50)}) == min(50, len(all_ways(c)))
    for text in ("there of", "a b\nthe x", "in on"):
        whole = pieces.SPACE + text.replace(" ", pieces.SPACE)
        assert [s for s, _ in p.encode(text, 5)] == pytest.approx(all_ways(whole)[:5])
        assert all(p.decode(ids) == text for _, ids in p.encode(text, 5))


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_pieces_round_trip(text):
    p = test_pieces_round_trip.pieces = getattr(test_pieces_round_trip, "pieces", None) or pieces.Pieces.load(queries.PIECES_MODEL)
    assert [p.decode(ids) for _, ids in p.encode(text, 3)].count(text) == len(p.encode(text, 3))


def test_encode(docs, empty):
    got = pieces.encode(docs, queries.PIECES_MODEL).collect()
    assert Counter((r.doc_id, r.decoded) for r in got) == Counter((i, t or "") for i, t in pairs())
    assert all(len(r.ids) == r.n_pieces and (r.second_score is None or r.second_score <= r.score) for r in got)
    assert pieces.encode(empty, queries.PIECES_MODEL).count() == 0


def test_encode_gives_n_segmentations(docs):
    p = pieces.Pieces.load(queries.PIECES_MODEL)
    for n in (1, 2, 4):
        for r in pieces.encode(docs, queries.PIECES_MODEL, n).collect():
            want = pieces.Pieces.encode(p, r.text or "", n)
            assert [(r.score, r.ids)] + [(o.score, o.ids) for o in r.others] == [(s, list(ids)) for s, ids in want]
            assert r.second_score == (want[1][0] if len(want) > 1 else None) and all(p.decode(o.ids) == (r.text or "") for o in r.others)


def test_encode_gives_changes(docs):
    """The changes lead from the best ids to each other segmentation."""
    whole = {(r.doc_id, r.text): r for r in pieces.encode(docs, queries.PIECES_MODEL, 4).collect()}
    for r in pieces.encode(docs, queries.PIECES_MODEL, 4, changes_only=True).collect():
        want = whole[r.doc_id, r.text]
        ids = [pieces.changed(np.array(r.ids, np.int32), [(c.start, c.end, c.ids) for c in o.changes]).tolist() for o in r.others]
        assert ids == [o.ids for o in want.others] and [o.score for o in r.others] == [o.score for o in want.others] and r.ids == want.ids


def test_pieces_forget(monkeypatch):
    """A worker that forgets what it made gives the same."""
    p, texts = pieces.Pieces.load(queries.PIECES_MODEL), [f"some words number{k} and others{k * k}" for k in range(300)]
    want = [p.encode(t, 2) for t in texts]
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    pieces.Memory.held = (None, None)
    assert [p.encode(t, 2) for t in texts + texts] == want + want


def test_syncmers(spark, sample, empty):
    from pyspark.sql import functions as F

    ids = {i: t for i, t, _, _ in EDGE if i is not None and i != 2}
    for table in (sorted(ids.items()), list(zip(sample.doc_id, sample.text, strict=True))[:60], [(9, "one text only, " * 40)]):
        df = spark.createDataFrame(table, "doc_id bigint, text string")
        edited = syncmers.edited_pairs(df).withColumn("other", syncmers.sketch(F.col("edited")))
        near = syncmers.likeness(F.col("made"), F.col("other"))
        rows = {r.doc_id: r for r in edited.withColumn("near", near).withColumn("print", syncmers.fingerprint(F.col("made"))).collect()}
        assert len(rows) == len(table)
        for k, (i, t) in enumerate(table):
            t, after = t or "", table[(k + 1) % len(table)][1] or ""
            cut = len(t) // 4
            assert rows[i].edited == t[: len(t) - cut] + after[:cut]
            (print_, mine), (_, other) = brute.syncmers(t), brute.syncmers(rows[i].edited)
            assert rows[i].print == print_ and rows[i].near == pytest.approx(len(mine & other) / len(mine | other) if mine | other else 1.0)
    assert syncmers.edited_pairs(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "x"), (None, None)], "doc_id bigint, text string")
    assert syncmers.edited_pairs(twice).count() == 4


def test_likeness_of_a_short_and_a_long_text(spark, tmp_path):
    """Short texts, texts without spaces and texts of other scripts are as near as their shares in common."""
    w = " ".join(f"w{k * 7919 % 1000}" for k in range(120))
    blank = "".join(f"{k * 7919 % 1000:03d}" for k in range(300))
    script = "".join(chr(0x4E00 + k * 7919 % 5000) for k in range(300))
    rows = [(1, w[:410]), (2, w[:390]), (3, "tiny"), (4, blank), (5, blank[:880]), (6, script), (7, script[3:]), (8, "one two three four five six seven eight"), (9, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op7_syncmer_fingerprints(spark, str(tmp_path)).collect()}
    assert all(got[k].near_next > 0.8 for k in (1, 4, 6)) and got[2].near_next == got[3].near_next == got[5].near_next == 0
    assert all(got[k].near_edited > 0.4 for k in (2, 4, 5, 6)) and got[8].near_edited > 0.3 and got[9].near_edited == 1
    lone = [(1, w[:461]), (2, "x y z")]
    spark.createDataFrame(lone, "doc_id bigint, text string").write.parquet(f"{tmp_path}/lone/documents.parquet")
    assert queries.op7_syncmer_fingerprints(spark, f"{tmp_path}/lone").where("doc_id = 1").first().near_edited > 0.6


def test_syncmers_select_by_their_own_pieces_only(spark):
    """Equal passages have equal anchors, whatever stands around them, and links count order and distance."""
    from pyspark.sql import functions as F

    w = [f"w{k * 7919 % 1000}" for k in range(400)]
    row = (
        spark.createDataFrame([(" ".join(w), " ".join(["other"] * 9 + w[100:]), " ".join(w[200:] + w[:200]), " ".join(reversed(w)))], "a string, b string, c string, d string")
        .select(syncmers.anchors(F.col("a")).alias("in_a"), syncmers.anchors(F.col("b")).alias("in_b"), *[syncmers.likeness(syncmers.sketch(F.col("a")), syncmers.sketch(F.col(x))).alias(f"near_{x}") for x in "bcd"])
        .first()
    )
    shift = len(brute.PIECE.findall(" ".join(w[:100]))) - len(brute.PIECE.findall(" ".join(["other"] * 9)))
    a, b = ({(x >> 20, x & 0xFFFFF) for x in y} for y in (row.in_a, row.in_b))
    late = {(k, h) for k, h in a if k >= 400}
    assert len(late) > 100 and {(k - shift, h) for k, h in late} <= b
    assert 0.65 < row.near_b < 0.8 and row.near_c > 0.97 and row.near_d < 0.05


@pytest.mark.parametrize("table", ["edge", "sample"])
def test_mixing(docs, sample, spark, table):
    df = docs if table == "edge" else spark.createDataFrame(sample[["doc_id", "text", "source"]])
    source = {(r.doc_id, r.text): r.source for r in df.select("doc_id", "text", "source").collect()}
    rows = mixing.mix_plan(df).collect()
    assert len(rows) == df.count() and all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in rows)
    sizes = defaultdict(int)
    for r in df.select("source", "text").collect():
        sizes[r.source] += len(brute.words(r.text))
    sizes = dict(sorted(sizes.items(), key=lambda x: (x[0] is None, (x[0] or "").encode())))
    want, by = brute.targets(sizes), defaultdict(int)
    for r in rows:
        by[r.source_size, round(r.target, 6)] += r.taken
    assert {(s, round(want[k], 6)) for k, s in sizes.items()} == set(by)
    if table == "sample":
        assert all(abs(taken - t) <= 0.02 * t + 20 for (_, t), taken in by.items())
    assert Counter(rows) == Counter(mixing.mix_plan(df.repartition(3)).collect())
    copies = Counter((r.doc_id, r.text) for r in mixing.mix_documents(df).select("doc_id", "text").collect())
    assert sum(len(brute.words(t)) * n for (_, t), n in copies.items()) == sum(r.taken for r in rows) and set(copies) <= set(source)


def test_mixing_rates(sample, spark):
    """Rates against the dual solved source by source by halving, and copies against the rates' tokens."""
    rows = mixing.mix_plan(spark.createDataFrame(sample[["doc_id", "text", "source"]])).toPandas()
    source = dict(zip(sample.doc_id, sample.source, strict=True))
    for _, g in rows.groupby(rows.doc_id.map(source)):
        size, target = g["size"].to_numpy(float), g["target"].iloc[0]
        rates = lambda x: np.minimum(3, np.exp(np.minimum(x * size, 2)))
        low, high = -20.0, 2.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if (size * rates(mid)).sum() >= target else (mid, high)
        assert g["rate"].to_numpy() == pytest.approx(rates(high), abs=1e-5)
        assert abs(g["taken"].sum() - target) <= 0.005 * target + 1 and g["rate"].std() > 0


def test_mixing_by_constraint(spark):
    """Sources under their target, over it, at it, at the cap and without words."""
    rows = [(k, "w " * (k % 9 + 1), "abcde"[k % 5]) for k in range(400)] + [(900, "x " * 40000, "f"), (901, None, "g"), (902, " ", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(brute.words(t))
    sizes = dict(sorted(sizes.items(), key=lambda x: (x[0] is None, x[0] or "")))
    source, by = {i: s for i, _, s in rows}, defaultdict(int)
    got = mixing.mix_plan(df, (1, 5)).collect()
    for r in got:
        by[source[r.doc_id]] += r.taken
        assert r.target == pytest.approx(brute.targets(sizes, (1, 5))[source[r.doc_id]]) and 0 <= r.copies <= 3
    assert len(got) == len(rows) and all(abs(by[s] - t) <= 1 for s, t in brute.targets(sizes, (1, 5)).items() if s != "f")


def test_mixing_hot_group(spark):
    rows = [(k, "five words of one size", "hot" if k % 3 else "cold") for k in range(2000)] + [(5000 + k, "x " * (k % 40), "cold") for k in range(500)]
    got = mixing.mix_plan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    by = defaultdict(int)
    for r in got:
        by[r.target] += r.taken
    assert len(got) == len(rows) and all(abs(n - t) < 0.01 * t + 5 for t, n in by.items())


def test_mixing_empty(empty):
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-menu"><header>Site</header>
<nav><ul><li><a href=/a>Menu</a></ul></nav><div class="ad box">Buy <b>now</b></div><div id=cookie-notice>We use cookies</div>
<article><h1>Title &amp;amp; more</h1><script>var t="</p><p>no";</script><p>First&nbsp;  para<br>graph <i>x</i>.<p>Second &lt;b&gt; caf&eacute; <!-- gone > --> &#8364;
<aside>side</aside><form>Search <input></form><ul><li>one<li>two</ul><div class='comments'>I disagree</div></article><footer>&copy; all</footer>"""


def test_html_blocks():
    want = "Title &amp; more\nFirst para graph x.\nSecond <b> café €\none\ntwo"
    assert html.main_texts([PAGE]) == [want]
    odd = ["", "plain words", "<p", "<article></article>", "<a href='x>y'>l</a><p>t</p>", "<p>a<p hidden>b<p>c", "<![CDATA[x<y]]>", "<script>never closed <p>x"]
    got = html.main_texts(odd)
    assert got[:2] + got[3:] == ["", "plain words", "", "t", "a\nc", "x<y", ""]


def test_html_boilerplate_without_markup():
    shared = "this long line stands at the top of every single page"
    pages = [f"<div>{shared}</div><div>own words of page {k} that no other page has at all</div>" for k in range(5)]
    assert html.main_texts(pages) == [f"own words of page {k} that no other page has at all" for k in range(5)]
    copy = f"<article><p>{shared}</p></article>"
    assert html.main_texts([copy, copy]) == [shared, shared]


def test_html_inside_an_article():
    """Parts are told by whole names of classes, and what is apart inside a line leaves the line whole."""
    page = """<article><p>one <b class="ad">buy</b> two <a class="share" href=x>Share this</a> three</p><div class="share-price">price</div>
    <section id="related-work"><p>work</p></section><div class="menu-recipe">recipe</div><div class="related-posts">no</div><div id="commentList">no</div>
    <p>x <span class="ad">no<span> no</span></span> y</p><p>z <button>no</button></p></article>"""
    assert html.main_texts([page]) == ["one two three\nprice\nwork\nrecipe\nx y\nz"]


def plain_pages(rng, n):
    """Pages without an article or telling names, of three hosts; copies; lines that several pages share."""
    word = lambda k: f"w{rng.integers(0, 10**6)}x{k}"
    lines = [" ".join(word(k) for _ in range(12)) for k in range(20)]
    rows = []
    for k in range(n):
        own = [" ".join(word(j) for _ in range(int(rng.integers(3, 30)))) for j in range(int(rng.integers(0, 4)))]
        shared = [lines[int(x)] for x in rng.integers(0, 20, int(rng.integers(0, 3)))]
        parts = [*own, *shared, *([own[0] + " " + lines[3]] if own and k % 3 == 0 else [])]
        rng.shuffle(parts)
        rows.append((k, f"http://host{k % 7 % 3}.org/{k}", "<body>" + "".join(f"<div>{x}</div>" for x in parts)))
        if k % 5 == 0:
            rows.append((1000 + k, rows[-1][1] + "?again", rows[-1][2]))
    return rows


def test_html_without_markup_like_brute_force(spark, monkeypatch):
    """Every block of every page by the definition, whatever the blocks and buckets, over all pages of a host."""
    from voxelith.llm import blocks

    rows = plain_pages(np.random.default_rng(4), 200)
    host = lambda url: url.split("/")[2]
    holders = defaultdict(set)
    streams = {i: [x.split() for x in h.removeprefix("<body><div>").removesuffix("</div>").split("</div><div>")] if "<div>" in h else [] for i, _, h in rows}
    grams = lambda i: [tuple(w[k : k + 8]) for w in [sum(streams[i], [])] for k in range(len(w) - 7)]
    for i, url, page in rows:
        for g in grams(i):
            holders[host(url), g].add(page)
    want = {}
    for i, url, _ in rows:
        gone = {k + j for k, g in enumerate(grams(i)) if len(holders[host(url), g]) > 1 for j in range(8)}
        at, kept = 0, []
        for w in streams[i]:
            if sum(at + j in gone for j in range(len(w))) < 0.8 * len(w):
                kept.append(" ".join(w))
            at += len(w)
        want[i] = "\n".join(kept)
    assert sum(len(t) < 10 for t in want.values()) < 150 and any(len(want[i]) < sum(map(len, streams[i])) for i in want)
    for least in (1 << 20, 1 << 9):
        monkeypatch.setattr(blocks, "LEAST_BYTES", least)
        monkeypatch.setattr(blocks, "RUN_KEYS", 20)
        df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
        assert {r.page_id: r.text for r in html.extract_main_text(df).collect()} == want


def test_suffix_ranks():
    tokens, page = np.array([1, 2, 3, 4, 1, 2, 3, 4, 9, 1, 2, 3]), np.repeat([0, 1, 2], [4, 5, 3])
    ranks = html.suffix_ranks(tokens, page, 4)
    assert ranks[0] == ranks[4] >= 0 and ranks[5] not in (-1, ranks[0]) and (ranks[[1, 2, 3, 9, 10, 11]] == -1).all()


def test_html_rows(spark):
    rows = [(1, "http://h/a", PAGE), (2, None, None), (None, "x", "<p>hi"), (1, "http://h/a", PAGE), (3, "http://H:80/b", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, host string")
    got = Counter(tuple(r) for r in html.extract_main_text(df).collect())
    assert sum(got.values()) == 5 and got[1, "http://h/a", html.main_texts([PAGE])[0]] == 2 and got[None, "x", "hi"] == 1 and got[2, None, ""] == 1
    assert html.extract_main_text(df.limit(0)).count() == 0


def test_html_articles(spark):
    import re
    from html import unescape

    got = {r.page_id: r.text for r in queries.op2_html_extraction(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(unescape(re.sub("</?(?:b|br)>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(x for x in parts if x)


def test_classifier(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, test = known.where("pmod(hash(doc_id), 3) > 0"), known.where("pmod(hash(doc_id), 3) = 0").withColumnRenamed("quality", "q")
    made = cotrain.classify(docs, train, targets=("quality",))
    rows = made.join(test, "doc_id").collect()
    assert made.count() == docs.count()
    assert np.mean([(r.q == 1) == r.quality for r in rows]) > 0.95
    some = cotrain.classify(spark.createDataFrame(EDGE, NAMES), spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id bigint, quality int"), targets=("quality",))
    assert some.count() == len(EDGE)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.quality_score for r in cotrain.classify(spark.createDataFrame(EDGE, NAMES), none, targets=("quality",)).collect()} == {0.5}
    assert cotrain.classify(empty, none, targets=("quality",)).count() == 0


def test_classifier_odd_rows(spark, docs, empty):
    """Nulls, empty texts, repeated ids, clashing names, odd labels and no metadata."""
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(1, 1, 0, "x"), (2, 0, 1, "y"), (2, 0, None, "z"), (6, 1, None, "x"), (None, 1, 1, "x"), (99, 0, 0, "x")], "doc_id bigint, quality int, toxic int, text string")
    for c in ("key", "label_0", "by", "lone", "words", "shape"):
        docs, labels = docs.withColumn(c, F.lit("own")), labels.withColumn(c, F.lit(1))
    got = cotrain.classify(docs, labels)
    assert got.count() == len(EDGE) and set(got.columns) == {"doc_id", *[f"{t}{x}" for t in ("quality", "toxic") for x in ("", "_score", "_text", "_meta")]}
    assert cotrain.classify(docs.select("doc_id", "text"), labels).where("quality_score between 0 and 1").count() == len(EDGE)
    assert cotrain.classify(empty, labels).count() == 0
    many = spark.createDataFrame([(1, f"text {k}", "en", "a") for k in range(500)], NAMES)  # one row of them is for fitting
    assert cotrain.classify(many, labels, rounds=1, taken=4).count() == 500


def test_cotraining_exchange(spark):
    """Both views give in every round, and what they give is what brute force finds surest among all without a label."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("pmod(hash(doc_id), 2) = 0")
    history = []
    cotrain.classify(docs, labels, targets=("quality",), taken=40, history=history)
    assert {(r, v) for r, _, v, _ in history} == {(r, v) for r in range(cotrain.ROUNDS) for v in ("text", "meta")}
    for v in ("text", "meta"):
        every = [i for _, _, view, ids in history if view == v for i in ids]
        assert len(every) == len(set(every)) == cotrain.ROUNDS * 40
    first = cotrain.classify(docs, labels, targets=("quality",), rounds=0)
    known = {r.doc_id for r in labels.collect()}
    rows = first.join(docs.select("doc_id", F.xxhash64("text").alias("k")), "doc_id").collect()
    for v in ("text", "meta"):
        best = {}
        for r in rows:
            if r.doc_id not in known:
                best[r.k] = (min(best[r.k][0], r[f"quality_{v}"]), max(best[r.k][1], r[f"quality_{v}"])) if r.k in best else (r[f"quality_{v}"],) * 2
        low, high = (ids for turn, _, view, ids in history if turn == 0 and view == v)
        assert sorted(best[k][0] for k in low) == pytest.approx(sorted(x for x, _ in best.values())[: len(low)])
        assert sorted(best[k][1] for k in high) == pytest.approx(sorted(x for _, x in best.values())[-len(high) :])


def test_fit_like_newton():
    """The fitted loss against that of Newton's steps on the same features."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 3))
    y = (rng.random(600) < 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.0] + 0.5)))).astype(float)
    weight = rng.choice([0.5, 1.0], 600)
    made = cotrain.fit(np.zeros(601, np.int64), np.zeros(0, np.int32), x, y, weight, 0, 300)
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), -8, 8)
    z, w = np.column_stack([z, np.ones(600)]), np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + 1e-9 * np.eye(4), z.T @ (weight * (p - y)))
    loss = lambda q: -np.average(y * np.log(q) + (1 - y) * np.log(1 - q), weights=weight)
    got = 1 / (1 + np.exp(-made.logits(np.zeros(601, np.int64), np.zeros(0, np.int32), x)))
    assert loss(got) <= loss(1 / (1 + np.exp(-z @ w))) * 1.01


def stirlings(c, d):
    """Generalised Stirling numbers S(c, 0..c) by their recursion."""
    row = [0.0, 1.0]
    for n in range(1, c):
        row = [0.0, *[row[t - 1] + (n - d * t) * (row[t] if t < len(row) else 0.0) for t in range(1, n + 2)]]
    return row


def rising(x, step, n):
    return math.prod(x + k * step for k in range(n))


@pytest.mark.parametrize("dishes", [[(3, 0.1)], [(10, 0.1)], [(40, 0.1)], [(40, 0.01)], [(3, 0.3), (7, 0.2)], [(1, 0.2), (2, 0.2), (12, 0.6)]])
def test_seating_by_its_posterior(dishes):
    """Average tables of a restaurant's dishes against their exact posterior, over many restaurants alike."""
    d, strength, copies = 0.8, 1.0, 4000
    total, mean = 0.0, np.zeros(len(dishes))
    for ways in np.ndindex(*[c for c, _ in dishes]):
        t = [k + 1 for k in ways]
        p = rising(strength, d, sum(t)) * math.prod(stirlings(c, d)[k] * h**k for k, (c, h) in zip(t, dishes, strict=True))
        total, mean = total + p, mean + p * np.array(t)
    counts, base = (np.tile(x, copies) for x in zip(*dishes, strict=True))
    runs = list(pitmanyor.seat(counts, base, np.repeat(np.arange(copies), len(dishes)), d, strength, 5, 16))[4:]
    assert np.mean(runs, axis=0).reshape(copies, -1).mean(axis=0) == pytest.approx(mean / total, rel=0.02)


def test_seating_of_many_customers():
    """Beyond the table of Stirling numbers, against the numbers themselves."""
    small, large = pitmanyor.Stirling(0.8, 200), pitmanyor.Stirling(0.8, 1500)
    for c, rate in ((300, 0.5), (1500, 8.0), (1500, 90.0)):
        t, w = np.arange(1, c + 1), large.log[c, 1 : c + 1] + np.arange(1, c + 1) * np.log(0.8 * rate)
        w = np.exp(w - w.max())
        v = small.weights(c, rate)
        v = np.exp(v - v.max())
        assert (v * np.arange(1, len(v) + 1)).sum() / v.sum() == pytest.approx((w * t).sum() / w.sum(), rel=0.005)
        drawn = small.draw(np.full(4000, c), np.full(4000, rate), np.random.default_rng(1).random(4000))
        assert drawn.mean() == pytest.approx((w * t).sum() / w.sum(), rel=0.02)


@pytest.mark.parametrize("shape", [0.3, 1.0, 7.5, 1e4])
def test_gamma(shape):
    x = pitmanyor.gamma(np.full(40_000, shape), np.arange(40_000, dtype=np.uint64), 3)
    assert x.mean() == pytest.approx(shape, rel=0.02) and x.var() == pytest.approx(shape, rel=0.05)


def test_lm_by_its_posterior(spark):
    """Scores of a tiny corpus, averaged over seeds, against predictive probabilities summed over all seatings."""
    train, d, d0 = ["a b", "a b", "a c", "b"], pitmanyor.DISCOUNT, pitmanyor.ROOT_DISCOUNT
    ids = [k for k in range(100) if pitmanyor.is_training(k)][: len(train)]
    other = [k for k in range(100) if not pitmanyor.is_training(k)][:2]
    tests = ["a b", "c z"]
    tokens = lambda t: list(zip(["<", *t.split()], [*t.split(), ">"], strict=True))
    c = Counter(x for t in train for x in tokens(t))
    context, known, vocabulary = Counter(), sorted({w for _, w in c}), len({w for _, w in c})
    for (u, _), n in c.items():
        context[u] += n
    pairs = sorted(c)
    total, p = 0.0, defaultdict(float)
    asked = {x for t in tests for x in tokens(t)}
    for ways in np.ndindex(*[c[x] for x in pairs]):
        t = {x: k + 1 for x, k in zip(pairs, ways, strict=True)}
        at, up = Counter(), Counter()
        for (u, w), k in t.items():
            at[u] += k
            up[w] += k
        one = math.prod(rising(pitmanyor.STRENGTH, d, n) for n in at.values()) * math.prod(stirlings(c[x], d)[t[x]] for x in pairs)
        for roots in np.ndindex(*[up[w] for w in known]):
            r = {w: k + 1 for w, k in zip(known, roots, strict=True)}
            n0, t0 = sum(up.values()), sum(r.values())
            both = one * rising(pitmanyor.ROOT_STRENGTH, d0, t0) / rising(pitmanyor.ROOT_STRENGTH, 1, n0) * math.prod(stirlings(up[w], d0)[r[w]] for w in known) / (vocabulary + 1) ** t0
            total += both
            for u, w in asked:
                h = ((up[w] - d0 * r[w] if w in r else 0) + (pitmanyor.ROOT_STRENGTH + d0 * t0) / (vocabulary + 1)) / (pitmanyor.ROOT_STRENGTH + n0)
                p[u, w] += both * ((c[u, w] - d * t.get((u, w), 0) + (pitmanyor.STRENGTH + d * at[u]) * h) / (pitmanyor.STRENGTH + context[u]) if context[u] else h)
    df = spark.createDataFrame([*zip(ids, train, strict=True), *zip(other, tests, strict=True)], "doc_id bigint, text string")
    got = defaultdict(list)
    for seed in range(8):
        for r in pitmanyor.score(df, rounds=3, samples=8, seed=seed).where("held_out").collect():
            got[r.doc_id].append(10**r.score)
    for i, t in zip(other, tests, strict=True):
        assert math.log10(np.mean(got[i])) == pytest.approx(sum(math.log10(p[x] / total) for x in tokens(t)), abs=0.06)


def test_lm_whatever_the_blocks(spark, sample, monkeypatch):
    """Scores don't depend on blocks, buckets and partitions."""
    from voxelith.llm import blocks

    df = spark.createDataFrame(sample[["doc_id", "text"]])
    want = {r.doc_id: r.score for r in pitmanyor.score(df).collect()}
    monkeypatch.setattr(blocks, "LEAST_BYTES", 1 << 15)
    monkeypatch.setattr(blocks, "RUN_KEYS", 50)
    assert {r.doc_id: r.score for r in pitmanyor.score(df.repartition(2)).collect()} == pytest.approx(want, rel=1e-12)


def test_lm(spark, docs, empty, sample):
    for table, rows in ((docs, pairs()), (spark.createDataFrame(sample[["doc_id", "text"]]), list(zip(sample.doc_id, sample.text, strict=True)))):
        tokens = [[*brute.words(brute.lower(t)), None] for _, t in rows]
        train = [zlib.crc32(b"" if i is None else str(int(i)).encode()) % 7 != 2 for i, _ in rows]
        c = Counter(w for t, on in zip(tokens, train, strict=True) for w in t if on)
        n, v = sum(c.values()), len(c)
        want = Counter((i, not on, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 5)) for (i, _), t, on in zip(rows, tokens, train, strict=True))
        got = pitmanyor.score(table).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
        assert all(r.score < 0 and r.perplexity >= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    again = pitmanyor.score(table.repartition(3)).collect()
    assert {r.doc_id: r.score for r in got} == pytest.approx({r.doc_id: r.score for r in again})
    assert pitmanyor.score(empty).count() == 0


def test_queries_have_sql_or_none():
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_hashes_of_edited_text(spark, sample):
    got = {r.doc_id: r for r in queries.op7_syncmer_fingerprints(spark, SF).collect()}
    texts = list(sample.text)
    for k, i in enumerate(sample.doc_id):
        a, b = texts[k], texts[(k + 1) % len(texts)]
        cut = len(a) // 4
        assert got[i].edited_sha256 == hashlib.sha256((a[: len(a) - cut] + b[:cut]).encode()).hexdigest()
    long = [r for r in got.values() if r.n_chars > 400]
    assert np.median([r.near_edited for r in long]) > 0.5 and max(r.near_next for r in got.values() if r.near_next < 1) < 0.5
