from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm import brute
from voxelith.llm.pieces import Pieces

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    """Every stage on the rows that its predecessor kept, against plain statements of what it does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = [r.asDict() for r in out.collect()]
        made[name] = ([r.asDict() for r in docs.collect()], rows)
        if name != "sentencepiece":
            assert out.columns == COLUMNS and all(r["n_chars"] == len(r["text"]) for r in rows)
            docs = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], docs.select(COLUMNS).schema)

    before, after = made["quality_rules"]
    kept = {r["doc_id"] for r in after}
    for r in before:
        n, chars, symbols, _, again = brute.quality(r["text"])
        if n < 50 or 100 * again > 50 * n or symbols > 0.2 * n:
            assert r["doc_id"] not in kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    long = {r["doc_id"] for r in before if brute.quality(r["text"])[0] >= 50}
    assert all(i in kept for i, q in labels.items() if q == 1 and i in long)

    before, after = made["line_dedup"]
    assert {(r["doc_id"], r["text"]) for r in after} == {(i, t) for i, _, _, t in brute.kept_lines([(r["doc_id"], r["text"]) for r in before])}

    before, after = made["simhash_near_dedup"]
    sets = []
    for r in before:
        w = brute.words(brute.lower(r["text"]))
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    ids = {r["doc_id"] for r in after}
    assert all(sum(before[k]["doc_id"] in ids for k in g) <= 1 for g in brute.groups(len(before), lambda a, b: like(a, b) >= 0.8))
    assert all(any(before[k]["doc_id"] in ids for k in g) for g in brute.groups(len(before), lambda a, b: like(a, b) >= 0.5))

    before, after = made["mix_sources"]
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r["source"]] += len(brute.words(r["text"]))
    for r in after:
        taken[r["source"]] += len(brute.words(r["text"]))
    want = brute.targets(dict(sorted(sizes.items())))
    assert all(abs(taken[s] - t) <= 0.02 * t + 40 for s, t in want.items())
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3

    before, after = made["sentencepiece"]
    p = Pieces.load(corpus_pipeline.PIECES_MODEL)
    assert Counter((r["doc_id"], p.decode(r["ids"])) for r in after) == Counter((r["doc_id"], r["text"]) for r in before)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 20 and {"doc_id", "text", "ids", "score"} <= set(rows.columns)
