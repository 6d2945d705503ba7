"""Mixing sources to target weights: entropy balancing over documents, then rounding into copies by error diffusion."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelith.llm.common import checkpointed, shuffle_partitions, unused, words

#: Newton's steps between two checkpoints, the most turns of these, and the relative error of a source's tokens that ends them.
STEPS, TURNS, TOLERANCE = 4, 25, 1e-9
#: Bits of a row's hash that cut the documents of one source and size into runs, so that no run of equal documents is one task's.
RUN_BITS = 9
#: Sizes of a source, the smallest, that even out what rounding left.
LAST = 64
SOURCE = ["sn", "sk"]


def _numbered(sources: DataFrame) -> DataFrame:
    """Sources with their number in order of name: ranges are numbered apart, and only their sizes come to the driver."""
    n = shuffle_partitions(sources.sparkSession)
    dealt = checkpointed(sources.repartitionByRange(n, *SOURCE).withColumn("range", F.spark_partition_id()))
    sizes = {r["range"]: r["count"] for r in dealt.groupBy("range").count().collect()}
    before = [sum(sizes.get(k, 0) for k in range(r)) for r in range(max(sizes, default=0) + 1)]
    offset = F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.col("range"))
    return dealt.withColumn("number", offset + F.row_number().over(Window.partitionBy("range").orderBy(*SOURCE)) - 1).drop("range")


def source_targets(hist: DataFrame, weights: tuple[int, ...], max_copies: int) -> DataFrame:
    """(sn, sk, source_size, target) of every source of ``hist`` (sn, sk, size, n).

    The level is what one unit of weight gets. It starts at the share of all and goes up while
    sources at their cap leave some over; two sums are all that the driver sees.
    """
    sources = hist.groupBy(*SOURCE).agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    cap, w = (F.col("source_size") * max_copies).cast("double"), F.col("w")
    weight = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("number") % len(weights)).cast("int"))
    weighed = checkpointed(_numbered(sources).withColumn("w", weight).select(*SOURCE, "source_size", "w"))
    total, all_weights = weighed.agg(F.sum("source_size"), F.sum("w")).first()
    level = (total or 0) / (all_weights or 1)
    while True:
        full, left = weighed.agg(F.sum(F.when(w * level > cap, cap)), F.sum(F.when(w * level <= cap, w))).first()
        if not full or not left or (new := (total - full) / left) <= level:
            break
        level = new
    return weighed.select(*SOURCE, "source_size", F.least(cap, w * (level if left else math.inf)).alias("target"))


def solve(hist: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """targets with ``tilt``: the dual value of each source's token constraint.

    The rates of least relative entropy to one copy a document that keep the constraint are
    min(max_copies, exp(tilt * size)). Newton's steps on the logarithm of a source's tokens run
    for all sources at once over the counts of sizes; each is an aggregate by source, and the
    step is halved into the bracket where it would leave it.
    """
    log, top = F.log(F.col("target")), math.log(max_copies)
    some = (F.col("source_size") > 0) & (F.col("target") > 0)
    full = F.col("target") >= max_copies * F.col("source_size")
    down = F.col("target") < F.col("source_size")
    state = targets.select(
        *SOURCE,
        "source_size",
        "target",
        F.when(some & ~full, F.lit(0.0)).otherwise(F.lit(top)).alias("tilt"),
        F.when(down, log - F.log("source_size")).otherwise(F.lit(0.0)).alias("low"),
        F.when(down, F.lit(0.0)).otherwise(F.lit(top)).alias("high"),
        (some & ~full & (F.col("target") != F.col("source_size"))).alias("open"),
    )
    size = F.col("size").cast("double")
    exact = lambda x: F.sum(x.cast("decimal(28,6)")).cast("double")  # noqa: E731  # the same in every order of rows
    for _ in range(TURNS):
        for _ in range(STEPS):
            x = F.col("tilt") * size
            tokens = F.col("n") * size * F.least(F.lit(float(max_copies)), F.exp(F.least(x, F.lit(top))))
            sums = hist.where("size > 0").join(state.where("open").select(*SOURCE, "tilt"), SOURCE).groupBy(*SOURCE).agg(exact(tokens).alias("f"), exact(F.when(x < top, tokens * size).otherwise(F.lit(0.0))).alias("g"))
            over = F.col("f") >= F.col("target")
            low, high = F.when(over, F.col("low")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("high"))
            step = F.when(F.col("g") > 0, F.col("tilt") - (F.log("f") - log) * F.col("f") / F.col("g"))
            inside = step.isNotNull() & (step >= low) & (step <= high)
            done = F.abs(F.col("f") / F.col("target") - 1) <= TOLERANCE
            moved = F.when(done, F.col("tilt")).when(inside, step).otherwise((low + high) / 2)
            state = state.join(sums, SOURCE, "left").select(
                *SOURCE, "source_size", "target", *[F.when(F.col("open") & F.col("f").isNotNull(), new).otherwise(F.col(old)).alias(old) for old, new in (("tilt", moved), ("low", low), ("high", high))], (F.col("open") & F.col("f").isNotNull() & ~done).alias("open")
            )
        state = checkpointed(state)
        if not state.where("open").take(1):
            break
    return state.select(*SOURCE, "source_size", "target", "tilt")


def _nearer(size: np.ndarray, n: np.ndarray, taken: np.ndarray, owed: float, max_copies: int) -> np.ndarray:
    """``taken`` with one copy more or less of one size or of two, over and over, while that lessens what is owed."""
    taken = taken.copy()
    while abs(owed) > 0.5:
        up, down = np.flatnonzero((taken < max_copies * n) & (size > 0)), np.flatnonzero((taken > 0) & (size > 0))
        at, by = np.concatenate([up, down, [0]]), np.concatenate([np.ones(len(up), np.int64), -np.ones(len(down), np.int64), [0]])
        moves = by * size[at]
        both = np.abs(owed - moves[:, None] - moves[None, :])
        both[(at[:, None] == at[None, :]) & (by[:, None] != 0) & (by[None, :] != 0)] = np.inf
        i, j = np.unravel_index(np.argmin(both), both.shape)
        if both[i, j] >= abs(owed):
            break
        for k in (i, j):
            taken[at[k]] += by[k]
            owed -= moves[k]
    return taken


def _diffuse(frames: Iterator[pd.DataFrame], max_copies: int) -> Iterator[pd.DataFrame]:
    """Copies that all documents of a source and size get together, from the largest size to the smallest.

    Each size takes its rate's share and what the larger ones left, rounded. Only the sum that a
    source owes is carried over, and its smallest sizes so far, LAST of them: at the end of a
    source, these give and take single copies while that brings it nearer to its target.
    """
    source, owed, last = None, 0.0, []

    def emit(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["sn", "sk", "size", "n", "taken"])

    def close() -> list[tuple]:
        if not last:
            return []
        size, n, taken = (np.array([r[k] for r in last], np.int64) for k in (2, 3, 4))
        return [(*r[:4], int(t)) for r, t in zip(last, _nearer(size, n, taken, owed, max_copies), strict=True)]

    for frame in frames:
        out: list[tuple] = []
        for sn, sk, size, n, rate in zip(frame["sn"], frame["sk"], frame["size"].tolist(), frame["n"].tolist(), frame["rate"].tolist(), strict=True):
            if (sn, sk) != source:
                out += close()
                source, owed, last = (sn, sk), 0.0, []
            owed += size * n * rate
            taken = min(max(round(owed / size), 0), max_copies * n) if size else n
            owed -= size * taken
            last.append((sn, sk, size, n, taken))
            if len(last) > 2 * LAST:
                out += last[:-LAST]
                last = last[-LAST:]
        yield emit(out)
    yield emit(close())


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """(k1, k2, doc_id, size, source_size, target, rate, copies, taken) for every row of docs.

    Size: words of the text, 0 for null. Sources by code point, null last, weigh ``weights``
    in turn; targets share all sizes by weight and stop at ``max_copies`` times their source.
    Rates are exp(tilt * size), at most max_copies, with the tilt that brings a source's
    tokens to its target (``solve``). They become copies from the largest size to the smallest;
    sizes carry over what rounding left, and the smallest ones give and take single copies at
    the end, so that a source ends as near to its target as one change or two can bring it. Of
    documents of one size those of the smaller hashes k1, k2 of id, text and source get one copy
    more; equal rows can't be told apart, so reruns agree. Texts without words are taken once, at no words.
    Empty table: no rows.
    """
    key = [F.col("doc_id"), F.col("text"), F.col("source")]
    n = shuffle_partitions(docs.sparkSession)
    rows = checkpointed(
        docs.select(
            F.xxhash64(*key).alias("k1"),
            F.xxhash64(F.lit(7), *key).alias("k2"),
            "doc_id",
            F.col("source").isNull().cast("int").alias("sn"),
            F.coalesce("source", F.lit("")).alias("sk"),
            F.size(words(F.col("text"))).cast("long").alias("size"),
        )
    )
    hist = checkpointed(rows.groupBy(*SOURCE, "size").agg(F.count(F.lit(1)).alias("n")))
    solved = checkpointed(solve(hist, source_targets(hist, weights, max_copies), max_copies))
    rate = F.least(F.lit(float(max_copies)), F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(math.log(max_copies) + 1)))).alias("rate")
    rated = hist.join(solved.select(*SOURCE, "tilt"), SOURCE).select(*SOURCE, "size", "n", rate)
    dealt = rated.repartition(n, *SOURCE).sortWithinPartitions(*SOURCE, F.col("size").desc())
    taken = dealt.mapInPandas(lambda frames: _diffuse(frames, max_copies), "sn int, sk string, size long, n long, taken long")
    same = [*SOURCE, "size"]
    run = F.shiftrightunsigned("k1", 64 - RUN_BITS).cast("int").alias("run")
    runs = rows.groupBy(*same, run).agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*same).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = (
        runs.withColumn("before", before)
        .join(taken, same)
        .join(solved, SOURCE)
        .select(*same, "run", "source_size", "target", rate, F.floor(F.col("taken") / F.col("n")).alias("whole"), (F.col("taken") % F.col("n") - F.col("before")).alias("more"))
    )
    rank = F.row_number().over(Window.partitionBy(*same, "run").orderBy(F.shiftrightunsigned("k1", 1), "k1", "k2"))
    copies = (F.col("whole") + (F.col("rank") <= F.col("more")).cast("int")).cast("long")
    return (
        rows.select("*", run)
        .withColumn("rank", rank)
        .join(shares, [*same, "run"])
        .withColumn("copies", copies)
        .select("k1", "k2", "doc_id", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with docs' own columns, whatever their names."""
    key = [F.col("doc_id"), F.col("text"), F.col("source")]
    k1, k2, list_, row, copy = unused(docs, "k1", "k2", "copies", "row", "copy")
    plan = mix_plan(docs.select("doc_id", "text", "source"), weights, max_copies)
    copies = plan.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.sort_array(F.collect_list("copies"), asc=False).alias(list_))
    own = docs.withColumn(k1, F.xxhash64(*key)).withColumn(k2, F.xxhash64(F.lit(7), *key))
    own = own.withColumn(row, F.row_number().over(Window.partitionBy(k1, k2).orderBy(k1)))
    taken = own.join(copies, [k1, k2]).withColumn(list_, F.element_at(list_, F.col(row)).cast("int")).where(F.col(list_) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(list_)))).select(*[F.col(c) for c in docs.columns])
