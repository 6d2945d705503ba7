"""Document fingerprints from closed syncmers: anchors that depend on no context, matched with their distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.llm.common import let, shuffle_partitions

#: A piece of a text: up to three characters that end none, then one more. White space is in no piece, and ASCII vowels,
#: digits and all beyond ASCII end one, so pieces fall in step again soon after any change, in scripts without spaces too.
PIECE = r"[^\x20\x09-\x0DaeiouAEIOU0-9\x{80}-\x{10FFFF}]{0,3}[^\x20\x09-\x0D]"
#: Pieces of an anchor, pieces of its inner substrings, bits of an anchor's hash.
K, S, ANCHOR_BITS = 8, 3, 20
FIRST_ID = -(1 << 63)
_HASH = (1 << ANCHOR_BITS) - 1


def anchors(text: Column) -> Column:
    """array<bigint> of a text's closed syncmers in order: start << 20 | hash, both of its pieces.

    K pieces are an anchor if the least hash of their S-piece substrings is the first or the last
    one's, which no piece outside can change. Anchors start at most K - S pieces apart. A text
    with pieces but without anchors, such as a shorter one, has one at 0: the hash of all its
    pieces. Null, empty and blank texts have none.
    """
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))

    def of(p: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(p) - S), lambda i: F.xxhash64(*[F.get(p, i + j) for j in range(S)]))

        def pick(g: Column) -> Column:
            def anchor(first: Column, i: Column) -> Column:
                inner = F.least(*[F.get(g, i + j) for j in range(1, K - S)])
                covered = [*range(0, K - S, S), K - S]  # substrings that hold all pieces between them
                whole = F.xxhash64(*[F.get(g, i + j) for j in covered])
                return F.when(F.least(first, F.get(g, i + (K - S))) <= inner, F.shiftleft(i.cast("bigint"), ANCHOR_BITS).bitwiseOR(whole.bitwiseAND(F.lit(_HASH))))

            return F.array_compact(F.transform(F.slice(g, 1, F.size(p) - K + 1), anchor))

        one = F.array(F.xxhash64(F.array_join(p, " ")).bitwiseAND(F.lit(_HASH)))
        found = F.when(F.size(p) >= K, let(grams, pick))
        return F.when(F.size(p) == 0, F.array().cast("array<bigint>")).otherwise(let(found, lambda a: F.when(F.size(a) > 0, a).otherwise(one)))

    return let(pieces, of)


def links(made: Column) -> Column:
    """Each anchor's link to the one before: that one's hash, the distance in pieces and its own hash; the first one's distance is to the start."""

    def link(x: Column, j: Column) -> Column:
        back = F.coalesce(F.get(made, j - 1), F.lit(0).cast("bigint"))
        gap = F.shiftright(x, ANCHOR_BITS) - F.shiftright(back, ANCHOR_BITS)
        return F.shiftleft(back.bitwiseAND(F.lit(_HASH)), ANCHOR_BITS + 4).bitwiseOR(F.shiftleft(gap, ANCHOR_BITS)).bitwiseOR(x.bitwiseAND(F.lit(_HASH)))

    return F.transform(made, link)


def sketch(text: Column) -> Column:
    """The links of a text's anchors, of its whole length. Equal texts give equal sketches."""
    return let(anchors(text), links)


def fingerprint(made: Column) -> Column:
    """A sketch as a string: for each anchor a hex digit of its distance and five of its hash, so that all can be read from it."""
    return F.lower(F.array_join(F.transform(made, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit((1 << ANCHOR_BITS + 4) - 1))), ANCHOR_BITS // 4 + 1, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """The share of links in common among all distinct links of two sketches, 0 to 1; 1 for two empty ones.

    A link is in common where both texts have the same two anchors at the same distance: a run
    of these is a chain of anchors at one shift between the texts.
    """
    shared, apart = F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(let(shared, lambda n: (n / (apart - n)).cast("double")))


def with_next(docs: DataFrame, made: dict[str, Column]) -> DataFrame:
    """(doc_id, text) of docs, the columns of ``made``, and text and these, as ``next_<name>``, of the row that follows by (doc_id, text); the first follows the last.

    Ids are cut at approximate quantiles into ranges, and each range is a window. The first
    row of a range is also sent to the range before, so that rows are shuffled once. The cuts
    and the first ids, a few for each partition, are all that the driver sees. A null id ranks first.
    """
    n = 4 * shuffle_partitions(docs.sparkSession)
    did = F.coalesce(F.col("doc_id"), F.lit(FIRST_ID))
    ids = docs.select(did.alias("did"))
    cuts = sorted(set(ids.agg(F.percentile_approx("did", [k / n for k in range(1, n)], max(10_000, 10 * n)).alias("q")).first()["q"] or [0]))
    known = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = F.array(*[F.lit(1 << j) for j in reversed(range(len(cuts).bit_length()))])

    def range_of(x: Column) -> Column:
        up = lambda at, st: F.when(F.get(known, at + st - 1) <= x, at + st).otherwise(at)
        return F.aggregate(steps, F.lit(0), up)

    firsts = [tuple(r) for r in ids.select(range_of(F.col("did")).alias("r"), "did").groupBy("r").agg(F.min("did")).orderBy("r").collect()]
    before = dict(zip([r for r, _ in firsts], [firsts[-1][0], *[r for r, _ in firsts[:-1]]] if firsts else [], strict=True))
    lead_id = {r: d for r, d in firsts}
    size = len(cuts) + 1
    first_of = F.array(*[F.lit(lead_id.get(r)).cast("long") for r in range(size)])
    range_before = F.array(*[F.lit(before.get(r)).cast("int") for r in range(size)])
    wraps = F.lit(firsts[0][0] if firsts else 0)
    own = docs.select("doc_id", "text", did.alias("did"), range_of(did).alias("r"))
    place = lambda r, ghost, late: F.struct(r.alias("r"), ghost.alias("ghost"), late.alias("late"))
    here = place(F.col("r"), F.lit(False), F.lit(False))
    there = place(F.get(range_before, F.col("r")), F.lit(True), F.col("r") == wraps)
    sent = own.withColumn("p", F.explode(F.when(F.col("did") == F.get(first_of, F.col("r")), F.array(here, there)).otherwise(F.array(here))))
    order = ["late", "did", "text", "ghost"]
    dealt = sent.select("doc_id", "text", "did", F.col("p.r").alias("range"), F.col("p.ghost").alias("ghost"), F.col("p.late").alias("late")).repartition(n // 4, "range").sortWithinPartitions("range", *order)
    # Made after the exchange, so that only texts are sent.
    window = Window.partitionBy("range").orderBy(*order)
    columns = ["text", *made]
    following = [F.lead(c).over(window).alias(f"next_{c}") for c in columns]
    return dealt.select("*", *[m.alias(c) for c, m in made.items()]).select("*", *following).where(~F.col("ghost")).select("doc_id", *columns, *[f"next_{c}" for c in columns])


def edited_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, text, made, next_text, next_made, edited) for every row; null text counts as empty.

    ``edited`` is the text with its last quarter of code points, rounded down, replaced by as
    many from the start of the next row's text, or all of that; ``made`` are sketches. Rows are in
    order of doc_id and text, a null id first; equal rows follow each other. Other columns of
    docs are left out. Rows of one doc_id are sorted by one task.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    return with_next(rows, {"made": sketch(F.col("text"))}).withColumn("edited", edited)
