"""Line dedup without moving text: one hash row a line, one bitmap a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelith.llm.common import SPACE_CHARS, ascii_lower, shuffle_partitions, unused

#: A line's occurrences are dealt to so many groups by document, so that a very common line is no single task's.
SALTS = 64
#: Bits of a hash that make its range.
RANGE_BITS = 16
FIRST_ID = -(1 << 63)


def _keyed(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row for each line with a long enough key: two hashes of the key, document, text and position."""
    line = F.btrim(F.col("line"), F.lit(SPACE_CHARS))
    return (
        docs.select(
            F.coalesce("doc_id", F.lit(FIRST_ID)).alias("did"),
            F.xxhash64("text").alias("tid"),
            F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"),
        )
        .select("did", "tid", "pos", line.alias("line"))
        .where(F.char_length("line") >= min_chars)
        .select("did", "tid", "pos", ascii_lower(F.col("line")).alias("line"))
        .select("did", "tid", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))
    )


def dropped_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Bitmaps of the lines to drop: (did, tid, n_dropped, words), a row for each document that loses a line.

    ``words`` maps 64-line words to their bits, and holds only words with a bit set. Lines
    are partitioned by range of hash and salt, sorted by document and position, and streamed:
    what is not of a group's first document goes. Hashes are even, so that their ranges are cut
    by arithmetic and no sample is taken. The one document left of each salt then
    meets the others of its hash, at most SALTS of them.
    A null doc_id ranks before all others; rows of one doc_id count as one document.
    """
    n = shuffle_partitions(docs.sparkSession)
    lines = _keyed(docs, min_chars).withColumn("salt", F.pmod(F.xxhash64("did"), F.lit(SALTS)).cast("int"))
    within = Window.partitionBy("range", "salt", "h1", "h2").orderBy("did", "pos").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("h1", "h2").orderBy("did", "pos").rowsBetween(Window.unboundedPreceding, 0)
    ranged = lines.withColumn("range", F.shiftrightunsigned("h1", 64 - RANGE_BITS).cast("int")).repartition(n, "range", "salt")
    streamed = ranged.withColumn("first", F.first("did").over(within))
    later = streamed.where("did <> first")
    kept = streamed.where("did = first").withColumn("first", F.first("did").over(across)).where("did <> first")
    bits = (
        later.unionByName(kept)
        .groupBy("did", "tid", F.shiftright("pos", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    )
    return bits.groupBy("did", "tid").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Every row of docs with n_lines, n_dropped, drop_words (null: none dropped) and kept_text.

    Lines are split at \\n; a null or empty text is one empty line. A line's key is the line
    without white space at its ends, A-Z in lower case; shorter keys than ``min_chars`` code
    points always stay. Of the others only the smallest doc_id keeps its lines, repeats
    included. Other columns of docs pass through, whatever their names, except the four added.
    """
    own = docs.drop("n_lines", "n_dropped", "drop_words", "kept_text")
    did, tid, count, found = unused(own, "did", "tid", "count", "found")
    drops = dropped_lines(docs.select("doc_id", "text"), min_chars).select(F.col("did").alias(did), F.col("tid").alias(tid), F.col("n_dropped").alias(count), F.col("words").alias(found))
    text = F.coalesce("text", F.lit(""))
    keys = (F.coalesce(F.col("doc_id"), F.lit(FIRST_ID)) == F.col(did)) & (F.xxhash64("text") == F.col(tid))
    dense = F.transform(F.sequence(F.lit(0), F.shiftright(F.col("n_lines").cast("int") - 1, 6)), lambda k: F.coalesce(F.col(found)[k], F.lit(0).cast("long")))
    joined = (
        own.join(drops, keys, "left")
        .withColumn("n_lines", F.size(F.split(text, "\n")).cast("long"))
        .withColumn("drop_words", F.when(F.col(count).isNotNull(), dense))
    )
    kept = F.filter(F.split(text, "\n"), lambda _, i: F.call_function("getbit", F.get("drop_words", F.shiftright(i, 6)), i.bitwiseAND(F.lit(63))) == 0)
    return joined.select(
        *[F.col(c) for c in own.columns],
        "n_lines",
        F.coalesce(count, F.lit(0)).cast("long").alias("n_dropped"),
        "drop_words",
        F.when(F.col("drop_words").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
