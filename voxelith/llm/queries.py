"""One query for each operator, over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.llm.cotrain import classify
from voxelith.llm.html import extract_main_text
from voxelith.llm.lines import dedup_lines
from voxelith.llm.mixing import mix_plan
from voxelith.llm.pitmanyor import score as lm_score
from voxelith.llm.pieces import encode
from voxelith.llm.quality import RULES, STOP_WORDS, quality_rules
from voxelith.llm.simhash import near_duplicates
from voxelith.llm.substring import dedup_substrings
from voxelith.llm.syncmers import edited_pairs, fingerprint, likeness, sketch

#: A public SentencePiece model; read on the driver only.
PIECES_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rule_sql() -> str:
    terms = [(a, b, least, most) for a, b, least, most in RULES.values()]
    bounds = [f"({b} > 0 AND {a} < CAST({least!r} AS DOUBLE) * {b})" for a, b, least, _ in terms if least is not None]
    bounds += [f"({b} > 0 AND {a} > CAST({most!r} AS DOUBLE) * {b})" for a, b, _, most in terms if most is not None]
    return " OR ".join(bounds)


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_Q = "'"


@query(
    rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
 g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
 twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
 r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) t(k) GROUP BY doc_id),
 c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
   CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
   CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
   len(list_filter(w, lambda x: x IN ({", ".join(_Q + x + _Q for x in sorted(set(STOP_WORDS)))}))) AS n_stop_words,
   len(list_filter(w, lambda x: suffix(x, '!!'))) AS n_loud, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
   FROM d LEFT JOIN r USING (doc_id)),
 b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {_rule_sql()}) AS kept FROM b"""
)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_rows(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query(
    r"""
WITH l AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
   FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
 f AS (SELECT *, length(k) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY k) AS gone FROM l)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id"""
)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_rows(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_rows(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 k AS (SELECT doc_id, i, sha256(array_to_string(w[i + 1 : i + 35], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 34)) AS i FROM d)),
 c AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY s) > 1), range(35) r(j)),
 x AS (SELECT doc_id, w[p + 1] AS x, p FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS p FROM d)),
 g AS (SELECT x.doc_id, count(*) AS n_words, count(c.p) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY x.p) FILTER (c.p IS NULL), '') AS kept
   FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.p = c.p GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""
)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_rows(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(_rows(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode(_rows(spark, sf_dir, "documents").select("doc_id", "text"), PIECES_MODEL, changes_only=True)
    return made.select("doc_id", "ids", "n_pieces", "score", "second_score", "others", F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


@query()
def op7_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = edited_pairs(_rows(spark, sf_dir, "documents")).withColumn("edited_made", sketch(F.col("edited")))
    return pairs.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("made")).alias("fingerprint"),
        fingerprint(F.col("edited_made")).alias("edited_fingerprint"),
        likeness(F.col("made"), F.col("edited_made")).alias("near_edited"),
        likeness(F.col("made"), F.col("next_made")).alias("near_next"),
    )


@query()
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_rows(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query()
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(_rows(spark, sf_dir, "documents")).drop("perplexity")


@query()
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = classify(_rows(spark, sf_dir, "documents"), _rows(spark, sf_dir, "labels"))
    return made.withColumnRenamed("quality", "kept")
