"""Checkable queries of the training-data operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesift.llm.common import UPPER, ascii_lower, documents, text_of
from tidesift.llm.exact_dedup import mark_copies
from tidesift.llm.line_dedup import deduplicate_lines
from tidesift.llm.lm_scores import score_texts
from tidesift.llm.packing import pack
from tidesift.llm.piece_counts import count_tokens
from tidesift.llm.quality_rules import judge
from tidesift.llm.simhash import near_groups
from tidesift.llm.tensor_minhash import near_sets
from tidesift.llm.token_files import new_path, read_tokens, write_tokens
from tidesift.llm.toxicity import fit_toxicity
from tidesift.llm.turn_repair import repair
from tidesift.llm.whitening import fit_whitening
from tidesift.llm.word_bpe import round_trip_digests
from tidesift.plans.registry import query

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

_LOWER_SQL = f"translate({{}}, '{UPPER}', '{UPPER.lower()}')"
_WORD_SQL = r"'[^\x20\x09-\x0D]+'"
_BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    "op6_quality_rules",
    rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD_SQL}) AS w FROM documents),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
l AS (
  SELECT doc_id, source, t, x, {_LOWER_SQL.format(f"trim(x, {_BLANKS_SQL})")} AS k
  FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, {_WORD_SQL})),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM l GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT t) AS n FROM l GROUP BY source),
often AS (
  SELECT l.source, k, max(doc_id) AS holder FROM l JOIN hosts ON l.source IS NOT DISTINCT FROM hosts.source
  GROUP BY l.source, k, n
  HAVING (count(DISTINCT t) >= 3 AND 100 * count(DISTINCT t) > 5 * n) OR count(DISTINCT t) > 1000),
lost AS (
  SELECT doc_id, sum(len(regexp_extract_all(k, {_WORD_SQL}))) AS n
  FROM (SELECT DISTINCT l.doc_id, l.k FROM l JOIN often o
        ON l.k = o.k AND l.source IS NOT DISTINCT FROM o.source AND l.doc_id <> o.holder)
  GROUP BY doc_id),
b AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(translate(t, {_BLANKS_SQL}, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(lost.n, 0) AS BIGINT) AS lost_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND NOT (lost_words > 0 AND (100 * (n_words - lost_words) < 40 * n_words OR n_words - lost_words < 20)) AS kept
FROM b""",
)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return judge(documents(spark, sf_dir)).drop("text_hash", "host")


@query(
    "op8_exact_dedup",
    f"""
WITH n AS (SELECT doc_id, {_LOWER_SQL.format("coalesce(text, '')")} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)""",
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its group that stays."""
    return mark_copies(documents(spark, sf_dir), text_sha256=F.sha2(ascii_lower(text_of()), 256))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2,048 ids."""
    return pack(documents(spark, sf_dir), BYTE_VOCABULARY)


@query("op7_token_files")
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written, then read back from the files."""
    path = new_path(spark)
    write_tokens(documents(spark, sf_dir), path, BYTE_VOCABULARY)
    return read_tokens(spark, path, with_ids=False)


@query("op5_word_bpe")
def op5_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return round_trip_digests(documents(spark, sf_dir), WORD_VOCABULARY)


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word pieces of all documents."""
    return count_tokens(documents(spark, sf_dir), BYTE_VOCABULARY)


@query("op1_simhash_near_dedup")
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return near_groups(documents(spark, sf_dir)).withColumn("fingerprint", digits)


@query(
    "op2_line_dedup",
    f"""
WITH l AS (
  SELECT doc_id, i, ls[i] AS x, {_LOWER_SQL.format(f"trim(ls[i], {_BLANKS_SQL})")} AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
often AS (
  SELECT k, max(doc_id) AS holder FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT doc_id, i, x, coalesce(doc_id <> holder, false) AS lost FROM l LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document before and after, and the digest of what is left."""
    return deduplicate_lines(documents(spark, sf_dir), digest=True)


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    docs = documents(spark, sf_dir)
    return fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).score(docs)


@query("op10_lm_scores")
def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return score_texts(documents(spark, sf_dir))


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with faults put in by checksum, nulls being one space, and how often each row stands there."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    fault = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    broken = turns.select(
        "conv_id",
        "turn",
        F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, F.lit(0)).when(fault == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"),
    )
    return broken, F.col("copies")


@query("op13_turn_repair")
def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation, after damage."""
    turns, copies = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair(turns, copies=copies)


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every usable vector, one row per component."""
    model = fit_whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    n = model.centre.n if model.centre else 0
    # at most eight numbers
    explained = F.array(*[F.lit(float(e) / model.trace) for e in model.variances]).cast("array<double>")
    return model.rows().select(
        "vec_id", "deviation", F.lit(n).cast("long").alias("n"), F.posexplode("whitened").alias("place", "whitened")
    ).select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        "whitened",
        F.element_at(explained, F.col("place") + 1).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


@query("op11_minhash_near_dedup")
def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document at Jaccard 0.85 of three-word shingles."""
    return near_sets(documents(spark, sf_dir))
