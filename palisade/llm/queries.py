"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, jaccard_join, language, pieces, quality, secrets, sharding, substring_dedup

#: A public SentencePiece vocabulary; it stays where it is.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"), length=13, digest_only=True)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept_text").alias("kept_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model: str = VOCABULARY) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = pieces.encoded(docs, pieces.Pieces.load(model), check="round_trip")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_rows(_table(spark, sf_dir, "documents"), [1.0] * 16, grown=1.0)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _transcript_text(style: Column) -> Column:
    """A turn as it stands in a transcript: one of five marker styles, the last with blank lines only."""
    role, body = F.col("role"), F.coalesce(F.col("text"), F.lit(""))
    title = F.initcap(role)
    heading = F.when(role == "user", "Human").otherwise(title)
    letter = F.when(role == "user", "Q: ").when(role == "assistant", "A: ").otherwise("System: ")
    return (
        F.when(style == 0, F.concat(title, F.lit(": "), body))
        .when(style == 1, F.concat(F.lit("### "), heading, F.lit(":\n"), body))
        .when(style == 2, F.concat(letter, body))
        .when(style == 3, F.concat(F.lit("["), role, F.lit("] "), body, F.lit("\n")))
        .otherwise(F.concat(body, F.lit("\n")))
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's turns as recovered from a transcript without roles; fitted on the half that is not held out."""
    rows = _table(spark, sf_dir, "conversations")
    raw = _transcript_text(F.pmod(F.xxhash64("conv_id"), F.lit(5)))
    held_out = F.pmod(F.xxhash64("conv_id", F.lit("held out")), F.lit(2)) == 1
    model = chat.train(rows.filter(~held_out), raw)
    parts = chat.transcript_parts(rows.select("conv_id", "turn", raw.alias("text")))
    return chat.parse(parts, model).select("conv_id", "turn", "role", "rendered", held_out.alias("held_out"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs.filter(~language.held_out()))
    found = language.identify(docs, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    found = quality.graded(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return found.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= quality.KEEP).alias("kept"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), low AS (
  SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)
), cut AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM win JOIN low USING (s) WHERE doc_id > m
), word AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM word ANTI JOIN cut USING (doc_id, k) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), links AS (
  SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL)
  JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, v FROM reach JOIN links ON r = u
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


OP9_SQL = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), pats AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), hits AS (
  SELECT DISTINCT g.doc_id, g.i, p.n, p.item_id
  FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM pats) WHERE len(w) >= n)) g
  JOIN pats p ON g.p = p.p AND g.n = p.n
), cover AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def queries() -> dict:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_secret_scan": op2_secret_scan,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_sharding": op4_sharding,
        "op5_chat_format": op5_chat_format,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_language_id": op7_language_id,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_decontamination": op9_decontamination,
        "op10_quality_classifier": op10_quality_classifier,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": OP1_SQL,
        "op6_jaccard_join": OP6_SQL,
        "op8_exact_dedup": OP8_SQL,
        "op9_decontamination": OP9_SQL,
    }
