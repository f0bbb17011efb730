"""From documents to token ids: classify, dedup, decontaminate, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of docs, whatever these are and whatever they are called. In every stage a
null text counts as empty, and empty documents are judged like any others; texts of
any length are read whole; a null id comes after all others; an empty table gives an
empty one. Rows that repeat are judged alike by the first and the fourth stage and
stay or go together; the second keeps one row of each text, so later stages see none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import decontaminate, exact_dedup, jaccard_join, pieces, quality, shared

#: A public SentencePiece vocabulary; it stays where it is.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade is at least a half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept_rows(docs, quality.train(docs, labels))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id for each text, white-space runs apart."""
    return exact_dedup.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id in each group linked by a Jaccard similarity of 0.8 or more of five-word shingles."""
    return jaccard_join.first_rows(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than a twentieth of their words in windows of the benchmark."""
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the text's piece ids, their number, and whether they decode to the text."""
    rows = docs.select("doc_id", shared.text_or_empty().alias("text"))
    found = pieces.encoded(rows, pieces.Pieces.load(VOCABULARY), check="round_trip")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", sentencepiece),
]

#: The first stage is a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' rows in turn. Of what the stages write, only the last one's input is left, which the result reads."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, at = shared.settled(spark, lambda: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            shared.removed(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
