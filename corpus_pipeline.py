"""Documents made ready for training: five stages, each on all that the one before it kept.

Defined cases, alike in all stages: an empty table gives an empty table; a null text counts as an empty one; very
long texts are treated as wholes, never cut; columns beyond those of ``documents`` are kept up to the last stage,
whatever their names; rows with a null ``doc_id`` are rows like others.  What a stage does with ties and repeated
rows is told with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinchart.llm import pieces
from kinchart.llm.common import stored
from kinchart.llm.odd_sketch import without_near_copies
from kinchart.llm.queries import table, tokenizer_file
from kinchart.llm.repetition import passes
from kinchart.llm.secrets import without_secrets
from kinchart.llm.templates import without_leaks


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat themselves, or are too short, go.

    Too short is fewer than fifty words: null, empty and blank texts go, and so do clean documents of a sentence or
    two.  Repeated rows and ties do not matter: each row is judged by its own text.
    """
    return passes(docs)


#: Per cent of their shingles that near copies share; the query op6_ has a threshold of its own.
NEAR_PERCENT = 80


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the smallest id.

    Of repeated rows of that document one stays; a document with a null id stays only where its group has no other;
    documents without words are copies of nothing and stay.  Where one id has several texts, each text is judged alone.
    """
    return without_near_copies(docs, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go, all of their rows; documents without words leak nothing and stay."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, overlapping ones by one mask; all documents and rows stay, null texts as null."""
    return without_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text; a null or empty text has none."""
    words = pieces.Vocabulary.load(tokenizer_file("piece_bpe_32k.model"))
    both = pieces.decode(pieces.encode(docs.select("doc_id", "text"), words, keep_text=True), words)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return both.select("doc_id", "n_tokens", "n_byte_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("piece_ids", piece_ids),
]

#: SQL has no unigram lattice; tests/llm compares the rows with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
