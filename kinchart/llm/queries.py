"""The named queries of this folder: each applies one operator, as in production, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinchart.llm import additive, id_store, language, middles, pieces
from kinchart.llm.odd_sketch import near_copies
from kinchart.llm.repeats import without_repeats
from kinchart.llm.repetition import repetition_coverage
from kinchart.llm.secrets import secret_spans, spans_text
from kinchart.llm.style_tree import main_text
from kinchart.llm.templates import leaks
from kinchart.llm.urls import judge_urls
from kinchart.llm.vector_codes import vector_codes


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_additive_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from the labels outside the held-out third."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = additive.train(docs, table(spark, folder, "labels"), _remainder(3) != 1)
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out")
    return additive.score(docs.select("doc_id", held_out, "text"), model)


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file: $TOKENIZERS, or the installed package."""
    import os

    folder = os.environ.get("TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_template_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that leak a benchmark item."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return leaks(docs, table(spark, folder, "benchmark")).drop("text_hash")


def op3_unigram_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to the text they came from."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = pieces.Vocabulary.load(tokenizer_file("piece_bpe_32k.model"))
    both = pieces.decode(pieces.encode(docs, model, keep_text=True), model)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return both.select("doc_id", "n_tokens", "n_byte_tokens", "ids", same.alias("round_trip"))


def op4_id_store(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, written as indexed shards and read back."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    shards = id_store.write(docs, tokenizer_file("word_bpe_49k.json"))
    return id_store.read(shards).withColumnRenamed("key", "doc_id")


def op5_output_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned outside the held-out fifth."""
    docs = table(spark, folder, "documents")
    model = language.train(docs.select("doc_id", "text", "lang"), _remainder(5) != 0)
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out")
    return language.predict(docs.select("doc_id", held_out, "text"), model)


def op6_odd_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_copies(table(spark, folder, "documents").select("doc_id", "text")).drop("text_hash")


def op7_style_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return main_text(table(spark, folder, "pages").select("page_id", "url", "html"))


def op8_url_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page address."""
    judged = judge_urls(table(spark, folder, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op9_entropy_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed forms and random-looking strings of every document."""
    found = secret_spans(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    ranks = F.transform("spans", lambda s: s["rank"])
    counts = [F.size(ranks) - F.size(F.array_remove(ranks, k)) for k in range(3)]
    return found.select(
        "doc_id",
        *[c.cast("long").alias(n) for c, n in zip(counts, ("n_assign", "n_access", "n_hex"))],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def op10_repetition_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return repetition_coverage(table(spark, folder, "documents").select("doc_id", "text"))


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of all vectors."""
    return vector_codes(table(spark, folder, "embeddings")).drop("label")


def op12_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in fill-in-middle form, and the text made whole again."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cut = middles.fill_in_middle(docs, keep_text=False)
    return cut.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(middles.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_sampled_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the strings of 400 bytes that occur twice in the corpus."""
    cut = without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    sizes = F.transform("spans", lambda s: s["end"] - s["start"])
    return cut.select(
        "doc_id", "n_bytes", F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}
