"""The two background jobs as a whole, for all touched records or users at once.

``process_documents`` takes the words two recognition engines found in uploaded documents to entities,
prescriptions and finished records; ``refresh_profiles`` takes scored users to predictions and profiles.
Both return new tables and are the bodies of the streams as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinchart.functions import columns as C
from kinchart.operators import extract as X
from kinchart.operators import maintain as M
from kinchart.operators import ocr as O


def recognised_texts(words: DataFrame) -> DataFrame:
    """(doc_id, raw_text, overall_confidence, page_count) from the word tables of both engines."""
    merged = O.merge_ocr_words(words)
    confidence = O.document_confidence(merged, keys=("doc_id", "page")).withColumnRenamed("overall_confidence", "confidence")
    pages = O.reading_order_text(merged).join(confidence, ["doc_id", "page"])
    return O.merge_pages(pages)


def _entity_rows(done: DataFrame) -> DataFrame:
    rows = X.explode_entities(done, "record_id")
    shown = F.coalesce(F.when(F.col("text") != "", F.col("text")), F.when(F.col("normalized") != "", F.col("normalized")), F.lit(""))
    return rows.select(
        "record_id",
        "ord",
        C.canonical_entity_type("type").alias("entity_type"),
        shown.alias("entity_value"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        "icd10_code",
        "atc_code",
        F.col("start").alias("start_index"),
        F.col("end").alias("end_index"),
    )


def process_documents(
    records: DataFrame, words: DataFrame, entities: DataFrame, prescriptions: DataFrame, as_of, min_confidence: float = 0.60
) -> dict[str, DataFrame]:
    """Tables after the recognised words (doc_id is the record's id) have gone through the whole upload job.

    ``records``: text, confidence, status (done, or failed where no word was found) and, where it was
    missing, the date of the processed ones; others as they were.  ``entities`` and ``prescriptions``:
    those of processed records replaced.  ``texts``: the processed records with text and ``entities`` array.
    """
    texts = recognised_texts(words).withColumnRenamed("doc_id", "record_id")
    done = X.extract_documents(texts, "raw_text", min_confidence, fix_text=True)
    found = _entity_rows(done)
    kinds = records.filter(F.col("record_type") == "prescription").select(F.col("id").alias("record_id"), "owner_id")
    parts = X.prescription_rows(X.structured_prescription(done, as_of, "raw_text"))
    fresh = parts.join(kinds, "record_id").select(
        "record_id", "owner_id", "diagnosis", "icd10_code", "prescription_date", "medicines", "notes"
    )
    read = texts.select(F.col("record_id").alias("id"), "raw_text", "overall_confidence").join(
        fresh.select(F.col("record_id").alias("id"), "prescription_date"), "id", "left"
    )
    touched = F.col("raw_text").isNotNull()
    base = [c for c in records.columns if c not in ("raw_ocr_text", "confidence_score", "extraction_status", "record_date")]
    finished = records.join(read, "id", "left").select(
        *base,
        F.coalesce("record_date", "prescription_date").alias("record_date"),
        F.when(touched, "done").otherwise(F.col("extraction_status")).alias("extraction_status"),
        F.when(touched, F.col("overall_confidence")).otherwise(F.col("confidence_score")).alias("confidence_score"),
        (F.coalesce("raw_text", "raw_ocr_text") if "raw_ocr_text" in records.columns else F.col("raw_text")).alias("raw_ocr_text"),
    )
    processed = texts.select("record_id")
    return {
        "records": finished,
        "entities": M.replace_entities(entities, found, processed),
        "prescriptions": M.replace_entities(prescriptions, fresh, processed),
        "texts": done,
    }


def refresh_profiles(
    scored: DataFrame, predictions: DataFrame, profiles: DataFrame, updated_at: Column, disease: str | None = None
) -> dict[str, DataFrame]:
    """Predictions and profiles after users have been scored (``scored`` is what the profile build returns).

    Earlier active predictions of the same user and disease are switched off and the new ones added;
    the profile of a scored user is replaced.  ``disease`` limits both to predictions whose name contains it.
    """
    if disease is not None:
        scored = scored.filter(F.lower("disease").contains(disease.lower()))
    new = scored.select(
        "user_id", F.col("disease").alias("disease_name"), F.col("icd10").alias("icd10_code"), "probability", "risk_level"
    )
    watched = F.sum(F.col("on_watchlist").cast("int"))
    heads = scored.groupBy("user_id", "health_score", "health_grade").agg(watched.cast("int").alias("watchlist"))
    heads = heads.select("user_id", "health_score", "health_grade", "watchlist", updated_at.alias("updated_at"))
    return {
        "predictions": M.version_predictions(predictions, new),
        "profiles": M.upsert_profile(profiles, heads, "user_id"),
    }
