"""Declared schemas of the eight tables, and reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "users": "id string not null, email string not null, password_hash string, full_name string not null, "
    "date_of_birth date, gender string, blood_group string, phone string, profile_image_url string, role string, "
    "is_verified boolean, email_verified_at timestamp, created_at timestamp, updated_at timestamp",
    "family_members": "id string not null, user_id string not null, related_user_id string, name string not null, "
    "relationship string not null, gender string, date_of_birth date, is_deceased boolean, invite_status string, "
    "invite_token string, invite_sent_at timestamp, created_at timestamp, updated_at timestamp",
    "health_records": "id string not null, owner_id string not null, family_member_id string, "
    "record_type string not null, record_date date, source_file_url string, source_file_type string, "
    "source_file_key string, extraction_status string, confidence_score double, raw_ocr_text string, "
    "structured_data map<string,string>, celery_task_id string, is_verified_by_user boolean, "
    "verified_at timestamp, created_at timestamp, updated_at timestamp",
    "extracted_entities": "id string not null, record_id string not null, entity_type string not null, "
    "entity_value string not null, confidence double, icd10_code string, atc_code string, start_index int, "
    "end_index int, user_corrected boolean, corrected_value string, corrected_at timestamp, created_at timestamp",
    "prescriptions": "id string not null, record_id string not null, owner_id string not null, diagnosis string, "
    "icd10_code string, doctor_name string, doctor_specialization string, hospital_name string, "
    "hospital_address string, prescription_date date, follow_up_date date, "
    "medicines array<struct<name:string,dosage:string,frequency:string,duration:string,instructions:string,"
    "atc_code:string>>, notes string, is_refillable boolean, refill_count int, created_at timestamp, "
    "updated_at timestamp",
    "risk_predictions": "id string not null, user_id string not null, disease_name string not null, "
    "icd10_code string, probability double not null, risk_level string not null, "
    "contributing_factors array<struct<factor:string,weight:double,source:string,direction:string>>, "
    "model_version string, generated_at timestamp, is_active boolean",
    "family_invites": "id string not null, inviter_id string not null, family_member_id string, "
    "invitee_email string, invitee_phone string, relationship string, token string not null, status string, "
    "expires_at timestamp, created_at timestamp, responded_at timestamp",
    "doctor_access": "id string not null, patient_id string not null, doctor_id string not null, "
    "access_level string, granted_at timestamp, expires_at timestamp, is_active boolean, consent_text string, "
    "revoked_at timestamp, revocation_reason string",
}

OCR_RESULTS = (
    "record_id string, owner_id string, raw_text string, words array<struct<text:string,bbox:array<double>,"
    "confidence:double,engine:string,page:int>>, overall_confidence double, processing_time_ms int, "
    "extracted_at timestamp"
)


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def load_tables(spark: SparkSession, path: str, source: str = "parquet", **options) -> dict[str, DataFrame]:
    """The eight tables with their declared schemas; ``source="jdbc"`` reads them from a database.

    Files: one folder per table under ``path``.  JDBC: ``path`` is the URL and the options carry
    driver, user and, for parallel reads, partitionColumn/lowerBound/upperBound/numPartitions.
    """
    tables = {}
    for name in SCHEMAS:
        if source == "jdbc":
            tables[name] = spark.read.format("jdbc").options(url=path, dbtable=name, **options).load()
        else:
            tables[name] = spark.read.format(source).schema(schema(name)).options(**options).load(f"{path}/{name}")
    return tables


def load_ocr_results(spark: SparkSession, path: str, source: str = "json") -> DataFrame:
    return spark.read.format(source).schema(OCR_RESULTS).load(path)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of files under a folder; the content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("uploaded_at"))
