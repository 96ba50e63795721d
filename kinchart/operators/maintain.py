"""Table maintenance: intake, replacement, versioning, upsert, cascade, validation, verification.

Each operator returns the new table (or the rows to add or purge).  Writing it is the caller's
choice; ``write_partitions`` overwrites only the touched partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from kinchart.functions import columns as C
from kinchart.operators import normalize as N
from kinchart.operators.records import apply_corrections, top_per_key
from kinchart.sources import fixed_values as fixed
from kinchart.sources.dimensions import words

MAX_UPLOAD_BYTES = 20 * 1024 * 1024


def document_intake(files: DataFrame, owner: str = "owner_id", max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Uploaded files (path, length, owner_id, record_type, family_member_id) as pending records.

    ``reject_reason`` is null for accepted files; the first failed test counts.
    """
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")
    uuid = r"(?i)^\{?(urn:uuid:)?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"
    member = F.col("family_member_id")
    bad_member = member.isNotNull() & (member != "") & ~member.rlike(uuid)
    reason = (
        F.when(~extension.isin(words(fixed.UPLOAD_FILE_TYPES)), "UNSUPPORTED_FILE_TYPE")
        .when(F.col("length") > max_bytes, "FILE_TOO_LARGE")
        .when(bad_member, "INVALID_UUID")
    )
    return files.select(
        owner,
        F.when(member != "", member).alias("family_member_id"),
        "record_type",
        F.col("path").alias("source_file_key"),
        extension.alias("source_file_type"),
        F.lit(None).cast("date").alias("record_date"),
        F.lit("pending").alias("extraction_status"),
        reason.alias("reject_reason"),
    )


def replace_entities(existing: DataFrame, new: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Entities after re-extraction: all rows of the re-extracted records go, the new ones come.

    ``records`` lists the re-extracted records where some of them may have no new entity.
    """
    done = (new if records is None else records).select("record_id")
    return existing.join(done, "record_id", "left_anti").unionByName(new, allowMissingColumns=True)


def version_predictions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Active predictions of the same user and disease are switched off, the new ones added."""
    replaced = new.select("user_id", "disease_name").distinct().withColumn("_replaced", F.lit(True))
    keep = existing.join(replaced, ["user_id", "disease_name"], "left")
    kept = keep.withColumn("is_active", F.col("is_active") & F.col("_replaced").isNull()).drop("_replaced")
    return kept.unionByName(new.withColumn("is_active", F.lit(True)), allowMissingColumns=True)


def upsert_profile(existing: DataFrame, new: DataFrame, key: str, version: str = "updated_at") -> DataFrame:
    """Latest document per key: one aggregation that keeps the row with the largest version."""
    columns = existing.columns
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = F.max_by(F.struct(*columns), F.struct(version, "_new"))
    return both.groupBy(F.col(key).alias("_key")).agg(latest.alias("_row")).select("_row.*")


def append_rows(
    existing: DataFrame, new: DataFrame, key: str, defaults: dict[str, Column] | None = None
) -> dict[str, DataFrame]:
    """Add rows with defaults for missing values: ``rows`` with the new ones, and ``rejected``.

    A key that exists already is refused; of several new rows with one key one is added.
    ``rejected`` tells key, reason (exists, repeated) and the number of rows refused for it.
    """
    for name, value in (defaults or {}).items():
        new = new.withColumn(name, F.coalesce(name, value) if name in new.columns else value)
    if "name" in new.columns:
        new = new.withColumn("name", F.trim("name"))
    names = [c for c in sorted(new.columns) if c != key]
    # rows are ordered by their text: maps have no order of their own
    one = F.min_by(F.struct(*names), F.to_json(F.struct(*names)))
    single = new.groupBy(key).agg(one.alias("_r"), F.count("*").alias("_n"))
    known = existing.select(F.col(key).alias("_known")).distinct()
    marked = single.join(known, single[key].eqNullSafe(F.col("_known")) & F.col("_known").isNotNull(), "left")
    exists = F.col("_known").isNotNull()
    fresh = marked.filter(~exists).select(key, *[F.col(f"_r.{c}").alias(c) for c in names])
    refused = marked.filter(exists | (F.col("_n") > 1)).select(
        key,
        F.when(exists, "exists").otherwise("repeated").alias("reason"),
        F.when(exists, F.col("_n")).otherwise(F.col("_n") - 1).alias("refused"),
    )
    return {"rows": existing.unionByName(fresh, allowMissingColumns=True), "rejected": refused}


def apply_patches(existing: DataFrame, patches: DataFrame, key: str = "id", version: str | None = None) -> DataFrame:
    """Partial update: ``patches`` has the key and a map ``changes`` of column name to text value.

    A column that is in the map changes (null included); a column that is not stays.  Arrays, maps
    and structs come as JSON text.  Of several patches of one key the one of the largest ``version``
    counts, without a version the one whose JSON text is largest.
    """
    last = F.struct(*([version] if version else []), F.to_json("changes"))
    single = patches.groupBy(key).agg(F.max_by("changes", last).alias("changes"))
    joined = existing.join(single, key, "left")
    changes = F.col("changes")
    out = []
    for field in existing.schema.fields:
        has = F.coalesce(F.map_contains_key(changes, F.lit(field.name)), F.lit(False))
        text = F.try_element_at(changes, F.lit(field.name))
        nested = isinstance(field.dataType, (ArrayType, MapType, StructType))
        value = F.from_json(text, field.dataType) if nested else text.try_cast(field.dataType)
        out.append(F.col(field.name) if field.name == key else F.when(has, value).otherwise(F.col(field.name)).alias(field.name))
    return joined.select(*out)


def _without(df: DataFrame, column: str, gone: DataFrame, key: str = "id") -> DataFrame:
    return df.join(gone.select(F.col(key).alias(column)), column, "left_anti")


def _only(df: DataFrame, column: str, gone: DataFrame, key: str = "id") -> DataFrame:
    return df.join(gone.select(F.col(key).alias(column)), column, "left_semi")


def cascade_delete(
    tables: dict[str, DataFrame],
    users: DataFrame | None = None,
    members: DataFrame | None = None,
    records: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Delete users, members or records (tables of ids) with everything that depends on them.

    A member takes its records along; a link to a deleted account is set to null.  ``purge`` lists
    the records whose stored file and archived words have to go as well.
    """
    none = tables["users"].select("id").limit(0)
    gone_users = none if users is None else users.select("id")
    t = dict(tables)
    gone_members = (none if members is None else members.select("id")).unionByName(
        _only(t["members"], "user_id", gone_users).select("id")
    )
    gone_records = (
        (none if records is None else records.select("id"))
        .unionByName(_only(t["records"], "owner_id", gone_users).select("id"))
        .unionByName(_only(t["records"].filter("family_member_id is not null"), "family_member_id", gone_members).select("id"))
        .distinct()
    )
    out = {
        "users": _without(t["users"], "id", gone_users),
        "members": _without(t["members"], "id", gone_members),
        "records": _without(t["records"], "id", gone_records),
        "entities": _without(t["entities"], "record_id", gone_records),
        "purge": gone_records.withColumnRenamed("id", "record_id"),
    }
    flag = gone_users.select(F.col("id").alias("related_user_id"), F.lit(True).alias("_gone")).distinct()
    linked = out["members"].join(flag, "related_user_id", "left")
    out["members"] = linked.withColumn(
        "related_user_id", F.when(F.col("_gone").isNull(), F.col("related_user_id"))
    ).select(*t["members"].columns)
    if "prescriptions" in t:
        kept = _without(t["prescriptions"], "record_id", gone_records)
        out["prescriptions"] = _without(kept, "owner_id", gone_users) if "owner_id" in kept.columns else kept
    if "predictions" in t:
        out["predictions"] = _without(t["predictions"], "user_id", gone_users)
    if "invites" in t:
        kept = _without(t["invites"], "inviter_id", gone_users)
        out["invites"] = _without(kept, "family_member_id", gone_members)
    if "access" in t:
        out["access"] = _without(_without(t["access"], "patient_id", gone_users), "doctor_id", gone_users)
    return out


def validate_rows(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with ``reasons``, the names of the rules they break (null counts as kept, see ``required``)."""
    broken = [F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]
    return rows.withColumn("reasons", F.array_compact(F.array(*broken)))


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    checked = validate_rows(rows, rules)
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def required(column: str) -> Column:
    return F.col(column).isNotNull()


def length_between(column: str, low: int, high: int) -> Column:
    return F.length(column).between(low, high)


def one_of(column: str, values: list[str]) -> Column:
    return F.col(column).isin(values)


def between(column: str, low: float, high: float) -> Column:
    return F.col(column).between(low, high)


# --- verification ---------------------------------------------------------------------------------


def review_diff(original: DataFrame, edited: DataFrame) -> dict[str, DataFrame]:
    """What changed between two entity sets of the same records.

    ``edited`` has id, record_id, entity_type, value and is_new.
    """
    old = original.select("id", "record_id", F.col("entity_value").alias("_old"))
    changed = edited.filter(~F.col("is_new")).join(old, ["id", "record_id"])
    return {
        "deletions": old.join(edited.select("id", "record_id"), ["id", "record_id"], "left_anti").select(
            F.col("id").cast("string").alias("entity_id"), "record_id"
        ),
        "corrections": changed.filter(~F.col("value").eqNullSafe(F.col("_old"))).select(
            F.col("id").alias("entity_id"), "record_id", F.col("value").alias("corrected_value")
        ),
        "additions": edited.filter("is_new").select(
            "record_id", F.lower("entity_type").alias("entity_type"), F.col("value").alias("entity_value")
        ),
    }


def verify_records(
    records: DataFrame,
    entities: DataFrame,
    verified: DataFrame,
    corrections: DataFrame,
    additions: DataFrame,
    deletions: DataFrame,
) -> dict[str, DataFrame]:
    """Apply a batch of verifications.

    verified: record_id and optionally structured_data (a map merged over the stored one);
    corrections: entity_id, record_id, corrected_value; additions: record_id, entity_type,
    entity_value; deletions: entity_id (text; ids that start with "custom_" were never stored), record_id.
    """
    has_data = "structured_data" in verified.columns
    # a record that is listed several times counts once, with its latest data (``verified_at``)
    last = F.struct(*([F.col("verified_at")] if "verified_at" in verified.columns else []), *([F.to_json("structured_data")] if has_data else [F.lit(1)]))
    data = F.max_by("structured_data", last) if has_data else F.lit(None)
    marks = verified.groupBy(F.col("record_id").alias("id")).agg(F.lit(True).alias("_v"), data.alias("_data"))
    marks = marks if has_data else marks.drop("_data")
    seen = records.join(marks, "id", "left").withColumn(
        "is_verified_by_user", F.col("_v").isNotNull() | F.col("is_verified_by_user")
    )
    if has_data and "structured_data" in records.columns:
        new = F.coalesce("_data", F.create_map().cast("map<string,string>"))
        old = F.map_filter(
            F.coalesce("structured_data", F.create_map().cast("map<string,string>")),
            lambda k, _: ~F.map_contains_key(new, k),
        )
        seen = seen.withColumn(
            "structured_data", F.when(F.size(new) > 0, F.map_concat(old, new)).otherwise(F.col("structured_data"))
        )
    keys = verified.select("record_id").distinct()
    listed = deletions.filter(~F.col("entity_id").startswith("custom_")).select(
        F.col("entity_id").try_cast(entities.schema["id"].dataType).alias("id"), "record_id"
    )
    kept = entities.join(listed.join(keys, "record_id", "left_semi"), ["id", "record_id"], "left_anti")
    fixed_ = apply_corrections(kept, corrections.join(keys, "record_id", "left_semi"))
    value = F.trim("entity_value")
    kind = C.canonical_entity_type(F.coalesce("entity_type", F.lit("other")))
    added = (
        additions.join(keys, "record_id", "left_semi")
        .filter(F.coalesce(value, F.lit("")) != "")
        .select("record_id", kind.alias("entity_type"), value.alias("entity_value"))
        .withColumns(
            {
                "confidence": F.lit(1.0),
                "user_corrected": F.lit(True),
                "corrected_value": F.col("entity_value"),
                "_codes": N.code_lookup(F.col("entity_type"), F.col("entity_value")),
            }
        )
        .select("*", "_codes.*")
        .drop("_codes")
    )
    return {
        "records": seen.drop("_v", "_data"),
        "entities": fixed_.unionByName(added, allowMissingColumns=True),
        "added": added,
    }


def sync_prescription(records: DataFrame, entities: DataFrame, length: int | None = None) -> dict[str, DataFrame]:
    """Diagnosis, code and medicine rows of prescription records from the effective entity values.

    The diagnosis is one text of all diseases of a record, in the order of their ids; ``length`` cuts it.
    """
    wanted = records.filter(F.col("record_type") == "prescription").select(F.col("id").alias("record_id"), "owner_id")
    ents = entities.withColumn("_value", C.effective_value()).join(wanted, "record_id", "left_semi")
    diseases = ents.filter(F.lower("entity_type") == "disease")
    parts = F.array_sort(F.collect_list(F.struct("id", F.coalesce("_value", F.lit("")).alias("v"))))
    whole = F.array_join(F.transform(parts, lambda p: p["v"]), ", ")
    text = diseases.groupBy("record_id").agg((whole if length is None else F.substring(whole, 1, length)).alias("diagnosis"))
    out = wanted.join(text, "record_id", "left")
    if "icd10_code" in entities.columns:
        code = (
            diseases.filter(F.coalesce("icd10_code", F.lit("")) != "")
            .groupBy("record_id")
            .agg(F.min_by("icd10_code", "id").alias("icd10_code"))
        )
        out = out.join(code, "record_id", "left")
    medicines = ents.filter(F.lower("entity_type") == "medicine").select(
        "record_id", F.col("id").alias("entity_id"), F.col("_value").alias("name"),
        *([F.col("atc_code")] if "atc_code" in entities.columns else []),
    )
    return {"prescriptions": out, "medicines": medicines}


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def write_partitions(rows: DataFrame, path: str, column: str) -> None:
    """Overwrite only the partitions that occur in ``rows``."""
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(column)
        .parquet(path)
    )
