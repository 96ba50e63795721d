"""Record listing, search, review, timeline and trend operators.

Results are long tables: where an answer for one user would nest children in a parent, the children
are rows of their own that carry the parent key.  No group is gathered into one row or one task, so
a user, record or member that owns a large share of all rows is just a longer run of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinchart.functions import columns as C


def owner_scope(rows: DataFrame, owner, key: str = "owner_id") -> DataFrame:
    """Rows of one owner; a row of someone else is simply not there."""
    return rows.filter(F.col(key) == owner)


def user_by_key(users: DataFrame, user_id=None, email: str | None = None) -> DataFrame:
    return users.filter(F.col("id") == user_id if user_id is not None else F.col("email") == email)


def role_filter(users: DataFrame, roles: list[str]) -> DataFrame:
    return users.filter(F.col("role").isin(roles))


def list_records(
    records: DataFrame,
    record_type: str | None = None,
    family_member_id=None,
    date_from=None,
    date_to=None,
    include_family: bool = False,
) -> DataFrame:
    """Filtered records; without ``include_family`` only the owner's own, whatever member is asked for."""
    if record_type is not None:
        records = records.filter(F.col("record_type") == record_type)
    if family_member_id is not None:
        records = records.filter(F.col("family_member_id") == family_member_id)
    if date_from is not None:
        records = records.filter(F.col("record_date") >= C.day(date_from))
    if date_to is not None:
        records = records.filter(F.col("record_date") <= C.day(date_to))
    if not include_family:
        records = records.filter(F.col("family_member_id").isNull())
    return records


def record_derived(records: DataFrame) -> DataFrame:
    return records.withColumns(
        {
            "is_family_record": F.col("family_member_id").isNotNull(),
            "confidence_pct": F.round(F.col("confidence_score").cast("decimal(12,6)") * 100, 1).cast("double"),
        }
    )


def record_entities(records: DataFrame, entities: DataFrame) -> DataFrame:
    """Every entity with its record (equi join; adaptive skew splitting covers one huge record)."""
    return entities.withColumnRenamed("id", "entity_id").join(
        records.withColumnRenamed("id", "record_id"), "record_id"
    )


def records_with_member(records: DataFrame, members: DataFrame) -> DataFrame:
    names = members.select(F.col("id").alias("family_member_id"), F.col("name").alias("family_member_name"))
    return records.join(names, "family_member_id", "left")


def records_with_entities(records: DataFrame, entities: DataFrame) -> DataFrame:
    """All records, each with its entities as further rows (one null row where it has none)."""
    children = entities.select(
        "record_id", F.col("id").alias("entity_id"), "entity_type", C.effective_value().alias("value")
    )
    return records.withColumnRenamed("id", "record_id").join(children, "record_id", "left")


def list_entities(records: DataFrame, entities: DataFrame, entity_type: str | None = None) -> DataFrame:
    if entity_type is not None:
        entities = entities.filter(F.col("entity_type") == entity_type)
    return record_entities(records.select("id", "owner_id"), entities)


def unmatched(rows: DataFrame, partners: DataFrame, keys: list[str] | str) -> DataFrame:
    """Rows that have no partner."""
    return rows.join(partners, keys, "left_anti")


def with_effective_value(entities: DataFrame) -> DataFrame:
    return entities.withColumn("effective_value", C.effective_value())


def apply_corrections(entities: DataFrame, corrections: DataFrame) -> DataFrame:
    """Set value and flag of the listed entities; a correction names the record it belongs to.

    Of several corrections of one entity the latest counts (``corrected_at``), else the largest value.
    """
    latest = F.struct(*[c for c in ("corrected_at", "corrected_value") if c in corrections.columns])
    fixes = corrections.groupBy(F.col("entity_id").alias("id"), "record_id").agg(
        F.max_by("corrected_value", latest).alias("_fix")
    )
    hit = F.col("_hit").isNotNull()
    return (
        entities.join(fixes.withColumn("_hit", F.lit(True)), ["id", "record_id"], "left")
        .withColumn("corrected_value", F.when(hit, F.col("_fix")).otherwise(F.col("corrected_value")))
        .withColumn("user_corrected", hit | F.col("user_corrected"))
        .drop("_fix", "_hit")
    )


def record_search(records: DataFrame, entities: DataFrame, query: str) -> DataFrame:
    """Records whose type, date text or any effective entity value contains the query."""
    needle = query.lower()
    hits = (
        entities.filter(F.lower(C.effective_value()).contains(needle))
        .select(F.col("record_id").alias("id"), F.lit(True).alias("_hit"))
        .distinct()
    )
    own = F.lower("record_type").contains(needle) | F.coalesce(
        F.col("record_date").cast("string").contains(needle), F.lit(False)
    )
    return records.join(hits, "id", "left").filter(own | F.col("_hit")).drop("_hit")


def needs_review(confirmed: Column | None = None, threshold: float = 0.7) -> Column:
    """Low and unconfirmed confidence; a missing or zero confidence counts as 1."""
    confidence = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(1.0))
    return (confidence < threshold) & ~(F.lit(False) if confirmed is None else confirmed)


def review_queue(entities: DataFrame, confirmed: Column | None = None) -> DataFrame:
    return entities.filter(needs_review(confirmed))


def blocked_records(entities: DataFrame, confirmed: Column | None = None) -> DataFrame:
    """Per record the open review items; a record with any cannot be saved yet."""
    return (
        entities.groupBy("record_id")
        .agg(F.count_if(needs_review(confirmed)).alias("open_items"))
        .withColumn("blocked", F.col("open_items") > 0)
    )


def confidence_filter(entities: DataFrame, threshold: float = 0.60) -> DataFrame:
    return entities.filter(F.coalesce("confidence", F.lit(0.0)) >= threshold)


def with_canonical_type(entities: DataFrame, column: str = "entity_type") -> DataFrame:
    return entities.withColumn("canonical_type", C.canonical_entity_type(column))


def disease_trends(records: DataFrame, entities: DataFrame, as_of, months: int = 12) -> DataFrame:
    """Mentions and months of each disease of each owner.

    Mentions are counted per record and value before the join, so a record or value that holds a
    large share of the rows reaches the shuffle as a single row per map task.
    """
    per_record = (
        entities.filter(F.col("entity_type") == "disease")
        .groupBy("record_id", "entity_value")
        .agg(F.count("*").alias("_n"))
    )
    recent = records.filter(F.col("record_date") >= C.days_before(as_of, 30 * months)).select(
        F.col("id").alias("record_id"), "owner_id", F.date_format("record_date", "MMM yyyy").alias("_month")
    )
    return (
        per_record.join(recent, "record_id")
        .groupBy("owner_id", C.py_title(F.trim("entity_value")).alias("disease"))
        # the set holds month names of the window only: at most months + 2 of them
        .agg(F.sum("_n").alias("mentions"), F.sort_array(F.collect_set("_month")).alias("months"))
    )


def activity_heatmap(records: DataFrame, as_of, months: int = 12) -> DataFrame:
    since = C.days_before(as_of, 30 * months)
    return (
        records.filter(F.col("created_at") >= since)
        .groupBy("owner_id", F.date_format("created_at", "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("records"))
    )


def daily_calendar(users: DataFrame, records: DataFrame, as_of, weeks: int = 52) -> DataFrame:
    """Dense day grid of every user with the record count and a shade from 0 to 4."""
    days = F.sequence(C.days_before(as_of, weeks * 7 - 1), C.day(as_of))
    grid = users.select(F.col("id").alias("owner_id"), F.explode(days).alias("day"))
    counts = (
        records.filter(F.col("created_at") >= C.days_before(as_of, weeks * 7 - 1))
        .groupBy("owner_id", F.to_date("created_at").alias("day"))
        .agg(F.count("*").alias("_n"))
    )
    return (
        grid.join(counts, ["owner_id", "day"], "left")
        .withColumn("records", F.coalesce("_n", F.lit(0)))
        .withColumn("shade", F.least("records", F.lit(4)))
        .drop("_n")
    )


def page_meta(rows: DataFrame, page: int = 1, per_page: int = 20, keys: list[str] | None = None) -> DataFrame:
    """Totals and neighbours of a page, over all rows or per key."""
    totals = rows.groupBy(*(keys or [])).agg(F.count("*").alias("total"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("bigint")
    return totals.withColumn("total_pages", pages).select(
        "*", (F.lit(page) < F.col("total_pages")).alias("has_next"), F.lit(page > 1).alias("has_prev")
    )


def records_page(records: DataFrame, page: int = 1, per_page: int = 20) -> DataFrame:
    """One page, newest first, ties by id (take-ordered: no full sort)."""
    ordered = records.orderBy(F.desc("created_at"), F.desc("id"))
    return ordered.offset((page - 1) * per_page).limit(per_page)


def users_page(users: DataFrame, page: int = 1, per_page: int = 20) -> DataFrame:
    return users.orderBy("id").offset((page - 1) * per_page).limit(per_page)


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of every key.

    Spark cuts each map task to ``n`` rows per key before the shuffle (window group limit), so a hot
    key sends a bounded number of rows.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def relevant_records(
    records: DataFrame, entities: DataFrame, complaints: DataFrame, pool: int | None = None, top: int = 10
) -> DataFrame:
    """Best records of each patient for a complaint; with ``pool`` only out of the latest so many.

    ``complaints`` has owner_id and complaint.  The entities meet their record's complaints first and
    only those that name one are counted.
    """
    asked = complaints.withColumn("_needle", F.lower("complaint"))
    wanted = records.join(asked.select("owner_id").distinct(), "owner_id", "left_semi")
    if pool is not None:
        wanted = top_per_key(wanted, ["owner_id"], [F.desc("created_at"), F.desc("id")], pool, "_recent").drop("_recent")
    candidates = wanted.withColumnRenamed("id", "record_id").join(asked, "owner_id")
    needles = candidates.filter(F.col("_needle") != "").select("record_id", "complaint", "_needle")
    matches = (
        entities.select("record_id", F.lower(C.effective_value()).alias("_value"))
        .join(needles, "record_id")
        .filter(F.col("_value").contains(F.col("_needle")))
        .groupBy("record_id", "complaint")
        .agg(F.count("*").alias("_matches"))
    )
    score = (
        2.0 * F.coalesce("_matches", F.lit(0))
        + F.when(F.col("_needle").contains(F.col("record_type")), 1.0).otherwise(0.0)
        + F.when(F.col("extraction_status") == "done", 0.5).otherwise(0.0)
        + F.when(F.col("is_verified_by_user"), 0.5).otherwise(0.0)
    )
    scored = candidates.join(matches, ["record_id", "complaint"], "left").withColumn("score", score)
    order = [F.desc("score"), F.desc("created_at"), F.desc("record_id")]
    return top_per_key(scored, ["owner_id", "complaint"], order, top)


def timeline(records: DataFrame, entities: DataFrame, members: DataFrame) -> DataFrame:
    """One event per record with a readable title; ``timeline_order`` gives its order."""
    first_disease = (
        entities.filter(F.col("entity_type") == "disease")
        .groupBy(F.col("record_id").alias("id"))
        .agg(F.min_by(C.effective_value(), "id").alias("_disease"))
    )
    kind = C.py_title(F.replace("record_type", F.lit("_"), F.lit(" ")))
    disease = C.py_title("_disease")
    title = F.when(F.length("_disease") > 0, F.concat(kind, F.lit(" — "), disease)).otherwise(kind)
    return (
        records_with_member(records, members)
        .join(first_disease, "id", "left")
        .select(
            "owner_id",
            F.col("id").alias("record_id"),
            "record_type",
            "record_date",
            "created_at",
            title.alias("title"),
            F.col("family_member_id").isNotNull().alias("is_family_record"),
            "family_member_name",
            "extraction_status",
        )
    )


def timeline_order() -> list[Column]:
    """Undated records first, then newest."""
    return [F.desc_nulls_first("record_date"), F.desc("created_at"), F.desc("record_id")]


def recent_events(events: DataFrame, n: int = 3) -> DataFrame:
    return top_per_key(events, ["owner_id"], timeline_order(), n)


def entity_tags(entities: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` entities of each record."""
    return top_per_key(entities, ["record_id"], [F.asc("id")], n)


def annotation_import(annotations: DataFrame, labels: DataFrame, min_score: float = 0.70) -> DataFrame:
    """Turn external annotations into entity rows; unknown labels, low scores and single letters drop out."""
    text = F.trim("word")
    return (
        annotations.filter((F.col("score") >= min_score) & (F.length(text) >= 2))
        .join(F.broadcast(labels.select("label", "entity_type")), "label")
        .select(
            "doc_id",
            F.col("entity_type").alias("type"),
            text.alias("text"),
            "start",
            "end",
            C.py_title(text).alias("normalized"),
            F.col("score").alias("confidence"),
            F.lit("ml").alias("source"),
        )
    )


def medicine_names(prescriptions: DataFrame) -> DataFrame:
    """Non-empty medicine names of each prescription; an empty array where there are none."""
    names = F.filter(F.transform("medicines", lambda m: m["name"]), lambda n: n != "")
    return prescriptions.withColumn(
        "medicine_names", F.coalesce(names, F.array().cast("array<string>"))
    )
