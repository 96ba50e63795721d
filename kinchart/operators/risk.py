"""Feature table, disease scores and risk profiles, for all users at once.

Every input is aggregated once to one row per user and then joined; the scores are column
expressions over the feature row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinchart.functions import columns as C
from kinchart.sources import dimensions as dims

FEATURES = dims.rows("FEATURES", 3)
CLASSES = {name: dims.words(kws) for name, kws in dims.rows("DISEASE_CLASSES", 2)}
MODELS = {r[0]: r for r in dims.rows("RISK_MODELS", 5)}


# --- features -----------------------------------------------------------------------------------


def personal_features(users: DataFrame, as_of) -> DataFrame:
    """Whole years at ``as_of`` (month and day compared, never below 0; 40 if unknown) and gender."""
    today, dob = C.day(as_of), F.col("date_of_birth")
    mmdd = lambda d: F.month(d) * 100 + F.dayofmonth(d)
    years = F.year(today) - F.year(dob) - (mmdd(today) < mmdd(dob)).cast("int")
    return users.select(
        F.col("id").alias("user_id"),
        F.when(dob.isNull(), 40).otherwise(F.greatest(years, F.lit(0))).cast("double").alias("age"),
        F.coalesce(F.lower("gender").isin("male", "m").cast("int"), F.lit(0)).alias("gender_male"),
    )


def record_history(records: DataFrame) -> DataFrame:
    days = F.datediff(F.max("record_date"), F.min("record_date"))
    return records.groupBy(F.col("owner_id").alias("user_id")).agg(
        F.count("*").alias("record_count"),
        F.round(F.coalesce(days, F.lit(0)) / F.lit(365.25), 2).alias("years_of_history"),
    )


def _owned(records: DataFrame, entities: DataFrame) -> DataFrame:
    return entities.join(
        records.select(F.col("id").alias("record_id"), F.col("owner_id").alias("user_id"), "record_date"), "record_id"
    )


def entity_history(records: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct diseases and medicines, history flags and medication counts.

    First one row per user, type and value with its count (which also makes the values distinct),
    then one row per user: both steps combine on the map side.
    """
    kind = F.col("entity_type")
    value = F.col("entity_value")
    per_record = (
        entities.withColumn("entity_type", F.lower("entity_type"))
        .filter(kind.isin("disease", "medicine"))
        .groupBy("record_id", "entity_type", "entity_value")
        .agg(F.count("*").alias("_n"))
    )
    per_value = (
        _owned(records, per_record)
        .groupBy("user_id", "entity_type", "entity_value")
        .agg(F.sum("_n").alias("_n"))
    )
    disease, medicine = kind == "disease", kind == "medicine"
    flags = [
        F.max((disease & C.any_word(value, CLASSES[c])).cast("int")).alias(f"has_{c}_history")
        for c in ("diabetes", "hypertension", "thyroid", "heart")
    ]
    counts = [
        F.sum(F.when(medicine & C.any_word(value, dims.words(names)), F.col("_n")).otherwise(0)).alias(feature)
        for feature, names in dims.rows("MEDICATION_SETS", 2)
    ]
    return per_value.groupBy("user_id").agg(
        F.count_if(disease).alias("disease_count"),
        F.count_if(medicine).alias("unique_medicines_count"),
        *flags,
        *counts,
    )


def history_features(users: DataFrame, records: DataFrame, entities: DataFrame) -> DataFrame:
    names = ["record_count", "years_of_history", "disease_count", "unique_medicines_count"] + [
        f"has_{c}_history" for c in ("diabetes", "hypertension", "thyroid", "heart")
    ]
    joined = (
        users.select(F.col("id").alias("user_id"))
        .join(record_history(records), "user_id", "left")
        .join(entity_history(records, entities), "user_id", "left")
    )
    return joined.select("user_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def medication_features(users: DataFrame, records: DataFrame, entities: DataFrame) -> DataFrame:
    names = [feature for feature, _ in dims.rows("MEDICATION_SETS", 2)]
    joined = users.select(F.col("id").alias("user_id")).join(
        entity_history(records, entities), "user_id", "left"
    )
    return joined.select("user_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def latest_labs(records: DataFrame, entities: DataFrame) -> DataFrame:
    """Latest numeric value per biomarker (by record date, then id); a label may feed several."""
    fragments: dict[str, list[str]] = {}
    for fragment, feature in dims.rows("LAB_FEATURES", 2):
        fragments.setdefault(feature, []).append(fragment)
    labs = entities.filter(
        (F.lower("entity_type") == "lab_value") & F.col("lab_numeric_value").isNotNull()
    ).select("id", "record_id", "entity_value", "lab_numeric_value")
    at = F.struct("record_date", "id")
    label = F.trim("entity_value")
    return (
        _owned(records, labs)
        .groupBy("user_id")
        .agg(
            *[
                F.max_by("lab_numeric_value", F.when(C.any_word(label, parts), at)).alias(feature)
                for feature, parts in fragments.items()
            ]
        )
    )


def disease_class(text: Column) -> Column:
    """First matching class of a disease text."""
    chain = None
    for name, keywords in CLASSES.items():
        hit = C.any_word(text, keywords)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain


def family_aggregates(cls: Column, rel: Column, entries: Column) -> dict[str, Column]:
    """The thirteen family columns from rows of a class, a relationship and a number of entries."""
    near = {
        "parent": rel.isin("father", "mother", "parent"),
        "grandparent": rel.contains("grand"),
        "sibling": rel.isin("brother", "sister", "sibling"),
    }
    count = lambda c: F.sum(F.when(cls == c, entries).otherwise(0))
    flag = lambda c, who: F.max(((cls == c) & near[who]).cast("int"))
    return {
        "parent_diabetes": flag("diabetes", "parent"),
        "grandparent_diabetes": flag("diabetes", "grandparent"),
        "sibling_diabetes": flag("diabetes", "sibling"),
        "family_diabetes_count": count("diabetes"),
        "parent_hypertension": flag("hypertension", "parent"),
        "grandparent_hypertension": flag("hypertension", "grandparent"),
        "family_hypertension_count": count("hypertension"),
        "parent_heart_disease": flag("heart", "parent"),
        "grandparent_heart_disease": flag("heart", "grandparent"),
        "family_heart_count": count("heart"),
        "parent_thyroid": flag("thyroid", "parent"),
        "family_thyroid_count": count("thyroid"),
        "family_cancer_count": count("cancer"),
    }


def family_features(users: DataFrame, members: DataFrame, conditions: DataFrame) -> DataFrame:
    """Thirteen columns from the relatives' disease entries (member_id, condition, entries)."""
    rel = F.replace(F.lower(F.coalesce("relationship", F.lit(""))), F.lit(" "), F.lit("_"))
    cls = F.col("_class")
    aggs = family_aggregates(cls, rel, F.col("entries"))
    classed = (
        conditions.withColumn("_class", disease_class(F.col("condition")))
        .filter(cls.isNotNull())
        .groupBy("member_id", "_class")
        .agg(F.sum("entries").alias("entries"))
    )
    per_user = (
        classed.join(members.select(F.col("id").alias("member_id"), "user_id", "relationship"), "member_id")
        .groupBy("user_id")
        .agg(*[agg.alias(name) for name, agg in aggs.items()])
    )
    base = users.select(F.col("id").alias("user_id")).join(per_user, "user_id", "left")
    return base.select("user_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in aggs])


def impute_and_cast(raw: DataFrame) -> DataFrame:
    """All 42 features, missing ones from the population medians, cast to their declared type.

    ``bmi`` prefers the latest recorded value over the median.
    """
    have = set(raw.columns)
    out = []
    for name, kind, median in FEATURES:
        sources = [F.col(name)] if name in have else []
        if name == "bmi" and "latest_bmi" in have:
            sources.append(F.col("latest_bmi"))
        # a text or number that is no valid double counts as 0, a whole number is cut, not rounded
        given = F.coalesce(*sources) if sources else F.lit(None)
        number = F.coalesce(given.try_cast("double"), F.lit(0.0))
        value = F.when(given.isNull(), F.lit(float(median))).otherwise(number)
        out.append((F.coalesce(value.try_cast("int"), F.lit(0)) if kind == "int" else value).alias(name))
    return raw.select("user_id", *out)


def build_features(
    users: DataFrame, records: DataFrame, entities: DataFrame, members: DataFrame, conditions: DataFrame, as_of
) -> DataFrame:
    """Feature table of all users.  ``records`` are the users' own records."""
    raw = (
        personal_features(users, as_of)
        .join(record_history(records), "user_id", "left")
        .join(entity_history(records, entities), "user_id", "left")
        .join(latest_labs(records, entities), "user_id", "left")
        .join(family_features(users, members, conditions), "user_id", "left")
    )
    return impute_and_cast(raw)


def _placed(records: DataFrame, members: DataFrame) -> DataFrame:
    """(record_id, user_id, record_date, relationship, kin): own records, and members' records with whose relative they are."""
    own = records.filter("family_member_id is null").select(
        F.col("id").alias("record_id"), F.col("owner_id").alias("user_id"), "record_date",
        F.lit(None).cast("string").alias("relationship"), F.lit(False).alias("kin"),
    )
    relatives = members.select(F.col("id").alias("family_member_id"), "user_id", "relationship")
    kin = records.filter("family_member_id is not null").join(relatives, "family_member_id")
    return own.unionByName(
        kin.select(F.col("id").alias("record_id"), "user_id", F.lit(None).cast("date").alias("record_date"), "relationship", F.lit(True).alias("kin"))
    )


def entity_features(records: DataFrame, entities: DataFrame, members: DataFrame) -> DataFrame:
    """History, labs, medication and family columns of every user with entities, in one pass over the entities.

    Entities are folded per record and value, met with their records once, folded per user, relationship
    and value, and then to one row per user by filtered aggregates.  ``records`` are all records, own and members'.
    """
    kind, value, rel = F.col("kind"), F.col("entity_value"), F.col("rel")
    lab = F.struct("id", "lab_numeric_value")
    per_record = (
        entities.withColumn("kind", F.lower("entity_type"))
        .filter(kind.isin("disease", "medicine", "lab_value"))
        .groupBy("record_id", "kind", "entity_value")
        .agg(
            F.count("*").alias("_n"),
            F.count_if(F.col("entity_type") == "disease").alias("_exact"),
            F.max(F.when(F.col("lab_numeric_value").isNotNull(), lab)).alias("_lab"),
        )
    )
    dated = F.struct("record_date", F.col("_lab.id").alias("id"), F.col("_lab.lab_numeric_value").alias("lab"))
    shown = F.replace(F.lower(F.coalesce("relationship", F.lit(""))), F.lit(" "), F.lit("_"))
    per_value = (
        per_record.join(_placed(records, members), "record_id")
        .groupBy("user_id", "kin", shown.alias("rel"), "kind", "entity_value")
        .agg(F.sum("_n").alias("_n"), F.sum("_exact").alias("_exact"), F.max(F.when(F.col("_lab").isNotNull(), dated)).alias("_lab"))
    )
    own = ~F.col("kin")
    disease, medicine, labs = own & (kind == "disease"), own & (kind == "medicine"), own & (kind == "lab_value")
    flags = {
        f"has_{c}_history": F.max((disease & C.any_word(value, CLASSES[c])).cast("int"))
        for c in ("diabetes", "hypertension", "thyroid", "heart")
    }
    counts = {
        feature: F.sum(F.when(medicine & C.any_word(value, dims.words(names)), F.col("_n")).otherwise(0))
        for feature, names in dims.rows("MEDICATION_SETS", 2)
    }
    fragments: dict[str, list[str]] = {}
    for fragment, feature in dims.rows("LAB_FEATURES", 2):
        fragments.setdefault(feature, []).append(fragment)
    latest = {f: F.max(F.when(labs & C.any_word(F.trim(value), parts), F.col("_lab")))["lab"] for f, parts in fragments.items()}
    cls = F.when(F.col("kin") & (F.col("_exact") > 0), disease_class(value))
    family = family_aggregates(F.col("_class"), rel, F.col("_exact"))
    return per_value.withColumn("_class", cls).groupBy("user_id").agg(
        F.count_if(disease).alias("disease_count"),
        F.count_if(medicine).alias("unique_medicines_count"),
        *[agg.alias(n) for n, agg in (flags | counts | latest).items()],
        *[F.coalesce(agg, F.lit(0)).alias(n) for n, agg in family.items()],
    )


def all_features(users: DataFrame, records: DataFrame, entities: DataFrame, members: DataFrame, as_of) -> DataFrame:
    """Feature table of all users from all records, each entity read once (the rows of ``build_features``)."""
    zero = [n for n, kind, _ in FEATURES if n.startswith(("parent_", "grandparent_", "sibling_", "family_"))]
    raw = (
        personal_features(users, as_of)
        .join(record_history(records.filter("family_member_id is null")), "user_id", "left")
        .join(entity_features(records, entities, members), "user_id", "left")
    )
    return impute_and_cast(raw.withColumns({n: F.coalesce(n, F.lit(0)) for n in zero if n in raw.columns}))


# --- scores -------------------------------------------------------------------------------------


def _steps(value: Column, *bounds: tuple[float, float]) -> Column:
    """Points for the first bound the value reaches."""
    chain = None
    for bound, points in bounds:
        chain = F.when(value >= bound, points) if chain is None else chain.when(value >= bound, points)
    return chain.otherwise(0.0)


def _if(feature: str, points: float) -> Column:
    return F.when(F.col(feature) != 0, points).otherwise(0.0)


def _score(*parts: Column) -> Column:
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return F.round(C.clamp(total, 0.02, 0.98), 4)


def diabetes_score() -> Column:
    f = F.col
    return _score(
        F.lit(0.10),
        C.clamp((f("age") - 35) * 0.005, 0.0, 0.15),
        _steps(f("latest_blood_sugar_fasting"), (126, 0.35), (100, 0.18)),
        _steps(f("latest_hba1c"), (6.5, 0.30), (5.7, 0.15)),
        _steps(f("bmi"), (30, 0.10), (25, 0.05)),
        f("parent_diabetes") * 0.18,
        f("grandparent_diabetes") * 0.08,
        F.least(F.lit(0.12), f("family_diabetes_count") * 0.04),
        _if("has_diabetes_history", 0.25),
        f("exercise_regularity") * -0.05,
        f("diet_quality_score") * -0.04,
    )


def hypertension_score() -> Column:
    f = F.col
    return _score(
        F.lit(0.08),
        C.clamp((f("age") - 40) * 0.004, 0.0, 0.12),
        _steps(f("latest_systolic_bp"), (140, 0.30), (130, 0.15), (120, 0.05)),
        _steps(f("latest_diastolic_bp"), (90, 0.15)),
        _steps(f("bmi"), (30, 0.08)),
        f("parent_hypertension") * 0.15,
        f("grandparent_hypertension") * 0.07,
        _if("has_hypertension_history", 0.25),
        _if("has_diabetes_history", 0.06),
        f("exercise_regularity") * -0.06,
        f("diet_quality_score") * -0.05,
    )


def thyroid_score() -> Column:
    f = F.col
    tsh = f("latest_tsh")
    return _score(
        F.lit(0.06),
        F.when(f("gender_male") == 0, 0.12).otherwise(0.0),
        F.when(tsh > 4.0, 0.20).when(tsh < 0.4, 0.15).when(tsh > 2.5, 0.05).otherwise(0.0),
        _if("has_thyroid_history", 0.28),
        f("parent_thyroid") * 0.14,
        F.least(F.lit(0.10), f("family_thyroid_count") * 0.05),
        _if("has_diabetes_history", 0.05),
    )


def heart_score() -> Column:
    f = F.col
    hdl = f("latest_hdl")
    return _score(
        F.lit(0.05),
        _steps(f("age"), (65, 0.20), (55, 0.12), (45, 0.06), (35, 0.02)),
        _if("gender_male", 0.04),
        _steps(f("latest_cholesterol"), (240, 0.12), (200, 0.06)),
        _steps(f("latest_ldl"), (160, 0.10), (130, 0.05)),
        F.when(hdl < 40, 0.08).when(hdl >= 60, -0.04).otherwise(0.0),
        _steps(f("latest_systolic_bp"), (140, 0.10), (130, 0.05)),
        _if("has_diabetes_history", 0.12),
        _if("has_hypertension_history", 0.08),
        _if("has_heart_history", 0.25),
        f("parent_heart_disease") * 0.15,
        f("grandparent_heart_disease") * 0.08,
        F.least(F.lit(0.10), f("family_heart_count") * 0.04),
        f("exercise_regularity") * -0.08,
        f("diet_quality_score") * -0.05,
    )


SCORES = {
    "diabetes": diabetes_score,
    "hypertension": hypertension_score,
    "thyroid": thyroid_score,
    "heart_disease": heart_score,
}


def contributing_factors(model: str) -> Column:
    """Up to five weighted factors of a model, those with value 0 left out (gender: kept for women)."""
    entries = []
    for m, feature, weight, source, label in dims.rows("FACTORS", 5):
        if m != model:
            continue
        value = F.col(feature)
        present = value == 0 if feature == "gender_male" else value != 0
        if "%" in label:
            number = value.cast("int") if "%d" in label else value
            text = F.format_string(label, number)
        else:
            text = F.lit(label)
        entry = F.struct(
            text.alias("factor"),
            F.lit(float(weight)).alias("weight"),
            F.lit("increases").alias("direction"),
            F.lit(source).alias("source"),
        )
        entries.append(F.when(present, entry))
    return F.slice(F.array_compact(F.array(*entries)), 1, 5)


def score_features(features: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """One row per user and disease: probability, level, confidence and factors.

    ``fitted`` may give user_id, model_key, tree_p and net_p of trained models; without it the rule
    score is the probability.
    """
    parts = [
        F.struct(
            F.lit(key).alias("model_key"),
            F.lit(MODELS[key][1]).alias("disease"),
            F.lit(MODELS[key][2]).alias("icd10"),
            score().alias("rule_p"),
            contributing_factors(key).alias("contributing_factors"),
        )
        for key, score in SCORES.items()
    ]
    rows = features.select("user_id", F.inline(F.array(*parts)))
    if fitted is None:
        rows = rows.withColumns({"tree_p": F.lit(None).cast("double"), "net_p": F.lit(None).cast("double")})
    else:
        rows = rows.join(fitted.select("user_id", "model_key", "tree_p", "net_p"), ["user_id", "model_key"], "left")
    args = [F.col("tree_p"), F.col("net_p"), F.col("rule_p")]
    return rows.withColumns(
        {"probability": C.ensemble(*args), "model_confidence": C.model_confidence(*args)}
    ).withColumn("risk_level", C.risk_level("probability"))


def apply_boost(scored: DataFrame, boosts: DataFrame) -> DataFrame:
    """Add the family boost, capped at 0.95; the level follows the boosted value before rounding."""
    boosted = F.least(F.lit(0.95), F.col("probability") + F.col("boost").cast("double"))
    has = F.coalesce(F.col("boost") > 0, F.lit(False))
    return (
        scored.join(boosts.select("user_id", "model_key", "boost"), ["user_id", "model_key"], "left")
        .withColumn("_b", boosted)
        .withColumn("probability", F.when(has, F.round("_b", 4)).otherwise(F.col("probability")))
        .withColumn("risk_level", F.when(has, C.risk_level("_b")).otherwise(F.col("risk_level")))
        .withColumn("boost_applied", F.when(has, F.round(F.col("boost").cast("double"), 4)))
        .drop("_b", "boost")
    )


def grade(score: Column) -> Column:
    return (
        F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 55, "C").when(score >= 40, "D").otherwise("F")
    )


def weighted_health_score(scored: DataFrame) -> DataFrame:
    """100 minus the weighted probabilities, rounded half to even, with a letter grade."""
    weight = F.lit(0)
    for key, model in MODELS.items():
        weight = F.when(F.col("model_key") == key, int(model[3])).otherwise(weight)
    deduction = F.sum(F.col("probability").cast("decimal(10,4)") * weight)
    score = C.clamp(F.bround(100 - deduction, 0), 0, 100).cast("int")
    return (
        scored.groupBy("user_id").agg(score.alias("health_score")).withColumn("health_grade", grade(F.col("health_score")))
    )


def watchlist_flags(scored: DataFrame, threshold: float = 0.40) -> DataFrame:
    return scored.filter(F.col("probability") >= threshold).select(
        "user_id",
        "disease",
        "icd10",
        "probability",
        "risk_level",
        F.coalesce(F.try_element_at("contributing_factors", F.lit(1))["factor"], F.lit("")).alias("top_factor"),
    )


def feature_summary(features: DataFrame) -> DataFrame:
    return features.select(
        "user_id",
        "age",
        "bmi",
        F.col("latest_blood_sugar_fasting").alias("blood_sugar_fasting"),
        F.col("latest_hba1c").alias("hba1c"),
        F.col("latest_tsh").alias("tsh"),
        F.col("latest_systolic_bp").alias("systolic_bp"),
        F.col("latest_cholesterol").alias("cholesterol"),
    )


def risk_profile_build(
    features: DataFrame, boosts: DataFrame | None = None, fitted: DataFrame | None = None
) -> DataFrame:
    """Boosted predictions of all users with score and grade of the user on every row."""
    scored = score_features(features, fitted)
    if boosts is not None:
        scored = apply_boost(scored, boosts)
    # The four rows of a user fit one window frame; no second pass over the features is needed.
    per_user = Window.partitionBy("user_id")
    weight = F.lit(0)
    for key, model in MODELS.items():
        weight = F.when(F.col("model_key") == key, int(model[3])).otherwise(weight)
    deduction = F.sum(F.col("probability").cast("decimal(10,4)") * weight).over(per_user)
    return (
        scored.withColumn("health_score", C.clamp(F.bround(100 - deduction, 0), 0, 100).cast("int"))
        .withColumn("health_grade", grade(F.col("health_score")))
        .withColumn("on_watchlist", F.col("probability") >= 0.40)
    )


# --- cohort split -------------------------------------------------------------------------------


def stratified_split(rows: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """80/10/10 split of every label, by the rank of a seeded hash of the key.

    A label has few values, so ranking inside one window per label would put half of all rows into
    one task.  The rank is put together from two levels instead: rows are ranked inside
    4,096 hash ranges per label, and the counts of the ranges (at most 4,096 rows per label) give
    each range its offset.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    hashed = rows.withColumn("_h", digest).withColumn("_range", F.substring("_h", 1, 3))
    ranges = hashed.groupBy(label, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(label).orderBy("_range")
    offsets = ranges.select(
        label,
        "_range",
        (F.sum("_n").over(before) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(label)).alias("_total"),
    )
    inside = F.row_number().over(Window.partitionBy(label, "_range").orderBy("_h", key))
    share = (F.col("_offset") + F.col("_rank") - 1) * 10
    part = F.when(share < F.col("_total") * 8, "train").when(share < F.col("_total") * 9, "val").otherwise("test")
    return (
        hashed.withColumn("_rank", inside)
        .join(offsets, [label, "_range"])
        .withColumn("part", part)
        .select(*rows.columns, "part")
    )
