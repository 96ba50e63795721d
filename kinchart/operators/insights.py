"""Predictions, scores shown to the user, recommendations, consent and invitations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinchart.functions import columns as C
from kinchart.operators.records import disease_trends, top_per_key
from kinchart.sources import dimensions as dims
from kinchart.sources import fixed_values as fixed

# --- predictions --------------------------------------------------------------------------------


def active_predictions(predictions: DataFrame) -> DataFrame:
    return predictions.filter("is_active")


def predictions_like(predictions: DataFrame, disease: str) -> DataFrame:
    """Active predictions whose disease name contains the text; all of them, however many match."""
    return active_predictions(predictions).filter(F.lower("disease_name").contains(disease.lower()))


def prediction_derived(predictions: DataFrame) -> DataFrame:
    """Percentage, level from the thresholds, and factors by falling weight (given order on ties)."""
    factors = F.transform(
        "contributing_factors",
        lambda f, i: F.struct((-F.coalesce(f["weight"], F.lit(0.0))).alias("k"), i.alias("i"), f.alias("f")),
    )
    return predictions.withColumns(
        {
            "probability_pct": F.round(F.col("probability").cast("decimal(12,6)") * 100, 1).cast("double"),
            "risk_level": C.risk_level("probability"),
            "top_factors": F.coalesce(
                F.transform(F.array_sort(factors), lambda x: x["f"]),
                F.slice("contributing_factors", 1, 0),
            ),
        }
    )


def top_predictions(predictions: DataFrame, n: int = 3) -> DataFrame:
    """The likeliest ``n`` active predictions of every user.

    The rows are dealt out before they are sorted for the first cut: one split of a small wide source may hold them
    all, and a task would sort them all.
    """
    order = [F.desc("probability"), F.asc("id")]
    return top_per_key(active_predictions(predictions).repartition("user_id", "id"), ["user_id"], order, n)


def ranked_predictions(predictions: DataFrame) -> DataFrame:
    """Active predictions of every user, likeliest first (``rank``): the list that goes with a risk profile."""
    order = Window.partitionBy("user_id").orderBy(F.desc("probability"), F.asc("id"))
    return active_predictions(predictions).withColumn("rank", F.row_number().over(order))


def risk_profile(users: DataFrame, predictions: DataFrame) -> DataFrame:
    """Counts per level, worst level present and last update of every user."""
    counts = (
        active_predictions(predictions)
        .groupBy(F.col("user_id").alias("id"))
        .agg(
            F.count("*").alias("_total"),
            *[F.count_if(F.col("risk_level") == lv).alias(f"_{lv}") for lv in ("high", "moderate", "low")],
            F.max("generated_at").alias("last_updated"),
        )
    )
    zero = F.lit(0)
    overall = F.when(F.col("_high") > 0, "high").when(F.col("_moderate") > 0, "moderate").otherwise("low")
    return users.select("id").join(counts, "id", "left").select(
        F.col("id").alias("user_id"),
        overall.alias("overall_risk_level"),
        F.coalesce("_total", zero).alias("total_predictions"),
        F.coalesce("_high", zero).alias("high_risk_count"),
        F.coalesce("_moderate", zero).alias("moderate_risk_count"),
        F.coalesce("_low", zero).alias("low_risk_count"),
        "last_updated",
    )


def health_score(users: DataFrame, predictions: DataFrame, records: DataFrame) -> DataFrame:
    """100 minus a penalty per active prediction plus a small bonus for verified records, for everyone."""
    level = F.col("risk_level")
    penalty = F.when(level == "high", 20).when(level == "moderate", 10).when(level == "low", 3).otherwise(0)
    penalties = (
        active_predictions(predictions)
        .groupBy(F.col("user_id").alias("id"))
        .agg(F.sum(penalty).alias("_penalty"))
    )
    verified = (
        records.filter("is_verified_by_user")
        .groupBy(F.col("owner_id").alias("id"))
        .agg(F.count("*").alias("_verified"))
    )
    bonus = F.least(F.coalesce("_verified", F.lit(0)) * 2, F.lit(5))
    score = C.clamp(100 - F.coalesce("_penalty", F.lit(0)) + bonus, 0, 100).cast("int")
    label = (
        F.when(F.col("score") >= 80, "good").when(F.col("score") >= 60, "moderate").otherwise("needs_attention")
    )
    return (
        users.select("id")
        .join(penalties, "id", "left")
        .join(verified, "id", "left")
        .select(F.col("id").alias("user_id"), score.alias("score"))
        .withColumn("label", label)
    )


def top_trend_disease(predictions: DataFrame) -> DataFrame:
    """Per user the disease with the highest mean probability, with its monthly means."""
    monthly = predictions.groupBy(
        "user_id", "disease_name", F.date_format("generated_at", "yyyy-MM").alias("month")
    ).agg(F.sum("probability").alias("_s"), F.count("*").alias("_n"))
    means = monthly.groupBy("user_id", "disease_name").agg(
        F.round(F.sum("_s") / F.sum("_n"), 6).alias("mean_probability")
    )
    best = means.groupBy("user_id").agg(
        F.min_by("disease_name", F.struct(-F.col("mean_probability"), "disease_name")).alias("disease_name"),
        F.max("mean_probability").alias("mean_probability"),
    )
    return monthly.join(best, ["user_id", "disease_name"]).select(
        "user_id",
        "disease_name",
        "mean_probability",
        "month",
        F.round(F.col("_s") / F.col("_n"), 6).alias("value"),
    )


def watchlist(predictions: DataFrame, n: int = 5) -> DataFrame:
    """Top active predictions with advice and up to three family factors."""
    advice = dims.lookup(dims.rows("WATCHLIST_ACTIONS", 2))
    low = dict(dims.rows("WATCHLIST_ACTIONS", 2))["low"]
    family = F.filter(F.coalesce("contributing_factors", F.slice("contributing_factors", 1, 0)), lambda f: f["source"] == "family")
    # only what is shown is dealt out and sorted, not all factors
    shown = predictions.select(
        "user_id", "id", "disease_name", "icd10_code", "probability", "risk_level", "is_active",
        F.slice(F.transform(family, lambda f: f["factor"]), 1, 3).alias("family_members_affected"),
    )
    return top_predictions(shown, n).select(
        "user_id",
        "rank",
        "disease_name",
        "icd10_code",
        "probability",
        F.round(F.col("probability").cast("decimal(12,6)") * 100, 1).cast("double").alias("probability_pct"),
        "risk_level",
        F.coalesce(F.try_element_at(advice, F.col("risk_level")), F.lit(low)).alias("recommended_action"),
        "family_members_affected",
    )


# --- recommendations and summary ----------------------------------------------------------------


def recommendations(users: DataFrame, predictions: DataFrame) -> DataFrame:
    """Templates that apply to each user: the universal ones, and those a prediction matches.

    Each template is one boolean over the user's predictions (a max), so six templates cost one
    aggregation and no join against them.
    """
    templates = dims.rows("RECOMMENDATIONS", 7)
    order = {"urgent": 0, "recommended": 1, "optional": 2}
    flags = []
    for i, (_, _, levels, keywords, *_rest) in enumerate(templates):
        if keywords is None:
            continue
        match = F.col("risk_level").isin(dims.words(levels)) & C.any_word(
            F.col("disease_name"), dims.words(keywords)
        )
        flags.append(F.max(match).alias(f"_t{i}"))
    matched = active_predictions(predictions).groupBy(F.col("user_id").alias("id")).agg(*flags)
    shown = []
    for i, (category, priority, _, keywords, title, description, action) in enumerate(templates):
        entry = F.struct(
            F.lit(order[priority] * 100 + i).alias("display_order"),
            F.lit(category).alias("category"),
            F.lit(priority).alias("priority"),
            F.lit(title).alias("title"),
            F.lit(description).alias("description"),
            F.lit(action).alias("action"),
        )
        shown.append(entry if keywords is None else F.when(F.col(f"_t{i}"), entry))
    return users.select("id").join(matched, "id", "left").select(
        F.col("id").alias("user_id"), F.inline(F.array_compact(F.array(*shown)))
    )


def recommendation_filter(
    rows: DataFrame, category: str | None = None, priority: str | None = None
) -> DataFrame:
    """Keep one category or priority and add the category's display label."""
    if category is not None:
        rows = rows.filter(F.col("category") == category)
    if priority is not None:
        rows = rows.filter(F.col("priority") == priority)
    labels = dims.lookup(dims.rows("CATEGORY_LABELS", 2))
    label = F.coalesce(F.try_element_at(labels, F.col("category")), F.col("category"))
    return rows.withColumn("category_label", label)


def health_summary(
    users: DataFrame, predictions: DataFrame, records: DataFrame, entities: DataFrame, as_of
) -> DataFrame:
    """Score, three top risks, three most mentioned conditions of six months, and a sentence."""
    risks = (
        top_predictions(predictions, 3)
        .groupBy(F.col("user_id").alias("id"))
        .agg(F.sort_array(F.collect_list(F.struct("rank", "disease_name"))).alias("_r"))
    )
    trends = disease_trends(records, entities, as_of, months=6).select("owner_id", "disease", "mentions")
    recent = (
        top_per_key(trends, ["owner_id"], [F.desc("mentions"), F.asc("disease")], 3)
        .groupBy(F.col("owner_id").alias("id"))
        .agg(F.sort_array(F.collect_list(F.struct("rank", "disease"))).alias("_c"))
    )
    names = F.transform("_r", lambda r: r["disease_name"])
    count = F.size("_r")
    clause = (
        F.when(count > 1, F.concat(
            F.array_join(F.slice(names, F.lit(1), count - 1), ", "), F.lit(" and "), F.element_at(names, -1)
        ))
        .when(count == 1, F.element_at(names, 1))
        .otherwise(fixed.NO_RISKS)
    )
    scores = health_score(users, predictions, records).withColumnRenamed("user_id", "id")
    return (
        users.select("id", F.split("full_name", r"\s+")[0].alias("_first"))
        .join(scores, "id")
        .join(risks, "id", "left")
        .join(recent, "id", "left")
        .select(
            F.col("id").alias("user_id"),
            F.col("score").alias("health_score"),
            F.coalesce(names, F.array().cast("array<string>")).alias("top_risks"),
            F.coalesce(F.transform("_c", lambda c: c["disease"]), F.array().cast("array<string>")).alias(
                "recent_conditions"
            ),
            C.sentence(fixed.HEALTH_SENTENCE, name=F.col("_first"), score=F.col("score"), risks=clause).alias("summary"),
        )
    )


# --- consent ------------------------------------------------------------------------------------


def _active_grants(access: DataFrame, as_of, enforce_expiry: bool) -> DataFrame:
    grants = access.filter("is_active")
    if enforce_expiry:
        grants = grants.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= C.day(as_of)))
    return grants


def doctor_patients(access: DataFrame, users: DataFrame, scores: DataFrame) -> DataFrame:
    """Patients every doctor may see, with level, expiry and health score."""
    patients = users.select(F.col("id").alias("patient_id"), "full_name", "gender")
    return (
        access.filter("is_active")
        .join(patients, "patient_id")
        .join(scores.select(F.col("user_id").alias("patient_id"), F.col("score").alias("health_score")), "patient_id")
        .select("doctor_id", "patient_id", "full_name", "gender", "access_level", "expires_at", "health_score")
    )


def consented_rows(
    rows: DataFrame, access: DataFrame, doctor_id, key: str = "owner_id", as_of=None, enforce_expiry: bool = False
) -> DataFrame:
    """Rows of the patients this doctor holds an active grant for."""
    grants = _active_grants(access, as_of, enforce_expiry).filter(F.col("doctor_id") == doctor_id)
    return rows.join(grants.select(F.col("patient_id").alias(key)), key, "left_semi")


def patient_summary(users: DataFrame, scores: DataFrame, predictions: DataFrame) -> DataFrame:
    """Profile and score of each patient with the active risks as rows (one null row where none)."""
    risks = active_predictions(predictions).select(
        F.col("user_id").alias("id"), "disease_name", "probability", "risk_level"
    )
    return (
        users.join(scores.select(F.col("user_id").alias("id"), F.col("score").alias("health_score")), "id")
        .join(risks, "id", "left")
        .withColumnRenamed("id", "patient_id")
    )


def grant_extension(access: DataFrame, as_of, days: int = 30) -> DataFrame:
    if not 1 <= days <= 365:
        raise ValueError("days must lie between 1 and 365")
    return access.filter("is_active").withColumn(
        "new_expires_at", F.date_add(F.coalesce(F.col("expires_at").cast("date"), C.day(as_of)), days)
    )


# --- invitations --------------------------------------------------------------------------------

INVITE_HOURS = 72


def new_invites(members: DataFrame, requests: DataFrame, hours: int = INVITE_HOURS) -> dict[str, DataFrame]:
    """Invites for the requested members (family_member_id, token, created_at); members turn pending.

    A member that is not asked keeps its state; one asked twice gets the latest request.
    """
    life = F.expr(f"interval {hours} hours")
    last = F.max(F.struct("created_at", "token"))
    asked = requests.groupBy(F.col("family_member_id").alias("id")).agg(last.alias("_r")).select(
        "id", F.col("_r.token").alias("token"), F.col("_r.created_at").alias("invite_sent_at")
    )
    invites = members.select("id", "user_id", "relationship").join(asked, "id").select(
        F.col("user_id").alias("inviter_id"),
        F.col("id").alias("family_member_id"),
        "relationship",
        "token",
        F.lit("pending").alias("status"),
        F.col("invite_sent_at").alias("created_at"),
        (F.col("invite_sent_at") + life).alias("expires_at"),
    )
    marked = members.join(asked.toDF("id", "_token", "_sent"), "id", "left")
    fresh = F.col("_token").isNotNull()

    def old(name: str, missing: Column) -> Column:
        return F.coalesce(F.col(name), missing) if name in members.columns else missing

    marked = marked.withColumns(
        {
            "invite_status": F.when(fresh, "pending").otherwise(old("invite_status", F.lit("not_invited"))),
            "invite_token": F.when(fresh, F.col("_token")).otherwise(old("invite_token", F.lit(None).cast("string"))),
            "invite_sent_at": F.when(fresh, F.col("_sent")).otherwise(old("invite_sent_at", F.lit(None).cast("timestamp"))),
        }
    )
    return {"invites": invites, "members": marked.drop("_token", "_sent")}


def invite_status(invites: DataFrame, now: Column) -> DataFrame:
    """Pending invites past their expiry turn expired; ``is_valid`` marks those that can be used."""
    late = F.coalesce(F.col("expires_at") < now, F.lit(False))
    pending = F.col("status") == "pending"
    return invites.withColumns(
        {"is_valid": pending & ~late, "status": F.when(pending & late, "expired").otherwise(F.col("status"))}
    )


def expired_invites(changes: DataFrame, until: Column, hours: int = INVITE_HOURS) -> DataFrame:
    """Tokens (token, expired_at) whose last invite ran out up to ``until``: nothing answered it or came after it.

    ``changes`` are the events (token, status, at) that the stream of invites reads.
    """
    pending = F.col("status") == "pending"
    last = changes.groupBy("token").agg(F.max(F.when(pending, F.col("at"))).alias("sent"), F.max(F.when(~pending, F.col("at"))).alias("answered"))
    ends = F.col("sent") + F.expr(f"interval {hours} hours")
    open_ones = last.filter(F.col("sent").isNotNull() & (F.col("answered").isNull() | (F.col("sent") > F.col("answered"))))
    return open_ones.select("token", ends.alias("expired_at")).filter(F.col("expired_at") <= until)


def invite_details(invites: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    inviters = users.select(F.col("id").alias("inviter_id"), F.col("full_name").alias("inviter_name"))
    return (
        invite_status(invites, now)
        .filter("is_valid")
        .join(inviters, "inviter_id")
        .select("token", "inviter_name", "relationship", "expires_at", "family_member_id")
    )


def accept_invites(
    invites: DataFrame, members: DataFrame, acceptances: DataFrame, now: Column
) -> dict[str, DataFrame]:
    """Apply acceptances (token, new_user_id) of valid invites to the invite and member tables.

    An invite is accepted once: by the smallest user id if several accept it.  Earlier answers stay.
    """
    once = acceptances.groupBy("token").agg(F.min("new_user_id").alias("new_user_id"))
    answered = F.col("responded_at") if "responded_at" in invites.columns else F.lit(None).cast("timestamp")
    valid = (
        invite_status(invites, now)
        .filter("is_valid")
        .join(once, "token")
        .select("token", "family_member_id", "new_user_id")
    )
    done = valid.select("token", F.lit(True).alias("_done")).distinct()
    new_invites_ = (
        invite_status(invites, now)
        .drop("is_valid")
        .join(done, "token", "left")
        .withColumn("status", F.when(F.col("_done"), "accepted").otherwise(F.col("status")))
        .withColumn("responded_at", F.when(F.col("_done"), now).otherwise(answered))
        .drop("_done")
    )
    links = valid.filter("family_member_id is not null").groupBy(F.col("family_member_id").alias("id")).agg(
        F.max_by("new_user_id", "token").alias("_new")
    )
    new_members = (
        members.join(links, "id", "left")
        .withColumn("invite_status", F.when(F.col("_new").isNotNull(), "accepted").otherwise(F.col("invite_status") if "invite_status" in members.columns else F.lit("not_invited")))
        .withColumn("related_user_id", F.coalesce("_new", "related_user_id"))
        .drop("_new")
    )
    return {"invites": new_invites_, "members": new_members}
