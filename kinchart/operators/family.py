"""Family graph, generations, shared conditions and hereditary patterns, for all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinchart.functions import columns as C
from kinchart.operators.records import top_per_key
from kinchart.sources import dimensions as dims
from kinchart.sources import fixed_values as fixed

WEIGHT = "decimal(12,4)"


# --- conventions for generations and weights ---------------------------------------------------


def generation_stored(relationship: Column) -> Column:
    """Convention of the stored members: ancestors positive."""
    known = dims.lookup(dims.rows("GENERATIONS", 2))
    return F.coalesce(F.try_element_at(known, relationship).cast("int"), F.lit(0))


def _has(rel: Column, *parts: str) -> Column:
    return rel.rlike("|".join(parts))


def generation_signed(relationship: Column, compat: bool = False) -> Column:
    """Convention of the pattern score: ancestors negative.

    Grandchildren are tested before children; ``compat`` tests them after, where they count as +1.
    """
    rel = F.replace(F.lower(F.coalesce(relationship, F.lit(""))), F.lit(" "), F.lit("_"))
    elder = F.when(_has(rel, "grandfather", "grandmother", "grandparent"), -2)
    if not compat:
        elder = elder.when(_has(rel, "grandson", "granddaughter", "grandchild"), 2)
    return (
        elder.when(_has(rel, "father", "mother", "parent"), -1)
        .when(_has(rel, "son", "daughter", "child"), 1)
        .when(_has(rel, "brother", "sister", "sibling"), 0)
        .when(_has(rel, "uncle", "aunt"), -1)
        .otherwise(0)
    )


def generation_graph(relationship: Column, compat: bool = False) -> Column:
    """Convention of the family graph: as the signed one, and great-grandparents at -3."""
    rel = F.lower(F.coalesce(relationship, F.lit("unknown")))
    grand = rel.contains("grand")
    elder = F.when(rel.contains("great") & grand, -3).when(grand & _has(rel, "father", "mother", "parent"), -2)
    if not compat:
        elder = elder.when(_has(rel, "grandson", "granddaughter", "grandchild"), 2)
    return (
        elder.when(_has(rel, "father", "mother", "parent"), -1)
        .when(_has(rel, "son", "daughter", "child"), 1)
        .when(_has(rel, "uncle", "aunt"), -1)
        .otherwise(0)
    )


def closeness_weight(relationship: Column, partial: str | None = None) -> Column:
    """Closeness of a relationship: exact entry, else 0.25.

    ``partial`` adds a second step over the entries in their order: ``"inside"`` takes the first entry
    contained in the relationship, ``"either"`` also the first that contains it (so "other" is found
    in "mother").
    """
    entries = dims.rows("CLOSENESS_WEIGHTS", 2)
    rel = F.replace(F.trim(F.lower(relationship)), F.lit(" "), F.lit("_"))
    steps = [F.try_element_at(dims.lookup(entries), rel).cast(WEIGHT)]
    if partial:
        chain = None
        for key, weight in entries:
            hit = rel.contains(key)
            if partial == "either":
                hit = hit | F.lit(key).contains(rel)
            value = F.lit(weight).cast(WEIGHT)
            chain = F.when(hit, value) if chain is None else chain.when(hit, value)
        steps.append(chain)
    return F.coalesce(*steps, F.lit("0.25").cast(WEIGHT))


# --- members and their conditions -------------------------------------------------------------


def member_derived(members: DataFrame) -> DataFrame:
    return members.withColumns(
        {
            "generation": generation_stored(F.col("relationship")),
            "is_linked": F.col("related_user_id").isNotNull(),
        }
    )


def members_by_created(members: DataFrame) -> DataFrame:
    return members.orderBy("created_at", "id")


def member_conditions(
    records: DataFrame, entities: DataFrame, distinct: bool = True, use_corrections: bool = False
) -> DataFrame:
    """Diseases of each family member with the number of entries (1 each where ``distinct``).

    Equal values of a record are folded before the join, so neither a huge record nor a common
    disease is shuffled row by row.
    """
    value = C.effective_value() if use_corrections else F.col("entity_value")
    per_record = (
        entities.filter(F.col("entity_type") == "disease")
        .groupBy("record_id", value.alias("condition"))
        .agg(F.count("*").alias("_n"))
    )
    owned = records.filter(F.col("family_member_id").isNotNull()).select(
        F.col("id").alias("record_id"), F.col("family_member_id").alias("member_id")
    )
    entries = F.lit(1).cast("bigint") if distinct else F.sum("_n")
    return per_record.join(owned, "record_id").groupBy("member_id", "condition").agg(entries.alias("entries"))


def _with_member(conditions: DataFrame, members: DataFrame) -> DataFrame:
    return conditions.join(members.withColumnRenamed("id", "member_id"), "member_id")


def hereditary_pattern_members(members: DataFrame, conditions: DataFrame) -> DataFrame:
    """One row per user, disease and affected member entry, with generation and risk share.

    Values are made distinct per member before they are folded to lower case, so two spellings of
    one disease count twice.
    """
    relations = dims.relationships(members.sparkSession).select("relationship", "generation", "weight")
    joined = _with_member(conditions, members).join(F.broadcast(relations), "relationship", "left")
    return joined.select(
        "user_id",
        F.lower("condition").alias("disease"),
        "member_id",
        "name",
        "relationship",
        F.coalesce("generation", F.lit(0)).alias("generation"),
        F.coalesce("weight", F.lit("0.05").cast("decimal(4,2)")).alias("weight"),
    )


def hereditary_patterns(members: DataFrame, conditions: DataFrame, min_members: int = 1) -> DataFrame:
    """Cumulated family risk of each disease of each user, capped at 0.85."""
    risk = F.least(F.sum("weight"), F.lit("0.85").cast("decimal(14,2)"))
    return (
        hereditary_pattern_members(members, conditions)
        .groupBy("user_id", "disease")
        .agg(
            F.count("*").alias("affected_members"),
            # the generations come from a fixed list, so the set stays tiny
            F.size(F.collect_set("generation")).alias("generation_count"),
            F.round(risk, 3).alias("risk_to_user"),
        )
        .filter(F.col("affected_members") >= min_members)
        .withColumn("risk_level", C.risk_level("risk_to_user", 0.25, 0.5))
    )


def keyword_matches(rows: DataFrame, text: str, classes: list[tuple[str, list[str]]], out: str) -> DataFrame:
    """One row per input row and class any of whose keywords the text contains (an in-row test)."""
    hits = F.array_compact(F.array(*[F.when(C.any_word(F.col(text), kws), F.lit(k)) for k, kws in classes]))
    return rows.withColumn(out, F.explode(hits))


def tracked_diseases() -> list[tuple[str, list[str]]]:
    return [(r[0], dims.words(r[5])) for r in dims.rows("HEREDITARY_DISEASES", 6)]


def member_tracked_diseases(conditions: DataFrame) -> DataFrame:
    """Tracked diseases of each member, each once."""
    matched = keyword_matches(conditions, "condition", tracked_diseases(), "disease_key")
    return matched.select("member_id", "disease_key").distinct()


def weighted_patterns(members: DataFrame, conditions: DataFrame, compat: bool = False) -> DataFrame:
    """Closeness- and heritability-weighted score of each tracked disease in each family."""
    generation = generation_signed(F.col("relationship"), compat)
    rel = F.lower(F.coalesce("relationship", F.lit("unknown")))
    shown = C.py_title(F.replace(rel, F.lit("_"), F.lit(" ")))
    scored = (
        _with_member(member_tracked_diseases(conditions), members)
        .groupBy("user_id", "disease_key")
        .agg(
            F.count("*").alias("affected_count"),
            F.sum(closeness_weight(rel, "either" if compat else None)).alias("raw_score"),
            F.sum(closeness_weight(rel, "inside" if compat else None)).alias("scorer_raw"),
            F.size(F.collect_set(generation)).alias("generation_span"),
            F.min_by(shown, F.struct("created_at", "member_id")).alias("top_relative"),
        )
    )
    known = F.broadcast(dims.hereditary_diseases(members.sparkSession).drop("ord"))
    adjusted = F.col("raw_score") * F.col("heritability")
    flag = F.when(adjusted >= 1.5, "high").when(adjusted >= 0.8, "moderate").otherwise("low")
    result = scored.join(known, "disease_key").select(
        "user_id",
        "disease_key",
        "disease",
        "icd10",
        "model_key",
        "heritability",
        "affected_count",
        F.round("raw_score", 3).alias("raw_score"),
        adjusted.alias("adjusted_score"),
        F.round(adjusted, 3).alias("weighted_score"),
        flag.alias("risk_flag"),
        "scorer_raw",
        "generation_span",
        "top_relative",
    )
    return result.withColumn("generation_span", F.lit(1)) if compat else result


def pattern_boost(patterns: DataFrame) -> DataFrame:
    """Largest boost per user and model among flagged patterns."""
    boost = F.least(F.lit("0.25").cast("decimal(20,10)"), F.col("heritability") * F.col("adjusted_score") * F.expr("0.08"))
    return (
        patterns.filter(F.col("model_key").isNotNull() & F.col("risk_flag").isin("high", "moderate"))
        .groupBy("user_id", "model_key")
        .agg(F.max(boost).alias("boost"))
    )


def heritability_boost(patterns: DataFrame) -> DataFrame:
    """The scorer's variant: no flag needed, heritability enters once, rounded to four places."""
    boost = F.least(
        F.lit("0.25").cast("decimal(20,10)"), F.col("scorer_raw") * F.col("heritability") * F.expr("0.08")
    )
    return (
        patterns.filter(F.col("model_key").isNotNull())
        .groupBy("user_id", "model_key")
        .agg(F.max(F.round(boost, 4)).alias("boost"))
    )


def _percent() -> Column:
    return F.concat(F.floor(F.col("heritability") * 100).cast("string"), F.lit("%"))


def heritability_summary(patterns: DataFrame) -> DataFrame:
    pct = _percent()
    text = F.lit(None).cast("string")
    for least, form in reversed(fixed.HERITABILITY_SENTENCES):
        told = C.sentence(form, percent=pct)
        text = told if least == 0 else F.when(F.col("weighted_score") >= least, told).otherwise(text)
    return patterns.filter(F.col("risk_flag") != "low").select(
        "user_id",
        "disease",
        pct.alias("heritability_pct"),
        F.col("affected_count").alias("affected_family_members"),
        "risk_flag",
        "weighted_score",
        text.alias("interpretation"),
    )


def shared_risk_summary(patterns: DataFrame) -> DataFrame:
    return patterns.filter(F.col("risk_flag") != "low").select(
        "user_id", "disease", "risk_flag", "affected_count", _percent().alias("heritability_pct"), "top_relative"
    )


def dominant_factors(patterns: DataFrame, top: int = 3) -> DataFrame:
    flagged = patterns.filter(F.col("risk_flag") != "low")
    return top_per_key(flagged, ["user_id"], [F.desc("weighted_score"), F.asc("disease")], top).select(
        "user_id", "rank", "disease", "risk_flag", "weighted_score"
    )


# --- family graph -------------------------------------------------------------------------------


def user_node(user_id: Column) -> Column:
    return F.concat(F.lit("u"), user_id.cast("string"))


def member_node(member_id: Column) -> Column:
    return F.concat(F.lit("m"), member_id.cast("string"))


def family_edges(members: DataFrame, compat: bool = False) -> DataFrame:
    """Ancestor to user, user to descendant, and both ways for the user's own generation."""
    gen = generation_graph(F.col("relationship"), compat)
    rel = F.lower(F.coalesce("relationship", F.lit("unknown")))
    user, member = user_node(F.col("user_id")), member_node(F.col("id"))
    edge = lambda s, t, r: F.struct(s.alias("source"), t.alias("target"), r.alias("relationship_type"))
    sibling = F.lit("sibling")
    edges = (
        F.when(gen < 0, F.array(edge(member, user, rel)))
        .when(gen > 0, F.array(edge(user, member, rel)))
        .otherwise(F.array(edge(member, user, sibling), edge(user, member, sibling)))
    )
    return members.select("user_id", F.inline(edges))


def family_nodes(users: DataFrame, members: DataFrame, conditions: DataFrame, compat: bool = False) -> DataFrame:
    """The user and every member as graph nodes with a risk colour from the member's conditions."""
    risk = conditions.groupBy("member_id").agg(
        F.max(C.any_word(F.col("condition"), dims.words(fixed.NODE_HIGH_WORDS))).alias("_high"),
        F.max(C.any_word(F.col("condition"), dims.words(fixed.NODE_MODERATE_WORDS))).alias("_moderate"),
        F.sum("entries").alias("condition_count"),
    )
    level = (
        F.when(F.col("_high"), "high")
        .when(F.col("_moderate"), "moderate")
        .when(F.col("condition_count") > 0, "low")
        .otherwise("unknown")
    )
    kin = (
        members.withColumnRenamed("id", "member_id")
        .join(risk, "member_id", "left")
        .select(
            "user_id",
            member_node(F.col("member_id")).alias("node"),
            F.coalesce("name", F.lit("Unknown")).alias("name"),
            F.lower(F.coalesce("relationship", F.lit("unknown"))).alias("relationship"),
            generation_graph(F.col("relationship"), compat).alias("generation"),
            F.coalesce("condition_count", F.lit(0)).alias("condition_count"),
            level.alias("risk_level"),
            F.lit(False).alias("is_user"),
        )
    )
    selves = users.select(
        F.col("id").alias("user_id"),
        user_node(F.col("id")).alias("node"),
        F.col("full_name").alias("name"),
        F.lit("self").alias("relationship"),
        F.lit(0).alias("generation"),
        F.lit(0).cast("bigint").alias("condition_count"),
        F.lit("unknown").alias("risk_level"),
        F.lit(True).alias("is_user"),
    )
    return selves.unionByName(kin)


def risk_overlay(
    users: DataFrame, members: DataFrame, conditions: DataFrame, compat: bool = False
) -> dict[str, DataFrame]:
    """Node and edge tables of all family graphs; a single graph is both filtered by user_id."""
    return {
        "nodes": family_nodes(users, members, conditions, compat),
        "edges": family_edges(members, compat),
    }


def graph_stats(users: DataFrame, members: DataFrame) -> DataFrame:
    edges = F.when(generation_graph(F.col("relationship")) == 0, 2).otherwise(1)
    kin = members.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("_m"), F.sum(edges).alias("_e"))
    return users.select("id").join(kin, "id", "left").select(
        F.col("id").alias("user_id"),
        (F.coalesce("_m", F.lit(0)) + 1).alias("nodes"),
        F.coalesce("_e", F.lit(0)).alias("edges"),
    )


def _reach(members: DataFrame, ancestors: bool, max_depth: int, link_accounts: bool) -> DataFrame:
    """Breadth-first walk from every user at once, each member once with its first depth.

    Members link to their user only, so one step is complete unless a member's own account is
    followed (``link_accounts``).  The depth is a small constant.  Each level follows the distinct links of the
    one before; the least depth of a member is taken once, at the end, so no level is met with those before it.
    """
    gen = generation_graph(F.col("relationship"))
    side = members.filter((gen < 0) | (gen == 0) if ancestors else (gen > 0) | (gen == 0)).select(
        F.col("user_id").alias("node_user"),
        F.col("id").alias("member_id"),
        "name",
        "relationship",
        gen.alias("generation"),
        "related_user_id",
    )
    reached = side.withColumn("user_id", F.col("node_user")).withColumn("depth", F.lit(1))
    if link_accounts:
        own_link = F.col("related_user_id").eqNullSafe(F.col("user_id"))
        reached = frontier = reached.filter(~own_link)
        for depth in range(2, max_depth + 1):
            links = frontier.filter(F.col("related_user_id").isNotNull())
            ahead = links.select("user_id", F.col("related_user_id").alias("node_user")).distinct()
            frontier = ahead.join(side, "node_user").filter(~own_link).withColumn("depth", F.lit(depth))
            reached = reached.unionByName(frontier)
        first = F.min(F.struct("depth", "name", "relationship", "generation"))
        reached = reached.groupBy("user_id", "member_id").agg(first.alias("_f")).select("user_id", "member_id", "_f.*")
    return reached.select("user_id", "member_id", "name", "relationship", "generation", "depth")


def ancestors(members: DataFrame, max_depth: int = 3, link_accounts: bool = False) -> DataFrame:
    return _reach(members, True, max_depth, link_accounts)


def descendants(members: DataFrame, max_depth: int = 2, link_accounts: bool = False) -> DataFrame:
    return _reach(members, False, max_depth, link_accounts)


def shared_conditions(members: DataFrame, conditions: DataFrame, min_holders: int = 2) -> DataFrame:
    """Conditions with two or more entries in a family; entries of one member count separately."""
    return (
        _with_member(conditions, members)
        .groupBy("user_id", F.lower("condition").alias("condition"))
        .agg(F.sum("entries").alias("holders"))
        .filter(F.col("holders") >= min_holders)
    )


def shared_condition_holders(members: DataFrame, conditions: DataFrame, min_holders: int = 2) -> DataFrame:
    """The members behind each shared condition, one row per member."""
    holders = _with_member(conditions, members).select(
        "user_id", F.lower("condition").alias("condition"), "member_id", "name", "entries"
    )
    shared = shared_conditions(members, conditions, min_holders)
    return holders.join(shared.select("user_id", "condition"), ["user_id", "condition"], "left_semi")


def prevalence_by_generation(members: DataFrame, conditions: DataFrame) -> DataFrame:
    return (
        _with_member(conditions, members)
        .groupBy(
            "user_id",
            generation_graph(F.col("relationship")).alias("generation"),
            F.lower("condition").alias("condition"),
        )
        .agg(F.sum("entries").alias("occurrences"))
    )


def family_tree(members: DataFrame, conditions: DataFrame) -> DataFrame:
    """Every member with its conditions as further rows, and the size of the user's family."""
    totals = members.groupBy("user_id").agg(F.count("*").alias("total_members"))
    return (
        member_derived(members)
        .withColumnRenamed("id", "member_id")
        .join(conditions.select("member_id", "condition"), "member_id", "left")
        .join(totals, "user_id")
    )


def family_risk_map(
    members: DataFrame, conditions: DataFrame, predictions: DataFrame
) -> dict[str, DataFrame]:
    """Nodes, distinct conditions and active predictions, each keyed by user_id."""
    return {
        "nodes": family_tree(members, conditions),
        "hereditary_diseases": _with_member(conditions, members).select("user_id", "condition").distinct(),
        "predictions": predictions.filter("is_active"),
    }


def generation_groups(members: DataFrame) -> DataFrame:
    gen = generation_stored(F.col("relationship"))
    group = F.when(gen >= 2, "grandparents").when(gen == 1, "parents").otherwise("own_and_younger")
    return members.groupBy("user_id", group.alias("generation_group")).agg(F.count("*").alias("members"))
