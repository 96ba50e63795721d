"""Queries over the family graph and hereditary patterns."""

from pyspark.sql import functions as F

from kinchart.operators import family as K
from kinchart.plans.record_queries import EFF, title_sql
from kinchart.plans.registry import query, relation
from kinchart.sources import dimensions as dims
from kinchart.sources import fixed_values as fixed

GEN_SQL = "case relationship " + " ".join(
    f"when '{r}' then {g}" for r, g in dims.rows("GENERATIONS", 2)
) + " else 0 end"
SHARE_SQL = "case relationship " + " ".join(
    f"when '{r}' then {w}" for r, w in dims.rows("SHARED_RISK_WEIGHTS", 2)
) + " else 0.05 end"
CLOSE_SQL = "cast(case relationship " + " ".join(
    f"when '{r}' then {w}" for r, w in dims.rows("CLOSENESS_WEIGHTS", 2)
) + " else 0.25 end as decimal(12,4))"
# The two looser lookups; "inside": an entry in the relationship, "either": also the other way round.
LOOSE = {
    mode: "cast(coalesce("
    + "case relationship "
    + " ".join(f"when '{r}' then {w}" for r, w in dims.rows("CLOSENESS_WEIGHTS", 2))
    + " end, case "
    + " ".join(
        f"when contains(relationship, '{r}')"
        + (f" or contains('{r}', relationship)" if mode == "either" else "")
        + f" then {w}"
        for r, w in dims.rows("CLOSENESS_WEIGHTS", 2)
    )
    + " end, 0.25) as decimal(12,4))"
    for mode in ("inside", "either")
}
SIGNED_SQL = """case when relationship similar to '.*(grandfather|grandmother|grandparent).*' then -2
  when relationship similar to '.*(grandson|granddaughter|grandchild).*' then 2
  when relationship similar to '.*(father|mother|parent).*' then -1
  when relationship similar to '.*(son|daughter|child).*' then 1
  when relationship similar to '.*(brother|sister|sibling).*' then 0
  when relationship similar to '.*(uncle|aunt).*' then -1 else 0 end"""
GRAPH_SQL = """case when contains(relationship, 'great') and contains(relationship, 'grand') then -3
  when contains(relationship, 'grand') and relationship similar to '.*(father|mother|parent).*' then -2
  when relationship similar to '.*(grandson|granddaughter|grandchild).*' then 2
  when relationship similar to '.*(father|mother|parent).*' then -1
  when relationship similar to '.*(son|daughter|child).*' then 1
  when relationship similar to '.*(uncle|aunt).*' then -1 else 0 end"""

relation(
    "or_conditions",
    """select distinct r.family_member_id as member_id, entity_value as condition from fx_records r
       join fx_entities e on e.record_id = r.id where entity_type = 'disease' and family_member_id is not null""",
)
relation(
    "or_entries",
    f"""select r.family_member_id as member_id, {EFF} as condition, count(*) as entries from fx_records r
        join fx_entities e on e.record_id = r.id
        where entity_type = 'disease' and family_member_id is not null group by 1, 2""",
)


def conditions(t, **kw):
    return K.member_conditions(t.records, t.entities, **kw)


query(
    "member_derived",
    "id bigint, generation int, is_linked boolean",
    f"select id, {GEN_SQL} as generation, related_user_id is not null as is_linked from fx_members",
)(lambda t: K.member_derived(t.members))
query(
    "members_by_created",
    "id bigint, user_id bigint, created_at timestamp",
    "select id, user_id, created_at from fx_members order by created_at, id",
)(lambda t: K.members_by_created(t.members))
query("member_conditions", "member_id bigint, condition string", "select * from or_conditions")(
    lambda t: conditions(t)
)
query(
    "member_conditions_corrected",
    "member_id bigint, condition string, entries bigint",
    "select * from or_entries",
)(lambda t: conditions(t, distinct=False, use_corrections=True))
query(
    "hereditary_patterns",
    "user_id bigint, disease string, affected_members bigint, generation_count int, risk_to_user double, "
    "risk_level string",
    f"""select *, case when risk_to_user >= 0.5 then 'high' when risk_to_user >= 0.25 then 'moderate' else 'low' end
        as risk_level from (select user_id, lower(condition) as disease, count(*) as affected_members,
        count(distinct {GEN_SQL}) as generation_count, least(sum({SHARE_SQL}), 0.85) as risk_to_user
        from or_conditions join fx_members m on m.id = member_id group by 1, 2)""",
)(lambda t: K.hereditary_patterns(t.members, conditions(t)))
query(
    "hereditary_pattern_members",
    "user_id bigint, disease string, member_id bigint, name string, relationship string, generation int, weight double",
    f"""select user_id, lower(condition) as disease, member_id, name, relationship, {GEN_SQL} as generation,
        {SHARE_SQL} as weight from or_conditions join fx_members m on m.id = member_id""",
)(lambda t: K.hereditary_pattern_members(t.members, conditions(t)))

DISEASES = dims.rows("HEREDITARY_DISEASES", 6)
TRACKED_SQL = "(values " + ", ".join(
    f"('{r[0]}', '{r[1]}', '{r[2]}', cast({r[3]} as decimal(4,2)), {dims.quote(r[4])}, '{kw.lower()}')"
    for r in DISEASES
    for kw in dims.words(r[5])
) + ") as k(disease_key, disease, icd10, heritability, model_key, keyword)"
relation(
    "or_tracked",
    f"""select distinct member_id, disease_key, disease, icd10, heritability, model_key
        from or_entries join {TRACKED_SQL} on contains(lower(condition), keyword)""",
)


def patterns_sql(weight: str, scorer: str, span: str) -> str:
    return f"""select user_id, disease_key, disease, icd10, model_key, heritability, affected_count, raw_score,
      scorer_raw, raw_score * heritability as adjusted_score, round(raw_score * heritability, 3) as weighted_score,
      case when raw_score * heritability >= 1.5 then 'high' when raw_score * heritability >= 0.8 then 'moderate'
        else 'low' end as risk_flag, generation_span, top_relative
      from (select user_id, disease_key, disease, icd10, model_key, heritability, count(*) as affected_count,
        sum({weight}) as raw_score, sum({scorer}) as scorer_raw, {span} as generation_span,
        arg_min({title_sql("replace(relationship, '_', ' ')")}, row(created_at, m.id)) as top_relative
        from or_tracked join fx_members m on m.id = member_id group by all)"""


relation("or_patterns", patterns_sql(CLOSE_SQL, CLOSE_SQL, f"count(distinct {SIGNED_SQL})"))
relation("or_patterns_compat", patterns_sql(LOOSE["either"], LOOSE["inside"], "1"))
PATTERN = (
    "user_id bigint, disease_key string, disease string, icd10 string, affected_count bigint, raw_score double, "
    "weighted_score double, risk_flag string, generation_span int"
)


def patterns(t, compat=False):
    entries = conditions(t, distinct=False, use_corrections=True)
    return K.weighted_patterns(t.members, entries, compat)


query(
    "keyword_match_join",
    "member_id bigint, disease_key string",
    "select member_id, disease_key from or_tracked",
)(lambda t: K.member_tracked_diseases(conditions(t, use_corrections=True)))
query("weighted_patterns", PATTERN, "select * from or_patterns")(lambda t: patterns(t))
query("weighted_patterns_compat", PATTERN, "select * from or_patterns_compat")(lambda t: patterns(t, True))
relation(
    "or_boost",
    """select user_id, model_key, max(least(0.25, heritability * adjusted_score * 0.08)) as boost
       from or_patterns where model_key is not null and risk_flag <> 'low' group by 1, 2""",
)
query(
    "pattern_boost",
    "user_id bigint, model_key string, boost double",
    "select user_id, model_key, round(boost, 6) as boost from or_boost",
)(lambda t: K.pattern_boost(patterns(t)).withColumn("boost", F.round("boost", 6)))
query(
    "heritability_boost",
    "user_id bigint, model_key string, boost double",
    """select user_id, model_key, max(round(least(0.25, scorer_raw * heritability * 0.08), 4)) as boost
       from or_patterns where model_key is not null group by 1, 2""",
)(lambda t: K.heritability_boost(patterns(t)))
query(
    "heritability_summary",
    "user_id bigint, disease string, heritability_pct string, affected_family_members bigint, risk_flag string, "
    "weighted_score double, interpretation string",
    """select user_id, disease, pct as heritability_pct, affected_count as affected_family_members, risk_flag,
       weighted_score, case when weighted_score >= 2.25 then 'Strong family history across multiple generations. This condition has '
         || pct || ' heritability. Regular screening is strongly recommended.'
       when weighted_score >= 1.5 then 'Significant family history detected. With ' || pct
         || ' heritability, early detection and prevention are important.'
       else 'Moderate family history detected. This condition has ' || pct
         || ' heritability. Maintain awareness and schedule routine checkups.' end as interpretation
       from (select *, cast(cast(floor(heritability * 100) as int) as varchar) || '%' as pct from or_patterns)
       where risk_flag <> 'low'""",
)(lambda t: K.heritability_summary(patterns(t)))
query(
    "shared_risk_summary",
    "user_id bigint, disease string, risk_flag string, affected_count bigint, heritability_pct string, "
    "top_relative string",
    """select *, cast(cast(floor(heritability * 100) as int) as varchar) || '%' as heritability_pct
       from or_patterns where risk_flag <> 'low'""",
)(lambda t: K.shared_risk_summary(patterns(t)))
query(
    "dominant_factors",
    "user_id bigint, rank int, disease string, risk_flag string, weighted_score double",
    """select * from (select *, row_number() over (partition by user_id order by weighted_score desc, disease)
       as rank from or_patterns where risk_flag <> 'low') where rank <= 3""",
)(lambda t: K.dominant_factors(patterns(t)))
query(
    "generation_number",
    "id bigint, stored int, signed int, graph int",
    f"select id, {GEN_SQL} as stored, {SIGNED_SQL} as signed, {GRAPH_SQL} as graph from fx_members",
)(
    lambda t: t.members.select(
        "id",
        K.generation_stored(F.col("relationship")).alias("stored"),
        K.generation_signed(F.col("relationship")).alias("signed"),
        K.generation_graph(F.col("relationship")).alias("graph"),
    )
)
query(
    "relationship_weight",
    "id bigint, exact double, inside double, either double",
    f"select id, {CLOSE_SQL} as exact, {LOOSE['inside']} as inside, {LOOSE['either']} as either from fx_members",
)(
    lambda t: t.members.select(
        "id",
        K.closeness_weight(F.col("relationship")).alias("exact"),
        K.closeness_weight(F.col("relationship"), "inside").alias("inside"),
        K.closeness_weight(F.col("relationship"), "either").alias("either"),
    )
)

relation(
    "or_edges",
    f"""select user_id, unnest(case when g <= 0 then [m] else [] end || case when g >= 0 then [u] else [] end) as source,
        unnest(case when g <= 0 then [u] else [] end || case when g >= 0 then [m] else [] end) as target,
        case when g = 0 then 'sibling' else relationship end as relationship_type
        from (select *, {GRAPH_SQL} as g, 'u' || cast(user_id as varchar) as u, 'm' || cast(id as varchar) as m
              from fx_members)""",
)
EDGE = "user_id bigint, source string, target string, relationship_type string"
query("family_edges", EDGE, "select * from or_edges")(lambda t: K.family_edges(t.members))
HIGH = "|".join(dims.words(fixed.NODE_HIGH_WORDS))
MODERATE = "|".join(dims.words(fixed.NODE_MODERATE_WORDS))
relation(
    "or_nodes",
    f"""select id as user_id, 'u' || cast(id as varchar) as node, full_name as name, 'self' as relationship,
        0 as generation, 0 as condition_count, 'unknown' as risk_level, true as is_user from fx_users
        union all
        select user_id, 'm' || cast(id as varchar), name, relationship, {GRAPH_SQL}, coalesce(n, 0),
          case when hi then 'high' when mo then 'moderate' when n > 0 then 'low' else 'unknown' end, false
        from fx_members left join (select member_id, sum(entries) as n,
          bool_or(regexp_matches(lower(condition), '{HIGH}')) as hi,
          bool_or(regexp_matches(lower(condition), '{MODERATE}')) as mo
          from or_entries group by 1) c on c.member_id = id""",
)
NODE = (
    "user_id bigint, node string, name string, relationship string, generation int, condition_count bigint, "
    "risk_level string, is_user boolean"
)


def entries(t):
    return conditions(t, distinct=False, use_corrections=True)


query("family_nodes", NODE, "select * from or_nodes")(lambda t: K.family_nodes(t.users, t.members, entries(t)))
query("risk_overlay_nodes", NODE, "select * from or_nodes")(
    lambda t: K.risk_overlay(t.users, t.members, entries(t))["nodes"]
)
query("risk_overlay_edges", EDGE, "select * from or_edges")(
    lambda t: K.risk_overlay(t.users, t.members, entries(t))["edges"]
)
query(
    "graph_stats",
    "user_id bigint, nodes bigint, edges bigint",
    """select n.user_id, nodes, coalesce(edges, 0) as edges from (select user_id, count(*) as nodes from or_nodes
       group by 1) n left join (select user_id, count(*) as edges from or_edges group by 1) e
       on e.user_id = n.user_id""",
)(lambda t: K.graph_stats(t.users, t.members))

REACH = "user_id bigint, member_id bigint, relationship string, generation int, depth int"


def star_sql(side: str) -> str:
    return f"""select user_id, id as member_id, relationship, {GRAPH_SQL} as generation, 1 as depth
               from fx_members where {GRAPH_SQL} {side} 0"""


query("ancestors", REACH, star_sql("<="))(lambda t: K.ancestors(t.members))
query("descendants", REACH, star_sql(">="))(lambda t: K.descendants(t.members))
query(
    "ancestors_linked",
    REACH,
    f"""with side as (select *, {GRAPH_SQL} as generation from fx_members where {GRAPH_SQL} <= 0),
        d1 as (select user_id, id, relationship, generation, related_user_id, 1 as depth from side
               where related_user_id is distinct from user_id),
        d2 as (select d1.user_id, s.id, s.relationship, s.generation, s.related_user_id, 2 as depth from d1
               join side s on s.user_id = d1.related_user_id where s.related_user_id is distinct from d1.user_id),
        d3 as (select d2.user_id, s.id, s.relationship, s.generation, s.related_user_id, 3 as depth from d2
               join side s on s.user_id = d2.related_user_id where s.related_user_id is distinct from d2.user_id)
        select user_id, id as member_id, relationship, generation, min(depth) as depth
        from (select * from d1 union all select * from d2 union all select * from d3) group by 1, 2, 3, 4""",
)(lambda t: K.ancestors(t.members, link_accounts=True))
relation(
    "or_shared",
    """select user_id, lower(condition) as condition, sum(entries) as holders from or_entries
       join fx_members m on m.id = member_id group by 1, 2 having sum(entries) >= 2""",
)
query("shared_conditions", "user_id bigint, condition string, holders bigint", "select * from or_shared")(
    lambda t: K.shared_conditions(t.members, entries(t))
)
query(
    "shared_condition_holders",
    "user_id bigint, condition string, member_id bigint, name string, entries bigint",
    """select m.user_id, lower(o.condition) as condition, member_id, name, entries from or_entries o
       join fx_members m on m.id = member_id
       join or_shared s on s.user_id = m.user_id and s.condition = lower(o.condition)""",
)(lambda t: K.shared_condition_holders(t.members, entries(t)))
query(
    "prevalence_by_generation",
    "user_id bigint, generation int, condition string, occurrences bigint",
    f"""select user_id, {GRAPH_SQL} as generation, lower(condition) as condition, sum(entries) as occurrences
        from or_entries join fx_members m on m.id = member_id group by 1, 2, 3""",
)(lambda t: K.prevalence_by_generation(t.members, entries(t)))
TREE = (
    "user_id bigint, member_id bigint, relationship string, generation int, is_linked boolean, condition string, "
    "total_members bigint"
)
relation(
    "or_tree",
    f"""select m.user_id, m.id as member_id, relationship, {GEN_SQL} as generation,
        related_user_id is not null as is_linked, condition, total_members from fx_members m
        join (select user_id, count(*) as total_members from fx_members group by 1) n on n.user_id = m.user_id
        left join or_conditions c on c.member_id = m.id""",
)
query("family_tree", TREE, "select * from or_tree")(lambda t: K.family_tree(t.members, conditions(t)))
query("family_risk_map_nodes", TREE, "select * from or_tree")(
    lambda t: K.family_risk_map(t.members, conditions(t), t.predictions)["nodes"]
)
query(
    "family_risk_map_predictions",
    "id bigint, user_id bigint, disease_name string, probability double",
    "select id, user_id, disease_name, probability from fx_predictions where is_active",
)(lambda t: K.family_risk_map(t.members, conditions(t), t.predictions)["predictions"])
query(
    "family_risk_map",
    "user_id bigint, condition string",
    "select distinct user_id, condition from or_conditions join fx_members m on m.id = member_id",
)(lambda t: K.family_risk_map(t.members, conditions(t), t.predictions)["hereditary_diseases"])
query(
    "generation_groups",
    "user_id bigint, generation_group string, members bigint",
    f"""select user_id, case when {GEN_SQL} >= 2 then 'grandparents' when {GEN_SQL} = 1 then 'parents'
        else 'own_and_younger' end as generation_group, count(*) as members from fx_members group by 1, 2""",
)(lambda t: K.generation_groups(t.members))
