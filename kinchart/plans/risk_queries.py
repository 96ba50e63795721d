"""Queries over features, disease scores and risk profiles."""

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinchart.functions import columns as C
from kinchart.operators import family as K
from kinchart.operators import jobs as J
from kinchart.operators import models as L
from kinchart.operators import risk as S
from kinchart.plans.family_queries import patterns
from kinchart.plans.registry import query, relation
from kinchart.sources import dimensions as dims
from kinchart.sources.fixtures import AS_OF

CLASSES = {name: "|".join(w.lower() for w in dims.words(kws)) for name, kws in dims.rows("DISEASE_CLASSES", 2)}


def has(text: str, words: str) -> str:
    return f"regexp_matches(lower({text}), '{words}')"


relation("or_own", "select * from fx_records where family_member_id is null")
relation(
    "or_personal",
    f"""select id as user_id, cast(greatest(0, year(date '{AS_OF}') - year(date_of_birth)
        - case when month(date '{AS_OF}') * 100 + day(date '{AS_OF}') < month(date_of_birth) * 100 + day(date_of_birth)
          then 1 else 0 end) as double) as age, case when gender = 'male' then 1 else 0 end as gender_male
        from fx_users""",
)
PERSONAL = "user_id bigint, age double, gender_male int"
query("personal_features", PERSONAL, "select * from or_personal")(lambda t: S.personal_features(t.users, AS_OF))

HISTORY = ["record_count", "years_of_history", "disease_count", "unique_medicines_count"] + [
    f"has_{c}_history" for c in ("diabetes", "hypertension", "thyroid", "heart")
]
MEDS = [(feature, "|".join(dims.words(names))) for feature, names in dims.rows("MEDICATION_SETS", 2)]
relation(
    "or_history",
    "select u.id as user_id, "
    + ", ".join(f"coalesce({c}, 0) as {c}" for c in HISTORY + [m for m, _ in MEDS])
    + """ from fx_users u left join (select owner_id, count(*) as record_count,
        round(coalesce(max(record_date) - min(record_date), 0) / cast(365.25 as double), 2) as years_of_history
        from or_own group by 1) r on r.owner_id = u.id
      left join (select owner_id,
        count(distinct case when entity_type = 'disease' then entity_value end) as disease_count,
        count(distinct case when entity_type = 'medicine' then entity_value end) as unique_medicines_count, """
    + ", ".join(
        f"max(case when entity_type = 'disease' and {has('entity_value', CLASSES[c])} then 1 else 0 end) as has_{c}_history"
        for c in ("diabetes", "hypertension", "thyroid", "heart")
    )
    + ", "
    + ", ".join(
        f"count(*) filter (entity_type = 'medicine' and {has('entity_value', names)}) as {m}" for m, names in MEDS
    )
    + " from or_own o join fx_entities e on e.record_id = o.id group by 1) h on h.owner_id = u.id",
)
query(
    "history_features",
    "user_id bigint, " + ", ".join(f"{c} double" for c in HISTORY),
    "select * from or_history",
)(lambda t: S.history_features(t.users, t.own_records, t.entities))
query(
    "medication_features",
    "user_id bigint, " + ", ".join(f"{m} bigint" for m, _ in MEDS),
    "select * from or_history",
)(lambda t: S.medication_features(t.users, t.own_records, t.entities))

LABS = sorted({feature for _, feature in dims.rows("LAB_FEATURES", 2)})
FRAGMENTS = "(values " + ", ".join(f"('{a}', '{b}')" for a, b in dims.rows("LAB_FEATURES", 2)) + ") as lf(fragment, feature)"
relation(
    "or_labs",
    "select owner_id as user_id, "
    + ", ".join(f"max(case when feature = '{f}' then lab_numeric_value end) as {f}" for f in LABS)
    + f""" from (select owner_id, feature, lab_numeric_value, row_number() over (partition by owner_id, feature
        order by record_date desc nulls last, e.id desc) as rn from or_own o join fx_entities e on e.record_id = o.id
        join (select distinct l.entity_value, feature from (select distinct entity_value from fx_entities) l
          join {FRAGMENTS} on contains(lower(trim(l.entity_value)), fragment)) x on x.entity_value = e.entity_value
        where entity_type = 'lab_value' and lab_numeric_value is not null) where rn = 1 group by 1""",
)
query("latest_labs", "user_id bigint, " + ", ".join(f"{f} double" for f in LABS), "select * from or_labs")(
    lambda t: S.latest_labs(t.own_records, t.entities)
)

CLASS_SQL = "case " + " ".join(f"when {has('condition', w)} then '{c}'" for c, w in CLASSES.items()) + " end"
NEAR = {
    "parent": "relationship in ('father', 'mother', 'parent')",
    "grandparent": "contains(relationship, 'grand')",
    "sibling": "relationship in ('brother', 'sister', 'sibling')",
}
FAMILY = {
    "parent_diabetes": ("diabetes", "parent"),
    "grandparent_diabetes": ("diabetes", "grandparent"),
    "sibling_diabetes": ("diabetes", "sibling"),
    "family_diabetes_count": ("diabetes", None),
    "parent_hypertension": ("hypertension", "parent"),
    "grandparent_hypertension": ("hypertension", "grandparent"),
    "family_hypertension_count": ("hypertension", None),
    "parent_heart_disease": ("heart", "parent"),
    "grandparent_heart_disease": ("heart", "grandparent"),
    "family_heart_count": ("heart", None),
    "parent_thyroid": ("thyroid", "parent"),
    "family_thyroid_count": ("thyroid", None),
    "family_cancer_count": ("cancer", None),
}
relation(
    "or_family",
    "select u.id as user_id, "
    + ", ".join(f"coalesce({c}, 0) as {c}" for c in FAMILY)
    + " from fx_users u left join (select user_id, "
    + ", ".join(
        f"sum(case when cls = '{c}' then 1 else 0 end) as {name}"
        if who is None
        else f"max(case when cls = '{c}' and {NEAR[who]} then 1 else 0 end) as {name}"
        for name, (c, who) in FAMILY.items()
    )
    + f""" from (select m.user_id, relationship, {CLASS_SQL} as cls from (select family_member_id, entity_value as
        condition from fx_records r join fx_entities e on e.record_id = r.id where entity_type = 'disease')
        join fx_members m on m.id = family_member_id) group by 1) f on f.user_id = u.id""",
)


def raw_entries(t):
    return K.member_conditions(t.records, t.entities, distinct=False)


query("family_features", "user_id bigint, " + ", ".join(f"{c} bigint" for c in FAMILY), "select * from or_family")(
    lambda t: S.family_features(t.users, t.members, raw_entries(t))
)


def features_sql() -> str:
    source = {c: "h" for c in HISTORY + [m for m, _ in MEDS]} | {c: "l" for c in LABS} | {c: "f" for c in FAMILY}
    source |= {"age": "p", "gender_male": "p"}
    out = []
    for name, kind, median in dims.rows("FEATURES", 3):
        median = f"cast({median} as double)"
        if name == "bmi":
            expr = f"coalesce(l.latest_bmi, {median})"
        elif name in source:
            expr = f"coalesce(cast({source[name]}.{name} as double), {median})"
        else:
            expr = median
        out.append(f"{'cast(trunc(' + expr + ') as int)' if kind == 'int' else expr} as {name}")
    return (
        "select p.user_id, " + ", ".join(out) + " from or_personal p join or_history h on h.user_id = p.user_id "
        "left join or_labs l on l.user_id = p.user_id join or_family f on f.user_id = p.user_id"
    )


relation("or_features", features_sql())
FEATURES = "user_id bigint, " + ", ".join(f"{n} {k}" for n, k, _ in dims.rows("FEATURES", 3))


def features(t):
    return S.build_features(t.users, t.own_records, t.entities, t.members, raw_entries(t), AS_OF)


query("impute_and_cast", FEATURES, "select * from or_features")(features)

CLAMP = "greatest(cast(0.02 as double), least(cast(0.98 as double), {}))"


def d(text: str) -> str:
    """Make decimal literals double, so that both engines add the same numbers."""
    import re

    return re.sub(r"(?<![\w.])(-?\d+\.\d+)(?![\w.])", r"cast(\1 as double)", text)


RULES = {
    "diabetes": d(
        """0.10 + greatest(0.0, least(0.15, (age - 35) * 0.005))
  + case when latest_blood_sugar_fasting >= 126 then 0.35 when latest_blood_sugar_fasting >= 100 then 0.18 else 0.0 end
  + case when latest_hba1c >= 6.5 then 0.30 when latest_hba1c >= 5.7 then 0.15 else 0.0 end
  + case when bmi >= 30 then 0.10 when bmi >= 25 then 0.05 else 0.0 end
  + parent_diabetes * 0.18 + grandparent_diabetes * 0.08 + least(0.12, family_diabetes_count * 0.04)
  + case when has_diabetes_history <> 0 then 0.25 else 0.0 end - exercise_regularity * 0.05 - diet_quality_score * 0.04"""
    ),
    "hypertension": d(
        """0.08 + greatest(0.0, least(0.12, (age - 40) * 0.004))
  + case when latest_systolic_bp >= 140 then 0.30 when latest_systolic_bp >= 130 then 0.15
    when latest_systolic_bp >= 120 then 0.05 else 0.0 end
  + case when latest_diastolic_bp >= 90 then 0.15 else 0.0 end + case when bmi >= 30 then 0.08 else 0.0 end
  + parent_hypertension * 0.15 + grandparent_hypertension * 0.07
  + case when has_hypertension_history <> 0 then 0.25 else 0.0 end
  + case when has_diabetes_history <> 0 then 0.06 else 0.0 end - exercise_regularity * 0.06 - diet_quality_score * 0.05"""
    ),
    "thyroid": d(
        """0.06 + case when gender_male = 0 then 0.12 else 0.0 end
  + case when latest_tsh > 4 then 0.20 when latest_tsh < 0.4 then 0.15 when latest_tsh > 2.5 then 0.05 else 0.0 end
  + case when has_thyroid_history <> 0 then 0.28 else 0.0 end + parent_thyroid * 0.14
  + least(0.10, family_thyroid_count * 0.05) + case when has_diabetes_history <> 0 then 0.05 else 0.0 end"""
    ),
    "heart_disease": d(
        """0.05 + case when age >= 65 then 0.20 when age >= 55 then 0.12 when age >= 45 then 0.06 when age >= 35 then 0.02
    else 0.0 end + case when gender_male <> 0 then 0.04 else 0.0 end
  + case when latest_cholesterol >= 240 then 0.12 when latest_cholesterol >= 200 then 0.06 else 0.0 end
  + case when latest_ldl >= 160 then 0.10 when latest_ldl >= 130 then 0.05 else 0.0 end
  + case when latest_hdl < 40 then 0.08 when latest_hdl >= 60 then -0.04 else 0.0 end
  + case when latest_systolic_bp >= 140 then 0.10 when latest_systolic_bp >= 130 then 0.05 else 0.0 end
  + case when has_diabetes_history <> 0 then 0.12 else 0.0 end
  + case when has_hypertension_history <> 0 then 0.08 else 0.0 end
  + case when has_heart_history <> 0 then 0.25 else 0.0 end
  + parent_heart_disease * 0.15 + grandparent_heart_disease * 0.08 + least(0.10, family_heart_count * 0.04)
  - exercise_regularity * 0.08 - diet_quality_score * 0.05"""
    ),
}
for key, rule in RULES.items():
    name = {"heart_disease": "heart"}.get(key, key)
    query(
        f"{name}_score",
        "user_id bigint, probability double",
        f"select user_id, round({CLAMP.format(rule)}, 4) as probability from or_features",
    )(lambda t, key=key: features(t).select("user_id", S.SCORES[key]().alias("probability")))

relation(
    "or_scored",
    " union all ".join(
        f"""select user_id, '{key}' as model_key, '{m[1]}' as disease, '{m[2]}' as icd10, {m[3]} as weight,
            round({CLAMP.format(RULES[key])}, 4) as rule_p from or_features"""
        for key, m in S.MODELS.items()
    ),
)


def factor_sql() -> str:
    parts = []
    for i, (model, feature, weight, source, label) in enumerate(dims.rows("FACTORS", 5)):
        present = f"{feature} = 0" if feature == "gender_male" else f"{feature} <> 0"
        text = f"'{label}'"
        if "%" in label:
            value = f"cast(trunc({feature}) as int)" if "%d" in label else feature
            text = f"printf('{label}', {value})"
        parts.append(
            f"select user_id, '{model}' as model_key, {i} as i, {text} as factor, {weight} as weight, "
            f"'{source}' as source from or_features where {present}"
        )
    return (
        "select *, row_number() over (partition by user_id, model_key order by i) as rank from ("
        + " union all ".join(parts)
        + ")"
    )


relation("or_factors", factor_sql())
query(
    "contributing_factors",
    "user_id bigint, model_key string, rank int, factor string, weight double, source string",
    "select * from or_factors where rank <= 5",
)(
    lambda t: S.score_features(features(t))
    .select("user_id", "model_key", F.posexplode("contributing_factors").alias("rank", "f"))
    .select("user_id", "model_key", (F.col("rank") + 1).alias("rank"), "f.*")
)


def fitted(t):
    """Stand-in for the outputs of two trained models, with missing sides."""
    k = F.col("id")
    p = lambda e: e.cast("double") / 1000
    keys = F.array(*[F.lit(m) for m in S.MODELS])
    return t.users.select("id", F.posexplode(keys).alias("mi", "model_key")).select(
        F.col("id").alias("user_id"),
        "model_key",
        F.when((k + F.col("mi")) % 5 != 0, p((k * 31 + F.col("mi") * 7) % 1000)).alias("tree_p"),
        F.when((k + F.col("mi")) % 3 != 0, p((k * 17 + F.col("mi") * 11) % 1000)).alias("net_p"),
    )


relation(
    "or_fitted",
    """select id as user_id, model_key, case when (id + mi) % 5 <> 0 then cast((id * 31 + mi * 7) % 1000 as double) / 1000 end
       as tree_p, case when (id + mi) % 3 <> 0 then cast((id * 17 + mi * 11) % 1000 as double) / 1000 end as net_p
       from fx_users cross join (values """
    + ", ".join(f"({i}, '{m}')" for i, m in enumerate(S.MODELS))
    + ") as mk(mi, model_key)",
)
query(
    "ensemble",
    "user_id bigint, model_key string, probability double, model_confidence double, risk_level string",
    d(
        """select user_id, model_key, round(0.6 * a + 0.4 * b, 4) as probability,
           greatest(0.30, least(1.0, round(1 - abs(a - b) * 1.5, 3))) as model_confidence,
           case when round(0.6 * a + 0.4 * b, 4) >= 0.6 then 'high' when round(0.6 * a + 0.4 * b, 4) >= 0.3
             then 'moderate' else 'low' end as risk_level
           from (select s.user_id, s.model_key, coalesce(tree_p, net_p, rule_p) as a, coalesce(net_p, tree_p, rule_p) as b
             from or_scored s join or_fitted f on f.user_id = s.user_id and f.model_key = s.model_key)"""
    ),
)(lambda t: S.score_features(features(t), fitted(t)))
query(
    "risk_level",
    "id bigint, risk_level string",
    """select id, case when probability >= 0.6 then 'high' when probability >= 0.3 then 'moderate' else 'low' end
       as risk_level from fx_predictions""",
)(lambda t: t.predictions.select("id", C.risk_level("probability").alias("risk_level")))
relation(
    "or_boosted",
    d(
        """select s.*, case when boost > 0 then round(least(0.95, rule_p + cast(boost as double)), 4) else rule_p end
           as probability, case when boost > 0 then round(cast(boost as double), 4) end as boost_applied,
           case when boost > 0 then least(0.95, rule_p + cast(boost as double)) else rule_p end as unrounded
           from (select *, round(0.6 * raw + 0.4 * raw, 4) as rule_p from (select * rename (rule_p as raw) from or_scored)) s
           left join or_boost b on b.user_id = s.user_id and b.model_key = s.model_key"""
    ),
)


def boosted(t):
    return S.apply_boost(S.score_features(features(t)), K.pattern_boost(patterns(t)))


LEVEL = "case when unrounded >= 0.6 then 'high' when unrounded >= 0.3 then 'moderate' else 'low' end"
query(
    "apply_boost",
    "user_id bigint, model_key string, probability double, risk_level string, boost_applied double",
    f"select *, {LEVEL} as risk_level from or_boosted",
)(boosted)
relation(
    "or_graded",
    """select *, case when health_score >= 85 then 'A' when health_score >= 70 then 'B' when health_score >= 55 then 'C'
       when health_score >= 40 then 'D' else 'F' end as health_grade from (select user_id, cast(greatest(0, least(100,
       round_even(100 - sum(cast(probability as decimal(10,4)) * weight), 0))) as int) as health_score
       from or_boosted group by 1)""",
)
query(
    "weighted_health_score",
    "user_id bigint, health_score int, health_grade string",
    "select * from or_graded",
)(lambda t: S.weighted_health_score(boosted(t)))
query(
    "watchlist_flags",
    "user_id bigint, disease string, icd10 string, probability double, risk_level string, top_factor string",
    f"""select b.user_id, disease, icd10, probability, {LEVEL} as risk_level, coalesce(factor, '') as top_factor
        from or_boosted b left join or_factors f on f.user_id = b.user_id and f.model_key = b.model_key and rank = 1
        where probability >= 0.4""",
)(lambda t: S.watchlist_flags(boosted(t)))
PROFILE = (
    "user_id bigint, model_key string, disease string, icd10 string, probability double, risk_level string, "
    "boost_applied double, health_score int, health_grade string, on_watchlist boolean"
)
PROFILE_SQL = f"""select b.*, {LEVEL} as risk_level, health_score, health_grade, probability >= 0.4 as on_watchlist
                  from or_boosted b join or_graded g on g.user_id = b.user_id"""


def profile(t):
    shared = S.all_features(t.users, t.records, t.entities, t.members, AS_OF)
    return S.risk_profile_build(shared, K.pattern_boost(patterns(t)))


query("risk_profile_build", PROFILE, PROFILE_SQL)(profile)
query("daily_refresh", PROFILE, PROFILE_SQL)(profile)


def refreshed(t):
    """The risk job: all users scored, earlier predictions switched off, profiles replaced."""
    old = t.users.filter("id % 3 = 0").select(F.explode(F.array("id", -F.col("id") - 1)).alias("user_id")).select(
        "user_id", F.lit(1).alias("health_score"), F.lit("F").alias("health_grade"), F.lit(0).alias("watchlist"),
        F.to_date(F.lit("1999-01-01")).alias("updated_at"),
    )
    return J.refresh_profiles(profile(t), t.predictions.drop("id"), old, F.to_date(F.lit(AS_OF)))


query(
    "refresh_predictions",
    "user_id bigint, disease_name string, icd10_code string, probability double, risk_level string, is_active boolean",
    f"""with fresh as materialized ({PROFILE_SQL})
        select f.user_id, disease_name, icd10_code, f.probability, f.risk_level, is_active and g.user_id is null as is_active
        from fx_predictions f left join fresh g on g.user_id = f.user_id and g.disease = f.disease_name
        union all select user_id, disease, icd10, probability, risk_level, true from fresh""",
)(lambda t: refreshed(t)["predictions"])
query(
    "refresh_profiles",
    "user_id bigint, health_score int, health_grade string, watchlist int, updated_at date",
    f"""select user_id, health_score, health_grade, count(*) filter (on_watchlist) as watchlist, date '{AS_OF}' as updated_at
        from ({PROFILE_SQL}) group by 1, 2, 3
        union all select -id - 1, 1, 'F', 0, date '1999-01-01' from fx_users where id % 3 = 0""",
)(lambda t: refreshed(t)["profiles"])
query(
    "feature_summary",
    "user_id bigint, age double, bmi double, blood_sugar_fasting double, hba1c double, tsh double, "
    "systolic_bp double, cholesterol double",
    """select *, latest_blood_sugar_fasting as blood_sugar_fasting, latest_hba1c as hba1c, latest_tsh as tsh,
       latest_systolic_bp as systolic_bp, latest_cholesterol as cholesterol from or_features""",
)(lambda t: S.feature_summary(features(t)))
query(
    "stratified_split",
    "id bigint, risk_level string, part string",
    """select id, risk_level, case when (rn - 1) * 10 < n * 8 then 'train' when (rn - 1) * 10 < n * 9 then 'val'
       else 'test' end as part from (select *, row_number() over (partition by risk_level
       order by md5('42:' || cast(id as varchar)), id) as rn, count(*) over (partition by risk_level) as n
       from fx_predictions)""",
)(lambda t: S.stratified_split(t.predictions, "risk_level", "id"))
query(
    "platt_scale",
    "id bigint, p double, q double",
    d(
        """select id, round(1 / (1 + exp(probability)), 9) as p, round(1 / (1 + exp(-3.5 * probability + 0.25)), 9) as q
           from fx_predictions"""
    ),
)(
    lambda t: t.predictions.select(
        "id",
        F.round(C.platt_scale(F.col("probability")), 9).alias("p"),
        F.round(C.platt_scale(F.col("probability"), -3.5, 0.25), 9).alias("q"),
    )
)
query(
    "confidence_labels",
    "id bigint, quality string, label string",
    """select id, case when confidence >= 0.9 then 'excellent' when confidence >= 0.75 then 'good'
       when confidence >= 0.55 then 'fair' else 'poor' end as quality,
       case when confidence >= 0.9 then 'Very High' when confidence >= 0.75 then 'High' when confidence >= 0.55
       then 'Moderate' when confidence >= 0.35 then 'Low' else 'Very Low' end as label from fx_entities""",
)(
    lambda t: t.entities.select(
        "id", C.ocr_quality("confidence").alias("quality"), C.confidence_label("confidence").alias("label")
    )
)
query(
    "entity_confidence",
    "id bigint, confidence double",
    """select id, round(case when id % 2 = 0 then least(1.0, base + 0.05) else base end, 3) as confidence from (
       select id, case when rc is not null and mc is not null then 0.4 * rc + 0.6 * mc
         when mc is not null then mc * 0.95 when rc is not null then rc * 0.85 else 0.5 end as base from (
         select id, case when id % 3 <> 0 then cast(confidence as decimal(12,6)) end as rc,
           case when id % 5 <> 0 then cast(cast(id % 101 as double) / 100 as decimal(12,6)) end as mc from fx_entities))""",
)(
    lambda t: t.entities.select(
        "id",
        C.entity_confidence(
            F.when(F.col("id") % 3 != 0, F.col("confidence")),
            F.when(F.col("id") % 5 != 0, (F.col("id") % 101).cast("double") / 100),
            F.col("id") % 2 == 0,
        ).alias("confidence"),
    )
)

# --- model inputs, evaluation, catalog ----------------------------------------------------------------

VECTORS = " union all ".join(
    f"select user_id, '{m}' as model, unnest(range(0, {len(names)})) as place, "
    f"unnest([{', '.join(f'cast({n} as double)' for n in names)}]) as value from or_features"
    for m, names in L.INPUTS.items()
)


def vectors(t):
    """The input vectors of all models, one row per place."""
    parts = [
        L.feature_vector(features(t), m).select("user_id", F.lit(m).alias("model"), F.posexplode(vector_to_array("x")).alias("place", "value"))
        for m in L.INPUTS
    ]
    return reduce(DataFrame.union, parts)


query("feature_vector", "user_id bigint, model string, place int, value double", VECTORS)(vectors)
query(
    "evaluate_confusion",
    "y int, p int, n bigint",
    """select case when (user_id * 31 + id) % 100 < 100 * probability then 1 else 0 end as y,
       case when probability >= 0.5 then 1 else 0 end as p, count(*) as n from fx_predictions group by 1, 2""",
)(
    lambda t: L.confusion(
        t.predictions.withColumn("label", F.expr("case when (user_id * 31 + id) % 100 < 100 * probability then 1 else 0 end"))
    )
)
LABELLED = "case when (user_id * 31 + id) % 100 < 100 * probability then 1 else 0 end"


def judged(t):
    return t.predictions.withColumn("label", F.expr(LABELLED))


query(
    "evaluate_auc",
    "disease_name string, auc double",
    f"""select disease_name, sum(p * (2 * coalesce(below, 0) + n)) / (2 * cast(sum(p) as double) * sum(n)) as auc from (
          select *, sum(n) over (partition by disease_name order by probability rows between unbounded preceding and 1 preceding) as below
          from (select disease_name, probability, sum({LABELLED}) as p, sum(1 - {LABELLED}) as n from fx_predictions group by 1, 2))
        group by 1""",
)(lambda t: L.auc(judged(t), keys=("disease_name",)))
query(
    "evaluate_report",
    "disease_name string, precision double, recall double, f1 double, support bigint",
    f"""select *, 2 * precision * recall / (precision + recall) as f1 from (
          select disease_name, count(*) filter (y = 1 and p) / cast(count(*) filter (p) as double) as precision,
            count(*) filter (y = 1 and p) / cast(count(*) filter (y = 1) as double) as recall, count(*) filter (y = 1) as support
          from (select *, {LABELLED} as y, probability >= 0.5 as p from fx_predictions) group by 1)""",
)(lambda t: L.class_report(judged(t), keys=("disease_name",)))
MODEL_NAMES = list(L.INPUTS)
relation(
    "or_catalog",
    f"""select [{', '.join(f"'{m}'" for m in MODEL_NAMES)}][1 + user_id % {len(MODEL_NAMES)}] as name,
        case when id % 2 = 0 then 'trees' else 'net' end as type, concat('v', cast(id as varchar)) as path,
        timestamp '2024-01-01 00:00:00' + to_minutes(cast(id * 7 % 5003 as int)) as saved_at
        from fx_predictions where not (id % 2 = 1 and user_id % {len(MODEL_NAMES)} = 1)""",
)


def catalog(t):
    """Catalog entries made from the predictions; one model has no net."""
    names = F.array(*[F.lit(m) for m in MODEL_NAMES])
    return t.predictions.filter(f"not (id % 2 = 1 and user_id % {len(MODEL_NAMES)} = 1)").select(
        F.get(names, (F.col("user_id") % len(MODEL_NAMES)).cast("int")).alias("name"),
        F.when(F.col("id") % 2 == 0, "trees").otherwise("net").alias("type"),
        F.expr("concat('v', id)").alias("path"),
        F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id * 7 % 5003 as int))").alias("saved_at"),
    )


query(
    "model_catalog",
    "name string, type string, path string, saved_at timestamp",
    """select name, type, path, saved_at from (select *, row_number() over (partition by name, type
       order by saved_at desc, path desc) as rn from or_catalog) where rn = 1""",
)(lambda t: L.model_catalog(catalog(t)))
query(
    "model_readiness",
    "name string, trees_exist boolean, net_exists boolean, fully_trained boolean",
    f"""select n.name, coalesce(bool_or(type = 'trees'), false) as trees_exist, coalesce(bool_or(type = 'net'), false) as net_exists,
        coalesce(bool_or(type = 'trees') and bool_or(type = 'net'), false) as fully_trained
        from (values {', '.join(f"('{m}')" for m in MODEL_NAMES)}) as n(name) left join or_catalog c on c.name = n.name group by 1""",
)(lambda t: L.model_readiness(catalog(t)))
