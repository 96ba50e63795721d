"""Queries over predictions, scores, recommendations, consent and invitations."""

from pyspark.sql import functions as F

from kinchart.operators import insights as I
from kinchart.plans.registry import query, relation
from kinchart.sources import dimensions as dims
from kinchart.sources.fixtures import AS_OF

PRED = "id bigint, user_id bigint, disease_name string, probability double, risk_level string, is_active boolean"
NOW = "timestamp '2001-06-01 00:00:00'"


def now():
    return F.lit("2001-06-01 00:00:00").cast("timestamp")



query("active_predictions", PRED, "select * from fx_predictions where is_active")(
    lambda t: I.active_predictions(t.predictions)
)
query(
    "predictions_like",
    PRED,
    "select * from fx_predictions where is_active and disease_name ilike '%diab%'",
)(lambda t: I.predictions_like(t.predictions, "Diab"))


def with_factors(t):
    """Predictions with three factors each; two of the weights may tie."""
    factor = lambda name, w, source: F.struct(
        F.lit(name).alias("factor"), (w / 10.0).alias("weight"), F.lit(source).alias("source")
    )
    i = F.col("id")
    return t.predictions.withColumn(
        "contributing_factors",
        F.array(
            factor("age", i % 3, "demographic"),
            factor("father", i % 5, "family"),
            factor("mother", i % 7, "family"),
        ),
    ).withColumn("generated_at", F.timestamp_seconds(F.lit(946684800) + (i % 400) * 86400))


relation(
    "or_predictions",
    """select *, timestamp '2000-01-01' + interval 1 day * (id % 400) as generated_at,
       [{'factor': 'age', 'w': id % 3, 'i': 0, 'source': 'demographic'},
        {'factor': 'father', 'w': id % 5, 'i': 1, 'source': 'family'},
        {'factor': 'mother', 'w': id % 7, 'i': 2, 'source': 'family'}] as factors from fx_predictions""",
)
query(
    "prediction_derived",
    "id bigint, probability_pct double, risk_level string, top_factors string",
    """select p.id, round(cast(probability as decimal(12,6)) * 100, 1) as probability_pct,
       case when probability >= 0.6 then 'high' when probability >= 0.3 then 'moderate' else 'low' end as risk_level,
       top_factors from or_predictions p join (
         select id, string_agg(f.factor, '|' order by f.w desc, f.i) as top_factors
         from (select id, unnest(factors) as f from or_predictions) group by id) x on x.id = p.id""",
)(
    lambda t: I.prediction_derived(with_factors(t)).withColumn(
        "top_factors", F.array_join(F.transform("top_factors", lambda f: f["factor"]), "|")
    )
)
relation(
    "or_top",
    """select *, row_number() over (partition by user_id order by probability desc, id) as rank
       from or_predictions where is_active""",
)
query(
    "top_predictions",
    "user_id bigint, rank int, disease_name string, probability double",
    "select * from or_top where rank <= 3",
)(lambda t: I.top_predictions(t.predictions, 3))
query(
    "risk_profile_predictions",
    "user_id bigint, rank int, id bigint, disease_name string, probability double",
    """select user_id, row_number() over (partition by user_id order by probability desc, id) as rank, id, disease_name,
       probability from fx_predictions where is_active""",
)(lambda t: I.ranked_predictions(t.predictions))
query(
    "risk_profile",
    "user_id bigint, overall_risk_level string, total_predictions bigint, high_risk_count bigint, "
    "moderate_risk_count bigint, low_risk_count bigint, last_updated timestamp",
    """select u.id as user_id, case when h > 0 then 'high' when m > 0 then 'moderate' else 'low' end as overall_risk_level,
       coalesce(n, 0) as total_predictions, coalesce(h, 0) as high_risk_count, coalesce(m, 0) as moderate_risk_count,
       coalesce(l, 0) as low_risk_count, last_updated from fx_users u left join (select user_id, count(*) as n,
       count(*) filter (risk_level = 'high') as h, count(*) filter (risk_level = 'moderate') as m,
       count(*) filter (risk_level = 'low') as l, max(generated_at) as last_updated
       from or_predictions where is_active group by 1) p on p.user_id = u.id""",
)(lambda t: I.risk_profile(t.users, with_factors(t)))
relation(
    "or_health",
    """select u.id as user_id, greatest(0, least(100, 100 - coalesce(pen, 0) + least(2 * coalesce(ver, 0), 5))) as score
       from fx_users u left join (select user_id, sum(case risk_level when 'high' then 20 when 'moderate' then 10
         else 3 end) as pen from fx_predictions where is_active group by 1) p on p.user_id = u.id
       left join (select owner_id, count(*) as ver from fx_records where is_verified_by_user group by 1) v
       on v.owner_id = u.id""",
)
query(
    "health_score",
    "user_id bigint, score int, label string",
    """select *, case when score >= 80 then 'good' when score >= 60 then 'moderate' else 'needs_attention' end as label
       from or_health""",
)(lambda t: I.health_score(t.users, t.predictions, t.records))
query(
    "top_trend_disease",
    "user_id bigint, disease_name string, mean_probability double, month string, value double",
    """with m as (select user_id, disease_name, strftime(generated_at, '%Y-%m') as month, sum(probability) as s,
         count(*) as n from or_predictions group by 1, 2, 3),
       d as (select user_id, disease_name, round(sum(s) / sum(n), 6) as mean_probability from m group by 1, 2),
       b as (select * from (select *, row_number() over (partition by user_id order by mean_probability desc,
         disease_name) as rn from d) where rn = 1)
       select m.user_id, m.disease_name, mean_probability, month, round(s / n, 6) as value
       from m join b on b.user_id = m.user_id and b.disease_name = m.disease_name""",
)(lambda t: I.top_trend_disease(with_factors(t)))
ADVICE_SQL = "case risk_level " + " ".join(
    f"when '{k}' then '{v}'" for k, v in dims.rows("WATCHLIST_ACTIONS", 2)
) + " end"
query(
    "watchlist",
    "user_id bigint, rank int, disease_name string, icd10_code string, probability_pct double, risk_level string, "
    "recommended_action string, family string",
    f"""select *, round(cast(probability as decimal(12,6)) * 100, 1) as probability_pct,
        {ADVICE_SQL} as recommended_action, 'father|mother' as family from or_top where rank <= 2""",
)(
    lambda t: I.watchlist(with_factors(t), 2).withColumn(
        "family", F.array_join("family_members_affected", "|")
    )
)


def template_sql() -> str:
    order = {"urgent": 0, "recommended": 1, "optional": 2}
    values = []
    for i, (category, priority, levels, words, title, _, _) in enumerate(dims.rows("RECOMMENDATIONS", 7)):
        for level in dims.words(levels):
            for word in dims.words(words) or [""]:
                values.append(
                    f"({order[priority] * 100 + i}, '{category}', '{priority}', '{title}', '{level}', '{word}')"
                )
    return "(values " + ", ".join(values) + ") as tp(display_order, category, priority, title, level, word)"


relation(
    "or_recommendations",
    f"""select distinct u.id as user_id, display_order, category, priority, title from fx_users u cross join
        {template_sql()} where word = '' or exists (select 1 from fx_predictions p where p.user_id = u.id
        and is_active and risk_level = level and contains(lower(disease_name), word))""",
)
REC = "user_id bigint, display_order int, category string, priority string, title string"
query("recommendations", REC, "select * from or_recommendations")(lambda t: I.recommendations(t.users, t.predictions))
query(
    "recommendation_filter",
    REC + ", category_label string",
    "select *, '🩺 Checkup' as category_label from or_recommendations where category = 'checkup' and priority = 'urgent'",
)(lambda t: I.recommendation_filter(I.recommendations(t.users, t.predictions), "checkup", "urgent"))
query(
    "health_summary",
    "user_id bigint, health_score int, top_risks string, recent_conditions string, summary string",
    f"""with risks as (select user_id, list(disease_name order by rank) as r from or_top where rank <= 3 group by 1),
        tr as (select owner_id, entity_value as disease, count(*) as mentions from fx_entities e
          join fx_records r on r.id = e.record_id where entity_type = 'disease'
          and record_date >= date '{AS_OF}' - 180 group by 1, 2),
        conds as (select owner_id, list(disease order by rn) as c from (select *, row_number() over (
          partition by owner_id order by mentions desc, disease) as rn from tr) where rn <= 3 group by 1)
        select u.id as user_id, score as health_score, array_to_string(coalesce(r, []), '|') as top_risks,
          lower(array_to_string(coalesce(c, []), '|')) as recent_conditions,
          'Hello ' || string_split(full_name, ' ')[1] || '! Your current health score is ' || cast(score as varchar)
          || '/100. Your primary areas to monitor are ' || case when len(r) > 1
            then array_to_string(r[1:len(r) - 1], ', ') || ' and ' || r[len(r)] when len(r) = 1 then r[1]
            else 'no significant conditions' end
          || '. Stay on top of your annual checkups and follow your personalised plan.' as summary
        from fx_users u join or_health h on h.user_id = u.id left join risks on risks.user_id = u.id
        left join conds on conds.owner_id = u.id""",
)(
    lambda t: I.health_summary(t.users, t.predictions, t.records, t.entities, AS_OF).select(
        "user_id",
        "health_score",
        F.array_join("top_risks", "|").alias("top_risks"),
        F.lower(F.array_join("recent_conditions", "|")).alias("recent_conditions"),
        "summary",
    )
)


def scores(t):
    return I.health_score(t.users, t.predictions, t.records)


query(
    "doctor_patients",
    "doctor_id bigint, patient_id bigint, full_name string, access_level string, expires_at date, health_score int",
    """select doctor_id, patient_id, full_name, access_level, expires_at, score as health_score from fx_access a
       join fx_users u on u.id = patient_id join or_health h on h.user_id = patient_id where is_active""",
)(lambda t: I.doctor_patients(t.access, t.users, scores(t)))
query(
    "consented_rows",
    "id bigint, owner_id bigint",
    """select id, owner_id from fx_records where owner_id in (select patient_id from fx_access
       where doctor_id = 3 and is_active)""",
)(lambda t: I.consented_rows(t.records, t.access, 3))
query(
    "consented_rows_unexpired",
    "id bigint, owner_id bigint",
    f"""select id, owner_id from fx_records where owner_id in (select patient_id from fx_access
        where doctor_id = 3 and is_active and (expires_at is null or expires_at >= date '{AS_OF}'))""",
)(lambda t: I.consented_rows(t.records, t.access, 3, as_of=AS_OF, enforce_expiry=True))
query(
    "patient_summary",
    "patient_id bigint, full_name string, health_score int, disease_name string, probability double, risk_level string",
    """select u.id as patient_id, full_name, score as health_score, disease_name, probability, risk_level
       from fx_users u join or_health h on h.user_id = u.id
       left join fx_predictions p on p.user_id = u.id and p.is_active""",
)(lambda t: I.patient_summary(t.users, scores(t), t.predictions))
query(
    "grant_extension",
    "id bigint, new_expires_at date",
    f"select id, coalesce(expires_at, date '{AS_OF}') + 30 as new_expires_at from fx_access where is_active",
)(lambda t: I.grant_extension(t.access, AS_OF, 30))
relation(
    "or_invites",
    f"""select id, inviter_id, family_member_id, relationship, token, created_at, expires_at,
        case when status = 'pending' and expires_at < {NOW} then 'expired' else status end as status,
        status = 'pending' and expires_at >= {NOW} as is_valid from fx_invites""",
)
query(
    "invite_status",
    "id bigint, status string, is_valid boolean",
    "select * from or_invites",
)(lambda t: I.invite_status(t.invites, now()))
def invited(t):
    """Every third member was invited before; every fifth is asked now, some of them twice."""
    before = F.col("id") % 3 == 0
    members = t.members.withColumns(
        {
            "invite_status": F.when(before, "accepted"),
            "invite_token": F.when(before, F.expr("concat('old', id)")),
            "invite_sent_at": F.when(before, F.col("created_at")),
        }
    )
    asked = t.members.filter("id % 5 = 0").select(
        F.col("id").alias("family_member_id"), F.expr("concat('new', id)").alias("token"), "created_at"
    )
    earlier = asked.filter("family_member_id % 10 = 0").select(
        "family_member_id", F.lit("earlier").alias("token"), (F.col("created_at") - F.expr("interval 1 hour")).alias("created_at")
    )
    return I.new_invites(members, asked.union(earlier))


query(
    "new_invites",
    "inviter_id bigint, family_member_id bigint, token string, status string, expires_at timestamp",
    """select user_id as inviter_id, id as family_member_id, concat('new', cast(id as varchar)) as token,
       'pending' as status, created_at + interval 72 hour as expires_at from fx_members where id % 5 = 0""",
)(
    lambda t: invited(t)["invites"]
)
query(
    "new_invites_members",
    "id bigint, invite_status string, invite_token string, invite_sent_at timestamp",
    """select id, case when id % 5 = 0 then 'pending' when id % 3 = 0 then 'accepted' else 'not_invited' end as invite_status,
       case when id % 5 = 0 then concat('new', cast(id as varchar)) when id % 3 = 0 then concat('old', cast(id as varchar)) end
       as invite_token, case when id % 5 = 0 or id % 3 = 0 then created_at end as invite_sent_at from fx_members""",
)(lambda t: invited(t)["members"])
query(
    "invite_details",
    "token string, inviter_name string, relationship string, expires_at timestamp, family_member_id bigint",
    """select token, full_name as inviter_name, relationship, expires_at, family_member_id from or_invites i
       join fx_users u on u.id = inviter_id where is_valid""",
)(lambda t: I.invite_details(t.invites, t.users, now()))


def acceptances(t):
    """Some tokens are accepted by two users."""
    users = F.explode(F.array(F.col("id") + 2000000, F.col("id") + 1000000))
    return t.invites.filter("id % 6 = 0").select("token", users.alias("new_user_id"))


def answered(t):
    """Invites that were declined carry the time of that answer."""
    return t.invites.withColumn("responded_at", F.when(F.col("status") == "declined", F.col("created_at")))


query(
    "accept_invites_invites",
    "id bigint, status string, responded_at timestamp",
    f"""select id, case when is_valid and id % 6 = 0 then 'accepted' else status end as status,
        case when is_valid and id % 6 = 0 then {NOW} when status = 'declined' then created_at end as responded_at from or_invites""",
)(lambda t: I.accept_invites(answered(t), t.members, acceptances(t), now())["invites"])
query(
    "accept_invites_members",
    "id bigint, related_user_id bigint, invite_status string",
    """select m.id, case when i.id is not null then m.id + 1000000 else related_user_id end as related_user_id,
       case when i.id is not null then 'accepted' else 'not_invited' end as invite_status
       from fx_members m left join or_invites i on i.family_member_id = m.id and i.is_valid and i.id % 6 = 0""",
)(lambda t: I.accept_invites(t.invites, t.members, acceptances(t), now())["members"])


def invite_changes(t):
    """Every invite as sent, its answer some hours later, and for some tokens a second invite after that."""
    at = lambda h: F.col("created_at") + F.make_interval(hours=h)
    event = lambda status, when: F.struct(F.lit(status).alias("status"), when.alias("at"))
    answer = F.when(F.col("status") != "pending", F.struct(F.col("status").alias("status"), at((F.col("id") % 100).cast("int")).alias("at")))
    again = F.when(F.col("id") % 5 == 0, event("pending", at(F.lit(50))))
    events = F.array_compact(F.array(event("pending", F.col("created_at")), answer, again))
    return t.invites.select("token", F.inline(events))


query(
    "expired_invites",
    "token string, expired_at timestamp",
    f"""select token, sent + interval 72 hour as expired_at from (
          select token, greatest(created_at, case when id % 5 = 0 then created_at + interval 50 hour end) as sent,
            case when status <> 'pending' then created_at + to_hours(cast(id % 100 as bigint)) end as answered from fx_invites)
        where (answered is null or sent > answered) and sent + interval 72 hour <= {NOW}""",
)(lambda t: I.expired_invites(invite_changes(t), now()))
