"""Queries over table maintenance, set operations and request limits."""

from pyspark.sql import functions as F

from kinchart.operators import limits as L
from kinchart.operators import maintain as M
from kinchart.plans.record_queries import EFF, corrections
from kinchart.plans.registry import query, relation
from kinchart.plans.text_queries import COND_SQL, BRAND_SQL, DRUG_SQL
from kinchart.sources import dimensions as dims

relation(
    "or_new_entities",
    """select 90000000 + id as id, record_id, 'disease' as entity_type, 'new ' || entity_value as entity_value, 0.9 as confidence
       from fx_entities where record_id % 10 = 3 and entity_type = 'disease'""",
)


def new_entities(t):
    return t.entities.filter("record_id % 10 = 3 and entity_type = 'disease'").select(
        (F.col("id") + 90000000).alias("id"),
        "record_id",
        F.lit("disease").alias("entity_type"),
        F.concat(F.lit("new "), "entity_value").alias("entity_value"),
        F.lit(0.9).alias("confidence"),
    )


ENT = "id bigint, record_id bigint, entity_type string, entity_value string, confidence double"
query(
    "replace_entities",
    ENT,
    """select id, record_id, entity_type, entity_value, confidence from fx_entities where record_id not in
       (select record_id from or_new_entities) union all select * from or_new_entities""",
)(lambda t: M.replace_entities(t.entities, new_entities(t)))
query(
    "version_predictions",
    "id bigint, user_id bigint, disease_name string, probability double, is_active boolean",
    """select id, user_id, disease_name, probability, is_active and not (user_id % 2 = 0 and disease_name ilike '%diab%')
       as is_active from fx_predictions union all select id + 500000000, user_id, disease_name, 0.5, true
       from fx_predictions where user_id % 2 = 0 and disease_name ilike '%diab%'""",
)(
    lambda t: M.version_predictions(
        t.predictions,
        t.predictions.filter("user_id % 2 = 0 and disease_name ilike '%diab%'").select(
            (F.col("id") + 500000000).alias("id"), "user_id", "disease_name", F.lit(0.5).alias("probability")
        ),
    )
)


def profiles(t, shift):
    return t.records.select(
        F.col("owner_id").alias("user_id"),
        (F.col("confidence_score") + shift).alias("score"),
        F.struct("created_at", "id").alias("updated_at"),
    )


query(
    "upsert_profile",
    "user_id bigint, score double",
    """select user_id, arg_max(s, v) as score from (
         select owner_id as user_id, confidence_score as s, row(created_at, id, 0) as v from fx_records
         union all select owner_id, confidence_score + 1, row(created_at, id, 1) from fx_records where id % 2 = 0) group by 1""",
)(lambda t: M.upsert_profile(profiles(t, 0), profiles(t, 1).filter("updated_at.id % 2 = 0"), "user_id"))


def cascaded(t):
    tables = {
        "users": t.users,
        "members": t.members,
        "records": t.records,
        "entities": t.entities,
        "predictions": t.predictions,
        "invites": t.invites,
        "access": t.access,
        "prescriptions": t.records.filter("record_type = 'prescription'").select(F.col("id").alias("record_id"), "owner_id"),
    }
    return M.cascade_delete(tables, users=t.users.filter("id % 10 = 4"), members=t.members.filter("id % 7 = 2"))


relation("or_gone_members", "select id from fx_members where user_id % 10 = 4 or id % 7 = 2")
relation(
    "or_gone_records",
    """select id from fx_records where owner_id % 10 = 4 or family_member_id in (select id from or_gone_members)""",
)
GONE = {
    "members": (
        "id bigint, user_id bigint, related_user_id bigint",
        """select id, user_id, case when related_user_id not in (select id from fx_users where id % 10 = 4)
           then related_user_id end as related_user_id
           from fx_members where id not in (select id from or_gone_members)""",
    ),
    "records": ("id bigint, owner_id bigint", "select id, owner_id from fx_records where id not in (select id from or_gone_records)"),
    "entities": (
        "id bigint, record_id bigint",
        "select id, record_id from fx_entities where record_id not in (select id from or_gone_records)",
    ),
    "invites": (
        "id bigint, inviter_id bigint",
        """select id, inviter_id from fx_invites where inviter_id % 10 <> 4 and family_member_id not in
           (select id from or_gone_members)""",
    ),
    "access": (
        "id bigint, patient_id bigint, doctor_id bigint",
        "select id, patient_id, doctor_id from fx_access where patient_id % 10 <> 4 and not (doctor_id % 10 = 4 and doctor_id in (select id from fx_users))",
    ),
    "users": ("id bigint", "select id from fx_users where id % 10 <> 4"),
    "predictions": ("id bigint, user_id bigint", "select id, user_id from fx_predictions where user_id % 10 <> 4"),
    "prescriptions": (
        "record_id bigint, owner_id bigint",
        """select id as record_id, owner_id from fx_records where record_type = 'prescription'
           and id not in (select id from or_gone_records)""",
    ),
    "purge": ("record_id bigint", "select id as record_id from or_gone_records"),
}
for table, (schema, sql) in GONE.items():
    query(f"cascade_delete_{table}", schema, sql)(lambda t, table=table: cascaded(t)[table])


def rules():
    return {
        "name_length": M.length_between("name", 1, 9),
        "relationship_known": M.one_of("relationship", [r for r, _ in dims.rows("GENERATIONS", 2) if r != "other"]),
        "link_required": M.required("related_user_id"),
        "id_range": M.between("id", 0, 12000),
    }


query(
    "validate_rows",
    "id bigint, reasons string",
    """select id, concat_ws(',', case when length(name) > 9 then 'name_length' end,
       case when relationship = 'other' then 'relationship_known' end, case when related_user_id is null then 'link_required' end,
       case when id > 12000 then 'id_range' end) as reasons from fx_members""",
)(lambda t: M.validate_rows(t.members, rules()).select("id", F.array_join("reasons", ",").alias("reasons")))
def appended(t):
    token = F.when(F.col("id") % 4 == 2, F.expr("concat('fresh', id)")).otherwise(F.col("token"))
    new = t.invites.filter("id % 2 = 0").select(token.alias("token"), "relationship")
    return M.append_rows(t.invites, new, "token", {"status": F.lit("pending")})


query(
    "append_rows",
    "token string, status string, relationship string",
    """select token, status, relationship from fx_invites union all select concat('fresh', cast(id as varchar)), 'pending',
       relationship from fx_invites where id % 4 = 2""",
)(
    lambda t: appended(t)["rows"]
)
query(
    "append_rows_rejected",
    "token string, reason string, refused bigint",
    "select token, 'exists' as reason, 1 as refused from fx_invites where id % 2 = 0 and id % 4 <> 2",
)(lambda t: appended(t)["rejected"])
query(
    "append_rows_records",
    "id bigint, note string, n bigint",
    """select id, map_extract_value(d, 'note') as note, cardinality(d) as n from (
         select id, map(['note'], ['old']) as d from fx_records
         union all select id + 100000000, case when id % 2 = 0 then map(['kind', 'note'], ['new', 'fresh']) else map(['kind'], ['new']) end
         from fx_records where id % 4 <> 1) q""",
)(
    lambda t: M.append_rows(
        t.records.select("id", F.expr("map('note', 'old')").alias("structured_data")),
        t.records.filter("id % 4 <> 1").select(
            (F.col("id") + 100000000).alias("id"),
            F.expr("if(id % 2 = 0, map('kind', 'new', 'note', 'fresh'), map('kind', 'new'))").alias("structured_data"),
        ),
        "id",
    )["rows"].select("id", F.try_element_at("structured_data", F.lit("note")).alias("note"), F.size("structured_data").alias("n"))
)
query(
    "apply_patches",
    "id bigint, name string, relationship string, related_user_id bigint",
    """select id, case when id % 5 = 0 then 'renamed' else name end as name, relationship,
       case when id % 5 = 0 then null else related_user_id end as related_user_id from fx_members""",
)(
    lambda t: M.apply_patches(
        t.members,
        t.members.filter("id % 5 = 0").select(
            "id", F.expr("map('name', 'renamed', 'related_user_id', cast(null as string))").alias("changes")
        ),
    )
)
query(
    "apply_patches_records",
    "id bigint, note string, n int, record_type string",
    """select id, case when id % 5 = 0 then 'second' else 'old' end as note, case when id % 5 = 0 then 2 else 1 end as n,
       case when id % 5 = 0 then 'patched' else record_type end as record_type from fx_records""",
)(
    lambda t: M.apply_patches(
        t.records.select("id", "record_type", F.expr("map('note', 'old')").alias("structured_data")),
        t.records.filter("id % 5 = 0").select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("v")).select(
            "id",
            "v",
            F.expr(
                "map('record_type', 'patched', 'structured_data', if(v = 1, '{\"note\": \"first\"}', '{\"note\": \"second\", \"more\": \"x\"}'))"
            ).alias("changes"),
        ),
        version="v",
    ).select("id", "record_type", F.try_element_at("structured_data", F.lit("note")).alias("note"), F.size("structured_data").alias("n"))
)
query(
    "apply_patches_prescriptions",
    "record_id bigint, first_name string, n int",
    """select id as record_id, case when id % 3 = 0 then 'aspirin' else 'none' end as first_name,
       case when id % 3 = 0 then 2 else 1 end as n from fx_records where record_type = 'prescription'""",
)(
    lambda t: M.apply_patches(
        t.records.filter("record_type = 'prescription'").select(
            F.col("id").alias("record_id"), F.expr("array(named_struct('name', 'none', 'atc_code', cast(null as string)))").alias("medicines")
        ),
        t.records.filter("record_type = 'prescription' and id % 3 = 0").select(
            F.col("id").alias("record_id"),
            F.expr("map('medicines', '[{\"name\": \"aspirin\", \"atc_code\": \"B01AC06\"}, {\"name\": \"x\"}]')").alias("changes"),
        ),
        "record_id",
    ).select("record_id", F.col("medicines")[0]["name"].alias("first_name"), F.size("medicines").alias("n"))
)
query(
    "document_intake",
    "path_key string, source_file_type string, extraction_status string, reject_reason string",
    """select path as path_key, ext as source_file_type, 'pending' as extraction_status,
       case when ext not in ('jpg', 'jpeg', 'png', 'pdf', 'heic') then 'UNSUPPORTED_FILE_TYPE' when length > 20971520
       then 'FILE_TOO_LARGE' when doc_id % 5 = 4 then 'INVALID_UUID' end as reject_reason from (select doc_id,
       case doc_id % 4 when 0 then 'in/scan.PDF' when 1 then 'in/a.b/x.txt' when 2 then 'in/noext' else 'in/p.1.jpeg' end as path,
       case doc_id % 4 when 0 then 'pdf' when 1 then 'txt' when 2 then '' else 'jpeg' end as ext, n_chars * 10000 as length
       from documents)""",
)(
    lambda t: M.document_intake(
        t.documents.select(
            F.when(F.col("doc_id") % 4 == 0, "in/scan.PDF")
            .when(F.col("doc_id") % 4 == 1, "in/a.b/x.txt")
            .when(F.col("doc_id") % 4 == 2, "in/noext")
            .otherwise("in/p.1.jpeg")
            .alias("path"),
            (F.col("n_chars") * 10000).alias("length"),
            F.lit("u1").alias("owner_id"),
            F.lit("other").alias("record_type"),
            F.when(F.col("doc_id") % 5 == 4, "not-a-uuid")
            .when(F.col("doc_id") % 5 == 3, "550e8400-e29b-41d4-a716-446655440000")
            .alias("family_member_id"),
        )
    ).withColumnRenamed("source_file_key", "path_key")
)


# --- verification -----------------------------------------------------------------------------------


def edited(t):
    """Entity sets after a user's edit: every 9th dropped, every 4th changed, additions per record."""
    value = F.when(F.col("id") % 4 == 0, F.concat(F.lit("edited "), "entity_value")).otherwise(F.col("entity_value"))
    kept = t.entities.filter("id % 9 <> 0").select(
        "id", "record_id", "entity_type", value.alias("value"), F.lit(False).alias("is_new")
    )
    fresh = t.records.filter("id % 6 = 0").select(
        F.lit(None).cast("bigint").alias("id"),
        F.col("id").alias("record_id"),
        F.lit("Disease").alias("entity_type"),
        F.lit("Gout").alias("value"),
        F.lit(True).alias("is_new"),
    )
    return kept.unionByName(fresh)


def diff(t, part):
    return M.review_diff(t.entities, edited(t))[part]


query(
    "review_diff_deletions",
    "entity_id string, record_id bigint",
    "select id as entity_id, record_id from fx_entities where id % 9 = 0",
)(lambda t: diff(t, "deletions"))
query(
    "review_diff_corrections",
    "entity_id bigint, record_id bigint, corrected_value string",
    """select id as entity_id, record_id, 'edited ' || entity_value as corrected_value from fx_entities
       where id % 9 <> 0 and id % 4 = 0""",
)(lambda t: diff(t, "corrections"))
query(
    "review_diff_additions",
    "record_id bigint, entity_type string, entity_value string",
    "select id as record_id, 'disease' as entity_type, 'Gout' as entity_value from fx_records where id % 6 = 0",
)(lambda t: diff(t, "additions"))


def additions(t):
    m = F.col("id") % 5
    return t.records.select(
        F.col("id").alias("record_id"),
        F.when(m == 0, "disease").when(m == 1, "MEDICINE").when(m == 2, "lab_value").otherwise("symptom").alias("entity_type"),
        F.when(m == 0, " Gout ").when(m == 1, "Glycomet").when(m == 2, "TSH 4").when(m == 3, "  ").otherwise("cough").alias(
            "entity_value"
        ),
    )


def verified(t):
    return M.verify_records(
        t.records,
        t.entities,
        t.records.filter("id % 3 = 1").select(F.col("id").alias("record_id")),
        corrections(t),
        additions(t),
        t.entities.filter("id % 9 = 0").select(
            F.when(F.col("id") % 2 == 0, F.expr("concat('custom_', id)")).otherwise(F.col("id").cast("string")).alias("entity_id"),
            "record_id",
        ),
    )


query(
    "verify_records",
    "id bigint, is_verified_by_user boolean",
    "select id, is_verified_by_user or id % 3 = 1 as is_verified_by_user from fx_records",
)(lambda t: verified(t)["records"])
relation(
    "or_added",
    f"""select record_id, entity_type, entity_value, icd10_code, atc_code from (select id as record_id, case id % 5 when 0
        then 'disease' when 1 then 'medicine' when 2 then 'other' else 'symptom' end as entity_type, case id % 5 when 0 then 'Gout'
        when 1 then 'Glycomet' when 2 then 'TSH 4' else 'cough' end as entity_value from fx_records where id % 3 = 1 and id % 5 <> 3)
        left join (select name as cname, icd10_code from {COND_SQL}) on entity_type = 'disease' and cname = lower(entity_value)
        left join (select brand, atc_code from {BRAND_SQL} join {DRUG_SQL} on name = generic) on entity_type = 'medicine'
        and brand = lower(entity_value)""",
)
relation(
    "or_verified",
    """select e.id, e.record_id, e.entity_type, e.entity_value, e.user_corrected or c.entity_id is not null as user_corrected,
       case when c.entity_id is not null then c.corrected_value else e.corrected_value end as corrected_value,
       cast(null as varchar) as icd10_code, cast(null as varchar) as atc_code
       from fx_entities e left join or_corrections c on c.entity_id = e.id and c.record_id = e.record_id and e.record_id % 3 = 1
       where not (e.id % 9 = 0 and e.id % 2 = 1 and e.record_id % 3 = 1)
       union all select null, record_id, entity_type, entity_value, true, entity_value, icd10_code, atc_code from or_added""",
)
query(
    "verify_entities",
    "id bigint, record_id bigint, entity_type string, entity_value string, user_corrected boolean, corrected_value string, "
    "icd10_code string, atc_code string",
    "select * from or_verified",
)(lambda t: verified(t)["entities"])
query(
    "sync_prescription",
    "record_id bigint, owner_id bigint, diagnosis string",
    f"""select r.id as record_id, owner_id, d as diagnosis from fx_records r left join (select record_id,
        string_agg(coalesce({EFF}, ''), ', ' order by id) as d from fx_entities where entity_type = 'disease' group by 1) x
        on x.record_id = r.id where record_type = 'prescription'""",
)(lambda t: M.sync_prescription(t.records, t.entities)["prescriptions"])
query(
    "sync_prescription_medicines",
    "record_id bigint, entity_id bigint, name string",
    f"""select record_id, e.id as entity_id, {EFF} as name from fx_entities e join fx_records r on r.id = record_id
        where record_type = 'prescription' and entity_type = 'medicine'""",
)(lambda t: M.sync_prescription(t.records, t.entities)["medicines"])

# --- set operations -----------------------------------------------------------------------------------

query(
    "concat_rows",
    "record_id bigint, entity_type string, atc_code string",
    """select record_id, entity_type, null as atc_code from fx_entities where entity_type = 'disease'
       union all select record_id, entity_type, 'x' from fx_entities where entity_type = 'medicine'""",
)(
    lambda t: t.entities.filter("entity_type = 'disease'")
    .select("record_id", "entity_type")
    .unionByName(
        t.entities.filter("entity_type = 'medicine'").select("record_id", "entity_type", F.lit("x").alias("atc_code")),
        allowMissingColumns=True,
    )
)
query(
    "vocabulary_union",
    "name string, used bigint",
    f"""select name, count(e.id) as used from (select name from {DRUG_SQL} union select brand from {BRAND_SQL}) v
        left join fx_entities e on lower(e.entity_value) = name group by 1""",
)(
    lambda t: dims.drugs(t.spark)
    .select("name")
    .union(dims.brands(t.spark).select("brand"))
    .distinct()
    .join(t.entities.groupBy(F.lower("entity_value").alias("name")).agg(F.count("*").alias("_n")), "name", "left")
    .select("name", F.coalesce("_n", F.lit(0)).alias("used"))
)
query(
    "id_difference",
    "id bigint",
    "select id from fx_records except select record_id from fx_entities where entity_type = 'medicine'",
)(
    lambda t: t.records.select("id").join(
        t.entities.filter("entity_type = 'medicine'").select(F.col("record_id").alias("id")), "id", "left_anti"
    )
)
query(
    "latest_per_key",
    "owner_id bigint, id bigint, record_type string",
    """select owner_id, id, record_type from (select *, row_number() over (partition by owner_id, record_type
       order by created_at desc, id desc) as rn from fx_records) where rn = 1""",
)(lambda t: M.latest_per_key(t.records, ["owner_id", "record_type"], [F.desc("created_at"), F.desc("id")]))

# --- request limits -------------------------------------------------------------------------------------


def requests(t):
    return t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts")


query(
    "rate_violations_tumbling",
    "key bigint, window_start timestamp, requests bigint, excess bigint",
    """select user_id as key, time_bucket(interval 6 hour, ts) as window_start, count(*) as requests, count(*) - 2 as excess
       from events group by 1, 2 having count(*) > 2""",
)(lambda t: L.tumbling_violations(requests(t), limit=2, seconds=21600))
query(
    "rate_violations",
    "key bigint, id bigint, window_start timestamp, position bigint, remaining bigint, retry_after bigint",
    """with recursive ev as materialized (select user_id as key, event_id as id, ts, row_number() over (partition by user_id
         order by ts, event_id) as n from events),
       walk as (select key, id, ts, n, ts as window_start, 1 as position from ev where n = 1
         union all select e.key, e.id, e.ts, e.n,
           case when e.ts >= w.window_start + interval 6 hour then e.ts else w.window_start end,
           case when e.ts >= w.window_start + interval 6 hour then 1 else w.position + 1 end
         from walk w join ev e on e.key = w.key and e.n = w.n + 1)
       select key, id, window_start, position, 0 as remaining,
         cast(ceil(epoch(window_start + interval 6 hour) - epoch(ts)) as bigint) as retry_after from walk where position > 2""",
)(lambda t: L.violations(requests(t), limit=2, seconds=21600))
