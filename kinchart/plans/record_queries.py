"""Queries over records, entities and users."""

from pyspark.sql import functions as F

from kinchart.functions import columns as C
from kinchart.operators import records as R
from kinchart.streaming import jobs as J
from kinchart.plans.registry import query, relation
from kinchart.sources import dimensions as dims
from kinchart.sources.fixtures import AS_OF

EFF = "case when user_corrected then corrected_value else entity_value end"


def title_sql(expr: str) -> str:
    """Title case in the oracle: upper-case the first letter of every run of letters."""
    return (
        "array_to_string(list_transform(regexp_extract_all(lower(" + expr + r"), '[a-z]+|[^a-z]+'), "
        "lambda w: upper(w[1]) || w[2:]), '')"
    )


REC = "id bigint, owner_id bigint, family_member_id bigint, record_type string, record_date date"
ENT = "id bigint, record_id bigint, entity_type string, entity_value string, confidence double"

query("owner_scope", REC, "select * from fx_records where owner_id = 7")(
    lambda t: R.owner_scope(t.records, 7)
)
query("user_by_key", "id bigint, full_name string", "select id, full_name from fx_users where id = 42")(
    lambda t: R.user_by_key(t.users, user_id=42)
)
query("role_filter", "id bigint, role string", "select id, role from fx_users where role in ('patient', 'admin')")(
    lambda t: R.role_filter(t.users, ["patient", "admin"])
)
query(
    "list_records",
    REC,
    """select * from fx_records where record_type = 'lab_report' and family_member_id is null
       and record_date >= date '1996-01-01' and record_date <= date '1999-12-31'""",
)(lambda t: R.list_records(t.records, "lab_report", date_from="1996-01-01", date_to="1999-12-31"))
query(
    "list_records_member",
    REC,
    "select * from fx_records where family_member_id = 30 and record_type is not null",
)(lambda t: R.list_records(t.records, family_member_id=30, include_family=True))
query(
    "list_entities",
    "owner_id bigint, record_id bigint, entity_id bigint, entity_value string",
    """select owner_id, record_id, e.id as entity_id, entity_value from fx_entities e
       join fx_records r on r.id = e.record_id where entity_type = 'medicine'""",
)(lambda t: R.list_entities(t.records, t.entities, "medicine"))
query(
    "effective_value",
    "id bigint, effective_value string",
    f"select id, {EFF} as effective_value from fx_entities",
)(lambda t: R.with_effective_value(t.entities))
query(
    "record_derived",
    "id bigint, is_family_record boolean, confidence_pct double",
    """select id, family_member_id is not null as is_family_record,
       round(cast(confidence_score as decimal(12,6)) * 100, 1) as confidence_pct from fx_records""",
)(lambda t: R.record_derived(t.records))
query(
    "record_search",
    "id bigint, owner_id bigint, record_type string",
    f"""select id, owner_id, record_type from fx_records r where contains(lower(record_type), 'presc')
        or contains(coalesce(cast(record_date as varchar), ''), 'presc')
        or exists (select 1 from fx_entities e where e.record_id = r.id and contains(lower({EFF}), 'presc'))
        """.replace("'presc'", "'gout'"),
)(lambda t: R.record_search(t.records, t.entities, "Gout"))
query(
    "review_queue",
    ENT,
    """select * from fx_entities where coalesce(nullif(confidence, 0), 1.0) < 0.7 and not user_corrected""",
)(lambda t: R.review_queue(t.entities, F.col("user_corrected")))
query(
    "blocked_records",
    "record_id bigint, open_items bigint, blocked boolean",
    """select record_id, count(*) filter (where coalesce(nullif(confidence, 0), 1.0) < 0.7 and not user_corrected)
       as open_items, max(case when confidence < 0.7 and not user_corrected then 1 else 0 end) = 1 as blocked
       from fx_entities group by record_id""",
)(lambda t: R.blocked_records(t.entities, F.col("user_corrected")))
query("confidence_filter", ENT, "select * from fx_entities where coalesce(confidence, 0) >= 0.65")(
    lambda t: R.confidence_filter(t.entities, 0.65)
)
query(
    "canonical_entity_type",
    "id bigint, canonical_type string",
    """select id, case when lower(entity_type) in ('disease', 'medicine', 'dosage', 'doctor', 'hospital', 'date',
       'test_result', 'test_name', 'symptom', 'allergy', 'other') then lower(entity_type) else 'other' end
       as canonical_type from fx_entities""",
)(lambda t: R.with_canonical_type(t.entities))
query(
    "record_entities",
    "record_id bigint, owner_id bigint, entity_id bigint, entity_type string, entity_value string",
    """select record_id, owner_id, e.id as entity_id, entity_type, entity_value
       from fx_records r join fx_entities e on e.record_id = r.id""",
)(lambda t: R.record_entities(t.records, t.entities))
query(
    "records_with_member",
    "id bigint, owner_id bigint, family_member_name string",
    """select r.id, owner_id, m.name as family_member_name from fx_records r
       left join fx_members m on m.id = r.family_member_id""",
)(lambda t: R.records_with_member(t.records, t.members))
query(
    "records_nested",
    "record_id bigint, owner_id bigint, entity_id bigint, entity_type string, value string",
    f"""select r.id as record_id, owner_id, e.id as entity_id, entity_type, {EFF} as value
        from fx_records r left join fx_entities e on e.record_id = r.id""",
)(lambda t: R.records_with_entities(t.records, t.entities))
query(
    "unmatched",
    "id bigint, owner_id bigint",
    "select id, owner_id from fx_records r where not exists (select 1 from fx_entities e where e.record_id = r.id)",
)(lambda t: R.unmatched(t.records, t.entities.select(F.col("record_id").alias("id")), "id"))
relation(
    "or_corrections",
    """select id as entity_id, record_id + case when id % 14 = 0 then 1 else 0 end as record_id,
       concat('fixed ', entity_value) as corrected_value from fx_entities where id % 7 = 0""",
)


def corrections(t):
    """A table of corrections; half of them name the wrong record and must not apply."""
    shift = F.when(F.col("id") % 14 == 0, 1).otherwise(0)
    return t.entities.filter("id % 7 = 0").select(
        F.col("id").alias("entity_id"),
        (F.col("record_id") + shift).alias("record_id"),
        F.concat(F.lit("fixed "), "entity_value").alias("corrected_value"),
    )


query(
    "apply_corrections",
    "id bigint, record_id bigint, user_corrected boolean, corrected_value string",
    """select e.id, e.record_id, e.user_corrected or c.entity_id is not null as user_corrected,
       case when c.entity_id is not null then c.corrected_value else e.corrected_value end as corrected_value
       from fx_entities e left join or_corrections c on c.entity_id = e.id and c.record_id = e.record_id""",
)(lambda t: R.apply_corrections(t.entities, corrections(t)))

relation(
    "or_trends",
    f"""select owner_id, {title_sql("trim(entity_value)")} as disease, count(*) as mentions,
        array_to_string(list_sort(list_distinct(list(strftime(record_date, '%b %Y')))), ', ') as months
        from fx_entities e join fx_records r on r.id = e.record_id
        where entity_type = 'disease' and record_date >= date '{AS_OF}' - 360 group by 1, 2""",
)
query(
    "disease_trends",
    "owner_id bigint, disease string, mentions bigint, months string",
    "select * from or_trends",
)(lambda t: R.disease_trends(t.records, t.entities, AS_OF).withColumn("months", F.array_join("months", ", ")))
query(
    "activity_heatmap",
    "owner_id bigint, month string, records bigint",
    f"""select owner_id, strftime(created_at, '%Y-%m') as month, count(*) as records from fx_records
        where created_at >= date '{AS_OF}' - 360 group by 1, 2""",
)(lambda t: R.activity_heatmap(t.records, AS_OF))
query(
    "activity_heatmap_events",
    "owner_id bigint, month string, records bigint",
    """select user_id as owner_id, strftime(ts, '%Y-%m') as month, count(*) as records from events
       where ts >= date '2024-02-01' - 30 group by 1, 2""",
)(
    lambda t: R.activity_heatmap(
        t.events.select(F.col("user_id").alias("owner_id"), F.col("ts").alias("created_at")), "2024-02-01", 1
    )
)
query(
    "daily_calendar",
    "owner_id bigint, day date, records bigint, shade int",
    f"""select u.id as owner_id, d.day, coalesce(n, 0) as records, least(coalesce(n, 0), 4) as shade
        from fx_users u cross join (select cast(unnest(generate_series(date '{AS_OF}' - 363, date '{AS_OF}',
          interval 1 day)) as date) as day) d
        left join (select owner_id, cast(created_at as date) as day, count(*) as n from fx_records group by 1, 2) c
        on c.owner_id = u.id and c.day = d.day""",
)(lambda t: R.daily_calendar(t.users, t.records, AS_OF))
query(
    "page_meta",
    "owner_id bigint, total bigint, total_pages bigint, has_next boolean, has_prev boolean",
    """select owner_id, count(*) as total, greatest(1, ceil(count(*) / 5.0)) as total_pages,
       2 < greatest(1, ceil(count(*) / 5.0)) as has_next, true as has_prev from fx_records group by owner_id""",
)(lambda t: R.page_meta(t.records, 2, 5, ["owner_id"]))
query(
    "records_page",
    REC,
    "select * from fx_records order by created_at desc, id desc limit 20 offset 20",
)(lambda t: R.records_page(t.records, 2, 20))
query("users_page", "id bigint, full_name string", "select * from fx_users order by id limit 20 offset 40")(
    lambda t: R.users_page(t.users, 3, 20)
)
def relevant_sql(pool: str) -> str:
    return f"""with asked as (select id as owner_id, case id % 3 when 0 then 'Diabetes' when 1 then 'prescription for gout'
          else 'aspirin' end as complaint from fx_users),
        latest as (select * from (select *, row_number() over (partition by owner_id order by created_at desc, id desc)
          as rn from fx_records) {pool}),
        scored as (select r.owner_id, complaint, r.id as record_id, r.created_at,
          2.0 * (select count(*) from fx_entities e where e.record_id = r.id
                 and contains(lower({EFF}), lower(complaint)))
          + case when contains(lower(complaint), record_type) then 1.0 else 0.0 end
          + case when extraction_status = 'done' then 0.5 else 0.0 end
          + case when is_verified_by_user then 0.5 else 0.0 end as score
          from latest r join asked using (owner_id))
        select * from (select *, row_number() over (partition by owner_id, complaint
          order by score desc, created_at desc, record_id desc) as rank from scored) where rank <= 10"""


def complaints(t):
    third = F.col("id") % 3
    text = F.when(third == 0, "Diabetes").when(third == 1, "prescription for gout").otherwise("aspirin")
    return t.users.select(F.col("id").alias("owner_id"), text.alias("complaint"))


RELEVANT = "owner_id bigint, complaint string, rank int, record_id bigint, score double"
query("relevant_records", RELEVANT, relevant_sql(""))(lambda t: R.relevant_records(t.records, t.entities, complaints(t)))
query("relevant_records_latest", RELEVANT, relevant_sql("where rn <= 5"))(
    lambda t: R.relevant_records(t.records, t.entities, complaints(t), pool=5)
)
relation(
    "or_timeline",
    f"""select r.owner_id, r.id as record_id, r.record_type, r.record_date, r.created_at,
        {title_sql("replace(record_type, '_', ' ')")}
          || case when length(d.disease) > 0 then ' — ' || {title_sql("d.disease")} else '' end as title,
        r.family_member_id is not null as is_family_record, m.name as family_member_name, extraction_status
        from fx_records r left join fx_members m on m.id = r.family_member_id
        left join (select record_id, arg_min({EFF}, id) as disease from fx_entities
                   where entity_type = 'disease' group by record_id) d on d.record_id = r.id""",
)
query(
    "timeline",
    "owner_id bigint, record_id bigint, record_date date, title string, is_family_record boolean, "
    "family_member_name string, extraction_status string",
    "select * from or_timeline",
)(lambda t: R.timeline(t.records, t.entities, t.members))
query(
    "recent_events",
    "owner_id bigint, rank int, record_id bigint, title string",
    """select * from (select *, row_number() over (partition by owner_id order by record_date desc nulls first,
       created_at desc, record_id desc) as rank from or_timeline) where rank <= 3""",
)(lambda t: R.recent_events(R.timeline(t.records, t.entities, t.members)))
query(
    "entity_tags",
    "record_id bigint, rank int, id bigint, entity_value string",
    """select * from (select *, row_number() over (partition by record_id order by id) as rank from fx_entities)
       where rank <= 3""",
)(lambda t: R.entity_tags(t.entities))

LABEL_SQL = " ".join(f"when '{a}' then '{b}'" for a, b in dims.rows("ANNOTATION_LABELS", 2))
relation(
    "or_annotations",
    """select record_id as doc_id, case id % 5 when 0 then 'B-Drug' when 1 then 'B-DISEASE' when 2 then 'B-DNA'
       when 3 then 'O' else 'I-Dosage' end as label, entity_value as word, id % 100 as start,
       id % 100 + length(entity_value) as "end", confidence as score from fx_entities""",
)


def annotations(t):
    """Stand-in for the table an external tagger leaves behind."""
    m = F.col("id") % 5
    label = (
        F.when(m == 0, "B-Drug").when(m == 1, "B-DISEASE").when(m == 2, "B-DNA").when(m == 3, "O").otherwise("I-Dosage")
    )
    return t.entities.select(
        F.col("record_id").alias("doc_id"),
        label.alias("label"),
        F.col("entity_value").alias("word"),
        (F.col("id") % 100).alias("start"),
        (F.col("id") % 100 + F.length("entity_value")).alias("end"),
        F.col("confidence").alias("score"),
    )


query(
    "model_annotation_import",
    "doc_id bigint, type string, text string, start int, end int, normalized string, confidence double, source string",
    f"""select doc_id, case label {LABEL_SQL} end as type, trim(word) as text, start, "end",
        {title_sql("trim(word)")} as normalized, score as confidence, 'ml' as source from or_annotations
        where score >= 0.7 and length(trim(word)) >= 2 and label <> 'O'""",
)(lambda t: R.annotation_import(annotations(t), dims.annotation_labels(t.spark)))


def prescriptions(t):
    """Medicine arrays as the prescription table stores them: null, empty names and real ones."""
    name = F.when(F.col("id") % 4 == 1, F.lit("")).otherwise(F.concat(F.lit("drug "), F.col("id").cast("string")))
    entry = lambda n: F.struct(n.alias("name"), F.lit("A").alias("atc_code"))
    return t.records.select(
        "id",
        F.when(F.col("id") % 3 != 0, F.array(entry(name), entry(F.lit(None).cast("string")), entry(F.lit("base")))).alias(
            "medicines"
        ),
    )


query(
    "medicine_names",
    "id bigint, names string, n int",
    """select id, case when id % 3 = 0 then '' when id % 4 = 1 then 'base'
       else 'drug ' || cast(id as varchar) || '|base' end as names,
       case when id % 3 = 0 then 0 when id % 4 = 1 then 1 else 2 end as n from fx_records""",
)(
    lambda t: R.medicine_names(prescriptions(t)).select(
        "id", F.array_join("medicine_names", "|").alias("names"), F.size("medicine_names").alias("n")
    )
)

# --- what the streams' outputs are read as --------------------------------------------------------------

query(
    "heatmap_of_days",
    "owner_id bigint, month string, records bigint",
    "select user_id as owner_id, strftime(ts, '%Y-%m') as month, count(*) as records from events group by 1, 2",
)(
    lambda t: J.heatmap_of(
        t.events.groupBy(F.col("user_id").alias("owner_id"), F.to_date("ts").alias("day"))
        .agg(F.count("*").alias("records"))
        .withColumn("month", F.date_format("day", "yyyy-MM"))
    )
)


def extractions(t):
    """Every entity as written by up to three runs of two streams; the status rows tell when."""
    runs = F.explode(F.sequence(F.lit(0), (F.col("record_id") % 3).cast("int")))
    entities = t.entities.select("id", "record_id", runs.alias("batch")).withColumn(
        "origin", F.when((F.col("record_id") + F.col("batch")) % 2 == 0, "a").otherwise("b")
    )
    status = entities.select("record_id", "batch", "origin", ((F.col("batch") * 7 + F.col("record_id")) % 5).alias("written")).distinct()
    return J.current_entities(entities.filter((F.col("id") + F.col("batch")) % 3 != 0), status)


query(
    "current_entities",
    "id bigint, record_id bigint, batch int, origin string",
    """with runs as (select id, record_id, cast(b as int) as batch, case when (record_id + b) % 2 = 0 then 'a' else 'b' end as origin,
         (b * 7 + record_id) % 5 as written from (select id, record_id, unnest(range(record_id % 3 + 1)) as b from fx_entities)),
       latest as (select record_id, max(row(written, origin, batch)) as l from runs group by 1)
       select id, runs.record_id, batch, origin from runs join latest on latest.record_id = runs.record_id
       and l = row(written, origin, batch) where (id + batch) % 3 <> 0""",
)(extractions)
