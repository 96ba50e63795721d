"""Record, family, score and maintenance operators on tiny literal tables."""

import datetime as dt

from pyspark.sql import functions as F

from kinchart.operators import family as K
from kinchart.operators import insights as I
from kinchart.operators import maintain as M
from kinchart.operators import records as R
from kinchart.operators import risk as S
from kinchart.sources import schemas

AS_OF = "2024-06-15"
T0 = dt.datetime(2024, 1, 1)


def family(spark):
    """The demo family: father, mother and a late paternal grandfather of user 1."""
    members = spark.createDataFrame(
        [
            (10, 1, "Ravi", "father", None, T0),
            (11, 1, "Meena", "mother", None, T0 + dt.timedelta(days=1)),
            (12, 1, "Om", "paternal_grandfather", 2, T0 + dt.timedelta(days=2)),
        ],
        "id long, user_id long, name string, relationship string, related_user_id long, created_at timestamp",
    )
    records = spark.createDataFrame(
        [(100 + m, 1, m, "diagnosis", dt.date(2024, 5, 1), "done", 0.9, True, T0) for m in (10, 11, 12)],
        "id long, owner_id long, family_member_id long, record_type string, record_date date, "
        "extraction_status string, confidence_score double, is_verified_by_user boolean, created_at timestamp",
    )
    values = [(110, "type 2 diabetes"), (110, "hypertension"), (111, "hypothyroidism"), (112, "type 2 diabetes"), (112, "heart disease")]
    entities = spark.createDataFrame(
        [(i, r, "disease", v, 0.9, False, None) for i, (r, v) in enumerate(values)],
        "id long, record_id long, entity_type string, entity_value string, confidence double, user_corrected boolean, "
        "corrected_value string",
    )
    return members, records, entities


def test_demo_family_patterns(spark):
    members, records, entities = family(spark)
    rows = K.hereditary_patterns(members, K.member_conditions(records, entities)).collect()
    got = {r["disease"]: (float(r["risk_to_user"]), r["risk_level"], r["generation_count"]) for r in rows}
    assert got == {
        "type 2 diabetes": (0.55, "high", 2),
        "hypertension": (0.35, "moderate", 1),
        "hypothyroidism": (0.35, "moderate", 1),
        "heart disease": (0.20, "low", 1),
    }


def test_spellings_count_twice_after_distinct(spark):
    members, records, entities = family(spark)
    extra = [(50, 110, "disease", v, 0.9, False, None) for v in ("Gout", "gout", "Gout")]
    entities = entities.unionByName(spark.createDataFrame(extra, entities.schema))
    rows = K.hereditary_patterns(members, K.member_conditions(records, entities)).filter("disease = 'gout'").collect()
    assert [(r["affected_members"], float(r["risk_to_user"])) for r in rows] == [(2, 0.70)]


def test_weighted_patterns_and_boosts(spark):
    members, records, entities = family(spark)
    patterns = K.weighted_patterns(members, K.member_conditions(records, entities, use_corrections=True))
    row = patterns.filter("disease_key = 'type_2_diabetes'").first()
    assert float(row["raw_score"]) == 3.0 and float(row["weighted_score"]) == 2.16
    assert (row["risk_flag"], row["affected_count"], row["top_relative"], row["generation_span"]) == ("high", 2, "Father", 2)
    boost = {r["model_key"]: round(float(r["boost"]), 6) for r in K.pattern_boost(patterns).collect()}
    assert boost["diabetes"] == round(0.72 * 2.16 * 0.08, 6)
    scorer = {r["model_key"]: float(r["boost"]) for r in K.heritability_boost(patterns).collect()}
    assert scorer["diabetes"] == round(2.16 * 0.08, 4)


def test_generations_and_weights(spark):
    rels = ["father", "granddaughter", "nephew", "great_grandfather", "other", "grandfather", "aunt", "stranger"]
    df = spark.createDataFrame([(r,) for r in rels], "r string")
    c = F.col("r")
    got = [
        tuple(x)
        for x in df.select(
            K.generation_stored(c), K.generation_signed(c), K.generation_signed(c, True), K.generation_graph(c)
        ).collect()
    ]
    assert got[0] == (1, -1, -1, -1) and got[1] == (0, 2, 1, 2) and got[2] == (-1, 0, 0, 0) and got[3] == (0, -2, -2, -3)
    weights = [
        [float(v) for v in x]
        for x in df.select(K.closeness_weight(c), K.closeness_weight(c, "inside"), K.closeness_weight(c, "either")).collect()
    ]
    assert weights[4] == [0.25, 0.25, 2.0] and weights[5] == [0.25, 2.0, 2.0] and weights[7] == [0.25, 0.25, 0.25]


def test_linked_accounts_extend_the_walk(spark):
    members, _, _ = family(spark)
    more = spark.createDataFrame([(20, 2, "Dada", "father", 1, T0), (21, 2, "Beta", "son", None, T0)], members.schema)
    both = members.unionByName(more)
    assert K.ancestors(both).filter("user_id = 1").count() == 3
    reached = {r["member_id"]: r["depth"] for r in K.ancestors(both, link_accounts=True).filter("user_id = 1").collect()}
    assert reached == {10: 1, 11: 1, 12: 1}  # 20 is user 1 itself
    assert {r["member_id"] for r in K.descendants(both).filter("user_id = 2").collect()} == {21}


def test_age_counts_birthdays(spark):
    users = spark.createDataFrame(
        [(1, dt.date(1984, 6, 15), "M"), (2, dt.date(1984, 6, 16), "female"), (3, None, None), (4, dt.date(2030, 1, 1), "male")],
        "id long, date_of_birth date, gender string",
    )
    got = [(r["age"], r["gender_male"]) for r in S.personal_features(users, AS_OF).orderBy("user_id").collect()]
    assert got == [(40.0, 1), (39.0, 0), (40.0, 0), (0.0, 1)]


def test_impute_casts_and_survives_bad_text(spark):
    raw = spark.createDataFrame([(1, "7.9", "oops", 31.5)], "user_id long, disease_count string, latest_tsh string, latest_bmi double")
    row = S.impute_and_cast(raw).first()
    assert (row["disease_count"], row["latest_tsh"], row["bmi"], row["latest_hba1c"]) == (7, 0.0, 31.5, 5.4)


def test_scores_stay_in_bounds(spark):
    base = S.impute_and_cast(spark.createDataFrame([(1, 95.0, 400.0, 300.0)], "user_id long, age double, latest_blood_sugar_fasting double, latest_systolic_bp double"))
    extreme = base.withColumns({n: F.lit(1) for n, k, _ in S.FEATURES if n.startswith(("has_", "parent_", "grandparent_"))})
    scored = S.risk_profile_build(extreme)
    rows = scored.collect()
    assert all(0.02 <= r["probability"] <= 0.98 for r in rows) and len(rows) == 4
    assert all(0 <= r["health_score"] <= 100 and len(r["contributing_factors"]) <= 5 for r in rows)
    assert {r["health_grade"] for r in rows} == {"F"}


def test_zero_probability_is_not_missing(spark):
    base = S.impute_and_cast(spark.createDataFrame([(1,)], "user_id long"))
    fitted = spark.createDataFrame([(1, "thyroid", 0.0, 0.5)], "user_id long, model_key string, tree_p double, net_p double")
    row = S.score_features(base, fitted).filter("model_key = 'thyroid'").first()
    assert row["probability"] == 0.2 and row["model_confidence"] == 0.3


def test_member_filter_needs_family(spark):
    _, records, _ = family(spark)
    assert R.list_records(records, family_member_id=10).count() == 0
    assert R.list_records(records, family_member_id=10, include_family=True).count() == 1
    assert R.owner_scope(records, 2).count() == 0


def test_zero_confidence_needs_no_review(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (2, 1, None), (3, 1, 0.69), (4, 2, 0.7)], "id long, record_id long, confidence double")
    assert [r["id"] for r in R.review_queue(df).collect()] == [3]
    blocked = {r["record_id"]: r["blocked"] for r in R.blocked_records(df).collect()}
    assert blocked == {1: True, 2: False}


def test_undated_records_come_first(spark):
    members, records, entities = family(spark)
    undated = spark.createDataFrame([(999, 1, None, "lab_report", None, "done", 0.9, False, T0)], records.schema)
    events = R.timeline(records.unionByName(undated), entities, members)
    first = events.orderBy(*R.timeline_order()).first()
    assert (first["record_id"], first["title"]) == (999, "Lab Report")
    titles = {r["record_id"]: r["title"] for r in events.collect()}
    assert titles[111] == "Diagnosis — Hypothyroidism"


def test_score_without_rows_is_100(spark):
    users = spark.createDataFrame([(1,), (2,)], "id long")
    predictions = spark.createDataFrame([(1, "high", True), (1, "low", False)], "user_id long, risk_level string, is_active boolean")
    records = spark.createDataFrame([(1, True)] * 4, "owner_id long, is_verified_by_user boolean")
    got = {r["user_id"]: (r["score"], r["label"]) for r in I.health_score(users, predictions, records).collect()}
    assert got == {1: (85, "good"), 2: (100, "good")}


def test_replace_and_upsert_are_idempotent(spark):
    _, _, entities = family(spark)
    new = spark.createDataFrame([(900, 110, "disease", "gout", 0.9, False, None)], entities.schema)
    once = M.replace_entities(entities, new)
    assert sorted(r["id"] for r in once.collect()) == [2, 3, 4, 900]
    assert sorted(M.replace_entities(once, new).collect()) == sorted(once.collect())
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k long, v string, updated_at int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 1)], old.schema)
    once = M.upsert_profile(old, new, "k")
    assert sorted(tuple(r) for r in once.collect()) == [(1, "c", 1), (2, "b", 5), (3, "e", 1)]
    assert sorted(M.upsert_profile(once, new, "k").collect()) == sorted(once.collect())


def test_patch_sets_null_only_when_named(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, gender string")
    patches = spark.createDataFrame([(1, {"gender": None})], "id long, changes map<string,string>")
    assert sorted(tuple(r) for r in M.apply_patches(df, patches).collect()) == [(1, "a", None), (2, "b", "y")]


def test_verification_merges_data_and_ignores_custom_ids(spark):
    _, records, entities = family(spark)
    records = records.withColumn("structured_data", F.expr("map('a', '1', 'b', '2')"))
    verified = spark.createDataFrame([(110, {"b": "9", "c": "3"})], "record_id long, structured_data map<string,string>")
    none = spark.createDataFrame([], "entity_id long, record_id long, corrected_value string")
    adds = spark.createDataFrame([(110, "Medicine", "Glycomet"), (110, "odd", "x"), (110, "disease", "  ")], "record_id long, entity_type string, entity_value string")
    dels = spark.createDataFrame([("custom_1", 110), ("1", 110), ("2", 110)], "entity_id string, record_id long")
    out = M.verify_records(records, entities, verified, none, adds, dels)
    row = out["records"].filter("id = 110").first()
    assert row["structured_data"] == {"a": "1", "b": "9", "c": "3"} and row["is_verified_by_user"]
    assert sorted((r["entity_type"], r["atc_code"]) for r in out["added"].collect()) == [("medicine", "A10BA02"), ("other", None)]
    assert 1 not in [r["id"] for r in out["entities"].collect()] and out["entities"].filter("id = 2").count() == 1


def test_cascade_leaves_no_dangling_keys(spark):
    members, records, entities = family(spark)
    users = spark.createDataFrame([(1, "a"), (2, "b")], "id long, full_name string")
    tables = {"users": users, "members": members, "records": records, "entities": entities}
    out = M.cascade_delete(tables, users=users.filter("id = 2"))
    assert out["members"].filter("related_user_id is not null").count() == 0 and out["members"].count() == 3
    out = M.cascade_delete(tables, members=members.filter("id = 10"))
    assert (out["records"].count(), out["entities"].count(), out["purge"].first()[0]) == (2, 3, 110)


def test_validation_splits_rows(spark):
    df = spark.createDataFrame([(1, "ok", "male", 50.0), (2, "", "robot", 101.0), (3, None, None, None)], "id long, name string, gender string, x double")
    rules = {"name": M.required("name"), "length": M.length_between("name", 1, 5), "gender": M.one_of("gender", ["male", "female", "other"]), "x": M.between("x", 0, 100)}
    good, bad = M.split_valid(df, rules)
    assert [r["id"] for r in good.collect()] == [1]
    assert {r["id"]: r["reasons"] for r in bad.collect()} == {2: ["length", "gender", "x"], 3: ["name"]}


def test_diagnosis_keeps_all_of_many(spark):
    records = spark.createDataFrame([(1, 7, "prescription")], "id long, owner_id long, record_type string")
    rows = [(i, 1, "disease", "a" if i % 2 else "", False, None) for i in range(600)]
    entities = spark.createDataFrame(rows, "id long, record_id long, entity_type string, entity_value string, user_corrected boolean, corrected_value string")
    text = M.sync_prescription(records, entities)["prescriptions"].first()["diagnosis"]
    assert text == ", ".join(r[3] for r in rows)
    assert M.sync_prescription(records, entities, length=500)["prescriptions"].first()["diagnosis"] == text[:500]


def test_sixty_matching_records_are_all_scored(spark):
    _, records, entities = family(spark)
    made = spark.range(60).select(
        (F.col("id") + 500).alias("id"), F.lit(77).cast("long").alias("owner_id"), F.lit(None).cast("long").alias("family_member_id"),
        F.lit("other").alias("record_type"), F.lit("done").alias("extraction_status"), F.lit(False).alias("is_verified_by_user"),
        (F.lit(T0).cast("timestamp") + F.make_interval(days=F.col("id").cast("int"))).alias("created_at"),
    )
    hits = made.select(F.col("id").alias("record_id"), F.lit("gout").alias("entity_value"), F.lit(False).alias("user_corrected"), F.lit(None).cast("string").alias("corrected_value"))
    asked = spark.createDataFrame([(77, "Gout")], "owner_id long, complaint string")
    rows = R.relevant_records(made, hits.filter("record_id = 500"), asked, top=1).collect()
    assert [r["record_id"] for r in rows] == [500]
    assert R.relevant_records(made, hits, asked, top=100).count() == 60
    assert R.relevant_records(made, hits, asked, pool=50, top=100).count() == 50


def test_repeated_keys_do_not_double_rows(spark):
    _, records, entities = family(spark)
    twice = spark.createDataFrame([(110,), (110,)], "record_id long")
    none = spark.createDataFrame([], "record_id long, entity_type string, entity_value string")
    gone = spark.createDataFrame([], "entity_id string, record_id long")
    fixes = spark.createDataFrame([(2, 110, "a"), (2, 110, "b")], "entity_id long, record_id long, corrected_value string")
    out = M.verify_records(records, entities, twice, fixes, none, gone)
    assert out["records"].count() == records.count() and out["entities"].count() == entities.count()
    assert R.apply_corrections(entities, fixes).count() == entities.count()
    patches = spark.createDataFrame([(1, {"v": "x"}), (1, {"v": "y"})], "id long, changes map<string,string>")
    assert M.apply_patches(spark.createDataFrame([(1, "a")], "id long, v string"), patches).collect() == [(1, "y")]


def test_declared_tables_take_patches_and_new_rows(spark):
    for name in schemas.SCHEMAS:
        empty = spark.createDataFrame([], schemas.schema(name))
        patches = spark.createDataFrame([], "id string, changes map<string,string>")
        assert M.apply_patches(empty, patches).count() == 0
        assert M.append_rows(empty, empty, "id")["rows"].count() == 0


def test_invites_expire_and_are_accepted_once(spark):
    rows = [("t1", 1, 10, "pending", T0), ("t2", 1, 11, "pending", T0 + dt.timedelta(days=3)), ("t3", 1, 12, "declined", T0 + dt.timedelta(days=9))]
    invites = spark.createDataFrame(rows, "token string, inviter_id long, family_member_id long, status string, expires_at timestamp")
    members, _, _ = family(spark)
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    asked = spark.createDataFrame([("t1", 5), ("t2", 6), ("t3", 7)], "token string, new_user_id long")
    out = I.accept_invites(invites, members, asked, now)
    assert {r["token"]: r["status"] for r in out["invites"].collect()} == {"t1": "expired", "t2": "accepted", "t3": "declined"}
    assert {r["id"]: r["related_user_id"] for r in out["members"].collect()} == {10: None, 11: 6, 12: 2}


def test_split_shares_are_exact(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    parts = S.stratified_split(df, "label", "id").groupBy("label", "part").count().collect()
    got = {(r["label"], r["part"]): r["count"] for r in parts}
    assert got[(1, "train")] == 534 and got[(0, "train")] == 1067 and sum(got.values()) == 2000
    assert abs(got[(0, "val")] - 133) <= 1 and abs(got[(0, "test")] - 133) <= 1


def test_load_tables_reads_declared_schemas(spark, tmp_path):
    for name in schemas.SCHEMAS:
        spark.createDataFrame([], schemas.schema(name)).write.parquet(str(tmp_path / name))
    tables = schemas.load_tables(spark, str(tmp_path))
    assert set(tables) == set(schemas.SCHEMAS)
    assert all(t.columns == schemas.schema(n).names and t.count() == 0 for n, t in tables.items())


def test_listed_files_become_pending_records(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(b"x" * 10)
    (tmp_path / "b.gif").write_bytes(b"x")
    files = schemas.list_files(spark, str(tmp_path)).withColumns(
        {"owner_id": F.lit("u"), "record_type": F.lit("other"), "family_member_id": F.lit(None).cast("string")}
    )
    got = {r["source_file_type"]: r["reject_reason"] for r in M.document_intake(files, max_bytes=5).collect()}
    assert got == {"png": "FILE_TOO_LARGE", "gif": "UNSUPPORTED_FILE_TYPE"}


def test_partition_overwrite_touches_only_given_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    M.write_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, "p")
    M.write_partitions(spark.createDataFrame([(9, "b")], "v int, p string"), path, "p")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (9, "b")]


def test_hot_key_stays_exact(spark):
    """A third of all rows on one member, record and value: counts are whole."""
    members, records, entities = family(spark)
    many = spark.range(30_000).select(
        (F.col("id") + 1000).alias("id"), F.lit(110).cast("long").alias("record_id"), F.lit("disease").alias("entity_type"),
        F.lit("gout").alias("entity_value"), F.lit(0.9).alias("confidence"), F.lit(False).alias("user_corrected"),
        F.lit(None).cast("string").alias("corrected_value"),
    )
    everything = entities.unionByName(many)
    entries = K.member_conditions(records, everything, distinct=False).filter("condition = 'gout'").first()
    assert entries["entries"] == 30_000
    trend = R.disease_trends(records, everything, AS_OF).filter("disease = 'Gout'").first()
    assert (trend["mentions"], trend["months"]) == (30_000, ["May 2024"])
