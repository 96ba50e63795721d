"""Streaming jobs, each driven to completion over small files."""

import datetime as dt
import json
import time

from pyspark.sql import functions as F

from kinchart.operators import records as R
from kinchart.sources.fixtures import AS_OF, Tables
from kinchart.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)


def write_lines(folder, name, rows):
    folder.mkdir(exist_ok=True)
    time.sleep(0.05)  # a stream takes files in the order of their times
    (folder / name).write_text("\n".join(json.dumps(r, default=str) for r in rows))


def drain(stream, tmp_path):
    """Run the stream over the files there are; everything it has written so far."""
    out = str(tmp_path / "sink")
    q = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def test_stream_extract_replaces_earlier_entities(spark, tmp_path):
    out, checkpoint, source = str(tmp_path / "out"), str(tmp_path / "cp"), tmp_path / "in"
    write_lines(source, "1.json", [{"record_id": "a", "text": "Tab Metformin 500mg BD"}, {"record_id": "b", "text": None}])
    J.stream_extract(J.read_files(spark, str(source)), out, checkpoint).awaitTermination(120)
    write_lines(source, "2.json", [{"record_id": "a", "text": "gout"}])
    J.stream_extract(J.read_files(spark, str(source)), out, checkpoint).awaitTermination(120)
    read = lambda p: spark.read.option("basePath", f"{out}/{p}").parquet(f"{out}/{p}/stream=*/run=*")
    entities, status = read("entities"), read("status")
    assert entities.filter("batch = 0").count() == 3
    current = J.current_entities(entities, status)
    assert [(r["record_id"], r["type"], r["normalized"]) for r in current.collect()] == [("a", "DISEASE", "Gout")]
    assert {(r["record_id"], r["extraction_status"]) for r in status.collect()} == {("a", "done"), ("b", "failed")}


def test_risk_refresh_equals_the_full_run_for_touched_users(spark, tmp_path):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    t = Tables(spark, folder)
    tables = {"users": t.users, "members": t.members, "records": t.records, "entities": t.entities}
    source = tmp_path / "in"
    write_lines(source, "1.json", [{"user_id": 3}, {"user_id": 5}, {"user_id": 3}])
    changes = J.read_files(spark, str(source), "user_id bigint")
    J.stream_risk_refresh(changes, tables, str(tmp_path / "out"), str(tmp_path / "cp"), AS_OF).awaitTermination(120)
    columns = ["user_id", "model_key", "probability", "risk_level", "health_score"]
    written = lambda: spark.read.parquet(str(tmp_path / "out"))
    got = written().select(columns)
    want = entry.queries()["risk_profile_build"](spark, folder).filter("user_id in (3, 5)").select(columns)
    assert got.count() == 8
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # a stream with a new checkpoint starts at batch 0 again and replaces nothing; older scores turn inactive
    write_lines(tmp_path / "more", "1.json", [{"user_id": 5}])
    again = J.read_files(spark, str(tmp_path / "more"), "user_id bigint")
    J.stream_risk_refresh(again, tables, str(tmp_path / "out"), str(tmp_path / "cp2"), AS_OF).awaitTermination(120)
    versions = J.versioned_predictions(written())
    assert versions.count() == 12 and versions.filter("is_active").count() == 8
    assert versions.filter("user_id = 5 and not is_active").count() == 4
    heads = {r["user_id"]: r["health_score"] for r in J.current_profiles(written()).collect()}
    assert heads == {r["user_id"]: r["health_score"] for r in want.collect()}


def test_rate_limit_stream(spark, tmp_path):
    source = tmp_path / "in"
    at = lambda s: (T0 + dt.timedelta(seconds=s)).isoformat()
    write_lines(source, "1.json", [{"key": "k", "id": i, "ts": at(s)} for i, s in enumerate([0, 10, 20, 59])])
    events = J.read_files(spark, str(source), "key string, id string, ts timestamp", per_trigger=1)
    first = drain(J.stream_violations(events, limit=2), tmp_path)
    assert [(r["id"], r["position"]) for r in first.orderBy("position").collect()] == [("2", 3), ("3", 4)]
    # the window opened at second 0, so second 60 opens a new one: state carries over runs
    write_lines(source, "2.json", [{"key": "k", "id": 10 + i, "ts": at(s)} for i, s in enumerate([60, 61, 62])])
    second = drain(J.stream_violations(events, limit=2), tmp_path)
    assert [(r["id"], r["position"]) for r in second.orderBy("ts").collect()] == [("2", 3), ("3", 4), ("12", 3)]


def test_invites_time_out_unless_answered(spark, tmp_path):
    source = tmp_path / "in"
    at = lambda h: (T0 + dt.timedelta(hours=h)).isoformat()
    schema = "token string, status string, at timestamp"
    write_lines(source, "1.json", [{"token": "a", "status": "pending", "at": at(0)}, {"token": "b", "status": "pending", "at": at(1)}])
    write_lines(source, "2.json", [{"token": "b", "status": "accepted", "at": at(5)}])
    write_lines(source, "3.json", [{"token": "z", "status": "pending", "at": at(200)}])
    changes = J.read_files(spark, str(source), schema, per_trigger=1)
    rows = drain(J.stream_invite_expiry(changes), tmp_path).collect()
    assert [(r["token"], r["expired_at"]) for r in rows] == [("a", T0 + dt.timedelta(hours=72))]


def test_answers_close_earlier_invites_whatever_comes_first(spark, tmp_path):
    source = tmp_path / "in"
    at = lambda h: (T0 + dt.timedelta(hours=h)).isoformat()
    schema = "token string, status string, at timestamp"
    write_lines(source, "1.json", [{"token": "early", "status": "accepted", "at": at(2)}, {"token": "again", "status": "pending", "at": at(0)}])
    write_lines(source, "2.json", [{"token": "early", "status": "pending", "at": at(1.5)}, {"token": "again", "status": "declined", "at": at(3)}])
    write_lines(source, "3.json", [{"token": "again", "status": "pending", "at": at(4)}])
    write_lines(source, "4.json", [{"token": "z", "status": "pending", "at": at(300)}])
    changes = J.read_files(spark, str(source), schema, per_trigger=1)
    rows = drain(J.stream_invite_expiry(changes), tmp_path).collect()
    assert [(r["token"], r["expired_at"]) for r in rows] == [("again", T0 + dt.timedelta(hours=76))]


def test_heatmap_stream_equals_batch(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    records = Tables(spark, folder).records.select("owner_id", "created_at")
    source = str(tmp_path / "in")
    records.coalesce(1).write.parquet(source)
    far = spark.createDataFrame([(-1, dt.datetime(2100, 1, 1))], "owner_id bigint, created_at timestamp")
    stream = J.read_files(spark, source, "owner_id bigint, created_at timestamp", "parquet")
    drain(J.stream_heatmap(stream), tmp_path)
    far.coalesce(1).write.mode("append").parquet(source)
    days = drain(J.stream_heatmap(stream), tmp_path)
    got = sorted(map(tuple, J.heatmap_of(days).collect()))
    want = sorted(map(tuple, R.activity_heatmap(records, AS_OF, months=120).collect()))
    assert got == want
