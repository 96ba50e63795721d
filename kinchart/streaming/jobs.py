"""Continuous jobs with Structured Streaming.

State that must survive a lost executor lives in the checkpoint of the query; every batch function
is idempotent (a batch that runs again overwrites what it wrote before).
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinchart.operators import extract as X
from kinchart.operators import family as K
from kinchart.operators import risk as S

NOTE = "record_id string, text string"


def read_files(spark: SparkSession, path: str, schema: str = NOTE, source: str = "json", per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format(source).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def _start(stream: DataFrame, batch, checkpoint: str, once: bool):
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def stream_extract(notes: DataFrame, out: str, checkpoint: str, buckets: int = 64, once: bool = True):
    """New notes (record_id, text) become entity rows and a status row per record.

    Batches are written to a folder of their own, named by the stream's id (which its checkpoint
    keeps) and the batch, so a repeated batch replaces itself and another stream replaces nothing.
    Readers take the batch written last per record (``current_entities``), which is what makes
    re-extraction of a record replace its earlier entities.
    """

    def batch(docs: DataFrame, number: int) -> None:
        stream = docs.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        written = F.lit(time.time()).alias("written")
        docs = docs.withColumn("bucket", F.pmod(F.xxhash64("record_id"), F.lit(buckets))).persist()  # read twice
        found = X.extract_documents(docs.filter(F.length(F.trim("text")) > 0))
        rows = found.select("record_id", "bucket", F.posexplode_outer("entities").alias("ord", "e"))
        rows = rows.filter("ord is not null").select("record_id", "bucket", "ord", "e.*", F.lit(number).alias("batch"), F.lit(stream).alias("origin"))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/entities/stream={stream}/run={number}")
        status = F.when(F.col("text").isNull(), "failed").otherwise("done")
        told = docs.select("record_id", status.alias("extraction_status"), F.lit(number).alias("batch"), F.lit(stream).alias("origin"), written)
        told.write.mode("overwrite").parquet(f"{out}/status/stream={stream}/run={number}")
        docs.unpersist()

    return _start(notes, batch, checkpoint, once)


def current_entities(entities: DataFrame, status: DataFrame) -> DataFrame:
    """Entities of the latest extraction of each record."""
    last = F.max(F.struct("written", "origin", "batch"))
    latest = status.groupBy("record_id").agg(last.alias("_l")).select("record_id", "_l.origin", "_l.batch")
    return entities.join(latest, ["record_id", "origin", "batch"], "left_semi")


def refresh_risks(touched: DataFrame, tables: dict[str, DataFrame], as_of) -> DataFrame:
    """Risk profiles of the touched users only (user_id); every table is cut to them first."""
    keys = touched.select("user_id").distinct()
    users = tables["users"].join(keys.withColumnRenamed("user_id", "id"), "id", "left_semi")
    members = tables["members"].join(keys, "user_id", "left_semi")
    own = tables["records"].filter("family_member_id is null").join(keys.withColumnRenamed("user_id", "owner_id"), "owner_id", "left_semi")
    kin = tables["records"].join(members.select(F.col("id").alias("family_member_id")), "family_member_id", "left_semi")
    effective = K.member_conditions(kin, tables["entities"], distinct=False, use_corrections=True)
    features = S.all_features(users, own.unionByName(kin), tables["entities"], members, as_of)
    return S.risk_profile_build(features, K.pattern_boost(K.weighted_patterns(members, effective)))


def stream_risk_refresh(changes: DataFrame, tables: dict[str, DataFrame], out: str, checkpoint: str, as_of, once: bool = True):
    """Re-score the users named in a stream of changes.

    Each batch is written to a folder of its own, named by the stream's id and the batch, so a repeated
    batch replaces itself and a stream with a new checkpoint replaces nothing.  Earlier predictions stay as
    rows; ``versioned_predictions`` tells which are active and ``current_profiles`` the profile of each user.
    """

    def batch(touched: DataFrame, number: int) -> None:
        stream = touched.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        scored = refresh_risks(touched, tables, as_of).withColumns(
            {"written": F.lit(time.time()), "origin": F.lit(stream), "batch": F.lit(number)}
        )
        scored.write.mode("overwrite").parquet(f"{out}/stream={stream}/run={number}")

    return _start(changes, batch, checkpoint, once)


VERSION = ("written", "origin", "batch")


def versioned_predictions(scored: DataFrame) -> DataFrame:
    """All predictions ever written with ``is_active``: of a user and disease only the one written last is."""
    last = scored.groupBy("user_id", "disease").agg(F.max(F.struct(*VERSION)).alias("_last"))
    joined = scored.join(last, ["user_id", "disease"])
    return joined.withColumn("is_active", F.struct(*VERSION) == F.col("_last")).drop("_last")


def current_profiles(scored: DataFrame) -> DataFrame:
    """Score, grade and number of watched diseases of each user as written last."""
    heads = scored.groupBy("user_id", *VERSION).agg(
        F.first("health_score").alias("health_score"), F.first("health_grade").alias("health_grade"),
        F.sum(F.col("on_watchlist").cast("int")).cast("int").alias("watchlist"),
    )
    latest = F.max_by(F.struct("health_score", "health_grade", "watchlist"), F.struct(*VERSION))
    return heads.groupBy("user_id").agg(latest.alias("_p")).select("user_id", "_p.*")


def stream_heatmap(records: DataFrame, lateness: str = "40 days") -> DataFrame:
    """Monthly record counts per owner of a stream, final once the watermark has passed the month.

    A month counts by its own window start, so late rows up to ``lateness`` are still included.
    """
    day = F.window("created_at", "1 day")
    daily = records.withWatermark("created_at", lateness).groupBy("owner_id", day.alias("w")).agg(F.count("*").alias("records"))
    return daily.select(
        "owner_id", F.col("w.start").alias("day"), F.date_format("w.start", "yyyy-MM").alias("month"), "records"
    )


def heatmap_of(daily: DataFrame) -> DataFrame:
    """Months from the day counts the stream has written."""
    return daily.groupBy("owner_id", "month").agg(F.sum("records").alias("records"))


RATE_OUT = "key string, id string, ts timestamp, window_start timestamp, position int"


def stream_violations(events: DataFrame, limit: int = 100, seconds: int = 60, lateness: str = "10 seconds") -> DataFrame:
    """Requests (key, id, ts) beyond the limit of a window that opens with the key's first request.

    The state of a key is the open window: its start and its count.  It expires with the watermark.
    """
    span = pd.Timedelta(seconds=seconds)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = (pd.Timestamp(state.get[0], unit="us"), state.get[1]) if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "id"])
        out = []
        for row in rows.itertuples():
            if start is None or row.ts >= start + span:
                start, count = row.ts, 0
            count += 1
            if count > limit:
                out.append((key[0], row.id, row.ts, start, count))
        state.update((int(start.value // 1000), count))
        ends = int((start + span).value // 1_000_000)
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "id", "ts", "window_start", "position"])

    marked = events.select(F.col("key").cast("string"), F.col("id").cast("string"), "ts").withWatermark("ts", lateness)
    return marked.groupBy("key").applyInPandasWithState(
        step, RATE_OUT, "start_us bigint, count int", "append", GroupStateTimeout.EventTimeTimeout
    )


NEVER_MS = -(2**62)


def stream_invite_expiry(changes: DataFrame, hours: int = 72, lateness: str = "1 hour") -> DataFrame:
    """Invites (token, status, at) that ran out: pending for ``hours`` and neither accepted nor declined.

    Times of events decide, not their arrival: an answer closes the invite sent before it, also if
    it arrives first (it is kept until no earlier invite can come), and a later invite opens anew.
    """
    life_ms = hours * 3_600_000

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            sent_ms, answered_ms = state.get
            state.remove()
            if sent_ms > answered_ms:
                yield pd.DataFrame({"token": [key[0]], "expired_at": [pd.Timestamp(sent_ms + life_ms, unit="ms")]})
            return
        sent_ms, answered_ms = state.get if state.exists else (NEVER_MS, NEVER_MS)
        for part in parts:
            pending = part["status"] == "pending"
            if pending.any():
                sent_ms = max(sent_ms, int(part.loc[pending, "at"].max().value // 1_000_000))
            if not pending.all():
                answered_ms = max(answered_ms, int(part.loc[~pending, "at"].max().value // 1_000_000))
        state.update((sent_ms, answered_ms))
        until = sent_ms + life_ms if sent_ms > answered_ms else answered_ms + 1
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))

    marked = changes.select("token", "status", "at").withWatermark("at", lateness)
    return marked.groupBy("token").applyInPandasWithState(
        step,
        "token string, expired_at timestamp",
        "sent_ms bigint, answered_ms bigint",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
