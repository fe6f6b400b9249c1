"""Streams give what the batch operators give."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from trackweave.operators import jersey, tactical
from trackweave.sources import tables as T
from trackweave.streaming import stateful


def drained(spark, stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


@pytest.fixture()
def as_stream(spark, tmp_path):
    def make(df, order, parts=3):
        """A table as a stream of files that come in order."""
        top = df.agg(F.max(order)).first()[0] + 1
        for k in range(parts):
            df.where((F.col(order) >= top * k // parts) & (F.col(order) < top * (k + 1) // parts)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return make


def test_smoothing(spark, as_stream):
    points = tactical.feet(T.tracks(spark, SMALL)).where("track_id < 20")
    want = {(r.is_referee, r.track_id, r.frame_idx): (round(r.sx, 6), round(r.sy, 6)) for r in tactical.smooth(points).collect()}
    got = {(r.is_referee, r.track_id, r.frame_idx): (round(r.sx, 6), round(r.sy, 6)) for r in drained(spark, stateful.smooth_stream(as_stream(points, "frame_idx")), "smooth").collect()}
    assert got == want


def test_jersey(spark, as_stream):
    reads = T.ocr_reads(spark, SMALL).withColumn("track_id", F.col("track_id") % 5).withColumn("text", F.substring("text", 1, 3))
    want = {(r.track_id, r.lock_frame, r.voted) for r in jersey.locks(jersey.votes(reads)).collect()}
    got = {(r.track_id, r.frame_idx, r.number) for r in drained(spark, stateful.jersey_stream(as_stream(reads, "frame_idx")), "jersey").collect()}
    assert got == want and want


def test_activation(spark, as_stream):
    counted = tactical.court_points(T.tracks(spark, SMALL), [0.21, 0.05, -12.0, 0.01, 0.33, -20.0, 0.0001, 0.0003, 1.0])
    none = spark.createDataFrame([], "game_id int, frame_idx long, track_id long, overlap double, inside_area long")
    want = {(r.is_referee, r.track_id, r.f) for r in tactical.activated(counted, none, none.select("game_id", "frame_idx")).where("active AND NOT is_referee").groupBy("is_referee", "track_id").agg(F.min("frame_idx").alias("f")).collect()}
    got = {(r.is_referee, r.track_id, r.active_from) for r in drained(spark, stateful.activation_stream(as_stream(counted.where("NOT is_referee"), "frame_idx")), "active", "complete").collect()}
    assert got == want


def test_windows(spark, as_stream):
    events = T.events(spark, SMALL).withColumn("ts", stateful.event_time(F.col("ts")))
    got = drained(spark, stateful.windowed_counts(as_stream(events, "event_id")), "windows", "complete")
    assert got.agg(F.sum("n")).first()[0] == events.count()
    assert stateful.sessions(events).agg(F.sum("n")).first()[0] == events.count()
