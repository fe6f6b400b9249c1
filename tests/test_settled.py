"""Streams that wait for late rows give what the batch operators give, over restarts too."""

import json

import pytest
from pyspark.sql import functions as F
from test_streaming import SMALL

from trackweave.operators import jersey, lifecycle
from trackweave.sources import tables as T
from trackweave.streaming import settled


def parts_of(df, order, parts=4, late=20):
    """Parts of a table in order, in which some rows come a part later than their frames say, but within the bound."""
    end = df.agg(F.max(order)).first()[0] + 1
    moved = F.when(F.xxhash64(*df.columns) % 5 == 0, late).otherwise(0)
    at = F.floor((F.col(order) + moved) * parts / (end + late))
    return [df.where(at == k) for k in range(parts)]


def run(stream, place, name):
    q = stream.writeStream.option("checkpointLocation", f"{place}/{name}-state").trigger(availableNow=True).outputMode("append").format("parquet").option("path", f"{place}/{name}").start()
    q.awaitTermination()


def gathered(spark, df, order, stream_of, place, name, close):
    """What a stream gives that is stopped and started again after each part."""
    for part in [*parts_of(df, order), close]:
        part.coalesce(1).write.mode("append").parquet(f"{place}/in")
        run(stream_of(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")), place, name)
    return spark.read.parquet(f"{place}/{name}")


def closing(df, order):
    """A row of another game, long after all others."""
    return df.orderBy(order).limit(1).withColumn("game_id", F.lit(-1)).withColumn(order, F.lit(3_000_000).cast("long"))


def test_lifecycle(spark, tmp_path):
    t = T.tracks(spark, SMALL).select("game_id", "is_referee", "track_id", "frame_idx").where("track_id % 7 = 0 OR frame_idx % 40 < 10")
    far = t.where("track_id < 3").withColumn("frame_idx", F.col("frame_idx") + 400)
    t = t.unionByName(far).cache()
    got = gathered(spark, t, "frame_idx", settled.lifecycle_stream, str(tmp_path), "out", closing(t, "frame_idx")).where("game_id >= 0")
    end = t.agg(F.max("frame_idx")).first()[0]
    rows = lambda d: sorted((r.is_referee, r.track_id, r.frame_idx, r.kind, r.n) for r in d.collect() if r.frame_idx <= end)
    want = rows(lifecycle.edges(t))
    assert rows(got) == want and {w[3] for w in want} == {"new", "lost", "recovered", "removed"}


def test_links(spark, tmp_path):
    t = T.tracks(spark, SMALL).where("track_id % 3 <> 0 OR frame_idx % 40 < 10")
    t = t.unionByName(t.where("track_id < 60").withColumn("frame_idx", F.col("frame_idx") + 230)).select("game_id", "is_referee", "track_id", "frame_idx", "x1", "y1", "x2", "y2").cache()
    want = sorted((r.is_referee, r.frame_idx, r.source_kind, r.source_id, r.new_id, round(r.dist, 6), r.dt) for r in lifecycle.switch_links(t).collect())
    got = gathered(spark, t, "frame_idx", settled.links_stream, str(tmp_path), "out", closing(t, "frame_idx")).where("game_id >= 0")
    assert sorted((r.is_referee, r.frame_idx, r.source_kind, r.source_id, r.new_id, round(r.dist, 6), r.dt) for r in got.collect()) == want
    assert {w[2] for w in want} == {"lost", "rm"}


@pytest.fixture(params=["UTC", "America/New_York"])
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_owners(spark, tmp_path, zone):
    reads = T.ocr_reads(spark, SMALL).withColumn("track_id", F.col("track_id") % 12).withColumn("text", F.concat(F.lit("#"), (F.col("det_id") % 3).cast("string"))).cache()
    want = sorted((r.track_id, r.lock_frame, r.voted, r.owner, r.jersey) for r in jersey.locks(jersey.votes(reads)).collect())
    last = closing(reads, "frame_idx").withColumns({"text": F.lit("1"), "conf": F.lit(1.0)})
    got = gathered(spark, reads, "frame_idx", settled.owners_stream, str(tmp_path), "out", last).where("game_id >= 0")
    assert sorted((r.track_id, r.frame_idx, r.number, r.owner, r.jersey) for r in got.collect()) == want
    assert any(w[4] is None for w in want) and any(w[4] for w in want)


def test_report_sink(spark, tmp_path):
    """A batch that is run again after a crash writes over what it has written, so each row is there once."""
    rows = spark.range(30).withColumn("kind", F.lit("new"))
    for k in range(3):
        rows.where(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out, state, crashed = f"{tmp_path}/out", f"{tmp_path}/state", []

    def put(df, batch):
        df.write.mode("overwrite").json(f"{out}/batch={batch}")
        if batch == 1 and not crashed:
            crashed.append(batch)
            raise RuntimeError("the driver died")

    q = stream().writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start()
    with pytest.raises(Exception, match="the driver died"):
        q.awaitTermination()
    settled.report_sink(stream(), out, state).start().awaitTermination()
    ids = [json.loads(line)["id"] for p in (tmp_path / "out").rglob("part-*.json") for line in p.read_text().splitlines()]
    assert crashed and sorted(ids) == list(range(30))
