"""Composed runs over several games: detections to positions and reports, keypoints to homographies, and the streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.config import DEFAULT, Config
from trackweave.config import DEFAULT as CFG
from trackweave.functions.geometry import choose_projection, milli, project
from trackweave.operators import association as _association
from trackweave.operators import court, court_state, game, jersey, lifecycle, mask_state, masks, matching, tactical
from trackweave.operators.homography import H
from trackweave.operators.matching import BOX, FRAME
from trackweave.plans import sql as S
from trackweave.plans.courts import EMA
from trackweave.plans.registry import query
from trackweave.sources import tables as T
from trackweave.sources.court_template import TEMPLATE
from trackweave.sources.written import materialize, scratch
from trackweave.streaming import settled, stateful


def updates(keypoints: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The court's state after each update; only every `keypoint_every`-th frame is one."""
    return court_state.court_run(keypoints.where(F.col("frame_idx") % cfg.keypoint_every == 0), cfg)


def held_points(state: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The keypoints that hold after each update, with their court positions under the template whose side is that of the update's layout, or
    else the court's side, or else under the mode of its homography."""
    places = F.array(*(F.struct(F.lit(tx).alias("tx"), F.lit(ty).alias("ty")) for _, tx, ty, _ in TEMPLATE))
    at = F.transform(F.arrays_zip("xs", "ys", "confs"), lambda p, k: F.struct(k.cast("int").alias("kp_idx"), p["xs"].alias("x"), p["ys"].alias("y"), p["confs"].alias("conf"), F.get(places, k).alias("t")))
    rows = state.withColumn("_p", F.filter(at, lambda p: (p["x"] > 0) & (p["y"] > 0)))
    mean = F.aggregate("_p", F.lit(0.0), lambda s, p: s + p["t"]["tx"]) / F.size("_p")
    mode = court.template_mode(F.col("layout"), F.col("court_side"), F.when(F.size("_p") > 0, mean), F.col("mode"), cfg)
    rows = rows.select(*FRAME, mode.alias("template"), F.explode("_p").alias("p"))
    tx = F.when(F.col("template") == "mirrored", cfg.court_w - F.col("p.t.tx")).otherwise(F.col("p.t.tx"))
    return rows.select(*FRAME, "p.kp_idx", "p.x", "p.y", "p.conf", tx.alias("tx"), F.col("p.t.ty").alias("ty"))


def track_run(detections: DataFrame, runs: DataFrame, state: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(online, links, tracks, positions) of a run of the whole. `online` has the tracks that association and masks leave, as `game.game_run` tells them;
    `links` the switches of identity, by place and by masks handed over; `tracks` those that suppression leaves and the court has activated, with
    stable ids; `positions` their feet, by masks or boxes, projected and smoothed.

    `state` has the court's updates, as `updates` gives; a frame holds the last one's."""
    told = materialize(game.game_run(detections, runs, state, cfg), "run-told")
    online, event = told.where("kind = 'track'"), lambda kind: told.where(F.col("kind") == kind).select("game_id", "is_referee", "frame_idx", "track_id", "other_id")
    by_place = lifecycle.switch_links(online, cfg, event("holding")).select("game_id", "is_referee", "frame_idx", "source_kind", "source_id", "new_id")
    links = materialize(by_place.unionByName(masks.reuse_links(event("reuse").withColumnRenamed("other_id", "owner_id"))), "run-links")
    tracks = lifecycle.apply_aliases(online.where("active"), links)
    tracks = materialize(tracks.select(*FRAME, "is_referee", "track_id", "stable_id", "place", *BOX, "confidence", "mask_id", "by_mask", "fx", "fy"), "run-active")
    feet = tracks.where("NOT is_referee").withColumn("update_frame", F.col("frame_idx") - F.col("frame_idx") % cfg.keypoint_every)
    now = state.select("game_id", F.col("frame_idx").alias("update_frame"), *H)
    feet = feet.join(now, ["game_id", "update_frame"], "left").select(*FRAME, "update_frame", "stable_id", "track_id", *H, F.col("fx").alias("x"), F.col("fy").alias("y"))
    near = held_points(state, cfg)
    relative = court.weighted_projection(feet.select("game_id", F.col("update_frame").alias("frame_idx"), F.struct("frame_idx", "track_id").alias("point_id"), "x", "y"), near, cfg)
    relative = relative.select("game_id", F.col("point_id.frame_idx").alias("frame_idx"), F.col("point_id.track_id").alias("track_id"), F.struct(F.col("tx").alias("x"), F.col("ty").alias("y")).alias("r"))
    hx, hy = project(F.col("x"), F.col("y"), [F.col(c) for c in H])
    direct = F.when(F.col("h0").isNotNull(), F.struct(hx.alias("x"), hy.alias("y")))
    both = feet.join(relative, [*FRAME, "track_id"], "left").withColumn("c", choose_projection(F.col("r"), direct, cfg)).where("c IS NOT NULL")
    # Two raw ids may show as one in a frame; the least stands for it in the trail.
    one = both.groupBy(*FRAME, "stable_id").agg(F.min(F.struct("track_id", "c")).alias("m"))
    points = one.select(*FRAME, F.col("stable_id").alias("track_id"), F.lit(False).alias("is_referee"), F.col("m.c.x").alias("x"), F.col("m.c.y").alias("y"), F.col("m.c.source").alias("source"))
    smooth = tactical.smooth(points, cfg).join(points.select(*FRAME, "track_id", "source"), [*FRAME, "track_id"])
    return online, links, tracks, smooth


def jersey_run(detections: DataFrame, reads: DataFrame, tracks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Votes for the numbers of stable ids: number boxes of every `ocr_every`-th frame go to the first active player that holds their centre, and what was read
    in them counts as that player's votes."""
    # Where two tracks show as one, the first one's place and the last one's box count.
    last = F.max_by(F.struct(*BOX), "place").alias("b")
    one = tracks.groupBy(*FRAME, "is_referee", F.col("stable_id").alias("track_id")).agg(F.min("place").alias("obs_id"), last)
    players = one.select(*FRAME, "is_referee", "track_id", "obs_id", "b.*")
    boxes = matching.number_boxes(detections, cfg).where(F.col("frame_idx") % cfg.ocr_every == 0)
    held = matching.containing_track(boxes, players).select(*FRAME, "det_id", "track_id")
    return jersey.votes(reads.select(*FRAME, "det_id", "text", "conf").join(held, [*FRAME, "det_id"]), cfg)


def _state(spark, d) -> DataFrame:
    return materialize(updates(T.views(spark, d)), "run-court")


def _run(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return track_run(T.detections(spark, d), T.place_masks(spark, d), _state(spark, d))


@query()
def keypoint_run(spark, d):
    out = court_state.court_run(T.views(spark, d))
    return out.select("game_id", "frame_idx", "status", "mode", "observed", "court_side", "switched", "reset", "streak", "n_valid", "n_carried", F.round("score", 3).alias("score"), F.round("reproj", 3).alias("reproj"))


@query()
def homography_machine(spark, d):
    """Updates by what became of their homography, and the successes of each game."""
    return court_state.court_run(T.views(spark, d)).groupBy("game_id").agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "fallback", "fail")), F.count_if("reset").alias("n_resets"), F.count_if("switched").alias("n_switched"))


@query()
def tracking_run(spark, d):
    *_, points = _run(spark, d)
    return points.select("game_id", "frame_idx", "track_id", "source", milli(F.col("sx")).alias("sx_milli"), milli(F.col("sy")).alias("sy_milli"))


@query()
def tracking_report(spark, d):
    """Totals of each role over the same run; masks handed over count as switches."""
    online, links, *_ = _run(spark, d)
    rec = lifecycle.recovered_switches(online).select("game_id", "is_referee")
    return lifecycle.summary(lifecycle.edges(online), links.select("game_id", "is_referee").unionByName(rec))


@query()
def tracking_jerseys(spark, d):
    """Votes for each number of each stable id, and the number that it is locked on."""
    _, _, tracks, _ = _run(spark, d)
    voted = materialize(jersey_run(T.detections(spark, d), T.ocr_reads(spark, d), tracks), "run-votes")
    locked = jersey.locks(voted).select("game_id", "track_id", "lock_frame", "jersey")
    return jersey.counts(voted).join(locked, ["game_id", "track_id"], "left")


@query()
def mask_ownership(spark, d):
    """Who has which mask in the crowd of tracks, and what happens to it."""
    return mask_state.ownership(T.crowd(spark, d), T.place_masks(spark, d))


@query()
def association(spark, d):
    return _association.associate(T.detections(spark, d)).select("frame_idx", "is_referee", "track_id", "det_id", "confidence")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives for all that its source has, written to the shared folder; the folder is removed when the driver ends."""
    place = scratch(stream.sparkSession, name)
    sink = stream.writeStream.option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    q = sink.outputMode("append").format("parquet").option("path", f"{place}/out").start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/out")


def as_stream(rows: DataFrame, name: str) -> DataFrame:
    """A table as a stream of one batch."""
    at = materialize(rows, name)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(at.written_at)


@query(f"{EMA} SELECT frame_idx, is_referee, track_id, {S.milli('sx')} AS sx_milli, {S.milli('sy')} AS sy_milli FROM ema")
def stream_smooth(spark, d):
    out = drained(stateful.smooth_stream(as_stream(tactical.feet(T.tracks(spark, d)), "stream-feet")), "stream-smooth")
    return out.select("frame_idx", "is_referee", "track_id", milli(F.col("sx")).alias("sx_milli"), milli(F.col("sy")).alias("sy_milli"))


@query(f"{S.VOTES} SELECT game_id, track_id, frame_idx, det_id, number FROM lk0")
def stream_jersey(spark, d):
    out = drained(stateful.jersey_stream(as_stream(T.ocr_reads(spark, d), "stream-reads")), "stream-jersey")
    return out.select(F.col("game_id").cast("long").alias("game_id"), "track_id", "frame_idx", "det_id", "number")


def closed(rows: DataFrame, **values) -> DataFrame:
    """Rows and one more, of a game -1 an hour later, so that the watermark passes all others."""
    last = {"game_id": -1, "is_referee": False, "track_id": -1, "det_id": -1} | values
    end = rows.agg((F.ceil((F.max("frame_idx") + 3600 * stateful.FPS) / CFG.ocr_every) * CFG.ocr_every).alias("frame_idx"))
    return rows.unionByName(end.select(*(F.lit(last[c]).cast(t).alias(c) if c in last else c for c, t in rows.dtypes)))


@query(f"{S.EDGES} SELECT game_id, is_referee, track_id, frame_idx, kind, n FROM ev")
def stream_lifecycle(spark, d):
    t = T.tracks(spark, d).select("game_id", "is_referee", "track_id", "frame_idx")
    out = drained(settled.lifecycle_stream(as_stream(closed(t), "stream-tracks")), "stream-lifecycle").where("game_id >= 0")
    ends = t.groupBy("game_id").agg(F.max("frame_idx").alias("end"))
    return out.join(ends, "game_id").where("frame_idx <= end").select(F.col("game_id").cast("long").alias("game_id"), "is_referee", "track_id", "frame_idx", "kind", "n")


@query(f"{S.LINKS} SELECT game_id, is_referee, frame_idx, source_kind, source_id, new_id, {S.milli('dist')} AS dist_milli, dt FROM links")
def stream_links(spark, d):
    t = closed(T.tracks(spark, d).select("game_id", "is_referee", "track_id", "frame_idx", *BOX), **dict.fromkeys(BOX, 0))
    out = drained(settled.links_stream(as_stream(t, "stream-tracks")), "stream-links").where("game_id >= 0")
    return out.select(F.col("game_id").cast("long").alias("game_id"), "is_referee", "frame_idx", "source_kind", "source_id", "new_id", milli(F.col("dist")).alias("dist_milli"), "dt")


@query(f"{S.VOTES} SELECT game_id, track_id, lock_frame, voted, owner, CASE WHEN owner <= 2 THEN voted END AS jersey FROM lk")
def stream_owners(spark, d):
    reads = closed(T.ocr_reads(spark, d), text="0", conf=1.0)
    out = drained(settled.owners_stream(as_stream(reads, "stream-reads")), "stream-owners").where("game_id >= 0")
    return out.select(F.col("game_id").cast("long").alias("game_id"), "track_id", F.col("frame_idx").alias("lock_frame"), F.col("number").alias("voted"), "owner", "jersey")
