"""Births, losses, recoveries and removals of tracks; identity-switch links, aliases and identity diagnostics.

Keys are (game_id, is_referee, track_id): a referee and a player may carry the same id. A track that is unseen for more than
`buffer` frames is removed; seen again after that, it is new. All of it is windows over a track's own rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trackweave.config import DEFAULT, Config
from trackweave.functions.geometry import box, box_distance, center, distance
from trackweave.operators.matching import BOX, FRAME, SPAN, TRACK, known, renamed, spans


def own() -> WindowSpec:
    """A track's rows in order of frames."""
    return Window.partitionBy(*TRACK).orderBy("frame_idx")


def births(tracks: DataFrame) -> DataFrame:
    """First frame and centre of every track."""
    cx, cy = center(box())
    first = F.min(F.struct("frame_idx", cx.alias("x"), cy.alias("y"))).alias("b")
    return tracks.groupBy(*TRACK).agg(first).select(*TRACK, F.col("b.frame_idx").alias("birth_frame"), F.col("b.x").alias("birth_x"), F.col("b.y").alias("birth_y"))


def edges(tracks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Lifecycle rows (frame_idx, kind, n): new; recovered (n: frames that it was lost for); lost; removed (n: frames since birth, once for each id)."""
    last = tracks.groupBy("game_id").agg(F.max("frame_idx").alias("end"))
    rows = tracks.select(*TRACK, "frame_idx").withColumn("before", F.lag("frame_idx").over(own())).withColumn("after", F.lead("frame_idx").over(own())).withColumn("birth", F.min("frame_idx").over(Window.partitionBy(*TRACK)))
    rows = rows.join(last, "game_id")
    gap, removal = F.col("frame_idx") - F.col("before"), F.col("frame_idx") + cfg.buffer + 1
    upto = F.coalesce("after", F.col("end") + 1)
    event = lambda frame, kind, n: F.struct(frame.alias("frame_idx"), F.lit(kind).alias("kind"), n.cast("long").alias("n"))
    zero = F.lit(0)
    found = F.array_compact(F.array(
        F.when(F.col("before").isNull() | (gap > cfg.buffer + 1), event(F.col("frame_idx"), "new", zero)),
        F.when((gap > 1) & (gap <= cfg.buffer + 1), event(F.col("frame_idx"), "recovered", gap - 1)),
        F.when(F.col("frame_idx") + 1 < upto, event(F.col("frame_idx") + 1, "lost", zero)),
        F.when(removal < upto, event(removal, "removed", removal - F.col("birth"))),
    ))
    out = rows.select(*TRACK, F.inline(found))
    once = F.row_number().over(Window.partitionBy(*TRACK, "kind").orderBy("frame_idx"))
    return out.withColumn("_n", once).where("kind <> 'removed' OR _n = 1").drop("_n")


def event_log(events: DataFrame) -> DataFrame:
    """Each role's events of a game, numbered from 1 in the order in which a reader meets them."""
    order = Window.partitionBy("game_id", "is_referee").orderBy("frame_idx", "kind", "track_id")
    return events.withColumn("event_no", F.row_number().over(order))


def unread(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """The log's events beyond each role's cursor (game_id, is_referee, cursor: events read so far); of a role without one, all."""
    both = log.join(cursors, ["game_id", "is_referee"], "left")
    return both.where(F.col("event_no") > F.coalesce("cursor", F.lit(0))).drop("cursor")


def recoveries(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return events.where("kind = 'recovered'").withColumn("long_gap", F.col("n") > cfg.long_gap)


def summary(events: DataFrame, switches: DataFrame) -> DataFrame:
    """Totals of each role, identity switches (a row each) among them."""
    kinds = ("new", "lost", "recovered", "removed")
    totals = events.groupBy("game_id", "is_referee").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds))
    turned = switches.groupBy("game_id", "is_referee").agg(F.count("*").alias("n_switches"))
    return totals.join(turned, ["game_id", "is_referee"], "left").withColumn("n_switches", F.coalesce("n_switches", F.lit(0)))


def recovered_switches(tracks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Recoveries that look like another identity: far from where the track was last seen, or, where that place is forgotten (it is kept for
    `switch_dt` frames), after a long gap. They count as switches and make no alias."""
    rows = tracks.select(*TRACK, "frame_idx", *BOX, F.struct("frame_idx", *BOX).alias("b")).withColumn("b", F.lag("b").over(own()))
    lost_for = F.col("frame_idx") - F.col("b.frame_idx") - 1
    rows = rows.withColumn("lost_for", lost_for).where((F.col("lost_for") > 0) & (F.col("lost_for") <= cfg.buffer))
    there = F.col("lost_for") - 1 <= cfg.switch_dt
    dist = F.when(there, box_distance(box(), tuple(F.col(f"b.{c}") for c in BOX)))
    rows = rows.withColumn("dist", dist).where((F.col("dist") > cfg.switch_dist) | (F.col("lost_for") > cfg.long_gap))
    return rows.select(*TRACK, "frame_idx", "lost_for", "dist")


def switches(tracks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """All identity switches: links of new tracks to lost or removed ones, and recoveries that look like another identity."""
    links = switch_links(tracks, cfg).select("game_id", "is_referee", "frame_idx", "source_kind", "source_id", "new_id", "dist")
    none = F.lit(None).cast("long").alias("new_id")
    return links.unionByName(recovered_switches(tracks, cfg).select("game_id", "is_referee", "frame_idx", F.lit("rec").alias("source_kind"), F.col("track_id").alias("source_id"), none, "dist"))


def lifetimes(events: DataFrame) -> DataFrame:
    """Mean, upper median and 90th of sorted lives, by index; 0 where no track was removed.

    Lives are ranked in a window, not gathered: a role may have any number of tracks."""
    key = ["game_id", "is_referee"]
    lives = events.where("kind = 'removed'").groupBy(*key, "n").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*key).orderBy("n")
    cum = lives.withColumn("upto", F.sum("c").over(w)).withColumn("total", F.sum("c").over(Window.partitionBy(*key)))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("n")))
    stats = cum.groupBy(*key).agg(F.max("total").alias("n_removed"), (F.sum(F.col("n") * F.col("c")) / F.sum("c")).alias("mean_life"), at(F.floor(F.col("total") / 2)).alias("median_life"), at(F.floor(F.col("total") * 0.9)).alias("p90_life"))
    roles = events.select(*key).distinct()
    return roles.join(stats, key, "left").select(*key, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_removed", "mean_life", "median_life", "p90_life")))


def shortest_lived(events: DataFrame, n: int = 10) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("game_id", "is_referee").orderBy("n", "frame_idx", "track_id"))
    return events.where("kind = 'removed'").withColumn("rank", order).where(F.col("rank") <= n).select(*TRACK, "frame_idx", F.col("n").alias("life"), "rank")


def most_recovered(events: DataFrame, n: int = 10) -> DataFrame:
    counts = events.where("kind = 'recovered'").groupBy(*TRACK).agg(F.count("*").alias("n_recovered"), F.min("frame_idx").alias("first_frame"))
    order = F.row_number().over(Window.partitionBy("game_id", "is_referee").orderBy(F.col("n_recovered").desc(), "first_frame", "track_id"))
    return counts.withColumn("rank", order).where(F.col("rank") <= n)


def switch_links(tracks: DataFrame, cfg: Config = DEFAULT, holding: DataFrame | None = None, span: int = 64) -> DataFrame:
    """New tracks that continue a lost or removed one: near in place and time, the nearest by (distance, time), and none where
    the runner-up is about as near. An interval join on spans of frames, so that it stays an equality join.

    A track is new when first seen, and when seen again after its removal. A removed one can be continued from the frame after its removal on, if it
    had lived for `source_life` frames, and unless it still had a mask then: `holding` has these (game_id, is_referee, track_id, frame_idx of the
    removal)."""
    rows = tracks.select(*TRACK, "frame_idx", *BOX).withColumn("before", F.lag("frame_idx").over(own())).withColumn("after", F.lead("frame_idx").over(own()))
    cx, cy = center(box())
    fresh = F.col("before").isNull() | (F.col("frame_idx") - F.col("before") > cfg.buffer + 1)
    new = rows.where(fresh).select("game_id", "is_referee", F.col("track_id").alias("new_id"), "frame_idx", cx.alias("cx"), cy.alias("cy"), F.floor(F.col("frame_idx") / span).alias("span"))
    since = own().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("born", F.last(F.when(fresh, F.col("frame_idx")), ignorenulls=True).over(since))
    gone = rows.where(F.col("after").isNull() | (F.col("after") > F.col("frame_idx") + 1)).select("game_id", "is_referee", F.col("track_id").alias("source_id"), cx.alias("sx"), cy.alias("sy"), "after", F.col("frame_idx").alias("seen"), "born")
    kind = lambda name, frame: F.struct(F.lit(name).alias("source_kind"), frame.alias("since"))
    gone = gone.withColumn("k", F.explode(F.array(kind("lost", F.col("seen") + 1), kind("rm", F.col("seen") + cfg.buffer + 1)))).select("*", "k.*").drop("k")
    gone = gone.where(f"source_kind = 'lost' OR (after IS NULL OR since < after) AND since - born >= {cfg.source_life}")
    if holding is not None:
        held = holding.select("game_id", "is_referee", F.col("track_id").alias("source_id"), F.col("frame_idx").alias("since"), F.lit("rm").alias("source_kind"))
        gone = gone.join(held, ["game_id", "is_referee", "source_id", "since", "source_kind"], "left_anti")
    gone = gone.withColumn("span", F.explode(F.sequence(F.floor(F.col("since") / span), F.floor((F.col("since") + cfg.switch_dt) / span))))
    both = new.join(gone, ["game_id", "is_referee", "span"]).withColumn("dt", F.col("frame_idx") - F.col("since")).withColumn("dist", distance((F.col("cx"), F.col("cy")), (F.col("sx"), F.col("sy"))))
    open_ = "after IS NULL OR frame_idx < after"
    both = both.where(f"dt <= {cfg.switch_dt} AND dist <= {cfg.switch_dist} AND new_id <> source_id AND (source_kind = 'rm' AND dt >= 1 OR source_kind = 'lost' AND dt >= 0 AND ({open_}))")
    order = Window.partitionBy("game_id", "is_referee", "new_id", "frame_idx").orderBy("dist", "dt", "source_kind", "source_id")
    ranked = both.withColumn("rank", F.row_number().over(order)).withColumn("second", F.lead("dist").over(order))
    return ranked.where(f"rank = 1 AND (second IS NULL OR second - dist >= {cfg.switch_margin})").select("game_id", "is_referee", "frame_idx", "source_kind", "source_id", "new_id", "dist", "dt")


def apply_aliases(tracks: DataFrame, links: DataFrame) -> DataFrame:
    """One hop: from a link's frame on, until its next link, a new track has the source's id; referees keep theirs. Of links in one frame those by
    place come after those by a mask."""
    order = (F.col("source_kind") != "mask").alias("by_place")
    a = links.where("NOT is_referee").groupBy("game_id", F.col("new_id").alias("track_id")).agg(F.array_sort(F.collect_list(F.struct("frame_idx", order, "source_id"))).alias("_links"))
    upto = F.filter("_links", lambda l: l["frame_idx"] <= F.col("frame_idx"))
    stable = F.when(~F.col("is_referee"), F.try_element_at(upto, F.lit(-1))["source_id"])
    return tracks.join(a, ["game_id", "track_id"], "left").withColumn("stable_id", F.coalesce(stable, F.col("track_id"))).drop("_links")


def adjacent(tracks: DataFrame) -> DataFrame:
    """Each player row beside the same track's row of the frame before, if there is one."""
    p = tracks.where("NOT is_referee").select("game_id", "frame_idx", "track_id", "x1", "y1", "x2", "y2")
    b = p.select("game_id", (F.col("frame_idx") + 1).alias("frame_idx"), "track_id", *(F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")))
    return p.join(b, ["game_id", "frame_idx", "track_id"], "left")


def id_diagnostics(tracks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per frame of players with raw and stable ids: ids shown, those that weren't in the frame before, those that are gone since, those that
    jumped, those whose raw id has changed, and raw ids that now show as another. Where two raw ids show as one, the greater stands for it."""
    p = tracks.where("NOT is_referee").select("game_id", "frame_idx", "track_id", "stable_id", *BOX)
    just = lambda c, key: F.when(F.lag("frame_idx").over(w := Window.partitionBy("game_id", key).orderBy("frame_idx")) == F.col("frame_idx") - 1, F.lag(c).over(w))
    now = p.withColumn("old_stable", just("stable_id", "track_id"))
    shown = now.groupBy("game_id", "frame_idx", "stable_id").agg(F.max(F.struct("track_id", *BOX)).alias("s"), F.collect_list(F.struct("track_id", *BOX, "old_stable")).alias("all")).withColumn("b", just("s", "stable_id"))
    known_ = F.col("b").isNotNull()
    middle = lambda r, c: (r[f"{c}1"] + r[f"{c}2"]) / 2.0
    far = lambda r: distance((middle(r, "x"), middle(r, "y")), (middle(F.col("b"), "x"), middle(F.col("b"), "y"))) >= cfg.jump_px
    count = lambda test: F.size(F.filter("all", test))
    when = lambda test: F.when(known_, count(test)).otherwise(0)
    per = shown.groupBy("game_id", "frame_idx").agg(
        F.sum(F.size("all")).alias("n_ids"), F.sum(F.when(~known_, F.size("all")).otherwise(0)).alias("n_new"), F.sum(when(far)).alias("n_jumps"),
        F.sum(when(lambda r: r["track_id"] != F.col("b.track_id"))).alias("n_raw_changed"), F.sum(count(lambda r: r["old_stable"] != F.col("stable_id"))).alias("n_map_changed"),
        F.count_if(known_).alias("stay"), F.count("*").alias("n_shown"),
    )
    order = Window.partitionBy("game_id").orderBy("frame_idx")
    prior = F.when(F.lag("frame_idx").over(order) == F.col("frame_idx") - 1, F.lag("n_shown").over(order))
    return per.withColumn("n_lost", F.coalesce(prior, F.lit(0)) - F.col("stay")).drop("stay", "n_shown")


def possible_swaps(tracks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Pairs of stable ids in both frames whose crossed distances, with a margin, are shorter than their own. Where two raw ids show as one, the greater
    stands for it."""
    shown = tracks.where("NOT is_referee").groupBy("game_id", "frame_idx", "stable_id").agg(F.max(F.struct("track_id", *BOX)).alias("s"))
    tracks = shown.select("game_id", "frame_idx", F.col("stable_id").alias("track_id"), F.lit(False).alias("is_referee"), *(F.col(f"s.{c}").alias(c) for c in BOX))
    two = adjacent(tracks).where("b_x1 IS NOT NULL")
    both = renamed(two, "p_").join(renamed(two, "q_"), ["game_id", "frame_idx"]).where("p_track_id < q_track_id")
    own = box_distance(box("p_b_"), box("p_")) + box_distance(box("q_b_"), box("q_"))
    cross = box_distance(box("p_b_"), box("q_")) + box_distance(box("q_b_"), box("p_"))
    return both.withColumn("own", own).withColumn("crossed", cross).where(F.col("crossed") + cfg.swap_margin < F.col("own")).select("game_id", "frame_idx", F.col("p_track_id").alias("a_id"), F.col("q_track_id").alias("b_id"), "own", "crossed")


def changes(tracks: DataFrame) -> DataFrame:
    """Set operators over adjacent frames: ids that came (now except before), went (before except now), and stayed (both)."""
    now = tracks.select("game_id", "is_referee", "frame_idx", "track_id")
    before = now.withColumn("frame_idx", F.col("frame_idx") + 1)
    frames = now.select("game_id", "frame_idx").distinct()
    at = ["game_id", "is_referee", "frame_idx", "track_id"]
    came = now.join(before, at, "left_anti").withColumn("kind", F.lit("came"))
    went = before.join(now, at, "left_anti").join(frames, ["game_id", "frame_idx"], "left_semi").withColumn("kind", F.lit("went"))
    return came.unionByName(went).unionByName(now.intersect(before).withColumn("kind", F.lit("stayed")))


def active_and_lost(tracks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The tracker's candidates after each frame: its own tracks (active), then those that are kept as lost, each once, with the frame in which it was
    last seen. An interval join of lost stretches with frames, on spans."""
    active = tracks.select("game_id", "is_referee", "frame_idx", "track_id", F.lit("active").alias("state"), F.col("frame_idx").alias("last_frame"))
    frames = tracks.select(*FRAME).distinct().withColumn("span", F.floor(F.col("frame_idx") / SPAN))
    gone = known(tracks, cfg).where("since < upto").withColumn("span", spans(F.col("since"), F.col("upto") - 1))
    lost = frames.join(gone, ["game_id", "span"]).where("frame_idx >= since AND frame_idx < upto")
    return active.unionByName(lost.select("game_id", "is_referee", "frame_idx", "track_id", F.lit("lost").alias("state"), F.col("seen").alias("last_frame")))


def gauges(tracks: DataFrame, owners: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per frame: tracks that are active, lost and removed so far, and masks. Lost stretches are summed as steps up and down, never spread over
    their frames; the running sums are windows over one row for each frame of a game."""
    active = tracks.groupBy(*FRAME).agg(F.count("*").alias("n_active"))
    masks = owners.groupBy(*FRAME).agg(F.count("*").alias("n_masks"))
    end = F.col("seen") + cfg.buffer + 1
    step = lambda frame, lost, removed: F.struct(frame.alias("frame_idx"), F.lit(lost).alias("lost"), F.lit(removed).alias("removed"))
    again = F.lead("frame_idx").over(own())
    gone = tracks.select(*TRACK, F.col("frame_idx").alias("seen"), again.alias("again"))
    falls = F.array(step(F.col("seen") + 1, 1, 0), F.when(F.coalesce(F.col("again") <= end, F.lit(False)), step(F.col("again"), -1, 0)).otherwise(step(end, -1, 1)))
    steps = gone.select("game_id", F.inline(falls)).groupBy(*FRAME).agg(F.sum("lost").alias("lost"), F.sum("removed").alias("removed"))
    order = Window.partitionBy("game_id").orderBy("frame_idx")
    run = active.join(steps, list(FRAME), "full").withColumn("n_lost", F.sum("lost").over(order)).withColumn("n_removed", F.sum("removed").over(order)).where("n_active IS NOT NULL")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return run.join(masks, list(FRAME), "left").select(*FRAME, "n_active", count("n_lost"), count("n_removed"), count("n_masks"))
