"""Masks as run-length rows (game_id, frame_idx, mask_id, y, x_start, x_end; the end is exclusive) against boxes and the court.

A pixel belongs to one mask at most, so a mask's runs don't overlap. Sums and percentiles weigh runs by their pixels; pixels are never spread
out into rows, but for a bounded sample of each mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.config import DEFAULT, Config
from trackweave.functions.fold import running
from trackweave.functions.geometry import box, box_distance, expand, iou, iou_tlwh, project
from trackweave.operators.matching import BOX, FRAME, TRACK, as_tlwh, renamed

WIDE = ("wx1", "wy1", "wx2", "wy2")


def shuffled(runs: DataFrame) -> DataFrame:
    """Runs that a join is to shuffle: a mask is some hundred runs, which the size of the table that they were unpacked from doesn't tell, so they would be broadcast."""
    return runs.hint("merge")


def with_wide(tracks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Tracks with their grown boxes."""
    wide = expand(box(), cfg.expand_ratio, cfg.frame_w, cfg.frame_h)
    return tracks.select(*FRAME, "is_referee", "track_id", *BOX, *(v.alias(c) for v, c in zip(wide, WIDE)))


def clipped(low: Column, high: Column) -> Column:
    """Pixels of a run within an interval of x."""
    return F.greatest(F.lit(0), F.least(F.col("x_end"), high) - F.greatest(F.col("x_start"), low))


def overlaps(tracks: DataFrame, runs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Pixels of each mask inside each box of its frame (`inside`) and inside the grown box (`wide`): clipped runs, summed."""
    x1, y1, x2, y2, wx1, wy1, wx2, wy2 = map(F.col, (*BOX, *WIDE))
    both = with_wide(tracks, cfg).join(shuffled(runs), list(FRAME)).where((F.col("y") >= F.least(y1, wy1)) & (F.col("y") < F.greatest(y2, wy2)) & (F.col("x_start") < F.greatest(x2, wx2)) & (F.col("x_end") > F.least(x1, wx1)))
    low, high = F.greatest(F.lit(0), x1), F.least(F.lit(cfg.frame_w), x2)
    inside = F.when((F.col("y") >= y1) & (F.col("y") < y2) & F.col("y").between(0, cfg.frame_h - 1), clipped(low, high)).otherwise(0)
    wide = F.when((F.col("y") >= wy1) & (F.col("y") < wy2), clipped(wx1, wx2)).otherwise(0)
    return both.groupBy(*FRAME, "is_referee", "track_id", "mask_id", *BOX).agg(F.sum(inside).alias("inside"), F.sum(wide).alias("wide"))


def sizes(runs: DataFrame) -> DataFrame:
    """Pixels, and the centroid as whole pixels, of each mask."""
    n = F.col("x_end") - F.col("x_start")
    mx = F.sum(n * (F.col("x_start") + F.col("x_end") - 1)).cast("double") / (2 * F.sum(n))
    return runs.groupBy(*FRAME, "mask_id").agg(F.sum(n).alias("area"), mx.cast("long").alias("cx"), (F.sum(n * F.col("y")).cast("double") / F.sum(n)).cast("long").alias("cy"))


def dominant(tracks: DataFrame, runs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The mask with most pixels in each box (the lowest id of equals): share of the box within the frame that it fills, its area, its pixels in the
    grown box and their share of it."""
    per = overlaps(tracks, runs, cfg).where("inside > 0")
    first = F.row_number().over(Window.partitionBy(*FRAME, "is_referee", "track_id").orderBy(F.col("inside").desc(), "mask_id"))
    best = per.withColumn("_n", first).where("_n = 1").drop("_n").join(sizes(runs).select(*FRAME, "mask_id", "area"), [*FRAME, "mask_id"])
    wide, high = (F.least(F.lit(m), F.col(b)) - F.greatest(F.lit(0), F.col(a)) for m, a, b in ((cfg.frame_w, "x1", "x2"), (cfg.frame_h, "y1", "y2")))
    return best.withColumn("fill", F.col("inside").cast("double") / F.greatest(F.lit(1), wide * high)).withColumn("inside_ratio", F.col("wide").cast("double") / F.greatest(F.lit(1), F.col("area")))


def valid(found: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Masks of which enough pixels, and enough of all, lie in the grown box."""
    return found.where((F.col("wide") >= cfg.mask_area) & (F.col("inside_ratio") >= cfg.mask_inside))


def without_duplicates(tracks: DataFrame, found: DataFrame, births: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Tracks of a role without those that share a valid dominant mask, well filled, with an earlier one, unless they overlap it little and
    stand apart."""
    t = valid(found, cfg).where(F.col("fill") >= cfg.mask_fill).join(births.select(*TRACK, "birth_frame"), list(TRACK))
    owner = Window.partitionBy(*FRAME, "is_referee", "mask_id").orderBy("birth_frame", "track_id", F.col("fill").desc())
    t = t.withColumn("first", F.first(F.struct("track_id", *BOX)).over(owner)).select("*", *(F.col(f"first.{c}").alias(f"o_{c}") for c in ("track_id", *BOX)))
    apart = (iou_tlwh(as_tlwh(), as_tlwh("o_")) < cfg.dup_iou) & (box_distance(box(), box("o_")) > cfg.dup_dist)
    gone = t.where((F.col("track_id") != F.col("o_track_id")) & ~apart)
    return tracks.join(gone.select(*FRAME, "is_referee", "track_id"), [*FRAME, "is_referee", "track_id"], "left_anti")


def without_referee_conflicts(tracks: DataFrame, runs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Player tracks without those that overlap a referee of the frame who is surer by a margin, and whose box a valid mask fills.

    A dropped player's mask is cleared, so the next player, in order of observation, doesn't find it: a fold over the few players of a frame that
    are beside a surer referee at all; only of these are masks looked at."""
    keep = FRAME
    p, r = tracks.where("NOT is_referee"), renamed(tracks.where("is_referee").select(*FRAME, *BOX, "confidence"), "r_")
    beside = (iou(box(), box("r_")) >= cfg.ref_iou) & (F.col("r_confidence") >= F.col("confidence") + cfg.ref_conf_gain)
    hits = p.join(r, list(FRAME)).where(beside).groupBy(*FRAME, "is_referee", "track_id", "obs_id", *BOX).agg(F.count("*").alias("n_referees"))
    near = runs.join(hits.select(*FRAME).distinct(), list(FRAME), "left_semi")
    per = overlaps(hits, near, cfg).where("inside > 0").join(sizes(near).select(*FRAME, "mask_id", "area"), [*FRAME, "mask_id"])
    wide, high = (F.least(F.lit(m), F.col(b)) - F.greatest(F.lit(0), F.col(a)) for m, a, b in ((cfg.frame_w, "x1", "x2"), (cfg.frame_h, "y1", "y2")))
    good = (F.col("wide") >= cfg.mask_area) & (F.col("wide").cast("double") / F.greatest(F.lit(1), F.col("area")) >= cfg.mask_inside)
    full = good & (F.col("inside").cast("double") / F.greatest(F.lit(1), wide * high) >= cfg.ref_fill)
    seen = per.groupBy(*keep, "track_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("inside")).alias("less"), "mask_id", full.alias("full")))).alias("masks"))
    frames = hits.select(*keep, "track_id", "obs_id").join(seen, [*keep, "track_id"]).groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("obs_id", "track_id", "masks"))).alias("players"))
    start = F.struct(F.array().cast("array<bigint>").alias("cleared"), F.array().cast("array<bigint>").alias("away"))

    def add(state: Column, player: Column) -> Column:
        first = F.get(F.filter(player["masks"], lambda m: ~F.array_contains(state["cleared"], m["mask_id"])), F.lit(0))
        out = F.coalesce(first["full"], F.lit(False))
        plus = lambda a, v: F.when(out, F.concat(a, F.array(v.cast("bigint")))).otherwise(a)
        return F.struct(plus(state["cleared"], first["mask_id"]).alias("cleared"), plus(state["away"], player["track_id"]).alias("away"))

    away = frames.select(*keep, F.explode(F.aggregate("players", start, add)["away"]).alias("track_id"))
    return p.join(away, [*keep, "track_id"], "left_anti")


def lookup(tracks: DataFrame, owners: DataFrame) -> DataFrame:
    """Player tracks with the mask that is theirs in the frame."""
    return tracks.where("NOT is_referee").join(owners.select(*FRAME, "track_id", "mask_id"), [*FRAME, "track_id"])


def track_masks(tracks: DataFrame, owners: DataFrame, runs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Runs of each player's own mask, clipped to its grown box (columns as of runs, and track_id); only of masks that stay valid so."""
    both = lookup(with_wide(tracks, cfg), owners).join(shuffled(runs), [*FRAME, "mask_id"])
    inside = F.when((F.col("y") >= F.col("wy1")) & (F.col("y") < F.col("wy2")), clipped(F.col("wx1"), F.col("wx2"))).otherwise(0)
    start = F.greatest("x_start", "wx1")
    cut = F.when(inside > 0, F.struct("y", start.alias("x_start"), (start + inside).alias("x_end")))
    # A mask has no more runs than a picture has rows and breaks in them, so they go through the group as an array.
    per = both.groupBy(*FRAME, "track_id", "mask_id").agg(F.sum(inside).alias("wide"), F.sum(F.col("x_end") - F.col("x_start")).alias("area"), F.collect_list(cut).alias("cut"))
    good = valid(per.withColumn("inside_ratio", F.col("wide").cast("double") / F.greatest(F.lit(1), F.col("area"))), cfg)
    return good.select(*FRAME, "track_id", "mask_id", "inside_ratio", F.inline("cut")).select(*FRAME, "track_id", "mask_id", "y", "x_start", "x_end", "inside_ratio")


def court_overlap(runs: DataFrame, h: list[float], key: str = "mask_id", cfg: Config = DEFAULT, most: int = 2500) -> DataFrame:
    """Share of a systematic sample of each mask's pixels that lies on the court (every (n // most)-th pixel in row order), and the pixels
    that this stands for. `key` says what has a mask: mask_id or track_id."""
    n = F.col("x_end") - F.col("x_start")
    w = Window.partitionBy(*FRAME, key).orderBy("y", "x_start")
    rows = runs.withColumn("upto", F.sum(n).over(w)).withColumn("total", F.sum(n).over(Window.partitionBy(*FRAME, key)))
    step = F.greatest(F.lit(1), F.floor(F.col("total") / most))
    begin = F.col("upto") - n
    first = F.when(begin % F.col("step") == 0, begin).otherwise(begin + F.col("step") - begin % F.col("step"))
    rows = rows.withColumn("step", step).withColumn("at", first).where("at < upto")
    picked = rows.withColumn("k", F.explode(F.sequence("at", F.col("upto") - 1, "step")))
    px, py = project(F.col("x_start") + F.col("k") - begin, F.col("y"), h)
    on = (px >= 0) & (px < cfg.court_w) & (py >= 0) & (py < cfg.court_h)
    per = picked.groupBy(*FRAME, key).agg(F.count("*").alias("n_sampled"), F.count_if(on).alias("n_on"), F.first("total").alias("area"))
    return per.withColumn("overlap", F.col("n_on") / F.col("n_sampled")).withColumn("inside_area", F.bround(F.col("area") * F.col("overlap")).cast("long"))


def middle(runs: Column) -> Column:
    """The median x of the pixels of an array of runs (x_start, x_end): the mean of the two middle pixels, found among the runs' ends."""
    total = F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["x_end"] - r["x_start"])
    below = lambda x: F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + F.greatest(F.lit(0), F.least(r["x_end"], x) - r["x_start"]))
    ends = F.array_distinct(F.array_sort(F.concat(F.transform(runs, lambda r: r["x_start"]), F.transform(runs, lambda r: r["x_end"]))))
    marks = F.transform(ends, lambda x: F.struct(x.alias("x"), below(x).alias("n")))

    def pixel(k: Column) -> Column:
        """The k-th pixel's x: between two ends every x has the same number of runs."""
        left = F.element_at(F.filter(marks, lambda m: m["n"] <= k), -1)
        right = F.get(F.filter(marks, lambda m: m["n"] > k), F.lit(0))
        return left["x"] + F.floor((k - left["n"]) * (right["x"] - left["x"]) / (right["n"] - left["n"]))

    return (pixel(F.floor((total - 1) / 2)) + pixel(F.floor(total / 2))) / 2.0


def feet(runs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Foot point of each mask: of the pixels at or below the 88th percentile of y, the median x and the 96th percentile of y. Where that leaves under
    four pixels, those of the mask's last rows count (as far as 3 above the last).

    Runs are weighed by their lengths; only those at a mask's foot become an array."""
    key, y, n = [*FRAME, "mask_id"], F.col("y"), F.col("n")
    rows = runs.select(*key, "y", "x_start", "x_end", (F.col("x_end") - F.col("x_start")).alias("n")).where("n > 0").repartition(*key)
    ends = rows.groupBy(*key).agg(F.percentile("y", 0.88, n).alias("cut"), F.max("y").alias("last"))
    foot = rows.join(ends, key).withColumn("low", y >= F.col("cut")).withColumn("end", y >= F.greatest(F.col("last") - 3, F.lit(0))).where("low OR end")
    of = lambda c: (F.sum(F.when(F.col(c), n).otherwise(0)).alias(f"n_{c}"), F.percentile(F.when(F.col(c), y), 0.96, n).alias(f"y_{c}"), F.collect_list(F.when(F.col(c), F.struct("x_start", "x_end"))).alias(f"runs_{c}"))
    per = foot.groupBy(*key).agg(*of("low"), *of("end"))
    few = F.col("n_low") < 4
    pick = lambda c: F.when(few, F.col(f"{c}_end")).otherwise(F.col(f"{c}_low"))
    return per.select(*key, pick("n").alias("n"), middle(pick("runs")).alias("fx"), pick("y").alias("fy"))


def reusable(tracks: DataFrame, found: DataFrame, owners: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Players without a mask whose valid dominant mask belongs to a track that isn't in the frame and fills their box enough: that mask becomes
    theirs, and they are taken for its owner (an identity switch)."""
    players = tracks.where("NOT is_referee").select(*FRAME, "track_id")
    free = valid(found, cfg).where("NOT is_referee").join(owners.select(*FRAME, "track_id"), [*FRAME, "track_id"], "left_anti").where(F.col("fill") >= cfg.reuse_fill)
    held = owners.select(*FRAME, "mask_id", F.col("track_id").alias("owner_id"))
    idle = held.join(players.withColumnRenamed("track_id", "owner_id"), [*FRAME, "owner_id"], "left_anti")
    return free.join(idle, [*FRAME, "mask_id"]).select(*FRAME, "track_id", "mask_id", "owner_id", "fill")


def reuse_links(reused: DataFrame) -> DataFrame:
    """Reused masks as links of identity, as `lifecycle.apply_aliases` and counts of switches take them: the new track continues the mask's owner."""
    return reused.select("game_id", F.lit(False).alias("is_referee"), "frame_idx", F.lit("mask").alias("source_kind"), F.col("owner_id").alias("source_id"), F.col("track_id").alias("new_id"))


def missing_runs(tracks: DataFrame, owners: DataFrame) -> DataFrame:
    """For each track row how many of its rows in a row, up to this one, have had no mask."""
    rows = tracks.join(owners.select(*FRAME, "track_id", "mask_id"), [*FRAME, "track_id"], "left").withColumn("has", F.col("mask_id").isNotNull().cast("int"))
    w = Window.partitionBy(*TRACK).orderBy("frame_idx")
    rows = rows.withColumn("grp", F.sum("has").over(w))
    n = F.sum(1 - F.col("has")).over(Window.partitionBy(*TRACK, "grp").orderBy("frame_idx"))
    return rows.withColumn("n_missing", n).drop("grp", "has")


def iou_of_masks(runs: DataFrame) -> DataFrame:
    """Shared pixels of pairs of masks in a frame, row by row of the image."""
    both = renamed(runs, "a_", (*FRAME, "y")).join(shuffled(renamed(runs, "b_", (*FRAME, "y"))), [*FRAME, "y"]).where("a_mask_id < b_mask_id AND a_x_start < b_x_end AND b_x_start < a_x_end")
    return both.groupBy(*FRAME, "a_mask_id", "b_mask_id").agg(F.sum(F.least("a_x_end", "b_x_end") - F.greatest("a_x_start", "b_x_start")).alias("shared"))


def painted(runs: DataFrame, order: str = "mask_id") -> DataFrame:
    """The runs that stay visible when masks are painted over each other in `order`: a later mask covers what earlier ones have drawn, and what is left of
    these is cut into pieces. Adjacent pieces of one mask are one run.

    Work is by rows of the picture: the ends of a row's runs cut it into stretches, of which the last mask that covers one has it."""
    row = [*FRAME, "y"]
    per = runs.where("x_end > x_start").groupBy(*row).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "mask_id", "x_start", "x_end"))).alias("rs"))
    ends = F.array_sort(F.array_distinct(F.flatten(F.transform("rs", lambda r: F.array(r["x_start"], r["x_end"])))))
    top = lambda x: F.try_element_at(F.filter("rs", lambda r: (r["x_start"] <= x) & (x < r["x_end"])), F.lit(-1))["mask_id"]
    cut = F.transform(F.slice("ends", F.lit(1), F.size("ends") - 1), lambda x, i: F.struct(x.alias("x_start"), F.get("ends", i + 1).alias("x_end"), top(x).alias("mask_id")))
    pieces = per.withColumn("ends", ends).withColumn("ps", F.filter(cut, lambda p: p["mask_id"].isNotNull()))

    def join(done: Column, p: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        goes_on = F.coalesce((last["mask_id"] == p["mask_id"]) & (last["x_end"] == p["x_start"]), F.lit(False))
        longer = F.struct(last["x_start"].alias("x_start"), p["x_end"].alias("x_end"), p["mask_id"].alias("mask_id"))
        return F.when(goes_on, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(p)))

    whole = F.aggregate("ps", F.filter("ps", lambda _: F.lit(False)), join)
    return pieces.select(*row, F.inline(whole)).select(*FRAME, "mask_id", "y", "x_start", "x_end")


def requests(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """When masks are asked for anew: (frame_idx, has_mask, blocked) of each track to the same with `missing`, `cooldown`, `waiting` and
    `request`. A track without a mask for some frames asks; while another stands in its way it waits, from the first such frame on; after
    asking it rests for some frames. A frame without the track ends its count and its waiting.

    A fold's array is a track's rows in a game."""
    seq = F.array_sort(F.collect_list(F.struct("frame_idx", "has_mask", "blocked")))
    item = lambda f, m, c, w, r: F.struct(f.alias("frame_idx"), m.alias("missing"), c.alias("cooldown"), w.alias("waiting"), r.alias("request"))

    def add(last: Column, p: Column) -> Column:
        passed = p["frame_idx"] - last["frame_idx"]
        cool, there = F.greatest(F.lit(0), last["cooldown"] - passed.cast("int")), passed == 1
        counted, waited = F.when(there, last["missing"]).otherwise(0), F.when(there, last["waiting"])
        has, rest = p["has_mask"], cool > 0
        missing = F.when(has, 0).when(rest, counted).otherwise(counted + 1)
        due = ~has & ~rest & (missing >= cfg.reinit_missing)
        ask = due & ~p["blocked"]
        waiting = F.when(has | ask, F.lit(None)).when(due, F.coalesce(waited, p["frame_idx"])).otherwise(waited)
        return item(p["frame_idx"], missing, F.when(ask, cfg.reinit_cooldown).otherwise(cool), waiting, ask)

    first = lambda p: item(p["frame_idx"], F.when(p["has_mask"], 0).otherwise(1), F.lit(0), F.lit(None).cast("long"), F.lit(False))
    return rows.groupBy(*TRACK).agg(seq.alias("s")).select(*TRACK, F.inline(running(F.col("s"), first, add)))


def cut_failures(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """How often in a row a track's mask failed to be cut to its box, and when that asks for a new one: (frame_idx, has_mask, wide, inside_ratio)
    of each track to (frame_idx, fails, cooldown, reinit).

    Too small a mask asks after some failures, one mostly outside after more of them and only where hardly any of it is inside; then it
    rests. Frames without a mask change nothing."""
    seq = F.array_sort(F.collect_list(F.struct("frame_idx", "has_mask", "wide", "inside_ratio")))
    item = lambda f, n, c, r: F.struct(f.alias("frame_idx"), n.cast("long").alias("fails"), c.cast("long").alias("cooldown"), r.alias("reinit"))

    def add(last: Column, p: Column) -> Column:
        cool = F.greatest(F.lit(0), last["cooldown"] - (p["frame_idx"] - last["frame_idx"]))
        small = p["wide"] < cfg.mask_area
        fails = p["has_mask"] & (small | (p["inside_ratio"] < cfg.mask_inside))
        n = F.when(~p["has_mask"], last["fails"]).when(fails, last["fails"] + 1).otherwise(0)
        due = fails & ((small & (n >= cfg.reinit_area)) | (~small & (p["inside_ratio"] <= cfg.reinit_ratio) & (n >= cfg.reinit_inside))) & (cool == 0)
        return item(p["frame_idx"], F.when(due, 0).otherwise(n), F.when(due, cfg.reinit_cooldown).otherwise(cool), due)

    start = lambda p: add(item(p["frame_idx"] - 1, F.lit(0), F.lit(0), F.lit(False)), p)
    return rows.groupBy(*TRACK).agg(seq.alias("s")).select(*TRACK, F.inline(running(F.col("s"), start, add)))
