"""Expressions on hand-computed rows, and properties of operators on random ones."""

from pyspark.sql import functions as F

from trackweave.config import Config
from trackweave.functions import geometry as G
from trackweave.functions import text as X
from trackweave.operators import lifecycle, masks, report
from trackweave.sources import scans


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_clean_number(spark):
    reads = {"O7": "07", "l2": "12", "Z": "2", "S s": "55", "B8": "88", "abc": None, "": None, "12345": "12", "#2|3": "21", "٣4": "4"}
    rows = spark.createDataFrame(list(reads.items()), "t string, n string")
    assert [(r.n, r.got) for r in rows.withColumn("got", X.clean_number(F.col("t"))).collect() if r.n != r.got] == []


def test_class_of(spark):
    names = [("Player-shooting", 5, 3), ("ball player", 1, 3), ("refs", 1, 8), ("number", 2, 2), ("Hoop", None, 9), ("my ball", None, 0), ("RIM", 1, 9), ("ball-number", 4, 0), ("coach", 6, 6), ("coach", None, 99), (None, 4, 4)]
    rows = spark.createDataFrame(names, "name string, raw int, want int")
    assert all(r.want == r.got for r in rows.withColumn("got", X.class_of(F.col("name"), F.col("raw"))).collect())


def test_labels(spark):
    assert one(spark, *(X.keypoint_label(F.lit(s)) for s in ("k1", "12", "a123", "none"))) == ("01", "12", "123", None)
    assert one(spark, *(X.confidence_of(F.lit(a), F.lit(b)) for a, b in (("0.5", None), ("x", "0.7")))) == (0.5, 0.0)
    assert one(spark, X.display_label(F.lit(7), F.lit("12"), F.lit(False)), X.display_label(F.lit(7), F.lit(None).cast("string"), F.lit(False)), X.display_label(F.lit(7), F.lit("12"), F.lit(True))) == ("#12", "7", "REF")


def test_boxes(spark):
    b = lambda *v: tuple(F.lit(x) for x in v)
    assert one(spark, G.iou(b(0, 0, 10, 10), b(5, 0, 15, 10)), G.iou(b(0, 0, 10, 10), b(10, 0, 20, 10)), G.iou_tlwh(b(0, 0, 0, 0), b(0, 0, 0, 0))) == (50 / 150, 0.0, 0.0)
    assert one(spark, *G.tlwh_to_corners(*(F.lit(v) for v in (0.5, 1.5, 2.0, 2.0)))) == (0, 2, 2, 4)
    assert one(spark, *G.expand(b(0, 0, 100, 50), 0.2, 105, 52)) == (0, 0, 105, 52)
    assert one(spark, *G.foot(b(0, 10, 20, 11))) == (10.0, 10) and one(spark, G.clamp(F.lit(2.5), 10), G.clamp(F.lit(-3.0), 10), G.clamp(F.lit(99.0), 10)) == (2, 0, 9)
    assert one(spark, *G.corners_from_center(*(F.lit(v) for v in (1.0, -1.0, 3.0, 3.0)))) == (0, -2, 2, 0)


def test_lifetimes_by_index(spark):
    """Upper median and 90th are picked by index; a role without removals has zeros."""
    rows = [(0, False, k, 100, "removed", n) for k, n in enumerate((4, 1, 3, 2))] + [(0, True, 1, 0, "new", 0)]
    out = {r.is_referee: r for r in lifecycle.lifetimes(spark.createDataFrame(rows, "game_id int, is_referee boolean, track_id long, frame_idx long, kind string, n long")).collect()}
    assert (out[False].mean_life, out[False].median_life, out[False].p90_life) == (2.5, 3, 4) and (out[True].n_removed, out[True].median_life) == (0, 0)


def test_ambiguous_switch(spark):
    """No link where the runner-up is about as near; a link where it isn't."""
    row = lambda f, t, x: (0, f, t, False, x, 0, x + 60, 150)
    schema = "game_id int, frame_idx long, track_id long, is_referee boolean, x1 long, y1 long, x2 long, y2 long"
    near = spark.createDataFrame([row(0, 1, 100), row(0, 2, 110), row(5, 3, 104)], schema)
    far = spark.createDataFrame([row(0, 1, 100), row(0, 2, 150), row(5, 3, 104)], schema)
    assert lifecycle.switch_links(near).count() == 0
    (link,) = lifecycle.switch_links(far).collect()
    assert (link.source_id, link.new_id, link.dt, link.dist) == (1, 3, 4, 4.0)
    stable = {(r.frame_idx, r.track_id): r.stable_id for r in lifecycle.apply_aliases(far, lifecycle.switch_links(far)).collect()}
    assert stable == {(0, 1): 1, (0, 2): 2, (5, 3): 1}


def test_islands(spark):
    """Totals count repeats, runs don't; the earliest of equal runs wins; null ids are kept."""
    rows = [(0, f, None, 1) for f in (1, 2, 2, 5, 6)] + [(0, f, 7, 1) for f in range(10, 15)]
    out = {r.dropped_id: r for r in report.islands(spark.createDataFrame(rows, "game_id int, frame_idx long, dropped_id long, kept_id long"), every=True).collect()}
    assert (out[None].total, out[None].longest_run, out[None].run_start) == (5, 2, 1) and (out[7].longest_run, out[7].run_start) == (5, 10)
    assert [r.dropped_id for r in report.islands(spark.createDataFrame(rows, "game_id int, frame_idx long, dropped_id long, kept_id long")).collect()] == [7]


def test_mask_ties(spark):
    runs = spark.createDataFrame([(0, 0, 5, 1, 0, 10), (0, 0, 2, 2, 0, 10), (0, 0, 9, 3, 0, 3)], "game_id int, frame_idx long, mask_id long, y long, x_start long, x_end long")
    track = spark.createDataFrame([(0, 0, False, 1, 0, 0, 10, 10)], "game_id int, frame_idx long, is_referee boolean, track_id long, x1 long, y1 long, x2 long, y2 long")
    (r,) = masks.dominant(track, runs).collect()
    assert (r.mask_id, r.inside, r.area, r.fill) == (2, 10, 10, 0.1)
    (c,) = [r for r in masks.sizes(runs).collect() if r.mask_id == 9]
    assert (c.area, c.cx, c.cy) == (3, 1, 3)


def test_frames(spark):
    src = spark.range(20).withColumnRenamed("id", "src_idx")
    assert [(r.src_idx, r.frame_idx) for r in scans.frames(src, 3, 3, 2).orderBy("src_idx").collect()] == [(3, 0), (5, 1), (7, 2)]
    assert scans.frames(src).count() == 20 and scans.seconds_to_frame(0.8, 30) == 24


def test_unreadable_keypoints(spark):
    rows = [(0, 0, "{bad"), (0, 1, '{"keypoints":[{"x":1,"y":2},{"x":0,"y":0,"conf":0.5}]}'), (0, 2, '{"predictions":[]}')]
    got = [(r.frame_idx, r.instance, r.kp_idx, r.x, r.conf) for r in scans.nested_keypoints(spark.createDataFrame(rows, "game_id int, frame_idx long, json string")).collect()]
    assert got == [(1, 0, 0, 1.0, 1.0), (1, 0, 1, None, 0.5)]


def test_empty_tables(spark):
    tracks = spark.createDataFrame([], "game_id int, frame_idx long, track_id long, obs_id long, is_referee boolean, x1 long, y1 long, x2 long, y2 long, confidence double")
    for f in (lifecycle.births, lifecycle.edges, lifecycle.switch_links, lifecycle.switches, lifecycle.changes, lifecycle.active_and_lost):
        assert f(tracks).count() == 0
    assert lifecycle.id_diagnostics(lifecycle.apply_aliases(tracks, lifecycle.switch_links(tracks))).count() == 0


def test_reused_masks_are_links(spark):
    """A track that takes over a mask continues its owner from that frame on, until another link."""
    reused = spark.createDataFrame([(0, 5, 9, 1, 3, 0.5)], "game_id int, frame_idx long, track_id long, mask_id long, owner_id long, fill double")
    row = lambda f, t: (0, f, t, False, 0, 0, 10, 10)
    tracks = spark.createDataFrame([row(4, 9), row(5, 9), row(8, 9), row(8, 2)], "game_id int, frame_idx long, track_id long, is_referee boolean, x1 long, y1 long, x2 long, y2 long")
    again = spark.createDataFrame([(0, False, 7, "lost", 4, 9)], "game_id int, is_referee boolean, frame_idx long, source_kind string, source_id long, new_id long")
    got = {(r.frame_idx, r.track_id): r.stable_id for r in lifecycle.apply_aliases(tracks, masks.reuse_links(reused).unionByName(again)).collect()}
    assert got == {(4, 9): 9, (5, 9): 3, (8, 9): 4, (8, 2): 2}


def test_template(spark):
    from trackweave.sources import court_template as C

    assert len(C.TEMPLATE) == 33 and len(C.old_template()) == 18
    new = {old: (tx, ty) for _, tx, ty, old in C.TEMPLATE if old >= 0}
    assert sorted(new) == list(range(18))
    assert all(abs(a - b) <= 2 for k, p in enumerate(C.old_template()) for a, b in zip(p, new[k]))


def test_colors(spark):
    """As the usual conversion of hue, saturation and value gives, cut to whole numbers."""
    import colorsys

    got = spark.range(130).select("id", X.color(F.col("id")).alias("c")).collect()
    for r in got:
        red, green, blue = (int(v * 255) for v in colorsys.hsv_to_rgb((r.id % 60) * 0.618033988749895 % 1.0, 0.85, 0.95))
        assert r.c == red * 65536 + green * 256 + blue, r


def test_projection_choice(spark):
    """Each branch: inside, outside with and without a relative point, no homography, nothing at all."""
    rows = [(1, 100.0, 100.0, 50.0, 50.0), (2, 310.0, -20.0, None, None), (3, 400.0, 50.0, 100.0, 100.0), (4, 400.0, 50.0, None, None), (5, None, None, 7.0, 8.0), (6, None, None, None, None)]
    p = spark.createDataFrame(rows, "id int, hx double, hy double, rx double, ry double")
    pair = lambda k: F.when(F.col(f"{k}x").isNotNull(), F.struct(F.col(f"{k}x").alias("x"), F.col(f"{k}y").alias("y")))
    got = {r.id: r.c and (round(r.c.x, 6), round(r.c.y, 6), r.c.source) for r in p.select("id", G.choose_projection(pair("r"), pair("h")).alias("c")).collect()}
    assert got == {1: (100.0, 100.0, "H"), 2: (299.0, 0.0, "H"), 3: (129.85, 92.5, "relative-guard"), 4: None, 5: (7.0, 8.0, "relative"), 6: None}


def test_old_homography_puts_off(spark):
    """A player without a mask isn't activated under a stale homography; one with a mask on the court is; referees always are."""
    from trackweave.operators import tactical

    rows = [(0, f, ref, t, n) for f, ref, t, n in ((0, False, 1, 5), (1, False, 1, 5), (2, False, 1, 0), (0, False, 2, 0), (1, False, 2, 0), (0, True, 3, 0))]
    counted = spark.createDataFrame(rows, "game_id int, frame_idx long, is_referee boolean, track_id long, n_inside int")
    masked = spark.createDataFrame([(0, 0, 2, 0.2, 50)], "game_id int, frame_idx long, track_id long, overlap double, inside_area long")
    stale = spark.createDataFrame([(0, 0)], "game_id int, frame_idx long")
    got = {(r.frame_idx, r.track_id): r.active for r in tactical.activated(counted, masked, stale).collect()}
    assert got == {(0, 1): False, (1, 1): True, (2, 1): True, (0, 2): True, (1, 2): True, (0, 3): True}


def test_painted(spark):
    """Random overlapping runs, painted in order over an array."""
    import numpy as np

    draw, rows = np.random.default_rng(4), []
    for f in range(40):
        for mask in range(int(draw.integers(1, 6))):
            for y in range(4):
                a = int(draw.integers(0, 20))
                rows.append((0, f, mask, y, a, a + int(draw.integers(0, 9))))
    frame = spark.createDataFrame(rows, "game_id int, frame_idx long, mask_id long, y long, x_start long, x_end long")
    image = np.full((40, 4, 30), -1)
    for _, f, mask, y, a, b in sorted(rows, key=lambda r: r[2]):
        image[f, y, a:b] = mask
    got, runs = np.full_like(image, -1), masks.painted(frame).collect()
    for r in runs:
        assert (got[r.frame_idx, r.y, r.x_start : r.x_end] == -1).all() and r.x_start < r.x_end
        got[r.frame_idx, r.y, r.x_start : r.x_end] = r.mask_id
    assert (got == image).all()
    ends = {(r.frame_idx, r.y, r.mask_id, r.x_end) for r in runs}
    assert not any((r.frame_idx, r.y, r.mask_id, r.x_start) in ends for r in runs)
    assert masks.painted(frame.limit(0)).collect() == []


def test_keypoint_containers(spark):
    """Odd containers and fields: nothing that can be read is lost, and nothing odd costs another point."""
    points = '[{"x": 1, "y": "2.5"}, {"x": 3}, {"x": 0, "y": 0, "conf": 0.4}, {"class_id": "7", "x": 5, "y": 6, "confidence": "bad"}, {"class": "abc", "keypoint_id": 9, "x": 7, "y": 8, "confidence": null, "conf": 0.2}]'
    want = [(0, 1.0, 2.5, 1.0), (2, None, None, 0.4), (7, 5.0, 6.0, 0.0), (9, 7.0, 8.0, 0.2)]
    forms = [
        f'{{"predictions": [{{"keypoints": {points}}}]}}', f'[{{"predictions": {{"items": [{{"keypoints": {{"items": {points}}}}}]}}}}, {{"predictions": []}}]', f'{{"predictions": {{"keypoints": {{"keypoints": {points}}}}}}}',
        f'{{"keypoints": {{"predictions": {points}}}}}', f'{{"predictions": {{"predictions": [{{"keypoints": {points}}}], "items": 3}}}}', f'{{"predictions": [], "keypoints": {points}}}',
    ]
    values = '{"predictions": [{"keypoints": {"z": {"x": 1, "y": 2}, "a": {"x": 3, "y": 4}, "m": 5}}]}'
    none = [None, "", "x", "[]", "{}", "7", '{"predictions": null}', '{"predictions": [{"keypoints": null}, {}]}', '{"predictions": 5}']
    rows = [(0, k, t) for k, t in enumerate([*forms, values, *none])]
    got = {}
    for r in scans.nested_keypoints(spark.createDataFrame(rows, "game_id int, frame_idx long, json string")).collect():
        got.setdefault(r.frame_idx, []).append((r.kp_idx, r.x, r.y, r.conf))
    assert [sorted(got.get(k, []), key=str) for k in range(len(forms))] == [sorted(want, key=str)] * len(forms)
    assert sorted(got[len(forms)]) == [(0, 1.0, 2.0, 1.0), (1, 3.0, 4.0, 1.0)] and len(got) == len(forms) + 1


def test_switch_rules(spark):
    """A removed track that lived too briefly, or that still had a mask, is no source."""
    cfg = Config(buffer=3, switch_dt=3, source_life=10)
    track = lambda t, frames, x: [(0, f, False, t, x, 0, x + 10, 20) for f in frames]
    rows = track(1, range(0, 8), 0) + track(2, [14], 2) + track(3, range(0, 5), 300) + track(4, [11], 302) + track(5, range(0, 8), 600) + track(6, [14], 602)
    t = spark.createDataFrame(rows, "game_id int, frame_idx long, is_referee boolean, track_id long, x1 long, y1 long, x2 long, y2 long")
    links = lambda holding=None: {(r.source_kind, r.source_id, r.new_id) for r in lifecycle.switch_links(t, cfg, holding).collect()}
    held = spark.createDataFrame([(0, False, 5, 11)], "game_id int, is_referee boolean, track_id long, frame_idx long")
    assert links() == {("rm", 1, 2), ("rm", 5, 6)} and links(held) == {("rm", 1, 2)}
