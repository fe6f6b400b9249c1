"""Driver tables as the tables of the tracking domain: detections, tracks, text reads, keypoints, views of a court, masks, points.

The formulas are integer arithmetic on `events` and `embeddings`; `SQL` has the same as DuckDB common table expressions. Each run of
`GAME_FRAMES` frames is a game of its own; frame numbers go on across games, so a frame number belongs to one game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackweave.sources.court_template import TEMPLATE

GAME_FRAMES = 400


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def game_of(frame: Column) -> Column:
    return F.floor(frame / GAME_FRAMES).cast("int").alias("game_id")


def of_event() -> tuple[Column, Column]:
    """Game and frame of an event: ten events are a frame."""
    frame = F.floor(F.col("event_id") / 10)
    return game_of(frame), frame.alias("frame_idx")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game_id, frame_idx of every frame, dealt to all partitions: each frame becomes many rows, and what follows works by frames."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return events(spark, sf_dir).where("event_id % 10 = 0").select(*of_event()).repartition(parts, "game_id", "frame_idx")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game_id, frame_idx, det_id, x1, y1, x2, y2, class_id, confidence."""
    e = events(spark, sf_dir).select("event_id", "user_id", "event_type")
    x1 = (F.col("user_id") % 3) * 200 + (F.col("event_id") * 7) % 40
    y1 = F.lit(100) + (F.col("event_id") * 11) % 30
    kind = F.when(F.col("event_type") == "signup", 8).when(F.col("event_type") == "error", 2).otherwise(3)
    base = e.select(*of_event(), F.col("event_id").alias("det_id"), x1.alias("x1"), y1.alias("y1"), "user_id", kind.alias("class_id"), (((F.col("event_id") * 13) % 100).cast("double") / 100).alias("confidence"))
    return base.select("game_id", "frame_idx", "det_id", "x1", "y1", (F.col("x1") + 60 + F.col("user_id") % 20).alias("x2"), (F.col("y1") + 150 + F.col("user_id") % 30).alias("y2"), "class_id", "confidence")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game_id, frame_idx, track_id, is_referee, obs_id, boxes and confidence; one row for each frame and track id."""
    e = events(spark, sf_dir).where("event_type <> 'error'").select("event_id", "user_id", "event_type")
    t = F.col("user_id") % 150
    base = e.select(
        *of_event(), t.alias("track_id"), F.col("event_id").alias("obs_id"),
        ((F.col("user_id") * 53) % 1100 + (F.col("event_id") * 7) % 40).alias("x1"), ((F.col("user_id") * 29) % 500 + (F.col("event_id") * 11) % 30).alias("y1"),
        (F.col("event_type") == "signup").alias("is_referee"), (((F.col("event_id") * 13) % 100).cast("double") / 100).alias("confidence"),
    )
    first = F.row_number().over(Window.partitionBy("game_id", "frame_idx", "track_id").orderBy("obs_id"))
    return base.withColumn("_n", first).where("_n = 1").drop("_n").withColumn("x2", F.col("x1") + 60 + F.col("track_id") % 20).withColumn("y2", F.col("y1") + 150 + F.col("track_id") % 30)


def crowd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks, moved to two places of the image, so that boxes of a frame overlap as much as all rules of overlap ask for."""
    t = tracks(spark, sf_dir)
    x1 = (F.col("track_id") % 2) * 150 + (F.col("obs_id") * 7) % 23
    y1 = F.lit(100) + (F.col("obs_id") * 11) % 17
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return t.withColumn("w", wide).withColumn("h", high).withColumn("x1", x1).withColumn("y1", y1).withColumn("x2", F.col("x1") + F.col("w")).withColumn("y2", F.col("y1") + F.col("h")).drop("w", "h")


def ocr_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game_id, frame_idx, det_id, track_id, text, conf."""
    e = events(spark, sf_dir).where("event_type IN ('error', 'signup')")
    text = F.concat(F.substring("event_type", 1, 2), F.regexp_extract("props", "([0-9]+)", 1))
    return e.select(*of_event(), F.col("event_id").alias("det_id"), (F.col("user_id") % 150).alias("track_id"), text.alias("text"), (((F.col("event_id") * 17) % 100).cast("double") / 100).alias("conf"))


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game_id, frame_idx, kp_idx, x, y, conf: 32 points of each vector, without order in the image."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.element_at("embedding", 2 * i + 1).alias("a"), F.element_at("embedding", 2 * i + 2).alias("b")))).alias("kp_idx", "p"))
    at = lambda c, k: F.floor(F.abs(F.col(c).cast("double")) * k)
    return v.select(game_of(F.col("vec_id")), F.col("vec_id").alias("frame_idx"), "kp_idx", at("p.a", 4000).alias("x"), at("p.b", 3000).alias("y"), (((F.col("vec_id") * 31 + F.col("kp_idx") * 17) % 100).cast("double") / 100).alias("conf"))


def template(spark: SparkSession) -> DataFrame:
    """kp_idx, label, tx, ty, legacy_idx of the court's 33 keypoints: a constant table."""
    return spark.createDataFrame([(k, *row) for k, row in enumerate(TEMPLATE)], "kp_idx int, label string, tx long, ty long, legacy_idx long")


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game_id, frame_idx, kp_idx, x, y, conf: a court seen by a panning camera that changes sides every 60 frames, in every frame of every game.

    Points are missing, far off or unsure by turns; two hang still at the frame's edge for 60 frames of 150; in some frames hardly any
    point is seen. x and y are NULL where a point is missing."""
    f, i = F.col("frame_idx"), F.col("kp_idx")
    side = F.floor(f / 60) % 2
    left = side * 130 + F.abs(f % 40 - 20)
    x = (F.col("tx") - left) * 7 + F.when(side == 0, -1).otherwise(1) * (F.col("ty") - 80) + (f * 7 + i * 13) % 5 - 2 + F.when((f * 3 + i * 7) % 41 == 0, 200).otherwise(0)
    y = F.lit(60) + 4 * F.col("ty") + (f * 11 + i * 5) % 5 - 2
    still = i.isin(12, 14) & (f % 150).between(20, 79)
    gone = ((f * 5 + i * 3) % 17 == 0) & ~still | (f % 97 >= 90) & (i % 11 != 0)
    rows = frames(spark, sf_dir).select("*", F.inline(F.array(*(F.struct(F.lit(k).alias("kp_idx"), F.lit(tx).alias("tx"), F.lit(ty).alias("ty")) for k, (_, tx, ty, _) in enumerate(TEMPLATE)))))
    seen = lambda v, held: F.when(~gone, F.when(still, F.lit(held)).otherwise(v)).cast("long")
    return rows.select("game_id", "frame_idx", "kp_idx", seen(x, 300).alias("x"), seen(y, 60).alias("y"), (((f * 31 + i * 17) % 100).cast("double") / 100).alias("conf"))


def mask_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game_id, frame_idx, mask_id, y, x_start, x_end: masks of a fifth of the crowd that fill most of their boxes, and of a fifteenth that
    are a few pixels."""
    t = crowd(spark, sf_dir).where("NOT is_referee")
    full = F.when(F.col("obs_id") % 5 == 0, F.sequence(F.col("y1"), F.col("y2") - 1))
    tiny = F.when((F.col("obs_id") % 5 == 1) & (F.col("obs_id") % 3 == 0), F.array(F.col("y1") + 5, F.col("y1") + 7))
    rows = t.select("game_id", "frame_idx", "obs_id", "x1", "x2", F.explode(F.coalesce(full, tiny)).alias("y"))
    large = F.col("obs_id") % 5 == 0
    start, end = F.when(large, F.col("x1") + 3 + F.col("y") % 4).otherwise(F.col("x1") + 9), F.when(large, F.col("x2") - 5).otherwise(F.col("x1") + 10 + F.col("y") % 2)
    return rows.select("game_id", "frame_idx", (F.col("obs_id") % 1000 + 1).alias("mask_id"), "y", start.alias("x_start"), end.alias("x_end"))


def place_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game_id, frame_idx, mask_id, y, x_start, x_end: two masks at each of the detections' three places, each drawn for some 40 to 70 frames under
    one id. By turns a mask is missing for a few frames, or drawn beside its place for a dozen."""
    f, p, q = F.col("frame_idx"), F.col("p"), F.col("q")
    kinds = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in range(3) for q in range(2)))
    rows = frames(spark, sf_dir).select("*", F.inline(kinds)).where((f + p * 13 + q * 5) % 50 >= 6)
    mask = F.floor(f / (40 + p * 10 + q * 7)) * 6 + p * 2 + q + 1
    left = p * 200 + q * 52 + 10 + F.when((F.floor(f / 12) + p + q) % 9 == 3, 110).otherwise(0)
    wide, y = F.when(q == 0, 50).otherwise(38), F.explode(F.sequence(110 + q * 10, 239 - q * 20)).alias("y")
    rows = rows.select("game_id", "frame_idx", mask.alias("mask_id"), left.alias("left"), wide.alias("wide"), y)
    return rows.select("game_id", "frame_idx", "mask_id", "y", (F.col("left") + F.col("y") % 3).cast("long").alias("x_start"), (F.col("left") + F.col("wide")).cast("long").alias("x_end"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game_id, point_id, x, y on the image."""
    return events(spark, sf_dir).select(of_event()[0], F.col("event_id").alias("point_id"), ((F.col("event_id") * 7) % 1280).alias("x"), ((F.col("event_id") * 11) % 720).alias("y"))


_TPL = ", ".join(f"({k}, '{label}', {tx}, {ty}, {old})" for k, (label, tx, ty, old) in enumerate(TEMPLATE))
#: The same tables for DuckDB; a query's SQL is `WITH` those of these that it names, and its own.
SQL = {
    "det": """SELECT game_id, frame_idx, det_id, x1, y1, x1 + 60 + user_id % 20 AS x2, y1 + 150 + user_id % 30 AS y2, class_id, confidence FROM (
  SELECT event_id // 4000 AS game_id, event_id // 10 AS frame_idx, event_id AS det_id, (user_id % 3) * 200 + (event_id * 7) % 40 AS x1, 100 + (event_id * 11) % 30 AS y1, user_id,
  CASE event_type WHEN 'signup' THEN 8 WHEN 'error' THEN 2 ELSE 3 END AS class_id, CAST((event_id * 13) % 100 AS DOUBLE) / 100 AS confidence FROM events)""",
    "trk": """SELECT *, x1 + 60 + track_id % 20 AS x2, y1 + 150 + track_id % 30 AS y2 FROM (
  SELECT event_id // 4000 AS game_id, event_id // 10 AS frame_idx, user_id % 150 AS track_id, event_id AS obs_id, (user_id * 53) % 1100 + (event_id * 7) % 40 AS x1,
  (user_id * 29) % 500 + (event_id * 11) % 30 AS y1, event_type = 'signup' AS is_referee, CAST((event_id * 13) % 100 AS DOUBLE) / 100 AS confidence
  FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY event_id // 10, user_id % 150 ORDER BY event_id) = 1)""",
    "crw": """SELECT game_id, frame_idx, track_id, obs_id, is_referee, confidence, nx AS x1, ny AS y1, nx + x2 - x1 AS x2, ny + y2 - y1 AS y2
  FROM (SELECT *, (track_id % 2) * 150 + (obs_id * 7) % 23 AS nx, 100 + (obs_id * 11) % 17 AS ny FROM trk)""",
    "ocr": """SELECT event_id // 4000 AS game_id, event_id // 10 AS frame_idx, event_id AS det_id, user_id % 150 AS track_id,
  concat(substring(event_type, 1, 2), regexp_extract(props, '([0-9]+)', 1)) AS text, CAST((event_id * 17) % 100 AS DOUBLE) / 100 AS conf FROM events WHERE event_type IN ('error', 'signup')""",
    "kp": """SELECT vec_id // 400 AS game_id, vec_id AS frame_idx, i AS kp_idx, CAST(floor(abs(CAST(embedding[2 * i + 1] AS DOUBLE)) * 4000) AS BIGINT) AS x,
  CAST(floor(abs(CAST(embedding[2 * i + 2] AS DOUBLE)) * 3000) AS BIGINT) AS y, CAST((vec_id * 31 + i * 17) % 100 AS DOUBLE) / 100 AS conf FROM embeddings, (SELECT unnest(range(32)) AS i)""",
    "tpl": f"SELECT CAST(kp_idx AS BIGINT) AS kp_idx, label, CAST(tx AS BIGINT) AS tx, CAST(ty AS BIGINT) AS ty, CAST(legacy_idx AS BIGINT) AS legacy_idx FROM (VALUES {_TPL}) v(kp_idx, label, tx, ty, legacy_idx)",
    "vw": """SELECT game_id, f AS frame_idx, i AS kp_idx, CASE WHEN NOT gone THEN CASE WHEN still THEN 300 ELSE x END END AS x, CASE WHEN NOT gone THEN CASE WHEN still THEN 60 ELSE y END END AS y,
  CAST((f * 31 + i * 17) % 100 AS DOUBLE) / 100 AS conf FROM (SELECT *, ((f * 5 + i * 3) % 17 = 0 AND NOT still) OR (f % 97 >= 90 AND i % 11 <> 0) AS gone FROM (
  SELECT game_id, f, i, i IN (12, 14) AND f % 150 BETWEEN 20 AND 79 AS still,
  (tx - side * 130 - abs(f % 40 - 20)) * 7 + (CASE side WHEN 0 THEN -1 ELSE 1 END) * (ty - 80) + (f * 7 + i * 13) % 5 - 2 + CASE WHEN (f * 3 + i * 7) % 41 = 0 THEN 200 ELSE 0 END AS x,
  60 + 4 * ty + (f * 11 + i * 5) % 5 - 2 AS y FROM (SELECT e.f // 400 AS game_id, e.f, kp_idx AS i, tx, ty, (e.f // 60) % 2 AS side FROM (SELECT event_id // 10 AS f FROM events WHERE event_id % 10 = 0) e, tpl)))""",
    "mr": """SELECT game_id, frame_idx, obs_id % 1000 + 1 AS mask_id, y, CASE WHEN obs_id % 5 = 0 THEN x1 + 3 + y % 4 ELSE x1 + 9 END AS x_start, CASE WHEN obs_id % 5 = 0 THEN x2 - 5 ELSE x1 + 10 + y % 2 END AS x_end
  FROM (SELECT *, unnest(CASE WHEN obs_id % 5 = 0 THEN range(y1, y2) ELSE [y1 + 5, y1 + 7] END) AS y FROM crw WHERE NOT is_referee AND (obs_id % 5 = 0 OR (obs_id % 5 = 1 AND obs_id % 3 = 0)))""",
    "pts": "SELECT event_id // 4000 AS game_id, event_id AS point_id, (event_id * 7) % 1280 AS x, (event_id * 11) % 720 AS y FROM events",
}
#: Tables that a table is made of.
NEEDS = {"crw": ("trk",), "vw": ("tpl",), "mr": ("trk", "crw")}
