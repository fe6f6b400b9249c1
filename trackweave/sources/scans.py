"""Scans of raw model output: frames with seek, limit and skip; boxes in either form; nested keypoint results; log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions.geometry import corners_from_center


def frames(source: DataFrame, start: int = 0, limit: int | None = None, skip: int = 1) -> DataFrame:
    """Source frames from `start`, each skip-th, at most `limit` of them: src_idx, and frame_idx from 0. The limit counts frames read."""
    at = F.col("src_idx") - start
    out = source.where((at >= 0) & (at % skip == 0)).withColumn("frame_idx", F.floor(at / skip))
    return out if limit is None else out.where(F.col("frame_idx") < limit)


def seconds_to_frame(seconds: float, fps: float) -> int:
    return int(seconds * fps)


def decoded_boxes(raw: DataFrame) -> DataFrame:
    """Corner boxes of rows that have all corners, or else a centre and size; rows with neither are left out.

    Input columns x1..y2 and cx, cy, w, h may be null."""
    corners = F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull()
    made = corners_from_center(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    pick = [F.when(corners, F.col(c).cast("long")).otherwise(m).alias(c) for c, m in zip(("x1", "y1", "x2", "y2"), made)]
    return raw.select(*(c for c in raw.columns if c not in ("x1", "y1", "x2", "y2", "cx", "cy", "w", "h")), *pick).where("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL")


def as_list(text: Column) -> Column:
    """JSON of an array as its elements' JSON; NULL for anything else."""
    return F.when(F.startswith(F.ltrim(text), F.lit("[")), F.from_json(text, "array<string>"))


def as_map(text: Column) -> Column:
    """JSON of an object as its fields' JSON, in the order in which they are written; NULL for anything else."""
    return F.when(F.startswith(F.ltrim(text), F.lit("{")), F.from_json(text, "map<string,string>"))


def filled(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def predictions_of(result: Column) -> Column:
    """The predictions' JSON of a result, or of the first of several: a list, or an object that holds one under `predictions` or `items`, or that is the only
    prediction itself. A result without predictions that has keypoints is one prediction."""
    one = F.coalesce(F.get(as_list(result), F.lit(0)), result)
    field = as_map(one)["predictions"]
    inner = as_map(field)
    nested = F.coalesce(filled(as_list(inner["predictions"])), filled(as_list(inner["items"])))
    single = F.when(inner.isNotNull(), F.array(field))
    alone = F.when(as_map(one)["keypoints"].isNotNull(), F.array(one))
    return F.coalesce(filled(as_list(field)), nested, single, alone)


def points_of(prediction: Column) -> Column:
    """The keypoints' JSON of a prediction: a list, or an object that holds one under `items`, `predictions` or `keypoints`, or whose values they are."""
    field = as_map(prediction)["keypoints"]
    inner = as_map(field)
    return F.coalesce(as_list(field), *(as_list(inner[k]) for k in ("items", "predictions", "keypoints")), F.map_values(inner))


def nested_keypoints(raw: DataFrame, column: str = "json") -> DataFrame:
    """Keypoints of JSON results, whatever holds them: instance, index (its own, or else its position), place (NULL where both are 0) and confidence (1 where
    none is given, 0 where it isn't a number). Points without both coordinates and unreadable results give no rows.

    Fields are read from a VARIANT, so a number may come as a string and one odd field costs no other."""
    per = raw.select("game_id", "frame_idx", F.posexplode(predictions_of(F.col(column))).alias("instance", "p"))
    points = per.select("game_id", "frame_idx", "instance", F.posexplode(points_of(F.col("p"))).alias("position", "k"))
    points = points.withColumn("v", F.try_parse_json("k"))
    number = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    sure = F.coalesce(number("confidence", "string"), number("conf", "string"))
    rows = points.select(
        "game_id", "frame_idx", "instance", F.coalesce(number("class_id", "int"), number("class", "int"), number("keypoint_id", "int"), F.col("position")).alias("kp_idx"),
        number("x", "double").alias("x"), number("y", "double").alias("y"), F.when(sure.isNull(), F.lit(1.0)).otherwise(F.coalesce(sure.try_cast("double"), F.lit(0.0))).alias("conf"),
    ).where("x IS NOT NULL AND y IS NOT NULL")
    there = (F.col("x") != 0) | (F.col("y") != 0)
    return rows.withColumns({"x": F.when(there, F.col("x")), "y": F.when(there, F.col("y"))})


def tagged_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Log lines with the tag in square brackets that they begin with, if any."""
    tag = F.regexp_extract(column, r"^\s*\[([A-Za-z:-]+)", 1)
    return lines.withColumn("tag", F.when(tag == "", F.lit(None)).otherwise(tag))


def starts_with_any(line: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a line, without blanks before it, begins with any of the prefixes."""
    out, bare = F.lit(False), F.regexp_replace(line, r"^\s+", "")
    for p in prefixes:
        out = out | F.startswith(bare, F.lit(p))
    return out


def without_noise(lines: DataFrame, noise: tuple[str, ...], column: str = "line") -> DataFrame:
    """Log lines that hold none of the known messages of libraries."""
    out = F.lit(True)
    for message in noise:
        out = out & ~F.coalesce(F.contains(F.col(column), F.lit(message)), F.lit(False))
    return lines.where(out)
