"""Reports: runs and same-track entries in the suppression ledger, and summaries as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.config import DEFAULT, Config


def islands(ledger: DataFrame, cfg: Config = DEFAULT, every: bool = False) -> DataFrame:
    """(dropped_id, kept_id): entries in all, and the longest run of successive frames (the earliest of equals) with its first frame.
    Null ids are ids of their own; entries of one track twice belong to `duplicates`. Pairs with few entries and short runs are left out unless `every`."""
    pair = ["game_id", "dropped_id", "kept_id"]
    ledger = ledger.where("dropped_id IS NULL OR kept_id IS NULL OR dropped_id <> kept_id")
    totals = ledger.groupBy(*pair).agg(F.count("*").alias("total"))
    frames = ledger.select(*pair, "frame_idx").distinct()
    runs = frames.withColumn("island", F.col("frame_idx") - F.row_number().over(Window.partitionBy(*pair).orderBy("frame_idx")))
    runs = runs.groupBy(*pair, "island").agg(F.count("*").alias("run"), F.min("frame_idx").alias("first_frame"))
    best = runs.groupBy(*pair).agg(F.min(F.struct((-F.col("run")).alias("r"), "first_frame")).alias("b"))
    t, b = totals.alias("t"), best.alias("b")
    same = (F.col("t.game_id") == F.col("b.game_id")) & F.col("t.dropped_id").eqNullSafe(F.col("b.dropped_id")) & F.col("t.kept_id").eqNullSafe(F.col("b.kept_id"))
    out = t.join(b, same).select("t.*", (-F.col("b.b.r")).alias("longest_run"), F.col("b.b.first_frame").alias("run_start"))
    return out if every else out.where(f"longest_run >= {cfg.islands_run} OR total >= {cfg.islands_total}")


def duplicates(ledger: DataFrame, n: int = 10) -> DataFrame:
    """Pairs of the suppression ledger in which both detections continue one track: entries in all, first and last frame, each game's n with most."""
    per = ledger.where("dropped_id = kept_id").groupBy("game_id", F.col("dropped_id").alias("track_id")).agg(F.count("*").alias("total"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"))
    order = F.row_number().over(Window.partitionBy("game_id").orderBy(F.col("total").desc(), "first_frame", "track_id"))
    return per.withColumn("rank", order).where(F.col("rank") <= n)


def as_json(report: DataFrame) -> DataFrame:
    """One line of JSON for each row."""
    return report.select(F.to_json(F.struct("*")).alias("json"))


def write_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def sampled(diagnostics: DataFrame, counts: list[str], every: int = 30, low: int = 10) -> DataFrame:
    """Diagnostics of each 30th frame, and of frames where any count is low."""
    few = F.lit(False)
    for c in counts:
        few = few | (F.col(c) < low)
    return diagnostics.where((F.col("frame_idx") % every == 0) | few)
