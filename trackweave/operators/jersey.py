"""Jersey numbers: cleaned text reads become votes; the first number of a track with enough votes is its own, at most two owners each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.config import DEFAULT, Config
from trackweave.functions.text import clean_number

KEY = ("game_id", "track_id")


def cleaned(reads: DataFrame) -> DataFrame:
    return reads.withColumn("number", clean_number(F.col("text")))


def votes(reads: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Accepted reads of the frames that are read, numbered for each (track, number) in order."""
    accepted = cleaned(reads).where((F.col("conf") > cfg.ocr_conf) & F.col("number").isNotNull() & (F.col("frame_idx") % cfg.ocr_every == 0))
    return accepted.withColumn("nth", F.row_number().over(Window.partitionBy(*KEY, "number").orderBy("frame_idx", "det_id")))


def counts(voted: DataFrame) -> DataFrame:
    return voted.groupBy(*KEY, "number").agg(F.count("*").alias("n_votes"), F.min("frame_idx").alias("first_frame"))


def locks(voted: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The read by which each track's first number reaches the votes; later reads of a locked track count no more. A number that
    has its owners already isn't given again, and the track stays locked without one."""
    reached = voted.where(F.col("nth") == cfg.votes)
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy("frame_idx", "det_id"))
    locked = reached.withColumn("_n", first).where("_n = 1")
    owner = F.row_number().over(Window.partitionBy("game_id", "number").orderBy("frame_idx", "det_id"))
    return locked.withColumn("owner", owner).select(*KEY, F.col("frame_idx").alias("lock_frame"), "owner", F.col("number").alias("voted"), F.when(F.col("owner") <= cfg.owners, F.col("number")).alias("jersey"))


def by_number(locked: DataFrame) -> DataFrame:
    """The first owner of each number."""
    return locked.where("jersey IS NOT NULL AND owner = 1").select("game_id", "jersey", "track_id")


def labelled(tracks: DataFrame, locked: DataFrame) -> DataFrame:
    """Tracks with the jersey that they have from their lock's frame on."""
    j = locked.select(*KEY, "lock_frame", "jersey")
    return tracks.join(j, list(KEY), "left").withColumn("jersey", F.when(~F.col("is_referee") & (F.col("frame_idx") >= F.col("lock_frame")), F.col("jersey"))).drop("lock_frame")
