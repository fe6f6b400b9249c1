"""Sharding by sampled splitters, under the law of near-equal bytes: no shard is off the mean by more than 1/100 of it and one row.

Keys are (hash of text, hash of doc_id and row), so equal texts lie together. A size-weighted sample of keys gives quantile splitters,
several ranges to each shard; rows go to their range, and ranges that come out overfull get splitters of their own from a further
sample, until none can be subdivided. Exact prefix sums over the ranges (all rows, not the sample) then cut the order of keys into shards.

A group of equal texts stays whole wherever the law allows it:
* A light group, of at most 1/100 of a shard, is never cut: no splitter lies in it, and it goes to the shard of its middle, which moves
  each boundary by half of it at most.
* Heavy groups (under 100 a shard, for they are parts of all bytes) are packed first, by falling size, each whole into the shard with
  most room left, if it fits or is over by 1/100 of a shard at most. Light rows then fill what room is left.
* A heavy group that fits nowhere is cut row by row where a shard is full; so is one that is larger than a shard.

What reaches the driver: the sample and a row for each range (about `RANGE_ROWS` rows of the table, or 1/16 of a shard if that is less),
a row for each heavy group, and one for each shard. Texts are read once; what is shuffled is about 40 bytes a row.

Defined results: a null text has size 16 and the checksum of no bytes; null doc_ids are ordinary keys; repeated rows each get a slot, and
may be parted like a heavy group; an empty table gives no rows; there may be fewer filled shards than asked for where there are fewer
rows."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import materialize, text_key

SHARDS, RANGES_PER_SHARD, RANGE_ROWS, DRAWS, ROW_BYTES, TOLERANCE = 40, 16, 500_000, 12, 16, 100
LOWEST, ROW_BITS = -(1 << 63), 20
Key = tuple[int, int]


def range_of(splitters: list[Key]):
    """A function of columns h1, h2 that counts the splitters at or below the key."""
    first = np.array([s[0] for s in splitters], np.int64)
    second = np.array([s[1] for s in splitters], np.int64)

    @F.pandas_udf("int")
    def count(h1: pd.Series, h2: pd.Series) -> pd.Series:
        a, b = h1.to_numpy(), h2.to_numpy()
        low, high = np.searchsorted(first, a, "left"), np.searchsorted(first, a, "right")
        while (between := low < high).any():  # a binary search of all rows at once among the splitters within their groups
            middle = (low + high) // 2
            up = between & (second[np.minimum(middle, len(second) - 1)] <= b)
            low, high = np.where(up, middle + 1, low), np.where(between & ~up, middle, high)
        return pd.Series(low.astype(np.int32))

    return count


def sample(rows: DataFrame, samples: int) -> list[Key]:
    """Keys drawn without replacement with chances in proportion to size, sorted."""
    u = (F.shiftrightunsigned(F.xxhash64("h1", "h2", F.lit(11)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    drawn = rows.select("h1", "h2", (-F.log(u) / F.col("size")).alias("draw")).orderBy("draw", "h1", "h2").limit(samples)
    return sorted((r.h1, r.h2) for r in drawn.collect())


def quantiles(keys: list[Key], parts: int, heavy: set[int]) -> set[Key]:
    """Boundaries of `parts` runs of a sorted sample; only heavy groups have boundaries within them."""
    found = (keys[k * len(keys) // parts] for k in range(1, parts))
    return {(h1, h2 if h1 in heavy else LOWEST) for h1, h2 in found}


def split(rows: DataFrame, total: int, ranges: int, heavy: set[int], edges: set[Key]) -> tuple[list[Key], list]:
    """Splitters, `edges` among them, and (rng, b, n) of all ranges, after overfull ranges have been subdivided as far as they can be."""
    keys, mean = sample(rows, DRAWS * ranges), total / ranges
    splitters = sorted(edges | (quantiles(keys, min(len(keys), ranges), heavy) if keys else set()))
    while True:
        stats = rows.groupBy(range_of(splitters)("h1", "h2").alias("rng")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
        over = {s.rng: s.b for s in stats if s.b > 3 * mean and s.n > 1}
        found: dict[int, list[Key]] = {}
        if over:
            for key in sample(rows.where(range_of(splitters)("h1", "h2").isin(list(over))), DRAWS * ranges):
                found.setdefault(bisect.bisect_right(splitters, key), []).append(key)
        more = set().union(*(quantiles(ks, min(len(ks), 2 + int(over.get(r, 0) / mean)), heavy) for r, ks in found.items()))
        if not more - set(splitters):
            return splitters, stats
        splitters = sorted(more | set(splitters))


def pack(groups: dict[int, int], shards: int, mean: float) -> dict[int, int]:
    """The shard of each heavy group (h1 to bytes) that is kept whole."""
    room, out = [mean] * shards, {}
    for h1 in sorted(groups, key=lambda h: (-groups[h], h)):
        s = max(range(shards), key=room.__getitem__)
        if groups[h1] <= room[s] + mean / TOLERANCE:
            out[h1], room[s] = s, room[s] - groups[h1]
    return out


def boundaries(loads: list[int], rest: int) -> list[float]:
    """Where the order of the other rows, of `rest` bytes, is cut so that shards with these loads come out level."""
    rising = sorted(loads)
    for k in range(len(rising), 0, -1):
        level = (rest + sum(rising[:k])) / k
        if level >= rising[k - 1]:
            break
    return np.cumsum([max(0.0, level - v) for v in loads])[:-1].tolist()


def sized(docs: DataFrame) -> DataFrame:
    text, low = F.coalesce("text", F.lit("")), (1 << ROW_BITS) - 1
    by_row = F.xxhash64(F.monotonically_increasing_id(), F.lit(7)).bitwiseAND(F.lit(low))
    return docs.select(
        "doc_id", (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        text_key(F.col("text")).alias("h1"), F.xxhash64("doc_id", F.lit(7)).bitwiseAND(F.lit(~low)).bitwiseOR(by_row).alias("h2"),
    )


def shard(docs: DataFrame, shards: int = SHARDS, ranges_per_shard: int = RANGES_PER_SHARD, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every document."""
    spark = docs.sparkSession
    rows = materialize(sized(docs), "shard-rows")
    all_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    mean = total / shards
    groups = rows.groupBy("h1").agg(F.sum("size").alias("b")).where(F.col("b") > mean / TOLERANCE).collect()  # fewer than shards * TOLERANCE
    heavy = {g.h1: g.b for g in groups}
    packed = pack(heavy, shards, mean)
    edges = {(h, LOWEST) for h1 in packed for h in (h1, h1 + 1) if h < 1 << 63}
    ranges = max(shards * ranges_per_shard, -(-all_rows // range_rows))
    splitters, stats = split(rows, max(total, 1), ranges, set(heavy), edges)
    loads, counts, offsets, at, before = [0] * shards, [0] * shards, [], 0, 0
    for s in sorted(stats, key=lambda s: s.rng):
        home = packed.get(splitters[s.rng - 1][0]) if s.rng else None
        if home is None:
            offsets.append((s.rng, at, before, None))
            at, before = at + s.b, before + s.n
        else:
            offsets.append((s.rng, 0, counts[home], home))
            loads[home], counts[home] = loads[home] + s.b, counts[home] + s.n
    starts = F.broadcast(spark.createDataFrame(offsets, "rng int, before long, rows_before long, home int"))  # a row for each range
    in_range, group = Window.partitionBy("rng").orderBy("h1", "h2"), Window.partitionBy("rng", "h1")
    placed = (
        rows.withColumn("rng", range_of(splitters)("h1", "h2")).join(starts, "rng")
        .withColumn("end", F.col("before") + F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("rank", F.col("rows_before") + F.row_number().over(in_range) - 1)
        .withColumn("group_bytes", F.sum("size").over(group)).withColumn("group_end", F.max("end").over(group))
    )
    cut = F.col("h1").isin([h for h in heavy if h not in packed])
    middle = F.when(cut, 2 * F.col("end") - F.col("size")).otherwise(2 * F.col("group_end") - F.col("group_bytes"))
    marks = F.array(*(F.lit(2 * b) for b in boundaries(loads, at))).cast("array<double>")
    number = F.coalesce("home", F.size(F.filter(marks, lambda m: m <= middle)))
    done = materialize(placed.select("doc_id", "size", "text_crc32", number.cast("int").alias("shard"), F.col("home").isNotNull().alias("whole"), "rank"), "shard-placed")
    first = [(r.shard, r.first, r.n) for r in done.where("NOT whole").groupBy("shard").agg(F.min("rank").alias("first"), F.count("*").alias("n")).collect()]
    firsts = F.broadcast(spark.createDataFrame(first, "shard int, first long, n long"))  # a row for each shard
    slot = F.when(F.col("whole"), F.col("rank") + F.coalesce("n", F.lit(0))).otherwise(F.col("rank") - F.col("first"))
    return done.join(firsts, "shard", "left").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
