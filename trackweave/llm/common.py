"""What the operators of this subpackage share: Arrow batch mapping, written intermediates, word rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.sources.written import discard, materialize, written_bytes

#: A word is a run of anything but these ASCII blanks; `bytes.split()` splits on exactly the same six.
BLANKS = "\\x20\\x09-\\x0D"
#: Python code works on slices of an Arrow batch of about so many bytes, so long texts can't pile up.
SLICE_BYTES = 4 << 20
#: A written table of so few rows and bytes is broadcast; a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `limit` bytes; a single longer row stays whole."""
    rows, step = batch.num_rows, 0
    if rows:
        step = max(1, min(rows, int(rows * limit / max(1, batch.nbytes))))
    for at in range(0, rows, step or 1):
        yield batch.slice(at, step)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches between Spark and Python hold about SLICE_BYTES at most, in this session from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))


def map_batches(df: DataFrame, schema: str, run: Callable[[pa.RecordBatch], dict[str, Sequence] | pa.RecordBatch], limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow with bounded slices; `run` gives columns by name, or a batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark_schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(spark_schema)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit):
                out = run(part)
                if isinstance(out, dict):
                    out = pa.RecordBatch.from_arrays([v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, f.type) for f, v in ((f, out[f.name]) for f in arrow)], schema=arrow)
                yield out

    bounded_batches(df.sparkSession)
    return df.mapInArrow(go, spark_schema)


def word_count(text: Column) -> Column:
    """Number of words, natively: each word with the blanks after it becomes one character."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{BLANKS}]+", "")
    return F.length(F.regexp_replace(body, f"[^{BLANKS}]+[{BLANKS}]*", "x")).cast("long")


def text_key(text: Column) -> Column:
    """64 bits that stand for the text; null has its own."""
    return F.xxhash64(text.isNull(), F.coalesce(text, F.lit("")))


def in_files(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """A table of about so many narrow rows in as many partitions as they are worth, and no more than there are: each partition becomes a file, and starting
    and naming files costs more than small ones hold."""
    return df.coalesce(max(8, -(-rows // each)))


def gathered(df: DataFrame) -> DataFrame:
    """A table of which each of a shuffle's partitions holds little, in an eighth of the shuffle's partitions, or two for each core where that is more."""
    context = df.sparkSession.sparkContext
    return df.coalesce(max(2 * context.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


def few(rows: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is small."""
    return F.broadcast(rows) if written_bytes(rows) <= BROADCAST_BYTES and rows.count() <= BROADCAST_ROWS else rows


def part_of(written: DataFrame, rows: DataFrame) -> DataFrame:
    """Marks rows as a selection from a written table, at most as large as that one."""
    rows.written_at = written.written_at
    return rows


class Scratch:
    """Writes tables in between and removes them together."""

    def __init__(self) -> None:
        self.written: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.written.append(materialize(df, name))
        return self.written[-1]

    def clear(self, *kept: DataFrame) -> None:
        """Remove all tables but those that are still read."""
        for df in self.written:
            if not any(df is k for k in kept):
                discard(df)
        self.written = list(kept)


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut so that rows with equal first `keys` columns (a group) are never apart; a group fits in memory."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        last = batch.num_rows
        same = np.ones(last, bool)
        for k in key:
            same &= k == k[-1]
        first = int(last - np.argmin(same[::-1])) if not same.all() else 0
        if first == 0 and kept and all(kept[-1].column(k)[kept[-1].num_rows - 1] == batch.column(k)[0] for k in range(keys)):
            kept.append(batch)
            continue
        yield from _together([*kept, batch.slice(0, first)])
        kept = [batch.slice(first)]
    yield from _together(kept)


def _together(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if parts and sum(p.num_rows for p in parts):
        yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def group_bounds(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    change = np.zeros(batch.num_rows - 1, bool)
    for k in range(keys):
        v = batch.column(k).to_numpy(zero_copy_only=False)
        change |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]])
