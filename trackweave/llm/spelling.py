"""Spelling variant grouping by Aho-Corasick halves: words one inserted, deleted or replaced letter apart.

1. Words are counted: each task counts its texts' words before anything is shuffled.
2. Of two words at distance 1, one half of either stands unchanged in the other: the first half at its beginning or the second at its end. So every word
   gives two segments. Segments of the same side, word length and outer letter are the patterns of one automaton, cut into shards of
   at most `SHARD` words or `SHARD_BYTES`, and every word is scanned by the shards of its own outer letters and of lengths up to one letter off. Where
   many words go to one shard they are cut into chunks, each with a copy of it; so no letter or length is one task, and memory holds one shard and one chunk.
3. A hit counts if its segment stands at the right offset. The distance of each such pair is verified, on arrays of the words' letters. A pair that
   both halves find is counted for the first. A task gives one row for each word and shard: how many words are near, and the best of them.
4. Forms are followed to roots by doubling: each word's pointer takes its target's, until none moves. Counts grow at least
   fivefold with each form, so there are no circles and few rounds.

Defined results: null and empty texts have no words; a null doc_id is hashed as an empty string; repeated rows count again;
ties go to the smallest word in code-point order; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import Scratch, discard, few, group_bounds, map_batches, materialize, runs_of

LETTERS, LEAST_LENGTH, LEAST_COUNT, FACTOR, EVERY = "a-zÀ-ÿ", 6, 5, 5, 199
SHARD, CHUNK, SHARD_BYTES = 20_000, 50_000, 16 << 20
#: Pairs that are verified at once hold about so many letters.
LETTERS_AT_ONCE = 1 << 22
RUN = re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}")
CELL = ["side", "size", "edge", "part", "chunk"]


def mistyped(doc_id: int | None, runs: Iterable[str]) -> Iterator[str]:
    """Each lower-cased run of a document, without a letter where the hash says so."""
    base = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run in runs:
        h = zlib.crc32(run.encode(), base)
        if h % EVERY:
            yield run
        else:
            at = h % len(run)
            yield run[:at] + run[at + 1 :]


def counted(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of enough letters that occur often enough."""

    def count(batch: pa.RecordBatch) -> dict:
        total: Counter[str] = Counter()
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            # Lower-casing bytes changes A-Z alone.
            own = Counter(m.group() for m in RUN.finditer(text.encode().lower().decode())) if text else {}
            for word, n in zip(mistyped(doc_id, own), own.values()):
                if len(word) >= LEAST_LENGTH:
                    total[word] += n
        return {"word": list(total), "n": list(total.values())}

    return map_batches(docs.select("doc_id", "text"), "word string, n long", count).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def edges_of(word: Column) -> Column:
    """The sides of a word with their outer letters."""
    side = lambda k, letter: F.struct(F.lit(k).alias("side"), F.ascii(letter).alias("edge"))
    return F.array(side(0, word), side(1, F.substring(word, -1, 1)))


def dealt(words: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (cell, kind, word, n): the words of a shard (kind 0) and the words that it scans (kind 1), together in each cell."""
    size = F.char_length("word")
    segments = words.select("word", "n", size.alias("size"), F.inline(edges_of(F.col("word"))))
    scans = segments.withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
    key = ["side", "size", "edge"]
    parts = F.ceil(F.greatest(F.count("*") / SHARD, F.count("*") * F.first("size") / SHARD_BYTES))
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.count("*") * F.first("size") / SHARD_BYTES))
    cells = segments.groupBy(*key).agg(parts.alias("parts")).join(scans.groupBy(*key).agg(chunks.alias("chunks")), key)
    cells = few(scratch(cells, "spelling-cells"))
    number = lambda c: F.pmod(F.xxhash64("word"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c).cast("int") - 1))
    shards = segments.join(cells, key).select(*key, number("parts").alias("part"), every("chunks").alias("chunk"), F.lit(0).alias("kind"), "word", "n")
    scanned = scans.join(cells, key).select(*key, every("parts").alias("part"), number("chunks").alias("chunk"), F.lit(1).alias("kind"), "word", "n")
    return shards.unionByName(scanned).repartition(*CELL).sortWithinPartitions(*CELL, "kind")


def letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of letters; all letters have code points below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def apart_by_one(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether rows of words, lengths at most one apart, differ by exactly one inserted, deleted or replaced letter."""
    if left.shape[1] == right.shape[1]:
        return (left != right).sum(1) == 1
    long, short = (left, right) if left.shape[1] > right.shape[1] else (right, left)
    before = np.logical_and.accumulate(long[:, :-1] == short, 1).sum(1)
    after = np.logical_and.accumulate((long[:, 1:] == short)[:, ::-1], 1).sum(1)
    return before + after >= short.shape[1]


def near_pairs(side: int, size: int, shard: list[str], scanned: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (scanned, shard) of rows whose words are near by the segments of one side."""
    import ahocorasick

    half = size // 2
    segment = [w[:half] if side == 0 else w[half:] for w in shard]
    order = sorted(range(len(shard)), key=segment.__getitem__)
    automaton, at = ahocorasick.Automaton(), 0
    while at < len(order):
        end = at
        while end < len(order) and segment[order[end]] == segment[order[at]]:
            end += 1
        automaton.add_word(segment[order[at]], (at, end))
        at = end
    automaton.make_automaton()
    order, lengths = np.array(order), np.array([len(w) for w in scanned])
    own = letters(shard)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        ends = half - 1 if side == 0 else length - 1
        hits = [(k, *span) for k, row in enumerate(rows.tolist()) for end, span in automaton.iter(scanned[row]) if end == ends]
        if not hits:
            continue
        other = letters([scanned[r] for r in rows.tolist()])
        row, first, last = np.array(hits).T
        left = np.repeat(row, last - first)
        right = order[np.arange(len(left)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + np.repeat(first, last - first)]
        for at in range(0, len(left), step := max(1, LETTERS_AT_ONCE // length)):
            i, j = left[at : at + step], right[at : at + step]
            near = apart_by_one(other[i], own[j])
            if side:
                near &= (other[i][:, :half] != own[j][:, :half]).any(1)
            found.append((rows[i[near]], j[near]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells to (word, n_near, form_n, form): of each scanned word the number of near words in the shard, and the most frequent of them."""
    for run in runs_of(batches, len(CELL)):
        bounds = group_bounds(run, len(CELL))
        out: tuple[list, list, list, list] = ([], [], [], [])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            cell = run.slice(a, b - a)
            words, n = cell.column(6).to_pylist(), cell.column(7).to_numpy()
            first = int(np.count_nonzero(cell.column(5).to_numpy() == 0))
            shard, scanned, n = words[:first], words[first:], n[:first]
            if not shard or not scanned:
                continue
            i, j = near_pairs(cell.column(0)[0].as_py(), cell.column(1)[0].as_py(), shard, scanned)
            rank = np.empty(first, np.int64)
            rank[sorted(range(first), key=shard.__getitem__)] = np.arange(first)
            sort = np.lexsort((rank[j], -n[j], i))
            i, j = i[sort], j[sort]
            start = np.flatnonzero(np.diff(i, prepend=-1))
            for col, values in zip(out, ([scanned[k] for k in i[start].tolist()], np.diff(np.append(start, len(i))).tolist(), n[j[start]].tolist(), [shard[k] for k in j[start].tolist()])):
                col.extend(values)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["word", "n_near", "form_n", "form"])


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of all words that have a form: the last word that forms lead to."""
    now = scratch(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        before, now = now, scratch(moved, "spelling-roots")
        scratch.written = [w for w in scratch.written if w is not before]
        discard(before)
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word."""
    scratch = Scratch()
    words = scratch(counted(docs), "spelling-words")
    found = dealt(words, scratch).mapInArrow(matches, "word string, n_near long, form_n long, form string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    near = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))
    is_form = F.coalesce(F.col("form_n") >= F.col("n") * FACTOR, F.lit(False))
    near = near.withColumns({"form": F.when(is_form, F.col("form")), "form_n": F.when(is_form, F.col("form_n"))})
    near = scratch(near, "spelling-near")
    out = near.join(roots(near.where("form IS NOT NULL"), scratch), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = materialize(out, "spelling-variants")
    scratch.clear()
    return out
