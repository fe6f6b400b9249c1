"""State machines that depend on their own results: one for each key, fed in order, with memory for one step and its state only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Rows = dict[str, np.ndarray]


def merged(tables: dict[str, DataFrame]) -> DataFrame:
    """Several tables as one ordered feed: rows of all, with the name of their own in `_table`; columns that a table lacks are NULL there."""
    out = None
    for name, rows in tables.items():
        rows = rows.withColumn("_table", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def in_order(
    rows: DataFrame, keys: list[str], step: str, order: list[str], make: Callable[[tuple], Callable[[int, Rows], list[tuple]]], schema: str,
    prepare: Callable[[Rows, list[int]], list] | None = None, together: Callable[[list, list[int], list], list[tuple]] | None = None, most: int = 1,
) -> DataFrame:
    """Rows of each key, in order of `step` and then `order`, through one machine each: `make(key)` gives a function of a step's number and rows
    (arrays by column) that returns output rows.

    What a step doesn't need the state for can be made for a batch's steps at once: `prepare(rows, where steps begin, and the end)` gives what each step's
    machine gets in place of its rows. With `together`, a task's keys go on side by side, by steps since their first, and the next steps of up to `most` of them
    are made at once: `together(machines, steps' numbers, what each gets)`. The task then holds the states of all of its keys, else that of one.

    Keys are dealt to all shuffle partitions, however few bytes they have, for a key is much work, and sorted there, so a task streams its keys' rows in batches and never gathers a key; different keys run apart."""
    names, extra = [c.split()[0] for c in schema.split(", ")], ["_first"] if together else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machines, kept = {}, None

        def machine(now: tuple):
            if now not in machines:
                if not together:
                    machines.clear()
                machines[now] = make(now)
            return machines[now]

        def feed(part: pd.DataFrame) -> pd.DataFrame:
            arrays = {c: part[c].to_numpy() for c in part.columns if c not in extra}
            columns = [arrays[c] for c in (*keys, step)]
            change = np.zeros(len(part), bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            cuts, out = [0, *np.flatnonzero(change).tolist(), len(part)], []
            given = prepare(arrays, cuts) if prepare else [{c: v[a:b] for c, v in arrays.items()} for a, b in zip(cuts[:-1], cuts[1:])]
            number = columns[-1][cuts[:-1]].tolist()
            key = list(zip(*(c[cuts[:-1]].tolist() for c in columns[:-1])))
            if not together:
                for k, now in enumerate(key):
                    out += machine(now)(number[k], given[k])
                return pd.DataFrame(out, columns=names)
            at = 0
            while at < len(key):
                end = at + 1
                while end < len(key) and end - at < most and key[end] not in key[at:end]:
                    end += 1
                out += together([machine(now) for now in key[at:end]], number[at:end], given[at:end])
                at = end
            return pd.DataFrame(out, columns=names)

        for batch in frames:
            if not len(batch):
                continue
            part = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            last = np.ones(len(part), bool)  # rows of the last step, which the next batch may go on with
            for c in (*keys, step):
                last &= (part[c] == part[c].iloc[-1]).to_numpy()
            end = int(np.argmax(last))
            kept = part.iloc[end:]
            if end:
                yield feed(part.iloc[:end])
        if kept is not None:
            yield feed(kept)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, *keys)
    if together:
        side = dealt.withColumn("_first", F.col(step) - F.min(step).over(Window.partitionBy(*keys)))
        return side.sortWithinPartitions("_first", *keys, *order).mapInPandas(run, schema)
    return dealt.sortWithinPartitions(*keys, step, *order).mapInPandas(run, schema)
