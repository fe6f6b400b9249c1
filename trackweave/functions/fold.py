"""Running folds over an array, in native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A fold's outputs are gathered in pieces of so many, for appending to one array copies it: the work is about n * CHUNK / 2 + (n / CHUNK)**2 / 2.
CHUNK = 256


def running(points: Column, first: Callable[[Column], Column], step: Callable[[Column, Column], Column], chunk: int = CHUNK) -> Column:
    """The array of all states: `first(p)` for the first point, then `step(last state, p)`."""
    head = F.transform(F.slice(points, 1, 1), first)
    count = F.ceil((F.size(points) - 1) / F.lit(chunk)).cast("int")
    begins = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(begins, lambda i: F.slice(points, i * chunk + 2, F.lit(chunk)))

    def piece(acc: Column, ps: Column) -> Column:
        out = F.aggregate(ps, F.slice(F.element_at(acc, -1), -1, 1), lambda a, p: F.concat(a, F.array(step(F.element_at(a, -1), p))))
        return F.concat(acc, F.array(F.slice(out, 2, chunk)))

    return F.flatten(F.aggregate(pieces, F.array(head), piece))
