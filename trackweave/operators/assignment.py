"""Optimal assignment of rows to columns under a limit: of all sets of pairs that cost no more than it, one that saves most against it.

A frame has few pairs within the limit, so they are numbers of Python's: small arrays cost more than what is in them."""

from __future__ import annotations

import numpy as np


def groups(pairs: list[tuple[int, int]]) -> list[tuple[list[int], list[int]]]:
    """Rows and columns that pairs connect, group by group, each in order."""
    of_row, of_col = {}, {}
    for i, j in pairs:
        of_row.setdefault(i, []).append(j)
        of_col.setdefault(j, []).append(i)
    out = []
    while of_row:
        rows, cols, todo = [], set(), [next(iter(of_row))]
        while todo:
            i = todo.pop()
            if i in of_row:
                rows.append(i)
                for j in of_row.pop(i):
                    if j not in cols:
                        cols.add(j)
                        todo += of_col[j]
        out.append((sorted(rows), sorted(cols)))
    return out


def most(gain: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs of greatest total gain, by shortest augmenting paths over row and column prices; the table is made square with gains of 0."""
    height, width = len(gain), len(gain[0])
    n = max(height, width)
    cost = [[-g for g in row] + [0.0] * (n - width) for row in gain] + [[0.0] * n for _ in range(n - height)]
    row_price, col_price = [0.0] * n, [0.0] * (n + 1)
    row_of = [-1] * (n + 1)  # by column; the last one stands for the row that is being placed
    for r in range(n):
        row_of[n], at = r, n
        least, back, open_, done = [float("inf")] * n, [n] * n, list(range(n)), []
        while row_of[at] >= 0:
            done.append(at)
            here, to, step = row_of[at], -1, float("inf")
            line, price = cost[here], row_price[here]
            for c in open_:
                slack = line[c] - price - col_price[c]
                if slack < least[c]:
                    least[c], back[c] = slack, at
                if least[c] < step:
                    to, step = c, least[c]
            for c in done:
                row_price[row_of[c]] += step
                col_price[c] -= step
            open_.remove(to)
            for c in open_:
                least[c] -= step
            at = to
        while at != n:
            row_of[at], at = row_of[back[at]], back[at]
    return [(row_of[c], c) for c in range(width) if row_of[c] < height]


def assigned(cost: dict[tuple[int, int], float], limit: float) -> list[tuple[int, int]]:
    """`assign` of the pairs whose cost is known to be within the limit, in order of rows and columns."""
    if len({i for i, _ in cost}) == len({j for _, j in cost}) == len(cost):
        return list(cost)
    out = []
    for rows, cols in groups(list(cost)):
        if len(rows) == 1 or len(cols) == 1:
            out.append(min(((i, j) for i in rows for j in cols), key=cost.__getitem__))
        else:
            found = most([[limit - cost[i, j] if (i, j) in cost else 0.0 for j in cols] for i in rows])
            out += [(rows[i], cols[j]) for i, j in found if (rows[i], cols[j]) in cost]
    return sorted(out)


def assign(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Pairs (row, column), each once, of cost up to the limit, that save most against it in all."""
    rows, cols = np.nonzero(cost <= limit)
    return assigned(dict(zip(zip(rows.tolist(), cols.tolist()), cost[rows, cols].tolist())), limit)
