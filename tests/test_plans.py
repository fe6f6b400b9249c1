"""Plans: what is large is shuffled, whatever the size of the table that it was unpacked from."""

import pytest
from conftest import SMALL

from trackweave.plans.registry import QUERIES


def broadcasts(frame) -> list[str]:
    """The part of the plan below each broadcast."""
    lines, out = frame._jdf.queryExecution().executedPlan().toString().split("\n"), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for n, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((m for m in range(n + 1, len(lines)) if depth(lines[m]) <= depth(line)), len(lines))
            out.append("\n".join(lines[n:end]))
    return out


@pytest.mark.parametrize("name", ["court_active", "mask_court_overlap", "mask_dominant", "mask_duplicates", "mask_lookup", "mask_pairs", "mask_reuse", "ref_conflict"])
def test_runs_are_not_broadcast(spark, name):
    """A mask's runs, a hundred rows of each row of the table that they come from, aren't broadcast; what has a row for a mask may be."""
    for below in broadcasts(QUERIES[name](spark, SMALL)):
        assert "Generate" not in below or "HashAggregate" in below.split("Generate")[0], below
