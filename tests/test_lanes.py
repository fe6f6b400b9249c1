"""Streams keep state by lanes of tracks, for a key costs more than its rows."""

import pytest
from conftest import SMALL
from test_streaming import as_stream  # noqa: F401

from trackweave.operators import tactical
from trackweave.sources import tables as T
from trackweave.streaming import settled, stateful


@pytest.mark.parametrize("name", ["smooth", "jersey"])
def test_few_states(spark, as_stream, name):  # noqa: F811
    rows, make = (tactical.feet(T.tracks(spark, SMALL)), stateful.smooth_stream) if name == "smooth" else (T.ocr_reads(spark, SMALL), stateful.jersey_stream)
    q = make(as_stream(rows, "frame_idx", 1)).writeStream.outputMode("append").format("noop").start()
    try:
        q.processAllAvailable()
        most = max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress)
    finally:
        q.stop()
    games = rows.select("game_id").distinct().count()
    assert 0 < most <= games * stateful.LANES < rows.select("game_id", "track_id").distinct().count()


def test_settled_keys(spark, as_stream):  # noqa: F811
    tracks, reads = (as_stream(t, "frame_idx", 1) for t in (T.tracks(spark, SMALL), T.ocr_reads(spark, SMALL)))
    for out in (settled.lifecycle_stream(tracks), settled.owners_stream(reads)):
        assert "AS lane" in out._jdf.queryExecution().logical().toString()
