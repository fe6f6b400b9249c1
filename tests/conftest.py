"""One local session for all tests; workers find the repository by PYTHONPATH."""

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    at = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.warehouse.dir", str(at / "warehouse")).config("spark.checkpoint.dir", str(at / "checkpoints")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the driver's small tables as views."""
    import duckdb

    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows_of(frame) -> list[tuple]:
    """Rows in order of their text, columns by name, floats as they print."""
    names = sorted(frame.columns)
    return sorted((tuple(r[n] for n in names) for r in frame.select(*names).collect()), key=str)


def same_rows(frame, con, sql) -> None:
    names = sorted(frame.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    want = sorted((tuple(r) for r in con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()), key=str)
    got = rows_of(frame)
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, bad[:3]
