"""Every stage of the pipeline on what the one before kept, against what its operator is meant to do."""

import importlib.util

import pytest
from conftest import SMALL

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline", allow_module_level=True)


def test_stages(spark):
    import corpus_pipeline as P
    from trackweave.llm import pii, quality_rules
    from trackweave.llm.common import documents, materialize
    from test_llm_odd_inputs import shingles
    from test_llm_oracles import mixed_targets

    docs = documents(spark, SMALL)
    columns, out = docs.columns, [docs]
    for _, stage in P.STAGES:
        out.append(materialize(stage(spark, out[-1], SMALL), "test"))
    assert len(P.STAGES) == 5 and all(d.columns == columns for d in out[:-1])
    rows = [{r[0]: r for r in d.collect()} for d in out]
    judged = {k: quality_rules.judge(r.text) for k, r in rows[0].items()}
    assert {k: v.text for k, v in rows[1].items()} == {k: j[7] for k, j in judged.items() if j[6]}
    sets = {k: shingles(r.text) for k, r in rows[1].items()}
    kept, gone = set(rows[2]), set(rows[1]) - set(rows[2])
    like = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    assert not any(like(a, b) for a in kept for b in kept if a < b)
    assert all(any(like(a, b) for b in rows[1] if b != a) for a in gone)
    assert {k: v.text for k, v in rows[3].items()} == {k: pii.redacted(r.text, pii.find(r.text)) for k, r in rows[2].items()}
    size = lambda t: len((t or "").encode().split())
    sources = {r.source for r in rows[3].values()}
    words = {s: sum(size(r.text) for r in rows[3].values() if r.source == s) for s in sources}
    taken = {s: 0 for s in sources}
    for r in out[4].collect():
        taken[r.source] += size(r.text)
        assert r == rows[3][r.doc_id]
    most = max(size(r.text) for r in rows[3].values())
    assert all(abs(taken[s] - t) <= most for s, t in mixed_targets(words).items())
    assert out[5].count() == out[4].count()


@pytest.mark.parametrize("made", [False, True])
def test_one_of_each_component(spark, made):
    """Of each connected component of similar documents exactly one stays; `made`: chains of edits in any order."""
    import corpus_pipeline as P
    from test_llm_odd_inputs import DOCS, brute_classes, chains
    from trackweave.llm.common import documents, materialize

    docs = spark.createDataFrame(chains(40), DOCS) if made else materialize(P.quality(spark, documents(spark, SMALL), SMALL), "test")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = [r.doc_id for r in P.near_duplicates(spark, docs, SMALL).collect()]
    assert sorted(kept) == sorted({c for _, c, _, _ in brute_classes(rows)})


def test_run_is_the_stages(spark):
    import corpus_pipeline as P

    rows = P.run(spark, SMALL).collect()
    assert rows and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(rows[0].asDict())


def test_empty_and_null_tables(spark):
    """Every stage by itself, and all in order, over no rows and over rows of nothing but nulls."""
    import corpus_pipeline as P
    from trackweave.llm.common import documents, materialize

    base = documents(spark, SMALL)
    nulls = spark.createDataFrame([(None,) * len(base.columns)] * 3, base.schema)
    for docs, left in ((base.limit(0), [0] * 5), (nulls, [0, 3, 3, 3, 3])):
        for (_, stage), n in zip(P.STAGES, left):
            out = stage(spark, docs, SMALL)
            assert out.columns == (docs.columns if stage is not P.STAGES[-1][1] else out.columns) and len(out.collect()) == n
        now = docs
        for _, stage in P.STAGES:
            now = materialize(stage(spark, now, SMALL), "test")
        assert now.collect() == []


def test_few_files_between(spark, tmp_path, monkeypatch):
    """However many partitions a shuffle has, tables in between that hold little are written in two files a core or an eighth of them: each file costs processes."""
    from pathlib import Path

    import corpus_pipeline as P
    from test_llm_odd_inputs import DOCS, brute_classes, chains
    from trackweave.llm import common, components, families
    from trackweave.sources import written

    monkeypatch.setattr(written, "shared_dir", lambda spark: str(tmp_path))
    files, drop = {}, written.discard

    def counted(df):
        files[df.written_at] = len(list(Path(df.written_at).glob("part-*")))
        drop(df)

    for module in (common, components, families):
        monkeypatch.setattr(module, "discard", counted)
    held = {"spark.sql.shuffle.partitions": "96", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        docs = spark.createDataFrame(chains(10), DOCS).coalesce(4)
        kept = common.materialize(P.near_duplicates(spark, docs, SMALL), "test")
        assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _, _ in brute_classes(chains(10))})
        P.mixture(spark, docs, SMALL).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files |= {str(p): len(list(p.glob("part-*"))) for p in tmp_path.iterdir() if not p.name.startswith("test-")}
    assert len(files) > 15 and max(files.values()) <= 16, files
