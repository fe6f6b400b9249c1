"""Spelling variants, HyperMinHash and whitening against brute force, and on odd inputs."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest import SMALL, same_rows
from test_llm_odd_inputs import DOCS, brute_classes, odd_docs

from trackweave.llm import hyperminhash, ngram_join, spelling, whitening
from trackweave.llm import queries as Q
from trackweave.llm.common import documents

LARGER = "/root/testdata/sf0.1"


def letter(c):
    return "a" <= c <= "z" or "A" <= c <= "Z" or "\u00c0" <= c <= "\u00ff"


def brute_words(rows):
    """Counts of the words of (doc_id, text) rows, letter by letter."""
    total = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if letter(c):
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                at = h % len(run)
                total[run if h % 199 else run[:at] + run[at + 1 :]] += 1
                run = ""
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(words, pairs=None):
    """(word, form, root, n, n_near, form_n) of each word; pairs that can be near, all by default."""
    near = defaultdict(set)
    for a in words:
        for b in words if pairs is None else pairs[a]:
            if one_apart(a, b):
                near[a].add(b)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 5 * words[w]:
            form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def got_variants(docs):
    return sorted(tuple(r) for r in spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_spelling_whole_table(spark):
    docs = documents(spark, SMALL)
    words = brute_words([(r.doc_id, r.text) for r in docs.collect()])
    by_cut, pairs = defaultdict(set), defaultdict(set)
    for w in words:
        for cut in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            by_cut[cut].add(w)
    for same in by_cut.values():
        for w in same:
            pairs[w] |= same
    want = brute_variants(words, pairs)
    got = sorted(tuple(r) for r in Q.queries()["op11_spelling"](spark, SMALL).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == want and any(r[1] for r in want)


@pytest.mark.parametrize("alphabet", ["ab", "aé\u00d7z"])
@pytest.mark.parametrize("shard", [7, 20_000])
def test_spelling_random(spark, monkeypatch, alphabet, shard):
    """Words of few letters, most of them near to many others, in shards and chunks of any size; chains of forms, ties and repeats."""
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "CHUNK", 2 * shard)
    draw = np.random.default_rng(len(alphabet) + shard)
    words = sorted({"".join(draw.choice(list(alphabet), int(draw.integers(5, 9)))) for _ in range(160)})
    said = [w for w in words for _ in range(int(5 ** draw.integers(0, 4)))]
    draw.shuffle(said)
    rows = [(k, " ".join(said[k::12]).replace("a", "A", 5)) for k in range(12)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    assert got_variants(docs) == brute_variants(brute_words(rows))


def test_spelling_odd(spark):
    rows = [(None, "letters Letters LETTERS l\u00e9tters"), (1, None), (2, ""), (3, "x" * 200_000 + " lettersx" * 40), (3, "x" * 200_000 + " letterss" * 200), (4, "lettexs " * 2000 + "\u00c9tages \u00e9tages " * 9)] + [(5, "x" * 200_000)] * 4
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n long, side int")
    want = brute_variants(brute_words(rows))
    assert got_variants(docs) == want and len(want) >= 5
    assert got_variants(docs.limit(0)) == [] and got_variants(docs.where("doc_id in (1, 2)")) == []


def test_halves():
    """Each pair at distance 1 is found by exactly one side, whichever word is in the shard."""
    words = sorted({"".join(w) for w in np.random.default_rng(4).choice(list("ab"), (600, 7))} | {"".join(w) for w in np.random.default_rng(5).choice(list("ab"), (600, 6))})
    found = Counter()
    for side in (0, 1):
        for size in (6, 7):
            shard = [w for w in words if len(w) == size]
            i, j = spelling.near_pairs(side, size, shard, words)
            found.update(zip([words[k] for k in i], [shard[k] for k in j]))
    assert found == Counter((a, b) for a in words for b in words if one_apart(a, b))


def components_of(rows):
    """(doc_id, n_shingles, component, kept) from all pairs."""
    from test_llm_odd_inputs import shingles

    return sorted(((i, len(shingles(r[1], 2, True)), c, i == c) for r, (i, c, _, _) in zip(rows, brute_classes(rows, 2, True))), key=str)


def got_components(docs):
    return sorted((tuple(r) for r in hyperminhash.components(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_hyperminhash_odd(spark):
    docs, rows = odd_docs(spark)
    rows = [*rows, (900, "Mixed CASE words stay \u00c9", None, None, 0, None, 0), (901, "mixed case WORDS stay \u00c9", None, None, 0, None, 0), (902, "mixed case words stay \u00e9", None, None, 0, None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    assert got_components(docs) == components_of(rows)
    assert got_components(docs.limit(0)) == []


def test_hyperminhash_small_sets(spark):
    """Sets of few shingles, which fill few buckets of their own."""
    draw = np.random.default_rng(7)
    rows = []
    for k in range(250):
        words = [f"g{k}w{w}" for w in range(int(draw.integers(4, 30)))]
        for text in (words, words[:-1], [*words, "end"], [*words[:-1], "other"]):
            rows.append((len(rows), " ".join(text), None, None, 0, None, 0))
    assert got_components(spark.createDataFrame(rows, DOCS)) == components_of(rows)


def test_registers():
    """Registers are leading zeros and mantissa of the least hash of each bucket; their equality estimates the similarity."""
    least = np.array([0, 1, 3, (1 << 52) | 5, (1 << 53) - 1, 1 << 40], np.uint64)
    for x, got in zip(least.tolist(), hyperminhash.compressed(least).tolist()):
        bits = f"{x:053b}"
        zeros = len(bits) - len(bits.lstrip("0"))
        assert got == zeros << 10 | int((bits.lstrip("0")[1:] + "0" * 10)[:10], 2)
    draw = np.random.default_rng(2)
    for n in (4, 10, 60, 500, 5000):
        left, right = [], []
        for _ in range(200):
            hashes = draw.integers(0, 1 << 63, n + n // 4, dtype=np.uint64) * np.uint64(2)
            left.append(np.unique(hashes[:n]))
            right.append(np.unique(hashes[n // 4 :]))
        equal = (hyperminhash.registers(left) == hyperminhash.registers(right)).sum(1)
        true = (n - n // 4) / (n + n // 4)
        size = np.full(200, n)
        assert abs(hyperminhash.estimate(equal, size, size).mean() - true) < 0.03


def test_collisions():
    """Sets without a common shingle share as many registers as the table says."""
    draw = np.random.default_rng(9)
    for n in (128, 2000):
        sets = [draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) for _ in range(400)]
        values = hyperminhash.registers(sets)
        share = np.mean([(values[k] == values[j]).mean() for k in range(0, 400, 2) for j in range(1, 400, 14)])
        at = int(np.rint(2 * np.log2(max(n / 128, 1))))
        assert abs(share - hyperminhash.COLLISIONS[at, at]) < 2e-4


@pytest.mark.parametrize("name", ["op3_ngram_jaccard", "op12_hyperminhash"])
def test_recall(spark, name):
    """No link is lost at sf0.1: the same rows as all pairs in SQL."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{LARGER}/documents.parquet'")
    same_rows(Q.queries()[name](spark, LARGER), con, Q.oracle_sql()[name])


def brute_whitening(rows, up_to=4):
    """n, {vec_id: [(deviation, |whitened| by component)]}, explained, from numpy."""
    good = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dims = max(len(x) for _, x in good)
    good = [(i, np.pad(x, (0, dims - len(x)))) for i, x in good]
    fit = np.unique(np.stack([x for _, x in good]), axis=0)
    n, total = len(fit), fit.sum(0)
    centred = fit - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:up_to], axes[:, ::-1][:, :up_to]
    white = lambda x: np.abs((x - total / n) @ axes / np.sqrt(values))
    return n, [(i, int(((n * x - total) ** 2).sum()), white(x)) for i, x in good], values / np.trace(centred.T @ centred / n)


def same_whitening(frame, rows):
    n, want, explained = brute_whitening(rows)
    got = frame.orderBy("vec_id", "component").collect()
    k = len(explained)
    assert len(got) == k * len(want)
    for at, (i, deviation, white) in enumerate(sorted(want, key=lambda x: x[0])):
        own = got[at * k : at * k + k]
        assert [(r.vec_id, r.component, r.n, r.deviation) for r in own] == [(i, c + 1, n, deviation) for c in range(k)]
        assert np.allclose([abs(r.whitened) for r in own], white, rtol=1e-7, atol=1e-7) and np.allclose([r.explained for r in own], explained, rtol=1e-9)
        assert all(r.identity_error < 1e-9 for r in own)
    return got


def test_whitening_whole_table(spark):
    frame = Q.queries()["op13_whitening"](spark, SMALL)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    same_whitening(frame, rows)


def test_whitening_odd(spark, monkeypatch):
    """Tiles and row-blocks of odd sizes; nulls, infinities, short vectors, repeats and clashing columns."""
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 70 * 3)
    draw = np.random.default_rng(3)
    rows = [(k, (draw.normal(0, 1, 70) * np.linspace(3, 1, 70)).round(6).tolist()) for k in range(400)]
    rows += [(400 + k, rows[k][1]) for k in range(30)] + [(500, [0.5] * 40), (501, [])]
    odd = [(600, None), (601, [1.0, None]), (602, [float("nan")] * 70), (603, [float("inf"), 1.0]), (604, [float("-inf")])]
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows + odd], "vec_id long, embedding array<double>, x string, n long")
    got = same_whitening(whitening.whiten(frame), rows)
    # One sign for all rows: equal vectors have equal values.
    by = {(r.vec_id, r.component): r.whitened for r in got}
    assert all(by[k, c] == by[400 + k, c] for k in range(30) for c in range(1, 5))


def test_whitening_few(spark):
    schema = "vec_id long, embedding array<float>"
    whiten = lambda rows: whitening.whiten(spark.createDataFrame(rows, schema)).orderBy("vec_id", "component").collect()
    assert whiten([]) == [] and whiten([(1, None), (2, [])]) == []
    (one,) = whiten([(1, [0.5])])
    assert (one.n, one.deviation, one.whitened, one.explained, one.identity_error) == (1, 0, None, None, None)
    flat = whiten([(1, [0.5, 1.0]), (2, [0.5, 2.0]), (None, [0.5, 2.0])])
    assert [(r.n, r.deviation, r.explained) for r in flat] == [(2, 256**2, 1.0), (2, 256**2, 0.0)] * 3
    assert {abs(r.whitened) for r in flat if r.component == 1} == {1.0} and {r.whitened for r in flat if r.component == 2} == {None}
    far = whiten([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1e15, 2.0])])
    assert len(far) == 6 and {r.n for r in far} == {3}


def test_whitening_exact_deviation():
    rows = np.array([[1 << 40, -5], [3, 7]])
    assert whitening.deviations(rows, 3, [1 << 40, 9]) == [None, sum(x * x for x in (9 - (1 << 40), 12)) if (9 - (1 << 40)) ** 2 < 1 << 63 else None]
    assert whitening.deviations(np.array([[1 << 20, -5]]), 3, [1 << 20, 9]) == [(2 << 20) ** 2 + 24**2]
    assert ngram_join.METHOD.words == 5
