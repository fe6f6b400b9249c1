"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, with brute force where there is a choice."""

import hashlib
from pathlib import Path

import numpy as np
import pytest
from conftest import ROOT, SMALL

from trackweave.llm import chat, common, families, hyperminhash, ngram_join, quality_rules, revisits
from trackweave.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, node long"


def odd_docs(spark):
    long = " ".join(f"w{k}" for k in range(30000))
    base = [f"t{k}" for k in range(60)]
    near = [" ".join([*base[:-1], f"end{k}"]) for k in range(8)]
    chain = [" ".join(base[k : k + 50]) for k in (0, 3, 6, 9)]
    all_texts = [None, "", "  \n", "a", "a", "a b c", "a b c", long, long + " x", long, *near, near[0], *chain, "b a", "a b c d e", "a b c d e"]
    rows = [(k, t, "en", "s", len(t or ""), None, 7) for k, t in enumerate(all_texts)] + [(3, "a", "en", "s", 1, None, 7), (None, near[1], None, None, None, None, None), (None, "only here and nowhere else at all", None, None, 3, None, None)]
    return spark.createDataFrame(rows, DOCS), rows


def shingles(t, words=5, lower=False):
    w = (t or "").encode().lower().split() if lower else (t or "").encode().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute_classes(rows, words=5, lower=False):
    """(doc_id, class, copies, links) of each row from all pairs."""
    sets = [shingles(r[1], words, lower) for r in rows]
    n = len(rows)
    link = [[a != b and bool(sets[a]) and bool(sets[b]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for b in range(n)] for a in range(n)]
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            new = {b for b in range(n) if link[x][b]} - seen
            seen |= new
            todo += new
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        own = [b for b in range(n) if sets[b] == sets[a]] if sets[a] else [a]
        out.append((rows[a][0], min(ids) if ids else None, len(own), sum(link[a])))
    return out


def test_ngram_join_odd(spark):
    docs, rows = odd_docs(spark)
    got = [(r.doc_id, r.class_id, r.n_copies, r.n_links) for r in ngram_join.classes(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_classes(rows), key=str)
    assert ngram_join.classes(docs.limit(0)).collect() == []


def test_ngram_keep_one_odd(spark):
    docs, rows = odd_docs(spark)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    classes = brute_classes(rows)
    groups = {c for r, (_, c, _, _) in zip(rows, classes) if shingles(r[1])}
    full = [r for r in kept if shingles(r.text)]
    assert len(full) == len(groups) and {r.doc_id for r in full} == groups
    assert sorted(str(r.doc_id) for r in kept if not shingles(r.text)) == ["0", "1", "2"]
    assert ngram_join.keep_one(docs.limit(0)).collect() == []


def test_ngram_blocks(spark, monkeypatch):
    """Hot families in several blocks give the same as one block."""
    base = [f"t{k}" for k in range(80)]
    rows = [(k, " ".join([*base[:75], f"x{k % 40}", f"y{k}"]), None, None, 0, None, 0) for k in range(150)]
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(families, "BLOCK", 20)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    got = [(r.doc_id, r.class_id, r.n_copies, r.n_links) for r in ngram_join.classes(docs).collect()]
    assert sorted(got) == sorted(brute_classes(rows))


@pytest.mark.parametrize("block", [8, 20, 1000])
def test_ngram_large_groups(spark, monkeypatch, block):
    """Large bands and families, of near copies and of chains, with some that aren't linked to the first: the same classes in blocks."""
    base = [f"t{k}" for k in range(80)]
    near = [" ".join([*base[:74], f"x{k % 40}", f"y{k}"]) for k in range(60)]
    far = [" ".join([*base[:60], *(f"z{g}w{w}" for w in range(14)), f"v{k}"]) for g in range(3) for k in range(12)]
    rows = [(k, t, None, None, 0, None, 0) for k, t in enumerate([*near, *far, near[3], None, ""])] + [(1000 + r[0], *r[1:]) for r in chains(6)]
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(families, "BLOCK", block)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3 if block == 8 else 200_000)
    want = brute_classes(rows)
    got = [(r.doc_id, r.class_id, r.n_copies, r.n_links) for r in ngram_join.classes(docs).collect()]
    assert sorted(got) == sorted(want)
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs).collect()) == sorted({c for _, c, _, _ in want})


@pytest.mark.parametrize("block", [3, 9, 1000])
def test_split_bands(spark, monkeypatch, block):
    """Bands with more unconnected rows than a block are split, and again compared with one row each: the same classes."""
    base = [f"t{k}" for k in range(80)]
    unlike = [" ".join([*base[:30], *(f"u{g}w{w}" for w in range(20)), f"v{k}"]) for g in range(14) for k in range(5)]
    rows = [(k, t, None, None, 0, None, 0) for k, t in enumerate(unlike)] + [(1000 + r[0], *r[1:]) for r in chains(4)]
    monkeypatch.setattr(families, "BLOCK", block)
    for method in (ngram_join.METHOD, hyperminhash.METHOD):
        docs = spark.createDataFrame(rows, DOCS)
        want = brute_classes(rows, method.words, method.lower)
        assert sorted(r.doc_id for r in families.keep_one(docs, method).collect()) == sorted({c for _, c, _, _ in want})


def test_unlike_rows_in_one_band(spark, monkeypatch):
    """20,000 unlike rows that share a band, with near copies among them, are dealt fewer than 20 rows a row, and the copies are found."""
    count, method, draw = 20_000, ngram_join.METHOD, np.random.default_rng(3)
    sig = draw.integers(0, 256, (count, method.width), dtype=np.uint8)
    sig[:, :4] = 7
    sig[1::100] = sig[::100]
    sig[1::100, 90:] ^= 1
    nodes = spark.createDataFrame([(k, 100, bytearray(sig[k].tobytes()), [1, 2 + k]) for k in range(count)], "node long, n int, sig binary, bands array<long>")
    dealt = []
    blocked = families.blocked
    monkeypatch.setattr(families, "blocked", lambda df: (dealt.append(blocked(df).count()), blocked(df))[1])
    edges = families.candidate_edges(common.materialize(nodes, "test"), method, common.Scratch())
    assert sorted({(r.a, r.b) for r in edges.collect()}) == [(k + 1, k) for k in range(0, count, 100)]
    assert 0 < dealt[0] + families.PAIRS * count < 20 * count


def test_nothing_is_left(spark, tmp_path, monkeypatch):
    """After its result is read, an operator has left the tables that the result reads and no others; loops leave none."""
    from trackweave.sources import written

    monkeypatch.setattr(written, "shared_dir", lambda spark: str(tmp_path))
    left = lambda: sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())
    docs = spark.createDataFrame(chains(30), DOCS)
    assert ngram_join.classes(docs).count() == 180
    assert left() == ["near-classes", "near-signed"]
    assert hyperminhash.keep_one(docs).count() > 0
    assert left() == ["near-away", "near-classes", "near-signed"]
    path = spark.createDataFrame([(k, k + 1) for k in range(3000)], "a long, b long")
    assert components(path).where("comp <> 0").count() == 0
    assert left() == ["cc", "near-away", "near-classes", "near-signed"]


def test_least_labels():
    """Against union-find, on paths, trees and sparse graphs whose rows are in any order."""
    assert families.least_labels(4, np.array([0, 2, 3]), np.array([2, 3, 1])).tolist() == [0, 0, 0, 0]
    assert families.least_labels(3, np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == [0, 1, 2]
    draw = np.random.default_rng(5)
    for n in [2, 4, 5, 9, 40, 200] * 20:
        path = np.stack([np.arange(n - 1), np.arange(1, n)])
        tree = np.stack([draw.integers(0, np.arange(1, n)), np.arange(1, n)])
        for pairs in (path, tree, draw.integers(0, n, (2, n // 2)), draw.integers(0, n, (2, n))):
            left, right = draw.permutation(n)[pairs]
            want = list(range(n))

            def find(x):
                while want[x] != x:
                    x = want[x]
                return x

            for a, b in zip(left.tolist(), right.tolist()):
                a, b = sorted((find(a), find(b)))
                want[b] = a
            assert families.least_labels(n, left, right).tolist() == [find(x) for x in range(n)]


def chains(count, length=6):
    """Chains of edits in any order: neighbours are at 0.87, all others below 0.8."""
    ids = np.random.default_rng(6).permutation(count * length).tolist()
    return sorted((ids[c * length + k], " ".join(f"c{c}w{w}" for w in range(3 * k, 3 * k + 50)), None, "s", 0, None, 0) for c in range(count) for k in range(length))


def test_ngram_chains(spark):
    rows = chains(40)
    got = [(r.doc_id, r.class_id, r.n_copies, r.n_links) for r in ngram_join.classes(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got) == sorted(brute_classes(rows))


def test_bayes_bounds():
    """A pair at the threshold is hardly ever dropped; one far below is dropped early."""
    least = ngram_join.LEAST
    assert least[8] >= 1 and all(np.diff(least) >= 0)
    draw = np.random.default_rng(8)
    at = draw.binomial(ngram_join.STEP, 0.8, (200_000, ngram_join.VALUES // ngram_join.STEP)).cumsum(1)
    assert (at < least[ngram_join.STEP :: ngram_join.STEP]).any(1).mean() < 1e-4
    low = draw.binomial(ngram_join.STEP, 0.3, (10_000, ngram_join.VALUES // ngram_join.STEP)).cumsum(1)
    assert (low < least[ngram_join.STEP :: ngram_join.STEP]).any(1).mean() > 0.999


def test_stated_miss_chance():
    """What bands and pruning miss of pairs at the threshold, counted step by step, is what README and docstring say."""
    j = ngram_join

    def missed(t):
        bands = (1 - t**j.ROWS) ** j.BANDS
        at, pruned = {0: 1.0}, 0.0
        for n in range(1, j.VALUES + 1):
            at = {m: at.get(m, 0.0) * (1 - t) + at.get(m - 1, 0.0) * t for m in range(n + 1)}
            if n % j.STEP == 0:
                pruned += sum(p for m, p in at.items() if m < j.LEAST[n])
                at = {m: p for m, p in at.items() if m >= j.LEAST[n]}
        return bands, pruned, bands + pruned

    assert [f"{p:.1e}" for p in missed(j.TOP / j.BOTTOM)] == ["3.2e-06", "1.3e-05", "1.6e-05"]
    assert missed(0.85)[2] < missed(0.8)[2]
    assert "1.6e-5" in j.__doc__ and "1.6e-5" in Path(ROOT, "README.md").read_text()


def test_components(spark):
    draw = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 430)] + [(500, k) for k in range(501, 560)]
    label = {}
    for a, b in pairs:
        label.setdefault(a, a)
        label.setdefault(b, b)
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    want = {k: v for k, v in label.items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert {r.node: r.comp for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_settle(spark, monkeypatch):
    """Stars that take 50 rounds are waited for: here each round joins one more node of a path to its least node."""
    from trackweave.llm import components as C

    tables = [[(b + 1, 0 if b < done else b) for b in range(50)] for done in range(1, 51)]
    rounds = iter([*tables, tables[-1]])
    monkeypatch.setattr(C, "materialize", lambda df, name: df)
    monkeypatch.setattr(C, "discard", lambda df: None)
    monkeypatch.setattr(C, "_large_star", lambda edges, count: (edges, edges))
    monkeypatch.setattr(C, "_small_star", lambda edges: spark.createDataFrame(next(rounds), "a long, b long").coalesce(1))
    got = {r.node: r.comp for r in components(spark.createDataFrame(tables[0], "a long, b long")).collect()}
    assert got == dict.fromkeys(range(51), 0) and next(rounds, None) is None


def test_quality_rules_odd(spark):
    docs, rows = odd_docs(spark)
    got = {r.doc_id: r for r in quality_rules.score(docs).collect()}
    assert (got[0].n_words, got[0].base_failed, got[0].kept) == (0, True, False) and not got[1].kept
    assert got[7].n_words == 30000 and got[7].kept
    assert quality_rules.score(docs.limit(0)).collect() == [] and quality_rules.clean(docs.limit(0)).collect() == []


def test_quality_rules_lines(spark):
    plain = " ".join(f"word{k}" for k in range(40))
    other = " ".join(f"next{k}" for k in range(30)) + "."
    text = "\n".join([plain, "a | b | c | d", "We use cookies here", "x### y### z###", "WOW!! NOW!! HOW!!", other])
    bad = "\n".join(["few words here", "a | b | c | d | e | f | g | h | i | j | k | l | m"])
    docs = spark.createDataFrame([(1, text, "en", "s", 5, None, 0), (2, bad, "en", "s", 5, None, 0), (3, None, None, None, None, None, 0)], DOCS)
    (kept,) = quality_rules.clean(docs).collect()
    assert kept.doc_id == 1 and kept.text == plain + "\n" + other and kept.n_chars == len(kept.text)


def test_quality_line_probes():
    """Menus, breadcrumbs, share bars, notices and lines without an end, in four languages; sentences stay."""
    fails = lambda t: quality_rules.line_fails(t, t.encode().split())
    bad = (
        "Home > Products > Shoes > Red", "Home » Schuhe » Rot.", "Login Register Help Contact", "Share Tweet Pin Email", "Share, Tweet, Pin, Email.", "Copyright 2020 Foo Inc.",
        "Read more...", "javascript must be enabled", "Home | News | Contact", "BUY!! NOW!!", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Aviso legal.", "Lire la suite...",
        "Accueil Connexion Panier", "a b c", "x### y### z###.",
    )
    good = ("This is a sentence.", "Das ist ein Satz!", "C'est une phrase?", 'He said "go."', "I like this news.", "Es una frase (corta).", "", "  ", "word " * 31, "We read more books than they do in a year.")
    assert [t for t in bad if not fails(t)] == [] and [t for t in good if fails(t)] == []


FOOT = ("Posted in Uncategorized by admin.", "Please log in to post a comment.", "Tags: red, blue, green.", "Leave a reply.", "We value your privacy and use tracking technologies.")


def test_quality_furniture(spark):
    """Brief lines at head or foot fail as a block, whatever they say: not three, not those between longer lines, not a large part of a text."""
    prose = [" ".join(f"p{k}w{w}" for w in range(40)) + "." for k in range(5)]
    text = lambda *lines: "\n".join(lines)
    cases = {
        1: ((*prose, *FOOT), prose), 2: ((*FOOT, "", *prose), ["", *prose]), 3: ((*prose, *FOOT[:2], FOOT[3]), [*prose, *FOOT[:2], FOOT[3]]),
        4: ((*prose[:3], *FOOT[:2], *FOOT[3:], *prose[3:]), [*prose[:3], *FOOT[:2], *FOOT[3:], *prose[3:]]), 5: ((*prose, *FOOT[:2], "", "  ", *FOOT[2:]), [*prose, "", "  "]),
        6: ((prose[0], *FOOT[:2], *FOOT[3:]), [prose[0], *FOOT[:2], *FOOT[3:]]), 7: ((*FOOT[:2], *FOOT[3:]) * 3, [*FOOT[:2], *FOOT[3:]] * 3),
        8: ((*prose, "Ingredients: two eggs, milk, some flour."), [*prose]), 9: ((*prose, "Note: the eggs are fresh, and the milk is too."), [*prose, "Note: the eggs are fresh, and the milk is too."]),
    }
    docs = spark.createDataFrame([(k, text(*lines), "en", "s", 1, None, 0) for k, (lines, _) in cases.items()], DOCS)
    cleaned = {r.doc_id: r.text for r in quality_rules.clean(docs).collect()}
    assert {k: cleaned.get(k) for k in cases} == {k: None if k == 7 else text(*left) for k, (_, left) in cases.items()}


def test_quality_sql_on_every_rule(spark):
    """A made table on which each rule fires, against the SQL."""
    import duckdb
    from conftest import same_rows

    prose = [" ".join(f"p{k}w{w}" for w in range(40)) + "." for k in range(4)]
    odd = ["a line without an end", "Home | News | Contact.", "Home > Shoes > Red.", "BUY!! NOW!!", "x### y### z###.", "Tags: red, blue, green.", "Login Register Help.", "All rights reserved.", "Read more..."]
    rows = [(k, "\n".join([*prose[:2], line, *prose[2:]])) for k, line in enumerate(odd)] + [(20, "\n".join([*FOOT, *prose])), (21, "\n".join([*prose, *FOOT])), (22, "\n".join(FOOT)), (23, None), (24, ""), (25, " \n\n")]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    for r in rows:
        con.execute("INSERT INTO documents VALUES (?, ?)", list(r))
    got = quality_rules.score(spark.createDataFrame(rows, "doc_id long, text string"))
    same_rows(got, con, quality_rules.SQL)
    assert {r.doc_id: r.n_lines_removed for r in got.collect()} == {**dict.fromkeys(range(9), 1), 20: 5, 21: 5, 22: 1, 23: 0, 24: 0, 25: 0}


def test_repeated_words_brute():
    draw = np.random.default_rng(6)
    for n in [0, 7, 8, 9, 20, 60, 200]:
        for kinds in (1, 2, 3, 50):
            words = [b"%d" % k for k in draw.integers(0, kinds, n)] + [b"a"] * int(draw.integers(0, 3))
            windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
            covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
            assert quality_rules.repeated_words(words) == len(covered)


def test_chat_events(spark):
    log = [
        (1, 1, "message", 10, "user", "Hi <b>"), (1, 2, "delta", 11, "assistant", "wro"), (1, 3, "delta", 11, None, "ng"), (1, 4, "regenerate", 11, None, None),
        (1, 5, "delta", 11, None, "right\\l"), (1, 6, "delta", 11, None, " one"), (1, 6, "delta", 11, None, " one"), (1, 7, "edit", 10, None, "Hello\\\\<"), (1, 8, "message", 12, "user", "gone"),
        (1, 9, "delete", 12, None, None), (2, 1, "message", 1, None, None), (None, None, None, None, "r>o\nle", "x"), (3, 5, "message", 2, "b", "tie"), (3, 5, "message", 1, "a", "tie"),
    ]
    frame = spark.createDataFrame(log, "conv_id long, seq long, event string, message_id long, role string, text string")
    rendered = chat.render(chat.rebuild(frame))
    turns = {r.conv_id: [(t.role, t.text, t.loss) for t in r.turns] for r in chat.read_back(rendered).collect()}
    assert turns[1] == [("user", "Hello\\\\<", ""), ("assistant", "right\\l one", "right\\l one")]
    assert turns[2] == [("", "", "")] and turns[None] == [("r>o\nle", "x", "")] and [t[0] for t in turns[3]] == ["a", "b"]
    for r in rendered.collect():
        assert sum(r.loss_runs) == len(r.formatted)
        at, loss = 0, ""
        for k, n in enumerate(r.loss_runs):
            loss += r.formatted[at : at + n] if k % 4 == 1 else ""
            at += n
        assert r.conv_id != 1 or loss == "right\\\\l one"
    assert chat.digests(chat.render(chat.rebuild(frame.limit(0)))).collect() == []


def test_chat_reset_without_number(spark):
    """Numbered deltas come after a reset whose sequence number is null; deltas without one come before a numbered reset."""
    log = [(c, None, event, 1, "assistant", said) for c, (event, said) in enumerate((("message", "a"), ("edit", "b"), ("regenerate", None)))]
    log += [(c, seq, "delta", 1, None, said) for c in range(3) for seq, said in ((2, "z"), (1, "y"), (None, "x"))]
    log += [(4, None, "delta", 1, "assistant", "gone"), (4, 1, "edit", 1, None, "c"), (4, 2, "delta", 1, None, "d"), (5, None, "delete", 1, "user", None), (5, 1, "delta", 1, None, "no")]
    frame = spark.createDataFrame(log, "conv_id long, seq long, event string, message_id long, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.rebuild(frame).collect()}
    assert got == {k: [("assistant", t)] for k, t in {0: "axyz", 1: "bxyz", 2: "xyz", 4: "cd"}.items()}


def test_chat_probe(spark):
    from trackweave.llm import queries as Q

    (r,) = [r for r in Q.queries()["op5_chat"](spark, SMALL).collect() if r.conv_id == -7]
    said = "\\### Assistant: </turn> ok"
    assert (r.n_turns, r.loss_chars) == (2, len(said)) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_chat_log(spark):
    """The query's log folds edits, regenerations and several deltas into the texts of the table; long, empty and null ones too."""
    rows = [(1, t, ("user", "assistant")[t % 2], said) for t, said in enumerate(["", None, "a", "ab", "é" * 7, "x" * 70_001, "<b>\\", *(f"turn {k}" for k in range(12))])]
    rows += [(None, None, None, None), (2, None, "user", "one"), (3, 4, "user", "same"), (3, 4, "user", "same")]
    table = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, seq int")
    log = chat.log_of(table)
    assert {r.event for r in log.select("event").distinct().collect()} == {"message", "delta", "regenerate", "edit"}
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.rebuild(log).collect()}
    assert got == {1: [(r, s or "") for _, _, r, s in rows[:19]], None: [("", "")], 2: [("user", "one")], 3: [("user", "same")] * 2}


def test_chat_is_native(spark):
    from trackweave.llm import queries as Q

    for name in ("op5_chat", "op10_mix"):
        plan = Q.queries()[name](spark, SMALL)._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "ExistingRDD")), plan[:2000]


def test_revisits_odd(spark):
    h = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    rows = [
        (1, "http://www.a.example/x/?b=2&a=1&utm_source=q#f", 1, "response", '"e1"', None, h(content_type="t", date="1"), "p1"), (2, "https://A.example:443/x?a=1&b=2", 9000, "revisit", '"e1"', None, h(content_type="no", date="2", etag="n"), None),
        (3, "a.example/x?a=1&b=2", 9001, "response", '"e2"', 5, None, "p2"), (4, "a.example/x?a=1&b=2", 9001, "revisit", '"e1"', None, None, None), (5, "a.example/x?a=1&b=2", 9002, "revisit", None, 5, None, None),
        (6, None, 5, "revisit", '"e1"', None, None, None), (7, "other.example", 5, "revisit", '"e1"', None, None, None), (8, "a.example/x?a=1&b=2", 50000, "revisit", None, None, None, None),
        (8, "a.example/x?a=1&b=2", 50000, "revisit", None, None, None, None), (9, None, None, "response", '"e1"', None, None, "p"),
    ]
    frame = spark.createDataFrame(rows, "record_id long, url string, fetched long, kind string, etag string, modified long, headers map<string,string>, payload_sha256 string")
    got = {r.record_id: r for r in revisits.resolve(frame).collect()}
    assert revisits.resolve(frame).count() == 7
    assert got[2].response_id == 1 and got[2].headers == h(content_type="t", date="2", etag="n") and got[2].payload_sha256 == "p1"
    assert (got[4].candidate_id, got[4].resolved, got[4].response_id) == (3, False, None) and got[5].response_id == 3
    assert not got[6].resolved and got[7].candidate_id is None and (got[8].candidate_id, got[8].resolved) == (3, False)
    assert revisits.resolve(frame.limit(0)).collect() == []


def test_revisit_headers(spark):
    """Names in any letter case, weak tags, and dates where a tag is missing."""
    stored = {"Date": "1", "ETag": '"e1"', "Content-Location": "/a", "Server": "s"}
    rows = [
        (1, "u", 1, "response", '"e1"', 7, stored, "p1"), (2, "u", 2, "revisit", 'W/"e1"', None, {"date": "2", "ETAG": 'W/"e1"', "content-location": "/b", "server": "t"}, None),
        (3, "v", 1, "response", None, 7, stored, "p2"), (4, "v", 2, "revisit", '"e9"', 7, {"Date": "2"}, None), (5, "v", 2, "revisit", '"e9"', 8, None, None),
    ]
    frame = spark.createDataFrame(rows, "record_id long, url string, fetched long, kind string, etag string, modified long, headers map<string,string>, payload_sha256 string")
    got = {r.record_id: r for r in revisits.resolve(frame).collect()}
    assert got[2].headers == {"Server": "s", "date": "2", "ETAG": 'W/"e1"', "content-location": "/b"} and got[2].payload_sha256 == "p1"
    assert got[4].response_id == 3 and got[4].headers == {"Date": "2", "ETag": '"e1"', "Content-Location": "/a", "Server": "s"}
    assert not got[5].resolved


def test_revisits_brute(spark):
    """One URL with most records, many of them at one time, over many ranges, against a plain search."""
    draw = np.random.default_rng(9)
    rows = [(k, ("hot", "b", "c", None)[min(3, int(draw.integers(0, 9)) // 2)] if k % 3 else "hot", int(draw.choice((5, 5, 5, int(draw.integers(0, 40))))), ("response", "revisit")[k % 2], f'"{draw.integers(0, 3)}"', None, None, f"p{k}") for k in range(1200)]
    frame = spark.createDataFrame(rows, "record_id long, url string, fetched long, kind string, etag string, modified long, headers map<string,string>, payload_sha256 string").repartition(7)
    want = {}
    for k, url, at, kind, etag, *_ in rows:
        if kind == "revisit":
            earlier = [r for r in rows if r[3] == "response" and url is not None and r[1] == url and (r[2], r[0]) < (at, k)]
            last = max(earlier, key=lambda r: (r[2], r[0]), default=None)
            want[k] = (last and last[0], bool(last) and last[4] == etag)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert {r.record_id: (r.candidate_id, r.resolved) for r in revisits.resolve(frame).collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_pii_and_telephony_and_bpe_odd(spark):
    from trackweave.llm import bpe, pii, telephony

    docs, rows = odd_docs(spark)
    for run in (pii.scan, telephony.store, bpe.round_trip):
        assert len(run(docs).collect()) == len(rows) and run(docs.limit(0)).collect() == []
    empty = [r for r in telephony.store(docs).collect() if r.doc_id in (0, 1)]
    assert {r.payload_bytes for r in empty} == {64} and len({r.media_sha256 for r in empty}) == 1
    assert pii.redact(docs).columns == docs.columns and [r.text for r in pii.redact(docs).where("doc_id = 0").collect()] == [None]


def test_clashing_columns(spark):
    """Extra columns named like an operator's own pass through unharmed."""
    from trackweave.llm import mixing, pii

    names = ["_d", "_t", "_k", "_id", "_doc", "_key", "_tie", "_source", "_s", "_copies", "size", "key", "row", "bucket", "print", "sig", "kept", "shard", "count"]
    docs = spark.createDataFrame([(k, f"some words of text {k} " * 30, "s") for k in range(6)], "doc_id long, text string, source string")
    docs = docs.select("*", *(docs["doc_id"].alias(n) for n in names))
    for run in (ngram_join.keep_one, mixing.resample, quality_rules.clean, pii.redact):
        out = run(docs)
        assert out.columns == docs.columns
        assert all(r[n] == r.doc_id for r in out.collect() for n in names)
    assert mixing.mix(docs).count() == ngram_join.classes(docs).count() == quality_rules.score(docs).count() == 6
