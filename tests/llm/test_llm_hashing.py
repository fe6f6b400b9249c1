"""Word and shingle hashes against words cut out one by one."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trackweave.llm.hashing import word_hashes
from trackweave.llm.families import overlaps, shingle_sets
from trackweave.llm.ngram_join import METHOD
from trackweave.llm.quality_rules import judge

TEXT = st.one_of(st.none(), st.text(alphabet="ab é\t\n\x0b\r\x1c\x85 　\U0001f642", max_size=60), st.text(max_size=30))


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_words(texts):
    hashes, at = word_hashes(texts)
    words = [(t or "").encode().split() for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=2, max_size=5))
def test_shingles(texts):
    sets = shingle_sets(texts, METHOD)
    plain = []
    for t in texts:
        w = (t or "").encode().split()
        plain.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    assert [len(s) for s in sets] == [len(p) for p in plain]
    full = [k for k, p in enumerate(plain) if p]
    if len(full) > 1:
        both = overlaps([sets[k] for k in full])
        assert all(both[i, j] == len(plain[a] & plain[b]) for i, a in enumerate(full) for j, b in enumerate(full) if a != b)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_counts(text):
    n, chars, symbols, dup, repeat, failed, kept, cleaned, removed = judge(text)
    words = (text or "").encode().split()
    assert n == len(words) and chars == sum(len(w.decode()) for w in words) and symbols == sum(c in "#*$%&|<>" for c in text or "")
    assert failed == (n < 20 or 100 * repeat > 30 * n) and not (failed and kept) and (removed or cleaned == text)
