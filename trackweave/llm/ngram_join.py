"""N-gram Jaccard self-join with Bayesian candidate pruning: documents whose sets of five-word shingles are at least 0.8 alike.

Each document's signature is 96 MinHash values. Documents that share a band of 4 values (24 bands: a pair at 0.8 is missed with a chance of
3e-6) are compared value by value, 8 at a time: with a uniform prior, a pair is dropped once the posterior chance of a similarity of 0.8 or more
is below 1e-6. Over its 12 steps this drops a pair at 0.8 with a chance of 1.3e-5, so bands and pruning together miss one with a chance of
1.6e-5, unless other pairs bring both into one family. `families` has the rest: hot bands, exact verification and classes.

Defined results: a text of 1 to 4 words is one shingle of all its words; null texts and texts without words have no shingles, no links and a
class of their own; a null doc_id never names a class that has another; rows that repeat are copies of each other; an empty
table gives no rows; other columns are not read."""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm import families
from trackweave.llm.families import BOTTOM, TOP, Method, band_keys, sized

BANDS, ROWS = 24, 4
VALUES, STEP, TOLERANCE = BANDS * ROWS, 8, 1e-6
_rng = np.random.default_rng(97)
FACTORS = (_rng.integers(0, 1 << 31, VALUES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
SHIFTS = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)


def least_matches(threshold: float = TOP / BOTTOM, tolerance: float = TOLERANCE) -> np.ndarray:
    """For each n compared values the fewest matches at which P(similarity >= threshold | matches) reaches the tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is P(Binomial(n + 1, threshold) <= m)."""
    out = np.zeros(VALUES + 1, np.int32)
    for n in range(1, VALUES + 1):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


LEAST = least_matches()


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A byte of each MinHash value, and a 64-bit hash of each band."""
    joined = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    values = np.empty((len(sets), VALUES), np.uint32)
    for k in range(VALUES):
        values[:, k] = np.minimum.reduceat(joined * FACTORS[k] + SHIFTS[k], at)
    return ((values >> np.uint32(13)) & np.uint32(255)).astype(np.uint8), band_keys(values, BANDS)


def plausible(sig: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that sizes and the incremental comparison of MinHash values leave."""
    left, right = sized(n, left, right)
    matches = np.zeros(len(left), np.int32)
    for at in range(0, VALUES, STEP):
        matches += (sig[left, at : at + STEP] == sig[right, at : at + STEP]).sum(1, dtype=np.int32)
        keep = matches >= LEAST[at + STEP]
        left, right, matches = left[keep], right[keep], matches[keep]
        if not len(left):
            break
    return left, right


METHOD = Method(words=5, width=VALUES, value=1, signatures=signatures, plausible=plausible)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id that links reach), n_copies (documents of an equal set, itself included), n_links (documents at 0.8 or more)."""
    signed, nodes, _ = families.join(docs, METHOD)
    both = signed.select("doc_id", "tkey", "print").join(nodes, "print", "left")
    alone = F.col("print").isNull()
    return both.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("n_copies"), F.when(alone, F.lit(0)).otherwise(F.col("copies") - 1 + F.col("links")).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those that link to a kept one's class: of each class the one of least doc_id stays."""
    return families.keep_one(docs, METHOD)


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, sh FROM (SELECT rid, array_to_string(ws[p : p + 4], ' ') AS sh
  FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM d WHERE len(ws) > 0))),
n AS (SELECT rid, count(*) AS n, md5(string_agg(sh, chr(10) ORDER BY sh)) AS fp FROM s GROUP BY rid),
k AS (SELECT fp, min(rid) AS node, any_value(n) AS n, count(*) AS copies FROM n GROUP BY fp),
sk AS (SELECT k.node, k.n, s.sh FROM k JOIN s ON s.rid = k.node),
c AS (SELECT x.node AS a, y.node AS b, count(*) AS c, any_value(x.n) AS na, any_value(y.n) AS nb FROM sk x JOIN sk y ON x.sh = y.sh AND x.node <> y.node GROUP BY 1, 2),
e AS (SELECT a, b FROM c WHERE 5 * c >= 4 * (na + nb - c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
doc AS (SELECT d.rid, d.doc_id, k.node, k.copies FROM d LEFT JOIN n USING (rid) LEFT JOIN k USING (fp)),
m AS (SELECT node, min(doc_id) AS least FROM doc WHERE node IS NOT NULL GROUP BY node),
cl AS (SELECT r.a AS node, min(m.least) AS least FROM r JOIN m ON m.node = r.b GROUP BY 1),
l AS (SELECT e.a AS node, sum(k.copies) AS links FROM e JOIN k ON k.node = e.b GROUP BY 1)
SELECT doc.doc_id, CASE WHEN doc.node IS NULL THEN doc.doc_id ELSE least(m.least, cl.least) END AS class_id,
  CAST(coalesce(doc.copies, 1) AS BIGINT) AS n_copies, CAST(coalesce(doc.copies - 1 + coalesce(l.links, 0), 0) AS BIGINT) AS n_links
FROM doc LEFT JOIN m ON m.node = doc.node LEFT JOIN cl ON cl.node = doc.node LEFT JOIN l ON l.node = doc.node
"""
