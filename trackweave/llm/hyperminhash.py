"""Near-duplicate documents by HyperMinHash: sets of two-word shingles, at least 0.8 alike, A-Z taken as a-z.

Each shingle's hash falls into one of 128 buckets, and a bucket keeps a compressed register of its least hash: the count of leading zeros and 10
bits of mantissa, 16 bits together. An empty bucket takes the register of the first full one in an order of its own, so that small sets
fill all registers too. 32 bands of 4 registers give candidates: a pair at 0.8 shares none with a chance of 5e-8. Their similarity is
estimated from the share of equal registers, less what sets of such sizes without a common shingle would share by collision, and pairs estimated below
0.62 are dropped: at 0.8 that is over five standard deviations, a chance of about 1e-6. Pairs of small sets, whose registers hang on few shingles, are
all kept. `families` has the rest: hot bands, exact verification of full sets, and connected components.

Defined results: a text of one word is one shingle; null texts and texts without words have no shingles, no links and a component of their
own; a null doc_id never names a component that has another, and where all are null the row counts as kept; rows that repeat are copies of each
other, all of one component; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm import families
from trackweave.llm.families import BOTTOM, TOP, Method, band_keys, sized
from trackweave.llm.hashing import mix

INDEX, MANTISSA, BANDS = 7, 10, 32
BUCKETS = 1 << INDEX
MARGIN, SMALL = 0.18, 16
#: Bits of a hash beyond its bucket that are looked at; they fit into a float without rounding.
BITS = 53
#: The order in which an empty bucket looks at the others.
PROBES = np.stack([np.random.default_rng(1000 + b).permutation(np.delete(np.arange(BUCKETS), b)) for b in range(BUCKETS)])
NONE = np.uint64(1 << BITS)


def compressed(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of numbers of BITS bits, as one value of 16 bits."""
    zeros = BITS - np.frexp(least.astype(np.float64))[1]
    zeros[least == 0] = BITS
    top = least << zeros.astype(np.uint64)
    mantissa = (top >> np.uint64(BITS - 1 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each set; none of the sets is empty."""
    hashes = mix(np.concatenate(sets) ^ np.uint64(0xA0761D6478BD642F))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    least = np.full(len(sets) * BUCKETS, NONE)
    np.minimum.at(least, owner * BUCKETS + (hashes >> np.uint64(64 - INDEX)).astype(np.int64), (hashes >> np.uint64(64 - INDEX - BITS)) & (NONE - np.uint64(1)))
    least = least.reshape(len(sets), BUCKETS)
    row, bucket = np.nonzero(least == NONE)
    out = least.copy()
    for step in range(BUCKETS - 1):
        if not len(row):
            break
        found = least[row, PROBES[bucket, step]]
        full = found != NONE
        out[row[full], bucket[full]] = found[full]
        row, bucket = row[~full], bucket[~full]
    return compressed(out)


def collision_table(steps: int = 48) -> np.ndarray:
    """Chance that a register of two sets without a common shingle is equal, by the sets' shingles in a bucket: 1, 2 ** 0.5, 2, ..."""
    per_bucket = 2.0 ** (np.arange(steps) / 2)
    zeros, mantissa = np.divmod(np.arange((BITS - MANTISSA) << MANTISSA), 1 << MANTISSA)
    low = 2.0 ** -(zeros + 1) * (1 + mantissa / (1 << MANTISSA))
    high = low + 2.0 ** -(zeros + 1) / (1 << MANTISSA)
    # The chance that the least of t hashes lies in a register's interval.
    chance = np.stack([np.exp(t * np.log1p(-low)) - np.where(high < 1, np.exp(t * np.log1p(-np.minimum(high, 1 - 1e-16))), 0) for t in per_bucket])
    return chance @ chance.T


COLLISIONS = collision_table()


def estimate(equal: np.ndarray, left_n: np.ndarray, right_n: np.ndarray) -> np.ndarray:
    """Similarity from the number of equal registers, corrected for collisions of sets of these sizes."""
    at = lambda n: np.clip(np.rint(2 * np.log2(np.maximum(n / BUCKETS, 1))), 0, len(COLLISIONS) - 1).astype(np.int64)
    by_chance = COLLISIONS[at(left_n), at(right_n)]
    return np.maximum(0, (equal / BUCKETS - by_chance) / (1 - by_chance))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values = registers(sets)
    return values.view(np.uint8), band_keys(values, BANDS)


def plausible(sig: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose sizes and estimated similarity allow a link."""
    left, right = sized(n, left, right)
    values = sig.view(np.uint16)
    keep = np.zeros(len(left), bool)
    for at in range(0, len(left), 1 << 16):
        a, b = left[at : at + (1 << 16)], right[at : at + (1 << 16)]
        equal = (values[a] == values[b]).sum(1)
        keep[at : at + len(a)] = (estimate(equal, n[a], n[b]) >= TOP / BOTTOM - MARGIN) | (np.maximum(n[a], n[b]) <= SMALL)
    return left[keep], right[keep]


METHOD = Method(words=2, width=2 * BUCKETS, value=2, signatures=signatures, plausible=plausible, lower=True)


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach), kept (whether it is the row's own)."""
    signed, nodes, _ = families.join(docs, METHOD, count_links=False)
    both = signed.select("doc_id", "n", "print").join(nodes.select("print", "keeper"), "print", "left")
    least = F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id"))
    return both.select("doc_id", F.col("n").cast("long").alias("n_shingles"), least.alias("component_id"), F.col("doc_id").eqNullSafe(least).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those that link to a kept one's component: of each component the one of least doc_id stays."""
    return families.keep_one(docs, METHOD)


#: Candidates come from the rarest shingles of each set, of which two sets at 0.8 share one; pairs are counted on full sets.
SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, sh FROM (SELECT rid, array_to_string(ws[p : p + 1], ' ') AS sh
  FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 1, 1) + 1)) AS p FROM d WHERE len(ws) > 0))),
n AS (SELECT rid, count(*) AS n, md5(string_agg(sh, chr(10) ORDER BY sh)) AS fp FROM s GROUP BY rid),
k AS (SELECT fp, min(rid) AS node, any_value(n) AS n FROM n GROUP BY fp),
f AS (SELECT sh, count(*) AS df FROM s GROUP BY sh),
sk AS (SELECT k.node, k.n, s.sh, row_number() OVER (PARTITION BY k.node ORDER BY f.df, s.sh) AS pos FROM k JOIN s ON s.rid = k.node JOIN f USING (sh)),
p AS (SELECT node, n, sh FROM sk WHERE pos <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT x.node AS a, y.node AS b, x.n AS na, y.n AS nb FROM p x JOIN p y ON x.sh = y.sh AND x.node < y.node AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
o AS (SELECT c.a, c.b, any_value(c.na) AS na, any_value(c.nb) AS nb, count(*) AS c FROM c JOIN sk x ON x.node = c.a JOIN sk y ON y.node = c.b AND y.sh = x.sh GROUP BY 1, 2),
h AS (SELECT a, b FROM o WHERE 100 * c >= 80 * (na + nb - c)),
e AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
doc AS (SELECT d.rid, d.doc_id, n.n, k.node FROM d LEFT JOIN n USING (rid) LEFT JOIN k USING (fp)),
m AS (SELECT node, min(doc_id) AS least FROM doc WHERE node IS NOT NULL GROUP BY node),
cl AS (SELECT r.a AS node, min(m.least) AS least FROM r JOIN m ON m.node = r.b GROUP BY 1),
t AS (SELECT doc.doc_id, coalesce(doc.n, 0) AS n_shingles, CASE WHEN doc.node IS NULL THEN doc.doc_id ELSE least(m.least, cl.least) END AS component_id
  FROM doc LEFT JOIN m ON m.node = doc.node LEFT JOIN cl ON cl.node = doc.node)
SELECT doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM t
"""
