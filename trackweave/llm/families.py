"""Near-duplicate groups of documents by the Jaccard similarity of their sets of word shingles: what the operators of this kind share.

A `Method` gives each set a signature and band keys, and says which pairs of signatures are plausible. From there on:

1. Each document gets its shingle hashes, a fingerprint of the set, signature and bands; equal sets become one node with copies.
2. Nodes that share a band are compared by signature. The nodes of a large band are first compared with one of them, which connects near
   copies without pairs; those that aren't connected to it then meet all others in pairs of blocks. Where they are more than a block themselves,
   the band is first split: each of its nodes goes to `PAIRS` smaller groups, named after two further values of the signature each, which a pair at the
   threshold shares with a chance of 0.64; so a pair whose only shared bands are all split is missed with a chance of 0.36 ** PAIRS, 5e-6.
   What leaves a task is a spanning forest of the plausible pairs, at most an edge a row.
3. The forests' components are families of candidates. Their shingle sets are gathered once. Where links are counted, all pairs of a
   family are verified exactly, in pairs of blocks. Where one document of each class is kept, the members of a large family are first
   verified against one of them, and only those that aren't linked to it against all. What leaves a task is a count of links
   and a forest, so copies and dense families are never expanded into pairs of rows; no link is dropped, sampled or capped.
4. Components of the verified links are the classes.

Written intermediates are removed as soon as nothing reads them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackweave.llm.common import Scratch, bounded_batches, discard, few, gathered, group_bounds, in_files, map_batches, materialize, part_of, runs_of, text_key
from trackweave.llm.components import components
from trackweave.llm.hashing import grams, mix, word_hashes

TOP, BOTTOM = 4, 5  # a link: intersection * BOTTOM >= union * TOP
#: Groups of more rows than LARGE are compared row by row against what isn't connected yet; blocks bound a task's memory.
LARGE, BLOCK, BLOCK_SHINGLES = 64, 1024, 1 << 19
#: Groups that a node of a band with many unconnected nodes goes to.
PAIRS = 12


@dataclass(frozen=True)
class Method:
    """How documents become sets and signatures, and which pairs of signatures are worth a verification.

    `signatures` takes sets that aren't empty to a row of `width` bytes each, the bytes of `width // value` values, and to band keys;
    `plausible` takes signatures, sizes of sets and pairs of rows to the pairs that stay."""

    words: int
    width: int
    value: int
    signatures: Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray]]
    plausible: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    lower: bool = False

    def pairs(self) -> np.ndarray:
        """PAIRS pairs of values, all different."""
        return np.random.default_rng(11).permutation(self.width // self.value)[: 2 * PAIRS].reshape(PAIRS, 2)


def sized(n: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose sizes allow a link."""
    fits = BOTTOM * np.minimum(n[left], n[right]) >= TOP * np.maximum(n[left], n[right])
    return left[fits], right[fits]


def shingle_sets(texts: list[str | None], method: Method) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = word_hashes(texts, method.lower)
    runs = grams(words, method.words)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= method.words:
            out.append(np.unique(runs[a : b - method.words + 1]))
        else:
            out.append(grams(words[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """64 bits for each of the bands into which the columns of values are cut."""
    rows = values.shape[1] // bands
    out = np.empty((len(values), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(values), b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + values[:, b * rows + r])
        out[:, b] = h
    return out.view(np.int64)


def sign(docs: DataFrame, method: Method) -> DataFrame:
    """doc_id, hash of the text, fingerprint and size of the shingle set (null and 0 without words), signature and bands."""

    def run(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(batch.column(1).to_pylist(), method)
        full = [k for k, s in enumerate(sets) if len(s)]
        out = {"doc_id": batch.column(0), "tkey": batch.column(2), "n": [len(s) for s in sets]}
        prints, sigs, bands = ([None] * len(sets) for _ in range(3))
        if full:
            values, keys = method.signatures([sets[k] for k in full])
            for at, k in enumerate(full):
                prints[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
                sigs[k], bands[k] = values[at].tobytes(), keys[at]
        return out | {"print": prints, "sig": sigs, "bands": bands}

    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("tkey"))
    return map_batches(rows, "doc_id long, tkey long, n int, print binary, sig binary, bands array<long>", run, 1 << 20)


def least_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that the pairs connect it to."""
    label = np.arange(n)
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return label
        # Roots are hung on lesser roots, so a pair whose ends have met stays met and can go.
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label = up


def pairs_in(bounds: np.ndarray, largest: int, limit: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of each group of at most `largest` rows, in pieces of about `limit`."""
    sizes = np.diff(bounds)
    for size in np.unique(sizes[(sizes > 1) & (sizes <= largest)]):
        starts = bounds[:-1][sizes == size]
        i, j = np.triu_indices(size, 1)
        each = max(1, limit // len(i))
        for at in range(0, len(starts), each):
            some = starts[at : at + each, None]
            yield (some + i).ravel(), (some + j).ravel()


def connect(method: Method, sig: np.ndarray, n: np.ndarray, block: np.ndarray, across: bool) -> np.ndarray:
    """Labels of the rows of one large group: each row in turn is compared with the later rows that it isn't connected to yet,
    so a group of near copies takes few comparisons. `across`: only pairs of different blocks count."""
    label = np.arange(len(n))
    for i in range(len(n) - 1):
        later = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if across:
            later = later[block[later] != block[i]]
        if not len(later):
            if not label.any():
                break
            continue
        _, right = method.plausible(sig, n, np.full(len(later), i), later)
        if len(right):
            joined = np.unique(label[np.append(right, i)])
            label[np.isin(label, joined)] = joined[0]
    return label


def signature_rows(column: pa.Array, method: Method) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, method.width)


def pruner(method: Method) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, bi, bj, block, node, n, sig) sorted by the first three to forest edges (a, b) of plausible pairs."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of(batches, 3):
            bi, bj, block, node, n = (batch.column(k).to_numpy() for k in range(1, 6))
            sig = signature_rows(batch.column(6), method)
            bounds, found = group_bounds(batch, 3), []
            for left, right in pairs_in(bounds, LARGE):
                apart = (bi[left] == bj[left]) | (block[left] != block[right])
                found.append(method.plausible(sig, n, left[apart], right[apart]))
            left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), ())))
            label = least_labels(len(node), left, right)
            for k in np.flatnonzero(np.diff(bounds) > LARGE):
                a, b = bounds[k], bounds[k + 1]
                label[a:b] = a + connect(method, sig[a:b], n[a:b], block[a:b], bi[a] != bj[a])
            moved = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], ["a", "b"])

    return prune


def blocked(df: DataFrame) -> DataFrame:
    """Rows of a group go to the pairs of blocks in which they are compared: columns block, bi, bj.

    `blocks` has the number of blocks of each class, and `cls` is the row's. Rows of class 0 meet all of the group's; those of another class are known
    to be connected to each other and only meet the other classes."""
    before = F.aggregate(F.slice("blocks", F.lit(1), F.col("cls")), F.lit(0), lambda s, x: s + x)
    own, total = F.get("blocks", F.col("cls")), F.aggregate("blocks", F.lit(0), lambda s, x: s + x)
    rows = df.withColumns({"_before": before, "_own": own, "_all": F.sequence(F.lit(0), total - 1)})
    apart = F.filter("_all", lambda b: (F.col("cls") == 0) | (b < F.col("_before")) | (b >= F.col("_before") + F.col("_own")))
    rows = rows.withColumn("block", (F.col("_before") + F.pmod(F.xxhash64("node"), F.col("_own"))).cast("int")).withColumn("_other", F.explode(apart))
    return rows.withColumns({"bi": F.least("block", "_other"), "bj": F.greatest("block", "_other")}).drop("_other", "_before", "_own", "_all")


def block_counts(*counts: str) -> Column:
    """The numbers of blocks of classes of so many rows."""
    return F.array(*[F.ceil(F.col(c) / BLOCK).cast("int") for c in counts])


def sparse(rows: DataFrame) -> DataFrame:
    """A table of a row for each large band, of which there are few, in an eighth of the shuffle's partitions."""
    return rows.coalesce(max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


def peel(rows: DataFrame, signs: DataFrame, level: int, method: Method, scratch: Scratch) -> DataFrame:
    """Rows (key, node, cls), written again: those of class 0 that are plausible with the least such node of their key, `first`, go to class `level`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if count := batch.num_rows:
                sig = np.concatenate([signature_rows(batch.column(4), method), signature_rows(batch.column(7), method)])
                n = np.concatenate([batch.column(3).to_numpy(), batch.column(6).to_numpy()])
                cls = batch.column(2).to_numpy().copy()
                free = np.flatnonzero(cls == 0)
                left, _ = method.plausible(sig, n, free, free + count)
                cls[left] = level
                cls[batch.column(1).to_numpy() == batch.column(5).to_numpy()] = level
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cls), batch.column(5)], ["key", "node", "cls", "first"])

    own = signs.select(F.col("node").alias("first"), F.col("n").alias("first_n"), F.col("sig").alias("first_sig"))
    firsts = scratch(sparse(rows.where("cls = 0").groupBy("key").agg(F.min("node").alias("first")).join(own, "first")), "near-firsts")
    both = rows.join(signs, "node").join(few(firsts), "key").select("key", "node", "cls", "n", "sig", "first", "first_n", "first_sig")
    return scratch(both.mapInArrow(run, "key long, node long, cls int, first long"), "near-peeled")


def split(rows: DataFrame, signs: DataFrame, method: Method) -> DataFrame:
    """Rows (key, node, cls) in PAIRS smaller groups each, named after the key and two values of the signature."""
    pairs = method.pairs()
    at = (pairs[:, :, None] * method.value + np.arange(method.value)).reshape(PAIRS, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if count := batch.num_rows:
                sig = signature_rows(batch.column(3), method).astype(np.uint64)
                h = np.repeat(batch.column(0).to_numpy().astype(np.uint64)[:, None], PAIRS, 1) + np.arange(PAIRS, dtype=np.uint64)
                for k in range(at.shape[1]):
                    h = mix(h * np.uint64(0x9FB21C651E98DF25) + sig[:, at[:, k]])
                which = pa.array(np.repeat(np.arange(count), PAIRS))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64).ravel()), batch.column(1).take(which), batch.column(2).take(which)], ["key", "node", "cls"])

    return rows.join(signs.select("node", "sig"), "node").select("key", "node", "cls", "sig").mapInArrow(run, "key long, node long, cls int")


def candidate_edges(nodes: DataFrame, method: Method, scratch: Scratch) -> DataFrame:
    """Forests of the pairs that share a band and are plausible."""
    bounded_batches(nodes.sparkSession)
    signs = nodes.select("node", "n", "sig")
    keys = nodes.select(F.explode("bands").alias("key"), "node", F.lit(0).alias("cls"))
    known: list[DataFrame] = []

    def grouped(rows: DataFrame, at_least: str) -> tuple[DataFrame, DataFrame]:
        """Rows of groups that fit into a block, as such, and those of larger groups, written."""
        met = scratch(gathered(rows.groupBy("key").agg(F.count("*").alias("m"), F.count_if(F.col("cls") == 0).alias("free")).where(at_least)), "near-met")
        # Shuffled at any size, for this table grows with the input: its cost is in proportion from the start.
        shared = rows.join(met.hint("merge"), "key")
        small = shared.where(F.col("m") <= BLOCK).select("key", "node", F.lit(0).alias("cls"), F.array(F.lit(1)).alias("blocks"))
        return small, scratch(gathered(shared.where(F.col("m") > BLOCK).select("key", "node", "cls")), "near-large")

    def peeled(rows: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        """Rows by class, and the number of rows of each class by key."""
        out = peel(rows, signs, level, method, scratch)
        known.append(out.where((F.col("cls") == level) & (F.col("node") != F.col("first"))).select(F.col("node").alias("a"), F.col("first").alias("b")))
        counts = out.groupBy("key").agg(*[F.count_if(F.col("cls") == c).alias(f"c{c}") for c in range(level + 1)])
        return out.select("key", "node", "cls"), scratch(sparse(counts), "near-counts")

    rows, large = grouped(keys, "m > 1")
    if not large.isEmpty():
        one, counts = peeled(large, 1)
        near = counts.where(F.col("c0").between(1, BLOCK)).select("key", block_counts("c0", "c1").alias("blocks"))
        rows = rows.unionByName(one.join(few(scratch(sparse(near), "near-blocks")), "key"))
        wide = scratch(sparse(counts.where(F.col("c0") > BLOCK).select("key")), "near-wide")
        if not wide.isEmpty():
            small, large = grouped(scratch(split(one.join(few(wide), "key"), signs, method), "near-split"), "m > 1 AND free > 0")
            rows = rows.unionByName(small)
            if not large.isEmpty():
                two, counts = peeled(large, 2)
                whole = counts.select("key", block_counts("c0", "c1", "c2").alias("blocks"))
                rows = rows.unionByName(two.join(few(scratch(sparse(whole), "near-blocks")), "key"))
    dealt = blocked(rows.join(signs, "node")).select("key", "bi", "bj", "block", "node", "n", "sig").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    edges = dealt.mapInArrow(pruner(method), "a long, b long")
    for more in known:
        edges = edges.unionByName(more)
    return edges

def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets of distinct values."""
    g = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(g), [len(s) for s in sets])
    _, number, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[number] > 1
    rank = np.cumsum(count > 1) - 1
    column, owner = rank[number[shared]], owner[shared]
    total = np.zeros((g, g), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = max(64, (1 << 22) // g)
    for at in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        dense = np.zeros((g, width), np.float32)
        dense[owner[a:b], column[a:b] - at] = 1
        total += dense @ dense.T
    return total.astype(np.int64)


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (comp, bi, bj, block, node, copies, shingles) sorted by the first three to (node, root, links) of exact pairs."""
    for run in runs_of(batches, 3):
        bounds = group_bounds(run, 3)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        raw = run.column(6)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            bi, bj, block, node, copies = (run.column(k).slice(a, b - a).to_numpy() for k in range(1, 6))
            sets = [np.frombuffer(x, np.uint64) for x in raw.slice(a, b - a).to_pylist()]
            size = np.array([len(s) for s in sets], np.int64)
            if len(sets) == 1:
                linked = np.zeros((1, 1), bool)
            else:
                both = np.array([[0, c := len(np.intersect1d(*sets, assume_unique=True))], [c, 0]]) if len(sets) == 2 else overlaps(sets)
                linked = BOTTOM * both >= TOP * (size[:, None] + size[None, :] - both)
                np.fill_diagonal(linked, False)
                if bi[0] != bj[0]:
                    linked &= block[:, None] != block[None, :]
            label = least_labels(len(node), *np.nonzero(linked))
            out.append((node, node[label], linked @ copies))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["node", "root", "links"])


def with_texts(docs: DataFrame, members: DataFrame, repeats: bool) -> DataFrame:
    """The members with their texts: ids are broadcast where they are few, and shuffled with the texts beyond that."""
    rows = docs.select(F.col("doc_id").alias("d"), "text", text_key(F.col("text")).alias("t"))
    both = rows.join(few(members), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tkey")))
    return both.dropDuplicates(["node"]) if repeats else both


def shingle_rows(docs: DataFrame, members: DataFrame, repeats: bool, method: Method) -> DataFrame:
    """The members with their shingle sets in place of ids."""
    names = [c for c in members.columns if c not in ("doc_id", "tkey")]

    def shingles(batch: pa.RecordBatch) -> dict:
        return dict(zip(names, batch.columns)) | {"shingles": [s.tobytes() for s in shingle_sets(batch.column(len(names)).to_pylist(), method)]}

    schema = StructType([members.schema[c] for c in names]).add("shingles", "binary")
    return map_batches(with_texts(docs, members, repeats).select(*names, "text"), schema, shingles, 1 << 20)


def verified(sets: DataFrame) -> DataFrame:
    """(node, root, links) of all pairs of blocks in which rows are to be compared; node and root are linked, and links are counted."""
    dealt = blocked(sets).select("comp", "bi", "bj", "block", "node", "copies", "shingles").repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj")
    return dealt.mapInArrow(verify, "node long, root long, links long")


def linked_to_first(docs: DataFrame, members: DataFrame, repeats: bool, method: Method) -> DataFrame:
    """(comp, node, first, tied) of large families: whether a member is linked to the first one. Each block gets a copy of the first."""
    every = F.when(F.col("node") == F.col("first"), F.sequence(F.lit(0), (F.col("open_blocks") - 1).cast("int")))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("open_blocks")).cast("int"))
    rows = shingle_rows(docs, members, repeats, method).withColumn("block", F.explode(F.coalesce(every, own)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs_of(batches, 2):
            bounds, raw = group_bounds(part, 2), part.column(4)
            comp, node, first = (part.column(k).to_numpy() for k in (0, 2, 3))
            tied = np.zeros(part.num_rows, bool)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                sets = [np.frombuffer(x, np.uint64) for x in raw.slice(a, b - a).to_pylist()]
                base = sets[int(np.flatnonzero(node[a:b] == first[a])[0])]
                for k, s in enumerate(sets):
                    both = len(np.intersect1d(base, s, assume_unique=True))
                    tied[a + k] = BOTTOM * both >= TOP * (len(base) + len(s) - both)
            yield pa.RecordBatch.from_arrays([pa.array(comp), pa.array(node), pa.array(first), pa.array(tied)], ["comp", "node", "first", "tied"])

    dealt = rows.select("comp", "block", "node", "first", "shingles").repartition("comp", "block").sortWithinPartitions("comp", "block")
    return dealt.mapInArrow(run, "comp long, node long, first long, tied boolean").distinct()


def join(docs: DataFrame, method: Method, count_links: bool = True) -> tuple[DataFrame, DataFrame, bool]:
    """Signed rows, nodes with their class (print, copies, links, keeper), and whether rows repeat.

    Without `count_links` classes are the same, but links are only counted as far as they were met."""
    scratch = Scratch()
    signed = scratch(sign(docs, method), "near-signed")
    repeats = not signed.groupBy("doc_id", "tkey").count().where("count > 1").limit(1).isEmpty()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("rep")
    nodes = signed.where("print IS NOT NULL").groupBy("print").agg(first, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = scratch(gathered(nodes.select(F.monotonically_increasing_id().alias("node"), "print", "rep.doc_id", "rep.tkey", "copies", "n", "sig", "bands")), "near-nodes")
    candidates = components(candidate_edges(nodes, method, scratch))
    families = scratch(in_files(candidates, candidates.size), "near-families")
    discard(candidates.reads)
    size = lambda c: F.greatest(F.ceil(F.count_if(c) / BLOCK), F.ceil(F.sum(F.when(c, F.col("n"))) / BLOCK_SHINGLES)).cast("int")
    sizes = families.join(nodes.select("node", "n"), "node").groupBy("comp").agg(size(F.lit(True)).alias("open_blocks"))
    members = families.join(nodes.select("node", "doc_id", "tkey", "copies"), "node").join(sizes, "comp")
    members = scratch(gathered(members.select("node", "comp", "doc_id", "tkey", "copies", F.lit(0).alias("cls"), F.array("open_blocks").alias("blocks"), "open_blocks")), "near-members")
    if count_links or members.where("open_blocks > 1").isEmpty():
        checked = scratch(gathered(verified(shingle_rows(docs, part_of(members, members.drop("open_blocks")), repeats, method))), "near-checked")
    else:
        large = members.where("open_blocks > 1").withColumn("first", F.col("comp"))  # a component is named after its least node
        told = scratch(gathered(linked_to_first(docs, part_of(members, large.drop("cls", "blocks", "copies")), repeats, method)), "near-told")
        counts = told.join(nodes.select("node", "n"), "node").groupBy("comp").agg(F.array(F.coalesce(size(~F.col("tied")), F.lit(0)), F.coalesce(size(F.col("tied")), F.lit(0))).alias("blocks"))
        rest = large.select("node", "comp", "doc_id", "tkey", "copies").join(told.select("node", F.col("tied").cast("int").alias("cls")), "node").join(counts.where("blocks[0] > 0"), "comp")
        rest = members.where("open_blocks = 1").drop("open_blocks").unionByName(rest.select("node", "comp", "doc_id", "tkey", "copies", "cls", "blocks"))
        found = verified(shingle_rows(docs, scratch(gathered(rest), "near-open"), repeats, method))
        checked = scratch(gathered(found.unionByName(told.where("tied").select("node", F.col("first").alias("root"), F.lit(0).cast("long").alias("links")))), "near-checked")
    linked = components(checked.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    named = linked.join(nodes.select("node", "doc_id", "tkey"), "node")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey"))
    classes = named.groupBy("comp").agg(least.alias("keeper"))
    of_node = linked.join(classes, "comp").select("node", "keeper").join(links, "node", "full")
    all_nodes = nodes.select("node", "print", "doc_id", "tkey", "copies").join(of_node, "node", "left")
    keeper = F.coalesce("keeper", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey"))
    out = scratch(gathered(all_nodes.select("print", "copies", F.coalesce("links", F.lit(0)).alias("links"), keeper.alias("keeper"))), "near-classes")
    discard(linked.reads)
    scratch.clear(signed, out)
    return signed, out, repeats


def keep_one(docs: DataFrame, method: Method) -> DataFrame:
    """The documents without those that link to a kept one's class: of each class the one of least doc_id stays."""
    signed, nodes, repeats = join(docs, method, count_links=False)
    both = signed.select("doc_id", "tkey", "print").join(nodes.select("print", "keeper"), "print")
    away = both.where(~(F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("tkey") == F.col("keeper.tkey"))))
    away = materialize(gathered(away.select(F.col("doc_id").alias("_d"), F.col("tkey").alias("_t")).distinct()), "near-away")
    discard(signed)
    discard(nodes)
    # The document's own columns travel in a struct, so their names can't clash with those of the join.
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").alias("_id"), text_key(F.col("text")).alias("_k"), F.coalesce(F.regexp_like("text", F.lit("[^\\x20\\x09-\\x0D]")), F.lit(False)).alias("_words"))
    kept = whole.join(few(away), F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_t")), "left_anti")
    if repeats:
        kept = kept.where("_words").dropDuplicates(["_id", "_k"]).unionByName(kept.where("NOT _words"))
    return kept.select("_doc.*")
