"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each document draws u from its own hash and has the exponential key -ln(u) / w, w being its quality weight; in order of keys, least
first (the order of u^(1/w), greatest first), a source's documents are taken until its budget is full. The weight is a column that the
caller names, or else `quality_weight`: 1 less four times the share of symbols among the text's characters, 0.05 at least. Whole epochs
come first: a source whose target is e times its size and a rest gets every document e times, and the rest goes to the documents
of the least keys as long as they fit; what is then left is closed by the one further document whose size is nearest to it, if
that is nearer than none.

No source is sorted whole, so a hot source needs no single task. Sizes are summed by (source, bucket) with map-side combination, and
prefix sums over the buckets find the one where the budget ends; the same is done over that bucket's cells, and only the last
cell's documents are sorted. Buckets are equal steps of the key's logarithm: an exponential variable of any rate, and so any mixture of
weights, has at most 1/(256 e) = 0.15 % of its mass in one, and a cell is 1/4096 of a bucket.

Defined results: a null text has size 0; the null source is a source, last in order; a source of size 0 has target 0, and its documents, of no words, all fit; a null weight
counts as 0.05; rows that repeat are separate documents in `mix` and go in or out together in `resample`; an empty table gives no
rows; reruns agree, for the keys depend on doc_id, text and weight alone. Targets are computed in one task over a row for each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import gathered, materialize, text_key, word_count

WEIGHTS, SHARE, MOST, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 20
#: Buckets for each unit of the key's logarithm, and the binary logarithm of a bucket's cells.
STEPS, CELL_BITS, LEAST_WEIGHT, LEAST_KEY = 256, 12, 0.05, 1e-18
SYMBOLS = "[#*$%&|<>]+"


def quality_weight(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    symbols = F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))
    return F.lit(1.0) - symbols / F.greatest(F.length(body), F.lit(1)) * 4


def keyed(text: Column, doc_id: Column, seed: int = SEED, weight: Column | None = None) -> dict[str, Column]:
    """Size in words, and the key with its tie-break."""
    own = F.greatest(F.lit(LEAST_WEIGHT), quality_weight(text) if weight is None else weight)
    tie = F.xxhash64(doc_id, text_key(text), F.lit(seed))
    u = (F.shiftrightunsigned(tie, 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return {"size": word_count(text), "key": F.greatest(-F.log(u) / own, F.lit(LEAST_KEY)), "tie": tie}


def cell(key: Column) -> Column:
    """The key's place among equal steps of its logarithm."""
    return F.floor(F.log(key) * (STEPS << CELL_BITS)).cast("long")


def bucket(key: Column) -> Column:
    return F.shiftright(cell(key), CELL_BITS)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target): a share of all words by weight, at most `most` sizes each.

    The level L solves sum(min(cap, L * weight)) = share * all; over sources in order of cap / weight it is the greatest of
    (all that is due - caps before) / (weights from here on)."""
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy(F.lit(0))
    by_cap = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) * share - before) / rest)
    return rows.select("source", "source_size", F.least("cap", F.max("level").over(everything) * F.col("weight")).alias("target"))


def of_source(rows: DataFrame, goal: DataFrame, *columns: str) -> DataFrame:
    """The rows with columns of their source's plan; a null source has a plan too."""
    g = goal.select(F.col("source").alias("_s"), *columns)
    return rows.join(g, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def ending(sums: DataFrame, goal: DataFrame, part: str, before: str | None = None) -> DataFrame:
    """The plan with the last part (bucket or cell) of each source that begins within its rest, and the words before it.

    `sums` has the words of each (source, part), `before` names the words before the first of them."""
    upto = F.sum("words").over(Window.partitionBy("source").orderBy(part))
    base = F.col(before) if before else F.lit(0)
    begun = of_source(sums.withColumn("_before", upto - F.col("words")), goal, "rest", *([before] if before else [])).withColumn("_before", F.col("_before") + base)
    last = begun.where("_before <= rest").groupBy(F.col("source").alias("_e")).agg(F.max(F.struct(part, "_before")).alias("_end"))
    both = goal.drop(*([before] if before else [])).join(last, F.col("source").eqNullSafe(F.col("_e")), "left")
    return both.withColumn(f"end_{part}", F.col(f"_end.{part}")).withColumn("end_before", F.col("_end._before")).drop("_e", "_end")


def plan(rows: DataFrame) -> DataFrame:
    """A row for each source from (source, size, key): target, whole epochs, the rest, and the cell where the rest ends."""
    by_bucket = materialize(gathered(rows.groupBy("source", bucket(F.col("key")).alias("bucket")).agg(F.sum("size").alias("words"))), "mix-buckets")
    goal = targets(by_bucket.groupBy("source").agg(F.sum("words").alias("source_size")))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = materialize(gathered(ending(by_bucket, goal, "bucket")), "mix-goal")
    inside = of_source(rows, goal, "end_bucket").where(bucket(F.col("key")) == F.col("end_bucket"))
    cells = inside.groupBy("source", cell(F.col("key")).alias("cell")).agg(F.sum("size").alias("words"))
    return ending(cells, goal, "cell", "end_before").drop("end_bucket")


def order_of(key: Column, tie: Column, row: Column | None = None) -> Column:
    """Documents in order of keys, least first."""
    more = [] if row is None else [row.alias("r")]
    return F.struct(key.alias("k"), tie.alias("t"), *more)


def cuts(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """The plan with `last`, the last document of the rest, and `closing`, the one that fills what is left after it.

    Only documents of the cell where a budget ends are sorted; the closing one is a minimum over the others."""
    both = of_source(rows, goal, "rest", "end_cell", "end_before").withColumn("cell", cell(F.col("key")))
    order = order_of(F.col("key"), F.col("tie"), F.col("row"))
    within = Window.partitionBy("source").orderBy("key", "tie", "row").rowsBetween(Window.unboundedPreceding, 0)
    fits = both.where("cell = end_cell").withColumn("upto", F.col("end_before") + F.sum("size").over(within)).where("upto <= rest")
    last = fits.groupBy(F.col("source").alias("l")).agg(F.max(order).alias("last"), F.max("upto").alias("upto"))
    ended = materialize(gathered(goal.join(last, F.col("source").eqNullSafe(F.col("l")), "left").drop("l").withColumn("left_over", F.col("rest") - F.coalesce("upto", "end_before", F.lit(0)))), "mix-ends")
    out = of_source(rows, ended, "end_cell", "last", "left_over").withColumn("cell", cell(F.col("key")))
    out = out.where(~taken_before(order) & (F.abs(F.col("size") - F.col("left_over")) < F.col("left_over")))
    close = out.groupBy(F.col("source").alias("c")).agg(F.min(F.struct(F.abs(F.col("size") - F.col("left_over")).alias("gap"), order.alias("o"))).alias("best"))
    return ended.join(close, F.col("source").eqNullSafe(F.col("c")), "left").select("source", "source_size", "target", "epochs", "rest", "end_cell", "last", F.col("best.o").alias("closing"))


def taken_before(order: Column, last: str = "last") -> Column:
    at_end = (F.col("cell") == F.col("end_cell")) & F.coalesce(order <= F.col(last), F.lit(False))
    return F.coalesce((F.col("cell") < F.col("end_cell")) | at_end, F.lit(False))


def slim(docs: DataFrame, seed: int = SEED, weight: str | None = None) -> DataFrame:
    """What the mix needs of each document, without its text; written, for it is read several times."""
    key = keyed(F.col("text"), F.col("doc_id"), seed, F.col(weight) if weight else None)
    return materialize(docs.select("doc_id", "source", *(c.alias(n) for n, c in key.items()), F.monotonically_increasing_id().alias("row")), "mix-rows")


def mix(docs: DataFrame, seed: int = SEED, weight: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (the words that the mix takes) of every document."""
    rows = slim(docs, seed, weight)
    goal = materialize(gathered(cuts(rows, materialize(gathered(plan(rows)), "mix-plan"))), "mix-cuts")
    both = of_source(rows, goal, "source_size", "target", "epochs", "end_cell", "last", "closing").withColumn("cell", cell(F.col("key")))
    order = order_of(F.col("key"), F.col("tie"), F.col("row"))
    more = taken_before(order) | F.coalesce(order == F.col("closing"), F.lit(False))
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + more.cast("long"))).alias("taken"), "source")


def resample(docs: DataFrame, seed: int = SEED, weight: str | None = None) -> DataFrame:
    """The documents, each as many times as the mix takes it; texts aren't shuffled, only the plan is joined."""
    rows = slim(docs, seed, weight)
    goal = materialize(gathered(cuts(rows, materialize(gathered(plan(rows)), "mix-plan"))), "mix-cuts")
    two = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.k").alias("k"), F.col(f"{c}.t").alias("t")))
    goal = goal.select(F.col("source").alias("_s"), F.col("epochs").alias("_epochs"), F.col("end_cell").alias("_end"), two("last").alias("_last"), two("closing").alias("_closing"))
    key = keyed(F.col("text"), F.col("doc_id"), seed, F.col(weight) if weight else None)
    # The document's own columns travel in a struct, so their names can't clash with those of the plan.
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("source").alias("_source"), key["key"].alias("_key"), key["tie"].alias("_tie"))
    both = whole.join(goal, F.col("_source").eqNullSafe(F.col("_s")))
    order, at = order_of(F.col("_key"), F.col("_tie")), cell(F.col("_key"))
    more = (at < F.col("_end")) | (at == F.col("_end")) & F.coalesce(order <= F.col("_last"), F.lit(False)) | F.coalesce(order == F.col("_closing"), F.lit(False))
    copies = both.select("_doc", (F.col("_epochs") + F.coalesce(more, F.lit(False)).cast("int")).cast("int").alias("_copies")).where("_copies > 0")
    return copies.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")
