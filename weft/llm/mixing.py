"""Mixing sources to target weights by Pareto order sampling (native expressions only).

Each source gets a target in words. A document's expected number of copies is
``min(max_repeats, c * importance)``, with ``c`` solved per source so that the
expected words equal the target. The whole part is allocated with certainty;
for the fractional part ``p`` documents are ranked by Pareto's
``(u / (1 - u)) / (p / (1 - p))``, ``u`` a hash of the row, and the first ones
are taken until the source's remaining words are filled. A last correction
takes at most two further documents of a source, those whose sizes fit the
rest best.

Defined cases: null text has size 0; a null source is a source of its own,
last in order; documents of size 0 take 0 words; an empty table gives an empty
result; a null doc_id is an id like any other. Equal rows (same id, source and
text) are units with draws of their own: the row's hash and the unit's number,
so neither their number nor the layout of files matters. A clashing extra column does
no harm: only doc_id, source and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import durable, lookup_join

WORD = r"[^\x20\x09-\x0D]+"
#: Coarse ranks per source; only one of them is ranked row by row.
BUCKETS = 1 << 14


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def length_importance(size: Column) -> Column:
    """Mild preference for longer documents: 1 to about 2, in steps of 1/16 a doubling."""
    return F.lit(1.0) + F.floor(F.log2(size + 1.0)) / F.lit(16.0)


def _fill(table: DataFrame, part: list[str], total: str, cap: str, weight: str, out: str) -> DataFrame:
    """``out`` = min(cap, c * weight) with ``c`` such that the group's ``out`` add up to ``total``."""
    order = Window.partitionBy(*part).orderBy(F.col(cap) / F.col(weight), *[c for c in ("level", "rank") if c in table.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = table.withColumn("__c", (F.col(total) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum(weight).over(after))
    fits = F.when(F.col("__c") * F.col(weight) <= F.col(cap) * (1 + 1e-12), F.col("__c"))
    t = t.withColumn("__c", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return t.withColumn(out, F.least(F.col(cap), F.coalesce(F.col("__c") * F.col(weight), F.col(cap)))).drop("__c")


def source_targets(sizes: DataFrame, max_repeats: int = 3, weights: int = 3) -> DataFrame:
    """Targets of sources (source, source_size): weights 1..``weights`` repeating in code point order, null last.

    A target stops at ``max_repeats`` times its source's size; the excess is
    shared again by weight until none is above.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("rank", F.row_number().over(one)).withColumn("weight", ((F.col("rank") - 1) % weights + 1).cast("double"))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    t = t.withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
    return _fill(t, [], "total", "cap", "weight", "target").select("source", "source_size", "target")


def _odds(p: Column, u: Column) -> Column:
    return F.when(p >= 1, F.lit(0.0)).otherwise((u / (1 - u)) / (p / (1 - p)))


def _row_hash(seed: int) -> Column:
    cols = [F.col(c) for c in ("doc_id", "source", "text")]
    return F.xxhash64(F.lit(seed), *cols, *[c.isNull() for c in cols])


def _unit_hash(row: str, k: Column) -> Column:
    return F.xxhash64(F.col(row), k.cast("long"))


def units(docs: DataFrame, seed: int, run: int = 1 << 16) -> DataFrame:
    """Durable (doc_id, source, size, row, times, h): a row for each document, ``times`` how many equal ones there are, ``h`` its own hash.

    Equal rows are counted, which adds up in every task, and numbered when they are spread out again, in runs.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _row_hash(seed).alias("row"))
    rows = durable(rows.groupBy("doc_id", "source", "size", "row").agg(F.count("*").alias("times")))
    one = rows.filter("times = 1").withColumn("k", F.lit(0).cast("long"))
    many = rows.filter("times > 1").withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(run).cast("long"))))
    many = many.hint("rebalance").withColumn("k", F.explode(F.sequence("from", F.least(F.col("times"), F.col("from") + run) - 1))).drop("from")
    out = one.unionByName(many)
    return durable(out.select("doc_id", "source", "size", "row", "times", _unit_hash("row", F.col("k")).alias("h")))


def mix(docs: DataFrame, seed: int = 20240, max_repeats: int = 3, importance=length_importance) -> tuple[DataFrame, DataFrame]:
    """Decide the copies of every document.

    Returns (rows, chosen): ``rows`` has doc_id, source, size and the hashes
    of all documents, ``chosen`` adds source_size, target, copies and taken.
    """
    rows = units(docs, seed)
    plan, levels = plan_mix(rows, max_repeats, importance)
    return rows, apply_mix(rows, plan, levels, importance)


def _with_level(rows: DataFrame, importance) -> DataFrame:
    return rows.withColumn("level", F.round(importance(F.col("size").cast("double")) * 16).cast("int"))


def _ranked(rows: DataFrame, levels: DataFrame, importance) -> DataFrame:
    u = (F.shiftrightunsigned(F.col("h"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    r = lookup_join(_with_level(rows, importance), levels, ["source", "level"])
    r = r.withColumn("q", F.when(F.col("p") > 0, _odds(F.col("p"), u)))
    return r.withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS)).cast("int"))


def plan_mix(rows: DataFrame, max_repeats: int, importance) -> tuple[DataFrame, DataFrame]:
    """The plan: one row a source (targets, rank limit, fillers) and one a (source, importance level)."""
    strata = durable(_with_level(rows, importance).groupBy("source", "level").agg(F.sum("size").alias("words")))
    sources = source_targets(strata.groupBy("source").agg(F.sum("words").alias("source_size")), max_repeats)
    t = lookup_join(strata, durable(sources), ["source"])
    t = t.withColumn("cap", F.col("words") * F.lit(float(max_repeats))).withColumn("weight", F.greatest(F.col("words"), F.lit(1e-9)) * F.col("level"))
    t = _fill(t, ["source"], "target", "cap", "weight", "share")
    copies = F.when(F.col("words") > 0, F.col("share") / F.col("words")).otherwise(F.lit(0.0))
    whole = F.floor(copies + 1e-9)
    levels = durable(
        t.select("source", "level", "source_size", "target", "words", whole.cast("long").alias("whole"), F.greatest(F.lit(0.0), copies - whole).alias("p"))
    )
    rest = levels.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("words"))).alias("rest"))
    levels = levels.drop("words")
    ranked = _ranked(rows, levels, importance).filter("q is not null")
    sums = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    up = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = lookup_join(sums, durable(rest), ["source"]).withColumn("cum", F.sum("words").over(up))
    edge = durable(
        sums.groupBy("source").agg(
            F.first("rest").alias("rest"),
            F.coalesce(F.min(F.when(F.col("cum") > F.col("rest"), F.col("bucket"))), F.lit(BUCKETS)).alias("edge"),
            F.coalesce(F.max(F.when(F.col("cum") <= F.col("rest"), F.col("cum"))), F.lit(0)).alias("under"),
        )
    )
    close = lookup_join(ranked.select("source", "size", "h", "q", "bucket"), edge, ["source"]).filter("bucket = edge")
    up = Window.partitionBy("source").orderBy("q", "h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    close = close.withColumn("cum", F.col("under") + F.sum("size").over(up)).filter("cum <= rest")
    last = close.groupBy("source").agg(F.max(F.struct("q", "h")).alias("last"), F.max("cum").alias("cum"))
    plan = edge.join(last.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").select(
        "source", "edge", F.col("last.q").alias("q_last"), F.col("last.h").alias("h_last"), (F.col("rest") - F.coalesce("cum", "under")).alias("gap")
    )
    plan = durable(plan.withColumn("fill_1", F.lit(None).cast("long")).withColumn("fill_2", F.lit(None).cast("long")))
    for name in ("fill_1", "fill_2"):
        free = lookup_join(ranked.select("source", "size", "h", "q", "bucket"), plan, ["source"]).filter(~_taken())
        best = free.filter("abs(size - gap) < gap").groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("d"), F.col("size").alias("s"), F.col("h"))).alias("b"))
        best = best.withColumnRenamed("source", "__s")
        plan = plan.join(best, F.col("source").eqNullSafe(F.col("__s")), "left").withColumn(name, F.coalesce(name, "b.h"))
        plan = durable(plan.withColumn("gap", F.col("gap") - F.coalesce("b.s", F.lit(0))).drop("b", "__s"))
    return plan, levels


def _taken() -> Column:
    """Whether the fractional copy of a ranked row is taken."""
    before = (F.col("bucket") < F.col("edge")) | (
        (F.col("bucket") == F.col("edge")) & ((F.col("q") < F.col("q_last")) | ((F.col("q") == F.col("q_last")) & (F.col("h") <= F.col("h_last"))))
    )
    filler = F.col("h").eqNullSafe(F.col("fill_1")) | F.col("h").eqNullSafe(F.col("fill_2"))
    return F.coalesce(before, F.lit(False)) | (F.col("q").isNotNull() & filler)


def apply_mix(rows: DataFrame, plan: DataFrame, levels: DataFrame, importance) -> DataFrame:
    r = lookup_join(_ranked(rows, levels, importance), plan, ["source"])
    r = r.withColumn("copies", F.col("whole") + _taken().cast("long"))
    return r.select(
        *[c for c in rows.columns if c != "h"], "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def mixed_documents(docs: DataFrame, seed: int = 20240, max_repeats: int = 3, importance=length_importance) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, columns unchanged.

    The plan is one row a source and level, so texts are decided on where they
    lie. Equal rows share their copies out evenly; what is left over is added
    by one of them.
    """
    rows = units(docs, seed)
    plan, levels = plan_mix(rows, max_repeats, importance)
    equal = rows.filter("times > 1")
    equal = durable(apply_mix(equal, plan, levels, importance).groupBy("row").agg(F.first("times").alias("times"), F.sum("copies").alias("all")))
    names = docs.columns
    full = docs.select(F.struct(*names).alias("__d"), "source", word_count(F.col("text")).alias("size"), _row_hash(seed).alias("row"))
    full = apply_mix(full.withColumn("h", _unit_hash("row", F.lit(0))), plan, levels, importance)
    repeats = not equal.isEmpty()
    if repeats:
        full = lookup_join(full, equal, ["row"]).withColumn("copies", F.coalesce(F.floor(F.col("all") / F.col("times")), F.col("copies")))
    spread = lambda df: df.filter("copies > 0").select("__d", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__d.*")
    out = spread(full)
    if repeats:
        left = durable(equal.select("row", (F.col("all") % F.col("times")).alias("copies")).filter("copies > 0"))
        some = lookup_join(docs.select(F.struct(*names).alias("__d"), _row_hash(seed).alias("row")), left, ["row"], "inner")
        out = out.unionByName(spread(some.groupBy("row").agg(F.first("__d").alias("__d"), F.first("copies").alias("copies"))))
    return out
