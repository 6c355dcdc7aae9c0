"""Machine algebra on edge tables: (src, dst, in_sym, out_sym, w) DataFrames with numeric weights.

For machines built from data, or too large to hold as objects. '' is the empty
symbol. Edge tables may be large; nothing here is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLS = ["src", "dst", "in_sym", "out_sym", "w"]


def collapse(t: DataFrame) -> DataFrame:
    """Parallel edges added up."""
    return t.groupBy("src", "dst", "in_sym", "out_sym").agg(F.sum("w").alias("w")).select(*COLS)


def transpose(t):
    return t.select("src", "dst", F.col("out_sym").alias("in_sym"), F.col("in_sym").alias("out_sym"), "w")


def silence(t, side: str = "out"):
    return t.withColumn(f"{side}_sym", F.lit("")).select(*COLS)


def reverse(t, states: int):
    return t.select((states - 1 - F.col("dst")).alias("src"), (states - 1 - F.col("src")).alias("dst"), "in_sym", "out_sym", "w")


def shift(t, by: int):
    return t.select((F.col("src") + by).alias("src"), (F.col("dst") + by).alias("dst"), "in_sym", "out_sym", "w")


def silent(spark, rows) -> DataFrame:
    return spark.createDataFrame([(s, d, "", "", float(w)) for s, d, w in rows], "src int, dst int, in_sym string, out_sym string, w double")


def concat(a, na: int, b):
    return a.unionByName(shift(b, na)).unionByName(silent(a.sparkSession, [(na - 1, na, 1)]))


def union(a, na: int, b, nb: int, p=None):
    p, q = (1.0, 1.0) if p is None else (p, 1 - p)
    end = na + nb + 1
    links = silent(a.sparkSession, [(0, 1, p), (0, 1 + na, q), (na, end, 1), (na + nb, end, 1)])
    return shift(a, 1).unionByName(shift(b, 1 + na)).unionByName(links)


def plus(a, na: int):
    return shift(a, 1).unionByName(silent(a.sparkSession, [(0, 1, 1), (na, 1, 1), (na, na + 1, 1)]))


def star(a, na: int):
    """One or more, or nothing: the plus machine (na + 2 states) with a silent way past it."""
    return plus(a, na).unionByName(silent(a.sparkSession, [(0, na + 1, 1)]))


def loop(x, nx: int, y, ny: int):
    links = silent(x.sparkSession, [(nx - 1, nx, 1), (nx - 1, nx + ny, 1), (nx + ny - 1, 0, 1)])
    return x.unionByName(shift(y, nx)).unionByName(links)


def joint_norm(t):
    return t.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("src")))


def cond_norm(t):
    return t.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("src", "in_sym")))


def weight_by_symbol(t, symbols: DataFrame, side: str = "in"):
    """Multiply non-empty edges by a (sym, factor) table."""
    return t.join(symbols.select(F.col("sym").alias(f"{side}_sym"), "factor"), f"{side}_sym", "left").withColumn("w", F.col("w") * F.coalesce("factor", F.lit(1.0))).select(*COLS)


def alphabet(t):
    return t.select(F.lit("in").alias("side"), F.col("in_sym").alias("sym")).unionByName(t.select(F.lit("out").alias("side"), F.col("out_sym").alias("sym"))).filter("sym <> ''").distinct()


def stats(t):
    by = t.groupBy("in_sym", "out_sym").agg(F.count("*").alias("n"))
    loud = F.when((F.col("in_sym") != "") | (F.col("out_sym") != ""), F.col("n"))
    quiet = F.when((F.col("in_sym") == "") & (F.col("out_sym") == ""), F.col("n"))
    states = t.select(F.col("src").alias("s")).unionByName(t.select(F.col("dst").alias("s"))).agg(F.countDistinct("s").alias("states"))
    return by.agg(F.sum("n").alias("transitions"), (F.coalesce(F.max(loud), F.lit(0)) + F.coalesce(F.sum(quiet), F.lit(0))).alias("conditioned")).crossJoin(states)


def compose(a, b, nb: int):
    """Product edges (state = i * nb + j) of machines whose right operand is in waiting form: one equi-join on the shared symbol and two idle branches, parallel edges added."""
    state = lambda i, j: (F.col(i) * nb + F.col(j)).alias
    x = a.toDF("s", "d", "i", "m", "u")
    y = b.toDF("s2", "d2", "m2", "o", "v")
    both = x.filter("m <> ''").join(y, x.m == y.m2).select(state("s", "s2")("src"), state("d", "d2")("dst"), F.col("i").alias("in_sym"), F.col("o").alias("out_sym"), (F.col("u") * F.col("v")).alias("w"))
    j = y.groupBy(F.col("s2").alias("j")).agg(F.max((F.col("m2") != "").cast("int")).alias("takes"))
    waits = j.filter("takes = 1").select("j").unionByName(a.sparkSession.range(nb).select(F.col("id").cast("int").alias("j")).join(j, "j", "left_anti"))
    rest = x.filter("m = ''").crossJoin(F.broadcast(waits)).select(state("s", "j")("src"), state("d", "j")("dst"), F.col("i").alias("in_sym"), F.lit("").alias("out_sym"), F.col("u").alias("w"))
    states = x.select(F.col("s").alias("k")).unionByName(x.select(F.col("d").alias("k"))).distinct()
    idle = states.crossJoin(F.broadcast(y.filter("m2 = ''"))).select(state("k", "s2")("src"), state("k", "d2")("dst"), F.lit("").alias("in_sym"), F.col("o").alias("out_sym"), F.col("v").alias("w"))
    return collapse(both.unionByName(rest).unionByName(idle))


def intersect(a, b, nb: int):
    """Product of recognisers without silent edges: both read the same symbol."""
    x, y = a.toDF("s", "d", "i", "m", "u"), b.toDF("s2", "d2", "i2", "m2", "v")
    return x.join(y, x.i == y.i2).select((F.col("s") * nb + F.col("s2")).alias("src"), (F.col("d") * nb + F.col("d2")).alias("dst"), F.col("i").alias("in_sym"), F.lit("").alias("out_sym"), (F.col("u") * F.col("v")).alias("w"))


def reachable(t, start: DataFrame, most: int = 10_000) -> DataFrame:
    """States reachable from ``start`` (column state): a frontier of new states a round, kept until the end."""
    steps = t.select("src", "dst").distinct().persist()
    seen = front = start.select("state").distinct()
    held = [steps]
    for _ in range(most):
        ahead = steps.join(front.withColumnRenamed("state", "src"), "src", "left_semi").select(F.col("dst").alias("state")).distinct()
        front = ahead.join(seen, "state", "left_anti").persist()
        held.append(front)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if len(held) > 8:  # one table instead of a union that grows
            old, seen = held, seen.persist()
            seen.count()
            for h in old[1:-1]:
                h.unpersist()
            held = [steps, seen, front]
    return seen


def signatures(t):
    """States with equal futures: one row a class with its smallest state and how many states share it."""
    s = t.groupBy("src").agg(F.concat_ws(";", F.sort_array(F.collect_list(F.concat_ws(",", F.col("dst").cast("string"), "in_sym", "out_sym", F.round("w", 9).cast("string"))))).alias("sig"))
    return s.groupBy("sig").agg(F.min("src").alias("state"), F.count("*").alias("states")).select("state", "states")


def subgraph(t, flags: DataFrame):
    """The edges that a table of (src, dst, in_sym, out_sym) names."""
    return t.join(flags, ["src", "dst", "in_sym", "out_sym"], "left_semi").select(*COLS)


def labels(t):
    """Edge labels of a drawing: parallel edges share one arrow (src, dst, label)."""
    io = F.transform(F.sort_array(F.collect_list(F.struct("in_sym", "out_sym"))), lambda x: F.concat(x["in_sym"], F.lit("/"), x["out_sym"]))
    return t.groupBy("src", "dst").agg(F.array_join(io, ",").alias("label"))


def predicates(t):
    """Whether each state with edges waits for input, whether it goes on without, and its number of edges."""
    quiet = F.col("in_sym") == ""
    return t.groupBy(F.col("src").alias("state")).agg((F.count(F.when(quiet, 1)) == 0).alias("waits"), (F.count(F.when(~quiet, 1)) == 0).alias("continues"), F.count("*").alias("edges"))


def shares(counts, by: list[str], of: list[str], count: str = "cnt", name: str = "p"):
    """Counts added up by ``by`` and ``of`` as shares of their sum by ``by``: the closed-form M-step of normalised weights."""
    c = counts.groupBy(*by, *of).agg(F.sum(count).alias(count))
    return c.select(*by, *of, (F.col(count) / F.sum(count).over(Window.partitionBy(*by))).alias(name))
