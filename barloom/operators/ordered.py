"""What depends on the order of all rows, without one task that holds them: numbers in sequence, running sums, exact quantiles.

Rows are dealt to tasks by ranges of the order and sorted there; each task adds up its own rows and writes them down, so that
every later reading sees the same. The sums of the ranges before, one for each task, are then added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import tables


def running(df: DataFrame, order: list[str], weight: str | Column, name: str) -> DataFrame:
    """df with the sum of a weight (a whole number) over all rows up to each, itself included, in an order; NULL comes first.

    Rows with equal order come in any sequence, but always the same one. A range holds all rows of one order: fold these before, where one may be common.
    """
    spark = df.sparkSession
    weight = F.col(weight) if isinstance(weight, str) else weight
    rows = df.withColumn("|w", F.coalesce(weight.cast("long"), F.lit(0))).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*df.schema.fields, T.StructField("|sum", T.LongType()), T.StructField("|part", T.IntegerType())])

    def run(batches):
        total, c = 0, TaskContext.get()
        part = c.partitionId() if c else 0
        for b in batches:
            sums = total + np.cumsum(b.column(b.num_columns - 1).to_numpy())
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sums), pa.array(np.full(len(b), part), pa.int32())], names=schema.names)

    path = tables.shared(spark, "running")
    rows.mapInArrow(run, schema).write.parquet(path)
    made = spark.read.schema(schema).parquet(path)
    # a row for each task that had rows
    before = Window.orderBy("|part").rowsBetween(Window.unboundedPreceding, -1)
    starts = made.groupBy("|part").agg(F.max("|sum").alias("|all")).select("|part", F.coalesce(F.sum("|all").over(before), F.lit(0)).alias("|start"))
    return made.join(F.broadcast(starts), "|part").select(*(F.col(f"`{c}`") for c in df.columns), (F.col("`|sum`") + F.col("`|start`")).alias(name))


def numbered(df: DataFrame, order: list[str], name: str, have: int = 0) -> DataFrame:
    """df with numbers from have + 1 on, in an order."""
    out = running(df, order, F.lit(1), name)
    return out.withColumn(name, F.col(name) + have) if have else out


def quantiles(df: DataFrame, value: str, probs: list[float], *keys: str) -> DataFrame:
    """keys, n, q: count and exact quantiles, interpolated between neighbours, of each key's values (NULL left out).

    Values fold into counts first; running counts over (keys, value) tell which values hold the ranks asked for, and these alone are
    kept by an aggregate that combines in the tasks. So neither a key nor all distinct values meet in one task."""
    counts = df.select(*keys, F.col(value).cast("double").alias("|v")).where(F.col("`|v`").isNotNull()).groupBy(*(F.col(k) for k in keys), F.col("`|v`")).agg(F.count("*").alias("|n"))
    upto = running(counts, [*keys, "`|v`"], F.col("`|n`"), "|upto").withColumn("|from", F.col("`|upto`") - F.col("`|n`"))
    spans = upto.groupBy(*keys).agg(F.min("|from").alias("|first"), (F.max("|upto") - F.min("|from")).alias("n"))
    if keys:
        right = spans.withColumnsRenamed({k: f"|{k}" for k in keys})
        on = None
        for k in keys:
            same = F.col(k).eqNullSafe(F.col(f"`|{k}`"))
            on = same if on is None else on & same
        rows = upto.join(right, on)
    else:
        rows = upto.join(F.broadcast(spans))  # one row
    aggs = []
    for i, p in enumerate(probs):
        at = (F.col("n") - 1) * p
        for side, rank in (("l", F.floor(at)), ("h", F.ceil(at))):
            held = F.col("`|first`") + rank
            aggs.append(F.max(F.when((F.col("`|from`") <= held) & (held < F.col("`|upto`")), F.col("`|v`"))).alias(f"|{side}{i}"))
    found = rows.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)

    def between(i: int, p: float) -> Column:
        low, high, at = F.col(f"`|l{i}`"), F.col(f"`|h{i}`"), (F.col("n") - 1) * p
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return found.select(*keys, "n", F.array(*(between(i, p) for i, p in enumerate(probs))).alias("q"))


def digamma(x: Column) -> Column:
    """The derivative of the log of the gamma function, for x of 1 and more."""
    y = x + 6
    tail = F.ln(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8)
    for i in range(6):
        tail = tail - 1 / (x + i)
    return tail


#: Rows of a block in which neighbours are looked up.
BLOCK = 100_000


def neighbour_information(rows: DataFrame, names: list[str], label: str = "label", k: int = 3, block: int = BLOCK) -> DataFrame:
    """feature, mi: mutual information of each feature with a label of classes, by distances to the k-th neighbour of the same class.

    With N rows, N_c in a row's class and m rows of any class nearer than its k-th neighbour there (itself included):
    digamma(N) + mean(digamma(k)) - mean(digamma(N_c)) - mean(digamma(m)), at least 0. Equal values are folded; rows at
    distance 0 are neighbours; classes of one row are left out. A value's neighbours stand next to it in the order by (feature,
    class, value), which is cut into blocks with the k rows beyond each border; how many rows are nearer comes from running
    counts over all values merged with the bounds asked for. Rows with a NULL feature are left out for that feature.
    """
    f, x, n = F.col("feature"), F.col("x"), F.col("n")
    long = rows.select(F.col(label).cast("string").alias("y"), *(F.col(c).cast("double").alias(c) for c in names)).unpivot(["y"], list(names), "feature", "x").where("x is not null and y is not null")
    values = long.groupBy("feature", "y", "x").agg(F.count("*").alias("n"))
    sizes = values.groupBy("feature", "y").agg(F.sum("n").alias("size"))  # a row for each feature and class
    placed = running(values, ["feature", "y", "x"], F.lit(1), "at")
    home = F.floor(F.col("at") / block)
    spread = placed.withColumn("b", F.explode(F.array_distinct(F.array(F.floor((F.col("at") - k) / block), home, F.floor((F.col("at") + k) / block)))))
    w = Window.partitionBy("b").orderBy("at")
    sides = []
    for step in range(1, k + 1):
        for move in (F.lag, F.lead):
            same = (move("feature", step).over(w) == f) & (move("y", step).over(w) == F.col("y"))
            sides.append(F.when(same, F.struct(F.abs(move("x", step).over(w) - x).alias("r"), move("x", step).over(w).alias("v"), move("n", step).over(w).alias("n"))))
    near = spread.withColumn("near", F.array_sort(F.array_compact(F.array(*sides)))).where(F.col("b") == home).drop("b")
    near = near.join(F.broadcast(sizes), ["feature", "y"]).where("size > 1").withColumn("k", F.least(F.lit(k), F.col("size") - 1))
    # neighbours are taken, nearest first, until there are k
    start = F.struct((n - 1).alias("have"), F.lit(0.0).alias("r"), x.alias("v"))
    kth = F.aggregate("near", start, lambda a, e: F.when(a["have"] >= F.col("k"), a).otherwise(F.struct((a["have"] + e["n"]).alias("have"), e["r"].alias("r"), e["v"].alias("v"))))
    near = near.withColumn("kth", kth).withColumns({"r": F.col("kth.r"), "v": F.col("kth.v")})
    low, high = F.when(F.col("v") < x, F.col("v")).otherwise(x - F.col("r")), F.when(F.col("v") > x, F.col("v")).otherwise(x + F.col("r"))
    near = near.select("feature", "x", "n", "at", "size", "k", "r", low.alias("low"), high.alias("high"))
    # nearer than r: above low and under high; at r = 0: equal. At one value, bounds of rank 0 come before the rows and those of rank 2 after
    flat = F.col("r") == 0
    ask = near.select("feature", "at", F.explode(F.array(
        F.struct(F.col("low").alias("x"), F.when(flat, 0).otherwise(2).alias("rank"), F.lit(-1).alias("sign")),
        F.struct(F.col("high").alias("x"), F.when(flat, 2).otherwise(0).alias("rank"), F.lit(1).alias("sign")),
    )).alias("e")).select("feature", "e.x", "e.rank", "at", "e.sign", F.lit(0).cast("long").alias("n"))
    points = near.groupBy("feature", "x").agg(F.sum("n").alias("n")).select("feature", "x", F.lit(1).alias("rank"), F.lit(None).cast("long").alias("at"), F.lit(0).alias("sign"), "n")
    under = running(points.unionByName(ask), ["feature", "x", "rank"], "n", "upto").where("sign <> 0")
    m = under.groupBy("at").agg(F.sum(F.col("sign") * F.col("upto")).alias("m"))
    got = near.join(m, "at").groupBy("feature").agg(F.sum("n").alias("rows"), *(F.sum(n * digamma(F.col(c).cast("double"))).alias(f"d_{c}") for c in ("k", "size", "m")))
    mi = digamma(F.col("rows").cast("double")) + (F.col("d_k") - F.col("d_size") - F.col("d_m")) / F.col("rows")
    found = got.select(f, F.greatest(mi, F.lit(0.0)).alias("mi"))
    every = rows.sparkSession.createDataFrame([(c,) for c in names], "feature string")
    return every.join(found, "feature", "left").select("feature", F.coalesce("mi", F.lit(0.0)).alias("mi"))
