"""Exact ranks and percentiles of large groups without one task for a group.

Values are counted in equal bins between their group's extremes; only the bin that holds a wanted rank is
sorted, as distinct values with their counts. No window spans more than the bins of a group, or one bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096


def place(v: Column, lo: Column, hi: Column, bins: int = BINS) -> Column:
    """The equal bin between two extremes."""
    return F.when(hi > lo, F.least(F.lit(bins - 1), F.floor((v - lo) / (hi - lo) * bins))).otherwise(F.lit(0)).cast("int")


def order_statistics(x: DataFrame, col: str, wanted: DataFrame, by: str = "study") -> DataFrame:
    """(by, k, value): the values of rank k, from 0 upwards, that wanted(by, k) asks for. `x` is read three times."""
    x = x.select(by, F.col(col).cast("double").alias("v")).where("v is not null")
    ends = x.groupBy(by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    placed = x.join(ends, by).select(by, "v", place(F.col("v"), F.col("lo"), F.col("hi")).alias("bin"))
    so_far = Window.partitionBy(by).orderBy("bin")
    bins = placed.groupBy(by, "bin").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(so_far) - F.col("n"))
    hit = bins.join(wanted, by).where("k >= before and k < before + n").select(by, "bin", "k", "before")
    inside = placed.join(hit.select(by, "bin").distinct(), [by, "bin"]).groupBy(by, "bin", "v").agg(F.count("*").alias("n"))
    inside = inside.withColumn("ahead", F.sum("n").over(Window.partitionBy(by, "bin").orderBy("v")) - F.col("n"))
    return inside.join(hit, [by, "bin"]).where("k >= before + ahead and k < before + ahead + n").select(by, "k", F.col("v").alias("value"))


def percentile(x: DataFrame, col: str, share: float, by: str = "study") -> DataFrame:
    """(by, cut): the exact percentile of each group, interpolated between ranks."""
    sizes = x.where(F.col(col).isNotNull()).groupBy(by).agg(((F.count("*") - 1) * F.lit(share)).alias("at"))
    wanted = sizes.select(by, F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("k"))
    found = order_statistics(x, col, wanted, by).join(sizes, by).groupBy(by, "at").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return found.select(by, (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias("cut"))


def largest(x: DataFrame, col: str, most: int, ties: tuple[str, ...], by: str = "study") -> DataFrame:
    """The `most` rows of each group with the largest values, equal ones in the order of `ties`; x is a written table."""
    wanted = x.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > most).select(by, (F.col("n") - most).alias("k"))
    cut = order_statistics(x, col, wanted, by).select(by, F.col("value").alias("cut"))
    marked = x.join(cut, by, "left")
    sure = marked.where(F.col("cut").isNull() | (F.col(col) > F.col("cut"))).drop("cut")
    above = marked.where(F.col(col) > F.col("cut")).groupBy(by).agg(F.count("*").alias("above"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*ties))  # among the rows equal to the cut alone
    even = marked.where(F.col(col) == F.col("cut")).join(above, by, "left").withColumn("nth", nth + F.coalesce("above", F.lit(0)))
    return sure.union(even.where(F.col("nth") <= most).select(*x.columns))


def numbered(x: DataFrame, by: str, order: str, out: str = "pos") -> DataFrame:
    """x with the row number, from 1, of each row of its group in the order of a number or time; nulls come first."""
    v = F.col(order).cast("double")
    ends = x.groupBy(by).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    placed = x.join(ends, by).withColumn("_bin", F.when(v.isNull(), F.lit(-1)).otherwise(place(v, F.col("_lo"), F.col("_hi")))).drop("_lo", "_hi")
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_bin")) - F.col("_n")
    bins = placed.groupBy(by, "_bin").agg(F.count("*").alias("_n")).select(by, "_bin", before.alias("_before"))
    nth = F.row_number().over(Window.partitionBy(by, "_bin").orderBy(order))
    return placed.join(bins, [by, "_bin"]).withColumn(out, (nth + F.col("_before")).cast("long")).drop("_bin", "_before")
