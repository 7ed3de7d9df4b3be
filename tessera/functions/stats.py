"""Order statistics, ranks and the shared random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def hash_number(*parts: Column) -> Column:
    """A number from 0 to 2**32 - 1 by MD5 of the parts: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def order_statistics(rows: DataFrame, value: str, picks: dict[str, float], *by: str) -> DataFrame:
    """by and, for each pick of name to share, the value at place floor(share * n) of the group's sorted values, from 0.

    Nulls are left out; a group without values has no row. Equal values are counted before
    the shuffle and run through a window in order, which spills; no group is held as a list.
    """
    own = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_x")).agg(F.count("*").alias("_m"))
    sizes = own.groupBy(*by).agg(F.sum("_m").alias("_n"))
    upto = own.withColumn("_upto", F.sum("_m").over(Window.partitionBy(*by).orderBy("_x")))
    both = upto.join(sizes, list(by)) if by else upto.join(F.broadcast(sizes))
    out = both.groupBy(*by).agg(*[F.min(F.when(F.col("_upto") > F.floor(F.col("_n") * F.lit(share)), F.col("_x"))).alias(name) for name, share in picks.items()])
    return out if by else out.where(F.col(next(iter(picks))).isNotNull())


def average_rank(value: str | Column, *group: str) -> Column:
    """Rank from 1, ties sharing their mean, within the group: one window gives a row's rank and the rows up to its ties."""
    own = Window.partitionBy(*group).orderBy(value)
    return (F.rank().over(own) + F.count(F.lit(1)).over(own)) / F.lit(2.0)
