"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.shared import shared_dir

#: Bytes of one Arrow batch sent to Python, so that very long texts do not pile up in a worker.
ARROW_BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows; rows alone do not bound long texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(ARROW_BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash() -> list[Column]:
    """h1 and h2: 128 bits of a text; a null one is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(17), text).alias("h2")]


#: A key that holds more than one in so many rows is joined apart from the rest.
HOT_SHARE = 200


def hot_join(rows: DataFrame, keyed: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows joined to keyed, which has a row a key and `n`, about how many of the `total` rows hold it.

    Keys of over one in HOT_SHARE rows, a few hundred at most, are broadcast, so that no
    key's rows gather in a task; a filter by their values keeps their rows out of the
    shuffle by which the rest meets. keyed should be a table: it is read once more to find
    them. Without such keys this is one join.
    """
    bound = max(1, total // HOT_SHARE)
    hot, rest = keyed.where(F.col("n") > bound).drop("n"), keyed.where(F.col("n") <= bound).drop("n")
    values = hot.select(*on).dropna().collect()
    if not values:
        return rows.join(rest, on)
    kinds = [keyed.schema[c].dataType for c in on]
    key, pack = (F.col(on[0]), lambda x: x) if len(on) == 1 else (F.struct(*on), F.struct)
    known = [pack(*[F.lit(x).cast(kind).alias(c) for x, kind, c in zip(row, kinds, on)]) for row in values]
    here = rows.join(F.broadcast(hot), on)
    return here.unionByName(rows.where(~key.isin(known)).join(rest, on).select(*here.columns))


def parts_of(n: int, per: int) -> int:
    """How many tasks n rows make, `per` rows to a task."""
    return max(1, math.ceil(n / per))


class Stage:
    """Intermediate tables of one run, written to the shared folder to cut lineage.

    A lost executor then costs the re-read of a file, not the recomputation of
    what led to it. drop() and keep() remove tables that no plan reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_tessera_path", None)
        if path:
            self._delete(path)

    def keep(self, *tables: DataFrame) -> None:
        """Remove every table of the run but these, which plans still read."""
        held = {getattr(df, "_tessera_path", None) for df in tables}
        for k in range(self.count):
            if f"{self.root}/{k}" not in held:
                self._delete(f"{self.root}/{k}")

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
