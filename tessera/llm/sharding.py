"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one gives every row a number, scatters the rows by a seeded hash of row and number
uniformly into memory-sized buckets and writes them to the shared folder. Pass two puts
each bucket into a task of its own, permutes it by Spark's `shuffle` (a Fisher-Yates
permutation in the JVM, seeded by seed + bucket) and lays the buckets end to end; position
p goes to shard p mod n, slot p div n. Counts of shards hence differ by one at most. Whole
rows are written once and shuffled once. Equal rows differ in their numbers and scatter
like any others. Map columns, which cannot be put in order, go as their sorted entries.

Defined cases: a null text has size 8 and the CRC of no bytes (0); null ids and
repeated rows are ordinary rows, each copy with a place of its own; an empty table
gives an empty result. A row that makes up a third of the table is spread over all buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import MapType

from .common import Stage

N_SHARDS = 24
SEED = 20240
BUCKET_BYTES = 32 << 20
#: Bytes that a record takes in a bucket besides its own size.
RECORD_OVERHEAD = 64
#: Buckets up to which their places are broadcast (16 bytes each).
BROADCAST_BUCKETS = 1_000_000


def two_pass_shuffle(records: DataFrame, weight, n_shards: int = N_SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The columns of `records` with shard int and slot long. weight: column, bytes of a record."""
    stage = Stage(records.sparkSession, "shard")
    maps = {f.name for f in records.schema.fields if isinstance(f.dataType, MapType)}
    own = [(F.array_sort(F.map_entries(F.col(f"`{c}`"))) if c in maps else F.col(f"`{c}`")).alias(c) for c in records.columns]
    total = records.agg(F.sum(weight.cast("long") + RECORD_OVERHEAD)).first()[0] or 0
    n_buckets = max(1, math.ceil(total / bucket_bytes))
    numbered = records.select(F.struct(*own).alias("record"), F.monotonically_increasing_id().alias("copy"))
    scattered = stage.write(numbered.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "record", "copy"), F.lit(n_buckets)).cast("int")))
    sizes = scattered.groupBy("bucket").agg(F.count("*").alias("size"))
    ends = sizes.select("bucket", F.expr("sum(size) OVER (ORDER BY bucket) - size").alias("first"))
    dealt = scattered.repartitionById(n_buckets, F.col("bucket"))
    mixed = dealt.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("copy", "record"))).alias("rows"))
    mixed = mixed.select("bucket", F.shuffle("rows", F.lit(seed)).alias("rows"))
    # one row for each bucket of bucket_bytes
    placed = mixed.join(F.broadcast(ends) if n_buckets <= BROADCAST_BUCKETS else ends, "bucket").select("first", F.posexplode("rows").alias("at", "row"))
    placed = placed.select("row", (F.col("first") + F.col("at")).alias("place"))
    fields = [(F.map_from_entries(F.col("row.record").getField(c)) if c in maps else F.col("row.record").getField(c)).alias(c) for c in records.columns]
    return placed.select(*fields, (F.col("place") % n_shards).cast("int").alias("shard"), F.expr(f"place div {n_shards}").alias("slot"))


def write_shards(records: DataFrame, path: str, n_shards: int = N_SHARDS, seed: int = SEED) -> None:
    """Write whole records as n_shards folders shard=k, each in slot order."""
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in records.columns), F.lit(0))
    placed = two_pass_shuffle(records, size, n_shards, seed)
    placed.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("slot").write.partitionBy("shard").parquet(path)


def place_documents(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """Whole rows of docs with shard and slot, in names that clash with none of theirs: record (all columns), shard, slot."""
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    text = F.col(f"c{docs.columns.index('text')}")
    placed = two_pass_shuffle(plain, F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8), n_shards, seed)
    return placed.select(F.struct(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)]).alias("record"), "shard", "slot")


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law 'rows', shard, slot, grown_shard (null under this law), told from the placed rows."""
    text = F.coalesce(F.col("record.text"), F.lit(""))
    placed = place_documents(docs, n_shards, seed)
    return placed.select("record.doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
