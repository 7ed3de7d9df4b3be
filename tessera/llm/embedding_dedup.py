"""Embedding near-dedup by Euclidean p-stable hashing with exact cosine checks.

Vectors are normalised and projected on Gaussian directions; a table's key is the
tuple of floor((a.v + b) / width) over its projections. Vectors that share a key in
any table are candidates, and every candidate pair's cosine is then taken in double
precision. With 10 projections of width 2 a pair at cosine 0.95 (distance 0.316)
shares a key in one table with probability 0.26, in one of 16 with 0.992; closer
pairs are found more surely (0.9998 at 0.98).

Equal vectors are one row with a count before they are hashed. Keys go out alone first:
a bucket of one vector is dropped, and so is a bucket that holds the very vectors of a
bucket of an earlier table, as groups of near copies do. Only for what is left do vectors
follow. A key beyond BUCKET_ROWS vectors is dealt into blocks, and every pair of blocks
meets in a unit of its own, so no bucket is gathered whole. Pairs never leave a unit: it
gives each of its vectors a number of links, and links enough to join them. A pair that
meets in several tables counts in the first of them alone, which both rows' keys tell.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and are components of their own; a vector of another
length than its fellow does not link with it; rows with a null id take no part (no
links, null component, not kept); equal vectors link as any others; rows that share an
id count each by its own vector, and a component goes by the least id in it; labels and
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Stage, bounded_batches, hot_join, parts_of
from .components import connected_components, star_forest

THRESHOLD = 0.95
TABLES = 16
PROJECTIONS = 10
WIDTH = 2.0
SEED = 11
#: Vectors of a bucket that are compared in one unit.
BUCKET_ROWS = 1024


def directions(dim: int, tables: int, projections: int, width: float, seed: int):
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * projections)), rng.uniform(0, width, tables * projections), rng.integers(1, 1 << 62, tables * projections, dtype=np.int64) | 1


def keys_of(vectors: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """A 32-bit key for each table. vectors: unit rows."""
    a, b, mix = directions(vectors.shape[1], tables, projections, width, seed)
    cells = np.floor((vectors @ a + b) / width).astype(np.int64)
    mixed = (cells * mix).reshape(len(vectors), tables, projections).sum(axis=2)
    return ((mixed ^ (mixed >> 29)) * np.int64(0x1B873593CC9E2D51) >> 32).astype(np.int32)


def _valid():
    """Vectors that can link: no null or non-finite component, not zero."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _hashed(vectors: DataFrame, tables: int, projections: int, width: float, seed: int) -> DataFrame:
    """node, copies, the vector's bytes as it was given, and its 32-bit keys."""
    bounded_batches(vectors.sparkSession)
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"

    def run(batches):
        for batch in batches:
            rows = [np.asarray(x, np.float32 if single else np.float64) for x in batch.column(2).to_pylist()]
            keys: list = [None] * len(rows)
            for dim in {len(r) for r in rows}:
                at = [k for k, r in enumerate(rows) if len(r) == dim]
                own = _unit(np.stack([rows[k] for k in at]))
                for k, row in zip(at, keys_of(own, tables, projections, width, seed)):
                    keys[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(keys, pa.binary())], names=["node", "copies", "vector", "keys"])

    return vectors.select("node", "copies", "embedding").mapInArrow(run, "node long, copies long, vector binary, keys binary")


def _unit(rows: np.ndarray) -> np.ndarray:
    """Unit rows in double precision."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _meetings(hashed: DataFrame, tables: int, stage: Stage) -> DataFrame:
    """t, bucket, node and n of buckets with several vectors, without those that repeat a bucket of an earlier table."""
    part = F.array(*[F.xxhash64(F.lit(t), F.substring("keys", 4 * t + 1, 4), F.length("vector")) for t in range(tables)])
    rows = stage.write(hashed.select("node", F.posexplode(part).alias("t", "bucket")))
    mark = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"m{k}") for k in range(2)]
    sizes = rows.groupBy("bucket").agg(F.first("t").alias("t"), F.count("*").alias("n"), *mark).where("n > 1")
    # buckets of equal members have equal counts and marks
    firsts = sizes.groupBy("n", "m0", "m1").agg(F.min(F.struct("t", "bucket")).alias("x"))
    kept = stage.write(firsts.select("x.bucket", "n", F.col("n").alias("rows")))
    total = kept.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return stage.write(hot_join(rows, kept, ["bucket"], total).withColumnRenamed("rows", "n"))


def _compare(table: int, node, copies, x, keys, side, threshold: float):
    """Numbers of links by row, and links, of one unit."""
    unit = _unit(x)
    first = np.flatnonzero(side != 1)
    second = np.flatnonzero(side != 0)
    near = unit[first] @ unit[second].T >= threshold
    i, j = np.nonzero(near)
    i, j = first[i], second[j]
    if side[0] == 2:
        i, j = i[i < j], j[i < j]
    new = np.ones(len(i), bool)
    for t in range(table):
        new &= keys[i, t] != keys[j, t]
    u, v = i[new], j[new]
    links = np.bincount(u, copies[v], len(node)) + np.bincount(v, copies[u], len(node))
    return links.astype(np.int64), node[u], node[v]


#: Vectors of units that one task takes.
TASK_ROWS = 1 << 18


def _linked(hashed: DataFrame, threshold: float, tables: int, bucket_rows: int, stage: Stage, element: str) -> DataFrame:
    """node, links (within a unit), other (a link, or null)."""
    kind = np.float32 if element == "float" else np.float64
    rows = _meetings(hashed, tables, stage)
    blocks = F.ceil(F.col("n") / bucket_rows).cast("int")
    placed = rows.withColumns({"_blocks": blocks, "_own": F.pmod(F.xxhash64("node"), blocks).cast("int")})
    meets = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda k: F.struct(F.xxhash64("bucket", F.least(k, F.col("_own")), F.greatest(k, F.col("_own"))).alias("unit"), F.when(k == F.col("_own"), 2).when(k > F.col("_own"), 0).otherwise(1).alias("side")),
    )
    alone = F.array(F.struct(F.col("bucket").alias("unit"), F.lit(2).alias("side")))
    dealt = placed.select("t", "node", F.explode(F.when(F.col("_blocks") <= 1, alone).otherwise(meets)).alias("x")).select("x.unit", "x.side", "t", "node")
    units = dealt.join(hashed, "node").select("unit", "side", "t", "node", "copies", "vector", "keys")

    def run(batches):
        unit, held = None, []

        def out():
            for dim in {len(r[4]) for r in held}:
                own = [r for r in held if len(r[4]) == dim]
                if len(own) < 2:
                    continue
                side, node, copies = (np.array([r[k] for r in own], np.int64) for k in (0, 2, 3))
                x, keys = np.frombuffer(b"".join(r[4] for r in own), kind).reshape(len(own), -1), np.frombuffer(b"".join(r[5] for r in own), np.int32).reshape(len(own), -1)
                n, u, v = _compare(own[0][1], node, copies, x, keys, side, threshold)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                yield node[some], n[some], np.full(len(some), -1), np.zeros(len(some), bool)
                apart = u != v
                if apart.any():
                    u, v = star_forest(u[apart], v[apart])
                    yield u, np.zeros(len(u), np.int64), v, np.ones(len(u), bool)

        def flushed(parts):
            if parts:
                a, n, b, link = (np.concatenate(p) for p in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(b, pa.int64(), mask=~link)], names=["node", "links", "other"])

        for batch in itertools.chain(batches, [None]):
            parts: list = []
            if batch is None:
                parts += out()
            else:
                columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
                for key, *row in zip(*columns):
                    if key != unit:
                        if len(held) > 1:
                            parts += out()
                        unit, held = key, []
                    held.append(row)
            yield from flushed(parts)

    return units.repartition(parts_of(rows.count(), TASK_ROWS), "unit").sortWithinPartitions("unit").mapInArrow(run, "node long, links long, other long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    stage = Stage(vectors.sparkSession, "pstable")
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    element = element if element in ("float", "double") else "double"
    # adding zero makes -0.0 equal to 0.0
    own = F.transform(F.col("embedding").cast(f"array<{element}>"), lambda x: (x + F.lit(0.0).cast(element)).cast(element))
    rows = vectors.select("vec_id", own.alias("embedding"))
    usable = rows.where(_valid() & F.col("vec_id").isNotNull())
    # a vector goes by a number of its own, and rows find it by 128 bits of it
    marks = [F.xxhash64(F.lit(k), "embedding").alias(f"h{k}") for k in (1, 2)]
    grouped = usable.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    distinct = stage.write(grouped.select(F.monotonically_increasing_id().alias("node"), "embedding", "rep", "copies", *marks))
    hashed = stage.write(_hashed(distinct, tables, projections, width, seed))
    found = stage.write(_linked(hashed, threshold, tables, bucket_rows, stage, element))
    component = connected_components(found.where(F.col("other").isNotNull()).select(F.col("node").alias("u"), F.col("other").alias("v")), stage)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    own = distinct.select("node", "rep", "copies", "h1", "h2").join(links, "node", "left").join(component, "node", "left")
    named = stage.write(own.select("h1", "h2", "rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"), F.col("copies").alias("n")))
    least = stage.write(named.groupBy("component").agg(F.min("rep").alias("found"), F.count("*").alias("n")))
    total = named.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    by_vector = stage.write(hot_join(named.withColumnRenamed("n", "rows"), least, ["component"], total[0]).select("h1", "h2", "n_links", "found", F.col("rows").alias("n")))
    stage.keep(by_vector)
    linked = hot_join(rows.where(_valid() & F.col("vec_id").isNotNull()).select("vec_id", *marks), by_vector, ["h1", "h2"], total[1]).select("vec_id", "n_links", F.col("found").alias("component_id"))
    alone = rows.where(~(_valid() & F.col("vec_id").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
