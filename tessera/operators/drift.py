"""Year-over-year drift of sections, theme counts and threshold calibration."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .surfaces import encoded_or_error

UNCHANGED, MODIFIED = 0.95, 0.80
MIN_SIDE, MIN_RATIO = 5, 0.35
DIFF_CHARS = 1200
#: Rows of a side that meet another side's as one matrix.
TILE_ROWS = 1024

#: Words that mark a theme. Fixed values.
THEMES = {
    "supply_chain": ("supply chain", "supplier", "component", "manufactur", "single source", "sole source", "logistics"),
    "cybersecurity": ("cyber", "data breach", "information security", "unauthorized access", "ransomware"),
    "regulatory": ("regulat", "compliance", "antitrust", "governmental", "legislation", "sanction"),
    "litigation": ("litigation", "lawsuit", "legal proceeding", "claim against"),
    "macro": ("inflation", "interest rate", "recession", "economic condition", "geopolitical"),
    "talent": ("personnel", "talent", "key employee", "retention", "labor"),
    "climate": ("climate", "environmental", "emission", "sustainability"),
    "concentration": ("concentration", "significant customer", "depend on a", "substantial portion"),
    "liquidity": ("liquidity", "credit facility", "indebtedness", "covenant"),
    "ai_technology": ("artificial intelligence", "machine learning", "generative ai"),
}


def band(similarity: Column, unchanged: float = UNCHANGED, modified: float = MODIFIED) -> Column:
    return F.when(similarity >= unchanged, "unchanged").when(similarity >= modified, "modified").otherwise("new")


def _tiles(rows: DataFrame, block: tuple[str, ...], tile_rows: int, names: tuple[str, str]) -> DataFrame:
    """block and arrays of ids and vectors of up to about tile_rows rows; a block of many rows becomes many tiles."""
    sizes = rows.groupBy(*block).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("_n"))
    dealt = rows.join(sizes, list(block)).withColumn("_tile", F.pmod(F.xxhash64("id"), F.col("_n")))
    own = dealt.groupBy(*block, "_tile").agg(F.collect_list(F.struct("id", "vector")).alias("_rows"))
    return own.select(*block, F.col("_rows.id").alias(names[0]), F.col("_rows.vector").alias(names[1]))


def _matrix(vectors) -> np.ndarray:
    """Unit rows; null and zero vectors become zero rows."""
    dim = max((len(v) for v in vectors if v is not None), default=1)
    rows = np.array([np.zeros(dim) if v is None else np.asarray(v, np.float64) for v in vectors])
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1.0)


def best_matches(current: DataFrame, prior: DataFrame, *block: str, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """The likest prior row of each current row, and the highest similarity of each prior row; rows of blocks with both sides.

    block, current_id, prior_id, similarity; and block, prior_id, similarity. Tiles of both
    sides meet as matrices, and one row for each of a pair's rows leaves it, so a block's
    pairs are never rows. Similarities equal to 12 digits go to the smaller id.
    """
    kinds = [f"{c} {current.schema[c].dataType.simpleString()}" for c in block]
    ids = (current.schema["id"].dataType.simpleString(), prior.schema["id"].dataType.simpleString())
    pairs = _tiles(current.select(*block, "id", "vector"), block, tile_rows, ("_a", "_x")).join(_tiles(prior.select(*block, "id", "vector"), block, tile_rows, ("_b", "_y")), list(block))
    width = len(block)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                a, x, b, y = (batch.column(width + c)[k].as_py() for c in range(4))
                order = sorted(range(len(b)), key=b.__getitem__)
                b, y = [b[i] for i in order], [y[i] for i in order]
                scores = np.round(_matrix(x) @ _matrix(y).T, 12) + 0.0
                best = scores.argmax(axis=1)
                n = len(a) + len(b)
                own = [pa.array([batch.column(c)[k].as_py()] * n, batch.column(c).type) for c in range(width)]
                columns = [pa.array([*a, *[None] * len(b)], batch.column(width).type.value_type), pa.array([*[b[i] for i in best], *b], batch.column(width + 2).type.value_type), pa.array([*scores[np.arange(len(a)), best], *scores.max(axis=0)], pa.float64())]
                yield pa.RecordBatch.from_arrays([*own, *columns], names=[*block, "current_id", "prior_id", "similarity"])

    met = pairs.select(*block, "_a", "_x", "_b", "_y").mapInArrow(run, ", ".join([*kinds, f"current_id {ids[0]}", f"prior_id {ids[1]}", "similarity double"]))
    first = met.where("current_id IS NOT NULL").groupBy(*block, "current_id").agg(F.min(F.struct((-F.col("similarity")).alias("low"), "prior_id")).alias("best"))
    top = met.where("current_id IS NULL").groupBy(*block, "prior_id").agg(F.max("similarity").alias("similarity"))
    return first.select(*block, "current_id", F.col("best.prior_id").alias("prior_id"), (-F.col("best.low")).alias("similarity")), top


def align(current: DataFrame, prior: DataFrame, *block: str, unchanged: float = UNCHANGED, modified: float = MODIFIED, tile_rows: int = TILE_ROWS) -> DataFrame:
    """block, status, current_id, prior_id, similarity: each current row with its likest prior row of the block.

    current, prior: id (of any type), vector and the block's columns. Several rows may take
    one prior row. Prior rows that none takes are `removed`, with the best similarity they
    had; an empty side leaves the other side all new or all removed at 0.
    """
    best, top = best_matches(current, prior, *block, tile_rows=tile_rows)
    c, p = current.select(*block, F.col("id").alias("current_id")), prior.select(*block, F.col("id").alias("prior_id"))
    matched = c.join(best, [*block, "current_id"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    taken = matched.withColumn("status", band(F.col("similarity"), unchanged, modified)).withColumn("prior_id", F.when(F.col("status") != "new", F.col("prior_id")))
    out = taken.select(*block, "status", "current_id", "prior_id", "similarity")
    gone = p.join(taken.where("prior_id IS NOT NULL").select(*block, "prior_id").distinct(), [*block, "prior_id"], "left_anti").join(top, [*block, "prior_id"], "left")
    return out.unionByName(gone.select(*block, F.lit("removed").alias("status"), F.lit(None).cast(current.schema["id"].dataType).alias("current_id"), "prior_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity")))


def diff_texts(current: DataFrame, prior: DataFrame, encode: Callable[[list[str]], np.ndarray], *block: str, unchanged: float = UNCHANGED, modified: float = MODIFIED) -> DataFrame:
    """align() of encoded texts, with `text` (the first DIFF_CHARS) of new and modified rows, similarity to 3 digits, and `error`.

    current, prior: id, text and the block's columns. Where the encoder fails the rows of
    its batch have an error and no status; they fail no job and take no part.
    """

    def encoded_rows(rows: DataFrame) -> DataFrame:
        cut = F.substring(F.coalesce("text", F.lit("")), 1, DIFF_CHARS)
        return rows.select(*block, "id", cut.alias("text"), encoded_or_error(cut, encode).alias("_e")).select(*block, "id", "text", F.col("_e.vector").alias("vector"), F.col("_e.error").alias("error"))

    a, b = encoded_rows(current), encoded_rows(prior)
    out = align(a.where("error IS NULL"), b.where("error IS NULL"), *block, unchanged=unchanged, modified=modified)
    texts = a.select(*block, F.col("id").alias("current_id"), F.col("text").alias("_text"))
    shown = out.join(texts, [*block, "current_id"], "left").withColumn("text", F.when(F.col("status").isin("new", "modified"), F.col("_text")))
    done = shown.select(*block, "status", "current_id", "prior_id", F.round("similarity", 3).alias("similarity"), "text", F.lit(None).cast("string").alias("error"))
    for rows, side in ((a, "current_id"), (b, "prior_id")):
        other = "prior_id" if side == "current_id" else "current_id"
        failed = rows.where("error IS NOT NULL").select(*block, F.lit(None).cast("string").alias("status"), F.col("id").alias(side), F.lit(None).cast(out.schema[other].dataType).alias(other), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("string").alias("text"), "error")
        done = done.unionByName(failed)
    return done


def size_mismatch(n_current: Column, n_prior: Column) -> Column:
    """Sides too small or too unlike in size to compare; false where one is empty (that has its own reason)."""
    both = (n_current > 0) & (n_prior > 0)
    return both & ((F.least(n_current, n_prior) < MIN_SIDE) | (F.least(n_current, n_prior) / F.greatest(n_current, n_prior, F.lit(1)) < MIN_RATIO))


def drift_summary(aligned: DataFrame, sides: DataFrame, *block: str) -> DataFrame:
    """Counts, drift (null where undefined) and the reason. sides: block, n_current, n_prior."""
    counts = aligned.groupBy(*block).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("unchanged", "modified", "new", "removed")])
    own = sides.join(counts, list(block), "left").na.fill(0, [f"n_{s}" for s in ("unchanged", "modified", "new", "removed")])
    reason = F.when(F.col("n_current") == 0, "no_current").when(F.col("n_prior") == 0, "no_baseline").when(size_mismatch(F.col("n_current"), F.col("n_prior")), "size_mismatch")
    total = F.col("n_unchanged") + F.col("n_modified") + F.col("n_new")
    score = F.round((F.col("n_new") + F.col("n_modified")) / F.greatest(total, F.lit(1)), 4)
    return own.withColumn("reason", reason).withColumn("drift", F.when(F.col("reason").isNull(), score))


def theme_table(spark, themes: dict[str, tuple[str, ...]] = THEMES) -> DataFrame:
    return spark.createDataFrame([(t, list(w)) for t, w in themes.items()], "theme string, words array<string>")


def theme_counts(texts: DataFrame, themes: DataFrame, *by: str, chars: int = DIFF_CHARS) -> DataFrame:
    """by, theme, n: texts whose first characters hold any word of the theme; each text counts once a theme."""
    table = themes.agg(F.collect_list(F.struct("theme", "words")).alias("themes"))
    head = F.lower(F.substring("text", 1, chars))
    held = F.filter("themes", lambda t: F.exists(t["words"], lambda w: F.contains(head, w)))
    return texts.join(F.broadcast(table)).select(*by, F.explode(held).alias("t")).groupBy(*by, F.col("t.theme").alias("theme")).agg(F.count("*").alias("n"))


def confusion(labelled: DataFrame) -> DataFrame:
    """label, predicted, n."""
    return labelled.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def class_report(labelled: DataFrame) -> DataFrame:
    """label, precision, recall, support for each label."""
    rows = labelled.select(F.inline(F.array(F.struct(F.col("label").alias("c"), F.lit(1).alias("actual"), F.lit(0).alias("claimed")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("actual"), F.lit(1).alias("claimed")))), (F.col("label") == F.col("predicted")).cast("int").alias("right"))
    own = rows.groupBy(F.col("c").alias("label")).agg(F.sum("actual").alias("support"), F.sum("claimed").alias("claimed"), F.sum(F.col("right") * F.col("actual")).alias("right"))
    return own.select("label", F.try_divide("right", "claimed").alias("precision"), F.try_divide("right", "support").alias("recall"), "support")


def sweep(scored: DataFrame, grid: DataFrame) -> DataFrame:
    """unchanged, modified, accuracy, best for each pair of thresholds. scored: similarity, label; grid: a small table.

    The grid is an array beside each row, so counts are summed where the rows are.
    """
    cells = grid.agg(F.collect_list(F.struct("unchanged", "modified")).alias("cells"))
    predicted = F.when(F.col("similarity") >= F.col("c.unchanged"), "unchanged").when(F.col("similarity") >= F.col("c.modified"), "modified").otherwise("new")
    rows = scored.join(F.broadcast(cells)).select("similarity", "label", F.explode("cells").alias("c"))
    out = rows.groupBy("c.unchanged", "c.modified").agg(F.avg((predicted == F.col("label")).cast("double")).alias("accuracy"))
    return out.withColumn("best", F.col("accuracy") == F.max("accuracy").over(Window.partitionBy()))


def class_ranges(scored: DataFrame) -> DataFrame:
    """label, n, least, mean, most of the similarities."""
    x = F.col("similarity")
    return scored.groupBy("label").agg(F.count("*").alias("n"), F.min(x).alias("least"), F.avg(x).alias("mean"), F.max(x).alias("most"))


def separation(scored: DataFrame) -> DataFrame:
    """One row: the gaps between neighbouring classes (negative where they overlap) and the thresholds in their middles.

    unchanged_gap, modified_gap, unchanged, modified: a gap runs from the highest of the
    lower class to the lowest of the upper one; null where a class is missing.
    """
    x = F.col("similarity")
    own = scored.agg(*[f(F.when(F.col("label") == c, x)).alias(f"{n}_{c}") for c in ("unchanged", "modified", "new") for n, f in (("low", F.min), ("high", F.max))])
    gap = lambda a, b: F.col(f"low_{a}") - F.col(f"high_{b}")
    mid = lambda a, b: (F.col(f"low_{a}") + F.col(f"high_{b}")) / 2
    return own.select(gap("unchanged", "modified").alias("unchanged_gap"), gap("modified", "new").alias("modified_gap"), mid("unchanged", "modified").alias("unchanged"), mid("modified", "new").alias("modified"))
