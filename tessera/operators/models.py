"""Walk-forward evaluation of ridge regression, with permutation tests."""

from __future__ import annotations

import hashlib
import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.stats import average_rank
from ..sources.shared import new_folder

ALPHA = 10.0
MIN_TRAIN, MIN_TEST = 40, 5
PERMUTATIONS = 200
#: Boosted models that are fitted side by side.
FITS_AT_A_TIME = 4


def prepared(frame: DataFrame, features: list[str], target: str) -> DataFrame:
    """Features as doubles, infinite ones null; rows without a finite target are dropped."""

    def finite(name: str) -> Column:
        x = F.col(name).try_cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x).alias(name)

    keys = [c for c in frame.columns if c not in features and c != target]
    return frame.select(*keys, *[finite(c) for c in features], finite(target)).where(F.col(target).isNotNull())


def spearman(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """by, ic: correlation of average ranks; null under three rows or with one value of x."""
    ranked = rows.select(*by, average_rank(x, *by).alias("rx"), average_rank(y, *by).alias("ry"), F.col(x).alias("x"))
    return ranked.groupBy(*by).agg(F.when((F.count("*") > 2) & (F.min("x") < F.max("x")) & (F.stddev_pop("ry") > 0), F.corr("rx", "ry")).alias("ic"))


def rank_auc(rows: DataFrame, score: str, label: str, *by: str) -> DataFrame:
    """by, auc from rank sums; null unless both classes are there."""
    ranked = rows.select(*by, average_rank(score, *by).alias("r"), F.col(label).cast("int").alias("positive"))
    p, n = F.sum("positive"), F.count("*")
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(F.when(F.col("positive") == 1, F.col("r"))) - p * (p + 1) / F.lit(2.0), p * (n - p)).alias("auc"))


def fold_statistics(frame: DataFrame, year: str, feature: str) -> DataFrame:
    """fold (test year), n_train, median, mean and sample deviation of what comes before it."""
    folds = frame.select(F.col(year).alias("fold")).distinct()
    earlier = frame.select(F.col(year).alias("y"), F.col(feature).alias("x"))
    train = earlier.join(F.broadcast(folds), F.col("y") < F.col("fold"))
    return train.groupBy("fold").agg(F.count("*").alias("n_train"), F.percentile("x", F.lit(0.5)).alias("median"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("deviation"))


def _products(p: int) -> list[tuple[int, int]]:
    """Pairs whose sums a fit needs: of 1, the p values (nulls as 0), the p marks of nulls, and the target."""
    return [(i, j) for i in range(2 * p + 2) for j in range(i, 2 * p + 2)]


class _Frame:
    """A prepared frame, shifted and scaled as a whole for the sums' sake, with its sums of products by year.

    What a fold learns are sums over earlier years: with the medians m, a filled value is
    value + m * mark, so means, deviations and the normal equations of the filled,
    standardised features all come from the products of values and marks. One aggregate by
    year gives them; no row is copied into a fold.
    """

    def __init__(self, frame: DataFrame, features: list[str], target: str, year: str, min_train: int):
        self.features, self.year, self.min_train = features, year, min_train
        rows = prepared(frame, features, target)
        marks = rows.agg(*[f(c).alias(f"{n}_{k}") for k, c in enumerate(features) for n, f in (("mean", F.avg), ("dev", F.stddev_samp))], *[F.max(F.col(c).isNull()).alias(f"null_{k}") for k, c in enumerate(features)]).first()
        p = len(features)
        self.shift = [marks[f"mean_{k}"] or 0.0 for k in range(p)]
        self.scale = [marks[f"dev_{k}"] or 1.0 for k in range(p)]
        self.holed = [k for k in range(p) if marks[f"null_{k}"]]
        keys = [c for c in rows.columns if c not in features and c != target]
        self.keys = keys
        # kept as a table: the study passes over it several times
        path = new_folder(frame.sparkSession, "study")
        scaled = rows.select(*keys, *[((F.col(c) - F.lit(self.shift[k])) / F.lit(self.scale[k])).alias(f"x{k}") for k, c in enumerate(features)], F.col(target).alias("y"))
        scaled.write.parquet(path)
        self.rows = frame.sparkSession.read.schema(scaled.schema).parquet(path)
        self.values = [F.lit(1.0)] + [F.coalesce(f"x{k}", F.lit(0.0)) for k in range(p)] + [F.col(f"x{k}").isNull().cast("double") for k in range(p)]

    def sums(self) -> dict[int, np.ndarray]:
        """The symmetric matrix of sums of products by year."""
        z = [*self.values, F.col("y")]
        pairs = _products(len(self.features))
        out = {}
        for r in self.rows.groupBy(self.year).agg(*[F.sum(z[i] * z[j]).alias(f"s{i}_{j}") for i, j in pairs]).collect():
            m = np.zeros((len(z), len(z)))
            for i, j in pairs:
                m[i, j] = m[j, i] = r[f"s{i}_{j}"]
            out[r[self.year]] = m
        return out

    def medians(self, folds: list[int]) -> dict[int, dict[int, float]]:
        """The medians of earlier years by fold and feature, for the features that have nulls."""
        out: dict[int, dict[int, float]] = {f: {} for f in folds}
        if self.holed and folds:
            every = F.array(*[F.lit(int(f)) for f in folds])
            later = self.rows.select(F.explode(F.filter(every, lambda f: f > F.col(self.year))).alias("fold"), *[f"x{k}" for k in self.holed])
            for r in later.groupBy("fold").agg(*[F.percentile(f"x{k}", F.lit(0.5)).alias(f"x{k}") for k in self.holed]).collect():
                out[r["fold"]] = {k: r[f"x{k}"] for k in self.holed}
        return out


class _Fold:
    """The solved normal equations of one fold."""

    def __init__(self, total: np.ndarray, p: int, medians: dict[int, float], alpha: float):
        n = total[0, 0]
        # features without any value in the training years are left out
        self.used = [k for k in range(p) if total[0, 1 + p + k] < n]
        fill = np.array([medians.get(k) or 0.0 for k in range(p)])
        mix = np.zeros((p, len(total)))
        for k in range(p):
            mix[k, 1 + k], mix[k, 1 + p + k] = 1.0, fill[k]
        sums, squares = mix @ total[:, 0], mix @ total @ mix.T
        self.mean = sums / n
        spread = squares - np.outer(sums, sums) / n
        variance = np.diag(spread) / max(1.0, n - 1)
        self.deviation = np.sqrt(np.where(variance > 1e-20, variance, 1.0))
        self.mix, self.fill, self.n, self.base = mix, fill, int(n), total[0, -1] / n
        u = self.used
        gram = (spread / np.outer(self.deviation, self.deviation))[np.ix_(u, u)]
        self.inverse = np.linalg.inv(gram + alpha * np.eye(len(u))) if u else np.zeros((0, 0))

    def solve(self, cross: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Intercept, slopes on the filled values, and the standardised weights. cross: sums of the products with the target."""
        p = len(self.mean)
        right = (self.mix @ cross - self.n * self.mean * self.base) / self.deviation
        weights = np.zeros(p)
        weights[self.used] = self.inverse @ right[self.used]
        slopes = weights / self.deviation
        return float(self.base - slopes @ self.mean), slopes, weights


def _folds(frame: _Frame, alpha: float) -> tuple[dict[int, _Fold], dict[int, np.ndarray]]:
    sums, p = frame.sums(), len(frame.features)
    totals, running = {}, np.zeros((2 * p + 2, 2 * p + 2))
    for y in sorted(sums):
        totals[y] = running
        running = running + sums[y]
    kept = [y for y in sorted(sums) if totals[y][0, 0] >= frame.min_train and sums[y][0, 0] >= MIN_TEST]
    medians = frame.medians(kept)
    return {y: _Fold(totals[y], p, medians[y], alpha) for y in kept}, sums


def _predicted(frame: _Frame, rows: DataFrame, models: DataFrame, *on: str) -> DataFrame:
    """rows with `predicted`. models: on, c0 and for each feature a slope and the value that fills nulls."""
    out = F.col("c0")
    for k in range(len(frame.features)):
        out = out + F.col(f"a{k}") * F.coalesce(F.col(f"x{k}"), F.col(f"m{k}"))
    return rows.join(F.broadcast(models), list(on)).withColumn("predicted", out)


def _model_row(fold: _Fold, solved) -> list[float]:
    return [solved[0], *map(float, solved[1]), *map(float, fold.fill)]


def walk_forward(frame: DataFrame, features: list[str], target: str, year: str = "fiscal_year", alpha: float = ALPHA, min_train: int = MIN_TRAIN) -> DataFrame:
    """One row a test year; every earlier year trains it: fold, n_train, n_test, ic, auc, rmse, baseline_rmse, coefficients.

    Training is one aggregate by year; only its sums (a matrix a year) and the fitted models
    (a row a fold) pass through the driver. Testing is expressions and windows by fold.
    """
    spark, own = frame.sparkSession, _Frame(frame, features, target, year, min_train)
    folds, sums = _folds(own, alpha)
    p, rows = len(features), []
    totals = np.zeros(2 * p + 2)
    for y in sorted(sums):
        if y in folds:
            solved = folds[y].solve(totals)
            rows.append((int(y), folds[y].n, float(folds[y].base), {features[k]: float(solved[2][k]) for k in folds[y].used}, *_model_row(folds[y], solved)))
        totals = totals + sums[y][:, -1]
    slots = "".join(f", {n}{k} double" for n in "am" for k in range(p))
    models = spark.createDataFrame(rows, f"fold int, n_train int, base double, coefficients map<string,double>, c0 double{slots}")
    tested = _predicted(own, own.rows.withColumn("fold", F.col(year).cast("int")), models, "fold").select("fold", "n_train", "base", "predicted", "y", (F.col("y") > 0).cast("int").alias("up"))
    ranked = tested.withColumns({"rp": average_rank("predicted", "fold"), "ry": average_rank("y", "fold")})
    off = lambda x: F.sqrt(F.avg(F.pow(F.col(x) - F.col("y"), 2)))
    n, up = F.count("*"), F.sum("up")
    some = (n > 2) & (F.min("predicted") < F.max("predicted")) & (F.stddev_pop("ry") > 0)
    auc = F.try_divide(F.sum(F.when(F.col("up") == 1, F.col("rp"))) - up * (up + 1) / F.lit(2.0), up * (n - up))
    out = ranked.groupBy("fold").agg(F.first("n_train").alias("n_train"), n.cast("int").alias("n_test"), F.when(some, F.corr("rp", "ry")).alias("ic"), auc.alias("auc"), off("predicted").alias("rmse"), off("base").alias("baseline_rmse"))
    return out.join(F.broadcast(models.select("fold", "coefficients")), "fold").select("fold", "n_train", "n_test", "ic", "auc", "rmse", "baseline_rmse", "coefficients")


def walk_forward_trees(frame: DataFrame, features: list[str], target: str, year: str = "fiscal_year", min_train: int = MIN_TRAIN, **settings) -> DataFrame:
    """The folds of walk_forward with gradient-boosted trees: fold, n_train, n_test, ic, rmse, baseline_rmse.

    One model a test year (few, by the study), each fitted by the cluster, some folds at a
    time; medians are those of the training rows.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    # kept as a table: each fold passes over it several times
    spark, path = frame.sparkSession, new_folder(frame.sparkSession, "trees")
    ready = prepared(frame, features, target).select(year, *features, target)
    ready.write.parquet(path)
    rows = spark.read.schema(ready.schema).parquet(path)
    sizes = {r[0]: r[1] for r in rows.groupBy(year).count().orderBy(year).collect()}

    def fitted(fold: int, n_train: int) -> DataFrame:
        train, test = rows.where(F.col(year) < fold), rows.where(F.col(year) == fold)
        row = train.agg(*[F.percentile(f, F.lit(0.5)).alias(f) for f in features], F.avg(target).alias("base")).first()
        medians = {f: row[f] for f in features if row[f] is not None}
        assembler = VectorAssembler(inputCols=list(medians), outputCol="x")
        model = GBTRegressor(featuresCol="x", labelCol=target, seed=7, **({"maxIter": 20, "maxDepth": 3} | settings)).fit(assembler.transform(train.na.fill(medians)))
        scored = model.transform(assembler.transform(test.na.fill(medians))).select(F.lit(fold).alias("fold"), "prediction", target)
        errors = scored.groupBy("fold").agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col(target), 2))).alias("rmse"), F.sqrt(F.avg(F.pow(F.lit(row["base"]) - F.col(target), 2))).alias("baseline_rmse"))
        return errors.join(spearman(scored, "prediction", target, "fold"), "fold").select("fold", F.lit(n_train).alias("n_train"), F.lit(sizes[fold]).alias("n_test"), "ic", "rmse", "baseline_rmse")

    before = {fold: sum(n for y, n in sizes.items() if y < fold) for fold in sizes}
    wanted = [f for f in sizes if before[f] >= min_train and sizes[f] >= MIN_TEST]
    with ThreadPoolExecutor(FITS_AT_A_TIME) as pool:
        parts = list(pool.map(inheritable_thread_target(frame.sparkSession)(lambda f: fitted(f, before[f])), wanted))
    if not parts:
        return frame.sparkSession.createDataFrame([], "fold int, n_train int, n_test int, ic double, rmse double, baseline_rmse double")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def summary(folds: DataFrame) -> DataFrame:
    """n_folds, mean_ic, std_ic (population), mean_auc, rmse_gain; no row without folds."""
    gain = 1 - F.try_divide("rmse", "baseline_rmse")
    out = folds.agg(F.count("*").alias("n_folds"), F.round(F.avg("ic"), 4).alias("mean_ic"), F.round(F.stddev_pop("ic"), 4).alias("std_ic"), F.round(F.avg("auc"), 4).alias("mean_auc"), F.round(F.avg(gain), 4).alias("rmse_gain"))
    return out.where("n_folds > 0")


def shuffled_targets(rows: DataFrame, year: str, key: str, permutations: int, seed: int) -> DataFrame:
    """rows once for each permutation, with `permutation` and the target `z` and its rank `rz` of another row of the year.

    Permutation 0 is the identity. A row at place k of its year, by key, takes the target of
    the row whose MD5 of seed, permutation, year and place is the k-th of the year.
    """
    place = F.row_number().over(Window.partitionBy(year).orderBy(key))
    base = rows.withColumn("place", place).withColumn("ry", average_rank("y", year))
    every = base.withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), "permutation", F.col(year).cast("string"), "place"))
    order = F.when(F.col("permutation") > 0, draw).otherwise(F.lit(""))
    drawn = every.withColumn("given", F.row_number().over(Window.partitionBy("permutation", year).orderBy(order, "place")))
    targets = base.select(year, F.col("place").alias("given"), F.col("y").alias("z"), F.col("ry").alias("rz"))
    return drawn.drop("place", "y", "ry").join(targets, [year, "given"]).drop("given")


#: Sine table and rotations of MD5 (RFC 1321).
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_WORDS = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Numbers hashed at a time, so that a step's arrays stay in the cache.
MD5_ROWS = 1 << 14


def _md5_heads(prefix: bytes, first: int, count: int, digits: int) -> np.ndarray:
    """The first 8 bytes, as numbers, of the MD5 of prefix and each of count numbers of that many digits; one block of MD5 each."""
    size = len(prefix) + digits
    block = bytearray(64)
    block[: len(prefix)], block[size], block[56:] = prefix, 0x80, (8 * size).to_bytes(8, "little")
    words: list = [int.from_bytes(block[4 * k : 4 * k + 4], "little") for k in range(16)]
    rest = np.arange(first, first + count, dtype=np.uint32)
    for at in range(size - 1, len(prefix) - 1, -1):
        rest, digit = rest // np.uint32(10), rest % np.uint32(10)
        words[at // 4] = words[at // 4] + ((digit + np.uint32(48)) << np.uint32(8 * (at % 4)))
    a, b, c, d = (np.full(count, x, np.uint32) for x in _MD5_START)
    f, t = np.empty(count, np.uint32), np.empty(count, np.uint32)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word, turn = words[_WORDS[kind](i)], _TURNS[kind][i % 4]
        if isinstance(word, int):
            np.add(f, np.uint32((word + _SINES[i]) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, word, out=f), np.add(f, np.uint32(_SINES[i]), out=f)
        np.add(f, a, out=f)
        np.left_shift(f, np.uint32(turn), out=t), np.right_shift(f, np.uint32(32 - turn), out=f), np.bitwise_or(f, t, out=f), np.add(f, b, out=f)
        a, f, b, c, d = d, a, f, b, c
    out = np.empty((count, 2), "<u4")
    out[:, 0], out[:, 1] = a + np.uint32(_MD5_START[0]), b + np.uint32(_MD5_START[1])
    return out.view(">u8").ravel().astype(np.uint64)


def drawn_order(prefix: str, n: int) -> np.ndarray:
    """The places 1 to n, from 0, by the MD5 of prefix and place, then by place."""
    start, keys, first = prefix.encode(), np.empty(n, np.uint64), 1
    if len(start) + len(str(n)) > 55:
        raise ValueError("the prefix does not fit one block of MD5")
    while first <= n:
        digits = len(str(first))
        count = min(MD5_ROWS, n - first + 1, 10**digits - first)
        keys[first - 1 : first - 1 + count] = _md5_heads(start, first, count, digits)
        first += count
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    equal = np.flatnonzero(held[1:] == held[:-1])
    for k in equal:  # heads that agree are told apart by their whole digests
        if k == 0 or held[k - 1] != held[k]:
            end = k + 1 + int(np.argmax(np.append(held[k + 1 :] != held[k], True)))
            order[k:end] = sorted(order[k:end].tolist(), key=lambda x: (hashlib.md5(start + str(x + 1).encode()).digest(), x))
    return order


def _mean_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties sharing their mean."""
    order = np.argsort(x, kind="stable")
    held = x[order]
    starts = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
    ends = np.append(starts[1:], len(x))
    out = np.empty(len(x))
    out[order] = np.repeat((starts + 1 + ends) / 2, ends - starts)
    return out


def _permuted_year(numbers: list[int], seed: int, year: int, n: int, p: int, models: dict[int, list[float]]):
    """For each of the permutations: the sums of products with the drawn targets and, where it has a model, its IC on this year.

    Reads the year's rows (place, x0.., y) once; holds the year's columns and a few more of the same length.
    """

    def run(batches):
        x, missing, y = np.zeros((p, n)), np.zeros((p, n), bool), np.zeros(n)
        for batch in batches:
            at = batch.column(0).to_numpy() - 1
            for k in range(p):
                column = batch.column(1 + k)
                missing[k, at] = column.is_null().to_numpy(zero_copy_only=False)
                x[k, at] = pc.fill_null(column, 0.0).to_numpy()
            y[at] = batch.column(1 + p).to_numpy()
        ry, rows = _mean_ranks(y) - (n + 1) / 2, []
        for b in numbers:
            order = drawn_order(f"{seed}:{b}:{year}:", n) if b else np.arange(n)
            z = np.empty(n)
            z[order] = y
            sums, ic = [float(z.sum()), *(x @ z).tolist(), *(float(z[m].sum()) for m in missing)], None
            if b in models:
                c0, slopes, fill = models[b][0], models[b][1 : 1 + p], models[b][1 + p :]
                predicted = np.full(n, c0)
                for k in range(p):
                    predicted += slopes[k] * np.where(missing[k], fill[k], x[k])
                rp = _mean_ranks(predicted) - (n + 1) / 2
                z[order] = ry
                spread = math.sqrt(float(rp @ rp) * float(ry @ ry))
                ic = float(rp @ z) / spread if n > 2 and spread > 0 else None
            rows.append((b, ic, sums))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["permutation", "ic", "sums"])

    return run


def permutation_test(frame: DataFrame, features: list[str], target: str, year: str = "fiscal_year", key: str = "ticker", permutations: int = PERMUTATIONS, seed: int = 7, alpha: float = ALPHA, min_train: int = MIN_TRAIN) -> DataFrame:
    """observed, p, null_mean, null_std, null_p95, n: mean IC against targets shuffled within each year.

    Permutation 0 is the identity. A row at place k of its year, by key, takes the target
    of the row whose place is that of k in the order of the MD5 of seed, permutation, year
    and place. Shuffling changes the products with the target alone, so each fold's
    equations are solved once for all permutations. Years go one after the other: each
    task reads the year's rows and draws, sums and ranks its share of the permutations
    there, so that no row is copied or shuffled for a permutation; a task holds one year.
    """
    spark, own = frame.sparkSession, _Frame(frame, features, target, year, min_train)
    folds, sums = _folds(own, alpha)
    p, path = len(features), new_folder(spark, "places")
    columns = ["place", *[f"x{k}" for k in range(p)], "y"]
    placed = own.rows.withColumn("place", F.row_number().over(Window.partitionBy(year).orderBy(key))).select(F.col(year).cast("int").alias("_year"), *columns)
    placed.write.partitionBy("_year").parquet(path)
    kept = spark.read.schema(placed.schema).parquet(path)
    shares = min(permutations + 1, spark.sparkContext.defaultParallelism)
    totals, rows = {b: np.zeros(2 * p + 2) for b in range(permutations + 1)}, []
    last = max(folds, default=None)
    for y in sorted(sums):
        if last is None or y > last:
            break
        models = {b: _model_row(folds[y], folds[y].solve(total)) for b, total in totals.items()} if y in folds else {}
        own_rows, parts = kept.where(F.col("_year") == int(y)).select(*columns).coalesce(1), []
        for share in range(shares):
            numbers = list(range(share, permutations + 1, shares))
            parts.append(own_rows.mapInArrow(_permuted_year(numbers, seed, int(y), int(sums[y][0, 0]), p, {b: models[b] for b in numbers if b in models}), "permutation int, ic double, sums array<double>").rdd)
        # a union of tables in one part each would be one task
        for r in spark.sparkContext.union(parts).collect():  # a row of 2 p + 1 sums for each permutation
            totals[r["permutation"]] = totals[r["permutation"]] + np.array([*r["sums"], 0.0])
            if y in folds:
                rows.append((r["permutation"], int(y), r["ic"]))
    ics = spark.createDataFrame(rows, "permutation int, fold int, ic double").groupBy("permutation").agg(F.avg("ic").alias("ic")).where("ic IS NOT NULL")
    out = ics.agg(F.max(F.when(F.col("permutation") == 0, F.col("ic"))).alias("observed"), F.array_sort(F.collect_list(F.when(F.col("permutation") > 0, F.col("ic")))).alias("null"))
    n = F.size("null")
    beyond = F.size(F.filter("null", lambda x: F.abs(x) >= F.abs(F.col("observed"))))
    mean = F.aggregate("null", F.lit(0.0), lambda s, x: s + x) / n
    square = F.aggregate("null", F.lit(0.0), lambda s, x: s + x * x) / n
    return out.where(n > 0).select("observed", ((beyond + 1) / (n + 1)).alias("p"), mean.alias("null_mean"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("null_std"), F.get("null", F.floor(n * 0.95).cast("int")).alias("null_p95"), n.alias("n"))
