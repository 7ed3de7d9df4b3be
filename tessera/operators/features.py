"""The feature store: disclosure and fundamental features and forward returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .drift import THEMES

MIN_CHUNKS = 5
MAX_REMOVED_RATIO = 3
HORIZON_DAYS = 90

FUNDAMENTAL = ("net_margin", "operating_margin", "leverage", "roe", "asset_turnover", "cash_ratio", "rnd_intensity", "reporting_lag_days")
DISCLOSURE = ("drift_score", "n_new", "n_modified", "n_removed", "n_total_risks", "removal_rate", "new_rate", "modified_rate")
THEME_FEATURES = tuple(f"theme_{t}" for t in THEMES)
FEATURE_SETS = {"fundamentals": FUNDAMENTAL, "disclosure": DISCLOSURE + THEME_FEATURES, "combined": FUNDAMENTAL + DISCLOSURE + THEME_FEATURES}


def reject_reason(diff: Column) -> Column:
    """Why a drift summary can't be a feature row; the first that holds. diff: struct of counts and flags."""
    total = diff["new"] + diff["modified"] + diff["unchanged"]
    return (
        F.when(diff.isNull(), "no_diff")
        .when(~F.coalesce(diff["has_current"], F.lit(False)), "no_current")
        .when(~F.coalesce(diff["has_baseline"], F.lit(False)), "no_baseline")
        .when(diff["drift_score"].isNull(), "drift_undefined")
        .when(total < MIN_CHUNKS, "too_few_chunks")
        .when(diff["removed"] > MAX_REMOVED_RATIO * total, "mostly_removed")
    )


def keep_last(rows: DataFrame, *key: str, order: str) -> DataFrame:
    """The last row of each key by `order`."""
    last = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place")


def disclosure_features(rows: DataFrame) -> DataFrame:
    """Features of usable rows, the last of each company-year. rows: ticker, fiscal_year, accession, diff, themes map<string,int>, load_seq."""
    kept = keep_last(rows.where(reject_reason(F.col("diff")).isNull()), "ticker", "fiscal_year", order="load_seq")
    d = {c: F.col(f"diff.{c}") for c in ("new", "modified", "unchanged", "removed", "drift_score")}
    total = d["new"] + d["modified"] + d["unchanged"]
    changed = F.greatest(d["new"] + d["modified"], F.lit(1))
    rates = [(d[c] / F.greatest(total, F.lit(1))).alias(n) for c, n in (("removed", "removal_rate"), ("new", "new_rate"), ("modified", "modified_rate"))]
    counts = {t: F.coalesce(F.try_element_at("themes", F.lit(t)), F.lit(0)) for t in THEMES}
    return kept.select(
        "ticker", "fiscal_year", "accession", d["drift_score"].alias("drift_score"), d["new"].alias("n_new"), d["modified"].alias("n_modified"), d["removed"].alias("n_removed"), total.alias("n_total_risks"), *rates,
        *[(n / changed).alias(f"theme_{t}") for t, n in counts.items()], *[n.alias(f"n_theme_{t}") for t, n in counts.items()],
    )


def rejections(rows: DataFrame) -> DataFrame:
    """reason, n; rows that a later one of their company-year replaces count as `duplicate`."""
    reasons = rows.select("ticker", "fiscal_year", reject_reason(F.col("diff")).alias("reason"))
    kept = reasons.where("reason IS NULL").groupBy("ticker", "fiscal_year").agg((F.count("*") - 1).alias("n"))
    doubles = kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).where("n > 0").select(F.lit("duplicate").alias("reason"), "n")
    return reasons.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")).unionByName(doubles)


def with_filing_dates(rows: DataFrame, filings: DataFrame) -> DataFrame:
    """rows with filing_date, period_of_report and reporting_lag_days, the days from the period's end to the filing."""
    dates = filings.select("accession", F.to_date("filing_date").alias("filing_date"), F.to_date("period_of_report").alias("period_of_report"))
    return rows.join(dates, "accession", "left").withColumn("reporting_lag_days", F.datediff("filing_date", "period_of_report"))


def with_fundamentals(rows: DataFrame, facts: DataFrame, metrics: list[str]) -> DataFrame:
    """rows with a column for every metric of their filing and the ratios; rows without facts stay, with nulls."""
    return ratios(rows.join(wide_metrics(facts, "accession", metrics), "accession", "left"))


def profile(store: DataFrame, target: str = "excess_return") -> DataFrame:
    """One row on the store: rows, companies, years, median lag (days), and of the target its n, mean, median, deviation and positive share."""
    x = F.col(target).cast("double")
    x = F.when(~F.isnan(x), x)
    half = F.lit(0.5)
    return store.agg(
        F.count("*").alias("n_rows"), F.countDistinct("ticker").alias("n_companies"), F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"),
        F.percentile("reporting_lag_days", half).alias("median_lag"), F.count(x).alias("n_target"), F.avg(x).alias("mean"), F.percentile(x, half).alias("median"),
        F.stddev_samp(x).alias("deviation"), F.avg((x > 0).cast("double")).alias("positive_share"),
    )


def rows_per_year(store: DataFrame) -> DataFrame:
    """fiscal_year, n, with_target."""
    return store.groupBy("fiscal_year").agg(F.count("*").alias("n"), F.count("excess_return").alias("with_target"))


def wide_metrics(facts: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """One row a key with a column for every metric, null where it has none."""
    return facts.groupBy(key).pivot("metric", metrics).agg(F.max("value"))


def ratios(wide: DataFrame) -> DataFrame:
    """Adds seven ratios; a zero or missing denominator gives null."""
    pairs = {
        "net_margin": ("net_income", "revenue"), "operating_margin": ("operating_income", "revenue"), "leverage": ("total_liabilities", "total_assets"),
        "roe": ("net_income", "stockholders_equity"), "asset_turnover": ("revenue", "total_assets"), "cash_ratio": ("cash_and_equivalents", "total_assets"), "rnd_intensity": ("rnd_expense", "revenue"),
    }
    have = set(wide.columns)

    def col(name):
        return F.col(name) if name in have else F.lit(None).cast("double")

    return wide.withColumns({n: F.try_divide(col(a), F.nullif(col(b), F.lit(0.0))) for n, (a, b) in pairs.items()})


def forward_returns(events: DataFrame, prices: DataFrame, key: str, days: int = HORIZON_DAYS) -> DataFrame:
    """events with `forward`: last over first close in [day, day + days]; events: key, day; prices: key, date, close.

    Null without two closes in the window or at a first close of 0. An equi-join with a
    range behind it; closes are reduced to the first and the last by aggregates.
    """
    e = events.select(F.col(key), F.col("day")).distinct()
    near = e.join(prices.select(key, "date", "close"), key).where((F.col("date") >= F.col("day")) & (F.col("date") <= F.date_add("day", days)))
    own = near.groupBy(key, "day").agg(F.count("*").alias("n"), F.min_by("close", "date").alias("p0"), F.max_by("close", "date").alias("p1"))
    value = F.when((F.col("n") >= 2) & (F.col("p0") != 0), F.col("p1") / F.nullif(F.col("p0"), F.lit(0.0)) - 1)
    return events.join(own.select(key, "day", value.alias("forward")), [key, "day"], "left")


def excess_returns(events: DataFrame, prices: DataFrame, key: str, market, days: int = HORIZON_DAYS) -> DataFrame:
    """forward, market and excess (null if either is) of each event against the market's series on the same window."""
    own = forward_returns(events, prices, key, days)
    days_of = events.select(F.lit(market).alias(key), "day").distinct()
    base = forward_returns(days_of, prices.where(F.col(key) == market), key, days).select("day", F.col("forward").alias("market"))
    return own.join(base, "day", "left").withColumn("excess", F.col("forward") - F.col("market"))
