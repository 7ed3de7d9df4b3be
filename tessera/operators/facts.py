"""As-filed facts: from nested fact payloads to one fact a metric and filing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ANNUAL_DAYS = (300, 430)
PERIOD_TOLERANCE_DAYS = 10

#: Tags of each metric in the order they are tried. Fixed values.
METRIC_TAGS = {
    "revenue": (
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "RevenueFromContractWithCustomerIncludingAssessedTax",
        "Revenues",
        "SalesRevenueNet",
    ),
    "net_income": ("NetIncomeLoss", "ProfitLoss"),
    "operating_income": ("OperatingIncomeLoss",),
    "eps_diluted": ("EarningsPerShareDiluted",),
    "eps_basic": ("EarningsPerShareBasic",),
    "total_assets": ("Assets",),
    "total_liabilities": ("Liabilities",),
    "stockholders_equity": ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"),
    "cash_and_equivalents": ("CashAndCashEquivalentsAtCarryingValue",),
    "operating_cash_flow": ("NetCashProvidedByUsedInOperatingActivities",),
    "rnd_expense": ("ResearchAndDevelopmentExpense",),
}


def day(text: Column) -> Column:
    """A date, or null where the text is none."""
    return F.try_to_date(text, "yyyy-MM-dd")


def is_annual(start: Column, end: Column) -> Column:
    return F.coalesce(F.datediff(end, start).between(*ANNUAL_DAYS), F.lit(False))


def is_close(a: Column, b: Column, days: int = PERIOD_TOLERANCE_DAYS) -> Column:
    return F.coalesce(F.abs(F.datediff(a, b)) <= days, F.lit(False))


def tag_chains(spark, chains: dict[str, tuple[str, ...]] = METRIC_TAGS) -> DataFrame:
    return spark.createDataFrame([(m, t, k) for m, tags in chains.items() for k, t in enumerate(tags)], "metric string, tag string, tag_rank int")


def flat_facts(payloads: DataFrame) -> DataFrame:
    """One row a reported value, with its place in the payload. payloads: cik, ticker, facts (see sources.FACTS).

    A tag of `dei` hides the tag of that name in any other namespace.
    """
    tags = payloads.select("cik", "ticker", F.explode("facts").alias("space", "tags")).select("cik", "ticker", "space", F.explode("tags").alias("tag", "body"))
    first = F.min(F.struct((F.col("space") != "dei").alias("other"), "space")).over(Window.partitionBy("cik", "tag"))
    tags = tags.withColumn("kept", first["space"]).where("space = kept")
    units = tags.select("cik", "ticker", "tag", F.posexplode(F.map_entries("body.units")).alias("unit_at", "u"))
    rows = units.select("cik", "ticker", "tag", "unit_at", F.col("u.key").alias("unit"), F.posexplode("u.value").alias("fact_at", "f"))
    return rows.select("cik", "ticker", "tag", "unit_at", "unit", "fact_at", day(F.col("f.start")).alias("start"), F.col("f.start").isNull().alias("instant"), day(F.col("f.end")).alias("end"), F.col("f.val").alias("value"), F.col("f.accn").alias("accession"), F.col("f.fy").alias("fy"), F.col("f.fp").alias("fp"), F.col("f.form").alias("form"))


def select_facts(facts: DataFrame, filings: DataFrame, chains: DataFrame, form: str = "10-K", days: int = PERIOD_TOLERANCE_DAYS) -> DataFrame:
    """At most one fact a filing and metric; none rather than a guess.

    Of the facts of this filing whose end is near its period, a unit with durations
    offers only its annual ones (those of `form` first), one without durations its first
    instant. The first tag, then unit, that offers something wins.
    """
    near = facts.join(filings.select("accession", "period_of_report"), "accession").where(is_close(F.col("end"), F.col("period_of_report"), days))
    chained = near.join(F.broadcast(chains), "tag")
    unit = Window.partitionBy("accession", "metric", "tag", "unit_at")
    offered = chained.withColumn("durations", F.max(~F.col("instant")).over(unit)).where(F.when(F.col("durations"), is_annual(F.col("start"), F.col("end"))).otherwise(F.col("instant")))
    order = Window.partitionBy("accession", "metric").orderBy("tag_rank", "unit_at", F.when(F.col("durations") & (F.coalesce("form", F.lit("")) != form), 1).otherwise(0), "fact_at")
    best = offered.withColumn("place", F.row_number().over(order)).where("place = 1")
    return best.select("cik", "ticker", "accession", "metric", F.col("tag").alias("xbrl_tag"), "unit", "value", F.col("start").alias("period_start"), F.col("end").alias("period_end"), F.coalesce("fy", F.year("period_of_report")).cast("int").alias("fiscal_year"), F.col("fp").alias("fiscal_period"), F.col("instant").alias("is_instant"))


def coverage(facts: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """key, expected, found, pct, missing (sorted)."""
    every = F.array(*[F.lit(m) for m in metrics])
    own = facts.groupBy(key).agg(F.collect_set("metric").alias("have"))
    found = F.size(F.array_intersect(every, F.col("have")))
    return own.select(key, F.lit(len(metrics)).alias("expected"), found.alias("found"), F.round(found * 100.0 / len(metrics), 1).alias("pct"), F.array_sort(F.array_except(every, F.col("have"))).alias("missing"))
