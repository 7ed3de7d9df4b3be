"""Landed filing data: fact payloads, submission indexes, documents, prices; and how tables are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

FACT = "struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string>"
FACTS = f"cik bigint, entityName string, facts map<string,map<string,struct<units:map<string,array<{FACT}>>>>>"
SUBMISSIONS = (
    "cik string, tickers array<string>, filings struct<recent:struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,"
    "reportDate:array<string>,primaryDocument:array<string>>>"
)
ARCHIVE = "https://www.sec.gov/Archives/edgar/data"

#: Persistent tables: key and schema.
TABLES = {
    "companies": (("cik",), "cik bigint, ticker string, name string, sic string, sector string"),
    "filings": (("accession",), "accession string, cik bigint, ticker string, form string, filing_date date, period_of_report date, fiscal_year int, primary_document string, primary_doc_url string, local_path string, downloaded_at timestamp"),
    "ground_truth": (("accession", "metric"), "cik bigint, ticker string, accession string, metric string, xbrl_tag string, unit string, value double, period_start date, period_end date, fiscal_year int, fiscal_period string, is_instant boolean"),
    "sections": (("section_id",), "section_id string, accession string, item string, title string, char_start int, char_end int, n_tokens int, detect_method string, text string"),
    "chunks": (("chunk_id",), "chunk_id string, accession string, ticker string, fiscal_year int, item string, chunk_index int, char_start int, char_end int, n_tokens int, has_table boolean, text string, raw_text string"),
    "extractions": (("extraction_id",), "extraction_id string, accession string, metric string, value double, value_as_stated double, scale string, found boolean, confidence double, chunk_id string, quote string, band string, error_type string, tokens_in int, tokens_out int, latency_ms int"),
}


def padded_cik(cik: Column) -> Column:
    return F.lpad(cik.cast("string"), 10, "0")


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Company fact payloads, one JSON document a file."""
    return spark.read.schema(FACTS).option("multiLine", True).json(path)


def read_ticker_map(spark: SparkSession, path: str) -> DataFrame:
    """ticker (upper case), cik from the map of numbered entries."""
    raw = spark.read.text(path, wholetext=True)
    entries = F.map_values(F.from_json("value", "map<string,struct<cik_str:bigint,ticker:string,title:string>>"))
    return raw.select(F.inline(entries)).select(F.upper("ticker").alias("ticker"), F.col("cik_str").alias("cik"), F.col("title").alias("name"))


def universe(spark: SparkSession, path: str) -> DataFrame:
    """Upper-case tickers of a list file, one `- ticker` a line (YAML list or plain)."""
    line = F.regexp_extract("value", r"^\s*(?:-\s*)?(?:ticker:\s*)?[\"']?([A-Za-z][A-Za-z0-9.\-]*)[\"']?\s*(?:#.*)?$", 1)
    return spark.read.text(path).select(F.upper(line).alias("ticker")).where("ticker <> ''").distinct()


def filings_of(submissions: DataFrame, forms: list[str], start_year: int, end_year: int) -> DataFrame:
    """Filings from the parallel arrays of a submission index; an unreadable year counts as 0 and so is out."""
    recent = F.arrays_zip(*[F.col(f"filings.recent.{c}") for c in ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument")])
    rows = submissions.select(F.col("cik").cast("bigint").alias("cik"), F.upper(F.get("tickers", F.lit(0))).alias("ticker"), F.inline(recent))
    year = F.coalesce(F.try_to_date("reportDate", "yyyy-MM-dd").cast("string").substr(1, 4).cast("int"), F.lit(0))
    kept = rows.where(F.col("form").isin(forms) & year.between(start_year, end_year) & (F.coalesce("primaryDocument", F.lit("")) != ""))
    url = F.concat_ws("/", F.lit(ARCHIVE), F.col("cik").cast("string"), F.replace(F.col("accessionNumber"), F.lit("-"), F.lit("")), F.col("primaryDocument"))
    return kept.select(F.col("accessionNumber").alias("accession"), "cik", "ticker", "form", F.try_to_date("filingDate", "yyyy-MM-dd").alias("filing_date"), F.try_to_date("reportDate", "yyyy-MM-dd").alias("period_of_report"), year.alias("fiscal_year"), F.col("primaryDocument").alias("primary_document"), url.alias("primary_doc_url")).orderBy("period_of_report", "accession")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, is_html, content as text of landed files, read by Spark from any store."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.col("path").rlike(r"(?i)\.html?$").alias("is_html"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("n_bytes"))


def not_landed(filings: DataFrame, landed: DataFrame, key: str = "accession") -> DataFrame:
    """Filings without a landed file of any size."""
    return filings.join(landed.where("n_bytes > 0").select(key), key, "left_anti")


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns in its order; missing ones are added as nulls (additive migration)."""
    from pyspark.sql.types import _parse_datatype_string

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in _parse_datatype_string(schema)])


def upserted(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of `new` replace those of their key; of several new rows of a key the last by load_seq stays."""
    last = Window.partitionBy(*key).orderBy(F.desc("load_seq"))
    fresh = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "load_seq")
    return old.join(fresh.select(*key), list(key), "left_anti").unionByName(fresh)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Write only the partitions that df has; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work without a row in the checkpoint table."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def checkpointable(results: DataFrame, key: str) -> DataFrame:
    """Results of groups in which no call failed; a failed group leaves nothing behind and is tried again."""
    failed = results.groupBy(key).agg(F.bool_or("errored").alias("failed")).where("failed")
    return results.join(failed.select(key), key, "left_anti")


def write_features(df: DataFrame, path: str) -> None:
    """The feature store as Parquet and as CSV with a header."""
    df.write.mode("overwrite").parquet(f"{path}/features.parquet")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/features.csv")


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """ticker, date, close of landed daily series."""
    return spark.read.parquet(path).select("ticker", F.to_date("date").alias("date"), F.col("close").cast("double").alias("close"))


def write_lexical_index(counts: DataFrame, path: str) -> None:
    """The BM25 tables of term counts (retrieval.term_counts): the counts themselves, then terms and scale from what was written."""
    from ..operators.retrieval import lexical_index

    counts.write.mode("overwrite").parquet(f"{path}/postings")
    index = lexical_index(counts.sparkSession.read.schema(counts.schema).parquet(f"{path}/postings"))
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    index.scale.write.mode("overwrite").parquet(f"{path}/scale")


def read_lexical_index(spark: SparkSession, path: str):
    from ..operators.retrieval import LexicalIndex

    return LexicalIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "scale")))


def write_vector_index(vectors: DataFrame, path: str) -> None:
    """The vectors of one encoder: id, vector; replaces what is there."""
    vectors.select("id", "vector").write.mode("overwrite").parquet(f"{path}/vectors")


def read_vector_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vectors")


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """The index with the vectors of `new` (id, vector, load_seq) in the place of those of their ids; write it to another folder."""
    return upserted(old, new, "id")


def write_artifact(df: DataFrame, path: str) -> None:
    """A report or evaluation set as JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An artifact in its stated schema; fields that it lacks are null."""
    return spark.read.schema(schema).json(path)
