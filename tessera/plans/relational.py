"""Statements of the store on the supplied tables: scans, joins, aggregates, pivots and upserts.

Orders stand for filings and customers for companies: fiscal_year is the year of the order.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.html_dom import html_text
from ..functions.text import context_prefix, html_by_regex, stable_id, token_count, value_variants
from ..sources import filings as src
from ..sources.shared import dealt, new_folder, spread
from ..streaming.events import drained_whole, event_stream, tumbling_counts
from .registry import query, table
from .text_sql import HTML_SQL


@query("""SELECT (SELECT count(*) FROM customer) AS companies, (SELECT count(*) FROM orders) AS filings,
    (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS downloaded, (SELECT count(*) FROM lineitem) AS facts,
    (SELECT count(DISTINCT event_type) FROM events) AS metrics""")
def summary_counts(spark, d):
    orders = table(spark, d, "orders").agg(F.count("*").alias("filings"), F.count_if(F.col("o_orderstatus") == "F").alias("downloaded"))
    parts = [table(spark, d, "customer").agg(F.count("*").alias("companies")), orders, table(spark, d, "lineitem").agg(F.count("*").alias("facts")), table(spark, d, "events").agg(F.countDistinct("event_type").alias("metrics"))]
    out = parts[0]
    for part in parts[1:]:  # one-row tables
        out = out.join(F.broadcast(part))
    return out


@query("""SELECT o_custkey, count(*) AS n, min(year(o_orderdate))::INTEGER AS first_year, max(year(o_orderdate))::INTEGER AS last_year,
    sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS downloaded FROM orders GROUP BY o_custkey""")
def filings_per_company(spark, d):
    y = F.year("o_orderdate")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min(y).alias("first_year"), F.max(y).alias("last_year"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("downloaded"))


@query("""SELECT l_returnflag AS metric, count(*) AS n, count(DISTINCT l_suppkey) AS companies, count(DISTINCT l_orderkey) AS filings
    FROM lineitem GROUP BY l_returnflag""")
def coverage_by_metric(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("metric")).agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("companies"), F.countDistinct("l_orderkey").alias("filings"))


@query("""SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey HAVING count(o_orderkey) < 6""")
def coverage_having(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n")).where("n < 6")


@query("""SELECT o_orderkey, round(o_totalprice / 1e3, 2) AS thousands FROM orders WHERE o_orderpriority = '1-URGENT'""")
def revenue_sanity(spark, d):
    return table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.round(F.col("o_totalprice") / 1e3, 2).alias("thousands"))


@query("""SELECT DISTINCT l_orderkey, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::INTEGER AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE date_diff('day', o_orderdate::DATE, l_shipdate::DATE) < 300 OR date_diff('day', o_orderdate::DATE, l_shipdate::DATE) > 430""")
def period_outliers(spark, d):
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    n = lines.count()
    joined = dealt(lines.select("l_orderkey", "l_shipdate"), n, "l_orderkey").join(dealt(orders, n, "l_orderkey"), "l_orderkey")
    days = F.datediff("l_shipdate", "o_orderdate")
    return joined.select("l_orderkey", days.alias("days")).where((F.col("days") < 300) | (F.col("days") > 430)).distinct()


@query("""SELECT o_orderkey, string_agg(l_linestatus || l_linenumber::VARCHAR, ',' ORDER BY l_linenumber, l_linestatus) AS found, count(l_orderkey) AS n
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def ordered_agg(spark, d):
    item = F.struct("l_linenumber", "l_linestatus")
    own = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("x"), F.count("*").alias("n"))
    names = F.array_join(F.transform("x", lambda i: F.concat(i["l_linestatus"], i["l_linenumber"].cast("string"))), ",")
    return table(spark, d, "orders").select("o_orderkey").join(own, "o_orderkey", "left").select("o_orderkey", names.alias("found"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("""SELECT lang, count(*) AS n, min(n_chars) AS least, round(median(n_chars), 1) AS mid, max(n_chars) AS most, round(avg(n_chars), 6) AS mean,
    sum(n_chars)::BIGINT AS total FROM documents GROUP BY lang""")
def section_size_stats(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.min(n).alias("least"), F.round(F.percentile(n, F.lit(0.5)), 1).alias("mid"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"), F.sum(n).alias("total"))


@query("""SELECT d.doc_id, d.lang, substr(d.text, 1, 40) AS head FROM documents d JOIN labels l USING (doc_id) WHERE d.lang IN ('en', 'de') AND d.n_chars < 500""")
def short_sections(spark, d):
    docs = table(spark, d, "documents").where(F.col("lang").isin("en", "de") & (F.col("n_chars") < 500))
    return docs.join(table(spark, d, "labels").select("doc_id"), "doc_id").select("doc_id", "lang", F.substring("text", 1, 40).alias("head"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars > 6000")
def long_sections(spark, d):
    return table(spark, d, "documents").where("n_chars > 6000").select("doc_id", "n_chars")


@query("SELECT o_custkey, " + ", ".join(f"max(CASE WHEN year(o_orderdate) = {y} THEN 'yes' ELSE '-' END) AS y{y}" for y in range(1995, 2002)) + " FROM orders GROUP BY o_custkey")
def conditional_year_pivot(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(*[F.max(F.when(F.year("o_orderdate") == y, "yes").otherwise("-")).alias(f"y{y}") for y in range(1995, 2002)])


@query("""SELECT count(*) AS n, sum(CASE WHEN opened <> closed THEN 1 ELSE 0 END)::BIGINT AS n_bad, sum(opened)::BIGINT AS marks FROM
    (SELECT length(text) - length(replace(text, '(', '')) AS opened, length(text) - length(replace(text, ')', '')) AS closed FROM documents)""")
def marker_balance(spark, d):
    def marks(c):
        return F.length("text") - F.length(F.replace(F.col("text"), F.lit(c), F.lit("")))

    own = table(spark, d, "documents").select(marks("(").alias("opened"), marks(")").alias("closed"))
    return own.agg(F.count("*").alias("n"), F.count_if(F.col("opened") != F.col("closed")).alias("n_bad"), F.sum("opened").alias("marks"))


@query("""SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND lang = 'en'
    OR contains(text, 'Apache') OR contains(text, 'CC BY')""")
def substring_search(spark, d):
    low = F.lower("text").contains("license") & (F.col("lang") == "en")
    variants = F.exists(F.array(F.lit("Apache"), F.lit("CC BY")), lambda v: F.contains(F.col("text"), v))
    return table(spark, d, "documents").where(low | variants).select("doc_id")


@query("""SELECT o_orderkey, c_name, c_mktsegment, year(o_orderdate)::INTEGER AS fiscal_year FROM orders JOIN customer ON c_custkey = o_custkey
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND year(o_orderdate) IN (1996, 1997)""")
def join_in_filters(spark, d):
    o = table(spark, d, "orders").where(F.year("o_orderdate").isin(1996, 1997))
    c = table(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "c_mktsegment", F.year("o_orderdate").alias("fiscal_year"))


@query("SELECT DISTINCT o_custkey, year(o_orderdate)::INTEGER AS fiscal_year FROM orders WHERE o_orderstatus IS NOT NULL")
def distinct_filings(spark, d):
    return table(spark, d, "orders").where("o_orderstatus IS NOT NULL").select("o_custkey", F.year("o_orderdate").alias("fiscal_year")).distinct()


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate FROM lineitem),
old AS (SELECT * EXCLUDE (l_shipdate) REPLACE (-l_quantity AS l_quantity) FROM l WHERE l_orderkey % 3 <> 0), new AS (SELECT * FROM l WHERE l_orderkey % 3 <> 1)
SELECT * FROM old ANTI JOIN new USING (l_orderkey, l_linenumber)
UNION ALL SELECT * EXCLUDE (l_shipdate) FROM new QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1""")
def upsert_last_wins(spark, d):
    """Two thirds of the lines, with other quantities, are there; two thirds are new, half of them in the others' place."""
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    lines = table(spark, d, "lineitem")
    old = lines.where("l_orderkey % 3 <> 0").withColumn("l_quantity", -F.col("l_quantity")).select(*columns)
    new = lines.where("l_orderkey % 3 <> 1").select(*columns, F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("load_seq"))
    return src.upserted(old, new, "l_orderkey", "l_linenumber")


@query("""PIVOT (SELECT c_nationkey, year(o_orderdate)::INTEGER AS y FROM orders JOIN customer ON c_custkey = o_custkey)
    ON y IN (1995, 1996, 1997, 1998, 1999, 2000, 2001) USING count(*) GROUP BY c_nationkey""")
def corpus_pivot(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    years = list(range(1995, 2002))
    rows = o.select("o_custkey", F.year("o_orderdate").alias("y")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_nationkey").pivot("y", years).agg(F.count("o_custkey")).na.fill(0, [str(y) for y in years])


@query("""SELECT a.o_custkey, a.fiscal_year, a.total, b.total AS prior FROM
    (SELECT o_custkey, year(o_orderdate)::INTEGER AS fiscal_year, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL) a LEFT JOIN
    (SELECT o_custkey, year(o_orderdate)::INTEGER AS fiscal_year, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL) b
    ON a.o_custkey = b.o_custkey AND b.fiscal_year = a.fiscal_year - 1""")
def yoy_pair(spark, d):
    own = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("fiscal_year")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    prior = own.select("o_custkey", (F.col("fiscal_year") + 1).alias("fiscal_year"), F.col("total").alias("prior"))
    return own.join(prior, ["o_custkey", "fiscal_year"], "left")


@query("""SELECT c.conv_id, c.turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = 'system')""")
def resume_antijoin(spark, d):
    c = table(spark, d, "conversations")
    return src.pending(c, c.where("role = 'system'"), "conv_id").select("conv_id", "turn")


@query("""SELECT user_id, session, count(*) AS n, min(ts) AS started FROM (SELECT user_id, ts, sum(CASE WHEN gap > 6 * 3600 OR gap IS NULL THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM
    (SELECT user_id, ts, event_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)) GROUP BY ALL""")
def gap_sessions(spark, d):
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    gap = F.timestamp_diff("MICROSECOND", F.lag("ts").over(own), F.col("ts")) / 1e6
    opened = e.withColumn("opened", F.when(gap.isNull() | (gap > 6 * 3600), 1).otherwise(0))
    return opened.withColumn("session", F.sum("opened").over(own)).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("started"))


@query("""SELECT event_id, user_id, ts AS started, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ended FROM events""")
def section_end_lead(spark, d):
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", "user_id", F.col("ts").alias("started"), F.lead("ts").over(own).alias("ended"))


@query("""SELECT doc_id, floor(len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) * 1.33)::INTEGER AS n_tokens,
    concat_ws(' | ', upper(lang), 'FY' || (2000 + doc_id % 20)::VARCHAR, 'Item ' || source) AS prefix, substr(sha1(lang || ':' || source || ':' || doc_id::VARCHAR), 1, 16) AS chunk_id FROM documents""")
def token_count_prefix_ids(spark, d):
    year = (F.col("doc_id") % 20 + 2000).cast("string")
    return table(spark, d, "documents").select("doc_id", token_count(F.col("text")).alias("n_tokens"), context_prefix(F.upper("lang"), year, F.col("source"), F.lit("")).alias("prefix"), stable_id(F.col("lang"), F.col("source"), F.col("doc_id")).alias("chunk_id"))


@query(r"""WITH bare AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g') AS t FROM pages),
broken AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<(?:br|/p|/div|/tr|/h[1-6]|/li)\b[^>]*>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g') AS t FROM bare),
plain AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM broken),
spaced AS (SELECT page_id, regexp_replace(regexp_replace(translate(t, ' ' || chr(8199) || chr(8239) || chr(8201) || chr(8202) || chr(8203) || chr(65279), '       '), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g') AS t FROM plain)
SELECT page_id, length(trim(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13) || chr(12) || chr(11)))::INTEGER AS n_chars,
    md5(trim(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13) || chr(12) || chr(11))) AS digest FROM spaced""")
def html_regex_text(spark, d):
    text = table(spark, d, "pages").select("page_id", html_by_regex(F.col("html")).alias("t"))
    return text.select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@query(HTML_SQL)
def html_dom_text(spark, d):
    return spread(table(spark, d, "pages").select("page_id", "html")).select("page_id", html_text(F.col("html")).alias("x")).select("page_id", "x.n_tables", "x.n_words", "x.parser_used", F.md5("x.text").alias("digest"))


@query("""SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter(
    (CASE WHEN v >= 1 THEN [format('{:,.0f}', v)] ELSE [] END) || (CASE WHEN v >= 1 AND v < 10000 THEN [format('{:,.1f}', v)] ELSE [] END)
    || (CASE WHEN v / 1e3 >= 1 THEN [format('{:,.0f}', v / 1e3)] ELSE [] END) || (CASE WHEN v / 1e3 >= 1 AND v / 1e3 < 10000 THEN [format('{:,.1f}', v / 1e3)] ELSE [] END)
    || (CASE WHEN v / 1e6 >= 1 THEN [format('{:,.0f}', v / 1e6)] ELSE [] END) || (CASE WHEN v / 1e6 >= 1 AND v / 1e6 < 10000 THEN [format('{:,.1f}', v / 1e6)] ELSE [] END)
    || (CASE WHEN v >= 1e9 THEN [format('{:,.1f}', v / 1e9), format('{:,.2f}', v / 1e9)] ELSE [] END), lambda x: length(replace(x, ',', '')) >= 3))), ' / ') AS variants
    FROM (SELECT o_orderkey, abs(o_totalprice) * 12345 AS v FROM orders)""")
def value_variants_qrels(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.array_join(value_variants(F.col("o_totalprice") * 12345), " / ").alias("variants"))


@query("""SELECT o_orderpriority, year(o_orderdate)::INTEGER AS y, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, year(o_orderdate))""")
def ext_rollup(spark, d):
    return table(spark, d, "orders").select("o_orderpriority", F.year("o_orderdate").alias("y"), "o_totalprice").rollup("o_orderpriority", "y").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0""")
def ext_setops(spark, d):
    both = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))
    return both.exceptAll(table(spark, d, "nation").where("n_regionkey = 0").select("n_nationkey"))


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def ext_streaming_windows(spark, d):
    """The event stream in windows of a day, drained: all rows of all files, late ones and the last windows too."""
    root = new_folder(spark, "stream")
    # streams read folders: the pattern names the table's file or files
    stream = event_stream(spark, f"{d}/events.parque*", table(spark, d, "events").schema)
    out = drained_whole(tumbling_counts(stream.withColumn("ts", F.col("ts").cast("timestamp"))), f"{root}/out", f"{root}/state")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
