"""Diffs of texts, prompts, grouped extraction, labels, strata and the feature store on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims as cl
from ..operators import drift as dr
from ..operators import features as fe
from ..operators import retrieval as re_
from ..operators import surfaces as su
from ..operators import verify as ve
from .analysis import BM25_SQL, HELD_SQL, METRICS_SQL, QRELS_SQL, VERDICT_SQL, _diffs, _gated, _index, _qrels, _questions, _verdicts
from .registry import query, table
from .text_sql import CLAIMS_SQL

_PLACES = "list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9.,%$-]*'), lambda t: (31 * ascii(t) + 7 * ascii(t[-1]) + length(t)) % 64)"


@query(f"""WITH cut AS (SELECT doc_id AS id, source, substr(text, 1, 1200) AS text FROM documents),
v AS (SELECT id, source, text, list_transform(range(64), lambda k: len(list_filter(places, lambda p: p = k)))::DOUBLE[] AS v FROM (SELECT *, {_PLACES} AS places FROM cut)),
pairs AS (SELECT c.source, c.id AS c, p.id AS p, round(coalesce(CASE WHEN list_sum(c.v) > 0 AND list_sum(p.v) > 0 THEN list_cosine_similarity(c.v, p.v) END, 0), 12) AS sim FROM v c JOIN v p ON c.source = p.source AND c.id % 2 = 1 AND p.id % 2 = 0),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY c ORDER BY sim DESC, p) = 1),
cur AS (SELECT v.source, v.id AS c, p, coalesce(sim, 0) AS sim, text, CASE WHEN coalesce(sim, 0) >= 0.95 THEN 'unchanged' WHEN sim >= 0.80 THEN 'modified' ELSE 'new' END AS status FROM v LEFT JOIN best ON c = v.id WHERE v.id % 2 = 1),
gone AS (SELECT v.source, v.id AS p, coalesce((SELECT max(sim) FROM pairs WHERE pairs.p = v.id), 0) AS sim FROM v WHERE v.id % 2 = 0 AND v.id NOT IN (SELECT p FROM cur WHERE status <> 'new'))
SELECT source, status, c AS current_id, CASE WHEN status <> 'new' THEN p END AS prior_id, round(sim, 3) AS similarity, CASE WHEN status <> 'unchanged' THEN md5(text) END AS digest FROM cur
UNION ALL SELECT source, 'removed', NULL, p, round(sim, 3), NULL FROM gone""")
def diff_texts(spark, d):
    """Odd documents against the even ones of their source, from texts to statuses."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    out = dr.diff_texts(docs.where("id % 2 = 1"), docs.where("id % 2 = 0"), su.shape_encoder(), "source")
    return out.select("source", "status", "current_id", "prior_id", "similarity", F.md5("text").alias("digest"))


_SHOWN = "CASE WHEN abs({0}) >= 1e9 THEN format('{{:,.1f}}', {0} / 1e9) || ' billion (exactly ' || format('{{:,.0f}}', {0}) || ')' WHEN abs({0}) >= 1e6 THEN format('{{:,.1f}}', {0} / 1e6) || ' million (exactly ' || format('{{:,.0f}}', {0}) || ')' ELSE format('{{:,.2f}}', {0}) END"


@query(f"""WITH t AS (SELECT o_custkey, year(o_orderdate)::INTEGER AS y, count(*) AS n, sum(round(o_totalprice * 100))::BIGINT AS cents, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY ALL),
risks AS (SELECT o_custkey, year(o_orderdate)::INTEGER AS y, list(o_orderpriority || ' order ' || o_orderkey::VARCHAR ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
SELECT t.o_custkey, t.y, 'Company: C' || t.o_custkey::VARCHAR || chr(10) || 'Fiscal year: ' || t.y::VARCHAR || chr(10) || 'Compared with: ' || (t.y - 1)::VARCHAR || CASE WHEN t.y > 1995 THEN '' ELSE chr(10) || 'The year before is not at hand: say so, and call nothing a change.' END
    || chr(10) || chr(10) || 'Verified figures:' || chr(10) || '  cents: ' || {_SHOWN.format("cents::DOUBLE")} || chr(10) || '  grand: ' || {_SHOWN.format("(cents * 1000)::DOUBLE")}
    || chr(10) || chr(10) || 'Risk factors: ' || n::VARCHAR || ' new, ' || f::VARCHAR || ' modified, 0 unchanged; drift ' || CASE WHEN n > 1 THEN (n / 8)::DOUBLE::VARCHAR ELSE 'undefined' END || chr(10) || 'Themes: ' || CASE WHEN n > 2 THEN 'macro, talent' ELSE 'none' END
    || chr(10) || chr(10) || 'New risk factors:' || chr(10) || coalesce('- ' || array_to_string(r[:4], chr(10) || chr(10) || '- '), '  (none)') AS prompt FROM t LEFT JOIN risks USING (o_custkey, y)""")
def memo_prompts(spark, d):
    """A request for a note for each customer and year."""
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    risk = F.struct("o_orderkey", F.concat(F.col("o_orderpriority"), F.lit(" order "), F.col("o_orderkey").cast("string")).alias("t"))
    own = o.groupBy("o_custkey", "y").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == "O", risk)))["t"].alias("risks"))
    diff = F.struct(F.col("n").alias("new"), F.col("f").alias("modified"), F.lit(0).alias("unchanged"), F.when(F.col("n") > 1, F.col("n") / 8).alias("drift_score"))
    figures = F.create_map(F.lit("grand"), (F.col("cents") * 1000).cast("double"), F.lit("cents"), F.col("cents").cast("double"), F.lit("missing"), F.lit(None).cast("double"))
    themes = F.when(F.col("n") > 2, F.array(F.lit("macro"), F.lit("talent"))).otherwise(F.array().cast("array<string>"))
    return own.select("o_custkey", "y", su.memo_prompt(F.concat(F.lit("C"), F.col("o_custkey").cast("string")), F.col("y"), figures, diff, themes, F.col("risks"), F.col("y") > 1995).alias("prompt"))


GROUPS = {"income": ["revenue", "net_income"], "sheet": ["total_assets", "cash"]}


def _answer(prompt: str) -> str:
    """A stand-in model: reads its request, answers most groups, garbles some and leaves some metrics out."""
    key, names = prompt.split(":")
    k, asked = int(key), names.split(",")
    if len(asked) > 1 and k % 5 == 0:
        return "I cannot tell."
    told = [m for m in asked if not (m == "cash" and k % 3 == 0)]
    return "```json\n{" + ", ".join(f'"{m}": {{"found": true, "value_as_stated": {k + len(m)}, "scale": "thousands", "confidence": 0.8, "citation": 1}}' for m in told) + "}\n```"


@query("""WITH m AS (SELECT c_custkey AS k, unnest(['revenue', 'net_income', 'total_assets', 'cash', 'eps_basic']) AS metric FROM customer),
w AS (SELECT *, CASE WHEN metric = 'eps_basic' OR k % 5 = 0 THEN 'single' ELSE 'group' END AS way, metric <> 'cash' OR k % 3 <> 0 AS found FROM m)
SELECT k::VARCHAR AS accession, metric, way, found, CASE WHEN found THEN (k + length(metric)) * 1e3 END::DOUBLE AS value, NOT found AS abstained FROM w""")
def grouped_extraction(spark, d):
    """One call a group; groups that could not be read, and metrics of no group, alone."""
    filings = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("accession"))
    ask = lambda accession, names: F.concat(accession, F.lit(":" + ",".join(names)))
    out = su.grouped_extraction(filings, GROUPS, ["revenue", "net_income", "total_assets", "cash", "eps_basic"], _answer, ask)
    return out.select("accession", "metric", "way", "found", ve.normalised(F.col("value_as_stated"), F.col("scale"), F.col("found")).alias("value"), "abstained")


_FACTS_SQL = """sums AS (SELECT o_custkey AS c, year(o_orderdate)::INTEGER AS y, o_orderpriority AS metric, max(round(o_totalprice)) * 1e6 AS value FROM orders GROUP BY ALL),
said AS (SELECT o_custkey AS c, year(o_orderdate)::INTEGER AS y, o_orderkey AS id, 'Order of ' || format('{:,.0f}', round(o_totalprice)) || ' (millions)' AS text FROM orders WHERE o_orderstatus <> 'P')"""


def _facts_and_chunks(spark, d):
    o = table(spark, d, "orders").select("*", F.concat_ws("-", F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string")).alias("accession"), F.year("o_orderdate").alias("y"))
    facts = o.groupBy("accession", F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"), F.col("y").alias("fiscal_year"), F.col("o_orderpriority").alias("metric")).agg((F.max(F.round("o_totalprice")) * 1e6).alias("value"))
    chunks = o.where("o_orderstatus <> 'P'").select("accession", F.col("o_orderkey").alias("id"), F.concat(F.lit("Order of "), F.format_number(F.round("o_totalprice"), 0), F.lit(" (millions)")).alias("text"))
    return facts, chunks


@query("WITH " + _FACTS_SQL + """, forms AS (SELECT *, list_filter([format('{:,.0f}', value), format('{:,.0f}', value / 1e3), format('{:,.0f}', value / 1e6), CASE WHEN value / 1e6 < 10000 THEN format('{:,.1f}', value / 1e6) END,
    CASE WHEN value >= 1e9 THEN format('{:,.1f}', value / 1e9) END, CASE WHEN value >= 1e9 THEN format('{:,.2f}', value / 1e9) END], lambda x: x IS NOT NULL AND length(replace(x, ',', '')) >= 3) AS forms FROM sums),
hits AS (SELECT f.*, id FROM forms f JOIN said s ON f.c = s.c AND f.y = s.y WHERE len(list_filter(forms, lambda v: contains(s.text, v))) > 0)
SELECT 'num_C' || c::VARCHAR || '_' || y::VARCHAR || '_' || metric AS query_id, c::VARCHAR || '-' || y::VARCHAR AS accession, metric, value, id FROM hits QUALIFY dense_rank() OVER (PARTITION BY c, y ORDER BY metric) <= 4""")
def numeric_qrels(spark, d):
    """Priorities' largest orders as figures, orders as chunks: labels where a chunk prints the figure."""
    return re_.numeric_labels(*_facts_and_chunks(spark, d))


@query("WITH " + _FACTS_SQL + """, own AS (SELECT c, y, count(*) AS size FROM said GROUP BY ALL)
SELECT count(*) AS n, min(size) AS least, max(size) AS most, count(*) FILTER (size > 3) AS n_oversized, list_sort(list(size))[count(*) // 2 + 1] AS median, round(least(1.0, 5.0 / list_sort(list(size))[count(*) // 2 + 1]), 6)::DOUBLE AS recall_ceiling FROM own""")
def label_set_stats(spark, d):
    chunks = _facts_and_chunks(spark, d)[1]
    out = re_.label_sizes(chunks.select(F.col("accession").alias("query_id"), "id"), oversized=3)
    return out.withColumn("recall_ceiling", F.round("recall_ceiling", 6))


@query("WITH " + _FACTS_SQL + """ SELECT c::VARCHAR || '-' || y::VARCHAR AS query_id, count(*) AS n, round(5.0 / count(*), 6)::DOUBLE AS ceiling FROM said GROUP BY c, y HAVING count(*) > 3""")
def oversized_labels(spark, d):
    chunks = _facts_and_chunks(spark, d)[1]
    return re_.oversized_labels(chunks.select(F.col("accession").alias("query_id"), "id"), 3).withColumn("ceiling", F.round("ceiling", 6))


@query("WITH " + BM25_SQL + QRELS_SQL + "ranked AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored) WHERE rank <= 50)," + METRICS_SQL + """,
kinds AS (SELECT *, CASE WHEN query_id % 2 = 0 THEN 'numeric' ELSE 'qualitative' END AS kind FROM scores)
SELECT CASE WHEN grouping(kind) = 1 THEN 'ALL' ELSE kind END AS kind, k::INTEGER AS k, count(*) AS n_queries, round(avg(rr), 6) AS mrr, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit, round(avg(ndcg), 6) AS ndcg FROM kinds GROUP BY GROUPING SETS ((k), (k, kind))""")
def strata_metrics(spark, d):
    """Retrieval metrics for all queries and for each kind."""
    scores = re_.query_scores(re_.top_k(re_.lexical_scores(_index(spark, d), _questions(spark, d)), 50), _qrels(spark, d))
    kind = F.when(F.col("query_id") % 2 == 0, "numeric").otherwise("qualitative")
    out = re_.evaluate_strata(scores.withColumn("kind", kind), "kind")
    return out.select("kind", "k", "n_queries", *[F.round(c, 6).alias(c) for c in ("mrr", "recall", "hit", "ndcg")])


@query("WITH " + VERDICT_SQL + """, other AS (SELECT k, y, map_from_entries(list((metric, truth))) AS m FROM own GROUP BY k, y),
kinds AS (SELECT CASE WHEN abs(abs(value / truth) / 1e3 - 1) < 0.01 OR abs(abs(value / truth) * 1e3 - 1) < 0.01 THEN 'scale:thousands' WHEN abs(-value - truth) / abs(truth) < 0.02 THEN 'sign'
    ELSE coalesce('wrong_metric:' || list_sort(list_filter(map_keys(m), lambda x: x <> metric AND abs(value - m[x]) / abs(m[x]) < 0.005))[1], 'unexplained') END AS error_type FROM verdicts v JOIN other USING (k, y) WHERE outcome = 'wrong')
SELECT error_type, count(*) AS n FROM kinds GROUP BY error_type""")
def error_histogram(spark, d):
    rows = _verdicts(spark, d)
    every = rows.groupBy("k", "y").agg(F.map_from_entries(F.collect_list(F.struct("metric", "truth"))).alias("m"))
    others = F.map_filter("m", lambda name, _: name != F.col("metric"))
    kinds = rows.join(every, ["k", "y"]).withColumn("error_type", F.when(F.col("outcome") == "wrong", ve.error_class(F.col("value"), F.col("truth"), others)))
    return ve.error_histogram(kinds)


@query("WITH " + VERDICT_SQL + """ SELECT k, count(*) AS n, count(*) FILTER (outcome IN ('exact', 'within_0.5pct', 'within_2pct')) AS correct, count(*) FILTER (outcome IN ('exact', 'within_0.5pct', 'within_2pct', 'wrong')) AS scored,
    count(*) FILTER (outcome = 'wrong') AS wrong, count(*) FILTER (outcome = 'abstained') AS abstained, count(*) FILTER (outcome = 'no_ground_truth') AS no_ground_truth,
    round(count(*) FILTER (outcome IN ('exact', 'within_0.5pct', 'within_2pct')) / nullif(count(*) FILTER (outcome IN ('exact', 'within_0.5pct', 'within_2pct', 'wrong')), 0), 6) AS accuracy FROM verdicts GROUP BY k""")
def outcome_by_company(spark, d):
    return ve.cross_tab(_verdicts(spark, d), "k").withColumn("accuracy", F.round("accuracy", 6))


_SCORED_SQL = "s AS (SELECT ((vec_id * 37) % 100) / 100.0 AS sim, CASE WHEN (vec_id * 37) % 100 + label >= 88 THEN 'unchanged' WHEN (vec_id * 37) % 100 + label >= 75 THEN 'modified' ELSE 'new' END AS label FROM embeddings)"


def _scored(spark, d):
    whole = (F.col("vec_id") * 37) % 100
    return table(spark, d, "embeddings").select((whole / 100.0).alias("similarity"), F.when(whole + F.col("label") >= 88, "unchanged").when(whole + F.col("label") >= 75, "modified").otherwise("new").alias("label"))


@query("WITH " + _SCORED_SQL + " SELECT label, count(*) AS n, round(min(sim), 6)::DOUBLE AS least, round(avg(sim), 6)::DOUBLE AS mean, round(max(sim), 6)::DOUBLE AS most FROM s GROUP BY label")
def class_ranges(spark, d):
    return dr.class_ranges(_scored(spark, d)).select("label", "n", *[F.round(c, 6).alias(c) for c in ("least", "mean", "most")])


@query("WITH " + _SCORED_SQL + """, r AS (SELECT min(sim) FILTER (label = 'unchanged') AS u, max(sim) FILTER (label = 'modified') AS mh, min(sim) FILTER (label = 'modified') AS ml, max(sim) FILTER (label = 'new') AS n FROM s)
SELECT round(u - mh, 6)::DOUBLE AS unchanged_gap, round(ml - n, 6)::DOUBLE AS modified_gap, round((u + mh) / 2, 6)::DOUBLE AS unchanged, round((ml + n) / 2, 6)::DOUBLE AS modified FROM r""")
def class_separation(spark, d):
    """Gaps between the classes and the thresholds in their middles."""
    out = dr.separation(_scored(spark, d))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("""PIVOT (SELECT year(o_orderdate)::INTEGER AS fiscal_year, c_mktsegment, (o_orderkey % 100) / 100.0::DOUBLE AS drift FROM orders JOIN customer ON c_custkey = o_custkey)
    ON c_mktsegment IN ('BUILDING', 'MACHINERY') USING round(avg(drift), 6) GROUP BY fiscal_year""")
def drift_pivot(spark, d):
    """Mean drift by year and company."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.year("o_orderdate").alias("fiscal_year"), "c_mktsegment", ((F.col("o_orderkey") % 100) / 100.0).alias("drift"))
    return rows.groupBy("fiscal_year").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.round(F.avg("drift"), 6))


_STORE_SQL = """r AS (SELECT source AS ticker, (2000 + doc_id % 10)::INTEGER AS fiscal_year, doc_id, n_chars % 40 AS n FROM documents WHERE doc_id % 7 > 3 AND n_chars % 40 >= 5 AND doc_id % 50 <= 3 * (n_chars % 40)),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY ticker, fiscal_year ORDER BY doc_id DESC) = 1),
store AS (SELECT ticker, fiscal_year, doc_id, CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 90)::INTEGER END AS lag, CASE WHEN doc_id % 13 <> 0 THEN n * 1.0 / ((doc_id % 4) * 2.0) END AS margin_, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 21 - 10) / 100.0 END::DOUBLE AS target FROM k)"""


def _store(spark, d):
    """The feature store: disclosure features with dates, fundamentals and a made-up target."""
    rows = fe.disclosure_features(_diffs(spark, d))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("accession"), "doc_id", (F.col("n_chars") % 40).alias("n"))
    day = F.lit("2020-12-31").cast("date")
    filings = docs.where("doc_id % 11 <> 0").select("accession", F.date_add(day, (F.col("doc_id") % 90).cast("int")).alias("filing_date"), day.alias("period_of_report"))
    facts = docs.where("doc_id % 13 <> 0").select("accession", F.inline(F.array(F.struct(F.lit("net_income").alias("metric"), F.col("n").cast("double").alias("value")), F.struct(F.lit("revenue").alias("metric"), ((F.col("doc_id") % 4) * 2).cast("double").alias("value")))))
    out = fe.with_fundamentals(fe.with_filing_dates(rows, filings), facts, ["net_income", "revenue"])
    k = F.col("accession").cast("long")
    return out.withColumn("excess_return", F.when(k % 5 != 0, (k % 21 - 10) / 100.0))


@query("WITH " + _STORE_SQL + " SELECT doc_id::VARCHAR AS accession, lag AS reporting_lag_days, round(CASE WHEN doc_id % 4 = 0 THEN NULL ELSE margin_ END, 6)::DOUBLE AS net_margin, target AS excess_return FROM store")
def feature_store(spark, d):
    """Wide rows by left joins: a filing without a date or facts keeps its row."""
    return _store(spark, d).select("accession", "reporting_lag_days", F.round("net_margin", 6).alias("net_margin"), "excess_return")


@query("WITH " + _STORE_SQL + """ SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_companies, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year, median(lag)::DOUBLE AS median_lag, count(target) AS n_target,
    round(avg(target), 6) AS mean, round(median(target), 6) AS median, round(stddev_samp(target), 6) AS deviation, round(avg((target > 0)::INT), 6) AS positive_share FROM store""")
def store_profile(spark, d):
    out = fe.profile(_store(spark, d))
    return out.select(*[F.round(c, 6).alias(c) if c in ("mean", "median", "deviation", "positive_share") else F.col(c) for c in out.columns])


@query("WITH " + _STORE_SQL + " SELECT fiscal_year, count(*) AS n, count(target) AS with_target FROM store GROUP BY fiscal_year")
def store_rows_per_year(spark, d):
    return fe.rows_per_year(_store(spark, d))


@query("WITH " + BM25_SQL + """top AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored) WHERE rank <= 6),
c AS (SELECT query_id, list(id ORDER BY rank) AS ids, (query_id % 8)::BIGINT AS cited FROM top GROUP BY query_id)
SELECT query_id, CASE WHEN cited BETWEEN 1 AND len(ids) THEN ids[cited] ELSE ids[1] END AS chunk_id, CASE WHEN cited BETWEEN 1 AND len(ids) THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM c""")
def cited_chunks(spark, d):
    """Citations by number turned into ids; an unknown one falls back to the first excerpt at half the confidence."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("item"))
    hits = re_.top_k(re_.lexical_scores(_index(spark, d), _questions(spark, d)), 6).join(docs, "id")
    found, confidence = re_.cited(F.col("ids"), F.col("query_id") % 8, F.lit(0.9))
    return re_.contexts(hits).select("query_id", found.alias("chunk_id"), confidence.alias("confidence"))


@query("WITH " + CLAIMS_SQL + HELD_SQL + r"""judged AS (SELECT c.*, NOT is_percentage AND NOT EXISTS (SELECT 1 FROM held h, (SELECT unnest([1.0, 1e3, 1e6, 1e9]) AS f) WHERE h.doc_id = c.doc_id AND h.value <> 0 AND abs(c.value * f - h.value) / abs(h.value) <= 0.01) AS bad FROM claims c),
marks AS (SELECT doc_id, k, start + length(raw) - spot AS e, coalesce(lag(start + length(raw) - spot) OVER (PARTITION BY doc_id, k ORDER BY start), 0) AS p, body FROM judged JOIN sentences USING (doc_id, k) WHERE bad),
lines AS (SELECT doc_id, k, string_agg(body[p + 1:e] || ' [UNVERIFIED]', '' ORDER BY e) || any_value(body)[max(e) + 1:] AS marked FROM marks GROUP BY doc_id, k)
SELECT doc_id, md5(string_agg(coalesce(marked, body), '' ORDER BY k)) AS digest FROM sentences LEFT JOIN lines USING (doc_id, k) GROUP BY doc_id""")
def annotated_claims(spark, d):
    return _gated(spark, d).select("doc_id", F.md5("annotated").alias("digest"))


@query("WITH " + CLAIMS_SQL.rstrip().rstrip(",") + " SELECT doc_id, start, md5(trim(text[opens + 1:closes], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS sentence FROM claims JOIN documents USING (doc_id)")
def claim_sentences(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", cl.claims(F.col("text")).alias("claims"))
    rows = docs.select("doc_id", F.inline(F.transform("claims", lambda c: F.struct(c["start"].alias("start"), F.md5(cl.sentence_of(F.col("text"), c)).alias("sentence")))))
    return rows
