"""Retrieval, verification, drift, claims, features and models on the supplied tables.

Benchmark items stand for questions and documents for chunks; a document is relevant
to an item whose text it holds. Customers' yearly totals stand for extracted figures,
labels of embeddings for sections, users' event values for price series.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.stats import hash_number, order_statistics
from ..functions.text import tokens
from ..operators import claims as cl
from ..operators import chunks as ch
from ..operators import drift as dr
from ..operators import facts as fa
from ..operators import features as fe
from ..operators import models as mo
from ..operators import retrieval as re_
from ..operators import sections as se
from ..operators import surfaces as su
from ..operators import verify as ve
from ..sources import filings as src
from ..sources.shared import dealt, new_folder, spread, stored
from .registry import query, table
from .study_sql import FRAME_SQL, PERMUTATION_SQL, RIDGE_SQL
from .text_sql import CHUNKS_SQL, CLAIMS_SQL, GATE_SQL, SECTIONS_SQL

BM25_SQL = """
docs AS (SELECT doc_id AS id, lang, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9.,%$-]*') AS own FROM documents),
post AS (SELECT id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT id, len(own) AS length, unnest(own) AS term FROM docs) GROUP BY id, term),
scale AS (SELECT count(*) AS n, avg(len(own)) AS mean_length FROM docs),
raw AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM post, scale GROUP BY term, n),
terms AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT query_id, term, count(*) AS asked FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9.,%$-]*')) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, id, sum(asked * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))) AS score
    FROM asked JOIN terms USING (term) JOIN post USING (term), scale GROUP BY query_id, id HAVING score > 0),
"""
QRELS_SQL = "qrels AS (SELECT item_id AS query_id, doc_id AS id, lang FROM benchmark b JOIN documents d ON contains(d.text, b.text)),"
METRICS_SQL = """
hits AS (SELECT q.query_id, q.id, h.rank FROM qrels q LEFT JOIN ranked h USING (query_id, id)),
per AS (SELECT query_id, k, count(*) AS n, coalesce(1.0 / min(rank), 0) AS rr, count(*) FILTER (rank <= k) AS got, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= k), 0) AS gain
    FROM hits, (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY query_id, k),
scores AS (SELECT *, got / n AS recall, (got > 0)::INT::DOUBLE AS hit, gain / list_sum(list_transform(range(1, least(n, k) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM per)
"""


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _index(spark, d):
    """The stored index of the documents: written once a session, read by every query that searches it."""

    def write(folder):
        docs = spread(table(spark, d, "documents").select("doc_id", "text"))
        src.write_lexical_index(re_.term_counts(docs, "doc_id", "text"), folder)

    return src.read_lexical_index(spark, stored(spark, "lexical", f"{d}/documents.parquet", write))


def _vectors(spark, d):
    """The stored vectors of the documents by the stand-in encoder: id, vector."""

    def write(folder):
        docs = spread(table(spark, d, "documents").select("doc_id", "text"))
        src.write_vector_index(docs.select(F.col("doc_id").alias("id"), su.encoded(F.col("text"), su.shape_encoder()).alias("vector")), folder)

    return src.read_vector_index(spark, stored(spark, "vectors", f"{d}/documents.parquet", write))


#: Rows up to which labels' anchors are broadcast to the documents; more are joined by shuffle.
BROADCAST_ITEMS = 50_000


def _qrels(spark, d):
    """Item and document pairs by containment.

    An item's anchor is its longest token that neither begins nor ends it: such a token
    stands whole in any text that holds the item, so the index's terms lead to the documents
    by a join on it. An item of up to two tokens has no such token (its own may run on in a
    document) and is sought in every text, a slice of items against all rows.
    """
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("wanted"), tokens(F.col("text")).alias("own"))
    inner = F.when(F.size("own") > 2, F.slice("own", F.lit(2), F.greatest(F.size("own") - 2, F.lit(1))))
    longest = F.get(F.array_sort(F.transform(inner, lambda t: F.struct((-F.length(t)).alias("size"), t.alias("t")))), F.lit(0))["t"]
    keyed = items.select("query_id", "wanted", longest.alias("anchor"))
    anchored, bare = keyed.where("anchor IS NOT NULL"), keyed.where("anchor IS NULL").drop("anchor")
    small = keyed.limit(BROADCAST_ITEMS + 1).count() <= BROADCAST_ITEMS
    index = _index(spark, d)
    terms = index.postings.select("id", F.explode("counts.term").alias("anchor"))
    near = terms.join(F.broadcast(anchored) if small else anchored, "anchor").select("query_id", "wanted", "id")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    found = docs.join(near, "id").where(F.contains(F.col("text"), F.col("wanted"))).select("query_id", "id", "lang")
    if not bare.isEmpty():
        found = found.unionByName(docs.join(F.broadcast(bare) if small else bare, F.contains(F.col("text"), F.col("wanted"))).select("query_id", "id", "lang"))
    return found


@query("WITH " + BM25_SQL + "done AS (SELECT 1) SELECT term, round(idf, 6) AS idf FROM terms")
def bm25_index(spark, d):
    """The index's terms with their weights."""
    return _index(spark, d).terms.select("term", F.round("idf", 6).alias("idf"))


@query("WITH " + BM25_SQL + """ranked AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored)
SELECT query_id AS item_id, rank::INTEGER AS rank, id AS doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 10""")
def bm25_topk(spark, d):
    scored = re_.lexical_scores(_index(spark, d), _questions(spark, d))
    return re_.top_k(scored, 10).select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("WITH " + BM25_SQL + QRELS_SQL + "ranked AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored) WHERE rank <= 50)," + METRICS_SQL + """
SELECT k::INTEGER AS k, count(*) AS n_queries, round(avg(rr), 6) AS mrr, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit, round(avg(ndcg), 6) AS ndcg FROM scores GROUP BY k""")
def bm25_ir_metrics(spark, d):
    scored = re_.lexical_scores(_index(spark, d), _questions(spark, d))
    out = re_.evaluate(re_.query_scores(re_.top_k(scored, 50), _qrels(spark, d)))
    return out.select("k", "n_queries", *[F.round(c, 6).alias(c) for c in ("mrr", "recall", "hit", "ndcg")])


@query("WITH " + BM25_SQL + QRELS_SQL + """allowed AS (SELECT DISTINCT query_id, d.doc_id AS id FROM qrels q JOIN documents d USING (lang)),
ranked AS (SELECT * FROM (SELECT false AS routed, query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored
    UNION ALL SELECT true, query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) FROM scored SEMI JOIN allowed USING (query_id, id)) WHERE rank <= 50),
per AS (SELECT r.routed, q.query_id, coalesce(1.0 / min(rank), 0) AS rr, coalesce((min(rank) <= 5)::INT, 0) AS hit FROM qrels q CROSS JOIN (SELECT unnest([false, true]) AS routed) r
    LEFT JOIN ranked h ON h.query_id = q.query_id AND h.id = q.id AND h.routed = r.routed GROUP BY ALL)
SELECT routed, round(avg(rr), 6) AS mrr, round(avg(hit), 6) AS hit5 FROM per GROUP BY routed""")
def bm25_routed_vs_unrouted(spark, d):
    qrels = _qrels(spark, d)
    langs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    scored = re_.lexical_scores(_index(spark, d), _questions(spark, d), langs)
    # the 50 best of a query and language hold the 50 best of any choice of languages
    own = Window.partitionBy("query_id", "lang").orderBy(F.desc("score"), "id")
    best = scored.withColumn("place", F.row_number().over(own)).where("place <= 50").drop("place")
    path = new_folder(spark, "routed")
    best.write.parquet(path)
    scored = spark.read.schema(best.schema).parquet(path)
    # a routed query keeps documents in the language of its relevant ones
    routed = scored.join(qrels.select("query_id", "lang").distinct(), ["query_id", "lang"], "left_semi")
    parts = [re_.evaluate(re_.query_scores(re_.top_k(x, 50), qrels)).where("k = 5").select(F.lit(name).alias("routed"), F.round("mrr", 6).alias("mrr"), F.round("hit", 6).alias("hit5")) for name, x in ((False, scored.select("query_id", "id", "score")), (True, routed.select("query_id", "id", "score")))]
    return parts[0].unionByName(parts[1])


DENSE_SQL = """dense AS (SELECT query_id, id, sim AS score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS sim,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank
    FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) WHERE rank <= 10)"""


@query("WITH " + DENSE_SQL + " SELECT query_id, rank::INTEGER AS rank, id AS vec_id, round(score, 6) AS sim FROM dense")
def dense_topk(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    return re_.dense_search(q, v, 10, digits=9).select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("sim"))


@query("""WITH v AS (SELECT query_id, id, score, label FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, v.label, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v USING (label)
    WHERE q.vec_id % 50 = 0) WHERE rank <= 5) SELECT query_id, id AS vec_id, label, round(score, 6) AS sim FROM v""")
def dense_topk_filtered(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    found = re_.dense_search(v.where("id % 50 = 0").withColumnRenamed("id", "query_id"), v, 5, ("label",), digits=9)
    return found.join(v.select("id", "label"), "id").select("query_id", F.col("id").alias("vec_id"), "label", F.round("score", 6).alias("sim"))


HYBRID_SQL = """shapes AS (SELECT query_id, id, list_transform(range(64), lambda k: len(list_filter(places, lambda p: p = k)))::DOUBLE[] AS v FROM (
    SELECT item_id AS query_id, NULL AS id, list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9.,%$-]*'), lambda t: (31 * ascii(t) + 7 * ascii(t[-1]) + length(t)) % 64) AS places FROM benchmark
    UNION ALL SELECT NULL, doc_id, list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9.,%$-]*'), lambda t: (31 * ascii(t) + 7 * ascii(t[-1]) + length(t)) % 64) FROM documents)),
near AS (SELECT q.query_id, d.id, round(list_cosine_similarity(q.v, d.v), 12) AS score FROM shapes q, shapes d WHERE q.query_id IS NOT NULL AND d.id IS NOT NULL AND list_sum(q.v) > 0 AND list_sum(d.v) > 0),
lists AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, 0 AS list_no FROM near
    UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id), 1 FROM scored) WHERE rank <= 50),
sums AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 12) AS score, min((list_no, rank)) AS seen FROM lists GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, id) AS rank FROM sums)"""


def _encoded_questions(spark, d):
    return _questions(spark, d).withColumn("vector", su.encoded(F.col("question"), su.shape_encoder()))


@query("WITH " + BM25_SQL + HYBRID_SQL + " SELECT query_id, rank::INTEGER AS rank, id AS doc_id, round(score, 6) AS score FROM fused WHERE rank <= 10")
def rrf_hybrid(spark, d):
    """Dense and sparse lists of 50, fused."""
    out = re_.search("hybrid", _encoded_questions(spark, d), 10, _index(spark, d), _vectors(spark, d))
    return out.select("query_id", "rank", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("WITH " + BM25_SQL + HYBRID_SQL + """, words AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split_regex(lower(text), '\\W+'), lambda w: w <> '')) AS asked FROM benchmark),
judged AS (SELECT query_id, id, round(coalesce(len(list_intersect(asked, list_filter(string_split_regex(lower(d.text), '\\W+'), lambda w: w <> '')))::DOUBLE / nullif(len(asked), 0), 0), 12) AS score
    FROM fused JOIN words USING (query_id) JOIN documents d ON d.doc_id = id WHERE rank <= 25)
SELECT query_id, rank::INTEGER AS rank, id AS doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM judged) WHERE rank <= 8""")
def hybrid_rerank(spark, d):
    """The whole chain with the stand-in encoder and scorer."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    scorer = lambda q, t: F.round(su.overlap_scorer(q, t), 12)
    out = re_.search("rerank", _encoded_questions(spark, d), 8, _index(spark, d), _vectors(spark, d), docs, scorer)
    return out.select("query_id", "rank", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("WITH " + BM25_SQL + """ranked AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored) WHERE rank <= 10),
moved AS (SELECT query_id, r.id, text, source, row_number() OVER (PARTITION BY query_id ORDER BY contains(lower(text[:1200]), 'schedule i') OR contains(lower(text[:1200]), 'by segment')
    OR contains(lower(text[:1200]), 'parent company') OR contains(lower(text[:1200]), 'regulatory capital') OR contains(lower(text[:1200]), 'condensed financial information') OR contains(lower(text[:1200]), 'reportable segment')
    OR contains(lower(text[:1200]), 'segment results') OR contains(lower(text[:1200]), 'variable interest entit') OR contains(lower(text[:1200]), 'supplementary information'), rank) AS place FROM ranked r JOIN documents d ON d.doc_id = r.id)
SELECT query_id, md5(string_agg('--- Excerpt ' || place::VARCHAR || ' (Item ' || source || ') ---' || chr(10) || text[:1800], chr(10) || chr(10) ORDER BY place)) AS digest, min_by(id, place) AS first_id FROM moved WHERE place <= 6 GROUP BY query_id""")
def scope_demotion_context(spark, d):
    scored = re_.lexical_scores(_index(spark, d), _questions(spark, d))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("item"))
    hits = re_.demote_scoped(re_.top_k(scored, 10).join(docs, "id"))
    return re_.contexts(hits).select("query_id", F.md5("context").alias("digest"), F.try_element_at("ids", F.lit("1")).alias("first_id"))


KEYWORDS = (("apache", "en", ("apache", "license")), ("gnu", "en", ("general public", "gnu")), ("rights", "fr", ("copyright", "rights")), ("cc", "de", ("cc by", "creative")))


@query("""WITH t AS (SELECT * FROM (VALUES ('apache', 'en', ['apache', 'license']), ('gnu', 'en', ['general public', 'gnu']), ('rights', 'fr', ['copyright', 'rights']), ('cc', 'de', ['cc by', 'creative'])) x(slug, lang, words))
SELECT source, slug, count(*) AS n, count(*) > 2 AS oversized FROM documents JOIN t USING (lang) WHERE len(list_filter(words, lambda w: contains(lower(text), w))) > 0 GROUP BY source, slug HAVING count(*) >= 2""")
def keyword_qrels(spark, d):
    """Labels by language and keyword; templates with under two matches ask nothing."""
    templates = spark.createDataFrame([(s, lang, list(w)) for s, lang, w in KEYWORDS], "slug string, lang string, words array<string>")
    hits = table(spark, d, "documents").join(F.broadcast(templates), "lang").where(F.exists("words", lambda w: F.contains(F.lower("text"), w)))
    return hits.groupBy("source", "slug").agg(F.count("*").alias("n")).where("n >= 2").withColumn("oversized", F.col("n") > 2)


@query("""SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY ('0x' || substr(md5('7:' || doc_id::VARCHAR), 1, 8))::BIGINT, doc_id) AS place,
    greatest(1, floor(count(*) OVER (PARTITION BY quality) * 0.1)) AS wanted FROM labels) WHERE place <= wanted""")
def stratified_sample(spark, d):
    return re_.stratified_sample(table(spark, d, "labels"), "quality", "doc_id", 0.1).select("doc_id", "quality")


BOOT_SQL = """own AS (SELECT x, row_number() OVER (ORDER BY item_id) - 1 AS position, count(*) OVER () AS n FROM (SELECT item_id, {0} AS x FROM benchmark)),
draws AS (SELECT b, i, n FROM (SELECT b, n, unnest(range(n)) AS i FROM range(2000) t(b), (SELECT DISTINCT n FROM own))),
means AS (SELECT b, avg(x) AS m, any_value(draws.n) AS n FROM draws JOIN own ON position = ('0x' || substr(md5('7:' || b::VARCHAR || ':' || i::VARCHAR), 1, 8))::BIGINT % draws.n GROUP BY b)"""


@query("WITH " + BOOT_SQL.format("length(text)::DOUBLE") + """ SELECT any_value(n)::INTEGER AS n, round((SELECT avg(x) FROM own), 6) AS mean, round(list_sort(list(m))[51], 6) AS low, round(list_sort(list(m))[1950], 6) AS high FROM means""")
def bootstrap_ci(spark, d):
    rows = table(spark, d, "benchmark").select((F.row_number().over(Window.orderBy("item_id")) - 1).alias("position"), F.length("text").cast("double").alias("x"))
    out = re_.bootstrap(rows, "x")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query("WITH " + BOOT_SQL.format("(length(text) - 6 * len(string_split(text, ' ')))::DOUBLE") + """, o AS (SELECT avg(x) AS o FROM own) SELECT any_value(n)::INTEGER AS n, round(any_value(o), 6) AS difference,
    round(list_sort(list(m))[51], 6) AS low, round(list_sort(list(m))[1950], 6) AS high, round(count(*) FILTER (abs(m - o) >= abs(o) - 1e-12) / 2000.0, 6) AS p FROM means, o""")
def paired_bootstrap(spark, d):
    b = table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id")
    out = re_.paired_bootstrap(b.select("query_id", F.length("text").cast("double").alias("x")), b.select("query_id", (F.size(F.split("text", " ")) * 6).cast("double").alias("x")), "x")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("difference", "low", "high", "p")])


VERDICT_SQL = """own AS (SELECT o_custkey AS k, year(o_orderdate)::INTEGER AS y, o_orderpriority AS metric, sum(round(o_totalprice * 100))::DOUBLE / 100 AS truth, count(*) AS n FROM orders GROUP BY ALL),
rows_ AS (SELECT a.*, p.truth AS prior, CASE (a.k + a.y) % 9 WHEN 0 THEN NULL WHEN 1 THEN a.truth * 1000 WHEN 2 THEN -a.truth WHEN 3 THEN a.truth * 1.003 WHEN 4 THEN a.truth * 1.01 WHEN 5 THEN p.truth WHEN 6 THEN a.truth * 1.5 ELSE a.truth END AS value
    FROM own a LEFT JOIN own p ON p.k = a.k AND p.metric = a.metric AND p.y = a.y - 1),
errs AS (SELECT *, CASE WHEN truth = 0 THEN CASE WHEN value = 0 THEN 0 ELSE 'inf'::DOUBLE END ELSE abs(value - truth) / nullif(abs(truth), 0) END AS err,
    CASE WHEN prior = 0 THEN CASE WHEN value = 0 THEN 0 ELSE 'inf'::DOUBLE END ELSE abs(value - prior) / nullif(abs(prior), 0) END AS before, (k % 97 = 0) AS errored FROM rows_),
verdicts AS (SELECT *, CASE WHEN errored THEN 'errored' WHEN value IS NULL THEN 'abstained' WHEN prior IS NOT NULL AND before < err AND before < 0.005 THEN 'wrong_period'
    WHEN err <= 0 OR (abs(value - truth) < 1 AND abs(truth) >= 1e6) THEN 'exact' WHEN err <= 0.005 THEN 'within_0.5pct' WHEN err <= 0.02 THEN 'within_2pct' ELSE 'wrong' END AS outcome FROM errs)
"""


def _verdicts(spark, d):
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 100
    own = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("metric")).agg(cents.alias("truth"))
    prior = own.select("k", "metric", (F.col("y") + 1).alias("y"), F.col("truth").alias("prior"))
    rows = own.join(prior, ["k", "metric", "y"], "left")
    t, case = F.col("truth"), (F.col("k") + F.col("y")) % 9
    value = F.when(case == 0, None).when(case == 1, t * 1000).when(case == 2, -t).when(case == 3, t * 1.003).when(case == 4, t * 1.01).when(case == 5, F.col("prior")).when(case == 6, t * 1.5).otherwise(t)
    rows = rows.withColumn("value", value).withColumn("errored", F.col("k") % 97 == 0)
    return rows.withColumn("error", ve.relative_error(F.col("value"), t)).withColumn("outcome", ve.verdict(F.col("value"), t, F.col("prior"), F.col("errored")))


@query("WITH " + VERDICT_SQL + """, other AS (SELECT k, y, map_from_entries(list((metric, truth))) AS m FROM own GROUP BY k, y)
SELECT v.k, v.y, metric, outcome, CASE WHEN outcome = 'wrong' THEN
    CASE WHEN abs(abs(value / truth) / 1e3 - 1) < 0.01 OR abs(abs(value / truth) * 1e3 - 1) < 0.01 THEN 'scale:thousands'
    WHEN abs(abs(value / truth) / 1e6 - 1) < 0.01 OR abs(abs(value / truth) * 1e6 - 1) < 0.01 THEN 'scale:millions'
    WHEN abs(abs(value / truth) / 1e9 - 1) < 0.01 OR abs(abs(value / truth) * 1e9 - 1) < 0.01 THEN 'scale:billions'
    WHEN abs(-value - truth) / abs(truth) < 0.02 THEN 'sign'
    ELSE coalesce('wrong_metric:' || list_sort(list_filter(map_keys(m), lambda x: x <> metric AND abs(value - m[x]) / abs(m[x]) < 0.005))[1], 'unexplained') END END AS error_type
FROM verdicts v JOIN other USING (k, y)""")
def verify_ladder(spark, d):
    rows = _verdicts(spark, d)
    every = rows.groupBy("k", "y").agg(F.map_from_entries(F.collect_list(F.struct("metric", "truth"))).alias("m"))
    others = F.map_filter("m", lambda name, _: name != F.col("metric"))
    return rows.join(every, ["k", "y"]).select("k", "y", "metric", "outcome", F.when(F.col("outcome") == "wrong", ve.error_class(F.col("value"), F.col("truth"), others)).alias("error_type"))


@query("WITH " + VERDICT_SQL + """, s AS (SELECT *, outcome IN ('exact', 'within_0.5pct', 'within_2pct', 'wrong', 'wrong_period') AS scored FROM verdicts)
SELECT metric, count(*) AS total, count(*) FILTER (scored) AS scorable, round(count(*) FILTER (outcome = 'exact') / greatest(count(*) FILTER (scored), 1), 6) AS share_exact,
    round(count(*) FILTER (outcome IN ('exact', 'within_0.5pct')) / greatest(count(*) FILTER (scored), 1), 6) AS share_within_0_5pct,
    round(count(*) FILTER (outcome IN ('exact', 'within_0.5pct', 'within_2pct')) / greatest(count(*) FILTER (scored), 1), 6) AS share_within_2pct,
    count(*) FILTER (outcome = 'errored') AS errored, count(*) FILTER (outcome = 'abstained') AS abstained, count(*) FILTER (outcome = 'no_ground_truth') AS no_ground_truth,
    count(*) FILTER (outcome = 'wrong_period') AS wrong_period, count(*) FILTER (outcome = 'wrong') AS wrong,
    round(list_sort(list(err) FILTER (scored AND err < 'inf'::DOUBLE))[len(list(err) FILTER (scored AND err < 'inf'::DOUBLE)) // 2 + 1], 6) AS median_error FROM s GROUP BY metric""")
def outcome_summary(spark, d):
    out = ve.summarise(_verdicts(spark, d), "metric")
    return out.select(*[F.round(c, 6).alias(c) if c.startswith("share") or c == "median_error" else F.col(c) for c in out.columns])


@query("""WITH v AS (SELECT c_custkey, max(c_acctbal) AS total_assets, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS total_liabilities, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS stockholders_equity,
    max(o_totalprice) AS net_income, sum(o_totalprice) AS revenue, min(o_totalprice) AS cash FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey),
r AS (SELECT c_custkey, 'balance' AS rule, 'error' AS severity, abs(total_liabilities + stockholders_equity - total_assets) / nullif(abs(total_assets), 0) > 0.02 AS broken FROM v
UNION ALL SELECT c_custkey, 'equity_over_assets', 'error', stockholders_equity > total_assets FROM v
UNION ALL SELECT c_custkey, 'income_over_revenue', 'warning', CASE WHEN revenue IS NOT NULL AND net_income IS NOT NULL THEN revenue > 0 AND net_income > 1.05 * revenue END FROM v
UNION ALL SELECT c_custkey, 'cash_over_assets', 'error', cash > total_assets FROM v)
SELECT c_custkey, rule, severity, CASE WHEN broken IS NULL THEN 'unchecked' WHEN broken THEN 'violated' ELSE 'ok' END AS state FROM r""")
def identities(spark, d):
    price = F.col("o_totalprice")
    sums = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", price)).alias("total_liabilities"), F.sum(F.when(F.col("o_orderstatus") == "O", price)).alias("stockholders_equity"), F.max(price).alias("net_income"), F.sum(price).alias("revenue"), F.min(price).alias("cash_and_equivalents"))
    wide = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("total_assets")).join(sums, "c_custkey", "left")
    return ve.identities(wide)


@query("""WITH f AS (SELECT o_orderkey AS accession, 'net' AS tag, 0 AS rank, l_linenumber AS place, l_returnflag AS form, l_extendedprice AS value, l_shipdate::DATE AS finish, o_orderdate::DATE AS period FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'N'
    UNION ALL SELECT o_orderkey, 'gross', 1, l_linenumber, l_returnflag, l_extendedprice, l_shipdate::DATE, o_orderdate::DATE FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT accession, tag AS source, value FROM f WHERE abs(date_diff('day', period, finish)) <= 60
    QUALIFY row_number() OVER (PARTITION BY accession ORDER BY rank, (form <> 'A')::INT, place, finish, value) = 1""")
def fallback_fact(spark, d):
    """One value an order: the first tag of the chain that has any near the order's date, form A first."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("accession"), F.col("l_linenumber").alias("fact_at"), F.col("l_returnflag").alias("form"), F.col("l_extendedprice").alias("value"), F.to_date("l_shipdate").alias("end"))
    tagged = lines.withColumn("tag", F.explode(F.when(F.col("form") != "N", F.array(F.lit("net"), F.lit("gross"))).otherwise(F.array(F.lit("gross")))))
    # a line is an annual duration up to its day
    facts = tagged.select("accession", "tag", F.lit(0).alias("unit_at"), F.lit("USD").alias("unit"), F.struct("fact_at", "end", "value").alias("fact_at"), F.date_sub("end", 365).alias("start"), F.lit(False).alias("instant"), "end", "value", F.year("end").alias("fy"), F.lit("FY").alias("fp"), "form", F.lit(0).alias("cik"), F.lit("T").alias("ticker"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("accession"), F.to_date("o_orderdate").alias("period_of_report"))
    return fa.select_facts(facts, orders, fa.tag_chains(spark, {"price": ("net", "gross")}), form="A", days=60).select("accession", F.col("xbrl_tag").alias("source"), "value")


@query("""SELECT o_custkey, 5 AS expected, count(DISTINCT o_orderpriority)::INTEGER AS found, round(count(DISTINCT o_orderpriority) * 100.0 / 5, 1)::DOUBLE AS pct,
    array_to_string(list_sort(list_filter(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], lambda x: NOT list_contains(list(o_orderpriority), x))), ',') AS missing FROM orders GROUP BY o_custkey""")
def coverage_report(spark, d):
    out = fa.coverage(table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("metric")), "o_custkey", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    return out.withColumn("missing", F.array_join("missing", ",")).withColumn("pct", F.col("pct").cast("double"))


DIFF_SQL = """side AS (SELECT vec_id, label, vec_id % 2 AS s, embedding::DOUBLE[] AS v FROM embeddings),
pairs AS (SELECT c.label, c.vec_id AS c, p.vec_id AS p, list_cosine_similarity(c.v, p.v) AS sim FROM side c JOIN side p ON c.label = p.label AND c.s = 1 AND p.s = 0),
best AS (SELECT label, c, p, sim FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY round(sim, 12) DESC, p::VARCHAR) AS n FROM pairs) WHERE n = 1),
cur AS (SELECT s.label, s.vec_id AS c, p, coalesce(sim, 0) AS sim, CASE WHEN sim >= 0.40 THEN 'unchanged' WHEN sim >= 0.35 THEN 'modified' ELSE 'new' END AS status FROM side s LEFT JOIN best ON c = s.vec_id WHERE s = 1),
gone AS (SELECT s.label, s.vec_id AS p, coalesce((SELECT max(sim) FROM pairs WHERE pairs.p = s.vec_id), 0) AS sim FROM side s WHERE s = 0 AND s.vec_id NOT IN (SELECT p FROM cur WHERE status <> 'new')),
diff AS (SELECT label, status, c AS current_id, CASE WHEN status <> 'new' THEN p END AS prior_id, sim FROM cur UNION ALL SELECT label, 'removed', NULL, p, sim FROM gone)
"""


def _aligned(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "label", F.col("embedding").alias("vector"), "vec_id")
    return dr.align(v.where("vec_id % 2 = 1"), v.where("vec_id % 2 = 0"), "label", unchanged=0.40, modified=0.35)


@query("WITH " + DIFF_SQL + "SELECT label, status, current_id::VARCHAR AS current_id, prior_id::VARCHAR AS prior_id, round(sim, 6) AS similarity FROM diff")
def diff_status(spark, d):
    return _aligned(spark, d).withColumn("similarity", F.round("similarity", 6))


@query("WITH " + DIFF_SQL + """, n AS (SELECT label, count(*) FILTER (s = 1) AS n_current, count(*) FILTER (s = 0) AS n_prior FROM side GROUP BY label),
k AS (SELECT label, count(*) FILTER (status = 'unchanged') AS u, count(*) FILTER (status = 'modified') AS m, count(*) FILTER (status = 'new') AS w, count(*) FILTER (status = 'removed') AS r FROM diff GROUP BY label)
SELECT label, n_current, n_prior, u AS n_unchanged, m AS n_modified, w AS n_new, r AS n_removed, CASE WHEN n_current = 0 THEN 'no_current' WHEN n_prior = 0 THEN 'no_baseline'
    WHEN least(n_current, n_prior) < 5 OR least(n_current, n_prior) / greatest(n_current, n_prior) < 0.35 THEN 'size_mismatch' END AS reason,
    CASE WHEN n_current > 0 AND n_prior > 0 AND least(n_current, n_prior) >= 5 AND least(n_current, n_prior) / greatest(n_current, n_prior) >= 0.35 THEN round((w + m) / greatest(u + m + w, 1), 4) END AS drift FROM n JOIN k USING (label)""")
def drift_summary(spark, d):
    sides = table(spark, d, "embeddings").groupBy("label").agg(F.count_if(F.col("vec_id") % 2 == 1).alias("n_current"), F.count_if(F.col("vec_id") % 2 == 0).alias("n_prior"))
    return dr.drift_summary(_aligned(spark, d), sides, "label")


TEST_THEMES = {"legal": ("license", "copyright", "rights"), "contact": ("@", "mail"), "connective": (" and ", " und ", " y ")}


@query("""WITH t AS (SELECT * FROM (VALUES ('legal', ['license', 'copyright', 'rights']), ('contact', ['@', 'mail']), ('connective', [' and ', ' und ', ' y '])) x(theme, words))
SELECT lang, theme, count(*) AS n FROM documents, t WHERE len(list_filter(words, lambda w: contains(lower(text[:1200]), w))) > 0 GROUP BY ALL""")
def theme_taxonomy(spark, d):
    return dr.theme_counts(table(spark, d, "documents"), dr.theme_table(spark, TEST_THEMES), "lang")


@query("""WITH s AS (SELECT vec_id, ((vec_id * 37) % 100) / 100.0 AS sim, CASE WHEN (vec_id * 37) % 100 + label >= 88 THEN 'unchanged' WHEN (vec_id * 37) % 100 + label >= 75 THEN 'modified' ELSE 'new' END AS label FROM embeddings),
g AS (SELECT u / 100.0 AS u, m / 100.0 AS m FROM range(80, 100, 5) a(u), range(60, 80, 5) b(m))
SELECT u::DOUBLE AS unchanged, m::DOUBLE AS modified, round(avg((CASE WHEN sim >= u THEN 'unchanged' WHEN sim >= m THEN 'modified' ELSE 'new' END = label)::INT), 6) AS accuracy FROM s, g GROUP BY ALL""")
def threshold_sweep(spark, d):
    whole = (F.col("vec_id") * 37) % 100
    scored = table(spark, d, "embeddings").select((whole / 100.0).alias("similarity"), F.when(whole + F.col("label") >= 88, "unchanged").when(whole + F.col("label") >= 75, "modified").otherwise("new").alias("label"))
    grid = spark.createDataFrame([(u / 100, m / 100) for u in range(80, 100, 5) for m in range(60, 80, 5)], "unchanged double, modified double")
    return dr.sweep(scored, grid).select("unchanged", "modified", F.round("accuracy", 6).alias("accuracy"))


@query("""WITH x AS (SELECT quality AS label, CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS predicted FROM labels), c AS (SELECT unnest([0, 1]) AS label)
SELECT c.label::INTEGER AS label, round(count(*) FILTER (x.label = c.label AND predicted = c.label) / nullif(count(*) FILTER (predicted = c.label), 0), 6) AS precision,
    round(count(*) FILTER (x.label = c.label AND predicted = c.label) / nullif(count(*) FILTER (x.label = c.label), 0), 6) AS recall, count(*) FILTER (x.label = c.label) AS support FROM x, c GROUP BY c.label""")
def confusion(spark, d):
    x = table(spark, d, "labels").select(F.col("quality").alias("label"), F.when(F.col("toxic") == 1, 0).otherwise(1).alias("predicted"))
    return dr.class_report(x).select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "support")


@query("WITH " + CLAIMS_SQL.rstrip().rstrip(",") + """ SELECT doc_id, raw, value, is_percentage, start, (start + length(raw))::INTEGER AS "end", opens, closes FROM claims""")
def extract_claims(spark, d):
    c = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(cl.claims(F.col("text"))).alias("c"))
    return c.select("doc_id", "c.raw", "c.value", "c.is_percentage", "c.start", "c.end", "c.opens", "c.closes")


#: The figures that back a document's claims: its length and a version, and the counts of a made-up diff.
HELD_SQL = """held AS (SELECT doc_id, n_chars::DOUBLE AS value FROM documents UNION ALL SELECT doc_id, 2.0 FROM documents UNION ALL SELECT doc_id, (doc_id % 50 + 4000)::DOUBLE FROM documents),
"""


def _gated(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "source", "n_chars"))
    verified = F.create_map(F.lit("n_chars"), F.col("n_chars").cast("double"), F.lit("version"), F.lit(2.0))
    diff = F.struct((F.col("doc_id") % 50 + 4000).alias("new"), *[F.lit(None).cast("long").alias(c) for c in ("modified", "unchanged", "removed")], F.lit(None).cast("double").alias("drift_score"))
    return cl.measured(cl.gate(docs.withColumns({"verified": verified, "diff": diff}), diff="diff"))


@query("WITH " + CLAIMS_SQL + HELD_SQL + GATE_SQL + """SELECT doc_id, n_claims, n_checked, n_unsupported, support_rate, words_before, words_after, sentences_removed, md5(after_) AS digest FROM measured""")
def claims_gate(spark, d):
    return _gated(spark, d).select("doc_id", "n_claims", "n_checked", "n_unsupported", "support_rate", "words_before", "words_after", "sentences_removed", F.md5("shown").alias("digest"))


def _reports(spark, d):
    """Reports made of the documents: each run of five texts of a source under numbered headings."""
    docs = table(spark, d, "documents")
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    items = F.array(*[F.lit(i) for i in ("1", "1A", "7", "7A", "8")])
    parts = docs.withColumn("at", place).select(F.concat_ws("-", "source", F.floor(F.col("at") / 5).cast("string")).alias("accession"), (F.col("at") % 5).alias("place"), "text")
    part = lambda x: F.concat(F.lit("Item "), F.get(items, x["place"]), F.lit(". Part\n"), F.repeat(F.concat(x["text"], F.lit("\n\n")), 12))
    return parts.groupBy("accession").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), part), "").alias("text"))


@query("WITH " + SECTIONS_SQL + "SELECT accession, item, char_start, char_end, n_tokens, 'item-heading' AS detect_method, md5(body) AS digest FROM sections")
def sectionise(spark, d):
    return se.section_table(_reports(spark, d)).select("accession", "item", "char_start", "char_end", "n_tokens", "detect_method", F.md5("text").alias("digest"))


@query("WITH " + SECTIONS_SQL + """SELECT r.accession, round(count(item) * 100.0 / 5, 1)::DOUBLE AS coverage, coalesce(string_agg(item, ',' ORDER BY char_start), '') AS found FROM reports r LEFT JOIN sections s USING (accession) GROUP BY r.accession""")
def section_coverage(spark, d):
    out = se.section_report(_reports(spark, d))
    return out.select("accession", F.col("coverage").cast("double").alias("coverage"), F.array_join("found", ",").alias("found"))


@query("""WITH t AS (SELECT doc_id::VARCHAR AS accession, text || chr(10) || CASE doc_id % 3 WHEN 0 THEN '> Risk  Factors.' WHEN 1 THEN 'Our risk factors changed' ELSE 'Risk Factors' END || chr(10) || 'end' AS text FROM documents),
h AS (SELECT accession, text, regexp_extract(text, '(?i)risk\\s+factors') AS m, instr(text, regexp_extract(text, '(?i)risk\\s+factors')) - 1 AS spot FROM t)
SELECT accession, '1A' AS item, spot::INTEGER AS char_start, round(spot * 100.0 / length(text), 1)::DOUBLE AS position, accession::BIGINT % 3 <> 1 AS line_start, accession::BIGINT % 3 <> 1 AS alone, m AS matched, md5(text[greatest(0, spot - 80) + 1:spot]) AS before_digest, text[spot + length(m) + 1:spot + length(m) + 80] AS after FROM h""")
def title_contexts(spark, d):
    """Texts with one title below them, in three forms."""
    form = F.when(F.col("doc_id") % 3 == 0, "> Risk  Factors.").when(F.col("doc_id") % 3 == 1, "Our risk factors changed").otherwise("Risk Factors")
    docs = spread(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("accession"), F.concat_ws("\n", "text", form, F.lit("end")).alias("text")))
    out = se.title_contexts(docs)
    return out.select("accession", "item", "char_start", F.col("position").cast("double").alias("position"), "line_start", "alone", "matched", F.md5("before").alias("before_digest"), "after")


@query(CHUNKS_SQL)
def chunk_documents(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "lang", "text")).select(F.col("doc_id").cast("string").alias("accession"), F.lit("1A").alias("item"), F.upper("lang").alias("ticker"), F.lit(2024).alias("fiscal_year"), F.lit("Risk Factors").alias("item_title"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return ch.chunk_table(docs).select("chunk_id", "accession", "chunk_index", "n_tokens", "has_table", "char_start", "char_end", F.md5("text").alias("digest"))


@query("""SELECT CASE WHEN doc_id % 7 = 0 THEN 'no_diff' WHEN doc_id % 7 = 1 THEN 'no_current' WHEN doc_id % 7 = 2 THEN 'no_baseline' WHEN doc_id % 7 = 3 THEN 'drift_undefined'
    WHEN n_chars % 40 < 5 THEN 'too_few_chunks' WHEN doc_id % 50 > 3 * (n_chars % 40) THEN 'mostly_removed' END AS reason, count(*) AS n FROM documents GROUP BY 1 HAVING reason IS NOT NULL
UNION ALL SELECT 'duplicate', sum(n)::BIGINT FROM (SELECT count(*) - 1 AS n FROM documents WHERE doc_id % 7 > 3 AND n_chars % 40 >= 5 AND doc_id % 50 <= 3 * (n_chars % 40) GROUP BY source, doc_id % 10) HAVING sum(n) > 0""")
def rejects(spark, d):
    return fe.rejections(_diffs(spark, d))


def _diffs(spark, d):
    k, n = F.col("doc_id"), (F.col("n_chars") % 40).cast("int")
    third = F.floor(n / 3).cast("int")
    diff = F.struct(third.alias("new"), third.alias("modified"), (n - 2 * third).alias("unchanged"), (k % 50).cast("int").alias("removed"), (k % 7 != 1).alias("has_current"), (k % 7 != 2).alias("has_baseline"), F.when(k % 7 != 3, F.round(2 * third / F.greatest(n, F.lit(1)), 4)).alias("drift_score"))
    themes = F.create_map(F.lit("macro"), (k % 5).cast("int"), F.lit("climate"), (k % 3).cast("int"))
    return table(spark, d, "documents").select(F.col("source").alias("ticker"), (2000 + k % 10).cast("int").alias("fiscal_year"), k.cast("string").alias("accession"), F.when(k % 7 != 0, diff).alias("diff"), themes.alias("themes"), k.alias("load_seq"))


@query("""WITH r AS (SELECT source AS ticker, (2000 + doc_id % 10)::INTEGER AS fiscal_year, doc_id, n_chars % 40 AS n, (n_chars % 40) // 3 AS t FROM documents WHERE doc_id % 7 > 3 AND n_chars % 40 >= 5 AND doc_id % 50 <= 3 * (n_chars % 40)),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY ticker, fiscal_year ORDER BY doc_id DESC) = 1)
SELECT ticker, fiscal_year, doc_id::VARCHAR AS accession, round(2 * t / n, 4) AS drift_score, t::INTEGER AS n_new, (doc_id % 50)::INTEGER AS n_removed, n::INTEGER AS n_total_risks, round(t / n, 6) AS new_rate, round((doc_id % 50) / n, 6) AS removal_rate,
    round((doc_id % 5) / greatest(2 * t, 1), 6) AS theme_macro, 0::INTEGER AS n_theme_talent FROM k""")
def disclosure_features(spark, d):
    out = fe.disclosure_features(_diffs(spark, d))
    return out.select("ticker", "fiscal_year", "accession", "drift_score", "n_new", "n_removed", "n_total_risks", *[F.round(c, 6).alias(c) for c in ("new_rate", "removal_rate", "theme_macro")], "n_theme_talent")


@query("""WITH w AS (SELECT o_custkey, sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS net_income, sum(o_totalprice) FILTER (o_orderpriority = '2-HIGH') AS revenue,
    sum(o_totalprice) FILTER (o_orderpriority = '3-MEDIUM') AS total_assets, sum(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS total_liabilities FROM orders GROUP BY o_custkey)
SELECT o_custkey, round(net_income / nullif(revenue, 0), 6) AS net_margin, round(total_liabilities / nullif(total_assets, 0), 6) AS leverage, round(revenue / nullif(total_assets, 0), 6) AS asset_turnover, NULL::DOUBLE AS rnd_intensity FROM w""")
def fundamentals_wide(spark, d):
    names = F.create_map(*[F.lit(x) for x in ("1-URGENT", "net_income", "2-HIGH", "revenue", "3-MEDIUM", "total_assets", "5-LOW", "total_liabilities")])
    facts = table(spark, d, "orders").withColumn("metric", F.coalesce(F.try_element_at(names, F.col("o_orderpriority")), F.lit("other"))).groupBy("o_custkey", "metric").agg(F.sum("o_totalprice").alias("value"))
    wide = fe.ratios(fe.wide_metrics(facts, "o_custkey", ["net_income", "revenue", "total_assets", "total_liabilities"]))
    return wide.select("o_custkey", *[F.round(c, 6).alias(c) for c in ("net_margin", "leverage", "asset_turnover", "rnd_intensity")])


RETURN_SQL = """prices AS (SELECT user_id, ts::DATE AS date, avg(value) AS close FROM events GROUP BY ALL), e AS (SELECT user_id, (min(ts)::DATE + INTERVAL (3 + user_id % 9) DAY)::DATE AS day FROM events GROUP BY user_id),
fwd AS (SELECT e.user_id, e.day, p.user_id AS series, CASE WHEN count(*) >= 2 AND min_by(close, date) <> 0 THEN max_by(close, date) / min_by(close, date) - 1 END AS f FROM e JOIN prices p ON p.user_id IN (e.user_id, (SELECT min(user_id) FROM events)) AND date >= e.day AND date <= e.day + INTERVAL 10 DAY GROUP BY ALL)"""


def _prices(spark, d):
    e = table(spark, d, "events")
    prices = e.groupBy("user_id", F.to_date("ts").alias("date")).agg(F.avg("value").alias("close"))
    days = e.groupBy("user_id").agg(F.to_date(F.min("ts")).alias("first")).select("user_id", F.date_add("first", (3 + F.col("user_id") % 9).cast("int")).alias("day"))
    return days, prices


@query("WITH " + RETURN_SQL + """ SELECT e.user_id, e.day, round(a.f, 6) AS forward, round(m.f, 6) AS market, round(a.f - m.f, 6) AS excess FROM e LEFT JOIN fwd a ON a.user_id = e.user_id AND a.series = e.user_id
    LEFT JOIN fwd m ON m.user_id = e.user_id AND m.series = (SELECT min(user_id) FROM events)""")
def excess_return(spark, d):
    days, prices = _prices(spark, d)
    market = days.agg(F.min("user_id")).first()[0]
    out = fe.excess_returns(days, prices, "user_id", market, 10)
    return out.select("user_id", "day", *[F.round(c, 6).alias(c) for c in ("forward", "market", "excess")])


@query("""SELECT y.fold::INTEGER AS fold, count(*) AS n_train, round(median(o_totalprice), 6) AS median, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS deviation
    FROM (SELECT DISTINCT year(o_orderdate) AS fold FROM orders) y JOIN orders ON year(o_orderdate) < y.fold GROUP BY y.fold""")
def fold_stats(spark, d):
    out = mo.fold_statistics(table(spark, d, "orders").withColumn("y", F.year("o_orderdate")), "y", "o_totalprice")
    return out.select("fold", "n_train", F.round("median", 6).alias("median"), F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"))


@query("""WITH r AS (SELECT year(o_orderdate)::INTEGER AS y, rank() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY year(o_orderdate), o_totalprice) - 1) / 2.0 AS a,
    rank() OVER (PARTITION BY year(o_orderdate) ORDER BY o_custkey % 100) + (count(*) OVER (PARTITION BY year(o_orderdate), o_custkey % 100) - 1) / 2.0 AS b FROM orders) SELECT y, round(corr(a, b), 6) AS ic FROM r GROUP BY y""")
def spearman(spark, d):
    rows = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), "o_totalprice", (F.col("o_custkey") % 100).alias("b"))
    return mo.spearman(rows, "o_totalprice", "b", "y").select("y", F.round("ic", 6).alias("ic"))


@query("""WITH r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS r, quality AS p FROM documents JOIN labels USING (doc_id))
SELECT lang, round((sum(r) FILTER (p = 1) - sum(p) * (sum(p) + 1) / 2.0) / nullif(sum(p) * (count(*) - sum(p)), 0), 6) AS auc FROM r GROUP BY lang""")
def auc_rank(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return mo.rank_auc(rows, "n_chars", "quality", "lang").select("lang", F.round("auc", 6).alias("auc"))


def _frame(spark, d):
    """A study of all orders: customers' years with four features and a target that leans on the first."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("ticker"), F.year("o_orderdate").alias("fiscal_year"))
    own = o.agg(F.avg("o_totalprice").alias("a"), F.count("*").cast("double").alias("b"), F.max("o_totalprice").alias("c"), F.when(F.count("*") > 2, F.stddev_samp("o_totalprice")).alias("e"))
    noise = hash_number(F.lit(3), F.col("ticker"), F.col("fiscal_year")) / 2.0**32 - 0.5
    return own.withColumn("target", F.col("a") / 1e6 + noise)


@query("WITH " + FRAME_SQL + RIDGE_SQL + " SELECT fold, n_train, n_test, round(ic, 6) AS ic, round(auc, 6) AS auc, round(rmse, 6) AS rmse, round(baseline_rmse, 6) AS baseline_rmse, round(w1, 6) AS weight_a, round(w4, 6) AS weight_e FROM ridge")
def walk_forward_ridge(spark, d):
    out = mo.walk_forward(_frame(spark, d), ["a", "b", "c", "e"], "target")
    weights = [F.round(F.col("coefficients")[c], 6).alias(f"weight_{c}") for c in ("a", "e")]
    return out.select("fold", "n_train", "n_test", *[F.round(c, 6).alias(c) for c in ("ic", "auc", "rmse", "baseline_rmse")], *weights)


@query("WITH " + FRAME_SQL + RIDGE_SQL + """ SELECT count(*) AS n_folds, round(avg(ic), 4) AS mean_ic, round(stddev_pop(ic), 4) AS std_ic, round(avg(auc), 4) AS mean_auc, round(avg(1 - rmse / baseline_rmse), 4) AS rmse_gain FROM ridge""")
def walk_forward_summary(spark, d):
    return mo.summary(mo.walk_forward(_frame(spark, d), ["a", "b", "c", "e"], "target"))


@query()
def walk_forward_trees(spark, d):
    return mo.walk_forward_trees(_frame(spark, d), ["a", "b", "c", "e"], "target")


@query("WITH " + FRAME_SQL + PERMUTATION_SQL)
def permutation(spark, d):
    out = mo.permutation_test(_frame(spark, d), ["a", "b", "c", "e"], "target")
    return out.select(*[F.round(c, 6).alias(c) for c in ("observed", "p", "null_mean", "null_std", "null_p95")], "n")


@query("""SELECT event_type, count(*) AS n, sum(tin)::BIGINT AS tokens_in, sum(tout)::BIGINT AS tokens_out, round(sum(tin * 0.15 + tout * 0.6) / 1e6, 6) AS cost, list_sort(list(value))[count(*) // 2 + 1] AS p50, list_sort(list(value))[floor(0.95 * count(*))::BIGINT + 1] AS p95
    FROM (SELECT event_type, value, user_id % 100 + 50 AS tin, event_id % 70 AS tout FROM events) GROUP BY event_type""")
def usage_percentiles(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("value").alias("latency"), (F.col("user_id") % 100 + 50).alias("tokens_in"), (F.col("event_id") % 70).alias("tokens_out"))
    priced = e.withColumn("cost", su.call_cost(F.col("tokens_in"), F.col("tokens_out"), F.lit(0.15), F.lit(0.6)))
    return su.usage(priced, "event_type").withColumn("cost", F.round("cost", 6))


@query("""WITH c AS (SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS prompt_id, turn % 2 = 0 AND text IS NOT NULL AS told, length(text) AS n, unnest(['revenue', 'net_income']) AS metric FROM conversations),
x AS (SELECT *, told AND metric = 'revenue' AS found FROM c)
SELECT prompt_id, metric, found, CASE WHEN found THEN n END::DOUBLE AS value_as_stated, CASE WHEN found THEN 'millions' ELSE 'units' END AS scale, CASE WHEN found THEN 0.9 ELSE 0 END::DOUBLE AS confidence, CASE WHEN found THEN '2' END AS citation,
    NULL::VARCHAR AS quote, false AS errored, NOT found AS abstained, CASE WHEN found THEN n * 1e6 END::DOUBLE AS value FROM x""")
def parse_replies(spark, d):
    """Replies made of the conversations: fenced JSON for even turns, prose for the others."""
    c = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("prompt_id"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit('```json\n{"revenue": {"found": true, "value_as_stated": '), F.length("text").cast("string"), F.lit(', "scale": "millions", "confidence": 0.9, "citation": 2}}\n```'))).otherwise(F.col("text")).alias("reply"))
    out = su.parsed_replies(c, ["revenue", "net_income"])
    return out.withColumn("value", ve.normalised(F.col("value_as_stated"), F.col("scale"), F.col("found")))


@query("""SELECT lang, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median, list_sort(list(n_chars))[floor(0.95 * count(*))::BIGINT + 1] AS p95 FROM documents GROUP BY lang""")
def index_percentiles(spark, d):
    return order_statistics(table(spark, d, "documents").select("lang", "n_chars"), "n_chars", {"upper_median": 0.5, "p95": 0.95}, "lang")


@query("""WITH a AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) / count(*) AS accuracy, count(*) FILTER (quality = 1 OR toxic = 0) / count(*) AS ceiling FROM labels)
SELECT round(accuracy, 6) AS accuracy, round(ceiling, 6) AS ceiling, CASE WHEN ceiling < 0.7 THEN 'retrieval' WHEN accuracy < 0.95 * ceiling THEN 'generation' WHEN accuracy >= 0.99 AND ceiling >= 0.99 THEN 'suspicious' ELSE 'balanced' END AS diagnosis FROM a""")
def bottleneck_diagnosis(spark, d):
    q, t = F.col("quality") == 1, F.col("toxic") == 0
    a = table(spark, d, "labels").agg((F.count_if(q & t) / F.count("*")).alias("accuracy"), (F.count_if(q | t) / F.count("*")).alias("ceiling"))
    return a.select(F.round("accuracy", 6).alias("accuracy"), F.round("ceiling", 6).alias("ceiling"), ve.diagnosis(F.col("accuracy"), F.col("ceiling")).alias("diagnosis"))


@query("WITH " + BM25_SQL + QRELS_SQL + """ranked AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored) WHERE rank <= 6)
SELECT count(DISTINCT q.query_id) AS n, count(DISTINCT r.query_id) AS reachable, round(count(DISTINCT r.query_id) / count(DISTINCT q.query_id), 6) AS ceiling FROM qrels q LEFT JOIN ranked r ON r.query_id = q.query_id AND r.id = q.id""")
def retrieval_ceiling(spark, d):
    """The share of labelled items whose context of six holds a relevant document."""
    scored = re_.lexical_scores(_index(spark, d), _questions(spark, d))
    found = re_.query_scores(re_.top_k(scored, 6), _qrels(spark, d))
    return found.agg(F.count("*").alias("n"), F.count_if(F.col("rr") > 0).alias("reachable"), F.round(F.avg((F.col("rr") > 0).cast("double")), 6).alias("ceiling"))


@query("""SELECT count(*) AS pending, count(*) * 3 AS calls, count(*) * 3 * 3300 AS tokens, round(count(*) * 3 * 3300 * 0.15 / 1e6, 6) AS cost
FROM (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') < 2)""")
def cost_estimate(spark, d):
    """Calls, tokens and cost of the conversations that are not done, before any work."""
    own = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("n")).where("n < 2")
    n = F.count("*")
    return own.agg(n.alias("pending"), (n * 3).alias("calls"), (n * 3 * 3300).alias("tokens"), F.round(su.call_cost(n * 3 * 3300, F.lit(0), F.lit(0.15), F.lit(0.0)), 6).alias("cost"))


@query("WITH " + CLAIMS_SQL + HELD_SQL + GATE_SQL + """SELECT sum(n_unsupported)::BIGINT AS unsupported, sum(n_checked)::BIGINT AS checked, round(sum(n_unsupported) / nullif(sum(n_checked), 0), 6) AS share,
    round(avg(words_after * 100.0 / nullif(words_before, 0)), 3) AS retained_pct FROM measured""")
def gate_totals(spark, d):
    """Unsupported and checked claims over all memos."""
    own = claims_gate(spark, d)
    return own.agg(F.sum("n_unsupported").alias("unsupported"), F.sum("n_checked").alias("checked"), F.round(F.try_divide(F.sum("n_unsupported"), F.sum("n_checked")), 6).alias("share"), F.round(F.avg(F.try_divide(F.col("words_after") * 100.0, F.col("words_before"))), 3).alias("retained_pct"))


@query("WITH " + CLAIMS_SQL + HELD_SQL + GATE_SQL + """SELECT source AS config, count(*) AS n_memos, round(sum(n_checked) / count(*), 2) AS claims_per_memo, round(sum(n_unsupported) / count(*), 3) AS unsupported_generated, 0::DOUBLE AS unsupported_shown,
    count(*) FILTER (n_unsupported > 0) AS memos_with_any, sum(sentences_removed)::BIGINT AS sentences_removed, round(100.0 * sum(words_after) / nullif(sum(words_before), 0), 1) AS words_retained_pct FROM measured JOIN documents USING (doc_id) GROUP BY source""")
def gate_averages(spark, d):
    """Averages of the gate by configuration; what is shown goes through the gate again and has nothing left to remove."""
    first = _gated(spark, d).select("doc_id", "source", "verified", "diff", "shown", "n_checked", "n_unsupported", "sentences_removed", "words_before", "words_after")
    again = cl.gate(first.select("doc_id", "verified", "diff", F.col("shown").alias("text")), diff="diff").select("doc_id", F.col("n_unsupported").alias("n_unsupported_shown"))
    return su.gate_averages(first.join(again, "doc_id").withColumnRenamed("source", "config"))


@query("""WITH o AS (SELECT 'o' || o_orderkey::VARCHAR AS accession, o_orderkey AS k, o_totalprice AS price, year(o_orderdate)::INTEGER AS fiscal_year FROM orders)
SELECT accession, 'net_income' AS metric, CASE WHEN k % 100 = 0 THEN 'NetIncomeLoss' ELSE 'ProfitLoss' END AS xbrl_tag, price * 2 AS value, false AS is_instant, fiscal_year FROM o
UNION ALL SELECT accession, 'total_assets', 'Assets', price * 9, true, fiscal_year FROM o""")
def selected_facts(spark, d):
    """The fact chains on payloads made of orders: two tags, durations of 365 and 90 days, and an instant."""
    o = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("accession"), F.to_date("o_orderdate").alias("period_of_report"), "o_custkey", "o_totalprice", "o_orderkey")
    end = F.col("period_of_report").cast("string")

    def fact(days, value, form):
        start = F.date_sub("period_of_report", days).cast("string") if days else F.lit(None).cast("string")
        return F.struct(start.alias("start"), end.alias("end"), value.alias("val"), F.col("accession").alias("accn"), F.year("period_of_report").alias("fy"), F.lit("FY").alias("fp"), F.lit(form).alias("form"))

    def tag(*facts):
        return F.struct(F.create_map(F.lit("USD"), F.array(*facts)).alias("units"))

    price = F.col("o_totalprice")
    income = F.when(F.col("o_orderkey") % 100 == 0, F.lit("NetIncomeLoss")).otherwise("ProfitLoss")
    tags = F.create_map(income, tag(fact(90, price / 4, "10-K"), fact(365, price, "8-K"), fact(365, price * 2, "10-K")), F.lit("Assets"), tag(fact(0, price * 9, "10-K")))
    n = o.count()
    payloads = dealt(o, n, "o_custkey").select(F.col("o_custkey").alias("cik"), F.lit("T").alias("ticker"), F.create_map(F.lit("us-gaap"), tags).alias("facts"))
    return fa.select_facts(dealt(fa.flat_facts(payloads), 4 * n, "accession"), dealt(o, 4 * n, "accession"), fa.tag_chains(spark)).select("accession", "metric", "xbrl_tag", "value", "is_instant", "fiscal_year")
