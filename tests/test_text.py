from pyspark.sql import functions as F

from tessera.functions import html_dom, text
from tessera.operators import claims, surfaces


def value(spark, column, **cells):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()]) if cells else spark.range(1)
    return row.select(column).first()[0]


def test_tokens_keep_figures(spark):
    assert value(spark, text.tokens(F.col("t")), t="Revenue of $391,035 rose 5.2%") == ["revenue", "of", "391,035", "rose", "5.2%"]


def test_token_count_and_null(spark):
    assert value(spark, text.token_count(F.col("t")), t="a b c") == 3
    assert value(spark, text.token_count(F.lit(None).cast("string"))) == 0


def test_prefix_skips_blanks(spark):
    assert value(spark, text.context_prefix(F.lit("AAPL"), F.lit(2024), F.lit(""), F.lit("Title"))) == "AAPL | FY2024 | Title"


def test_quote_cap(spark):
    assert value(spark, text.cap_words(F.col("t")), t=" ".join("abcdefghijklmnopqrstuvwxyz")).endswith("y...")
    assert value(spark, text.cap_words(F.col("t")), t="short quote") == "short quote"


def test_value_variants(spark):
    found = value(spark, text.value_variants(F.lit(391035000000.0)))
    assert found[:4] == ["391,035", "391,035,000", "391,035,000,000", "391.0"] and len(found) == 5
    assert value(spark, text.value_variants(F.lit(6.08), F.lit(True))) == ["6.08"]
    assert value(spark, text.value_variants(F.lit(None).cast("double"))) == []


def test_refused_pages_take_the_native_form(spark):
    df = spark.createDataFrame([(1, "<p>a b</p><p>c &amp; d</p><![foo[ x"), (2, "<p>fine</p>"), (3, None)], "id int, html string")
    got = {r.id: r.x for r in df.select("id", html_dom.html_text(F.col("html")).alias("x")).collect()}
    assert got[1].parser_used == "regex" and got[1].text.startswith("a b\nc & d") and got[1].n_words >= 5 and got[1].n_tables == 0
    assert got[2].parser_used == "dom" and got[2].text == "fine" and got[3] is None


def test_html_tables_comments_and_nesting():
    page = "<html><head><title>x</title></head><body><p>A&nbsp;b</p><!-- gone --><table><tr><td>Net</td><td>$</td><td>5 <b>m</b></td></tr><tr><td><table><tr><td>in</td></tr></table></td></tr></table>tail<script>var x</script></body></html>"
    got = html_dom.read_html(page)
    assert got["n_tables"] == 1 and "Net | 5 m" in got["text"] and "gone" not in got["text"] and "var x" not in got["text"]
    assert got["text"].startswith("A b\n") and got["text"].endswith("tail")
    assert html_dom.read_html(None) is None and html_dom.read_html("")["text"] == ""


MEMOS = {
    "In fiscal 2024 the 12 segments earned $6 and 3 regions": [("$6", 6.0, False)],
    "$2,024 million": [("$2,024 million", 2.024e9, False)],
    "up 5.2 percent": [("5.2 percent", 5.2, True)],
    "": [],
    "-$42.0 billion": [("-$42.0 billion", -42e9, False)],
    "$-42.0 billion": [("$-42.0 billion", -42e9, False)],
    "−$42.0 billion": [("−$42.0 billion", -42e9, False)],
    "$‐42.0 billion": [("$‐42.0 billion", -42e9, False)],
    "$‑42.0 billion": [("$‑42.0 billion", -42e9, False)],
    "a loss of $42.0 billion": [("$42.0 billion", -42e9, False)],
    "negative $42.0 billion": [("$42.0 billion", -42e9, False)],
    "was $(42.0) billion": [("(42.0)", -42.0, False)],
    "(42.5)": [("(42.5)", -42.5, False)],
    "(see $42.5 million": [("$42.5 million", 42.5e6, False)],
    "There was a loss. Revenue was $5 million": [("$5 million", 5e6, False)],
    "Cash flow was negative. Revenue was 177.6 billion (see note 3).": [("177.6 billion", 177.6e9, False)],
    "391.0M 12.55 billions 5bn US$391.0 billion 125x 391,035": [("12.55", 12.55, False), ("5bn", 5e9, False), ("391.0 billion", 391e9, False), ("391,035", 391035.0, False)],
    "é5 naïve7 5é 1,2345 .5 a.77 7.5.": [("7.5", 7.5, False)],
}


def test_figures_signs_years_and_small_numbers(spark):
    df = spark.createDataFrame([(t,) for t in MEMOS], "t string")
    for r in df.withColumn("c", claims.claims(F.col("t"))).collect():
        assert [(c.raw, c.value, c.is_percentage) for c in r.c] == MEMOS[r.t], r.t
        assert all(r.t[c.start : c.end] == c.raw for c in r.c)
    assert value(spark, claims.claims(F.lit(None).cast("string"))) is None


def test_sentences_of_claims(spark):
    text_ = "Heading\nRevenue was $391.0 billion in 3.5 years! Debt\nwas $5\nor so. End $7"
    c = F.transform(claims.claims(F.col("t")), lambda x: claims.sentence_of(F.col("t"), x))
    assert value(spark, c, t=text_) == ["Revenue was $391.0 billion in 3.5 years!"] * 2 + ["was $5\nor so.", "End $7"]


def test_long_texts_take_time_in_proportion(spark):
    long = "Total 391,035 and 5.5% " * 5000
    found = value(spark, F.size(claims.claims(F.col("t"))), t=long)
    assert found == 10_000


def test_gate_strips_and_annotates(spark):
    memo = "Revenue was $391.0 billion. Debt was $77.7 billion. Margin rose 3.1%."
    counted = "Heading\n\nWe list 1,234.0 new risks.\nBut 9,999.0 went\naway. Fine."
    df = spark.createDataFrame([(1, memo), (2, None), (3, "No figures.\nNone at all"), (4, counted)], "id int, text string").withColumn("verified", F.create_map(F.lit("revenue"), F.lit(391035000000.0)))
    diff = F.struct(*[F.lit(x).cast("double").alias(n) for n, x in (("new", 1234), ("modified", None), ("unchanged", 2), ("removed", 0), ("drift_score", 0.5))])
    got = {r.id: r for r in claims.gate(df.withColumn("diff", diff), diff="diff").collect()}
    assert got[1].shown == "Revenue was $391.0 billion. Margin rose 3.1%." and got[1].support_rate == 0.5 and got[1].examples == ["$77.7 billion"]
    assert got[1].annotated == "Revenue was $391.0 billion. Debt was $77.7 billion [UNVERIFIED]. Margin rose 3.1%."
    assert got[2].support_rate is None and got[2].shown is None and got[3].shown == "No figures.\nNone at all"
    assert got[4].shown == "Heading\n\nWe list 1,234.0 new risks.\n Fine." and got[4].claims[0].metric == "diff_new"
    bare = {r.id: r for r in claims.gate(df.withColumn("verified", F.lit(None).cast("map<string,double>"))).collect()}
    assert bare[1].n_unsupported == 2


def test_the_first_metric_of_the_map_wins(spark):
    entries = claims.verifiable(F.create_map(F.lit("z"), F.lit(5.0), F.lit("a"), F.lit(5.0), F.lit("zero"), F.lit(0.0)))
    assert value(spark, claims.supported(claims.claims(F.col("t")), entries), t="$5")[0].metric == "z"


def test_replies(spark):
    rows = [("a", '```json\n{"revenue": {"found": true, "value_as_stated": 5, "scale": "millions", "confidence": 2, "citation": 3}}\n```', None), ("b", "no json", None), ("c", None, "Timeout: x")]
    got = {(r.prompt_id, r.metric): r for r in surfaces.parsed_replies(spark.createDataFrame(rows, "prompt_id string, reply string, error string"), ["revenue", "eps"]).collect()}
    assert got["a", "revenue"].found and got["a", "revenue"].citation == "3" and got["a", "revenue"].confidence == 1.0
    assert got["a", "eps"].abstained and not got["a", "eps"].found and got["b", "revenue"].abstained and got["c", "eps"].errored


def test_failing_model_is_a_row(spark):
    def model(prompt):
        if "bad" in prompt:
            raise ValueError("no")
        return prompt.upper()

    got = {r.prompt_id: r for r in surfaces.complete(spark.createDataFrame([(1, "ok"), (2, "bad")], "prompt_id int, prompt string"), model).collect()}
    assert got[1].reply == "OK" and got[2].error == "ValueError: no"


def test_prompt_parts(spark):
    m = F.create_map(F.lit("b"), F.lit(1.5e9), F.lit("a"), F.lit(12.5), F.lit("c"), F.lit(None).cast("double"))
    assert value(spark, surfaces.figure_lines(m)) == "  a: 12.50\n  b: 1.5 billion (exactly 1,500,000,000)"
    a = F.array(F.lit("x"), F.lit("y-chat"))
    assert value(spark, surfaces.first_available(F.array(F.lit("q")), a, lambda x: x.contains("chat"))) == "y-chat"
    assert value(spark, surfaces.merged(F.lit(None).cast("array<string>"), F.array(F.lit("e")))) == ["e"]
    budget = spark.createDataFrame([(1.0, 2.0, 3), (2.0, 2.0, 3), (0.0, 2.0, 0), (None, 2.0, 1)], "spent double, budget double, n int")
    assert [r[0] for r in budget.select(surfaces.may_write(F.col("spent"), F.col("budget"), F.col("n"))).collect()] == [True, False, False, False]


def test_abstentions_have_no_confidence(spark):
    df = spark.createDataFrame([("a", "no json")], "prompt_id string, reply string")
    assert surfaces.parsed_replies(df, ["eps"]).first().confidence == 0.0


def test_references_without_a_semicolon_stay_as_they_are():
    page = "<h1>ver&amp</h1><p>a&amp;amp b&amp;lt;c &copy;&#39;&copyx; d & e&nosuch;</p>"
    assert html_dom.read_html(page)["text"] == "ver&amp\n\na&amp b<c ©'&copyx; d & e&nosuch;"
