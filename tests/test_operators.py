import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import drift, facts, features, models, retrieval, verify
from tessera.sources import filings as src
from tessera.streaming import events


def val(start, end, v, accn="a1", fy=2024, fp="FY", form="10-K"):
    return {"start": start, "end": end, "val": v, "accn": accn, "fy": fy, "fp": fp, "form": form}


def payload(spark, space="us-gaap", **tags):
    return spark.createDataFrame([(1, "T", {space: {t: {"units": u} for t, u in tags.items()}})], f"cik bigint, ticker string, facts {src.FACTS.split('facts ')[1]}")


def chosen(spark, df):
    filings = spark.createDataFrame([("a1", dt.date(2024, 9, 28))], "accession string, period_of_report date")
    return {r.metric: r for r in facts.select_facts(facts.flat_facts(df), filings, facts.tag_chains(spark)).collect()}


def test_facts_avoid_the_traps(spark):
    df = payload(
        spark,
        NetIncomeLoss={"USD": [val("2022-09-25", "2023-09-30", 1.0), val("2024-06-30", "2024-09-28", 2.0), val("2023-10-01", "2024-09-28", 3.0, form="8-K"), val("2023-10-01", "2024-09-28", 4.0), val("2023-10-01", "2024-09-28", 5.0, accn="other")]},
        Assets={"USD": [val(None, "2023-09-30", 6.0), val(None, "2024-09-28", 7.0)]},
        EarningsPerShareDiluted={"USD/shares": [val("2023-10-01", "2024-09-28", 6.08)]},
        RevenueFromContractWithCustomerExcludingAssessedTax={"USD": []},
        Revenues={"USD": [val("2023-10-01", "2024-09-28", 9.0)]},
        OperatingIncomeLoss={"USD": [val("2024-06-30", "2024-09-28", 1.0), val(None, "2024-09-28", 2.0)]},
    )
    got = chosen(spark, df)
    assert got["net_income"].value == 4.0 and got["total_assets"].value == 7.0 and got["total_assets"].is_instant
    assert got["eps_diluted"].unit == "USD/shares" and got["revenue"].xbrl_tag == "Revenues"
    assert "operating_income" not in got and "rnd_expense" not in got


def test_period_predicates(spark):
    d = F.lit("2024-01-01").cast("date")
    row = spark.range(1).select(facts.is_annual(d, F.date_add(d, 370)), facts.is_annual(d, F.date_add(d, 90)), facts.is_annual(d, F.date_add(d, 730)), facts.is_annual(F.lit(None).cast("date"), d), facts.is_close(d, F.date_add(d, 10)), facts.is_close(d, F.date_add(d, 11))).first()
    assert list(row) == [True, False, False, False, True, False]


def test_verdict_ladder(spark):
    rows = [
        (100.0, 100.0, None, False, "exact"), (100.4, 100.0, None, False, "within_0.5pct"), (101.5, 100.0, None, False, "within_2pct"),
        (99.0, 100.0, 99.0, False, "wrong_period"), (1e6 + 0.5, 1e6, None, False, "exact"), (None, 100.0, None, False, "abstained"),
        (5.0, None, None, False, "no_ground_truth"), (None, 100.0, None, True, "errored"), (6.13, 5.13, None, False, "wrong"), (1.0, 0.0, None, False, "wrong"), (0.0, 0.0, None, False, "exact"),
    ]
    df = spark.createDataFrame(rows, "v double, t double, p double, e boolean, want string")
    for r in df.withColumn("got", verify.verdict(F.col("v"), F.col("t"), F.col("p"), F.col("e"))).collect():
        assert r.got == r.want, r


def test_error_classes(spark):
    others = F.create_map(F.lit("assets"), F.lit(777.0))
    df = spark.createDataFrame([(1e8, 1e2, "scale:millions"), (-100.0, 100.0, "sign"), (776.0, 100.0, "wrong_metric:assets"), (55.0, 100.0, "unexplained"), (5.0, 0.0, "unexplained")], "v double, t double, want string")
    for r in df.withColumn("got", verify.error_class(F.col("v"), F.col("t"), others)).collect():
        assert r.got == r.want, r


def test_identities_leave_missing_unchecked(spark):
    schema = "id int, total_assets double, total_liabilities double, stockholders_equity double, net_income double, revenue double, cash_and_equivalents double"
    df = spark.createDataFrame([(1, 568.0, 274.0, 294.0, 10.0, 100.0, 5.0), (2, 100.0, 10.0, 120.0, 50.0, 10.0, 200.0), (3, None, 1.0, 1.0, None, None, None)], schema)
    got = {(r.id, r.rule): r.state for r in verify.identities(df).collect()}
    assert {got[1, r] for r in ("balance", "equity_over_assets", "income_over_revenue", "cash_over_assets")} == {"ok"}
    assert got[2, "equity_over_assets"] == got[2, "cash_over_assets"] == got[2, "income_over_revenue"] == "violated" and got[3, "balance"] == "unchecked"


def test_metrics_in_closed_form(spark):
    hits = spark.createDataFrame([("q", 1, "x"), ("q", 2, "a"), ("q", 3, "b"), ("r", 1, "z")], "query_id string, rank int, id string")
    qrels = spark.createDataFrame([("q", "a"), ("q", "b"), ("s", "a")], "query_id string, id string")
    got = {r.query_id: r for r in retrieval.query_scores(hits, qrels).collect()}
    assert set(got) == {"q", "s"} and got["q"].rr == 0.5 and got["q"].recall_1 == 0 and got["q"].recall_3 == 1.0 and got["s"].rr == 0
    assert got["q"].ndcg_3 == pytest.approx((1 / np.log2(3) + 1 / np.log2(4)) / (1 + 1 / np.log2(3)))
    assert retrieval.evaluate(retrieval.query_scores(hits, qrels.limit(0))).count() == 0


def test_fusion_prefers_consensus(spark):
    lists = spark.createDataFrame([("q", 0, 1, "a"), ("q", 0, 2, "c"), ("q", 1, 1, "b"), ("q", 1, 2, "c")], "query_id string, list_no int, rank int, id string")
    assert [r.id for r in retrieval.reciprocal_rank_fusion(lists, 3).orderBy("rank").collect()] == ["c", "a", "b"]
    weighted = lists.withColumn("weight", F.when(F.col("list_no") == 1, 5.0).otherwise(0.1))
    assert [r.id for r in retrieval.reciprocal_rank_fusion(weighted, 3).orderBy("rank").collect()] == ["c", "b", "a"]


def test_dense_search_finds_itself_under_filter(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.standard_normal(8)).tolist(), "ab"[i % 2]) for i in range(40)] + [(90, None, "a"), (91, [0.0] * 8, "a")]
    v = spark.createDataFrame(rows, "id long, vector array<double>, ticker string")
    q = v.where("id in (3, 4)").withColumnRenamed("id", "query_id")
    got = retrieval.dense_search(q, v, 5, ("ticker",)).join(v.select("id", "ticker"), "id").collect()
    assert all(r.id % 2 == r.query_id % 2 for r in got) and {(r.query_id, r.id) for r in got if r.rank == 1} == {(3, 3), (4, 4)}
    assert retrieval.dense_search(q.limit(0), v.drop("ticker"), 5).count() == 0


def test_mode_is_checked_first(spark):
    with pytest.raises(ValueError):
        retrieval.search("fuzzy", None, 5)


def test_bootstrap_brackets(spark):
    rows = spark.createDataFrame([(i, float(i % 5)) for i in range(50)], "position int, x double")
    r = retrieval.bootstrap(rows, "x", 300).first()
    assert r.n == 50 and r.low < r["mean"] < r.high and r["mean"] == 2.0


def unit(*x):
    return (np.array(x) / np.linalg.norm(x)).tolist()


@pytest.mark.parametrize("tile_rows", [1024, 1])
def test_drift_alignment(spark, tile_rows):
    cur = spark.createDataFrame([("b", "c1", unit(1, 0, 0)), ("b", "c2", unit(1, 0.1, 0)), ("b", "c3", unit(0, 0, 1)), ("b", "c4", None), ("only", "c5", unit(1, 0, 0))], "block string, id string, vector array<double>")
    pri = spark.createDataFrame([("b", "p10", unit(1, 0, 0)), ("b", "p11", unit(0, 1, 0)), ("b", "p9", [5.0, 0.0, 0.0]), ("gone", "p12", unit(1, 0, 0))], "block string, id string, vector array<double>")
    got = {(r.block, r.current_id, r.prior_id): (r.status, round(r.similarity, 3)) for r in drift.align(cur, pri, "block", tile_rows=tile_rows).collect()}
    assert got == {
        ("b", "c1", "p10"): ("unchanged", 1.0), ("b", "c2", "p10"): ("unchanged", 0.995), ("b", "c3", None): ("new", 0.0), ("b", "c4", None): ("new", 0.0), ("only", "c5", None): ("new", 0.0),
        ("b", None, "p11"): ("removed", 0.1), ("b", None, "p9"): ("removed", 1.0), ("gone", None, "p12"): ("removed", 0.0),
    }


def test_drift_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), "ab"[k % 2], rng.integers(0, 3, 6).astype(float).tolist()) for k in range(80)]
    df = spark.createDataFrame(rows, "id int, block string, vector array<double>")
    got = {(r.current_id, r.prior_id): r for r in drift.align(df.where("id % 4 < 2"), df.where("id % 4 >= 2"), "block", unchanged=0.95, modified=0.6, tile_rows=7).collect()}
    norm = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    for i, block, v in rows:
        own = [(-round(float(norm(v) @ norm(w)), 12), j) for j, other, w in rows if other == block and (i % 4 < 2) != (j % 4 < 2)]
        if i % 4 < 2:
            sim, j = min(own)
            assert got[i, j if -sim >= 0.6 else None].similarity == pytest.approx(-sim)
        elif not any(p == i for c, p in got if c is not None):
            assert got[None, i].similarity == pytest.approx(-min(own)[0])


def test_diff_of_texts_keeps_failures_as_rows(spark):
    def encode(texts):
        if any("boom" in t for t in texts):
            raise ValueError("no")
        return np.array([[1.0, 0.0] if "supply" in t else [0.0, 1.0] for t in texts])

    cur = spark.createDataFrame([("s", 1, "supply " * 400), ("s", 2, "cyber risk")], "item string, id int, text string")
    pri = spark.createDataFrame([("s", 7, "supply chain")], cur.schema)
    got = {r.current_id: r for r in drift.diff_texts(cur, pri, encode, "item").collect()}
    assert got[1].status == "unchanged" and got[1].text is None and got[2].status == "new" and got[2].text == "cyber risk"
    bad = drift.diff_texts(spark.createDataFrame([("s", 1, "boom")], cur.schema), pri, encode, "item").collect()
    assert {(r.current_id, r.prior_id, r.status, r.error) for r in bad} == {(1, None, None, "ValueError: no"), (None, 7, "removed", None)}


def test_undefined_drift_has_a_reason(spark):
    sides = spark.createDataFrame([(b, c, p) for b, (c, p) in enumerate([(33, 5), (30, 28), (100, 40), (100, 30), (2, 2), (0, 5), (5, 0)])], "block int, n_current int, n_prior int")
    none = spark.createDataFrame([], "block int, status string")
    got = {r.block: r.reason for r in drift.drift_summary(none, sides, "block").collect()}
    assert got == {0: "size_mismatch", 1: None, 2: None, 3: "size_mismatch", 4: "size_mismatch", 5: "no_current", 6: "no_baseline"}


def test_forward_returns(spark):
    d = dt.date(2024, 1, 1)
    prices = spark.createDataFrame([(t, d + dt.timedelta(k), c * (1 + k / 100)) for t, c in (("A", 10.0), ("M", 5.0)) for k in range(0, 120, 10)] + [("B", d, 1.0)], "ticker string, date date, close double")
    events_ = spark.createDataFrame([("A", d), ("B", d), ("C", d)], "ticker string, day date")
    got = {r.ticker: r for r in features.excess_returns(events_, prices, "ticker", "M").collect()}
    assert got["A"].forward == pytest.approx(0.9) and got["A"].excess == pytest.approx(0.0) and got["B"].forward is None and got["C"].excess is None


def plain_folds(rows, features, target, alpha=10.0):
    """Each fold fitted on its own copy of the earlier rows, as the study is stated."""
    import pandas as pd

    df, out = pd.DataFrame(rows), {}
    for fold in sorted(df.fiscal_year.unique()):
        train, test = df[df.fiscal_year < fold], df[df.fiscal_year == fold]
        if len(train) < 40 or len(test) < 5:
            continue
        used = [f for f in features if train[f].notna().any()]
        filled = [x[used].fillna(train[used].median()) for x in (train, test)]
        mean, deviation = filled[0].mean(), filled[0].std().replace(0, 1.0)
        a, b = (((x - mean) / deviation).to_numpy() for x in filled)
        y, base = train[target].to_numpy(), train[target].mean()
        weights = np.linalg.solve(a.T @ a + alpha * np.eye(len(used)), a.T @ (y - base))
        predicted, z = pd.Series(base + b @ weights), test[target].reset_index(drop=True)
        up = z > 0
        ranks = predicted.rank()
        auc = (ranks[up].sum() - up.sum() * (up.sum() + 1) / 2) / (up.sum() * (~up).sum()) if 0 < up.sum() < len(z) else None
        out[fold] = (len(train), len(test), ranks.corr(z.rank()), auc, ((predicted - z) ** 2).mean() ** 0.5, ((base - z) ** 2).mean() ** 0.5, dict(zip(used, weights)))
    return out


def test_ridge_equals_each_fold_fitted_alone(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(240):
        x = rng.standard_normal(4)
        rows.append({"ticker": f"t{k % 40:02d}", "fiscal_year": 2015 + k // 40, "a": float(1e7 + 1e6 * x[0]), "b": float(x[1]) if rng.random() < 0.7 else None, "late": float(x[2]) if k >= 120 else None, "dead": None, "flat": 3.0, "y": float(x[0] - x[1] + x[3])})
    features = ["a", "b", "late", "dead", "flat"]
    schema = "ticker string, fiscal_year int, a double, b double, late double, dead double, flat double, y double"
    df = spark.createDataFrame([tuple(r.values()) for r in rows] + [("t0", 2020, 1.0, None, None, None, 1.0, None), ("t0", 2020, 1.0, None, None, None, 1.0, float("inf"))], schema).repartition(3)
    want, got = plain_folds(rows, features, "y"), {r.fold: r for r in models.walk_forward(df, features, "y").collect()}
    assert set(got) == set(want) and len(want) == 5
    for fold, (n, m, *figures, weights) in want.items():
        r = got[fold]
        assert (r.n_train, r.n_test) == (n, m) and [r.ic, r.auc, r.rmse, r.baseline_rmse] == pytest.approx(figures)
        assert r.coefficients == pytest.approx(weights)
    summary = models.summary(models.walk_forward(df, features, "y")).first()
    assert summary.n_folds == 5 and summary.mean_ic == pytest.approx(np.mean([w[2] for w in want.values()]), abs=1e-4)
    assert models.summary(models.walk_forward(df.limit(3), features, "y")).count() == 0


def test_shuffled_targets_are_those_of_the_year(spark):
    rows = [(f"t{k}", 2000 + k % 3, float(k)) for k in range(30)]
    df = spark.createDataFrame(rows, "ticker string, fiscal_year int, y double").repartition(4)
    got = models.shuffled_targets(df, "fiscal_year", "ticker", 20, 7).collect()
    by = {}
    for r in got:
        by.setdefault((r.permutation, r.fiscal_year), []).append((r.ticker, r.z))
    assert len(by) == 63 and all(sorted(z for _, z in own) == sorted(y for _, f, y in rows if f == year) for (_, year), own in by.items())
    assert all(z == float(t[1:]) for (p, _), own in by.items() if p == 0 for t, z in own)
    assert len({tuple(sorted(own)) for (p, year), own in by.items() if year == 2000}) > 15


def test_permutation_p_is_never_zero(spark):
    rng = np.random.default_rng(2)
    rows = [(f"t{i}", y, float(x := rng.standard_normal()), 5 * float(x) + float(rng.standard_normal())) for y in range(2018, 2024) for i in range(26)]
    df = spark.createDataFrame(rows, "ticker string, fiscal_year int, x double, target double")
    r = models.permutation_test(df, ["x"], "target", permutations=30).first()
    assert r.p == pytest.approx(1 / 31) and r.observed > 0.5
    folds = models.walk_forward(df, ["x"], "target").orderBy("fold").collect()
    assert [f.n_train for f in folds] == sorted(f.n_train for f in folds) and folds[0].n_train >= 40


def test_upsert_and_migration(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, load_seq int")
    assert sorted(map(tuple, src.upserted(old, new, "k").collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert src.conform(old, "k bigint, v string, extra double").dtypes == [("k", "bigint"), ("v", "string"), ("extra", "double")]


def test_failed_groups_are_not_kept(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", False)], "accession string, errored boolean")
    assert [r.accession for r in src.checkpointable(df, "accession").collect()] == ["b"]


def test_landed_files(spark, tmp_path):
    (tmp_path / "x.htm").write_text("<p>é</p>", encoding="utf-8")
    (tmp_path / "y.txt").write_text("plain", encoding="utf-8")
    got = {r.path.rsplit("/", 1)[1]: r for r in src.read_documents(spark, str(tmp_path)).collect()}
    assert got["x.htm"].is_html and got["x.htm"].content == "<p>é</p>" and not got["y.txt"].is_html


def test_submissions(spark):
    arrays = "struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,reportDate:array<string>,primaryDocument:array<string>>"
    df = spark.createDataFrame([("0000320193", ["aapl"], ((["a-1", "a-2", "a-3", "a-4"], ["10-K", "10-Q", "10-K", "10-K"], ["2024-11-01"] * 4, ["2024-09-28", "2024-06-29", "bad", "2019-09-28"], ["d.htm"] * 4),))], f"cik string, tickers array<string>, filings struct<recent:{arrays}>")
    got = src.filings_of(df, ["10-K"], 2020, 2024).collect()
    assert [r.accession for r in got] == ["a-1"] and got[0].primary_doc_url.endswith("/320193/a1/d.htm") and got[0].ticker == "AAPL"


def test_stream_drops_duplicates(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, 5, "view", 1.0), (1, t, 5, "view", 1.0), (2, t + dt.timedelta(hours=30), 5, "buy", 2.0)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.write.parquet(str(tmp_path / "in"))
    out = events.drained(events.distinct_events(events.event_stream(spark, str(tmp_path / "in"), df.schema)), str(tmp_path / "out"), str(tmp_path / "state"))
    assert out.count() == 2


def test_whole_sinks_and_sources(spark, tmp_path):
    (tmp_path / "map.json").write_text('{"0": {"cik_str": 320193, "ticker": "aapl", "title": "Apple"}}')
    assert [tuple(r) for r in src.read_ticker_map(spark, str(tmp_path / "map.json")).collect()] == [("AAPL", 320193, "Apple")]
    (tmp_path / "list.yaml").write_text("tickers:\n  - aapl\n  - ticker: BRK.B  # two\n")
    assert {"AAPL", "BRK.B"} <= {r.ticker for r in src.universe(spark, str(tmp_path / "list.yaml")).collect()}
    assert spark.range(1).select(src.padded_cik(F.lit(320193))).first()[0] == "0000320193"
    (tmp_path / "facts.json").write_text('{"cik": 1, "entityName": "E", "facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2024-09-28", "val": 7, "accn": "a1"}]}}}}}')
    assert facts.flat_facts(src.read_facts(spark, str(tmp_path / "facts.json")).withColumn("ticker", F.lit("T"))).first().value == 7.0
    landed = spark.createDataFrame([("a", 0), ("b", 9)], "accession string, n_bytes int")
    assert [r.accession for r in src.not_landed(spark.createDataFrame([("a",), ("b",), ("c",)], "accession string"), landed).orderBy("accession").collect()] == ["a", "c"]
    old, new = (spark.createDataFrame(r, "accession string, x int") for r in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4)]))
    for df in (old, new):
        src.replace_partitions(df, str(tmp_path / "parts"), "accession")
    assert sorted((r.accession, r.x) for r in spark.read.parquet(str(tmp_path / "parts")).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    src.write_features(old, str(tmp_path / "store"))
    assert spark.read.option("header", True).csv(str(tmp_path / "store/features.csv")).count() == spark.read.parquet(str(tmp_path / "store/features.parquet")).count() == 2
    src.write_artifact(spark.createDataFrame([("q", None, [1, 2])], "id string, value double, ids array<int>"), str(tmp_path / "set"))
    assert src.read_artifact(spark, str(tmp_path / "set"), "id string, value double, ids array<int>, later string").first().asDict() == {"id": "q", "value": None, "ids": [1, 2], "later": None}
    spark.createDataFrame([("T", "2024-01-02", 5)], "ticker string, date string, close int").write.parquet(str(tmp_path / "prices"))
    assert tuple(src.read_prices(spark, str(tmp_path / "prices")).first()) == ("T", dt.date(2024, 1, 2), 5.0)


def test_indexes_are_stored_and_upserted(spark, tmp_path):
    docs = spark.createDataFrame([(1, "net sales 391,035 391,035"), (2, "cost of sales"), (3, None), (4, "")], "id int, text string")
    counts = {r.id: (r.length, {c.term: c.tf for c in r.counts}) for r in retrieval.term_counts(docs, "id", "text").collect()}
    assert counts == {1: (4, {"net": 1, "sales": 1, "391,035": 2}), 2: (3, {"cost": 1, "of": 1, "sales": 1}), 3: (0, {}), 4: (0, {})}
    src.write_lexical_index(retrieval.term_counts(docs, "id", "text"), str(tmp_path / "lexical"))
    index = src.read_lexical_index(spark, str(tmp_path / "lexical"))
    asked = spark.createDataFrame([("q", "what of 391,035")], "query_id string, question string")
    assert [r.id for r in retrieval.lexical_search(index, asked, 1).collect()] == [1]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, vector array<double>")
    src.write_vector_index(v, str(tmp_path / "dense"))
    new = spark.createDataFrame([(2, [1.0, 1.0], 1), (3, [5.0, 5.0], 1)], "id int, vector array<double>, load_seq int")
    src.write_vector_index(src.upsert_vectors(src.read_vector_index(spark, str(tmp_path / "dense")), new), str(tmp_path / "dense2"))
    again = src.read_vector_index(spark, str(tmp_path / "dense2"))
    assert again.count() == 3 and {r.id: r.vector for r in again.collect()}[2] == [1.0, 1.0]


def test_dense_search_in_slices(spark):
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(60)], "id long, vector array<double>")
    q = v.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    whole, sliced = ({(r.query_id, r.rank, r.id) for r in retrieval.dense_search(q, v, 4, query_bytes=n).collect()} for n in (1 << 20, 200))
    assert whole == sliced and len(whole) == 80


def test_order_statistics(spark):
    rows = [(g, float(x)) for g, n in (("a", 1), ("b", 7), ("c", 40)) for x in range(n)] + [("b", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    from tessera.functions.stats import order_statistics

    got = {r.g: (r.mid, r.high) for r in order_statistics(df, "x", {"mid": 0.5, "high": 0.95}, "g").collect()}
    assert got == {"a": (0.0, 0.0), "b": (3.0, 6.0), "c": (20.0, 38.0)}
    assert order_statistics(df, "x", {"mid": 0.5}).first().mid == sorted(x for _, x in rows if x is not None)[24]
    assert order_statistics(df.limit(0), "x", {"mid": 0.5}).count() == 0


def test_usable_figures_and_profile(spark):
    df = spark.createDataFrame([(True, 1.0, "c", 0.5), (True, 1.0, "c", 0.4), (True, None, "c", 0.9), (None, 1.0, "c", 0.9), (True, 1.0, None, 0.9)], "f boolean, v double, c string, p double")
    assert [r[0] for r in df.select(verify.usable(F.col("f"), F.col("v"), F.col("c"), F.col("p"))).collect()] == [True, False, False, False, False]
    store = spark.createDataFrame([("A", 2020, 30, 0.1), ("A", 2021, 50, -0.1), ("B", 2021, None, None)], "ticker string, fiscal_year int, reporting_lag_days int, excess_return double")
    p = features.profile(store).first()
    assert (p.n_rows, p.n_companies, p.first_year, p.last_year, p.median_lag, p.n_target, p.positive_share) == (3, 2, 2020, 2021, 40.0, 2, 0.5)


def test_balance_against_no_assets_is_unchecked(spark):
    schema = "id int, total_assets double, total_liabilities double, stockholders_equity double, net_income double, revenue double, cash_and_equivalents double"
    df = spark.createDataFrame([(1, 0.0, 274.0, 294.0, 10.0, 100.0, 5.0), (2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (3, -0.0, 1.0, 1.0, 1.0, 1.0, 1.0)], schema)
    got = {(r.id, r.rule): r.state for r in verify.identities(df).collect()}
    assert {got[k, "balance"] for k in (1, 2, 3)} == {"unchecked"} and got[1, "cash_over_assets"] == "violated" and got[2, "cash_over_assets"] == "ok"


def test_drawn_order_is_that_of_the_digests():
    import hashlib

    for n in (1, 9, 10, 101, 20_000):
        want = sorted(range(n), key=lambda k: (hashlib.md5(b"7:12:1999:%d" % (k + 1)).hexdigest(), k))
        assert models.drawn_order("7:12:1999:", n).tolist() == want
    with pytest.raises(ValueError):
        models.drawn_order("x" * 55, 1)


def test_permutations_multiply_no_rows(spark, monkeypatch):
    """Same null as by a table of all rows and permutations, without that table."""
    rng = np.random.default_rng(5)
    rows = [(f"t{k:02d}", 2000 + y, float(rng.integers(5)), None if k % 7 == 0 else float(rng.standard_normal()), float(rng.integers(9))) for y in range(4) for k in range(30)]
    df = spark.createDataFrame(rows, "ticker string, fiscal_year int, a double, b double, y double").repartition(3)
    drawn = models.shuffled_targets(df, "fiscal_year", "ticker", 6, 7).collect()
    ics = {}
    for b in range(7):
        shuffled = spark.createDataFrame([(r.ticker, r.fiscal_year, r.a, r.b, r.z) for r in drawn if r.permutation == b], df.schema)
        ics[b] = np.mean([r.ic for r in models.walk_forward(shuffled, ["a", "b"], "y").collect()])
    monkeypatch.setattr(models, "shuffled_targets", None)
    got = models.permutation_test(df, ["a", "b"], "y", permutations=6).first()
    null = [ics[b] for b in range(1, 7)]
    assert got.n == 6 and got.observed == pytest.approx(ics[0]) and got.null_mean == pytest.approx(np.mean(null)) and got.null_std == pytest.approx(np.std(null))


def test_dense_search_keeps_ties_by_id_and_holds_little(monkeypatch):
    """Batches of many duplicates: the k best by score and id, and scores of a tile alone."""
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(retrieval, "TILE", 64)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((40, 8))
    ids, labels = rng.permutation(4000), rng.integers(3, size=4000)
    vectors = base[rng.integers(40, size=4000)]
    asked = [{"query_id": q, "vector": base[q % 40].tolist(), "label": q % 3} for q in range(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[a : a + 2000]), pa.array(vectors[a : a + 2000].tolist()), pa.array(labels[a : a + 2000])], names=["id", "vector", "label"]) for a in (0, 2000)]
    for same in ((), ("label",)):
        run = retrieval._nearest(asked, 7, same, 9)
        tracemalloc.start()
        got = [x for b in run(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns))]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        scores = np.round(np.array([a["vector"] for a in asked]) / np.linalg.norm([a["vector"] for a in asked], axis=1)[:, None] @ (vectors / np.linalg.norm(vectors, axis=1)[:, None]).T, 9)
        for a, row in zip(asked, scores):
            want = sorted(((-s, i) for s, i, own in zip(row, ids, labels) if not same or own == a["label"]))[:7]
            assert sorted((-s, i) for q, i, s in got if q == a["query_id"]) == want
        assert peak < 2_000_000  # all scores of a batch are 4.8 MB


def test_lexical_scores_are_summed_where_they_are_made(spark):
    docs = spark.createDataFrame([(k, " ".join(["net", "cash", "391,035", f"w{k}"][: 1 + k % 4]), "ab"[k % 2]) for k in range(40)], "id long, text string, lang string")
    index = retrieval.lexical_index(retrieval.term_counts(docs, "id", "text"))
    asked = spark.createDataFrame([("q", "net cash w7"), ("r", "391,035")], "query_id string, question string")
    plain = {(r.query_id, r.id): r.score for r in retrieval.lexical_scores(index, asked).collect()}
    scored = retrieval.lexical_scores(index, asked, docs.select("id", "lang"))
    assert {(r.query_id, r.id): r.score for r in scored.collect()} == plain and len(plain) > 20
    assert all(r.lang == "ab"[r.id % 2] for r in scored.collect())
    # no exchange of pairs: none deals by query
    for plan in (scored, retrieval.lexical_scores(index, asked)):
        assert "hashpartitioning(query_id#" not in plan.where("score > 1")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_parts_grow_with_the_rows(spark):
    from tessera.sources.shared import dealt

    df = spark.range(1000).withColumn("k", F.col("id") % 100)
    got = dealt(df, 1000, "k", rows=50)
    assert got.rdd.getNumPartitions() == 20 and got.count() == 1000
    assert got.select("k", F.spark_partition_id().alias("p")).distinct().count() == 100
    assert dealt(df, 1000, "k").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_trees_read_a_stored_frame(spark, monkeypatch):
    made, own = [], models.new_folder
    monkeypatch.setattr(models, "new_folder", lambda s, name: made.append(own(s, name)) or made[-1])
    df = spark.createDataFrame([(2000 + k // 40, float(k % 7), float(k % 5)) for k in range(80)], "fiscal_year int, a double, y double")
    got = models.walk_forward_trees(df, ["a"], "y", maxIter=1, maxDepth=1).collect()
    assert [(r.fold, r.n_train, r.n_test) for r in got] == [(2001, 40, 40)] and len(made) == 1 and spark.read.parquet(made[0]).count() == 80
