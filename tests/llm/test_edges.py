"""Cases at the edges of the training-data operators, each against a plain version."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, chat_tools, common, decontaminate, embedding_dedup, pii, sharding, simhash, substring_dedup, toxicity
from tessera.llm.common import Stage

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_long_blank_stretches_are_encoded():
    encoder = byte_bpe.codec(BPE, public_tokenizers.PATTERN)[0]
    for blank in (" ", "\n", "\t \n", " "):
        text = "word" + blank * (1_200_000 // len(blank)) + "next 12"
        ids = byte_bpe.encode(text, BPE, public_tokenizers.PATTERN)
        assert byte_bpe.decode(ids, BPE, public_tokenizers.PATTERN) == text.encode()
        short = "word" + blank * (150_000 // len(blank)) + "next 12"
        assert byte_bpe.encode(short, BPE, public_tokenizers.PATTERN) == encoder.encode_ordinary(short)
    mixed = "Ab's 12 x  \n\n y!? é z" * 50
    assert byte_bpe.splitter(public_tokenizers.PATTERN).findall(mixed) == regex.findall(public_tokenizers.PATTERN, mixed)


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.99, 0.05]), (3, [0.99, 0.06]), (4, [0.05, 0.99]), (9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == Counter({(1, 3, 1, True): 1, (1, 1, 1, True): 1, (2, 3, 1, False): 1, (3, 3, 1, False): 1, (9, 3, 1, False): 1, (4, 1, 1, False): 1})


def test_groups_that_meet_in_every_table_count_once(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((4, 16))
    rows = [(k, (base[k % 4] + 1e-4 * rng.standard_normal(16)).tolist()) for k in range(200)]
    for bucket in (1024, 7):
        got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), bucket_rows=bucket).collect()
        assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(k, 49, k % 4) for k in range(200)}


def test_substrings_by_way_of_coarse_buckets(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(words, k=50))
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(0, 90))) + (" " + passage if k % 3 == 0 else "") + f" end{k}") for k in range(90)] + [(200, passage), (201, passage), (202, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    one, two = ({(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(df, **kw).collect()} for kw in ({}, {"bucket_bytes": 200, "fanout": 5}))
    assert one == two and sum(r[2] > 0 for r in one) == 32


def test_marks_are_remembered_within_bounds(monkeypatch):
    monkeypatch.setattr(substring_dedup, "KEPT_MARKS", 4)
    marks = substring_dedup._Marks()
    a = np.arange(6, dtype=np.uint64)
    assert marks.new(a).all() and marks.new(a).tolist() == [False] * 4 + [True] * 2 and len(marks.held) == 4


def plain_discovery(instances, min_seeds=5, confidence=0.8, rounds=3):
    """The scores on the pattern-instance graph, by lists. instances: value, kind or None, patterns."""
    held, kinds = defaultdict(set), {}
    for value, kind, patterns in instances:
        for p in patterns:
            held[p].add(value)
            kinds[p, value] = max(kind or "", kinds.get((p, value), ""))
    usable = {}
    for p, values in held.items():
        for kind, seeds in Counter(kinds[p, v] for v in values).items():
            if kind and seeds >= min_seeds:
                usable[p, kind] = seeds
    fits = {"phone": lambda v: re.fullmatch(r"[+(]?[0-9().-]+\W?", v) and 7 <= len(re.sub("[^0-9]", "", v)) <= 15, "email": lambda v: re.fullmatch(r"\S+@\S+", v), "ip": lambda v: re.fullmatch(r"[0-9]+(\.[0-9]+){3}\W?", v), "card": lambda v: re.fullmatch(r"[0-9-]+\W?", v) and 12 <= len(re.sub("[^0-9]", "", v)) <= 19}
    open_ = {(p, kind, v) for p, kind in usable for v in held[p] if not kinds[p, v] and fits[kind](v)}
    score = defaultdict(float)
    for _ in range(rounds):
        sure = {(p, k): (n + sum(score[v, k] for q, l, v in open_ if (q, l) == (p, k))) / len(held[p]) for (p, k), n in usable.items()}
        miss = defaultdict(float)
        for p, k, v in open_:
            if sure[p, k] > 0.5:
                miss[v, k] += math.log(max(1e-12, 1 - sure[p, k]))
        score = defaultdict(float, {x: 1 - math.exp(m) for x, m in miss.items()})
    best = {}
    for (v, k), s in score.items():
        if s >= confidence and (s, k) > best.get(v, (0.0, "")):
            best[v] = (s, k)
    return {v: k for v, (_, k) in best.items()}


def test_graph_scores_equal_the_plain_ones(spark):
    rng = random.Random(11)
    leads = ["call me at", "phone no", "ring", "order number", "mail to", "host at", "see item"]
    rows = []
    for k in range(900):
        lead = rng.choice(leads)
        if lead in ("order number", "see item"):
            value = f"{rng.randrange(10**7, 10**9)}"
        elif lead == "mail to":
            value = rng.choice([f"user{k % 60}@mail.example.org", f"user{k % 40}@localhost", "someone"])
        elif lead == "host at":
            value = rng.choice([f"10.0.{k % 50}.7", f"310.2.{k % 9}.4", "here"])
        else:
            value = rng.choice([f"+1 988 555 {1000 + k % 150}", f"555-0{100 + k % 30}-77", "home"])
        rows.append((k, f"Please {lead} {value} {rng.choice(['now', 'today', 'or'])} and go"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tokens = Stage(spark, "t").write(pii.instances(df))
    want = plain_discovery([(r.value, r.kind, r.patterns) for r in tokens.collect()])
    got = {r.value: r.kind for r in pii.discover(tokens, Stage(spark, "t")).collect()}
    assert got == want and {"phone", "email"} <= set(want.values())
    report = {r.doc_id: r for r in pii.pii_report(df).collect()}
    spans = {k: {text[int(a) : int(b)].lower(): kind for kind, a, b in (s.split(":") for s in report[k].spans.split(",") if s)} for k, text in rows}
    assert all(spans[k].get(v) == kind for k, text in rows for v, kind in want.items() if f" {v} " in text.lower())
    assert sum(len(s) for s in spans.values()) > sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in report.values())


def test_contexts_take_whole_words(spark):
    long = "q" * 100_000
    rows = [(k, f"{long} at +1 (20{k}) 555-01{k:02d} go") for k in range(10, 20)] + [(50, f"{'q' * 99_999} at 555-0199-123 go"), (51, f"{long} at 555-0199-124 go")]
    got = {r.doc_id: r.spans for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[51] == "phone:100004:100016" and got[50] == ""  # another word, if only by a letter
    patterns = {p for r in pii.instances(spark.createDataFrame(rows, "doc_id long, text string")).collect() for p in r.patterns}
    assert f"< {long} at" in patterns and f"< {'q' * 99_999} at" in patterns and len(patterns) == 3


def test_spans_beside_any_columns(spark):
    df = spark.createDataFrame([(1, "a@b.co x", "old", 3, 4, 5), (2, None, None, None, None, None)], "doc_id int, text string, spans string, key int, row int, found int")
    got = {r.doc_id: r for r in pii.with_spans(df).collect()}
    assert got[1].spans[0].kind == "email" and got[1].key == 3 and got[1].row == 4 and got[2].spans == []
    red = {r.doc_id: r for r in pii.redacted_documents(df).collect()}
    assert red[1].text == "[EMAIL] x" and red[1].spans == "old" and red[2].text is None


def test_levels_of_long_chains_and_many_needs(spark):
    rng = random.Random(2)
    needs = {k: [k - 1] if k % 50 else [] for k in range(1, 400)}
    needs |= {1000 + k: sorted(rng.sample([*range(1, 400), *range(1000, 1000 + k)], min(3, 399))) for k in range(40)}
    needs |= {5000: [5001], 5001: [5002], 5002: [5000], 5003: [5002], 5004: [1, 5003]}
    rows = [("c", k, f"id{k}", "t", "{" + ",".join(f'"p{i}":[{{"$result":"id{x}"}}]' for i, x in enumerate(own)) + "}") for k, own in needs.items()]
    want, changed = {}, True
    while changed:
        changed = False
        for k, own in needs.items():
            known = [x for x in own if x in needs]
            if k not in want and all(x in want for x in known):
                want[k], changed = 1 + max((want[x] for x in known), default=-1), True
    calls = spark.createDataFrame(rows, chat_tools.CALLS).repartition(3)
    stage = Stage(spark, "t")
    got = {int(r.call_id[2:]): r.level for r in chat_tools._levels(stage.write(calls.withColumn("arguments", F.to_json(F.try_parse_json("arguments")))), stage).collect()}
    assert got == want and max(want.values()) > 49 and 5000 not in got


def test_ids_and_lengths_are_those_of_the_strings(spark):
    calls = spark.createDataFrame([("c", 1, 'a"x\\é', "f", '{"s":"\\n"}'), ("c", 2, "b", "f", '{"s":{"$result":"a\\"x\\\\\\u00e9"}}'), ("c", 3, "d", "f", '{"s":"text with {\\"$result\\":\\"b\\"} in it"}'), ("c", 4, "e", "f", '{"s":"\\n\\""}')], chat_tools.CALLS)
    schemas = spark.createDataFrame([("f", "s", "string", True, 2)], chat_tools.SCHEMAS)
    got = {r.call_id: r for r in chat_tools.link_tool_calls(calls, spark.createDataFrame([], chat_tools.RESULTS), schemas).collect()}
    assert got['a"x\\é'].errors == "too short s" and got["e"].errors == "" and (got["b"].level, got["d"].level) == (1, 0)


def test_swaps_are_made_in_sentences():
    swaps = toxicity.swaps_of((("women", "men"), ("old", "young")))
    assert toxicity.changes("No terms here. Women met men! Old women left\nmen", swaps)[0] == (frozenset(), frozenset())
    away, added = toxicity.changes("Old women left", swaps)[0]
    assert {"old", "women", "wome*"} <= away and {"young", "men", "youn*"} <= added
    assert len(toxicity.changes("women. men. women and men. nobody", swaps)) == 3 and toxicity.changes(None, swaps) == []


def test_counterfactuals_use_given_kinds(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        toxic = k % 6 == 0
        rows.append((k, " ".join(rng.choices(["able", "bare", "cold", "dare", "earn"], k=12)) + ". " + ("zorb zzvile" if toxic else "plain") + "."))
        labels.append((k, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    none, own = toxicity.fit(docs, marks), toxicity.fit(docs, marks, identity_terms=(("zorb", "krell"),), counterfactual=50.0)
    assert none.n_swaps == 0 and own.n_swaps > 50
    assert abs(own.weights.get("zorb", 0.0)) < 0.2 * abs(none.weights["zorb"]) and own.score("zzvile") > 0.5
    assert len(toxicity.fit(docs, marks, max_features=2).weights) <= 2


def test_fit_equals_a_dense_descent():
    """The sparse solver against the same objective in dense matrices, by its gradient."""
    rng = np.random.default_rng(3)
    x = (rng.random((60, 8)) < 0.4).astype(float)
    y = (x[:, 0] + x[:, 1] > 1).astype(float)
    swaps = [([0], [2], 3), ([1, 3], [4], 1)]
    bias, w = toxicity.solve(y, [np.flatnonzero(r).tolist() for r in x], swaps, 8, counterfactual=5.0, l2=0.05, steps=4000)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    d = np.zeros((2, 8))
    d[0, 0], d[0, 2], d[1, 1], d[1, 3], d[1, 4] = 1, -1, 1, 1, -1
    r = weight * (1 / (1 + np.exp(-(x @ w + bias))) - y)
    grad = x.T @ r + 0.05 * w + 2 * 5.0 * d.T @ (np.array([0.75, 0.25]) * (d @ w))
    assert np.abs(grad).max() < 1e-3 and abs(r.sum()) < 1e-3


def test_whole_records_with_maps_and_clashing_names(spark, tmp_path):
    rows = [(k % 5, "same" if k % 2 else None, {"b": k % 2, "a": 1}, 7, "x") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id int, text string, tags map<string,int>, shard int, row string").repartition(3)
    got = sharding.place_documents(df, 6).collect()
    assert Counter((r.record.doc_id, r.record.text, tuple(sorted(r.record.tags.items())), r.record.shard) for r in got) == Counter((d, t, tuple(sorted(m.items())), s) for d, t, m, s, _ in rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len({(r.shard, r.slot) for r in got}) == 40
    assert sharding.shard_documents(df, 6).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "two three"), (7, "TWO three"), (8, "two four")], "item_id long, text string")
    found = decontaminate.find_contamination(docs, bench).first()
    assert found["items"] == ["", "7"] and [(h.first, h.last) for h in found.hits] == [(1, 3)]


def test_windows_sliced_and_shuffled_to_their_shards(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join(rng.choices(words, k=80))) for k in range(60)], "doc_id long, text string").repartition(3)
    texts = {r.doc_id: r.text.split() for r in docs.collect()}
    items = [(k, " ".join(texts[k][a : a + 14])) for k in range(0, 60, 3) for a in (3, 40)] + [(900, "never seen words " * 5), (901, "w1 w2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {tuple(t.split()[a : a + 10]) for _, t in items for a in range(max(1, len(t.split()) - 9))}
    want = {}
    for d, own in texts.items():
        hit = {p for n in (2, 10) for k in range(len(own) - n + 1) if tuple(own[k : k + n]) in windows for p in range(k, k + n)}
        want[d] = hit
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_TERMS", 0)
    for slices in (5, 50_000):
        got = {r.doc_id: {p for h in r.hits for p in range(h.first, h.last)} for r in decontaminate.find_contamination(docs, bench, slice_windows=slices).collect()}
        assert got == want


def test_hot_keys_join_like_any_other(spark):
    rows = spark.createDataFrame([(1 if k % 3 else k, k) for k in range(900)], "k int, x int")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("x").alias("total"))
    got = sorted(map(tuple, common.hot_join(rows, keyed, ["k"], 900).select("k", "x", "total").collect()))
    assert got == sorted(map(tuple, rows.join(keyed, "k").select("k", "x", "total").collect()))


def joins(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return re.findall(r"(?:HashJoin|MergeJoin) .*?, (Inner|Left\w+|Right\w+|FullOuter)", plan)


def test_no_join_makes_rows_that_only_pass_a_hot_key(spark, tmp_path):
    # what holds no hot key went through an anti join, which made a row of each of them
    lots = [(None if k % 50 == 0 else 1 if k % 3 else k, -(1 << 40) if k % 3 == 1 else k, k) for k in range(3000)]
    for name, rows in (("hot", lots), ("even", [(k % 1000, k % 1000, k) for k in range(3000)])):
        made = spark.createDataFrame(rows, "a int, b long, x int")
        made.write.parquet(f"{tmp_path}/{name}")
        made = spark.read.parquet(f"{tmp_path}/{name}")
        for on in (["a"], ["b"], ["a", "b"]):
            made.groupBy(*on).agg(F.count("*").alias("n"), F.sum("x").alias("total")).write.parquet(f"{tmp_path}/{name}{len(on)}{on[0]}")
            keyed = spark.read.parquet(f"{tmp_path}/{name}{len(on)}{on[0]}")
            got = common.hot_join(made, keyed, on, 3000)
            want = made.join(keyed.drop("n"), on).select(*got.columns)
            assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
            assert joins(got) == ["Inner"] * (2 if name == "hot" else 1)


def test_intermediate_tables_need_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        common.shared_dir(Session())


def test_large_candidate_components_are_joined_exactly(spark):
    """One chain of texts, each similar to the next alone, and strangers that share a passage with all of them."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    line = [word() for _ in range(900)]
    rows = [(k, " ".join(line[15 * k : 15 * k + 200])) for k in range(40)]
    shared = [word() for _ in range(90)]
    rows += [(100 + k, " ".join(shared + [word() for _ in range(110)])) for k in range(30)]
    sets = {d: {tuple(t.split()[a : a + 5]) for a in range(len(t.split()) - 4)} for d, t in rows}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * (len(sets[a]) * len(sets[b])) ** 0.5
    assert near(0, 1) and not near(0, 5) and not near(100, 101)
    stage = Stage(spark, "t")
    texts = stage.write(spark.createDataFrame(rows, "node long, text string").repartition(3))
    members = stage.write(texts.select("node", F.lit(0).cast("long").alias("bucket"), F.lit(70).alias("n")))
    from tessera.llm.components import connected_components

    for size in (256, 4):
        found = {r.node: r.component for r in connected_components(simhash._verified(members, texts, stage, 0.8, size), stage).collect()}
        assert found == {k: 0 for k in range(40)}
