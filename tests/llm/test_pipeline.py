"""Each stage of the pipeline against a plain version, on tables at the edges."""

import base64
import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from tessera.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, pii_spans string, component long, h1 int, shard int, label double, key int"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
STAGES = dict(corpus_pipeline.STAGES)


def tables(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 == 0), 1) for k in range(200)], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{k}" for k in range(5, 25))), (None, "short item"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def made(rng):
    words = ["".join(rng.choice("bcdfglmn") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    rest = ("en", "s", 5, "r", "p", 1, 2, 3, 0.5, 4)
    rows = []
    for k in range(200):
        own = rng.choices(words, k=rng.randrange(8, 80))
        if k % 4 == 0:
            own += ["zzvile"] * 2
        rows.append((k, " ".join(own), *rest))
    group = rng.choices(words, k=150)
    for k in range(12):
        own = list(group)
        own[rng.randrange(150)] = f"x{k}"
        rows.append((300 + k if k % 3 else None, " ".join(own), *rest))
    rows += [(300, " ".join(group), *rest)] * 3
    rows += [(7, "Call +1 (988) 555-2485 or a@b.co, short item, at 10.0.0.1 now", *rest), (7, " ".join(f"bench{k}" for k in range(30)), *rest), (None, " ".join(f"Bench{k}!" for k in range(30)), *rest)]
    rows += [(400, None, *[None] * 10), (None, None, *[None] * 10), (401, "", *rest), (402, " \n ", *rest), (403, "a@b.co " * 3000, *rest), (404, "w" * 200_000, *rest), (405, " " * 300_000, *rest), (406, "short item", *rest)]
    return rows


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    return folder, tables(spark, folder, made(random.Random(5)))


def bag(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def test_toxicity_drops_what_scores_high(spark, corpus):
    folder, docs = corpus
    got = STAGES["toxicity"](spark, docs, folder)
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert got.dtypes == docs.dtypes
    assert bag(got) == Counter(tuple(r) for r in docs.collect() if model.score(r.text) < 0.7)
    kept = {r.text for r in got.collect()}
    assert not any(t and "zzvile" in t for t in kept) and None in kept and "" in kept


def test_near_dedup_keeps_one_row_of_each_group(spark, corpus):
    folder, docs = corpus
    rows, got = docs.collect(), STAGES["simhash_near_dedup"](spark, docs, folder)
    assert got.dtypes == docs.dtypes
    sets = []
    for r in rows:
        w = (r.text or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a].text or "") == (rows[b].text or "") or sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * (len(sets[a]) * len(sets[b])) ** 0.5:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(find(k), []).append(r)
    # of a group one row stays, and it has the least id there is
    kept = Counter(tuple(r) for r in got.collect())
    assert sum(kept.values()) == len(groups) and len(groups) < len(rows)
    for own in groups.values():
        ids = [r.doc_id for r in own if r.doc_id is not None]
        assert sum(kept[tuple(r)] for r in set(own) if not ids or r.doc_id == min(ids)) == 1


def test_decontamination_goes_by_the_text(spark, corpus):
    folder, docs = corpus
    got = STAGES["decontamination"](spark, docs, folder)
    assert got.dtypes == docs.dtypes

    def hit(text):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
        bench = [f"bench{k}".encode() for k in range(5, 25)]
        windows = {tuple(bench[a : a + 10]) for a in range(11)} | {(b"short", b"item")}
        return any(tuple(w[k : k + n]) in windows for n in (2, 10) for k in range(len(w)))

    want = Counter(tuple(r) for r in docs.collect() if not hit(r.text))
    assert bag(got) == want and sum(hit(r.text) for r in docs.collect()) == 4
    assert sum(n for r, n in want.items() if r[0] == 7) == 1  # the clean row of a shared id stays


def test_pii_goes_and_nothing_else(spark, corpus):
    folder, docs = corpus
    got = STAGES["pii"](spark, docs, folder)
    assert got.dtypes == docs.dtypes

    def shown(text):
        text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", text)
        return text.replace("+1 (988) 555-2485", "[PHONE]").replace("10.0.0.1", "[IP]")

    want = Counter()
    for r in docs.collect():
        text = r.text if r.text is None else shown(r.text)
        want[tuple({**r.asDict(), "text": text, "n_chars": None if r.n_chars is None or text is None else len(text)}[c] for c in COLUMNS)] += 1
    assert bag(got) == want
    bare = docs.select("doc_id", "text")
    assert STAGES["pii"](spark, bare, folder).columns == ["doc_id", "text"]


def test_encoding_is_the_librarys(spark, corpus):
    import tiktoken

    folder, docs = corpus
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in STAGES["byte_bpe"](spark, docs, folder).collect())
    want = Counter()
    for r in docs.collect():
        ids = encoder.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += 1
    assert got == want


def test_empty_tables_pass(spark, tmp_path):
    docs = tables(spark, str(tmp_path), [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "byte_bpe" or out.dtypes == docs.dtypes)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_follow_each_other(spark, corpus):
    folder, docs = corpus
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/after{k}"
        stage(spark, now, folder).write.parquet(path)
        now = spark.read.parquet(path)
    got, want = (Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in df.collect()) for df in (corpus_pipeline.run(spark, folder), now))
    assert got == want and 0 < sum(got.values()) < docs.count()
