"""Each training-data operator against a brute-force version, with nulls, ties, repeats, long and empty texts, clashing columns."""

import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import byte_bpe, chat_tools, components, decontaminate, embedding_dedup, pii, sharding, simhash, substring_dedup, token_counts, toxicity
from tessera.llm.common import Stage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score double, rep long, shard int, fp long, key string, kind string, d1 long"
BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def texts():
    rng = random.Random(4)
    words = [rng.choice("abcdefghijklmnop") * rng.randrange(1, 5) + rng.choice(["", "é", "ß", "日本"]) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = [None, "", " ", "one", "One two\tTHREE", passage, passage, passage + " more", "x " * 3000, "word" * 4000, passage.upper()]
    for k in range(40):
        own = [rng.choice(words) for _ in range(rng.randrange(1, 200))]
        if k % 3 == 0:
            cut = rng.randrange(len(own))
            own[cut:cut] = passage.split()[rng.randrange(10) : rng.randrange(40, 60)]
        out.append(("\n" if k % 5 == 0 else " ").join(own))
    return out


TEXTS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with repeated, null and tied ids and with columns named like the operators' own."""
    rows = [(k, t, None, "s", None, "9", 0.5, 1, 2, 3, "k", "z", 7) for k, t in enumerate(TEXTS)]
    rows += [(5, TEXTS[5], *rows[0][2:]), (None, TEXTS[12], *rows[0][2:]), (None, None, *rows[0][2:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def bag(rows, *columns):
    return Counter(tuple(r[c] for c in columns) for r in rows)


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 300)] + [(1000, 1001), (1001, 1000), (5, 5)], "u long, v long").repartition(5)
    got = {r.node: r.component for r in components.connected_components(links, Stage(spark, "t")).collect()}
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000}
    assert components.connected_components(links.limit(0), Stage(spark, "t")).count() == 0


def unit(v):
    return v / np.linalg.norm(v)


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = [unit(rng.standard_normal(32)) for _ in range(12)]
    rows = [(k, (base[k % 12] + 0.03 * rng.standard_normal(32)).tolist()) for k in range(120)]
    rows += [(200 + k, base[0].tolist()) for k in range(30)]  # equal vectors
    rows += [(300, None), (301, [0.0] * 32), (302, [float("nan")] + [1.0] * 31), (303, [None] + [1.0] * 31), (304, [float("inf")] + [0.0] * 31), (305, []), (306, [1.0, 2.0]), (307, [-0.0] * 31 + [1.0]), (308, [0.0] * 31 + [2.0]), (None, base[0].tolist())]
    df = spark.createDataFrame([(a, b, 1, 9, 5) for a, b in rows], "vec_id long, embedding array<double>, label int, rep long, links long").repartition(4)
    for bucket in (1024, 16):  # the second deals buckets into blocks
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, bucket_rows=bucket).collect()}
        good = [(a, np.array(b)) for a, b in rows if a is not None and b and len(b) == 32 and all(x is not None and np.isfinite(x) for x in b) and any(b)]
        x = np.stack([unit(v) for _, v in good])
        near = x @ x.T >= 0.95
        want = {a: int(n) - 1 for (a, _), n in zip(good, near.sum(1))}
        assert {a: got[a].n_links for a in want} == want
        left, root = {a: a for a, _ in good}, None
        for _ in range(len(good)):
            new = {a: min(left[good[j][0]] for j in np.flatnonzero(near[k])) for k, (a, _) in enumerate(good)}
            if new == left:
                break
            left = new
        assert {a: got[a].component_id for a in want} == left
        for a in (300, 301, 302, 303, 304, 305, 306):
            assert (got[a].n_links, got[a].component_id, got[a].kept) == (0, a, True)
        assert got[308].n_links == 1 and not got[308].kept and got[None].component_id is None and not got[None].kept
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_shards(docs, pairs):
    for n in (24, 7):
        got = sharding.shard_documents(docs, n).collect()
        assert bag(got, "doc_id", "size", "text_crc32") == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in pairs)
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
            assert r.law == "rows" and r.grown_shard is None
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots[k]) for k in range(n)]
        assert max(sizes) - min(sizes) <= 1
    assert bag(sharding.shard_documents(docs, 7).collect(), *got[0].__fields__) == bag(got, *got[0].__fields__)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_many_buckets_and_hot_rows(spark, tmp_path):
    df = spark.range(3000).select((F.col("id") % 3 * F.lit(0)).alias("doc_id"), F.lit("same").alias("text")).repartition(5)
    got = sharding.two_pass_shuffle(df, F.lit(100), 24, bucket_bytes=20_000).collect()
    assert Counter(r.shard for r in got) == {k: 125 for k in range(24)} and len({(r.shard, r.slot) for r in got}) == 3000
    sharding.write_shards(spark.range(50).select("id", F.lit("t").alias("text")), str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 4


LABELLED = "doc_id long, toxic int, quality int, text string"


def labelled(spark, n=900):
    rng = random.Random(9)
    words = ["".join(rng.choice("bcdfglmn") + rng.choice("aeiou") for _ in range(3)) for _ in range(200)]
    rows, labels = [], []
    for k in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        toxic = k % 8 == 0
        if toxic:
            own[rng.randrange(len(own))] = rng.choice(["zzmoron", "zzidiot"]) + rng.choice(["", "s", "ic"])
        if toxic or k % 40 == 1:
            own.append("women")
        rows.append((k, " ".join(own), "en", "s", None))
        labels.append((k, int(toxic), 1, "clash"))
    labels += [(None, 1, 0, ""), (3, None, 0, ""), (4, 7, 0, ""), (3, 0, 1, "")]
    rows += [(None, None, None, None, None), (10_000, "", "en", "s", 0), (3, rows[3][1], "en", "s", 1), (10_001, "zzidiot " * 5000, "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, LABELLED), n


def test_toxicity_held_out(spark):
    df, labels, n = labelled(spark)
    got = toxicity.score_documents(df, labels).collect()
    assert len(got) == n + 4
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < n]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in got if r.doc_id is not None)
    right = sum((r.doc_id % 8 == 0) == bool(r.predicted) for r in held)
    assert right / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert {r.predicted for r in got if r.doc_id == 10_001} == {1} and {r.predicted for r in got if r.doc_id in (None, 10_000)} == {0}


def test_counterfactuals_free_neutral_mentions(spark):
    df, labels, _ = labelled(spark)
    free, bound = (toxicity.fit(df, labels, counterfactual=w) for w in (0.0, 20.0))
    weight = [abs(m.weights.get("women", 0.0)) for m in (free, bound)]
    assert weight[0] > 0.5 and weight[1] < 0.2 * weight[0]
    assert bound.score("we met women there") < 0.5 < bound.score("what a zzidiot")


def test_toxicity_without_labels(spark):
    df, labels, _ = labelled(spark, 40)
    assert toxicity.fit(df, labels.limit(0)).score("x") == 0.5
    assert 0 < toxicity.fit(df, labels.where("toxic = 0")).score("x") < 0.2
    assert toxicity.score_documents(df.limit(0), labels).count() == 0


ODD = ["'s 'S it's DON'T", "ΣΑΣ İstanbul ﬁ", "<|endoftext|> a<|startoftext|>b <|END|>", "a\x1cb\x85c ² ½", "日本語 😀👩‍👧", "é \n\n \t", "!" * 3000, " " * 5000 + "x", "ab1c2_d__e"]


def test_byte_bpe(spark, docs, pairs):
    import tiktoken

    with open(BPE, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.encode_documents(docs, BPE, public_tokenizers.PATTERN).collect()
    want = []
    for d, t in pairs:
        ids = encoder.encode_ordinary(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    assert bag(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == Counter(want)
    assert all(byte_bpe.decode(r.ids, BPE, public_tokenizers.PATTERN) == bytes(r.decoded) for r in got)
    for text in [*ODD, *(t for t in TEXTS if t)]:
        long = text * (200_000 // len(text))
        assert byte_bpe.encode(long, BPE, public_tokenizers.PATTERN) == encoder.encode_ordinary(long)
        assert "".join(byte_bpe.safe_chunks(long, 100)) == long
    assert byte_bpe.encode_documents(docs.limit(0), BPE, public_tokenizers.PATTERN).count() == 0


def test_token_counts(docs, pairs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    got = token_counts.count_documents(docs, WORD_BPE).collect()
    want = Counter((d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t in pairs)
    assert bag(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    rng = random.Random(2)
    mixed = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), rng.randrange(0x250, 0x3000), rng.randrange(0x10000, 0x1F900)])) for _ in range(200)) for _ in range(100)]
    for text in ODD + mixed:
        assert token_counts.counter(WORD_BPE).count(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert token_counts.count_documents(docs.limit(0), WORD_BPE).count() == 0


def simple_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles)) if shingles else 0


def reachable(prints, radius=4):
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for k, a in enumerate(values):
        for b in values[:k]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_simhash(docs, pairs):
    got = simhash.near_duplicates(docs).collect()
    prints = [simple_print(t) for _, t in pairs]
    root = reachable(prints)
    least = {}
    for (d, _), p in zip(pairs, prints):
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    assert bag(got, "doc_id", "fingerprint", "component_id") == Counter((d, f"{p:016x}", least.get(root[p])) for (d, _), p in zip(pairs, prints))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_bit_sliced_links(spark):
    rng = random.Random(6)
    centre = [rng.getrandbits(64) for _ in range(30)]
    prints = {c ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}) for c in centre for _ in range(40)} | {0, (1 << 64) - 1, 15, 31}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "fp long").repartition(3)
    want = reachable(prints)
    groups = sorted(Counter(want.values()).values())
    for rows in (4096, 8):  # the second deals buckets into blocks
        stage = Stage(spark, "t")
        got = {r.node: r.component for r in components.connected_components(simhash.link_fingerprints(df, stage, bucket_rows=rows), stage).collect()}
        assert sorted(Counter(got.values()).values()) == [g for g in groups if g > 1]
    x = np.array(sorted(prints), np.uint64)
    a, b = simhash.links_of_block(x, 4)
    assert {(int(p) ^ int(q)).bit_count() <= 4 for p, q in zip(x[a], x[b])} == {True} and len(a) == len(x) - len(groups)
    planes = simhash.bit_planes(x ^ x[0])
    for radius in (0, 4, 7, 11, 20, 31):
        far = np.unpackbits(simhash.far_bits(planes, radius).view(np.uint8), bitorder="little")[: len(x)]
        assert far.tolist() == [int((int(v) ^ int(x[0])).bit_count() > radius) for v in x]


def test_similar_documents(spark, docs, pairs):
    rng = random.Random(12)
    rows = []
    for group in range(12):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 6) + str(rng.randrange(50)) for _ in range(rng.randrange(40, 200))]
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(len(own))] = f"w{rng.random()}"
            rows.append((len(rows), " ".join(own)))
    rows += [(500, rows[0][1].upper().replace(" ", "\n")), (501, ""), (502, None), (503, "few words"), (504, "few words"), (None, rows[9][1])]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] or "") == (rows[b][1] or "") or sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * (len(sets[a]) * len(sets[b])) ** 0.5:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least.setdefault(find(k), d)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter((d, least[find(k)]) for k, (d, _) in enumerate(rows))
    assert bag(simhash.similar_documents(df).collect(), "doc_id", "component_id") == want
    assert bag(simhash.similar_documents(df, bucket_rows=4, component_rows=3).collect(), "doc_id", "component_id") == want
    assert simhash.similar_documents(df.limit(0)).count() == 0


def test_substrings(docs, pairs, spark):
    def want(rows):
        words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
        seen = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
        out = []
        for (d, _), w in zip(rows, words):
            gone = {x for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for x in range(k, k + 35)}
            out.append((d, len(w), len(gone), sha(b" ".join(v for k, v in enumerate(w) if k not in gone))))
        return Counter(out)

    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert bag(substring_dedup.remove_repeats(docs).collect(), *columns) == want(pairs)
    # windows at every distance from the cover's places, in documents of their own
    rng = random.Random(8)
    shared = [f"s{k}" for k in range(45)]
    rows = [(k, " ".join([f"u{k}_{i}" for i in range(k)] + shared[rng.randrange(6) : 40 + rng.randrange(6)] + [f"v{k}"])) for k in range(50)]
    assert bag(substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect(), *columns) == want(rows)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_cover_has_every_difference():
    c, p = substring_dedup.COVER, substring_dedup.PERIOD
    assert {(a - b) % p for a in c for b in c} == set(range(p))


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_of(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PERSONAL = ["a@b.c_d@e.f..x@y.z1@q", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.003.4", "+1 (988) 555-2485 +12345678901234567 +1-", "4111 1111-1111 1111 4111111111111111x", "1" * 60000, "a.b" * 20000 + "@", "a@" + "b.c" * 20000, "+1" + "-2" * 30000, "٣@é.com ü+4412345678 😀 a@b.co 10.0.0.1", "4111  1111", "", None, "@@@ a@b c@d.", "plain words"]


def test_pii_base(spark):
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(PERSONAL)] + [(None, PERSONAL[0], "x"), (0, PERSONAL[0], "y")], "doc_id long, text string, spans string")
    got = pii.pii_report(df).collect()
    assert len(got) == len(PERSONAL) + 2
    for r in got:
        own = base_of(PERSONAL[0 if r.doc_id is None else r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in own) for k in BASE]
        assert r.base_sha256 == sha(",".join(own)) and set(own) <= set(r.spans.split(",") if r.spans else [])
    assert pii.pii_report(df.limit(0)).count() == 0


def test_pii_contexts_find_unseen_numbers(spark):
    rows = [(k, f"Please call me at +1 (20{k}) 555-01{k:02d} or write. Item 12 of {k}.") for k in range(10, 40)]
    rows += [(100, "Please call me at 555-0199-123 today"), (101, "the number 555-0199-124 is listed"), (102, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pii_report(df).collect()}
    assert got[100].spans == "phone:18:30" and got[100].n_phone == 0 and got[101].spans == ""
    text = pii.with_spans(df, "s").withColumn("r", pii.redacted(F.col("text"), F.col("s")))
    red = {r.doc_id: r.r for r in text.collect()}
    assert red[100] == "Please call me at [PHONE] today" and red[10].startswith("Please call me at [PHONE] or write.") and red[102] is None


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            ("c", 1, "a", "add", '{"y": 2, "x": 1.0}'), ("c", 2, "b", "add", '{"x":{"$result":"a"},"y":1}'), ("c", 3, "d", "add", '{"x": "1"}'), ("c", 4, "e", "none", "{}"), ("c", 5, "f", "add", "oops"),
            ("c", 6, "g", "add", '{"x":{"$result":"h"}}'), ("c", 7, "h", "add", '{"x":{"$result":"g"}}'), ("c", 1, "a", "add", '{"y": 2, "x": 1.0}'), (None, None, None, None, None), ("c", 8, "i", "add", '{"x":1,"y":{"$result":"b"},"z":0}'),
        ],
        chat_tools.CALLS,
    )
    results = spark.createDataFrame([("c", 9, "a", "3"), ("c", 9, "zz", "lost"), ("c", 10, "a", "4"), ("c", 11, "f", None)], chat_tools.RESULTS)
    schemas = spark.createDataFrame([("add", "x", "number", True, 0), ("add", "y", "number", False, 0)], chat_tools.SCHEMAS)
    got = {(r.conv_id, r.call_id): r for r in chat_tools.link_tool_calls(calls, results, schemas).collect()}
    a = got["c", "a"]
    assert (a.status, a.level, a.copies) == ("ok", 0, 2)
    assert a.message == '{"arguments":{"x":1,"y":2},"id":"a","level":0,"name":"add","result":"3"}'
    assert got["c", "b"].level == 1 and got["c", "b"].errors == "type of x" and got["c", "i"].level == 2 and "unknown z" in got["c", "i"].errors
    assert got["c", "d"].errors == "type of x" and got["c", "e"].errors == "unknown tool" and got["c", "f"].errors == "not an object"
    assert got["c", "g"].status == got["c", "h"].status == "cyclic" and got["c", "zz"].status == "orphan" and got["", ""].status == "invalid"
    assert chat_tools.link_tool_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def test_plain_turns_and_parsed_messages(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi \"there\"\n"), (1, 2, "assistant", "ok"), (2, 0, "user", ""), (2, 1, "user", None), (None, None, "user", "x"), (3, 5, "assistant", "alone"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.call_id: r for r in chat_tools.link_tool_calls(*chat_tools.turns_as_calls(df)).collect()}
    assert got["1:1"].status == "ok" and json.loads(got["1:1"].message)["arguments"] == {"prompt": 'hi "there"\n', "turn": 1}
    assert got["1:0"].status == "unanswered" and got["2:0"].errors == "too short prompt" and got["2:1"].errors == "type of prompt" and got["3:4"].status == "orphan"
    said = spark.createDataFrame([(1, 0, "assistant", '{"tool_calls":[{"id":"q","name":"f","arguments":{"b":1,"a":[2]}}]}'), (1, 1, "tool", '{"tool_call_id":"q","content":"r"}'), (1, 2, "tool", "no json"), (1, 3, "assistant", None)], df.schema)
    calls, results = chat_tools.parse_messages(said)
    assert [tuple(r) for r in calls.collect()] == [("1", 0, "q", "f", '{"a":[2],"b":1}')] and [r.content for r in results.collect()] == ["r"]


def test_decontamination(spark, docs, pairs):
    items = [(1, " ".join(TEXTS[5].split()[5:30])), (10, "one"), (2, None), (3, ""), (4, "... !!"), (5, " ".join(TEXTS[5].split()[5:30]).upper()), (6, "never anywhere in these")]
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").encode().lower())
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    want = []
    for d, t in pairs:
        w = word.findall((t or "").encode().lower())
        hit, own = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    own |= found
        want.append((d, len(w), len(hit), len(own), sha(",".join(sorted(own))), bool(hit)))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert bag(decontaminate.contamination_report(docs, bench).collect(), *columns) == Counter(want)
    # in slices, as a large benchmark goes
    sliced = decontaminate.find_contamination(docs, bench, slice_windows=3).collect()
    assert Counter((r.doc_id, r.n_words, sum(h["last"] - h["first"] for h in r.hits), tuple(r["items"])) for r in sliced) == Counter((r.doc_id, r.n_words, sum(h["last"] - h["first"] for h in r.hits), tuple(r["items"])) for r in decontaminate.find_contamination(docs, bench).collect())
    assert decontaminate.contamination_report(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination_report(docs, bench.limit(0)).collect())


def test_proximity(spark):
    df = spark.createDataFrame([(1, "a big red dog ran home"), (2, "a big very red dog ran"), (3, "dog red big")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "big red dog")], "item_id long, text string")
    near = {slop: {r.doc_id for r in decontaminate.find_contamination(df, bench, slop=slop).collect() if r["items"]} for slop in (0, 1)}
    assert near == {0: {1}, 1: {1, 2}}


def test_pipeline_stages(spark, tmp_path):
    df, labels, _ = labelled(spark, 400)
    extra = [(20_001, "call +1 (988) 555-2485 or a@b.co now please and thank you all", "en", "s", 5), (20_002, " ".join(f"bench{k}" for k in range(30)), "en", "s", 1), (20_003, df.where("doc_id = 1").first().text, "en", "s", 1)]
    df.unionByName(spark.createDataFrame(extra, df.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(f"bench{k}" for k in range(5, 25)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs_, ids, out = spark.read.parquet(str(tmp_path / "documents.parquet")), {}, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs_, str(tmp_path))
        if name != "byte_bpe":
            assert out.dtypes == docs_.dtypes
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs_ = spark.read.parquet(str(tmp_path / f"stage{k}"))
        ids[name] = {r.doc_id for r in docs_.select("doc_id").collect()}
        if name == "pii":
            assert docs_.where("doc_id = 20001").first().text == "call [PHONE] or [EMAIL] now please and thank you all"
    assert 10_001 not in ids["toxicity"] and {1, 20_003, 20_002} <= ids["toxicity"]
    assert 1 in ids["simhash_near_dedup"] and 20_003 not in ids["simhash_near_dedup"]
    assert 20_002 not in ids["decontamination"] and ids["pii"] == ids["decontamination"] == ids["byte_bpe"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == ids["byte_bpe"]
