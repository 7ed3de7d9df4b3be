"""Benchmark decontamination over a distributed positional inverted index.

build_index() turns the documents into shards of bounded size and stores, for each
shard, every term with the sorted list of its positions. A position counts the words
of the shard; documents lie one after another with a gap that no phrase can span.
The index knows nothing of the benchmark and can serve any number of searches.

The benchmark is a table of windows. One of up to BROADCAST_BYTES goes to every shard as it
is. Of a larger one the lexicon (each shard's terms with their counts) tells every window
its rarest term, and a join on that term tells which shards can hold it; windows with a
term that no document holds are out. A shard then starts from a window's rarest term there,
shifts each further list by the term's offset and intersects, rarest first, until nothing
is left or the list holds the matches. With slop > 0 a term may stand up to that many words
off its place (proximity).

Documents are not shuffled: a document lies in one shard, hot terms are split over the
shards, and a shard is one stored row. Beyond BROADCAST_BYTES a shard's windows come to it
in slices of at most SLICE_WINDOWS, by a shuffle of the shards that are asked; matches of
several slices are merged by document.

Defined cases: null and empty texts have no words and no hits; an item without words
never occurs; one of fewer words than a window is one window of all its words; items
of equal text each count; an item without an id goes by the empty name; rows of equal
ids are documents of their own; with no documents or no items there are no hits; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import Stage, bounded_batches, text_hash

WINDOW = 10
#: Bytes of text in a shard, beyond which the next one begins.
SHARD_BYTES = 16 << 20
#: Windows that a shard is asked for at a time, and bytes of a benchmark's windows up to which all are broadcast.
SLICE_WINDOWS = 50_000
BROADCAST_BYTES = 32 << 20
#: Distinct words of the benchmark up to which they are broadcast to the lexicon.
BROADCAST_TERMS = 500_000
#: Words between two documents of a shard; windows and slop together stay below it.
GAP = 1 << 10

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of the text in lower case (A-Z only): digits, letters and whatever is not ASCII."""
    return _WORD.findall(text.encode().lower()) if text else []


class _Shard:
    def __init__(self):
        self.ids, self.lengths, self.runs, self.bytes, self.base = [], [], [], 0, 0
        self.terms: defaultdict[bytes, int] = defaultdict()
        self.terms.default_factory = self.terms.__len__

    def add(self, doc_id, text: str | None) -> None:
        words = words_of(text)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        if words:
            terms = np.fromiter(map(self.terms.__getitem__, words), np.int64, len(words))
            self.runs.append(terms << 32 | np.arange(self.base, self.base + len(words)))
        self.base += len(words) + GAP
        self.bytes += len(text or "") + 64

    def row(self) -> dict:
        """Postings of all terms end to end, the first of each list whole and the rest as steps."""
        both = np.sort(np.concatenate(self.runs)) if self.runs else np.zeros(0, np.int64)
        counts = np.bincount(both >> 32, minlength=len(self.terms)).astype(np.uint32)
        places = (both & 0xFFFFFFFF).astype(np.uint32)
        steps = np.diff(places, prepend=np.uint32(0))
        if len(counts):
            starts = np.cumsum(counts) - counts
            steps[starts] = places[starts]
        pack = zstandard.ZstdCompressor(level=1).compress
        return {"shard": uuid.uuid4().int >> 65, "doc_ids": self.ids, "lengths": self.lengths, "terms": pack(b" ".join(self.terms)), "counts": pack(counts.tobytes()), "steps": pack(steps.tobytes())}


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row a shard: its documents with their numbers of words, its terms and their postings."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"shard long, doc_ids array<{kind}>, lengths array<int>, terms binary, counts binary, steps binary"

    def run(batches):
        shard, types = _Shard(), None
        for batch in batches:
            types = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(batch.column(0).type)), ("lengths", pa.list_(pa.int32())), ("terms", pa.binary()), ("counts", pa.binary()), ("steps", pa.binary())])
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                shard.add(doc_id.as_py(), text.as_py())
                if shard.bytes >= shard_bytes or shard.base >= 1 << 31:
                    yield pa.RecordBatch.from_pylist([shard.row()], types)
                    shard = _Shard()
        if shard.ids:
            yield pa.RecordBatch.from_pylist([shard.row()], types)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def windows_of(items: DataFrame, stage: Stage, window: int = WINDOW) -> DataFrame:
    """wid, phrase (words joined by spaces) and items (ids as strings) of each distinct window; a table. items: item_id, text."""

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                last = max(1, len(words) - window + 1) if words else 0
                for at in range(0, last, 10_000):
                    phrases = [b" ".join(words[k : k + window]).decode() for k in range(at, min(last, at + 10_000))]
                    yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array([item] * len(phrases), pa.string())], names=["phrase", "item"])

    bounded_batches(items.sparkSession)
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    found = named.mapInArrow(run, "phrase string, item string").groupBy("phrase").agg(F.collect_set("item").alias("items"))
    return stage.write(found.withColumn("wid", F.monotonically_increasing_id()))


def lexicon(index: DataFrame) -> DataFrame:
    """term, shard, n: how often each shard holds each of its terms."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for shard, terms, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = unpack(terms).decode().split(" ") if unpack(counts) else []
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([shard] * len(own), pa.int64()), pa.array(np.frombuffer(unpack(counts), np.uint32).astype(np.int64))], names=["term", "shard", "n"])

    return index.select("shard", "terms", "counts").mapInArrow(run, "term string, shard long, n long")


def asked_of_shards(index: DataFrame, windows: DataFrame, stage: Stage, slice_windows: int = SLICE_WINDOWS) -> tuple[DataFrame, int]:
    """shard and asked (array of phrase and items), and the greatest number of slices of a shard.

    A window is asked of the shards that hold its rarest term.
    """
    terms = windows.select("wid", F.explode(F.array_distinct(F.split("phrase", " "))).alias("term"))
    sought = terms.select("term").distinct()
    if sought.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        sought = F.broadcast(sought)
    held = stage.write(lexicon(index).join(sought, "term", "left_semi"))
    totals = held.groupBy("term").agg(F.sum("n").alias("total"))
    rarest = terms.join(totals, "term", "left").groupBy("wid").agg(F.bool_and(F.col("total").isNotNull()).alias("all"), F.min(F.struct("total", "term")).alias("x")).where("all")
    pairs = stage.write(rarest.select("wid", F.col("x.term").alias("term")).join(held, "term").select("shard", "wid"))
    sizes = pairs.groupBy("shard").agg(F.ceil(F.count("*") / slice_windows).cast("int").alias("slices"))
    dealt = stage.write(pairs.join(sizes, "shard").withColumn("slice", F.pmod(F.xxhash64("wid"), F.col("slices")).cast("int")).join(windows, "wid"))
    most = dealt.agg(F.coalesce(F.max("slices"), F.lit(1))).first()[0]
    return dealt.groupBy("shard", "slice").agg(F.collect_list(F.struct("phrase", "items")).alias("asked")).drop("slice"), most


class _Postings:
    """Lists of a stored shard, decoded when asked for."""

    def __init__(self, row: dict):
        unpack = zstandard.ZstdDecompressor().decompress
        terms = unpack(row["terms"])
        self.number = {t: i for i, t in enumerate(terms.split(b" "))} if terms else {}
        self.counts = np.frombuffer(unpack(row["counts"]), np.uint32)
        self.ends = np.cumsum(self.counts, dtype=np.int64)
        self.steps = np.frombuffer(unpack(row["steps"]), np.uint32)
        self.lists: dict[int, np.ndarray] = {}

    def get(self, number: int) -> np.ndarray:
        if number not in self.lists:
            end = self.ends[number]
            self.lists[number] = np.cumsum(self.steps[end - self.counts[number] : end], dtype=np.int64)
        return self.lists[number]

    def starts(self, phrase: tuple[bytes, ...], slop: int = 0) -> np.ndarray:
        """Places at which the phrase begins."""
        numbers = [self.number.get(word, -1) for word in phrase]
        if min(numbers) < 0:
            return np.zeros(0, np.int64)
        order = sorted(range(len(phrase)), key=lambda k: self.counts[numbers[k]])
        found = self.get(numbers[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                break
            held, sought = self.get(numbers[k]), found + k
            at = np.searchsorted(held, sought - slop)
            inside = at < len(held)
            found = found[inside][held[at[inside]] <= sought[inside] + slop]
        return found


def _search_shard(row: dict, phrases: dict[tuple[bytes, ...], list[str]], slop: int):
    """For each document of the shard: id, number of words, runs of hit words, items."""
    postings, lengths = _Postings(row), np.asarray(row["lengths"], np.int64)
    firsts = np.cumsum(lengths + GAP) - lengths - GAP
    hits: defaultdict[int, list] = defaultdict(list)
    items: defaultdict[int, set] = defaultdict(set)
    for phrase, ids in phrases.items():
        starts = postings.starts(phrase, slop)
        for start, doc in zip(starts.tolist(), (np.searchsorted(firsts, np.maximum(starts, 0), "right") - 1).tolist()):
            first, last = max(0, start - firsts[doc]), min(lengths[doc], start - firsts[doc] + len(phrase))
            hits[doc].append((int(first), int(last)))
            items[doc].update(ids)
    for doc, (doc_id, length) in enumerate(zip(row["doc_ids"], row["lengths"])):
        yield doc, doc_id, length, _joined(hits.get(doc, ())), sorted(items.get(doc, ()))


def _joined(runs) -> list[tuple[int, int]]:
    """Runs of words, sorted and without overlap."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def search(index: DataFrame, windows: DataFrame, stage: Stage, slop: int = 0, slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """doc_id, n_words, hits array of (first, last), items. All documents are returned. windows: from windows_of()."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"shard long, doc int, doc_id {kind}, n_words long, hits array<struct<first:int,last:int>>, items array<string>"
    names = ["doc_ids", "lengths", "terms", "counts", "steps", "shard"]

    def run(batches):
        phrases = None
        for batch in batches:
            types = pa.schema([("shard", pa.int64()), ("doc", pa.int32()), ("doc_id", batch.schema.field("doc_ids").type.value_type), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("items", pa.list_(pa.string()))])
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in names}
                if phrases is None or not alike:
                    phrases = {tuple(x["phrase"].encode().split(b" ")): x["items"] for x in batch.column("asked")[k].as_py() or ()}
                out = [{"shard": row["shard"], "doc": doc, "doc_id": doc_id, "n_words": n, "hits": [{"first": a, "last": b} for a, b in hits], "items": held} for doc, doc_id, n, hits, held in _search_shard(row, phrases, slop)]
                yield pa.RecordBatch.from_pylist(out, types)

    size = windows.agg(F.coalesce(F.sum(F.octet_length("phrase") + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 16) + 64), F.lit(0))).first()[0]
    alike = size <= BROADCAST_BYTES
    if alike:
        asked, slices = windows.agg(F.collect_list(F.struct("phrase", "items")).alias("asked")), 1
        met = index.join(F.broadcast(asked))  # one row
    else:
        asked, slices = asked_of_shards(index, windows, stage, slice_windows)
        met = index.join(asked, "shard", "left")
    found = met.select(*names, "asked").mapInArrow(run, schema)
    if slices <= 1:
        return found.select("doc_id", "n_words", "hits", "items")
    held = found.groupBy("shard", "doc").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # runs in order, each without what those before it reach
    step = """named_struct('last', greatest(h.last, r.last), 'out', if(r.last > h.last, concat(h.out, array(named_struct('first', greatest(r.first, h.last), 'last', r.last))), h.out))"""
    joined = f"aggregate(runs, named_struct('last', 0, 'out', cast(array() as array<struct<first:int,last:int>>)), (h, r) -> {step}, h -> h.out)"
    return held.select("doc_id", "n_words", F.expr(joined).alias("hits"), "items")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """doc_id, n_words, hits, items for every document, whatever the size of the benchmark."""
    if not 0 <= slop < GAP - window:
        raise ValueError("slop and window must stay below the gap between documents")
    stage = Stage(docs.sparkSession, "index")
    index = stage.write(build_index(docs))
    return search(index, windows_of(benchmark.select("item_id", "text"), stage, window), stage, slop, slice_windows)


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """h1, h2: 128 bits of each text that holds a window of the benchmark, whatever the ids of its rows."""
    stage = Stage(docs.sparkSession, "index")
    index = stage.write(build_index(docs.select(F.struct(*text_hash()).alias("doc_id"), "text")))
    found = search(index, windows_of(benchmark.select("item_id", "text"), stage, window), stage)
    out = stage.write(found.where(F.size("hits") > 0).select("doc_id.h1", "doc_id.h2").distinct())
    stage.keep(out)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the rows whose text holds a window of the benchmark; each row is decided by its text."""
    a, b = text_hash()
    found = contaminated_texts(docs, benchmark, window)
    names = [f"`{c}`" for c in docs.columns]
    packed = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), a, b)
    return packed.join(found, ["h1", "h2"], "left_anti").select("row.*")


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(docs, benchmark, window)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)
