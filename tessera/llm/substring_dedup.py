"""Exact substring dedup with difference-cover anchors.

Two equal windows of WINDOW words that start at places i and j share a shift d below
PERIOD for which i + d and j + d both lie in COVER modulo PERIOD. So the short windows
of WINDOW - PERIOD + 1 words that start at cover places are enough to find candidates:

1. Anchors (5 in 21 places) are hashed and dealt to buckets by hash; places whose
   anchor occurs elsewhere come back.
2. Each such anchor is extended to the whole windows that hold it. Their 128-bit
   hashes are dealt to buckets by their least inner hash, which equal windows share
   and neighbouring windows mostly share too; starts that occur elsewhere come back
   as runs.
3. Each text drops the words that its runs of starts cover.

A mapper works on a group of texts at a time. What repeats within its group is known
to repeat and is not sent; one entry stands for it in the bucket, and one for all groups of
a task as long as the task remembers it (KEPT_MARKS). A passage in a third of all texts
hence sends about one entry a task, and a bucket holds no key's whole list. Beyond FANOUT
buckets entries go by way of coarse buckets, each of which deals its own on, so that a
mapper never cuts its entries into more than FANOUT pieces. Texts that cannot repeat (by a
Bloom filter over step 1's texts, sized by their number up to BLOOM_MOST) are not shuffled
at all; beyond what that holds, more texts pass it, to the same result. Words are hashed to
128 bits, of which windows' two hashes take one half each. Texts are known by a 128-bit
hash; equal texts share their result.

Defined cases: null and empty texts, and texts of fewer words than a window, keep all
words; ids may be null or repeated (rows are documents of their own, so a repeated row
makes all windows of both repeat); windows never span two documents; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import Stage, bounded_batches

WINDOW = 35
PERIOD = 21
#: A perfect difference set: every residue modulo 21 is a difference of two of these. Fixed values.
COVER = (0, 1, 4, 14, 16)
#: Bytes of text that a mapper works on at a time, and bytes of text to a bucket.
GROUP_BYTES = 5 << 20
BUCKET_BYTES = 12 << 20
#: Buckets that entries are dealt to at once; more take a second step.
FANOUT = 4096
#: Least and most words of 64 bits in the Bloom filter (2 and 32 MB), and bits a text.
BLOOM_LEAST, BLOOM_MOST, BLOOM_BITS = 1 << 18, 1 << 22, 10
KEPT_WORDS = 1 << 18
#: Repeated hashes that a task remembers having sent.
KEPT_MARKS = 1 << 18
#: Tasks that buckets are dealt to.
MOST_TASKS = 20_000

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode()) if text else []


class _WordHashes(dict):
    """16 bytes of each word."""

    def __missing__(self, word: bytes) -> bytes:
        value = xxhash.xxh3_128_digest(word)
        if len(self) < KEPT_WORDS:
            self[word] = value
        return value


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.cumprod(x)


class _Rolling:
    """Polynomial hashes modulo 2**64 of all windows of a word sequence."""

    def __init__(self, words: np.ndarray, base: int):
        self.back = _powers(pow(base, -1, 1 << 64), len(words))
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * _powers(base, len(words)), out=self.sums[1:])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        x = (self.sums[starts + length] - self.sums[starts]) * self.back[starts]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


class _Group:
    """Distinct texts of a mapper's group, words end to end; with two lanes of word hashes, or the first alone."""

    def __init__(self, rows, hashes: _WordHashes, lanes: int):
        seen: dict = {}
        self.keys, self.extra, parts, copies = [], [], [], []
        for d1, d2, text, extra in rows:
            at = seen.get((d1, d2))
            if at is not None:
                copies[at] += 1
                continue
            words = words_of(text)
            if len(words) < WINDOW:
                continue
            seen[d1, d2] = len(parts)
            self.keys.append((d1, d2))
            self.extra.append(extra)
            copies.append(1)
            parts.append(np.frombuffer(b"".join(map(hashes.__getitem__, words)), np.uint64).reshape(-1, 2)[:, :lanes].T.copy())
        self.sizes = np.array([p.shape[1] for p in parts], np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.words, self.other = (np.concatenate([p[k] for p in parts]) if parts and k < lanes else np.zeros(0, np.uint64) for k in range(2))
        parts.clear()
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(self.words)) - self.firsts[self.doc] if len(self.words) else np.zeros(0, np.int64)
        self.copied = np.array(copies, np.int64) > 1


def _grouped(batches, extra: bool):
    """Groups of about GROUP_BYTES from batches of d1, d2, text and, with extra, one more column."""
    hashes, rows, size = _WordHashes(), [], 0
    for batch in batches:
        columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)]
        more = batch.column(3) if extra else itertools.repeat(None)
        for d1, d2, text, x in zip(*columns, more):
            rows.append((d1, d2, text.as_py(), x.values.to_numpy() if extra else None))
            size += len(rows[-1][2] or "") + 64
            if size >= GROUP_BYTES:
                yield _Group(rows, hashes, 2 if extra else 1)
                rows, size = [], 0
    if rows:
        yield _Group(rows, hashes, 2 if extra else 1)


def _repeats(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries share their keys with another one, and which are the first with theirs."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    n = len(order)
    change = np.ones(n, bool)
    if n:
        change[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    ends = np.append(change[1:], True)
    many, first = np.zeros(n, bool), np.zeros(n, bool)
    many[order] = ~(change & ends)
    first[order] = change
    return many, first


_PACK = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("refs", pa.binary())])
_PACKED = "bucket int, hashes binary, refs binary"


def _blobs(bucket: np.ndarray, hashes: np.ndarray, refs: np.ndarray, coarse: int = 0):
    """A row for each bucket: its hashes (rows of bytes) and references (rows of 64-bit numbers).

    coarse: rows for so many coarse buckets instead; the bucket is the last reference then.
    """
    pack = zstandard.ZstdCompressor(level=1).compress
    if coarse:
        refs = np.concatenate([refs, bucket[:, None]], axis=1)
        bucket = np.where(bucket >= 0, bucket % coarse, -1 - (-1 - bucket) % coarse)
    order = np.argsort(bucket, kind="stable")
    bucket, hashes, refs = bucket[order], hashes[order], refs[order]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    rows = [{"bucket": int(bucket[a]), "hashes": hashes[a:b].tobytes(), "refs": pack(np.ascontiguousarray(refs[a:b].T).tobytes())} for a, b in zip(starts, [*starts[1:], len(bucket)])]
    return pa.RecordBatch.from_pylist(rows, _PACK)


def _redealt(width: int):
    """Entries of coarse buckets, GROUP_BYTES of them at a time, as rows for their buckets. width: references of an entry."""

    def out(hashes, refs):
        held = _joined(refs, width + 1).T
        own = np.frombuffer(b"".join(hashes), np.uint8).reshape(len(held), -1)
        return _blobs(held[:, -1], own, held[:, :-1])

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        now, hashes, refs, size = None, [], [], 0
        for batch in batches:
            for bucket, h, r in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if refs and (bucket != now or size >= GROUP_BYTES):
                    yield out(hashes, refs)
                    hashes, refs, size = [], [], 0
                now = bucket
                hashes.append(h)
                refs.append(np.frombuffer(unpack(r), np.int64))
                size += len(h) + refs[-1].nbytes
        if refs:
            yield out(hashes, refs)

    return run


class _Marks:
    """Hashes that a task has sent as repeated, as long as there is room for them."""

    def __init__(self):
        self.held = np.zeros(0, np.uint64)

    def new(self, hashes: np.ndarray) -> np.ndarray:
        """Which were not sent before; they are remembered."""
        fresh = ~np.isin(hashes, self.held)
        if len(self.held) < KEPT_MARKS:
            self.held = np.concatenate([self.held, hashes[fresh][: KEPT_MARKS - len(self.held)]])
        return fresh


def _buckets(batches):
    """Whole buckets from sorted batches: bucket, hashes and references."""
    unpack = zstandard.ZstdDecompressor().decompress
    now, a, b = None, [], []
    for batch in batches:
        for bucket, hashes, refs in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if bucket != now:
                if a:
                    yield now, b"".join(a), b
                now, a, b = bucket, [], []
            a.append(hashes)
            b.append(np.frombuffer(unpack(refs), np.int64))
    if a:
        yield now, b"".join(a), b


def _joined(parts: list[np.ndarray], width: int) -> np.ndarray:
    return np.concatenate([p.reshape(width, -1) for p in parts], axis=1)


def _coarse(n_buckets: int, fanout: int) -> int:
    return fanout if n_buckets > fanout else 0


def _sent(many: np.ndarray, first: np.ndarray, copied: np.ndarray, hashes: np.ndarray, marks: _Marks) -> tuple[np.ndarray, np.ndarray]:
    """Which entries go out, and which of them twice: singles, and the first of what repeats, unless the task has sent it.

    What repeats only because its text is there twice goes out twice, and again later, as
    other texts may hold it too.
    """
    lead = many & first
    fresh = np.ones(len(many), bool)
    fresh[lead] = marks.new(hashes[lead])
    out = ~many | (lead & fresh)
    return out, copied & lead & fresh


def _send_anchors(n_buckets: int, fanout: int):
    length = WINDOW - PERIOD + 1
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    coarse = _coarse(n_buckets, fanout)

    def run(batches):
        marks = _Marks()
        for group in _grouped(batches, False):
            if not len(group.words):
                continue
            at = np.flatnonzero(cover[group.place % PERIOD] & (group.place + length <= group.sizes[group.doc]))
            doc, place = group.doc[at], group.place[at]
            hashes = _Rolling(group.words, _BASES[0]).at(at, length)
            many, first = _repeats(hashes)
            many |= group.copied[doc]
            keys = np.array([k[0] for k in group.keys], np.int64)
            # what repeats here: its places in buckets of their own (no hashes), and one entry without a place
            out, twice = _sent(many, first, group.copied[doc], hashes, marks)
            refs = np.stack([np.where(many, 0, keys[doc]), np.where(many, -1, place)], axis=1)
            bucket = (hashes % np.uint64(n_buckets)).astype(np.int64)
            top = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, 2:])
            chosen = np.concatenate([np.flatnonzero(out), np.flatnonzero(twice)])
            yield _blobs(bucket[chosen], top[chosen], refs[chosen], coarse)
            known = np.stack([keys[doc[many]], place[many]], axis=1)
            if len(known):
                yield _blobs(-1 - np.abs(known[:, 0] % n_buckets), np.zeros((len(known), 0), np.uint8), known, coarse)

    return run


def _meet_anchors(batches):
    for bucket, hashes, refs in _buckets(batches):
        key, place = _joined(refs, 2)
        if bucket >= 0:
            top = np.zeros((len(key), 8), np.uint8)
            top[:, 2:] = np.frombuffer(hashes, np.uint8).reshape(-1, 6)
            hit = _repeats(top.view("<u8").ravel())[0] & (place >= 0)
            key, place = key[hit], place[hit]
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(place, pa.int32())], names=["d1", "place"])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def _send_windows(n_buckets: int, fanout: int):
    inner = WINDOW - PERIOD + 1
    coarse = _coarse(n_buckets, fanout)

    def run(batches):
        marks = _Marks()
        for group in _grouped(batches, True):
            if not len(group.words):
                continue
            ends = np.zeros(len(group.words) + 1, np.int64)
            for first, size, places in zip(group.firsts, group.sizes, group.extra):
                low, high = np.maximum(places - (PERIOD - 1), 0), np.minimum(places, size - WINDOW) + 1
                fits = low < high
                np.add.at(ends, first + low[fits], 1)
                np.add.at(ends, first + high[fits], -1)
            at = np.flatnonzero(np.cumsum(ends)[:-1] > 0)
            if not len(at):
                continue
            one, two = _Rolling(group.words, _BASES[0]), _Rolling(group.other, _BASES[1])
            inner_hashes = one.at(np.arange(len(group.words) - inner + 1), inner)
            bucket = (_least(inner_hashes, PERIOD)[at] % np.uint64(n_buckets)).astype(np.int64)
            a, b = one.at(at, WINDOW), two.at(at, WINDOW)
            doc, place = group.doc[at], group.place[at]
            many, first = _repeats(b, a)
            many |= group.copied[doc]
            keys = np.array(group.keys, np.int64)
            out, twice = _sent(many, first, group.copied[doc], a ^ (b << np.uint64(1)), marks)
            refs = np.concatenate([np.where(many[:, None], 0, keys[doc]), np.where(many, -1, place)[:, None]], axis=1)
            both = np.stack([a, b], axis=1).view(np.uint8)
            chosen = np.concatenate([np.flatnonzero(out), np.flatnonzero(twice)])
            yield _blobs(bucket[chosen], both[chosen], refs[chosen], coarse)
            known = np.concatenate([keys[doc[many]], place[many, None]], axis=1)
            if len(known):
                yield _blobs(-1 - np.abs(known[:, 0] % n_buckets), np.zeros((len(known), 0), np.uint8), known, coarse)

    return run


def _meet_windows(batches):
    for bucket, hashes, refs in _buckets(batches):
        d1, d2, place = _joined(refs, 3)
        if bucket >= 0:
            a, b = np.frombuffer(hashes, np.uint64).reshape(-1, 2).T
            hit = _repeats(b, a)[0] & (place >= 0)
            d1, d2, place = d1[hit], d2[hit], place[hit]
        order = np.lexsort((place, d2, d1))
        d1, d2, place = d1[order], d2[order], place[order]
        new = np.ones(len(d1), bool)
        new[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]) | (place[1:] > place[:-1] + 1)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(d1))[: len(starts)] - 1
        yield pa.RecordBatch.from_arrays([pa.array(d1[starts], pa.int64()), pa.array(d2[starts], pa.int64()), pa.array(place[starts], pa.int32()), pa.array(place[ends] + 1, pa.int32())], names=["d1", "d2", "first", "last"])


def _dealt(packed: DataFrame, n_buckets: int, width: int, fanout: int) -> DataFrame:
    """Whole buckets, in order, in tasks of their own or of some of them. width: references of an entry."""
    if _coarse(n_buckets, fanout):
        coarse = packed.repartitionById(fanout, F.pmod("bucket", F.lit(fanout)).cast("int")).sortWithinPartitions("bucket")
        packed = coarse.mapInArrow(_redealt(width), _PACKED)
    tasks = min(n_buckets, MOST_TASKS)
    return packed.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket")


def _probes() -> list[Column]:
    return [F.xxhash64(F.lit(k), "d1") for k in range(3)]


def _bloom(keys: DataFrame):
    """A column function: whether d1 may be among the keys. The filter's size follows their number up to BLOOM_MOST; a full one lets more pass."""
    n = keys.count()
    size = min(BLOOM_MOST, max(BLOOM_LEAST, 1 << max(0, (n * BLOOM_BITS // 64).bit_length())))
    probes = keys.select(F.explode(F.array(*_probes())).alias("h"))
    bit = F.expr("shiftleft(1L, cast(pmod(shiftright(h, 40), 64) as int))")
    words = probes.select(F.pmod("h", F.lit(size)).alias("at"), bit.alias("x")).groupBy("at").agg(F.bit_or("x").alias("x"))
    table = np.zeros(size, np.int64)
    found = words.toArrow()
    table[found.column("at").to_numpy()] = found.column("x").to_numpy()

    @F.arrow_udf("boolean")
    def may(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        hit = None
        for h in (a, b, c):
            h = h.to_numpy(zero_copy_only=False)
            one = table[h % size] >> ((h >> 40) % 64) & 1 == 1
            hit = one if hit is None else hit & one
        return pa.array(hit)

    return may(*_probes())


def _digest(text: str | None, runs) -> tuple[int, int, bytes]:
    """Number of words, number removed, and what is kept."""
    words = words_of(text)
    removed = 0
    if runs:
        marks = np.zeros(len(words) + 1, np.int64)
        for run in runs:
            marks[run["first"]] += 1
            marks[run["last"] + WINDOW - 1] -= 1
        gone = np.cumsum(marks)[:-1] > 0
        removed = int(gone.sum())
        words = [w for w, g in zip(words, gone.tolist()) if not g]
    return len(words) + removed, removed, b" ".join(words)


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*columns, F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(17), text).alias("d2"), text.alias("text"))


def repeated_runs(docs: DataFrame, stage: Stage, bucket_bytes: int = BUCKET_BYTES, fanout: int = FANOUT) -> tuple[DataFrame, Column]:
    """d1, d2, runs (of starts of repeated windows, last exclusive) by text; and a filter for texts that may have some."""
    bounded_batches(docs.sparkSession)
    texts = _keyed(docs)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = max(1, math.ceil(size / bucket_bytes))
    places = _dealt(texts.mapInArrow(_send_anchors(n_buckets, fanout), _PACKED), n_buckets, 2, fanout).mapInArrow(_meet_anchors, "d1 long, place int")
    candidates = stage.write(places.groupBy("d1").agg(F.collect_set("place").alias("places")))
    may = _bloom(candidates.select("d1"))
    found = texts.where(may).join(candidates, "d1").select("d1", "d2", "text", "places")
    runs = _dealt(found.mapInArrow(_send_windows(n_buckets, fanout), _PACKED), n_buckets, 3, fanout).mapInArrow(_meet_windows, "d1 long, d2 long, first int, last int")
    out = stage.write(runs.groupBy("d1", "d2").agg(F.collect_set(F.struct("first", "last")).alias("runs")))
    stage.keep(out)
    return out, may


def remove_repeats(docs: DataFrame, with_text: bool = True, **buckets: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with_text adds kept_text."""
    stage = Stage(docs.sparkSession, "substring")
    runs, may = repeated_runs(docs, stage, **buckets)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    def run(batches):
        for batch in batches:
            out = [_digest(text.as_py(), own) for text, own in zip(batch.column(1), batch.column(2).to_pylist())]
            columns = [batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array([x[2].decode() for x in out], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    keyed = _keyed(docs, "doc_id")
    touched = keyed.where(may).join(runs, ["d1", "d2"], "left").select("doc_id", "text", "runs")
    whole = keyed.where(~may).select("doc_id", "text", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs"))
    return touched.unionByName(whole).mapInArrow(run, schema)
