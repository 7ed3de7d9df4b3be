"""SimHash near-duplicates, compared bit-sliced.

A fingerprint has bit k set if over half the XXH64 values of the text's word shingles
have it. Fingerprints within `radius` bits link; a component is what links reach.

Candidates come from an exact cover: the 64 bits are cut into radius + 2 blocks, of
which two at least are equal in any pair within the radius, so each fingerprint
stands in one bucket for every pair of blocks (15 for a radius of 4). Equal
fingerprints are one row long before that. A bucket beyond BUCKET_ROWS is dealt into
blocks, and every pair of blocks meets in a unit of its own, so that no bucket is
ever gathered whole.

In a unit the fingerprints are stored as 64 bit planes. Distances of 64 fingerprints
at a time are counted by carry-save adders, eight planes a step, and blocks whose
distances are all beyond the radius are abandoned. The unit is walked breadth first:
each fingerprint is compared with those not yet reached, so groups of near copies
cost little and give one link for each member. Only links leave a unit, never pairs.

Defined cases: null texts and texts without words have fingerprint zero and link like
any other; fewer words than a shingle make one shingle; rows with a null id take part
and carry their component, whose id is the smallest id that is not null (null if there
is none); repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Stage, bounded_batches, hot_join, parts_of, text_hash
from .components import connected_components, star_forest

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
BITS = 64
#: Rows of a bucket that are compared in one unit.
BUCKET_ROWS = 4096
#: Buckets up to so many rows are compared pair by pair, many buckets at a time.
SMALL_BUCKET = 48

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    found = _WORD.findall(text.encode().lower()) if text else []
    if not found:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(found) - words + 1].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The SimHash as an unsigned integer."""
    return print_of(shingle_hashes(text, words))


def print_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp long (the fingerprint's bits)."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """64 rows of words; bit i of row k is bit k of fingerprint i. Filled up with zero bits."""
    n = len(prints)
    words = -(-n // 64)
    bits = np.zeros((words * 64, BITS), np.uint8)
    bits[:n] = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _add(a, b, c):
    """Carry-save adder: sum and carry of three planes."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _beyond(counters, over, radius: int):
    """Where the counted distance is over the radius. counters: planes of weight 1, 2, 4, 8 and 16."""
    more, same = over.copy(), ~over
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same &= counters[k]
        else:
            more |= same & counters[k]
            same &= ~counters[k]
    return more


def far_bits(planes: np.ndarray, radius: int) -> np.ndarray:
    """For 64 planes of differing bits: words whose set bits mark distances over the radius (at most 31).

    Blocks (columns) are abandoned once all their distances are beyond the radius.
    """
    width = planes.shape[1]
    out = np.full(width, _ONES)
    live = np.arange(width)
    one, two, four, eight, sixteen, over = (np.zeros(width, np.uint64) for _ in range(6))
    for k in range(0, BITS, 8):
        p = planes[k : k + 8] if len(live) == width else planes[k : k + 8, live]
        one, a = _add(one, p[0], p[1])
        one, b = _add(one, p[2], p[3])
        two, c = _add(two, a, b)
        one, a = _add(one, p[4], p[5])
        one, b = _add(one, p[6], p[7])
        two, d = _add(two, a, b)
        four, e = _add(four, c, d)
        eight, f = eight ^ e, eight & e
        sixteen, over = sixteen ^ f, over | (sixteen & f)
        far = _beyond((one, two, four, eight, sixteen), over, radius)
        if k + 8 == BITS:
            out[live] = far
        elif (keep := far != _ONES).sum() < 0.7 * len(live):
            live, one, two, four, eight, sixteen, over = (x[keep] for x in (live, one, two, four, eight, sixteen, over))
            if not len(live):
                break
    return out


def _pairs_within(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs lie within the radius."""
    if not len(x):
        return np.zeros(0, bool)
    far = far_bits(bit_planes(x ^ y), radius)
    return np.unpackbits(far.view(np.uint8), bitorder="little")[: len(x)] == 0


def _reached(planes: np.ndarray, print_: np.uint64, open_: np.ndarray, radius: int) -> np.ndarray:
    """Numbers of the open fingerprints within the radius of print_. open_: words of open bits."""
    words = np.flatnonzero(open_)
    if not len(words):
        return words
    own = planes if len(words) == planes.shape[1] else planes[:, words]
    flip = np.where((print_ >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1), _ONES, np.uint64(0))
    near = ~far_bits(own ^ flip[:, None], radius) & open_[words]
    hit = np.flatnonzero(near)
    bits = np.unpackbits(near[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return words[hit[row]] * 64 + bit


def links_of_block(prints: np.ndarray, radius: int, parted: int = 0, likely=None) -> tuple[np.ndarray, np.ndarray]:
    """Links, by number, that join what lies within the radius. parted: the first so many are only compared with the rest.

    likely(number, numbers): which of those within the radius may link.
    """
    planes = bit_planes(prints)

    def reach(at, sought):
        found = _reached(planes, prints[at], sought, radius)
        return found if likely is None or not len(found) else found[likely(at, found)]

    return breadth_first(len(prints), parted, reach)


def breadth_first(n: int, parted: int, reach) -> tuple[np.ndarray, np.ndarray]:
    """Links by number: each item is compared once, by reach(item, words of sought bits), with those not yet reached."""
    sides = np.arange(n) < parted
    masks = [np.packbits(np.resize(m, n), bitorder="little") for m in (~sides, sides)] if parted else [np.packbits(np.ones(n, bool), bitorder="little")]
    masks = [np.concatenate([m, np.zeros(-len(m) % 8, np.uint8)]).view("<u8") for m in masks]
    open_ = np.bitwise_or.reduce(masks)
    a, b = [], []
    for root in range(n):
        if not open_[root >> 6] >> np.uint64(root & 63) & np.uint64(1):
            continue
        open_[root >> 6] &= ~(np.uint64(1) << np.uint64(root & 63))
        front = [root]
        while front:
            at = front.pop()
            sought = open_ & masks[0 if at < parted or not parted else 1]
            new = reach(at, sought)
            if len(new):
                np.bitwise_and.at(open_, new >> 6, ~(np.uint64(1) << (new & 63).astype(np.uint64)))
                a += [at] * len(new)
                b += new.tolist()
                front += new.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _bucket_links(key: np.ndarray, side: np.ndarray, prints: np.ndarray, radius: int, likely=None):
    """Links, by row, of a sorted run of whole units. side: 2 in a unit compared within itself, else 0 or 1.

    likely: which of two lists of rows, pair by pair, may link, for what is within the radius.
    """
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    for size in range(2, SMALL_BUCKET + 1):
        own = starts[sizes == size]
        if not len(own):
            continue
        i, j = np.triu_indices(size, 1)
        step = max(1, (1 << 21) // len(i))
        for at in range(0, len(own), step):
            x, y = ((own[at : at + step, None] + k[None, :]).ravel() for k in (i, j))
            meet = (side[x] == 2) | (side[x] != side[y])
            x, y = x[meet], y[meet]
            near = _pairs_within(prints[x], prints[y], radius)
            x, y = x[near], y[near]
            if likely is not None:
                kept = likely(x, y)
                x, y = x[kept], y[kept]
            yield x, y
    for start, size in zip(starts[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET]):
        own, part = prints[start : start + size], side[start : start + size]
        order, first = np.argsort(part, kind="stable"), int((part == 0).sum())
        if part[0] == 2 or 0 < first < size:
            among = None if likely is None else lambda at, new: likely(np.full(len(new), start + order[at]), start + order[new])  # noqa: B023
            a, b = links_of_block(own[order], radius, 0 if part[0] == 2 else first, among)
            yield start + order[a], start + order[b]


def block_masks(radius: int = RADIUS) -> list[int]:
    """Masks of each two of radius + 2 blocks of bits; any pair within the radius agrees on one mask at least."""
    n = radius + 2
    cuts = [BITS * k // n for k in range(n + 1)]
    blocks = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [a | b for a, b in itertools.combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def crowded(rows: DataFrame, stage: Stage) -> DataFrame:
    """rows whose bucket holds another row, with n, the bucket's rows. rows: a table with `bucket`."""
    sizes = stage.write(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("rows", F.col("n")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return stage.write(hot_join(rows, sizes, ["bucket"], total).withColumnRenamed("rows", "n"))


def _units(rows: DataFrame, split: int, *carried: str) -> DataFrame:
    """unit, side and the carried columns of rows with bucket and n; buckets beyond `split` rows become pairs of blocks."""
    blocks = F.ceil(F.col("n") / split).cast("int")
    own = F.pmod(F.xxhash64(carried[0], F.lit(7)), blocks).cast("int")
    placed = rows.withColumns({"_blocks": blocks, "_own": own})
    meets = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda k: F.struct(F.xxhash64("bucket", F.least(k, F.col("_own")), F.greatest(k, F.col("_own"))).alias("unit"), F.when(k == F.col("_own"), 2).when(k > F.col("_own"), 0).otherwise(1).alias("side")),
    )
    alone = F.array(F.struct(F.col("bucket").alias("unit"), F.lit(2).alias("side")))
    return placed.select(*carried, F.explode(F.when(F.col("_blocks") <= 1, alone).otherwise(meets)).alias("x")).select("x.unit", "x.side", *carried)


#: Rows of units that one task takes.
TASK_ROWS = 1 << 20


def _links_in_units(units: DataFrame, radius: int, tasks: int, agree: int = 0) -> DataFrame:
    """u, v: links of node long by its fp long, a forest in each run of units. units: unit, side, node, fp, and where `agree` is given the node's signs.

    signs: bytes of 16-bit min-hashes; pairs within the radius link if `agree` of them are equal.
    """

    def run(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
                if agree:
                    now.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint16).reshape(batch.num_rows, -1))
                held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
                if len(held[0]) < 1 << 18:
                    continue
            if held is None or not len(held[0]):
                continue
            # the last unit may go on in the next batch
            end = len(held[0]) if batch is None else int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1 if held[0][0] != held[0][-1] else 0
            key, side, node, prints = (x[:end] for x in held[:4])
            likely = (lambda x, y: (held[4][x] == held[4][y]).sum(axis=1) >= agree) if agree else None  # noqa: B023
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x, y in _bucket_links(key, side, prints.view(np.uint64), radius, likely) if end else ():
                a.append(node[x])
                b.append(node[y])
            u, v = np.concatenate(a), np.concatenate(b)
            if len(u):
                u, v = star_forest(u, v)
            held = [x[end:] for x in held]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return units.repartition(tasks, "unit").sortWithinPartitions("unit").mapInArrow(run, "u long, v long")


def link_fingerprints(prints: DataFrame, stage: Stage, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """u, v: links of distinct fingerprints, enough to join all within the radius. prints: distinct fp long."""
    masks = F.array(*[F.lit(_signed(m)) for m in block_masks(radius)])
    rows = prints.select("fp", F.posexplode(masks).alias("t", "mask")).select("fp", F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"))
    near = crowded(rows, stage)
    units = _units(near, bucket_rows, "fp").select("unit", "side", F.col("fp").alias("node"), "fp")
    return stage.write(_links_in_units(units, radius, parts_of(near.count(), TASK_ROWS)))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    stage = Stage(docs.sparkSession, "simhash")
    prints = stage.write(with_fingerprints(docs, words))
    reps = stage.write(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    component = connected_components(link_fingerprints(reps.select("fp"), stage, radius), stage)
    named = reps.join(component.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "rep", "n", F.coalesce("component", "fp").alias("component"))
    return _with_component(prints, stage.write(named), ["fp"], stage).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _with_component(rows: DataFrame, named: DataFrame, on: list[str], stage: Stage) -> DataFrame:
    """rows with component_id, the least rep of the component. named: on, rep, n (rows of the key) and component of each key."""
    least = stage.write(named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("keys")).withColumnRenamed("keys", "n"))
    total = named.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    keyed = stage.write(hot_join(named.withColumnRenamed("n", "rows"), least, ["component"], total[0]).select(*on, "component_id", F.col("rows").alias("n")))
    stage.keep(rows, keyed)
    return hot_join(rows, keyed, on, total[1])


#: For near-duplicates by similarity: words to a shingle; the cosine of two texts' sets of shingles, which is
#: what SimHash bits estimate, from which on they are similar; the radius within which the fingerprints of
#: such texts lie; and the min-hashes that bring them into one bucket.
SIMILAR_WORDS, SIMILARITY, SIMILAR_RADIUS = 5, 0.8, 24
BANDS, BAND_ROWS = 16, 2
#: Of all min-hashes, how many agree at least in a pair that is looked at (20 of 32 are expected at the similarity).
AGREE = 11
#: Texts of up to so many distinct shingles are compared by their shingles in the buckets.
FEW_SHINGLES = 80
#: Texts of a candidate component that are compared in one unit.
COMPONENT_ROWS = 256


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(23)
    return rng.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)


def _least_hashes(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-hashes of a text's shingle hashes."""
    mixed = hashes ^ (hashes >> np.uint64(32))
    least = np.full(len(a), _ONES)
    for at in range(0, len(mixed), 1 << 14):
        least = np.minimum(least, (a[:, None] * mixed[None, at : at + (1 << 14)] + b[:, None]).min(axis=1))
    return least


def _band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, BAND_ROWS)
    return (rows[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ (rows[:, 1] >> np.uint64(7)) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sketches(rows: DataFrame) -> DataFrame:
    """row, h1, h2 (128 bits of the text), fp, bands, signs and few of each row. few: its distinct shingles, null beyond FEW_SHINGLES."""
    bounded_batches(rows.sparkSession)

    def run(batches):
        a, b = _mixers()
        for batch in batches:
            prints, bands, signs, few = [], [], [], []
            for text in batch.column(3):
                hashes = np.unique(shingle_hashes(text.as_py(), SIMILAR_WORDS))
                prints.append(print_of(hashes))
                least = _least_hashes(hashes, a, b)
                # texts without shingles are similar to nothing
                bands.append(_band_keys(least) if len(hashes) else np.zeros(0, np.int64))
                signs.append((least >> np.uint64(40)).astype(np.uint16).tobytes())
                few.append(hashes.view(np.int64) if len(hashes) <= FEW_SHINGLES else None)
            lists = [pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.binary()), pa.array(few, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(np.array(prints, np.uint64).view(np.int64)), *lists], names=["row", "h1", "h2", "fp", "bands", "signs", "few"])

    return rows.select("row", *text_hash(), "text").mapInArrow(run, "row long, h1 long, h2 long, fp long, bands array<long>, signs binary, few array<long>")


def _similar_links(units: DataFrame, similarity: float, tasks: int) -> DataFrame:
    """u, v: links of nodes whose shingle sets are similar enough. units: unit, side, node, and text or distinct shingles."""

    def links(rows):
        rows = sorted({r[1]: r for r in rows}.values(), key=lambda r: (r[0], r[1]))
        if len(rows) < 2:
            return [], []
        sets = [np.array(r[2], np.int64) if isinstance(r[2], list) else np.unique(shingle_hashes(r[2], SIMILAR_WORDS)).view(np.int64) for r in rows]
        sizes = np.array([len(x) for x in sets])
        starts = np.cumsum(sizes) - sizes
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        marks = np.zeros(ids.max(initial=0) + 1, np.int64)

        def reach(at, sought):
            if not sought.any():
                return np.zeros(0, np.int64)
            own = ids[starts[at] : starts[at] + sizes[at]]
            marks[own] = 1
            shared = np.add.reduceat(marks[ids], starts)
            marks[own] = 0
            open_ = np.unpackbits(sought.view(np.uint8), bitorder="little")[: len(rows)] > 0
            # the cosine of two sets, without a root
            return np.flatnonzero(open_ & (shared * shared >= similarity**2 * sizes * sizes[at] * (1 - 1e-12)))

        parted = 0 if rows[0][0] == 2 else sum(r[0] == 0 for r in rows)
        if rows[0][0] != 2 and not 0 < parted < len(rows):
            return [], []
        a, b = breadth_first(len(rows), parted, reach)
        return [rows[k][1] for k in a], [rows[k][1] for k in b]

    def run(batches):
        unit, held = None, []
        for batch in itertools.chain(batches, [None]):
            u, v = [], []
            for key, *row in zip(*(batch.column(k).to_pylist() for k in range(4))) if batch is not None else [(None,)]:
                if key != unit or batch is None:
                    if held:
                        a, b = links(held)
                        u += a
                        v += b
                    unit, held = key, []
                if row:
                    held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return units.repartition(tasks, "unit").sortWithinPartitions("unit").mapInArrow(run, "u long, v long")


def _verified(members: DataFrame, texts: DataFrame, stage: Stage, similarity: float, component_rows: int) -> DataFrame:
    """u, v: links of similar texts, enough to join all that are linked within each candidate component.

    members: node, bucket (the candidate component) and n; texts: node, text. First each
    text goes out once, with its block of the component and the component's first text. What
    that joins to the first text is known to be together and is not compared again: only
    texts that it left apart meet the other blocks, and each other.
    """

    def linked(units):
        units = stage.write(units)
        return stage.write(_similar_links(units.join(texts, "node").select("unit", "side", "node", "text"), similarity, parts_of(units.count(), 16 * component_rows)))

    n = F.ceil(F.col("n") / component_rows).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), n).cast("int")
    head = F.col("node") == F.col("bucket")
    blocks = F.when(head, F.sequence(F.lit(0), n - 1)).otherwise(F.array(own))
    first = linked(members.select("node", "bucket", F.explode(blocks).alias("k")).select(F.xxhash64("bucket", "k").alias("unit"), F.lit(2).alias("side"), "node"))
    together = connected_components(first, stage).withColumnRenamed("component", "label")
    labels = stage.write(members.join(together, "node", "left").select("node", "bucket", "n", F.coalesce("label", "node").alias("label")))
    # the head is the smallest node of its candidate component, and so of its label
    left = labels.where(F.col("label") != F.col("bucket"))
    sizes = stage.write(left.groupBy("bucket").agg(F.count("*").alias("apart")))
    if sizes.isEmpty():
        return first
    both = labels.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_SIZES else sizes, "bucket")
    apart, rest = F.ceil(F.col("apart") / component_rows).cast("int"), F.ceil((F.col("n") - F.col("apart")) / component_rows).cast("int")
    lone = F.col("label") != F.col("bucket")
    mine = F.when(lone, F.pmod(F.xxhash64("node", F.lit(8)), apart)).otherwise(F.pmod(F.xxhash64("node", F.lit(9)), rest)).cast("int")
    placed = both.withColumns({"_apart": apart, "_rest": rest, "_mine": mine, "_lone": lone})
    other = F.sequence(F.lit(0), F.when(F.col("_lone"), F.col("_rest")).otherwise(F.col("_apart")) - 1)
    cross = F.transform(other, lambda k: F.struct(F.when(F.col("_lone"), F.xxhash64("bucket", F.lit("x"), "_mine", k)).otherwise(F.xxhash64("bucket", F.lit("x"), k, "_mine")).alias("unit"), F.when(F.col("_lone"), 0).otherwise(1).alias("side")))
    within = F.transform(F.sequence(F.lit(0), F.col("_apart") - 1), lambda k: F.struct(F.xxhash64("bucket", F.lit("y"), F.least(k, F.col("_mine")), F.greatest(k, F.col("_mine"))).alias("unit"), F.when(k == F.col("_mine"), 2).when(k > F.col("_mine"), 0).otherwise(1).alias("side")))
    meets = F.concat(cross, F.when(F.col("_lone"), within).otherwise(F.array().cast("array<struct<unit:bigint,side:int>>")))
    second = linked(placed.select("node", F.explode(meets).alias("x")).select("x.unit", "x.side", "node"))
    return first.unionByName(second)


#: Candidate components with texts left apart, up to which their sizes are broadcast.
BROADCAST_SIZES = 100_000


def similar_rows(rows: DataFrame, stage: Stage, similarity: float = SIMILARITY, radius: int = SIMILAR_RADIUS, bucket_rows: int = BUCKET_ROWS, component_rows: int = COMPONENT_ROWS) -> DataFrame:
    """row, component: rows joined by links of that similarity of five-word shingle sets. rows: a table of row long (unique) and text.

    A radius of a few bits misses most texts of similarity 0.8, and no cover by equal
    blocks is selective at the radius they need. Buckets here are bands of two min-hashes
    (0.9998 of pairs at 0.8 share one of 16). In them the bit-sliced comparison joins
    fingerprints within the radius whose min-hashes agree often enough to candidate
    components, and in those the shingle sets are compared exactly, so that only texts with
    a likely partner are read again. Fingerprints are of distinct shingles, as the sets
    are: repeats move no bit. With few shingles a bit hangs on one of them and no radius
    holds; such texts carry their shingles into the buckets and are compared exactly there,
    whatever their fingerprints. Texts equal by 128 bits are one node; texts without words
    are similar to nothing else.
    """
    sketches = stage.write(_sketches(rows))
    keys = stage.write(sketches.select("row", "h1", "h2"))
    grouped = sketches.groupBy("h1", "h2").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("fp", "bands", "signs", "few")])
    nodes = stage.write(grouped.withColumn("node", F.monotonically_increasing_id()))
    stage.drop(sketches)
    keyed = nodes.select("node", "fp", "signs", F.coalesce(F.size("few"), F.lit(-1)).alias("m"), F.explode("bands").alias("bucket"))
    near = crowded(keyed.select("node", "m", "bucket"), stage)
    tasks = parts_of(near.count(), TASK_ROWS)
    # a text of few shingles has partners beyond FEW_SHINGLES only near that number
    many = near.where((F.col("m") < 0) | (F.col("m") > similarity**2 * FEW_SHINGLES))
    prints = _units(many, bucket_rows, "node").join(nodes.select("node", "fp", "signs"), "node").select("unit", "side", "node", "fp", "signs")
    likely = connected_components(stage.write(_links_in_units(prints, radius, tasks, AGREE)), stage)
    small = _units(near.where("m >= 0"), bucket_rows, "node").join(nodes.select("node", "few"), "node").select("unit", "side", "node", "few")
    short = stage.write(_similar_links(small, similarity, tasks))
    likely = stage.write(likely.withColumnRenamed("component", "bucket"))
    sizes = stage.write(likely.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("size", F.col("n")))
    members = stage.write(hot_join(likely, sizes, ["bucket"], likely.count()).withColumnRenamed("size", "n"))
    stage.drop(near)
    firsts = keys.groupBy("h1", "h2").agg(F.min("row").alias("row")).join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).join(members.select("node"), "node", "left_semi")
    firsts = stage.write(firsts.select("row", "node"))
    few = firsts.count() <= BROADCAST_SIZES
    texts = stage.write(rows.select("row", "text").join(F.broadcast(firsts) if few else firsts, "row").select("node", "text"))
    found = _verified(members, texts, stage, similarity, component_rows).unionByName(short)
    component = connected_components(found, stage)
    named = stage.write(nodes.select("h1", "h2", "node", F.col("copies").alias("n")).join(component, "node", "left").select("h1", "h2", "n", F.coalesce("component", "node").alias("component")))
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = stage.write(hot_join(keys, named, ["h1", "h2"], total).select("row", "component"))
    stage.keep(rows, out)
    return out


def keyed_rows(docs: DataFrame, stage: Stage) -> DataFrame:
    """docs as a table with a unique row number as its last column, named so that it clashes with none."""
    return stage.write(docs.select("*", F.monotonically_increasing_id().alias(row_name(docs))))


def row_name(docs: DataFrame) -> str:
    name = "row"
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def similar_documents(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, component_id (the least id of the group, null if none has one) of every row; see similar_rows."""
    stage = Stage(docs.sparkSession, "similar")
    rows = keyed_rows(docs.select("doc_id", "text"), stage)
    found = similar_rows(rows, stage, **settings)
    ids = rows.select("row", "doc_id").join(found, "row")
    least = stage.write(ids.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")))
    return hot_join(ids, least, ["component"], rows.count()).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """docs with one row of each group of similar texts: the one with the least id (rows without an id come last), then the first.

    Every row is decided by itself: equal ids with other texts are other documents, and of
    repeated rows one stays.
    """
    stage = Stage(docs.sparkSession, "one")
    rows, name = keyed_rows(docs, stage), row_name(docs)
    plain = rows.select(F.col(name).alias("row"), "text")
    plain._tessera_path = rows._tessera_path
    found = similar_rows(plain, stage, **settings)
    ids = rows.select(F.col(name).alias("row"), "doc_id").join(found, "row")
    kept = ids.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row").alias("row"))).alias("x")).select("x.row")
    gone = stage.write(found.select("row").join(kept, "row", "left_anti").withColumnRenamed("row", name))
    stage.keep(rows, gone)
    return rows.join(gone, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
