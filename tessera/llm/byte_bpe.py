"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut where a match of the splitting pattern must begin: between a
character that is no white space and a space or line feed. No alternative of the
pattern holds white space after another character, so the ids are those of the
whole text. Decoding joins the raw bytes of the ids; a token may end inside a
character, so text is only made from the joined bytes. A stretch of white space too long
for the library's splitter, whose stack it exhausts, is split by the `regex` module, which
reads the same pattern, and its pieces are encoded one by one.

Defined cases: null texts count as empty (no ids, digests of no bytes); null and
repeated ids pass through row by row; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded_batches

#: Characters after which a long text is cut at the next safe boundary.
CHUNK_CHARS = 1 << 16
_BOUNDARY = re.compile(r"\S(?=[ \n])")
#: White space in a row that the library's splitter may not bear (it breaks off at about a million).
_LONG_BLANK = re.compile(r"\s{100000}")


@cache
def splitter(pattern: str):
    return regex.compile(pattern)


@cache
def codec(rank_file: str, pattern: str):
    """The encoder, and for each id its bytes and its decimal digits."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoder = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    raw: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        raw[rank] = token
    return encoder, raw, [b"%d" % i for i in range(len(raw))]


def safe_chunks(text: str, size: int = CHUNK_CHARS):
    at = 0
    while len(text) - at > size:
        cut = _BOUNDARY.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


def encode(text: str | None, rank_file: str, pattern: str) -> list[int]:
    encoder = codec(rank_file, pattern)[0]
    ids: list[int] = []
    for part in safe_chunks(text or ""):
        if _LONG_BLANK.search(part):
            for piece in splitter(pattern).findall(part):
                ids += encoder._core_bpe.encode_single_piece(piece.encode())
        else:
            ids += encoder.encode_ordinary(part)
    return ids


def decode(ids: list[int], rank_file: str, pattern: str) -> bytes:
    raw = codec(rank_file, pattern)[1]
    return b"".join(map(raw.__getitem__, ids))


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = True, with_decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids array<int>, with_decoded besides decoded binary."""
    with_decoded = with_ids and with_decoded
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded binary" * with_decoded

    def run(batches):
        digits = codec(rank_file, pattern)[2].__getitem__
        for batch in batches:
            n, a, b, all_ids, raws = [], [], [], [], []
            for text in batch.column(1):
                ids = encode(text.as_py(), rank_file, pattern)
                raw = decode(ids, rank_file, pattern)
                n.append(len(ids))
                a.append(hashlib.sha256(b",".join(map(digits, ids))).hexdigest())
                b.append(hashlib.sha256(raw).hexdigest())
                if with_ids:
                    # four bytes an id, not an object each
                    all_ids.append(np.array(ids, np.int32))
                if with_decoded:
                    raws.append(raw)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            if with_decoded:
                columns.append(pa.array(raws, pa.binary()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
