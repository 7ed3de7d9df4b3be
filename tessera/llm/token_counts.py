"""Token counts by byte-pair merging over a heap and a linked list.

The symbols of a word stand in a linked list, its adjacent pairs in a heap by rank
and then by place. The lowest pair is popped and merged until none is left; the
count is the number of symbols at first less the number of merges. No ids are made.
Counts of words of ordinary length are kept, up to a bound, in each worker.

Words are split as the vocabulary file states: special strings first, then white
space runs to one space, lower case, and its pattern. Texts within the Latin blocks
take a pattern of our own; all others go through the library's normaliser and
splitter, so that Unicode versions cannot differ.

Defined cases: a null text is empty (0 bytes, 0 tokens); null or repeated ids pass
through; words of any length take n log n; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded_batches

LIMIT = 2048
KEPT_WORDS = 1 << 20
KEPT_CHARS = 200
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: White space that the library's \s takes but another engine may not, or the other way round.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85]")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Counter(dict):
    """Number of tokens by word, counted when first asked for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.pairs = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        symbols = byte_symbols()
        self.inner = [vocab.get(s) for s in symbols]
        self.last = [vocab.get(s + self.suffix) for s in symbols]
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.library = Tokenizer.from_file(path)

    def __missing__(self, word: str) -> int:
        n = self.merged(word)
        if len(word) <= KEPT_CHARS and len(self) < KEPT_WORDS:
            self[word] = n
        return n

    def merged(self, word: str) -> int:
        """Symbols of the word less the merges that apply to it."""
        data = word.encode()
        ids = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]] if data else []
        ids = [i for i in ids if i is not None]
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, ids[i], ids[i + 1], found[1]) for i in range(n - 1) if (found := pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if found := pairs.get((new, ids[k])):
                    heapq.heappush(heap, (found[0], i, new, ids[k], found[1]))
            if (h := before[i]) >= 0 and (found := pairs.get((ids[h], new))):
                heapq.heappush(heap, (found[0], h, ids[h], new, found[1]))
        return n - merges

    def words(self, text: str):
        if not _BEYOND_LATIN.search(text) and not _ODD_SPACE.search(text):
            return _WORDS.findall(text.lower())
        return self.library_words(text)

    def library_words(self, text: str):
        """By the library's own rules; its byte symbols are turned back into text."""
        back = self.__dict__.setdefault("back", {c: b for b, c in enumerate(byte_symbols())})
        normal = self.library.normalizer.normalize_str(text)
        for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal):
            yield bytes(back[c] for c in piece).decode()

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        get = self.__getitem__
        if self.split_special is None or self.special[0][:2] not in text:
            return sum(map(get, self.words(text)))
        parts = self.split_special.split(text)
        return len(parts) - 1 + sum(sum(map(get, self.words(part))) for part in parts)


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_documents(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens)."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        count = counter(path).count
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            n = [count(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len((x or "").encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
