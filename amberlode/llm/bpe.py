"""Byte-pair encoding by the rules of a public tokenizer file, without its library's encoder.

`MergeCounter` counts the tokens of a text with a heap of adjacent pairs over a linked list of symbols: the
pair of lowest rank (leftmost on a tie) is popped and merged until none is left. The count is the number of
initial symbols less the number of merges; no identifier is made.

Defined results: null and empty text count 0 tokens; special strings inside a text count one token each, as the
library does by default; repeated rows count alike; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Distinct words whose counts one Python worker remembers, and the longest remembered word.
CACHED_WORDS, CACHED_LENGTH = 1_000_000, 64
#: From here on, in planes that are all but unassigned, the two regular-expression libraries differ on a few characters'
#: classes; chunks that reach it are split by the tokenizer's own.
RARE = "\U00030000"


@lru_cache(maxsize=1)
def byte_symbols() -> list[str]:
    """The printable character that byte-level BPE uses for each byte: printable Latin-1 stands for itself."""
    own = {b: chr(b) for r in (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100)) for b in r}
    rest = (chr(256 + i) for i in range(256 - len(own)))
    return [own.get(b) or next(rest) for b in range(256)]


class MergeCounter:
    """Counts tokens of texts under the BPE of the tokenizer file `path` (normalizer, pattern and merges are read from it)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        number = model["vocab"]
        #: A pair of symbols, as one integer, to its rank; a rank to the merged symbol; a byte to its symbol, inside and at the end of a word.
        self.rank = {number[a] << 20 | number[b]: i for i, (a, b) in enumerate(model["merges"])}
        self.merged = [number[a + b] for a, b in model["merges"]]
        self.inner, self.last = [number[x] for x in byte_symbols()], [number[x + self.end] for x in byte_symbols()]
        first = spec["pre_tokenizer"]["pretokenizers"][0] if spec["pre_tokenizer"]["type"] == "Sequence" else None
        self.split = regex.compile(first["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.normalize = self.library.normalizer.normalize_str if self.library.normalizer else str
        self.chunks = _Chunks(self)
        self.words: dict[str, int] = {}
        #: ASCII without white space: the normaliser only lowers it, and the pattern takes a run of letters whole.
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        self.plain_ascii = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]

    def merges(self, word: str) -> int:
        """Tokens of one word: its symbols less the merges.

        Heap entries are one integer each, rank above position, so the lowest rank comes first and of equal ranks the
        leftmost. An entry is stale if the pair at its position now is another one."""
        raw = word.encode()
        if not raw:
            return 0
        rank, merged = self.rank.get, self.merged
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        n = left = len(symbols)
        heap = []
        for i in range(n - 1):
            r = rank(symbols[i] << 20 | symbols[i + 1])
            if r is not None:
                heap.append(r << 32 | i)
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heapq.heappop(heap)
            r, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if symbols[i] < 0 or j >= n or rank(symbols[i] << 20 | symbols[j]) != r:
                continue
            symbols[i] = one = merged[r]
            symbols[j] = -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                r = rank(one << 20 | symbols[k])
                if r is not None:
                    heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = rank(symbols[h] << 20 | one)
                if r is not None:
                    heapq.heappush(heap, r << 32 | h)
        return left

    def _chunk(self, chunk: str) -> int:
        """Tokens of a text without ASCII white space."""
        if self.special is not None and self.special.search(chunk):
            parts = self.special.split(chunk)
            return len(parts) - 1 + sum(self._chunk(x) for x in parts if x)
        text = chunk.lower() if self.plain_ascii and chunk.isascii() else self.normalize(chunk)
        if text.isascii():
            found = (text,) if text.isalpha() else self.split.findall(text)
        elif max(text) >= RARE:
            found = [text[i:j] for _, (i, j) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        else:
            found = self.split.findall(text)
        total = 0
        for word in found:
            n = self.words.get(word)
            if n is None:
                n = self.merges(word)
                if len(word) <= CACHED_LENGTH:
                    if len(self.words) >= CACHED_WORDS:
                        self.words.clear()
                    self.words[word] = n
            total += n
        return total

    def count(self, text: bytes | None) -> int:
        """Tokens of a text in UTF-8. No token, and no normalisation, spans ASCII white space, so counts add up over its parts."""
        return sum(map(self.chunks.__getitem__, text.split())) if text else 0


class _Chunks(dict):
    """Chunk to its count; bounded, and forgets everything once it is full."""

    def __init__(self, counter: MergeCounter) -> None:
        self.counter = counter

    def __missing__(self, chunk: bytes) -> int:
        n = self.counter._chunk(chunk.decode())
        if len(chunk) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[chunk] = n
        return n


@lru_cache(maxsize=2)
def counter_for(path: str) -> MergeCounter:
    """One counter for each worker process, so that later tasks find its remembered words."""
    return MergeCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of `docs`, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(path)
        for batch in batches:
            texts = batch.column(1)
            n_bytes, n_tokens = [], []
            for text in texts.cast(pa.binary()):
                raw = text.as_py() or b""
                n_bytes.append(len(raw))
                n_tokens.append(counter.count(raw))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
