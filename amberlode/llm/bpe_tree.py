"""Byte-level BPE encoding and decoding by tree concatenation.

A long text is cut into leaves, which are encoded on their own - those of very long texts in parallel, as rows of
their own - and joined pairwise up a tree. At every join a window of tokens around the cut is encoded again and
grows until both sides agree with it: at a place where every encoding must break (a letter, digit or mark,
then a space, then no space), or, inside one unsplit run of letters, at an equal first and last token, since byte
pairs keep a sequence of tokens whenever they keep each neighbouring two. A window that covers both sides is exact.

Defined results: null and empty text give no identifiers and decode to ''; special strings inside a text become
their own identifiers, as the library does by default; repeated rows are encoded alike; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from amberlode.llm.bpe import byte_symbols

#: Characters of a leaf; of a text whose leaves are dealt out over the cluster; tokens of the first window.
LEAF, DEALT_OVER, WINDOW = 1 << 13, 1 << 16, 32
#: Entries that one worker remembers, and the longest one.
CACHED, CACHED_LENGTH = 1_000_000, 48

#: Fixed value: the splitting pattern of this byte-level family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SPACED = frozenset(b"\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x85\xa0")


class _Uneven(Exception):
    """A part that doesn't stand between single spaces."""


class _Parts(dict):
    """A part between two single spaces (UTF-8) to the identifiers of the space and the part."""

    def __init__(self, codec: TreeCodec) -> None:
        self.codec = codec

    def __missing__(self, part: bytes) -> bytes:
        text = part.decode()
        if not part or text[0].isspace() or text[-1].isspace():
            raise _Uneven
        ids = self.codec._split(" " + text)
        if len(part) <= CACHED_LENGTH and b"\n" not in part:
            if len(self) >= CACHED:
                self.clear()
            self[part] = ids
        return ids


class TreeCodec:
    """Encodes to and decodes from packed little-endian unsigned 32-bit identifiers."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW) -> None:
        self.library = Tokenizer.from_file(path)
        self.leaf, self.window = leaf, window
        self.symbols = byte_symbols()
        self.pattern = regex.compile(PATTERN)
        self.letters = regex.compile(r"\p{L}+")
        self.added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        raw = {s: b for b, s in enumerate(self.symbols)}
        self.bytes_of = [b""] * self.library.get_vocab_size(with_added_tokens=True)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.bytes_of[i] = token.encode() if token in self.added else bytes(raw[c] for c in token)
        self.words: dict[str, bytes] = {}
        self.parts = _Parts(self)

    # -- one leaf

    def _word(self, word: str) -> bytes:
        """Identifiers of a run that the pattern doesn't split."""
        found = self.words.get(word)
        if found is None:
            if len(word) > self.leaf:
                return self._tree([word[i : i + self.leaf] for i in range(0, len(word), self.leaf)], self._word)
            tokens = self.library.model.tokenize("".join(self.symbols[b] for b in word.encode()))
            found = np.array([t.id for t in tokens], "<u4").tobytes()
            if len(word) <= CACHED_LENGTH:
                if len(self.words) >= CACHED:
                    self.words.clear()
                self.words[word] = found
        return found

    def _split(self, text: str) -> bytes:
        return b"".join(map(self._word, self.pattern.findall(text)))

    def _leaf(self, text: str) -> bytes:
        """Most texts are words between single spaces, and such spaces are places where every encoding breaks."""
        first, *rest = text.encode().split(b" ")
        if first and not text[0].isspace() and rest:
            head = first.decode()
            if not head[-1].isspace():
                try:
                    return self._split(head) + b"".join(map(self.parts.__getitem__, rest))
                except _Uneven:
                    pass
        return self._split(text)

    # -- the tree

    def _tree(self, leaves: list[str], encode) -> bytes:
        return self.join_all([encode(x) for x in leaves])

    def join_all(self, level: list[bytes]) -> bytes:
        """Joins encoded neighbours pairwise until one is left."""
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else b""

    def _cut(self, text: str, upto: int, last: bool) -> int | None:
        """A place in `text` where every encoding breaks: the last one before `upto`, or the first one from there on."""
        found = None
        for m in self.hard.finditer(text, *((0, upto) if last else (max(0, upto - 1),))):
            if last and m.start() + 2 < upto or not last and m.start() + 1 >= upto:
                found = m.start() + 1
                if not last:
                    break
        return found

    #: No mark of white space, a single space, no white space.
    hard = regex.compile(r"\S (?=\S)")

    def join(self, left: bytes, right: bytes) -> bytes:
        a, b = np.frombuffer(left, "<u4"), np.frombuffer(right, "<u4")
        if not len(a) or not len(b):
            return left + right
        w = self.window
        while True:
            i, j = max(0, len(a) - w), min(len(b), w)
            before = b"".join([self.bytes_of[t] for t in a[i:].tolist()])
            after = b"".join([self.bytes_of[t] for t in b[:j].tolist()])
            if not i and j == len(b):
                return self._again((before + after).decode())
            done = self._agreed(a, b, i, j, before, after)
            if done is not None:
                return done
            w *= 2

    def _agreed(self, a: np.ndarray, b: np.ndarray, i: int, j: int, before: bytes, after: bytes) -> bytes | None:
        """The joined identifiers if the encoding of the window agrees with both sides, else None."""
        try:
            x, y = before.decode(), after.decode()
        except UnicodeDecodeError:  # the window starts or ends inside a character
            return None
        text = x + y
        start, end = (0 if not i else self._cut(text, len(x), True)), (len(text) if j == len(b) else self._cut(text, len(x) + 1, False))
        if start is not None and end is not None:
            n_left, n_right = len(text[:start].encode()), len(text[end:].encode())
            keep_a, keep_b = self._tokens(a[i:], n_left, False), self._tokens(b[:j], n_right, True)
            if keep_a is not None and keep_b is not None:
                return a[: i + keep_a].tobytes() + self._again(text[start:end]) + b[j - keep_b :].tobytes()
        if self.letters.fullmatch(text):
            again = np.frombuffer(self._direct(text), "<u4")
            if (not i or again[0] == a[i]) and (j == len(b) or again[-1] == b[j - 1]):
                return a[:i].tobytes() + again.tobytes() + b[j:].tobytes()
        return None

    def _again(self, text: str) -> bytes:
        """The encoding of a window, without a tree of its own."""
        return b"".join(map(self._direct, self.pattern.findall(text)))

    def _direct(self, word: str) -> bytes:
        tokens = self.library.model.tokenize("".join(self.symbols[b] for b in word.encode()))
        return np.array([t.id for t in tokens], "<u4").tobytes()

    def _tokens(self, ids: np.ndarray, n_bytes: int, back: bool) -> int | None:
        """How many first (or last) tokens hold exactly `n_bytes`; None if a token lies across."""
        k = total = 0
        for t in ids[::-1] if back else ids:
            if total >= n_bytes:
                break
            total += len(self.bytes_of[t])
            k += 1
        return k if total == n_bytes else None

    # -- texts

    def leaves(self, text: str) -> list[str]:
        return [text[i : i + self.leaf] for i in range(0, len(text), self.leaf)]

    def _plain(self, text: str) -> bytes:
        return self._leaf(text) if len(text) <= self.leaf else self._tree(self.leaves(text), self._leaf)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return b"".join(np.array([self.added[x]], "<u4").tobytes() if x in self.added else self._plain(x) for x in self.special.split(text) if x)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec_for(path: str) -> TreeCodec:
    """One codec for each worker process."""
    return TreeCodec(path)


_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(doc_ids: pa.Array, encoded: Iterator[bytes], codec: TreeCodec) -> pa.RecordBatch:
    n, ids, back = [], [], []
    for x in encoded:
        n.append(len(x) // 4)
        ids.append(hashlib.sha256(x).hexdigest())
        back.append(hashlib.sha256(codec.decode(x).encode()).hexdigest())
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_digests(docs: DataFrame, path: str, dealt_over: int = DEALT_OVER) -> DataFrame:
    """doc_id, n_tokens, and digests of the identifiers and of the text decoded from them: one row per row of `docs`.

    Texts of more than `dealt_over` characters are encoded leaf by leaf in rows of their own and joined afterwards."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path)
        for batch in batches:
            yield _digests(batch.column(0), (codec.encode(t.as_py()) for t in batch.column(1)), codec)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaves never span a special string: such a string is a leaf."""
        codec = codec_for(path)
        for batch in batches:
            for row in batch.to_pylist():
                pieces = codec.special.split(row["text"]) if codec.special else [row["text"]]
                leaves = [(p, x) for p, piece in enumerate(pieces) if piece for x in ([piece] if piece in codec.added else codec.leaves(piece))]
                n = len(leaves)
                yield pa.RecordBatch.from_pylist([{"row": row["row"], "doc_id": row["doc_id"], "piece": p, "leaf": k, "text": x} for k, (p, x) in enumerate(leaves)], schema=cut_schema) if n else pa.RecordBatch.from_pylist([], schema=cut_schema)

    cut_schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("leaf", pa.int32()), ("text", pa.string())])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path)
        for batch in batches:
            ids = [np.array([codec.added[t]], "<u4").tobytes() if t in codec.added else codec._leaf(t) for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.binary())], ["row", "doc_id", "piece", "leaf", "ids"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path)
        for batch in batches:
            encoded = []
            for leaves in batch.column(1).to_pylist():
                pieces: dict[int, list[bytes]] = {}
                for x in leaves:
                    pieces.setdefault(x["piece"], []).append(x["ids"])
                encoded.append(b"".join(map(codec.join_all, pieces.values())))
            yield _digests(batch.column(0), iter(encoded), codec)

    length = F.coalesce(F.length("text"), F.lit(0))
    short = texts.where(length <= dealt_over).mapInArrow(whole, _SCHEMA)
    leaves = texts.where(length > dealt_over).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
    leaves = leaves.mapInArrow(cut, "row long, doc_id long, piece int, leaf int, text string").repartition("row", "leaf")
    leaves = leaves.mapInArrow(leaf, "row long, doc_id long, piece int, leaf int, ids binary")
    grouped = leaves.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("leaf", "piece", "ids"))).alias("leaves")).select("doc_id", "leaves")
    return short.unionByName(grouped.mapInArrow(join, _SCHEMA))
