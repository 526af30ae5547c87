"""Variable-capacity best-fit packing of token sequences.

Documents are dealt by a hash of their id to shards of bounded size; each shard is packed on its own, longest
pieces first. A piece goes to the open bin that it leaves the least room in. If none takes it, a bin of the least-cost
size is opened: for every permitted size, the room beside the piece is planned with the lengths that are still to come,
the longest that fits first, and the cost of a sequence of that size is shared over the tokens that it would hold.
A sequence costs its tokens, a fixed overhead, and what attention adds with the square of its length; so long sizes
spread the overhead, short ones save attention, and either wins where the lengths at hand fill it. At the end every
bin shrinks to the smallest permitted size that holds its contents. A document longer than the largest size is cut into
pieces of that size and a rest; no token is dropped.

Defined results: null and empty text have no tokens and no row in a bin (bin_id null, n_tokens 0); a null n_tokens
counts as 0; repeated rows are packed one by one; rows without doc_id are packed like others; extra columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """`sizes`: permitted sequence lengths, ascending. A sequence of length s costs s + `overhead` + s * s / `square`.
    `shard_docs`: documents a shard is planned for."""

    sizes: tuple[int, ...] = (512, 1024, 2048, 4096)
    overhead: int = 16
    square: int = 65_536
    shard_docs: int = 20_000

    def cost(self, size: int) -> float:
        return size + self.overhead + size * size / self.square


class _Open:
    """Open bins by room, for the tightest one that takes a piece."""

    def __init__(self) -> None:
        self.rooms: list[tuple[int, int]] = []

    def take(self, n: int) -> tuple[int, int] | None:
        at = bisect.bisect_left(self.rooms, (n, -1))
        return self.rooms.pop(at) if at < len(self.rooms) else None

    def put(self, room: int, index: int) -> None:
        if room:
            bisect.insort(self.rooms, (room, index))


class _Ahead:
    """How many pieces of each length are still to come, and the longest such length up to a given one."""

    def __init__(self, lengths: list[int], largest: int) -> None:
        self.count = [0] * (largest + 1)
        for n in lengths:
            self.count[n] += 1
        #: A length points to itself while pieces of it are left, else to a shorter one.
        self.down = [n if self.count[n] else max(0, n - 1) for n in range(largest + 1)]

    def remove(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.down[n] = n - 1

    def longest(self, n: int) -> int:
        """0 if there is none."""
        top = n
        while self.down[top] != top:
            top = self.down[top]
        while self.down[n] != top and n != top:  # later searches go the short way
            self.down[n], n = top, self.down[n]
        return top

    def fill(self, room: int) -> int:
        """Tokens that would go into `room` if always the longest fitting piece went first."""
        free, n = room, self.longest(room)
        while n:
            free -= n * min(self.count[n], free // n)
            n = self.longest(min(free, n - 1))
        return room - free


def cheapest(n: int, ahead: _Ahead, p: Params) -> int:
    """The bin size to open for a piece of `n` tokens: the one of least cost a token, as planned with the pieces `ahead`.
    A bin that would stay emptier costs what it will shrink to; of equal costs the larger size wins, as it leaves more open."""
    best, least = 0, float("inf")
    for size in p.sizes[bisect.bisect_left(p.sizes, n) :]:
        held = n + ahead.fill(size - n)
        cost = p.cost(p.sizes[bisect.bisect_left(p.sizes, held)]) / held
        if cost <= least:
            best, least = size, cost
    return best


def pack(lengths: list[int], p: Params) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Pieces (item, piece start, bin, place in the bin) and the final size of every bin."""
    largest, pieces = p.sizes[-1], []
    for item, n in enumerate(lengths):
        pieces += [(largest, item, at) for at in range(0, n - largest + 1, largest)]
        if n % largest:
            pieces.append((n % largest, item, n - n % largest))
    pieces.sort(key=lambda x: (-x[0], x[1], x[2]))
    ahead = _Ahead([x[0] for x in pieces], largest)
    open_bins, used, out = _Open(), [], []
    for n, item, at in pieces:
        ahead.remove(n)
        room, k = open_bins.take(n) or (None, len(used))
        if room is None:
            room = cheapest(n, ahead, p)
            used.append(0)
        out.append((item, at, k, used[k]))
        used[k] += n
        open_bins.put(room - n, k)
    return out, [p.sizes[bisect.bisect_left(p.sizes, u)] for u in used]


def packed(docs: DataFrame, p: Params = Params(), n_docs: int | None = None) -> DataFrame:
    """doc_id, n_tokens, piece_start, piece_tokens, bin_id, bin_size, bin_start: a row per piece of each row of `docs`
    (doc_id, n_tokens)."""
    schema = "doc_id long, n_tokens long, piece_start long, piece_tokens long, bin_id string, bin_size int, bin_start int"
    largest = p.sizes[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def close() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            ids, lengths = rows.column("doc_id").to_pylist(), rows.column("n_tokens").to_pylist()
            pieces, sizes = pack(lengths, p)
            cells = [(ids[i], lengths[i], at, min(largest, lengths[i] - at), f"{last}-{k}", sizes[k], start) for i, at, k, start in pieces]
            cells += [(ids[i], 0, 0, 0, None, None, None) for i, n in enumerate(lengths) if not n]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.int32(), pa.int32()]
            names = [x.split()[0] for x in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*cells), kinds)], names)

        for batch in batches:
            shards = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *[i for i in range(1, len(shards)) if shards[i] != shards[i - 1]], len(shards)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if held and shards[i] != last:
                    yield close()
                    held = []
                last = int(shards[i])
                held.append(batch.slice(i, j - i))
        if held:
            yield close()

    total = docs.count() if n_docs is None else n_docs
    shards = max(1, -(-total // p.shard_docs))
    # a hash of the id and length, so that rows without an id don't meet in one shard
    shard = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("n_tokens"))), F.lit(shards)).cast("int")
    rows = docs.select(shard.alias("shard"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"))
    return rows.repartition("shard").sortWithinPartitions("shard", "doc_id", "n_tokens").mapInArrow(run, schema)
