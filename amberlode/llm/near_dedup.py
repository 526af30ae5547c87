"""b-bit MinHash near-duplicate detection.

Every document becomes a set of word shingles. Minima of `bands * rows` hash functions give band keys, and
the low `bits` bits of each minimum are packed into 64-bit planes. Documents that share a band key are
candidates; counting equal packed values, corrected for chance collisions, estimates their similarity;
candidates that may reach the threshold are confirmed on full shingle sets. Components of confirmed links
are the duplicate classes. Groups of at most `block` rows are compared whole; in larger ones every row is compared with
one hub, and only rows that aren't near it with the rest of the group, so that a class of very many near copies costs
about one comparison a copy.

Defined results at the edges: null or blank text has an empty set and is linked with nothing; a text with
fewer words than a shingle has its whole word sequence as its one shingle; rows that share a doc_id are one
node; a row without doc_id is linked with nothing and kept; columns besides doc_id and text play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberlode.llm.common import durable, remove, with_keys

_M3 = np.uint32(0x2C1B3C6D)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Params:
    """`percent`: least 100 * Jaccard similarity of a link. A pair at the threshold shares no band with probability `miss`."""

    shingle: int = 5
    percent: int = 80
    rows: int = 4
    bits: int = 4
    miss: float = 1e-9
    deviations: float = 6.0
    estimators: int = 256
    block: int = 1024

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def hashes(self) -> int:
        """Bands use the first `bands * rows`; the packed signature uses all."""
        return max(self.estimators, self.bands * self.rows)

    @property
    def planes(self) -> int:
        """Longs per bit plane."""
        return -(-self.hashes // 64)

    @property
    def least_equal(self) -> int:
        """Equal packed values that a pair at the threshold falls short of only beyond `deviations` standard deviations."""
        chance = 2.0**-self.bits
        p = self.percent / 100
        p = p + (1 - p) * chance
        return max(0, math.floor(self.hashes * p - self.deviations * math.sqrt(self.hashes * p * (1 - p))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Hasher:
    """64-bit hashes of the words of a text, by prefix sums of a polynomial over its bytes: no Python object per word."""

    CHUNK = 1 << 20

    def __init__(self) -> None:
        rng = np.random.default_rng(20240229)
        values = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        values[65:91] = values[97:123]  # A-Z count as a-z
        self.values, self.space = values, np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers(1 << 16)

    def powers(self, n: int) -> None:
        ones = np.ones(n, np.uint64)
        self.up, self.down = (np.multiply.accumulate(np.where(np.arange(n) == 0, ones, x)) for x in (self.base, self.inverse))

    def words(self, text: bytes) -> np.ndarray:
        raw, out, at = np.frombuffer(text, np.uint8), [], 0
        while at < len(raw):
            end = min(len(raw), at + self.CHUNK)
            while end < len(raw) and not self.space[raw[end]]:  # a word isn't cut
                end += 1
            out.append(self._chunk(raw[at:end]))
            at = end
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def _chunk(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw)
        if n > len(self.up):
            self.powers(1 << (n - 1).bit_length())
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = ~self.space[raw]
        edges = np.flatnonzero(np.diff(inside))
        start, end = edges[0::2], edges[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[raw] * self.up[:n], out=sums[1:])
        return _mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def shingle_set(text: bytes | None, n: int, hasher: _Hasher) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    h = hasher.words(text) if text else np.empty(0, np.uint64)
    if not len(h):
        return h
    short = len(h) < n
    n = min(n, len(h))
    last = len(h) - n + 1
    out = _mix(h[:last] + np.uint64(n))  # sequences of fewer words never equal a shingle
    for j in range(1, n):
        out = _mix(out + h[j : j + last])
    return out if short else np.unique(out)


def _functions(p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    add = rng.integers(0, 1 << 32, p.hashes, dtype=np.uint64).astype(np.uint32)
    times = rng.integers(0, 1 << 31, p.hashes, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    return add[:, None], times[:, None], rng.integers(1, 1 << 62, (p.bands, p.rows), dtype=np.uint64) | np.uint64(1)


def minima(shingles: np.ndarray, add: np.ndarray, times: np.ndarray, block: int = 4096) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = None
    for i in range(0, len(x), block):
        h = (x[None, i : i + block] ^ add) * times
        h ^= h >> np.uint32(15)  # a product alone is linear, and minima of linear functions go together
        h *= _M3
        h ^= h >> np.uint32(13)
        h *= times
        least = h.min(axis=1)
        out = least if out is None else np.minimum(out, least)
    return out


def pack(low: np.ndarray, bits: int, planes: int) -> np.ndarray:
    """`bits` planes of `planes` longs: plane j holds bit j of every value."""
    padded = np.zeros((bits, planes * 64), np.uint8)
    for j in range(bits):
        padded[j, : len(low)] = (low >> np.uint32(j)) & np.uint32(1)
    return np.packbits(padded, axis=1).view(">i8").astype(np.int64).ravel()


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (128-bit key of the set), bands, planes."""

    def run(batches):
        add, times, keys = _functions(p)
        order, hasher = np.arange(p.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), _Hasher()
        for batch in batches:
            n_sh, a, b, bands, planes = [], [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                s = shingle_set(text.as_py(), p.shingle, hasher)
                n_sh.append(len(s))
                if not len(s):
                    a.append(0), b.append(0), bands.append(None), planes.append(None)
                    continue
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                a.append((d >> 64) - (1 << 63)), b.append((d & ((1 << 64) - 1)) - (1 << 63))
                m = minima(s, add, times)
                key = _mix((m[: p.bands * p.rows].astype(np.uint64).reshape(p.bands, p.rows) * keys).sum(axis=1, dtype=np.uint64) + order)
                bands.append(key.view(np.int64))
                planes.append(pack(m, p.bits, p.planes))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n_sh, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bands, longs), pa.array(planes, longs)],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands", "planes"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, planes array<long>")


def _groups(batches, n_keys: int):
    """Groups of rows with equal leading `n_keys` columns, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            key = tuple(keys[:, i].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]).reshape(-1, width)


def equal_values(one: np.ndarray, many: np.ndarray, p: Params) -> np.ndarray:
    """Equal packed values of signature `one` and each row of `many`, by bit counts."""
    differ = np.zeros((len(many), p.planes), np.uint64)  # signed longs would have the bits of their absolute values counted
    for j in range(p.bits):
        at = slice(j * p.planes, (j + 1) * p.planes)
        differ |= (one[None, at] ^ many[:, at]).view(np.uint64)
    return p.hashes - np.bitwise_count(differ).sum(axis=1, dtype=np.int64)


def forest(ids: np.ndarray, planes: np.ndarray, p: Params, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of pairs that may be similar or, with `sets`, that are.

    A breadth-first search compares each reached row with the rows not reached yet, so members of a close group
    are compared a few times and not with one another."""
    edges, left = [], np.arange(len(ids))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = equal_values(planes[i], planes[left], p) >= p.least_equal
            near |= ids[left] == ids[i]
            if sets is not None:
                for k in np.flatnonzero(near):
                    near[k] = similar(sets[i], sets[left[k]], p.percent)
            edges += [(int(ids[i]), int(ids[j])) for j in left[near] if ids[i] != ids[j]]
            queue += left[near].tolist()
            left = left[~near]
    return edges


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b|, in integers."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _own(n_blocks: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id"), n_blocks).cast("int")


def _blocks(size: str, p: Params) -> Column:
    return F.ceil(F.col(size) / F.lit(p.block)).cast("int")


def _numbers(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _payload(group: pa.Table, p: Params) -> tuple[np.ndarray, np.ndarray, list[np.ndarray] | None]:
    """Ids, planes and, if there are any, sets of a group's rows."""
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("shingles")] if "shingles" in group.column_names else None
    return group.column("doc_id").to_numpy(), _matrix(group.column("planes"), p.bits * p.planes), sets


def _edges(edges: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if edges:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], ["src", "dst"])


def _dealt(rows: DataFrame, by: list[str], order: list[str], run, schema: str) -> DataFrame:
    """`run` over the rows of each group `by`, which are together and in `order`."""
    return rows.repartition(*by).select(*by, *[c for c in rows.columns if c not in by]).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def _whole_groups(rows: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """src, dst: forest edges of groups of at most `block` rows."""

    def run(batches):
        for group in _groups(batches, len(keys)):
            if group.num_rows > 1:
                yield from _edges(forest(*_payload(group, p)[:2], p, _payload(group, p)[2]))

    return _dealt(rows, keys, ["doc_id"], run, "src long, dst long")


def _hubs(rows: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """The keys, doc_id, hub and near of the rows of large groups, each compared with one row of its group: the hub goes to every
    block, and no other row is copied."""
    most = rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), "doc_id").alias("h"))
    hubs = most.select(*keys, "h.*").withColumn("own", _numbers(_blocks("size", p))).withColumn("role", F.lit(0))
    every = rows.withColumn("own", _own(_blocks("size", p))).withColumn("role", F.lit(1))

    def run(batches):
        for group in _groups(batches, len(keys) + 1):
            ids, planes, sets = _payload(group, p)
            near = (equal_values(planes[0], planes, p) >= p.least_equal) | (ids == ids[0])
            if sets is not None:
                near = np.array([n and (ids[k] == ids[0] or similar(sets[0], sets[k], p.percent)) for k, n in enumerate(near.tolist())])
            rest = group.slice(1)
            yield from pa.table({**{c: rest.column(c) for c in keys}, "doc_id": rest.column("doc_id"), "hub": pa.array(np.full(len(ids) - 1, ids[0])), "near": pa.array(near[1:])}).to_batches()

    kinds = ", ".join(f"{c} long" for c in keys)
    return _dealt(every.unionByName(hubs), [*keys, "own"], ["role", "doc_id"], run, f"{kinds}, doc_id long, hub long, near boolean")


def _around_hubs(rows: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """src, dst: edges of groups of more than `block` rows.

    Rows near the hub are linked by it. Only the others meet the whole group, block by block, so work and copies grow with
    their number times the group's and not with its square."""
    met = durable(_hubs(rows, keys, p), "hubs")
    star = met.where("near AND doc_id <> hub").select(F.col("doc_id").alias("src"), F.col("hub").alias("dst"))
    left = met.groupBy(*keys, "doc_id").agg(F.min("near").alias("near"))
    counts = left.where("NOT near").groupBy(*keys).agg(F.count("*").alias("n_left"))
    if counts.isEmpty():
        return star
    sizes = rows.groupBy(*keys).agg(F.max("size").alias("weight"))
    known = with_keys(rows, durable(counts.join(sizes, keys), "left"), keys, "weight").join(left, [*keys, "doc_id"])
    asking = known.where("NOT near").withColumn("i", _own(F.ceil(F.col("n_left") / F.lit(p.block)).cast("int"))).withColumn("j", _numbers(_blocks("size", p))).withColumn("role", F.lit(0))
    asked = known.withColumn("j", _own(_blocks("size", p))).withColumn("i", _numbers(F.ceil(F.col("n_left") / F.lit(p.block)).cast("int"))).withColumn("role", F.lit(1))

    def run(batches):
        for group in _groups(batches, len(keys) + 2):
            ids, planes, sets = _payload(group, p)
            linked = group.column("near").to_numpy(zero_copy_only=False).astype(bool)
            loose, held = np.flatnonzero(~linked), np.flatnonzero(linked)
            edges = forest(ids[loose], planes[loose], p, sets and [sets[k] for k in loose])
            for q in np.flatnonzero(group.column("role").to_numpy() == 0):
                near = held[equal_values(planes[q], planes[held], p) >= p.least_equal]
                hit = near[:1] if sets is None else next(([k] for k in near if similar(sets[q], sets[k], p.percent)), [])
                edges += [(int(ids[q]), int(ids[k])) for k in hit]  # those that are near the hub are linked already: one will do
            yield from _edges(edges)

    return star.unionByName(_dealt(asking.unionByName(asked), [*keys, "i", "j"], ["role", "doc_id"], run, "src long, dst long"))


def _links(make, sizes: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """src, dst: edges that connect what the pairs of rows within groups connect. `sizes`: keys and size, a written table;
    `make` gives the rows of such groups: keys, size, doc_id, planes and, to confirm links, shingles."""
    few = _whole_groups(make(sizes.where(F.col("size") <= p.block)), keys, p)
    many = sizes.where(F.col("size") > p.block)
    return few if many.isEmpty() else few.unionByName(_around_hubs(durable(make(many), "many"), keys, p))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """doc_id, root: the smallest id of every component of the undirected graph `edges` (src, dst); by alternating
    large-star and small-star steps, each a table in the shared folder. The edges of a vertex that very many have in common
    aren't brought together."""
    spark = edges.sparkSession
    now = durable(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u > v").distinct(), name)
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), name)
        large = durable(with_keys(both.where("v > u"), least, ["u"], "n", 2 * mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        fewest = durable(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), name)
        linked = with_keys(large, fewest, ["u"], "n")
        small = linked.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(fewest.select("u", F.col("m").alias("v")))
        then = durable(small.distinct(), name)
        for done in (now, least, large, fewest):
            remove(spark, done)
        now, before, mark = then, mark, _mark(then)
        if mark == before:
            break
    return now.select(F.col("u").alias("doc_id"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def shingle_sets(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, shingles: the sorted 64-bit shingle hashes of each text."""

    def run(batches):
        hasher = _Hasher()
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                sets = [shingle_set(t.as_py(), p.shingle, hasher).tobytes() for t in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, shingles binary")


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of `docs`; see the module for edge cases."""
    spark = docs.sparkSession
    signed = durable(signatures(docs, p), "signatures")
    real = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    # exact copies of a set fall together first; only their smallest id goes on
    firsts = durable(real.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "firsts")
    reps = real.join(firsts.select(F.col("rep").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"], "left_semi").dropDuplicates(["doc_id", "set_a", "set_b"])
    banded = reps.select("doc_id", F.explode("bands").alias("band"))
    crowded = durable(banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "crowded")
    total = firsts.count() * p.bands

    def buckets(bands: DataFrame) -> DataFrame:
        return with_keys(banded, bands.withColumn("weight", F.col("size")), ["band"], "weight", total).join(reps.select("doc_id", "planes"), "doc_id")

    maybe = _links(buckets, crowded, ["band"], p).distinct()
    clusters = durable(_with_roots(components(maybe, "candidates")), "clusters")
    # full sets are made again for clustered documents only
    sizes = durable(clusters.groupBy("root").agg(F.count("*").alias("size")), "sizes")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(clusters.select("doc_id"), "doc_id", "left_semi")
    sets = durable(shingle_sets(texts, p).where(F.length("shingles") > 0).dropDuplicates(["doc_id", "shingles"]), "sets")

    def full(roots: DataFrame) -> DataFrame:
        chosen = reps.join(with_keys(clusters, roots.withColumn("weight", F.col("size")), ["root"], "weight"), "doc_id")
        return chosen.select("root", "doc_id", "planes", "size").dropDuplicates(["doc_id", "planes"]).join(sets, "doc_id")

    links = _links(full, sizes, ["root"], p)
    # copies of one set, and rows of one id, link as well
    same = with_keys(real.select("doc_id", "set_a", "set_b"), firsts, ["set_a", "set_b"], "n").where("doc_id <> rep").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    found = components(links.unionByName(same), "links")
    for done in (firsts, crowded, clusters, sizes, sets):  # the result reads the signatures and the components
        remove(spark, done)
    return signed.join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"), F.coalesce("root", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept")
    )


def deduplicated(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose document stands for its class: its smallest doc_id. Rows without
    doc_id stay."""
    gone = near_duplicates(docs, p).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def _with_roots(found: DataFrame) -> DataFrame:
    """Adds the roots themselves as members."""
    return found.unionByName(found.select(F.col("root").alias("doc_id"), "root").distinct())
