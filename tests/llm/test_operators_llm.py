"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty
tables and extra columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from amberlode.llm import ann, bpe, bpe_tree, html_main, license_scan, line_dedup, near_dedup, packing, quality, secret_scan
from amberlode.llm import queries as Q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rows string, h string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def docs(spark, texts, ids=None, source="s"):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", source, len(t or ""), "clash", "clash") for i, t in zip(ids, texts)], SCHEMA)


def words(r, n):
    return [f"w{r.randrange(400)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Originals, near copies, exact copies, blanks, a null and a very long text."""
    r, out = random.Random(5), []
    for _ in range(12):
        base = words(r, r.randint(3, 120))
        out.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            near = base[:]
            for _ in range(r.randint(0, max(1, len(near) // 25))):
                near[r.randrange(len(near))] = f"x{r.randrange(99)}"
            out.append("\n".join([" ".join(near[:10]), " ".join(near[10:])]))
    out += ["", "   \n", None, "one two", "One\tTWO", "a", out[0], out[0].upper(), " ".join(words(r, 30_000))]
    return out


def plain_components(texts, n=3, percent=85):
    """doc_id, set size, component, kept of the texts by id; by counting the shingles that pairs share."""
    sets, holders, common = {}, defaultdict(list), Counter()
    for i in sorted(texts):
        w = [x.encode().lower().decode() for x in re.findall(r"[^\x20\x09-\x0D]+", texts[i] or "")]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        for g in sets[i]:
            common.update((j, i) for j in holders[g])
            holders[g].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), k in common.items():
        if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return sorted((i, len(x), find(i), find(i) == i) for i, x in sets.items())


def test_near_duplicates_equal_brute_force(spark, texts):
    got = near_dedup.near_duplicates(docs(spark, texts), near_dedup.Params(shingle=3, percent=85))
    assert sorted(map(tuple, got.collect())) == plain_components(dict(enumerate(texts)))


def test_near_duplicates_of_a_whole_table_equal_brute_force(spark):
    """Every link of the generated documents, those just above the threshold included."""
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    got = Q.QUERIES["op1_minhash_near_dedup"](spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, got.collect())) == plain_components(rows)


def test_near_duplicates_in_blocks_and_without_ids(spark):
    """Groups larger than a block, rows that share an id, and rows without one."""
    base = " ".join(f"w{i}" for i in range(100))
    many = [base + f" tail{i}" for i in range(40)]
    small = near_dedup.Params(shingle=3, percent=85, block=8)
    out = near_dedup.near_duplicates(docs(spark, many + [base, base, None], [*range(40), 7, None, 50]), small).collect()
    assert Counter(r.component_id for r in out) == {0: 41, None: 1, 50: 1}
    assert sum(r.kept for r in out) == 3
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_large_groups_with_rows_far_from_the_hub_equal_brute_force(spark):
    """Chains, two classes and strays that share bands, in blocks of four: links that don't pass the hub are found."""
    r = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    t = []
    for step in range(30):  # each is close to its neighbours only
        t.append(" ".join(base))
        k = r.randrange(110)
        base[k : k + 4] = [f"y{step}_{j}" for j in range(4)]
    t += [" ".join(words(r, 100) + base[:20]) for _ in range(10)] + [" ".join(f"w{i}" for i in range(120)) + f" z{k}" for k in range(25)] + [" ".join(base * 400) + f" q{k}" for k in range(6)]
    r.shuffle(t)
    for shingle, percent in ((3, 85), (5, 80)):
        p = near_dedup.Params(shingle=shingle, percent=percent, block=4)
        got = near_dedup.near_duplicates(docs(spark, t), p).collect()
        assert sorted(map(tuple, got)) == plain_components(dict(enumerate(t)), shingle, percent)
        assert len({x.component_id for x in got}) < len(t) - 20


def test_similarity_estimate_is_close():
    p, r = near_dedup.Params(), np.random.default_rng(1)
    add, times, _ = near_dedup._functions(p)
    x = np.unique(r.integers(0, 1 << 63, 1000, dtype=np.uint64))
    y = np.unique(np.concatenate([x[:900], r.integers(0, 1 << 63, 100, dtype=np.uint64)]))
    packed = [near_dedup.pack(near_dedup.minima(s, add, times), p.bits, p.planes) for s in (x, y)]
    equal = near_dedup.equal_values(packed[0], packed[1][None], p)[0] / p.hashes
    for_real = 900 / 1100
    assert abs((equal - 2**-p.bits) / (1 - 2**-p.bits) - for_real) < 0.12
    assert near_dedup.equal_values(packed[0], packed[0][None], p)[0] == p.hashes


def test_equal_values_are_counted_exactly():
    """Over random pairs and every bit, the sign bit of a plane included."""
    p, r = near_dedup.Params(), np.random.default_rng(3)
    low = r.integers(0, 1 << p.bits, (400, p.hashes), dtype=np.uint32)
    low[1::2] = np.where(r.random((200, p.hashes)) < r.random((200, 1)), low[::2], low[1::2])
    packed = np.stack([near_dedup.pack(x, p.bits, p.planes) for x in low])
    for i in range(0, 400, 7):
        assert near_dedup.equal_values(packed[i], packed, p).tolist() == (low == low[i]).sum(axis=1).tolist()


def test_packing_keeps_every_token(spark):
    r = random.Random(2)
    lengths = [r.randint(0, 3000) for _ in range(300)] + [4096, 8192, 10_000, 0, 1]
    df = spark.createDataFrame([(i if i % 50 else None, n, "x") for i, n in enumerate(lengths)], "doc_id long, n_tokens long, shard string")
    p = packing.Params(shard_docs=100)
    out = packing.packed(df, p).collect()
    assert sum(x.piece_tokens for x in out) == sum(lengths)
    bins = defaultdict(list)
    for x in out:
        if x.bin_id is None:
            assert x.n_tokens == 0
        else:
            bins[x.bin_id].append((x.bin_start, x.piece_tokens, x.bin_size))
    for pieces in bins.values():
        pieces.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:])) and pieces[0][0] == 0
        used, size = sum(x[1] for x in pieces), pieces[0][2]
        assert used <= size and size == min(s for s in p.sizes if s >= used)
    assert sum(lengths) / sum(x[0][2] for x in bins.values()) > 0.95
    assert packing.packed(df.limit(0), p).count() == 0


def plain_packing(lengths, p):
    """The packing rule by searching lists: sizes and contents of the bins."""
    top = p.sizes[-1]
    pieces = sorted((x for n in lengths for x in [top] * (n // top) + [n % top] if x), reverse=True)
    bins = []
    for k, n in enumerate(pieces):
        fit = [b for b in bins if b[0] - sum(b[1]) >= n]
        if fit:
            min(fit, key=lambda b: b[0] - sum(b[1]))[1].append(n)
            continue
        shared = {}
        for s in p.sizes:
            if s >= n:
                free = s - n
                for x in pieces[k + 1 :]:
                    free -= x if x <= free else 0
                held = s - free
                shared[s] = p.cost(min(y for y in p.sizes if y >= held)) / held
        bins.append((max(s for s in shared if shared[s] == min(shared.values())), [n]))
    return sorted((min(s for s in p.sizes if s >= sum(c)), sorted(c)) for _, c in bins)


def least_cost(pieces, p):
    """The least cost of any packing of a few pieces."""
    if not pieces:
        return 0.0
    best, rest = float("inf"), pieces[1:]
    for mask in range(1 << len(rest)):
        with_it = [x for i, x in enumerate(rest) if mask >> i & 1]
        n = pieces[0] + sum(with_it)
        if n <= p.sizes[-1]:
            best = min(best, p.cost(min(s for s in p.sizes if s >= n)) + least_cost([x for i, x in enumerate(rest) if not mask >> i & 1], p))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_packing_equals_the_plain_rule_and_is_near_the_least_cost(seed):
    r = random.Random(seed)
    p = packing.Params(sizes=(8, 16, 32, 64), overhead=2, square=200)
    lengths = [r.choice([r.randint(1, 64), r.randint(1, 12), 0, r.randint(60, 200)]) for _ in range(r.choice([3, 20, 150]))]
    placed, sizes = packing.pack(lengths, p)
    bins = defaultdict(list)
    for item, at, k, _ in placed:
        bins[k].append(min(64, lengths[item] - at))
    assert sorted((sizes[k], sorted(c)) for k, c in bins.items()) == plain_packing(lengths, p)
    few = [r.randint(1, 40) for _ in range(7)]
    assert sum(map(p.cost, packing.pack(few, p)[1])) <= 1.25 * least_cost(few, p)


def test_several_sizes_are_opened_and_none_is_always_best():
    """Against every single size and pair of sizes, bins shrunk alike, the joint choice costs least."""
    r = random.Random(3)
    lengths = [int(r.lognormvariate(5.8, 1.2)) + 1 for _ in range(3000)]
    p = packing.Params()
    placed, sizes = packing.pack(lengths, p)
    assert min(Counter(sizes)[s] for s in (1024, 2048, 4096)) > 20
    cost = sum(map(p.cost, sizes))
    for some in [(4096,), (512, 4096), (1024, 4096), (2048, 4096)]:
        fills = Counter()
        for item, at, k, _ in packing.pack(lengths, packing.Params(sizes=some))[0]:
            fills[k] += min(4096, lengths[item] - at)
        assert cost <= sum(p.cost(min(s for s in p.sizes if s >= n)) for n in fills.values())


def test_packing_of_nulls_repeated_rows_and_empty_shards(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (1, 5), (None, 7), (None, None), (2, 0)], "doc_id long, n_tokens long")
    out = packing.packed(df).collect()
    assert sorted((x.doc_id or 0, x.n_tokens, x.bin_id is None) for x in out) == [(0, 0, True), (0, 7, False), (1, 0, True), (1, 5, False), (1, 5, False), (2, 0, True)]
    assert {x.bin_start for x in out if x.bin_id} == {0, 7, 12} and {x.bin_size for x in out if x.bin_id} == {512}


#: Characters whose class the library's regular expressions and others take differently, and their neighbours.
RARE = [f"a{chr(i)}b x" for i in (0x2FFFD, 0x30000, 0x32808, 0x3285C, 0x32988, 0x3D808, 0x3D85C, 0x3D988, 0x3E808, 0x3E85C, 0x3E988, 0x3F808, 0x3F85C, 0x3F988, 0x10FFFF)]
TRICKY = [*RARE, "", None, "a", "<|startoftext|>x<|endoftext|>", "don't DON'T", "  two  spaces ", "tab\tnew\nline", "漢字🙂é́ Σς", "12345 ²", "a" * 5000, "x\x1cy\x85z", "the cat's end.\n\nNext"]


def test_token_counts_equal_the_library(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    every = texts + TRICKY
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in every], add_special_tokens=False)]
    got = {r.doc_id: r for r in bpe.count_tokens(docs(spark, every), path).collect()}
    assert [got[i].n_tokens for i in range(len(every))] == want
    assert [got[i].n_bytes for i in range(len(every))] == [len((t or "").encode()) for t in every]
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got.values())
    assert bpe.count_tokens(docs(spark, []), path).count() == 0


def test_licenses(spark):
    t = ["x y. Licensed under the Apache License, Version 2.0.\nmore", "RELEASED under the mit license", "Released under the licence", None, "", "this work is licensed under the gnu general public license version 3"]
    out = license_scan.licenses(docs(spark, t + t[:1], [0, 1, 2, 3, 4, 5, 0])).collect()
    assert Counter((r.doc_id, r.license) for r in out) == {(0, "apache-2.0"): 2, (1, "mit"): 1, (5, "gpl-3.0"): 1}
    assert license_scan.licenses(docs(spark, [])).count() == 0


def test_license_windows_find_shifted_and_edited_templates(spark):
    base = license_scan.TEMPLATES["mit-text"].split()
    base[12] = "changed"
    t = [" ".join(words(random.Random(i), i) + base + ["end"]) for i in range(4)]
    got = license_scan.licenses(docs(spark, t)).where("license = 'mit-text'").collect()
    assert len(got) == 4 and all(0.8 <= r.containment < 1 for r in got)


def test_whole_licenses_in_very_long_texts(spark):
    r = random.Random(1)
    full = {k: v for k, v in license_scan.TEMPLATES.items() if k.endswith("-full")}
    t = [" ".join(words(r, 40_000)) + "\n" + v.upper() + " " + " ".join(words(r, 9)) for v in full.values()]
    got = defaultdict(dict)
    for x in license_scan.licenses(docs(spark, t)).collect():
        got[x.doc_id][x.license] = x.containment
    assert all(got[i][k] == 1.0 and {y for y in got[i] if y.endswith("-full")} == {k} for i, k in enumerate(full))
    with pytest.raises(ValueError):
        license_scan.licenses(docs(spark, t), license_scan.Params(most_chars=10))


def test_quality_counts_equal_brute_force(spark, texts):
    r = random.Random(3)
    every = texts + ["a b c d a b c d a b c", "x y z x y z " * 30, "l1 l1\nl1 l1\n\n \n l1 l1 #$", "% & | < >", "\n".join(" ".join(words(r, 8)) for _ in range(9))]
    got = {x.doc_id: x for x in quality.judged(docs(spark, every)).collect()}
    for i, t in enumerate(every):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(zip(w, w[1:], w[2:]))
        again = {j + k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip(SPACE)]
        want = (len(w), len("".join(w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again))
        assert tuple(got[i])[1:6] == want
        assert got[i].base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
    assert quality.judged(docs(spark, [])).count() == 0


def test_boilerplate_rejects_all_but_its_first_holder(spark):
    boiler = "\n".join(" ".join(words(random.Random(7 + i), 9)) for i in range(10))
    own = ["\n".join(" ".join(words(random.Random(100 * i + k), 10)) for k in range(8)) for i in range(30)]
    t = [boiler + f"\nshort {i}" for i in range(25)] + own
    out = {r.doc_id: r.kept for r in quality.judged(docs(spark, t)).collect()}
    assert out[0] and not any(out[i] for i in range(1, 25)) and all(out[i] for i in range(25, 55))
    assert sorted(r.doc_id for r in quality.passing(docs(spark, t)).collect()) == [0, *range(25, 55)]


def test_boilerplate_lines_leave_the_texts_however_large_the_host(spark):
    import corpus_pipeline as cp

    line = "Subscribe to our weekly newsletter"
    own = ["\n".join(" ".join(words(random.Random(1000 * i + k), 10)) for k in range(8)) for i in range(600)]
    t = [x if i >= 25 else f"{x}\n  {line.upper() if i % 2 else line} \nshort" for i, x in enumerate(own)]
    got = {r.doc_id: r for r in cp.quality_rules(spark, docs(spark, t), "").collect()}
    assert sorted(got) == list(range(600))
    assert got[0].text == t[0] and all(got[i].text == own[i] + "\nshort" for i in range(1, 25)) and all(got[i].text == own[i] for i in range(25, 600))
    assert all(r.n_chars == len(r.text) and r.h == "clash" for r in got.values())
    strict = {r.doc_id: r.text for r in quality.passing(docs(spark, t), quality.Params(spare_first=False)).collect()}
    assert strict[0] == own[0] + "\nshort" and len(strict) == 600


CLASH = ["row", "lost", "bad", "k_a", "h1", "t", "n_lines", "n_dropped", "kept_text", "spans", "_blob", "_key", "_t", "blob", "depleted"]


def clashing(spark, texts, ids=None):
    """Documents with a column for every name that an operator might use itself."""
    out = docs(spark, texts, ids)
    for c in CLASH:
        out = out.withColumn(c, F.concat(F.lit(c + " "), F.col("doc_id").cast("string"))) if c not in out.columns else out
    return out


def test_rows_without_id_or_host_and_repeated_rows_are_judged(spark):
    own = ["\n".join(" ".join(words(random.Random(500 * i + k), 10)) for k in range(8)) for i in range(30)]
    line = "a footer line that every page of the host has"
    t = [f"{x}\n{line}" for x in own]
    with_ids = docs(spark, t[:22], source=None)
    none = docs(spark, t[22:], [None] * 8, source=None)
    twice = with_ids.where("doc_id IN (3, 4)")
    got = quality.passing(with_ids.unionByName(none).unionByName(twice)).collect()
    assert Counter(r.doc_id for r in got) == {**{i: 1 for i in range(22)}, 3: 2, 4: 2, None: 8}
    assert sorted(r.text for r in got) == sorted([t[0], *own[1:], own[3], own[4]])  # the first holder keeps the line
    few = docs(spark, t[:20], source=None).unionByName(none).unionByName(twice)  # 20 documents: not over the limit
    assert sorted(r.text for r in quality.passing(few).collect()) == sorted([*t[:20], *t[22:], t[3], t[4]])


def test_nearest_neighbours(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(700, 8)).astype(np.float32)
    x[600:650] = x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, [float("nan")] * 8, 0), (1003, [1.0, None] + [0.0] * 6, 0), (1100, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, near int")
    p = ann.Params(books=4, words=16, rerank=60, code_rows=128, query_rows=3)
    got = defaultdict(list)
    for q in ann.nearest(df, F.col("vec_id") % 100 == 0, p).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.vec_id, q.score))
    assert set(got) == set(range(0, 700, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(len(d)), d)) if i != q][:10]
        hit += len({i for i, _ in found} & set(order))
        assert all(abs(s - d[i]) < 1e-12 for i, s in found) and len(found) == 10
    assert hit >= 0.9 * 70
    assert [i for i, _ in got[0]] == list(range(600, 610))  # ties to the smaller id
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0, p).count() == 0
    assert ann.nearest(df.where("vec_id IN (0, 3)"), F.col("vec_id") % 100 == 0, p).count() == 1


def test_repeated_vector_ids_are_one_candidate_at_their_least_distance(spark):
    rows = [(0, [1.0, 0.0], "a"), (0, [1.0, 0.0], "a"), (1, [1.0, 1.0], "b"), (1, [1.0, 0.5], "c"), (2, [3.0, 0.0], "d"), (None, [1.0, 0.1], "e"), (3, [], "f"), (4, [float("inf"), 0.0], "g")]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string"), F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [tuple(r) for r in out] == [(0, 1, 1, 0.5), (0, 2, 2, 2.0)]


@pytest.mark.parametrize("leaf,window,dealt", [(64, 4, 200), (1 << 13, 32, 1 << 16)])
def test_tree_encoding_equals_the_library(spark, texts, leaf, window, dealt, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    every = texts[:20] + TRICKY + ["<|endoftext|>" * 3 + "tail", "theand" * 300, " " * 300, "漢" * 400]
    codec = bpe_tree.TreeCodec(path, leaf, window)
    for t in every:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert codec.encode(t) == np.array(ids, "<u4").tobytes()
        assert codec.decode(codec.encode(t)) == library.decode(ids, skip_special_tokens=False)
    out = {r.doc_id: r for r in bpe_tree.encode_digests(docs(spark, every), path, dealt).collect()}
    assert len(out) == len(every)
    for i, t in enumerate(every):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
        assert (out[i].n_tokens, out[i].ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_line_dedup_equals_brute_force(spark):
    long = "this line is long enough to count"
    t = [f"{long}\nown {i}\n  {long.upper()}  " for i in range(4)] + [None, "", "\n", f"{long} é\n{long}", "x\n" * 5, "short line\nshort line"]
    df = docs(spark, t + t[:1], [*range(len(t)), 0]).unionByName(docs(spark, [long], [None]))
    holders = defaultdict(set)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(SPACE))
    for i, x in enumerate(t):
        for line in (x or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    want = []
    for i, x in [*enumerate(t), (0, t[0])]:
        lines = (x or "").split("\n")
        kept = [y for y in lines if not (len(holders[key(y)]) >= 3 and i < max(holders[key(y)]))]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    want.append((None, 1, 0, hashlib.sha256(long.encode()).hexdigest()))
    for p in (line_dedup.Params(), line_dedup.Params(batches=3, fanout=2), line_dedup.Params(batches=1)):
        got = [tuple(r) for r in line_dedup.line_digests(df, p).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert line_dedup.line_digests(docs(spark, [])).count() == 0


def test_line_dedup_of_very_long_texts_and_clashing_columns(spark):
    lines = [f"line number {i % 60_000} of a very long text" for i in range(120_000)]
    t = ["\n".join(lines), "\n".join(lines[:10]), "\n".join(lines[5:15]), "x"]
    got = {r.doc_id: r for r in line_dedup.cleaned(clashing(spark, t)).collect()}
    assert got[0].text == "\n".join(x for x in lines if x not in lines[5:10])
    assert [got[i].text for i in (1, 2, 3)] == ["\n".join(lines[:5]), t[2], "x"]
    assert all(r[c] == (f"{c} {i}" if c != "h" else "clash") for i, r in got.items() for c in CLASH if c not in SCHEMA)
    assert line_dedup.cleaned(clashing(spark, [])).columns == clashing(spark, []).columns


def test_line_runs_compact_and_find_what_is_new(spark):
    """More batches than fanout squared: runs of three levels, no hash in two of them, and counts of all."""
    runs = line_dedup.LineRuns(spark, 2, 3)
    want = defaultdict(list)
    for k in range(7):
        rows = [(10 * k, k, 0), (10 * k, 99, 0), (10 * k + 1, 99, 0), (10 * k + 1, 99, 0), (10 * k, k // 3, 5)]
        for d, *h in set(rows):
            want[tuple(h)].append(d)
        runs.add(spark.createDataFrame(rows, "doc_id long, h1 long, h2 long"))
    assert [len(x) for x in runs.levels] == [1, 1, 1]
    held = [(r.h1, r.h2) for run in runs._runs(runs.levels) for r in run.collect()]
    assert len(held) == len(set(held)) == len(want)
    with line_dedup._planning(spark):
        counted = sorted(map(tuple, runs.all().collect()))
    assert counted == sorted((*h, len(d), max(d)) for h, d in want.items())
    batch = spark.createDataFrame([(9, 3, 0), (9, 77, 0)], "doc_id long, h1 long, h2 long")
    assert [r.h1 for r in runs.unseen(batch).collect()] == [77]
    runs.drop()
    assert not runs.made


def test_runs_meet_without_being_moved_or_sorted_again(spark):
    runs = line_dedup.LineRuns(spark, 4, 3)
    for k in range(3):
        runs.add(spark.range(500).selectExpr(f"id + {1000 * k} AS doc_id", f"id % 70 + {10 * k} AS h1", "id % 70 AS h2"))
    with line_dedup._planning(spark):
        for df in (runs.unseen(spark.table(runs.levels[0][0])), spark.table(runs.levels[0][0]).join(spark.table(runs.repeats[0][0]).hint("merge"), ["h1", "h2"])):
            plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    runs.drop()


def test_main_text_of_held_out_pages(spark):
    trees = html_main.trained(200)
    exact = 0
    for k in range(60):
        page, want = html_main.generated(9_000_000 + k)
        exact += html_main.main_text([page.replace(html_main._MARK, "")], trees)[0] == want
    assert exact >= 54
    rows = [(1, "u", None, 1), (2, "u", "", 1), (3, None, "<p>a" * 3000, 1), (3, None, "<div>" * 3000 + "deep", 1), (4, "u", "<script>x</script>", 1)]
    out = html_main.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), trees).collect()
    assert len(out) == 5 and {r.page_id: r.text for r in out if r.page_id in (1, 2, 4)} == {1: "", 2: "", 4: ""}
    assert all(r.n_chars == len(r.text) for r in out)


HAND_WRITTEN = [
    ("""<!doctype html><title>Harbour news</title><body><div id=header><a href=/>Home</a> | <a href=/news>News</a></div>
<div class="main-content"><h1>The old harbour reopens</h1><p>After nine years of work the old harbour has reopened to fishing boats, and the first
of them came in on Tuesday morning.</p><h2>What comes next</h2><ul><li>A market hall, to open in spring.</li><li>Two more berths for larger boats.</li></ul>
<table><tr><th>Year</th><th>Boats</th></tr><tr><td>1998</td><td>41</td></tr></table></div>
<div class="sidebar"><h3>Most read</h3><ul><li><a href=/a>Storm damages pier</a><li><a href=/b>School opens</a></ul></div>
<div id="comments"><h3>3 comments</h3><div class="comment"><p>I was there on Tuesday and it was a great day for the town, well done to all.</p></div></div>
<div class="footer">&copy; 2024 Harbour News. All rights reserved.</div>""",
     ["The old harbour reopens", "After nine years of work the old harbour has reopened to fishing boats, and the first of them came in on Tuesday morning.", "What comes next", "A market hall, to open in spring.", "Two more berths for larger boats.", "Year", "Boats", "1998", "41"]),
    ("""<html><head><title>x</title><script>var a="<p>no</p>"</script><body><nav><ul><li><a href="/">Start</a></ul></nav><main><article><h1>Bread</h1><p>Mix flour &amp; water.&nbsp;Wait an hour.<p>Bake it hot.
<blockquote>Good bread takes time.</blockquote><pre>200 g flour
120 g water</pre><form><input><button>Save</button></form></article></main><aside><p>Buy our book of recipes now, with a discount for readers.</p></aside><footer><p>Contact us at the address below.</p></footer></body></html>""",
     ["Bread", "Mix flour & water. Wait an hour.", "Bake it hot.", "Good bread takes time.", "200 g flour 120 g water"]),
    ("""<html><body><div class="cookie-banner"><p>We use cookies to make this site better. Accept or leave.</p></div><section class="story"><h1>Rain at last</h1><p>It rained.</p><div class="ad">Cheap umbrellas here!</div>
<p>The fields are green again, and the river runs past the mill for the first time since May.</p></section><div class="related"><a href=1>More rain</a><a href=2>Less rain</a></div></body></html>""",
     ["Rain at last", "It rained.", "The fields are green again, and the river runs past the mill for the first time since May."]),
    ("<body><article><p>Only one paragraph stands here, and it is the whole of the article.</p></article></body>", ["Only one paragraph stands here, and it is the whole of the article."]),
]


@pytest.mark.parametrize("page,want", HAND_WRITTEN)
def test_main_text_of_pages_written_by_hand(page, want):
    assert html_main.main_text([page], html_main.trained())[0].split("\n\n") == want


def test_kept_nodes_have_kept_ancestors():
    r = np.random.default_rng(4)
    parent = [-1] + [int(r.integers(0, i)) for i in range(1, 200)]
    kept = html_main.decode(parent, r.normal(size=200))
    assert all(kept[parent[i]] for i in range(1, 200) if kept[i])


def test_repaired_markup():
    page = html_main._Page("<ul><li>a<li>b &amp; c</ul><p>x<b>y<p>z<br>w</i><table><tr><td>1<td>2</table>tail")
    assert [t for t in page.text if t] == ["a", "b & c", "xy", "z w", "1", "2", "tail"]


@pytest.mark.parametrize("page,want", [
    ("<html><head><title>t</title><meta charset=x><body><p>a<p>b", ["a", "b"]),
    ("<head><title>t</title><style>p{}</style><p>a</p>b", ["a", "b"]),
    ("<head><noscript><div>no</div></noscript><title>t</title>a <b>b</b>", ["a b"]),
    ("<head><title>t</title></head><body><p>a</p></body>", ["a"]),
    ("<div>a<svg><path>x<p>b</p>c<button>y<div>d</div></div>e", ["a", "b", "c", "d", "e"]),
    ("<div><button>x<div>y</div></button>a<svg><text>z</text></svg>b</div>", ["ab"]),
    ("<div><button>x<button>y</button> a</div>", ["a"]),
    ("<article>let <math><mi>x</mi></math> be <object data=o>a picture</object></article>", ["let x be a picture"]),
])
def test_open_and_skipped_elements(page, want):
    assert [t for t in html_main._parsed(page).text if t] == want


SECRETS = ['token = "abcdefgh12345678"', "PassWord:short x", "AKIA" + "A1" * 8 + " AKIAX", "z" + "0af9" * 10 + "g", "secret=secret=tok", None, "", "api-key: nope", "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "é🙂 apikey='0123456789abcdef0123456789abcdef'", "to\u212aen=abcdefgh1 pa\u017fsword=abcdefgh1 TOKEN=abcdefgh1"]


def test_secret_spans_equal_brute_force(spark):
    out = {r.doc_id: r for r in secret_scan.scan_digests(docs(spark, SECRETS)).collect()}
    assert len(out) == len(SECRETS)
    for i, t in enumerate(SECRETS):
        found = []
        for order, (kind, pattern, group, least) in enumerate([
            ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32),
        ]):
            found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t or "") if len(m[group]) >= least]
        text = ",".join(x[2] for x in sorted(found))
        assert out[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(out[i].spans.split(","))
    assert "pem:" in out[8].spans


def test_long_secrets_are_covered_whole(spark):
    body = "Qk1" * 40
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B"
    keys = [f"{head}\n{headers}\n\n{body}\n{end}", f"{head}\\n{body}\\n{body}\\n{end}", f"{head}\n{headers}\n\n{body}\n{body}", f"{head}\\r\\n{body}", f"{head}\n{body}\n{end}"]
    t = [f"a, {k}." for k in keys] + [f"a, db://{'u' * 90}:{'p!' * 200}@host x.", f"{keys[2]}, then {keys[0]}.", f"{head} is a mark. " * 3]
    got = {r.doc_id: r.text for r in secret_scan.redacted(docs(spark, t)).collect()}
    assert [got[i] for i in range(6)] == ["a, [pem]."] * 5 + ["a, [userinfo] x."]
    assert got[6] == "[pem], then [pem]." and got[7] == "[pem]. " * 3


def test_secrets_of_long_texts_rows_without_id_and_clashing_columns(spark):
    long = "word " * 300_000 + "token = abcdefgh12345678 " + "x " * 1000 + "AKIA" + "B2" * 8
    df = clashing(spark, [long, "plain"]).unionByName(clashing(spark, [long, None], [None, None]))
    got = secret_scan.redacted(df).collect()
    assert Counter(r.text for r in got) == {"word " * 300_000 + "[assign] " + "x " * 1000 + "[access]": 2, "plain": 1, None: 1}
    assert {r.spans for r in got} == {"spans 0", "spans 1", None} and got[0].asDict().keys() == set(df.columns)
    assert Counter(r.n_assign for r in secret_scan.scan_digests(df).collect()) == {1: 2, 0: 2}


def test_ledger_scans_only_what_is_new(spark, monkeypatch):
    ledger, rules, seen = secret_scan.Ledger(spark), secret_scan.Rules(), []
    real = secret_scan.scan
    monkeypatch.setattr(secret_scan, "scan", lambda blobs, r: (seen.append(blobs.count()), real(blobs, r))[1])
    secret_scan.scan_digests(docs(spark, SECRETS + SECRETS[:2]), rules, ledger).count()
    again = secret_scan.scan_digests(docs(spark, SECRETS + ["new token=abcdefghi"]), rules, ledger)
    assert again.where("n_assign > 0").count() == 5
    secret_scan.scan_digests(docs(spark, SECRETS[:3]), secret_scan.Rules({**secret_scan.BASE}), ledger).count()
    assert seen == [10, 1, 3]  # null and '' are one blob; another rule version scans again


def test_redaction(spark):
    out = [r.text for r in secret_scan.redacted(docs(spark, SECRETS[:1] + ["a " + SECRETS[0] + " b", None])).orderBy("doc_id").collect()]
    assert out == ['[assign]"', 'a [assign]" b', None]


def plain_quality(rows):
    """(doc_id, source, text) of the rows that pass, without boilerplate lines."""
    norm = lambda x: x.strip(SPACE).lower()
    held, first = defaultdict(set), {}
    for i, s, t in rows:
        for k in {norm(x) for x in (t or "").split("\n") if len(norm(x)) >= 20}:
            if i is not None:
                held[s, k].add(i)
            rank = (i is None, i or 0)
            if (s, k) not in first or rank < first[s, k][0]:
                first[s, k] = (rank, t)
    out = []
    for i, s, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(zip(w, w[1:], w[2:]))
        again = {j + k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lost = {k for k in {norm(x) for x in (t or "").split("\n") if len(norm(x)) >= 20} if len(held[s, k]) > 20 and first[s, k][1] != t}
        total = sum(len(k) for k in {norm(x) for x in (t or "").split("\n") if len(norm(x)) >= 20})
        if len(w) >= 50 and 2 * len(again) <= len(w) and 100 * sum(map(len, lost)) <= 70 * total:
            out.append((i, s, "\n".join(x for x in t.split("\n") if norm(x) not in lost) if lost else t))
    return out


def plain_line_dedup(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(SPACE))
    held = defaultdict(set)
    for i, _, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 20:
                held[key(x)].add(i)
    return [(i, s, t if i is None else "\n".join(x for x in t.split("\n") if not (len(held[key(x)]) >= 3 and i < max(held[key(x)])))) for i, s, t in rows]


def plain_pipeline(rows):
    rows = plain_line_dedup(plain_quality(rows))
    with_id = {i: t for i, _, t in rows if i is not None}
    roots = {i: kept for i, _, _, kept in plain_components(with_id, 5, 80)}
    rows = [r for r in rows if r[0] is None or roots[r[0]]]
    scanner = secret_scan.Scanner(secret_scan.Rules())
    rows = [(i, s, secret_scan.without(t, [dict(zip(("kind", "start", "end"), x)) for x in scanner.spans(t)])) for i, s, t in rows]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = [len(e.ids) for e in library.encode_batch([t for _, _, t in rows], add_special_tokens=False)]
    return rows, [(i or -1, n) for (i, _, _), n in zip(rows, lengths)], plain_packing(lengths, packing.Params())


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    """Boilerplate, crowded lines, near and exact copies, secrets, junk, nulls, rows without id and clashing columns."""
    import corpus_pipeline as cp

    r = random.Random(8)
    long = ["\n".join(" ".join(words(r, 12)) for _ in range(8)) for _ in range(60)]
    footer, passage = "Subscribe to our weekly newsletter today", "this passage is in a few of the documents"
    t = [f"{x}\n  {footer} " if i < 25 else x for i, x in enumerate(long)]
    t = [f"{x}\n{passage}" if 20 <= i < 24 else x for i, x in enumerate(t)]
    t += [long[50] + "\ntoken = abcdef123456", long[51], long[52].replace("w1", "v1", 1), "junk " * 60, "short", "", None, long[53] + "\nAKIA" + "A1" * 8, " ".join(words(r, 30_000))]
    df = clashing(spark, t).unionByName(clashing(spark, [long[54], long[55] + "\nsecret: abcdefgh99"], [None, None]))
    rows = [(x.doc_id, x.source, x.text) for x in df.collect()]
    want_rows, want_lengths, want_bins = plain_pipeline(rows)
    stage = df
    for name, f in cp.STAGES[:-1]:
        stage = f(spark, stage, "")
        assert stage.columns == df.columns
    got = stage.collect()
    assert sorted((x.doc_id or -1, x.text) for x in got) == sorted((i or -1, x) for i, _, x in want_rows)
    assert all(x.n_chars == len(x.text) and x.lost == (f"lost {x.doc_id}" if x.doc_id is not None else None) for x in got)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = cp.run(spark, str(tmp_path)).collect()
    pieces = {(x.doc_id or -1, x.n_tokens) for x in out}
    assert pieces == set(want_lengths)
    bins = defaultdict(list)
    for x in out:
        bins[x.bin_size, x.bin_id].append(x.piece_tokens)
    assert sorted((size, sorted(c)) for (size, _), c in bins.items()) == want_bins
    docs(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert cp.run(spark, str(tmp_path / "none")).count() == 0
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "secret_scan", "packing"]


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_queries_against_sql(spark, name):
    from tests.test_entry import compared

    compared(spark, name, Q.QUERIES[name], Q.ORACLES[name])
