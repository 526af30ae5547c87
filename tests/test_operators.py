"""Behaviour of the composed operators on small literal tables."""

import math
import random
import zlib
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from amberlode.operators import facts as O
from amberlode.operators import candidates, graph, rag, resolve, search
from amberlode.plans import catalog
from amberlode.sources import imports
from amberlode.sources import tables as X
from amberlode.streaming import jobs

KEY = ["entity_id", "property", "qualifier"]
SCHEMA = "assertion_id long, entity_id long, property string, qualifier string, value string, source_id long, status string, ts timestamp"


def assertions(spark, rows):
    t = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, 1, p, q, v, s, st, t + timedelta(hours=i)) for i, (p, q, v, s, st) in enumerate(rows)], SCHEMA)


ROWS = [("founded", "-", "1890", 1, "ai_extracted"), ("founded", "-", "1890", 2, "source_verified"), ("founded", "-", "1895", 3, "unverified"), ("people", "1976", "120", 1, "unverified"), ("people", "2016", "300", 1, "unverified")]


def test_corroboration_and_conflict_whatever_the_order(spark):
    for rows in (ROWS, ROWS[::-1]):
        f = O.corroborated(assertions(spark, rows), KEY)
        got = {r.value: (r.sources_count, r.status) for r in f.collect()}
        assert got["1890"] == (2, "source_verified") and got["1895"][0] == 1
        assert [(r.property, r.n_values) for r in O.conflicts(f, KEY).collect()] == [("founded", 2)]


def test_resolution_decisions(spark):
    a = spark.createDataFrame([(1, "Bandar Abbas", False, None), (2, "Gamron", True, None), (3, "Dehnow", False, None), (4, "Dehnow", False, "Q4")], "entity_id long, alias string, historical boolean, external_id string")
    q = spark.createDataFrame([(1, "bandar-e abbas", None), (2, "Gamron", None), (3, "Dehnow", None), (4, "Dehnow", "Q4"), (5, "Nowhere", None), (6, "Dehnow", "Q77"), (7, " - ", None)], "query_id long, text string, external_id string")
    found = resolve.candidates(q, a)
    got = {r.query_id: (r.entity_id, r.decision) for r in resolve.decisions(found).collect()}
    assert got[1] == (1, "matched") and got[2] == (2, "review") and got[3][1] == "review" and not {5, 7} & set(got)
    assert got[4] == (4, "matched") and got[6][1] == "review"  # a known external id decides alone, an unknown one nothing
    assert [(r.entity_id, r.score, r.reasons) for r in found.where("query_id = 4").collect()] == [(4, 1.02, ["external_id"])]


def test_fuzzy_names_merged_entities_and_the_ten_best(spark):
    a = spark.createDataFrame([(i, f"Minab{'a' * (i % 3)}{i:02d}", False, None) for i in range(30)] + [(50, "Mi", False, None), (60, "xMinab", False, None)], "entity_id long, alias string, historical boolean, external_id string")
    q = spark.createDataFrame([(1, "Minab0", None), (2, "Mi", None)], "query_id long, text string, external_id string")
    found = resolve.candidates(q, a)
    one = {r.entity_id for r in found.where("query_id = 1").collect()}
    assert one >= set(range(10)) and 60 not in one  # fuzzy names share their first two characters
    assert {r.entity_id for r in found.where("query_id = 2").collect()} == {50}  # and have three or more
    assert [r.rank for r in resolve.best(found).where("query_id = 1").orderBy("rank").collect()] == list(range(1, 11))
    merges = spark.createDataFrame([(i, 29) for i in range(30)], "id long, target long")
    assert {r.entity_id for r in resolve.candidates(q, a, merges=merges).where("query_id = 1").collect()} == (one - set(range(30))) | {29}


ENTITY = "id long, type string, parent_id long, lat double, lng double, external_id string, merged_into_id long"


def test_duplicates_share_any_name_and_are_not_far_apart(spark):
    e = spark.createDataFrame([(1, "village", 9, 27.1, 56.2, None, None), (2, "village", 9, 27.1001, 56.2001, None, None), (3, "village", 9, 26.0, 54.0, None, None), (4, "village", 9, 27.1, 56.2, None, 1), (5, "port", 8, None, None, "Q5", None), (6, "port", None, None, None, "Q6", None), (7, "port", None, None, None, "Q6", None)], ENTITY)
    names = [(1, "Deh"), (2, "Deh"), (3, "Deh"), (4, "Deh"), (1, "Old Port"), (5, "old-port"), (6, "Gamron"), (7, "gam ron"), (5, "Gamron"), (2, "!"), (3, "?")]
    got = {(r.a, r.b): r.score for r in resolve.duplicates(e, spark.createDataFrame(names, "entity_id long, alias string")).collect()}
    assert got == {(1, 2): 0.95, (1, 5): 0.65, (6, 7): 0.85}


@pytest.mark.parametrize("pairs, least", [(250_000, 1_000), (20, 3)])
def test_duplicates_of_common_names_equal_brute_force_and_are_spread(spark, pairs, least, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK_PAIRS", pairs, raising=False)
    monkeypatch.setattr(resolve, "BLOCK_ROWS", least, raising=False)
    r = random.Random(4)
    e = [(i, r.choice("xy"), r.choice([7, 8, None]), *r.choice([(None, 56.0), (27.0, None), *[(27 + r.random() / 2, 56 + r.random() / 2)] * 4]), r.choice([None, None, "Q1", "Q2"]), r.choice([None] * 9 + [1])) for i in range(150)]
    names = [(i, r.choice(["Deh Now", "deh-now", "Gamron", "Mi", "!"])) for i in range(150) for _ in range(3)]
    own = {i: {n.lower().replace("-", "").replace(" ", "") for k, n in names if k == i} - {"!"} for i in range(150)}

    def km(a, b):
        if None in (*a[3:5], *b[3:5]):
            return None
        la, na, lb, nb = map(math.radians, (*a[3:5], *b[3:5]))
        return 2 * 6371 * math.asin(math.sqrt(min(1, math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((nb - na) / 2) ** 2)))

    want = {}
    for a in e:
        for b in e:
            far = km(a, b)
            if a[0] < b[0] and a[6] is None and b[6] is None and own[a[0]] & own[b[0]] and (far is None or far <= 20) and not (a[5] and b[5] and a[5] != b[5]):
                apart = None not in (a[2], b[2]) and a[2] != b[2]
                want[a[0], b[0]] = round(min(0.99, 0.80 + 0.05 * (a[1] == b[1]) + 0.1 * (far is not None and far <= 2) - 0.15 * apart), 4)
    found = resolve.duplicates(spark.createDataFrame(e + e[:20], ENTITY), spark.createDataFrame(names, "entity_id long, alias string")).withColumn("part", F.spark_partition_id()).collect()
    assert sorted((x.a, x.b, x.score) for x in found) == sorted((*k, v) for k, v in want.items()) and len(want) > 2000
    if pairs == 20:  # a few names, and no task with most of their pairs
        held = Counter(x.part for x in found)
        assert max(held.values()) < len(found) / 2


def test_search_documents_hold_every_name_and_fact(spark):
    e = spark.createDataFrame([(1, "Bandar Abbas", "Hormozgan", "city", 20, None), (2, "Gamron", None, "village", 0, 1), (3, "Qeshm", "Hormozgan", "island", 0, None)], "id long, title string, parent_title string, type string, facts long, merged_into_id long")
    names = spark.createDataFrame([(1, "Bandar Abbas", False), (1, "Gamron", True), (1, "Port-Comorão", True)], "entity_id long, alias string, historical boolean")
    lines = spark.createDataFrame([(1, "population: 526648"), (3, "length: 135 km")], "entity_id long, line string")
    docs = search.documents(e, names, lines)
    one = docs.where("id = 1").first()
    assert one.aliases == "bandar abbas gamron port comorao" and one.compact_text == "bandarabbas gamron portcomorao" and one.body == "Hormozgan\npopulation: 526648" and one.boost == 2.1
    hits = lambda q: [(r.id, r.score) for r in search.search(docs, q, 5).collect()]
    assert hits("bandarabbas") == [(1, 14.7)] and hits("gamron") == [(1, 16.8)] and hits("526648") == [(1, 2.1)] and hits("") == []
    assert [x[0] for x in hits("hormozgan")] == [1, 3] and hits("portcom") == [(1, 6.3)] and hits("bandar abbas")[0][1] == 39.9
    assert [r.id for r in docs.where(search.phrases("km length")).collect()] == [3] and docs.where(search.phrases("lengt")).count() == 0


@pytest.mark.parametrize("beside", [0, 1000])
def test_mentions_by_either_way_equal_brute_force(spark, beside, monkeypatch):
    monkeypatch.setattr(resolve, "BESIDE_ROWS", beside)
    monkeypatch.setattr(rag, "BESIDE_ROWS", beside)
    r = random.Random(9)
    texts = [" ".join(r.choice("abc de fgh ij klm nop".split()) for _ in range(r.randint(0, 60))) for _ in range(30)] + ["", None, "abc"]
    names = ["abc", "ij", "de fgh", "abc de fgh ij", "abc abc", "a b", "klm nop abc", "de", "Abc", "x y z v w"]
    got = resolve.mentions(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(names)), "entity_id long, alias string"))
    want = []
    for i, t in enumerate(texts):
        for k, n in enumerate(names):
            g = n.lower()
            if len(g.replace(" ", "")) >= 3 and len(g.split()) <= 4 and f" {g} " in f" {t or ''} ":
                want.append((i, k, g, round(0.8 / sum(g == x.lower() for x in names), 4)))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50
    passages = ["de fgh ij klm nop"[: 9 + 2 * k] for k in range(5)] + [" ".join(texts[0].split()[3:12]), texts[1][5:60]]
    found = rag.quotes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(passages)), "item_id long, text string"))
    assert sorted(map(tuple, found.collect())) == sorted((i, k, t.find(p.strip())) for i, t in enumerate(texts) for k, p in enumerate(passages) if t and p.strip() in t)


def test_paths_closure_and_merges(spark):
    n = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, parent_id long")
    assert {r.id: r.path for r in graph.paths(n).collect()} == {1: "/1/", 2: "/1/2/", 3: "/1/2/3/"}
    cycle = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id long, parent_id long")
    assert {r.id: r.depth for r in graph.closure(cycle, n.where("id = 1").select("id")).collect()} == {1: 0, 2: 1, 3: 2}
    assert graph.closure(cycle, n.where("id = 9").select("id")).count() == 0
    m = spark.createDataFrame([(i, i + 1 if i < 6 else None) for i in range(1, 7)], "id long, merged_into_id long")
    assert {r.target for r in graph.follow_merges(m).collect()} == {6}


def test_no_depth_is_too_great(spark):
    """Chains longer than any round; merge pointers stop at exactly ten hops."""
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)] + [(100, 99)], "id long, parent_id long")
    got = {r.id: (r.path, r.depth) for r in graph.paths(chain).collect()}
    assert got == {i: ("/" + "".join(f"{k}/" for k in range(i + 1)), i) for i in range(40)}  # 100's parent is missing
    assert {r.id: r.depth for r in graph.closure(chain, spark.range(1)).collect()} == {i: i for i in range(40)}
    with pytest.raises(ValueError, match="2 nodes"):
        graph.paths(spark.createDataFrame([(1, None), (2, 1), (3, 4), (4, 3)], "id long, parent_id long")).collect()
    m = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(20, None), (50, 51), (51, 50)], "id long, merged_into_id long")
    got = {r.id: r.target for r in graph.follow_merges(m).collect()}
    assert got == {**{i: min(20, i + 10) for i in range(21)}, 50: 50, 51: 51}
    assert {r.id: r.target for r in graph.follow_merges(m, 3).collect()}[0] == 3


def test_near_pairs_are_complete_at_poles_and_on_both_sides_of_the_date_line(spark):
    r = random.Random(4)
    points = [(70.0, 20.0), (70.0, 20.128), (10.0, 179.99), (10.0, -179.99), (89.99, 0.0), (89.99, 180.0), (-90.0, 5.0), (-89.97, -100.0), (0.0, 180.0), (0.0, -180.0)]
    for _ in range(300):
        lat, lng = r.choice([r.uniform(-90, 90), r.uniform(84, 90), r.uniform(-1, 1)]), r.choice([r.uniform(-180, 180), r.uniform(179, 180)])
        points += [(lat, lng), (max(-90, min(90, lat + r.uniform(-0.06, 0.06))), (lng + r.uniform(-0.06, 0.06) / max(0.01, math.cos(math.radians(lat))) + 180) % 360 - 180)]
    rows = list(enumerate(points))

    def km(p, q):
        (a, b), (c, d) = (tuple(map(math.radians, x)) for x in (p, q))
        return 12742 * math.asin(math.sqrt(min(1, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    df = spark.createDataFrame([(i, *p) for i, p in rows] + [(9999, None, 1.0)], "id long, lat double, lng double")
    for radius in (5.0, 60.0):
        want = {(i, j) for i, p in rows for j, q in rows if i < j and km(p, q) <= radius}
        got = [(x.a, x.b) for x in graph.near_pairs(df, radius).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_fusion_ignores_the_order_of_lists(spark):
    rows = [("a", 1, 0), ("a", 2, 1), ("b", 2, 0), ("b", 2, 5)]
    schema = "list string, key long, rank long"
    one, two = (sorted(map(tuple, rag.fused(spark.createDataFrame(x, schema)).collect())) for x in (rows, rows[::-1]))
    assert one == two and round(one[1][1], 9) == round(1 / 62 + 1 / 61, 9)


def test_answers_must_cite_what_was_found(spark):
    df = spark.createDataFrame([("yes [1]", 2), ("no", 2), ("out [9]", 2), ("x [1]", 0)], "a string, n long")
    assert [r[0] for r in df.select(rag.gate(F.col("a"), F.col("n"))).collect()] == ["answered", "rejected_uncited", "rejected_uncited", "insufficient"]


def test_quotes_of_any_length_and_within_words(spark):
    texts = ["The old harbour of Bandar Abbas was rebuilt in 1622 by the governor.", "Old harbours", "", None, "abc", "the old the old the old", "x" * 300 + " end"]
    quotes = ["harbour", "Bandar Abbas", "arbour of Bandar Abbas was reb", "he old har", "our of Ban", "the old harbour", "old", "1622", "rebuilt in 1622 by the governor", "ab", "", None, "abc", "missing word", "e old the o", "xxxxxxxxx end", "d harbour of Band", "é"]
    schema = "{} long, text string"
    got = rag.quotes(spark.createDataFrame(list(enumerate(texts)), schema.format("doc_id")), spark.createDataFrame(list(enumerate(quotes)), schema.format("item_id")))
    plain = [[" ".join((x or "").lower().replace(".", " ").split()) for x in xs] for xs in (texts, quotes)]
    want = [(i, k, n.find(q)) for i, n in enumerate(plain[0]) for k, q in enumerate(plain[1]) if len(q) >= 3 and q in n]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 15


def test_embeddings_hold_the_whole_text(spark, tmp_path):
    r = random.Random(6)
    texts = [" ".join(f"w{r.randrange(900)}" for _ in range(300)) for _ in range(3)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0,)], "vec_id long").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = {}
    for i, t in enumerate(texts):
        sums = Counter()
        for w in t.split():
            for f, x in [("w:" + w, 1.0)] + [("c:" + f" {w} "[k : k + 3], 0.35) for k in range(len(w))]:
                h = zlib.crc32(f.encode())
                sums[h % 512] += -x if h >= 2**31 else x
        norm = math.sqrt(sum(x * x for x in sums.values()))
        want |= {(i, b): x / norm for b, x in sums.items()}
    got = {(x.doc_id, x.bucket): x.weight for x in catalog.QUERIES["n26_hash_embedding"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    found = {x.doc_id: x.buckets for x in catalog.QUERIES["v2_embed_missing"](spark, str(tmp_path)).collect()}
    assert found == {i: sum(k[0] == i for k in want) for i in (1, 2)}


def test_registry_counts(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text('{"sources":[{"title":"A","source_type":"book","url":"https://x.org/a","tier":1},{"title":"A","source_type":"book","url":"https://X.org/a/?utm_source=1","tier":1},{"title":"","source_type":"book","url":"https://x.org/b","tier":1},{"title":"C","source_type":"blog","url":"https://x.org/c","tier":1}]}')
    got = {r.outcome: r["count"] for r in X.read_registry(spark, str(p)).groupBy("outcome").count().collect()}
    assert got == {"accepted": 1, "matched": 1, "rejected": 2}


def test_csv_and_export(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_text("﻿Word , Source\n a ,1\n\n,\nb\n", encoding="utf-8")
    rows = X.read_csv(spark, str(p), ["word", "source"])
    assert sorted((r.word, r.source) for r in rows.collect()) == [("a", "1"), ("b", None)]
    X.export_jsonl(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_streams_equal_their_batch_twins(spark, tmp_path):
    a = assertions(spark, ROWS)
    src, out = str(tmp_path / "in"), []
    a.repartition(3).write.parquet(src)

    def keep(df, batch):
        out.extend(map(tuple, df.collect()))

    jobs.run_available(jobs.conflict_state(jobs.file_stream(spark, src, a.schema, 1)), keep, str(tmp_path / "cp"), "update")
    last = {r[:3]: r[3:] for r in out}
    assert last[(1, "founded", "-")] == (2, 3, True) and last[(1, "people", "1976")] == (1, 1, False)


def test_chunks_routes_hours_content_and_evidence_as_streams(spark, tmp_path):
    """Several micro-batches, a restart, a changed document, late rows and repeated contents."""
    t0 = datetime(2024, 1, 1)
    docs = [(i % 7, f"document {i % 7} has a text that is long enough, version {i // 7}. " * 3, t0 + timedelta(minutes=i)) for i in range(21)]
    schema, src, cp = "doc_id long, text string, ts timestamp", str(tmp_path / "docs"), lambda n: str(tmp_path / n)
    for k in range(3):
        spark.createDataFrame(docs[7 * k : 7 * k + 7], schema).coalesce(1).write.mode("append").parquet(src)
        for _ in range(2):  # the second run finds nothing new
            jobs.run_available(jobs.chunk_stream(jobs.file_stream(spark, src, schema, 1).select("doc_id", "text")), jobs.upsert(cp("chunks"), ["doc_id", "seq"]), cp("cp1"))
    got = {r.doc_id: r.text for r in jobs.current(spark, cp("chunks"), ["doc_id", "seq"]).collect()}
    assert got == {i: docs[14 + i][1].strip() for i in range(7)}
    seen = []
    twice = spark.createDataFrame(docs + docs[:5], schema).repartition(3)
    twice.write.parquet(cp("twice"))
    jobs.run_available(jobs.distinct_content(jobs.file_stream(spark, cp("twice"), schema, 1)), lambda df, b: seen.extend(r.hash for r in df.collect()), cp("cp2"))
    assert len(seen) == len(set(seen)) == 21
    events = spark.createDataFrame([(i, t0 + timedelta(minutes=7 * i), i % 3, ["click", "view", "purchase"][i % 3], float(i)) for i in range(120)], "event_id long, ts timestamp, user_id long, event_type string, value double")
    for part in range(4):
        events.where(f"event_id % 4 = {part}").coalesce(1).write.mode("append").parquet(cp("events"))
    hours, routes, found = {}, [], {}
    read = lambda n: jobs.file_stream(spark, cp("events"), events.schema, n)
    jobs.run_available(jobs.hourly_quality(read(9)), lambda df, b: hours.update({(r.hour, r.event_type): (r.n, r.total) for r in df.collect()}), cp("cp3"), "update")
    assert hours == {(r.hour, r.event_type): (r.n, r.total) for r in jobs.hourly_quality(events).collect()}
    jobs.run_available(jobs.routed(read(1), {"click": "fact"}), lambda df, b: routes.extend((r.event_id, r.route, r.state) for r in df.collect()), cp("cp4"))
    assert sorted(routes) == [(i, "fact" if i % 3 == 0 else "entity", "low_confidence" if i < 60 else "in_review") for i in range(120)]
    told = events.select(F.col("event_type").alias("property"), (F.col("event_id") % 5).cast("string").alias("value"), F.col("user_id").alias("source_id"))
    told.repartition(3).write.parquet(cp("told"))
    jobs.run_available(jobs.evidence(jobs.file_stream(spark, cp("told"), told.schema, 1)), lambda df, b: found.update({(r.property, r.value): (r.evidence, r.state) for r in df.collect()}), cp("cp5"), "update")
    assert found == {(r.property, r.value): (r.evidence, r.state) for r in jobs.evidence(told).collect()}


def test_kernels_in_sql(spark):
    from amberlode.functions import sql
    from amberlode.functions import text as T

    assert {"kb_normalize", "kb_compact", "kb_haversine"} <= set(sql.register(spark))
    texts = ["Bandar-e ‘Abbās", "بَندَر عبّاس", "Ça va? É! a e b ye c", "e\u0301t\u00e9", None, "", "ya'ni \\ x", "۱۲٬۳۴۵ ي ك", "می‌رود"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i")
    want = [tuple(r) for r in df.select(T.normalize(F.col("x")), T.compact(F.col("x"))).collect()]
    assert [tuple(r) for r in df.selectExpr("kb_normalize(x)", "kb_compact(x)").collect()] == want and want[0][1] == "bandarabbas"
    assert round(spark.sql("SELECT kb_haversine(27, 56, 28, 56)").first()[0], 1) == 111.2


def test_csv_kinds(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text("\ufeffPlace , Property,value,census_year,source_uuid\nQeshm,population,120,1976,s1\nQeshm,population,,1986,s1\nQeshm,,5,,s1\nMinab,population,7,,s1\nQeshm,population,9,,none\n\n,,,,\n", encoding="utf-8")
    sources = spark.createDataFrame([("s1",)], "source_uuid string")
    places = spark.createDataFrame([("Qeshm", 1), ("Minab", 2), ("Minab", 3)], "name string, entity_id long")
    ok, bad = imports.import_csv(spark, "place_facts", str(p), sources, places)
    assert sorted((r.place_id, r.value, r.census_year) for r in ok.collect()) == [(1, "120", "1976"), (1, "unknown", "1986")]
    assert Counter(r.reason for r in bad.collect()) == {"property is required": 1, "place is not resolved unambiguously": 1, "row has no registered source_uuid": 1}
    with pytest.raises(ValueError):
        imports.import_csv(spark, "songs", str(p), sources)
    for kind in imports.KINDS:
        q = tmp_path / f"{kind}.csv"
        q.write_text(",".join(imports.columns_of(kind)) + "\n" + ",".join("s1" if c == "source_uuid" else "x" for c in imports.columns_of(kind)) + "\n")
        assert imports.import_csv(spark, kind, str(q), sources)[0].count() == 1


def test_category_listings_and_trees(spark):
    one = '<div id="mw-subcategories"><ul><li><a href="/wiki/Category:Sub_A">x</a></li><li><a href="/wiki/File:No">x</a></li></ul></div><div id="mw-pages"><ul><li><a href="/wiki/An_%41rticle">a</a></li><li><a href="/wiki/Help:X">h</a></li></ul></div><div id="catlinks"><a href="/wiki/Category:Parent">p</a></div>'
    two = '<div id="mw-subcategories"><a href="/wiki/Category:Root">back</a></div><div id="mw-pages"><li class="x"><a href="/wiki/B+C">a</a></li></div></main>'
    listings = spark.createDataFrame([("Category:Root", one), ("Category:Sub_A", two)], "title string, html string")
    got = {r.title: (r.depth, r.pages) for r in imports.category_tree(listings, listings.where("title = 'Category:Root'").select("title")).collect()}
    assert got == {"Category:Root": (0, ["An Article"]), "Category:Sub_A": (1, ["B+C"])}


def test_grids_waits_and_stale_backups(spark):
    html = '<table><tr class=a><th>Word</th><th>North&nbsp;side<th>South</tr><tr><td>x<td><i>a</i> <b>b</b><td>&lt;c&gt; &amp;amp;</table><table><tr></tr></table>'
    df = spark.createDataFrame([(1, html), (2, ""), (3, None)], "id long, html string")
    assert [r[0] for r in df.where("html IS NOT NULL").orderBy("id").select(imports.grid(F.col("html"))).collect()] == [[["Word", "North side", "South"], ["x", "a b", "<c> &amp;"]], []]
    assert sorted(tuple(r)[2:] for r in imports.columns_long(df, "id").collect()) == [("North side", "a b", "x"), ("South", "<c> &amp;", "x")]
    tries = spark.createDataFrame([(None, 1, None), (None, 3, None), (429, 2, 500), (503, 2, None), (503, 1, 3), (404, 1, 9)], "s int, a int, r int")
    assert [r[0] for r in tries.select(imports.retry_wait(F.col("s"), F.col("a"), F.col("r"))).collect()] == [10, None, 120, 10, 5, None]
    runs = spark.createDataFrame([("old", datetime(2024, 1, 1)), ("new", datetime(2024, 1, 20))], "run string, made timestamp")
    assert [r.run for r in imports.stale_backups(runs, F.lit(datetime(2024, 1, 31)), 14).collect()] == ["old"]


def test_the_command_line(spark, tmp_path, capsys):
    from amberlode.__main__ import main

    main(["list"])
    assert "t1_keyword_search" in capsys.readouterr().out.split()
    main(["run", "SELECT kb_compact(n_name) AS c FROM nation", "/root/testdata/sf0.001", "--out", str(tmp_path / "o")], spark)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 25
    main(["run", "a2_group_counts" if "a2_group_counts" in catalog.QUERIES else "s1_scan", "/root/testdata/sf0.001"], spark)
    main(["export", str(tmp_path / "o"), str(tmp_path / "j")], spark)
    assert spark.read.json(str(tmp_path / "j")).count() == 25
    (tmp_path / "p.csv").write_text("text_local,source_uuid\nx,s1\n,s1\n")
    spark.createDataFrame([("s1",)], "source_uuid string").write.parquet(str(tmp_path / "s"))
    main(["import", "proverbs", str(tmp_path / "p.csv"), str(tmp_path / "s"), str(tmp_path / "i")], spark)
    assert spark.read.parquet(str(tmp_path / "i/accepted")).count() == 1 == spark.read.parquet(str(tmp_path / "i/rejected")).count()


def test_candidates_are_admitted_and_routed(spark):
    payload = (
        '{"entities":[{"type":"village","name":"Minab","evidence_quote":"near MINAB.","confidence":1.7}],"facts":[{"subject":"Minab","property":"population","value":"","evidence_quote":"near Minab"},'
        '{"subject":"Minab","property":"colour","value":"red","evidence_quote":"near Minab"}],"relationships":[{"subject":"Minab","relation":"located_in","object":"Hormozgan","evidence_quote":"in Hormozgan"}],'
        '"historical_names":[{"entity":"Minab","historical_name":"Hormuz","evidence_quote":"it"}]}'
    )
    chunks = spark.createDataFrame([(1, "A village near Minab, it is said.", payload), (2, None, payload), (3, "x", None), (4, "x", "not json")], "chunk_id long, text string, payload string")
    got = candidates.admitted(chunks, ["village"], ["population"], ["located_in"]).orderBy("chunk_id", "seq").collect()
    assert [(r.kind, r.status, r.reason) for r in got if r.chunk_id == 1] == [
        ("entity", "pending", None), ("fact", "rejected", candidates.EMPTY), ("fact", "rejected", candidates.UNKNOWN["fact"]), ("relationship", "rejected", candidates.UNQUOTED), ("historical_name", "rejected", candidates.UNQUOTED),
    ]
    assert got[0].confidence == 1.0 and {r.chunk_id for r in got} == {1, 2} and all(r.reason for r in got if r.chunk_id == 2)
    pending = spark.createDataFrame([(1, "entity", "village", "minab", None, 1), (2, "entity", "village", "minab", None, 2), (3, "entity", None, "new", None, 1), (4, "entity", None, "new", None, 1), (5, "fact", "village", "x", "population", 1), (6, "fact", "village", "y", "length", 1), (7, "fact", "village", "z", "population", 1), (8, "historical_name", None, "x", None, 1), (9, "entity", "village", "q", None, 1)], "id long, kind string, type string, normalized_form string, key string, source_id long")
    decided = spark.createDataFrame([(5, 50, "matched", "village"), (6, 50, "matched", "village"), (7, 50, "review", "village"), (8, 50, "matched", "village"), (9, 9, "matched", "village")], "id long, entity_id long, decision string, entity_type string")
    applies = spark.createDataFrame([("population", "village"), ("population", "city"), ("length", "river")], "key string, entity_type string")
    state = {r.id: (r.route, r.state, r.reason, r.evidence) for r in candidates.routed(pending, decided, applies).collect()}
    assert state == {
        1: ("entity", "in_review", None, 2), 2: ("entity", "in_review", None, 2), 3: ("entity", "needs_evidence", None, 1), 4: ("entity", "needs_evidence", None, 1), 5: ("fact", "accepted", None, None),
        6: ("fact", "in_review", candidates.UNSUITED, None), 7: ("fact", "in_review", candidates.UNRESOLVED, None), 8: ("historical_name", "accepted", None, None), 9: ("entity", "matched", None, None),
    }
