"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from amberlode.functions import similarity as S
from amberlode.functions import text as T
from amberlode.operators import graph
from amberlode.plans.filters import published
from amberlode.plans.fixtures import ENTITIES_SQL, places
from amberlode.plans.registry import query

E = f"WITH {ENTITIES_SQL}"


@query("j1_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT'")
def _(t):
    return t("orders").where("o_orderpriority = '1-URGENT'").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name")


@query("j2_self_parent", f"{E} SELECT c.id, p.name AS parent FROM places c JOIN places p ON p.id = c.parent_id WHERE p.name = 'FRANCE'")
def _(t):
    p = places(t)
    parent = p.where("name = 'FRANCE'").select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    return p.join(parent, "parent_id").select("id", "parent")


@query("j3_semi_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part JOIN supplier ON s_suppkey = p_partkey % 10 + 1 WHERE s_acctbal > 0 AND p_size > 45)")
def _(t):
    good = t("part").where("p_size > 45").join(t("supplier").where("s_acctbal > 0"), F.col("s_suppkey") == F.col("p_partkey") % 10 + 1)
    return t("lineitem").join(good, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query("j4_embedding_chunk", "SELECT vec_id, d.doc_id, lang FROM embeddings JOIN documents d ON d.doc_id = vec_id WHERE label < 3 AND lang <> 'en'")
def _(t):
    return t("embeddings").where("label < 3").join(t("documents").where("lang <> 'en'"), F.col("doc_id") == F.col("vec_id")).select("vec_id", "doc_id", "lang")


@query("j5_semi_published", f"{E} SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT k FROM places WHERE type = 'village' AND visibility = 'published' AND merged_into_id IS NULL)")
def _(t):
    ids = published(places(t).where("type = 'village'")).select(F.col("k").alias("o_custkey"))
    return t("orders").join(ids, "o_custkey", "left_semi").select("o_orderkey")


@query("j6_semi", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def _(t):
    return t("documents").join(t("labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id")


@query("j7_two_hops", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 45))")
def _(t):
    lines = t("lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = t("orders").join(lines, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").join(orders, "c_custkey", "left_semi").select("c_custkey")


@query("j8_missing_embeddings", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id AND label < 5)")
def _(t):
    return t("documents").join(t("embeddings").where("label < 5").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id")


@query("j9_eager_left", "SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(t):
    return t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left").select("doc_id", "lang", "quality", "toxic")


@query("j10_with_count", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def _(t):
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t("customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


EDGES_SQL = "edges AS (SELECT o_orderkey * 10 + l_linenumber AS edge_id, o_custkey AS subject, l_partkey AS object, o_orderkey AS fact_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def edges(t):
    both = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select((F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.col("o_custkey").alias("subject"), F.col("l_partkey").alias("object"), F.col("o_orderkey").alias("fact_id"))


@query("j11_or_edges", f"WITH {EDGES_SQL}, chosen AS (SELECT unnest(range(1, 40)) AS e) SELECT DISTINCT edge_id, e FROM edges JOIN chosen ON subject = e OR object = e")
def _(t):
    chosen = t("orders").sparkSession.range(1, 40).select(F.col("id").alias("e"))
    return graph.touching(edges(t), chosen, "e").select("edge_id", "e").distinct()


@query("j12_path_join", f"{E} SELECT a.id AS ancestor, count(*) AS n FROM places d JOIN places a ON d.path LIKE '%/' || a.id || '/%' AND a.type IN ('province', 'county') GROUP BY a.id")
def _(t):
    p = places(t)
    up = p.select(F.explode(F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), lambda x: x.cast("long"))).alias("ancestor")).groupBy("ancestor").agg(F.count("*").alias("n"))
    return up.join(p.where("type IN ('province', 'county')").select(F.col("id").alias("ancestor")), "ancestor", "left_semi")


def _grams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) + 2), lambda i: substr('  ' || {x} || ' ', i, 3)))"


@query("j13_fuzzy_dice", f"""WITH n AS (SELECT DISTINCT replace(lower(p_name), ' ', '') AS c FROM part), g AS (SELECT c, {_grams('c')} AS g FROM n)
SELECT a.c AS a, b.c AS b, round(2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)), 4) AS dice FROM g a JOIN g b ON substr(a.c, 1, 2) = substr(b.c, 1, 2) AND a.c < b.c WHERE 2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) >= 0.3""")
def _(t):
    """Distinct names blocked on a two-character prefix, so a block has no more rows than it has spellings."""
    n = t("part").select(T.compact(F.col("p_name")).alias("c")).distinct().select("c", F.substring("c", 1, 2).alias("block"), T.trigrams(F.col("c")).alias("g"))
    a, b = n.select("block", F.col("c").alias("a"), F.col("g").alias("ga")), n.select("block", F.col("c").alias("b"), F.col("g").alias("gb"))
    d = S.dice(F.col("ga"), F.col("gb"))
    return a.join(b, "block").where(F.col("a") < F.col("b")).withColumn("d", d).where("d >= 0.3").select("a", "b", F.round("d", 4).alias("dice"))


@query("n7_haversine_pairs", f"""{E} SELECT a.id AS a, b.id AS b, round(2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))), 6) AS km
FROM places a JOIN places b ON a.id < b.id AND a.type = 'village' AND b.type = 'village'
WHERE 2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) <= 5""")
def _(t):
    """Grid cells a little wider than the radius, a point joined with its own and the eight neighbouring cells."""
    p = places(t).where("type = 'village'").select("id", "lat", "lng")
    return graph.near_pairs(p, 5.0)


_KM = "2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(v.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(v.lat)) * pow(sin(radians(v.lng - c.lng) / 2), 2))))"


@query("j14_spatial_join", f"{E} SELECT c.id AS county, v.id AS village, round({_KM}, 6) AS km FROM places c JOIN places v ON c.type = 'county' AND v.type = 'village' AND {_KM} <= 60")
def _(t):
    """Villages within sixty kilometres of a county's point, whoever their parent is: an equality on cells, then the distance."""
    p = places(t)
    c = p.where("type = 'county'").select(F.col("id").alias("county"), "lat", "lng")
    v = p.where("type = 'village'").select(F.col("id").alias("village"), "lat", "lng")
    return graph.near(c, v, 60.0, []).select("county", "village", F.round("d", 6).alias("km"))


@query("j17_polymorphic", "SELECT 'customer' AS ref_type, c_custkey AS ref_id, c_name AS label FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part")
def _(t):
    """References (type, id): one typed equality join per type."""
    refs = t("customer").select(F.lit("customer").alias("ref_type"), F.col("c_custkey").alias("ref_id"))
    refs = refs.unionByName(t("supplier").select(F.lit("supplier").alias("ref_type"), F.col("s_suppkey").alias("ref_id"))).unionByName(t("part").select(F.lit("part").alias("ref_type"), F.col("p_partkey").alias("ref_id")))
    parts = [
        refs.where(F.col("ref_type") == kind).join(t(kind).select(F.col(key).alias("ref_id"), F.col(name).alias("label")), "ref_id")
        for kind, key, name in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("ref_type", "ref_id", "label")


@query("j18_union_path", f"{E}, {EDGES_SQL} SELECT k FROM places WHERE type = 'village' AND (parent_id = 2000006 OR k IN (SELECT subject FROM edges WHERE object < 20))")
def _(t):
    v = places(t).where("type = 'village'")
    by_edge = v.join(edges(t).where("object < 20").select(F.col("subject").alias("k")), "k", "left_semi")
    return v.where("parent_id = 2000006").select("k").unionByName(by_edge.select("k")).distinct()


@query("j19_follow_merges", f"""WITH RECURSIVE {ENTITIES_SQL}, f AS (SELECT id, id AS target, 0 AS hops FROM places UNION ALL SELECT f.id, p.merged_into_id, hops + 1 FROM f JOIN places p ON p.id = f.target WHERE p.merged_into_id IS NOT NULL AND hops < 10)
SELECT id, arg_max(target, hops) AS target FROM f GROUP BY id""")
def _(t):
    return graph.follow_merges(places(t).select("id", "merged_into_id"))
