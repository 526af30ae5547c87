"""Facts, resolution, graph and history over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from amberlode.functions import facts as FF
from amberlode.functions import text as T
from amberlode.operators import candidates as C
from amberlode.operators import facts as O
from amberlode.operators import graph, resolve
from amberlode.plans.filters import VALID_SQL, publish_problems, servable, valid
from amberlode.plans.fixtures import ASSERTIONS_SQL, ENTITIES_SQL, assertions, places
from amberlode.plans.joins import EDGES_SQL, edges
from amberlode.plans.kernels import normal_sql
from amberlode.plans.registry import query

KEY = ["entity_id", "property", "qualifier"]
E = f"WITH {ENTITIES_SQL}"
RANK = "CASE status WHEN 'rejected' THEN -1 WHEN 'unverified' THEN 0 WHEN 'disputed' THEN 0 WHEN 'ai_extracted' THEN 1 WHEN 'source_verified' THEN 2 WHEN 'community_verified' THEN 3 ELSE 4 END"
FACTS_SQL = f"""{ASSERTIONS_SQL}, fact AS (SELECT entity_id, property, qualifier, value, arg_min(assertion_id, struct_pack(ts := ts, a := assertion_id)) AS fact_id, count(DISTINCT source_id) AS sources_count,
  arg_max(status, {RANK} * 2 + CASE WHEN status = 'disputed' THEN 0 ELSE 1 END) AS status FROM assertions GROUP BY ALL)"""


def facts(t):
    return O.corroborated(assertions(t), KEY)


@query("f1_corroborate", f"WITH {FACTS_SQL} SELECT * FROM fact")
def _(t):
    return facts(t)


@query("f2_conflicts", f"WITH {FACTS_SQL} SELECT entity_id, property, qualifier, count(*) AS n_values FROM fact WHERE status <> 'rejected' GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return O.conflicts(facts(t), KEY)


@query("f3_resolve", f"WITH {FACTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, property, qualifier ORDER BY sources_count DESC, fact_id) = 1 AS is_preferred FROM fact) SELECT fact_id, is_preferred, CASE WHEN is_preferred THEN status ELSE 'rejected' END AS status FROM r")
def _(t):
    return O.resolved(facts(t), KEY).select("fact_id", "is_preferred", "status")


@query("f4_transitions", f"WITH {ASSERTIONS_SQL}, o AS (SELECT assertion_id, source_id, status AS to_status, lag(status) OVER (PARTITION BY entity_id, property ORDER BY ts, assertion_id) AS from_status FROM assertions) SELECT assertion_id, from_status, to_status, source_id > 0 OR {RANK.replace('status', 'to_status')} < 2 AS allowed FROM o WHERE from_status IS NOT NULL AND from_status <> to_status")
def _(t):
    """The log of status changes, with whether each had the source that it needs."""
    w = Window.partitionBy("entity_id", "property").orderBy("ts", "assertion_id")
    o = assertions(t).withColumn("from_status", F.lag("status").over(w)).where("from_status IS NOT NULL AND from_status <> status")
    return o.select("assertion_id", "from_status", F.col("status").alias("to_status"), ((F.col("source_id") > 0) | (FF.rank_of(F.col("status")) < 2)).alias("allowed"))


@query("f5_revisions", f"WITH {ASSERTIONS_SQL}, o AS (SELECT *, lag(value) OVER (PARTITION BY entity_id, property, qualifier ORDER BY ts, assertion_id) AS before FROM assertions) SELECT assertion_id, before, value, row_number() OVER (PARTITION BY entity_id, property, qualifier ORDER BY ts, assertion_id)::INTEGER AS revision FROM o WHERE before IS NULL OR before <> value")
def _(t):
    return O.revisions(assertions(t), KEY).select("assertion_id", "before", "value", "revision")


@query("f6_edges", f"WITH {VALID_SQL} SELECT DISTINCT o_custkey AS subject, l_partkey AS object, year_from, year_to FROM valid JOIN orders ON o_orderkey = id JOIN lineitem ON l_orderkey = id AND l_linenumber = part")
def _(t):
    """Edges of entity-valued facts with their valid years."""
    lines = t("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("part"), F.col("l_partkey").alias("object"))
    owner = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"))
    return valid(t).join(lines, ["id", "part"]).join(owner, "id").select("subject", "object", "year_from", "year_to").distinct()


@query("f8_extract_dedup", "SELECT sha256(source || '|' || lang || '|' || text) AS extract_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return t("documents").groupBy(F.sha2(F.concat_ws("|", "source", "lang", "text"), 256).alias("extract_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("f10_admission", f"""WITH d AS (SELECT doc_id, {normal_sql("text")} AS n, text, doc_id % 30 / 10.0::DOUBLE - 0.5 AS c FROM documents), i AS (
  SELECT doc_id, 0 AS seq, 'entity' AS kind, c, CASE WHEN doc_id % 4 = 0 THEN 'unknown entity type' END AS unknown, CASE WHEN doc_id % 3 = 0 THEN 'no such quote at all' ELSE substr(text, 5, 20) END AS quote, n, 'x' AS value FROM d
  UNION ALL SELECT doc_id, 1, 'fact', c, CASE WHEN doc_id % 5 = 0 THEN 'unknown property' END, substr(text, 1, 30), n, CASE WHEN doc_id % 7 = 0 THEN '' ELSE '5' END FROM d
  UNION ALL SELECT doc_id, 2, 'relationship', NULL, CASE WHEN doc_id % 6 = 0 THEN 'unknown relation' END, substr(text, length(text) - 9, 10), n, 'x' FROM d)
SELECT doc_id AS chunk_id, CAST(seq AS INTEGER) AS seq, kind, coalesce(unknown, CASE WHEN length({normal_sql("quote")}) < 3 OR NOT contains(n, {normal_sql("quote")}) THEN 'evidence quote not found in source text' END, CASE WHEN kind = 'fact' AND value = '' THEN 'empty value' END) AS reason, CASE WHEN c IS NOT NULL THEN greatest(0, least(1, c)) END AS confidence FROM i""")
def _(t):
    """Items that a model found in every document, as JSON, each with the rule that it breaks."""
    k, text = F.col("doc_id"), F.col("text")
    sure = (k % 30 / F.lit(10.0) - 0.5).alias("confidence")
    entity = F.struct(F.when(k % 4 == 0, "alien").otherwise("village").alias("type"), F.col("lang").alias("name"), F.when(k % 3 == 0, "no such quote at all").otherwise(F.substring(text, 5, 20)).alias("evidence_quote"), sure)
    fact = F.struct(F.lit("village").alias("subject_type"), F.col("lang").alias("subject"), F.when(k % 5 == 0, "bogus").otherwise("population").alias("property"), F.when(k % 7 == 0, "").otherwise("5").alias("value"), F.substring(text, 1, 30).alias("evidence_quote"), sure)
    relation = F.struct(F.col("lang").alias("subject"), F.when(k % 6 == 0, "bogus").otherwise("located_in").alias("relation"), F.col("source").alias("object"), F.substring(text, F.length(text) - 9, F.lit(10)).alias("evidence_quote"))
    payload = F.to_json(F.struct(F.array(entity).alias("entities"), F.array(fact).alias("facts"), F.array(relation).alias("relationships")))
    chunks = t("documents").select(k.alias("chunk_id"), "text", payload.alias("payload"))
    return C.admitted(chunks, ["village", "port"], ["population"], ["located_in"]).select("chunk_id", "seq", "kind", "reason", "confidence")


@query("f12_merge", f"{E}, m AS (SELECT k AS old, merged_into_id - 10000000 AS new FROM places WHERE merged_into_id IS NOT NULL) SELECT o_orderkey, coalesce(new, o_custkey) AS owner FROM orders LEFT JOIN m ON old = o_custkey")
def _(t):
    m = places(t).where("merged_into_id IS NOT NULL").select(F.col("k").alias("old"), (F.col("merged_into_id") - 10000000).alias("new"))
    return O.repointed(t("orders").select("o_orderkey", F.col("o_custkey").alias("owner")), m, "owner")


@query("f13_alias_sync", "SELECT DISTINCT c_custkey, lower(trim(a)) AS alias FROM (SELECT c_custkey, c_name AS a FROM customer UNION ALL SELECT c_custkey, replace(c_name, '#', ' ') FROM customer UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0) WHERE trim(a) <> ''")
def _(t):
    c = t("customer").select("c_custkey", "c_name", F.replace("c_name", F.lit("#"), F.lit(" ")).alias("spaced"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    return c.unpivot("c_custkey", ["c_name", "spaced", "segment"], "field", "a").where("trim(a) <> ''").select("c_custkey", F.lower(F.trim("a")).alias("alias")).distinct()


@query("f14_fill_missing", "SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN p_brand END, ''), p_type) AS publisher FROM part")
def _(t):
    old = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.col("p_brand"))
    return t("part").select("p_partkey", O.filled(old, F.col("p_type")).alias("publisher"))


@query("f15_publish_audit", f"""{E}, {ASSERTIONS_SQL}, n AS (SELECT entity_id, count(*) AS n FROM assertions WHERE status IN ('source_verified', 'community_verified', 'expert_verified', 'disputed') AND source_id > 0 GROUP BY 1)
SELECT id, '["' || concat_ws('","', CASE WHEN visibility = 'draft' THEN 'candidate' END, CASE WHEN merged_into_id IS NOT NULL THEN 'merged' END, CASE WHEN coalesce(n, 0) < 3 THEN 'few_facts' END) || '"]' AS overridden
FROM places LEFT JOIN n ON n.entity_id = k WHERE type = 'village' AND (visibility = 'draft' OR merged_into_id IS NOT NULL OR coalesce(n, 0) < 3)""")
def _(t):
    return publish_problems(t).where("problems <> ''").select("id", F.to_json(F.split("problems", ",")).alias("overridden"))


@query("f16_csv_facts", "SELECT c_custkey, CASE WHEN v = '' THEN 'unknown' ELSE v END AS value, '{\"census_year\":\"' || y || '\"}' AS qualifiers FROM (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END AS v, 1976 + c_custkey % 3 * 10 AS y FROM customer)")
def _(t):
    v = F.when(F.col("c_custkey") % 6 == 0, F.lit(None).cast("string")).otherwise(F.floor("c_acctbal").cast("string"))
    year = (F.col("c_custkey") % 3 * 10 + 1976).cast("string")
    return t("customer").select("c_custkey", FF.value_normalized(F.lit("decimal"), v).alias("value"), F.to_json(F.create_map(F.lit("census_year"), year)).alias("qualifiers"))


#: Every nation has its name, an old name and an external id; queries are names, spellings, old names and external ids, known or not.
RES_SQL = """a AS (SELECT n_nationkey AS entity_id, n_name AS alias, false AS historical, 'Q' || n_nationkey AS ext FROM nation UNION ALL SELECT n_nationkey, 'Old ' || n_name, true, 'Q' || n_nationkey FROM nation UNION ALL SELECT n_nationkey, 'Coast', n_nationkey % 2 = 0, 'Q' || n_nationkey FROM nation WHERE n_nationkey % 6 = 1),
q AS (SELECT c_custkey AS query_id, CASE c_custkey % 5 WHEN 0 THEN lower(n_name) WHEN 1 THEN replace(n_name, '_', '') WHEN 2 THEN 'old-' || n_name WHEN 3 THEN 'coast' ELSE 'zz' || c_custkey END AS text, CASE WHEN c_custkey % 7 = 0 THEN 'Q' || (c_custkey % 40) END AS ext FROM customer JOIN nation ON n_nationkey = c_nationkey),
qn AS (SELECT query_id, ext, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS n FROM q), an AS (SELECT entity_id, historical, ext, trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')) AS n FROM a),
dec AS (SELECT DISTINCT query_id, entity_id FROM qn JOIN an ON an.ext = qn.ext), und AS (SELECT * FROM qn WHERE query_id NOT IN (SELECT query_id FROM dec)),
found AS (SELECT query_id, entity_id, max(score) AS score FROM (SELECT query_id, entity_id, 1.02 AS score FROM dec UNION ALL SELECT query_id, entity_id, CASE WHEN historical THEN 0.9 ELSE 1.0 END AS score FROM und JOIN an ON an.n = und.n
  UNION ALL SELECT query_id, entity_id, CASE WHEN historical THEN 0.88 ELSE 0.97 END FROM und JOIN an ON replace(an.n, ' ', '') = replace(und.n, ' ', '')) GROUP BY ALL)"""


def resolution_tables(t):
    n = t("nation").select(F.col("n_nationkey").cast("long").alias("entity_id"), "n_name", F.concat(F.lit("Q"), F.col("n_nationkey").cast("string")).alias("external_id"))
    alias = lambda df, name, old: df.select("entity_id", name.alias("alias"), old.alias("historical"), "external_id")
    a = alias(n, F.col("n_name"), F.lit(False)).unionByName(alias(n, F.concat(F.lit("Old "), "n_name"), F.lit(True))).unionByName(alias(n.where("entity_id % 6 = 1"), F.lit("Coast"), F.col("entity_id") % 2 == 0))
    both = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    k, name = F.col("c_custkey"), F.col("n_name")
    text = F.when(k % 5 == 0, F.lower(name)).when(k % 5 == 1, F.replace(name, F.lit("_"), F.lit(""))).when(k % 5 == 2, F.concat(F.lit("old-"), name)).when(k % 5 == 3, "coast").otherwise(F.concat(F.lit("zz"), k.cast("string")))
    external = F.when(k % 7 == 0, F.concat(F.lit("Q"), (k % 40).cast("string")))
    return both.select(k.alias("query_id"), text.alias("text"), external.alias("external_id")), a


def resolution(t, fuzzy=False):
    return resolve.candidates(*resolution_tables(t), fuzzy)


@query("e1_candidates", f"WITH {RES_SQL} SELECT query_id, CAST(entity_id AS BIGINT) AS entity_id, CAST(round(score, 4) AS DOUBLE) AS score FROM found")
def _(t):
    return resolution(t).select("query_id", "entity_id", F.round("score", 4).alias("score"))


@query("e1_candidates_fuzzy")
def _(t):
    """With fuzzy names, whose similarity has no SQL counterpart."""
    return resolution(t, True).select("query_id", "entity_id", F.round("score", 4).alias("score"))


@query("e2_context", f"WITH {RES_SQL} SELECT f.query_id, CAST(entity_id AS BIGINT) AS entity_id, CAST(round(CASE WHEN score > 1.01 THEN score ELSE least(1.0, score + CASE WHEN query_id % 2 = 0 THEN 0.04 ELSE -0.08 END + CASE WHEN query_id % 100 <= 2 THEN 0.04 WHEN query_id % 100 > 50 THEN -0.15 ELSE 0 END) END, 4) AS DOUBLE) AS score FROM found f")
def _(t):
    found = resolution(t)
    context = found.select("query_id", "entity_id", (F.col("query_id") % 2 == 0).alias("inside"), (F.col("query_id") % 100).cast("double").alias("km"))
    return resolve.adjusted(found, context).select("query_id", "entity_id", F.round("score", 4).alias("score"))


@query("e3_decisions", f"WITH {RES_SQL}, r AS (SELECT *, lead(score) OVER w AS second, row_number() OVER w AS rn FROM found WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, entity_id)) SELECT query_id, CAST(entity_id AS BIGINT) AS entity_id, CAST(round(score, 4) AS DOUBLE) AS score, CASE WHEN score >= 0.92 AND NOT coalesce(score - second < 0.03 AND score < 1.01, false) THEN 'matched' WHEN score >= 0.75 THEN 'review' ELSE 'new' END AS decision FROM r WHERE rn = 1")
def _(t):
    return resolve.decisions(resolution(t))


_DECIDED = """dd AS (SELECT query_id, entity_id, CASE WHEN score >= 0.92 AND NOT coalesce(score - second < 0.03 AND score < 1.01, false) THEN 'matched' WHEN score >= 0.75 THEN 'review' ELSE 'new' END AS decision
  FROM (SELECT *, lead(score) OVER w AS second, row_number() OVER w AS rn FROM found WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, entity_id)) WHERE rn = 1)"""


@query("f11_routing", f"""WITH {RES_SQL}, {_DECIDED}, c AS (SELECT q.query_id AS id, ['entity', 'fact', 'relationship', 'historical_name'][CAST(q.query_id // 5 % 4 AS INTEGER) + 1] AS kind, qn.n AS form, q.query_id % 3 AS source_id, CASE WHEN q.query_id % 2 = 0 THEN 'population' ELSE 'located_in' END AS key, entity_id, decision FROM q JOIN qn ON qn.query_id = q.query_id LEFT JOIN dd ON dd.query_id = q.query_id),
ev AS (SELECT form, count(DISTINCT source_id) AS evidence FROM c WHERE kind = 'entity' AND coalesce(decision, 'new') = 'new' GROUP BY form),
s AS (SELECT c.*, CASE WHEN kind = 'entity' AND coalesce(decision, 'new') = 'new' THEN ev.evidence END AS evidence, CASE WHEN kind = 'entity' THEN NULL WHEN coalesce(decision, '') <> 'matched' THEN 'subject not resolved' WHEN kind IN ('fact', 'relationship') AND key = 'population' AND entity_id % 2 = 1 THEN 'key does not apply to subject type' END AS reason FROM c LEFT JOIN ev ON ev.form = c.form)
SELECT id, CASE kind WHEN 'historical_name' THEN kind WHEN 'entity' THEN kind ELSE 'fact' END AS route, CASE WHEN kind = 'entity' THEN CASE WHEN decision = 'matched' THEN 'matched' WHEN decision = 'review' OR evidence >= 2 THEN 'in_review' ELSE 'needs_evidence' END WHEN reason IS NOT NULL THEN 'in_review' ELSE 'accepted' END AS state, reason, evidence FROM s""")
def _(t):
    """Candidates resolved, and routed by what they are and whom they name."""
    q, a = resolution_tables(t)
    k = F.col("query_id")
    kind = F.element_at(F.array(*map(F.lit, ["entity", "fact", "relationship", "historical_name"])), (F.floor(k / 5) % 4 + 1).cast("int"))
    pending = q.select(k.alias("id"), kind.alias("kind"), F.lit("county").alias("type"), T.normalize(F.col("text")).alias("normalized_form"), F.when(k % 2 == 0, "population").otherwise("located_in").alias("key"), (k % 3).alias("source_id"))
    decided = resolve.decisions(resolve.candidates(q, a, False)).select(k.alias("id"), "entity_id", "decision", F.when(F.col("entity_id") % 2 == 0, "county").otherwise("port").alias("entity_type"))
    applies = q.sparkSession.createDataFrame([("population", "county"), ("located_in", "county"), ("located_in", "port")], "key string, entity_type string")
    return C.routed(pending, decided, applies)


_KM = "2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"
#: Parts stand for entities with two names each; some have no coordinates, some are merged, some have external ids.
DUP_SQL = """d AS (SELECT p_partkey AS id, p_brand AS type, p_size AS parent_id, CASE WHEN p_partkey % 29 <> 4 THEN 25 + (p_partkey * 7919 % 10000) / 1000.0::DOUBLE END AS lat, 50 + (p_partkey * 104729 % 10000) / 1000.0::DOUBLE AS lng, CASE WHEN p_partkey % 6 = 0 THEN 'Q' || p_size END AS ext FROM part WHERE p_partkey % 13 <> 0),
n AS (SELECT DISTINCT id, c FROM (SELECT p_partkey AS id, replace(lower(p_name), ' ', '') AS c FROM part UNION ALL SELECT p_partkey, replace(lower(p_type), ' ', '') || p_size FROM part WHERE p_partkey % 4 = 0)), e AS (SELECT * FROM d JOIN n USING (id))"""


@query("e4_duplicates", f"WITH {DUP_SQL}, p AS (SELECT DISTINCT a.id AS a, b.id AS b, CASE WHEN a.lat + b.lat IS NOT NULL THEN {_KM} END AS km, a.type = b.type AS same, a.parent_id <> b.parent_id AS apart FROM e a JOIN e b ON a.c = b.c AND a.id < b.id WHERE NOT coalesce(a.ext <> b.ext, false)) SELECT a, b, CAST(round(least(0.99, 0.80 + CASE WHEN same THEN 0.05 ELSE 0 END + CASE WHEN km <= 2 THEN 0.1 ELSE 0 END - CASE WHEN apart THEN 0.15 ELSE 0 END), 4) AS DOUBLE) AS score FROM p WHERE km IS NULL OR km <= 20")
def _(t):
    k = F.col("p_partkey")
    d = t("part").select(
        k.alias("id"), F.col("p_brand").alias("type"), F.col("p_size").alias("parent_id"), F.when(k % 29 != 4, 25 + (k * 7919 % 10000) / F.lit(1000.0)).alias("lat"), (50 + (k * 104729 % 10000) / F.lit(1000.0)).alias("lng"),
        F.when(k % 6 == 0, F.concat(F.lit("Q"), F.col("p_size").cast("string"))).alias("external_id"), F.when(k % 13 == 0, k - 1).alias("merged_into_id"),
    )
    names = t("part").select(k.alias("entity_id"), F.col("p_name").alias("alias")).unionByName(t("part").where("p_partkey % 4 = 0").select(k.alias("entity_id"), F.concat("p_type", F.lit(" "), F.col("p_size").cast("string")).alias("alias")))
    return resolve.duplicates(d, names)


@query("g1_one_hop", f"WITH {EDGES_SQL}, seeds AS (SELECT unnest(range(1, 30)) AS e), pub AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') SELECT DISTINCT edge_id, e FROM edges JOIN seeds ON subject = e OR object = e WHERE fact_id IN (SELECT o_orderkey FROM pub) AND subject % 11 <> 3 AND object % 11 <> 3")
def _(t):
    x = edges(t)
    public = t("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("fact_id"))
    ids = x.select(F.col("subject").alias("id")).unionByName(x.select(F.col("object").alias("id"))).distinct().where("id % 11 <> 3")
    return graph.one_hop(x, public, ids, x.sparkSession.range(1, 30).select(F.col("id").alias("e"))).select("edge_id", "e").distinct()


@query("g2_relations", f"WITH {EDGES_SQL} SELECT DISTINCT 7 AS e, CASE WHEN subject = 7 THEN 'ordered' ELSE 'ordered_by' END AS label, CASE WHEN subject = 7 THEN object ELSE subject END AS other FROM edges WHERE subject = 7 OR object = 7")
def _(t):
    x = edges(t).where("subject = 7 OR object = 7")
    out = F.col("subject") == 7
    return x.select(F.lit(7).alias("e"), F.when(out, "ordered").otherwise("ordered_by").alias("label"), F.when(out, F.col("object")).otherwise(F.col("subject")).alias("other")).distinct()


@query("g3_place_paths", f"{E} SELECT id, path, len(string_split(path, '/')) - 3 AS depth FROM places")
def _(t):
    p = graph.paths(places(t).select("id", "parent_id"))
    return p.select("id", "path", F.col("depth").cast("long").alias("depth"))


@query("g4_closure", f"{E} SELECT id, CAST(len(string_split(path, '/')) - 3 AS INTEGER) AS depth FROM places WHERE path LIKE '/1000002/%'")
def _(t):
    p = places(t)
    return graph.closure(p.select("id", "parent_id").where("parent_id IS NOT NULL"), p.where("id = 1000002").select("id"))


@query("g5_comparison", "SELECT p_name, count(DISTINCT p_brand) AS brands, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS forms FROM part GROUP BY p_name")
def _(t):
    return t("part").groupBy("p_name").agg(F.countDistinct("p_brand").alias("brands"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("forms"))


@query("g6_current_parent", f"WITH {ASSERTIONS_SQL} SELECT entity_id, arg_max(value, CASE WHEN assertion_id % 9 = 0 THEN 1000000000 + assertion_id ELSE -assertion_id END) AS value FROM assertions WHERE property = 'view' GROUP BY entity_id")
def _(t):
    """The last preferred claim, else the first."""
    order = F.when(F.col("assertion_id") % 9 == 0, F.lit(1000000000) + F.col("assertion_id")).otherwise(-F.col("assertion_id"))
    return assertions(t).where("property = 'view'").groupBy("entity_id").agg(F.max_by("value", order).alias("value"))


MOVES = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "error"), ("click", "error")]


@query("h1_state_machine", f"""WITH moves(a, b) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in MOVES)}), o AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, before, event_type FROM o WHERE before IS NOT NULL AND before <> event_type AND NOT EXISTS (SELECT 1 FROM moves WHERE a = before AND b = event_type)""")
def _(t):
    """Illegal steps: those that the table of moves doesn't hold."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    o = t("events").select("event_id", "event_type", F.lag("event_type").over(w).alias("before")).where("before IS NOT NULL AND before <> event_type")
    moves = o.sparkSession.createDataFrame(MOVES, "before string, event_type string")
    return o.join(F.broadcast(moves), ["before", "event_type"], "left_anti").select("event_id", "before", "event_type")


@query("h2_submission_checks", f"""WITH {RES_SQL}, {_DECIDED}, top AS (SELECT query_id, array_to_string(list(entity_id ORDER BY rn), ',') AS dups FROM (SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rn FROM found) WHERE rn <= 3 GROUP BY 1)
SELECT q.query_id AS id, decision AS place_decision, coalesce(dups, '') AS dups, concat_ws(';', CASE WHEN q.query_id % 11 = 0 THEN 'no main text' END, CASE WHEN q.query_id % 13 = 0 THEN 'contributor did not consent to publication' END, CASE WHEN q.query_id % 4 = 0 AND q.query_id % 3 <> 0 AND q.query_id % 10 <> 0 THEN 'media rights unclear' END) AS issues
FROM q LEFT JOIN dd ON dd.query_id = q.query_id LEFT JOIN top ON top.query_id = q.query_id""")
def _(t):
    """What a reviewer sees of a submission: the place's resolution, up to three possible duplicates, and issues."""
    q, a = resolution_tables(t)
    k = F.col("query_id")
    found = resolve.candidates(q, a, False)
    s = q.select(k.alias("id"), F.when(k % 11 == 0, "").otherwise(F.col("text")).alias("main"), F.when(k % 4 == 0, "photo").otherwise("word").alias("kind"), (k % 13 != 0).alias("consent"), (k % 3 == 0).alias("own_work"), (k % 10 == 0).alias("license_offered"))
    out = C.submission_checks(s, resolve.decisions(found).withColumnRenamed("query_id", "id"), resolve.best(found, 3).withColumnRenamed("query_id", "id"))
    return out.select("id", "place_decision", F.array_join("possible_duplicates", ",").alias("dups"), F.array_join("issues", ";").alias("issues"))


@query("h3_layers", f"WITH {VALID_SQL} SELECT 'names' AS layer, id, part FROM valid WHERE year_from IS NOT NULL AND year_from <= 1995 AND (year_to IS NULL OR year_to >= 1995) UNION ALL SELECT 'locations', id, part FROM valid WHERE (year_from IS NULL OR year_from <= 1995) AND (year_to IS NULL OR year_to >= 1995)")
def _(t):
    """A historical name needs a first year; a location is open on both sides."""
    v = valid(t)
    to = F.col("year_to").isNull() | (F.col("year_to") >= 1995)
    names = v.where((F.col("year_from") <= 1995) & to).select(F.lit("names").alias("layer"), "id", "part")
    return names.unionByName(v.where((F.col("year_from").isNull() | (F.col("year_from") <= 1995)) & to).select(F.lit("locations").alias("layer"), "id", "part"))


@query("h4_pair_gate")
def _(t):
    """Then-and-now pairs of which both can be served."""
    s = servable(t).select("id")
    pairs = t("part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    return pairs.join(s.withColumnRenamed("id", "a"), "a", "left_semi").join(s.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")


from amberlode.plans.filters import _CONSENT, MEDIA_SQL  # noqa: E402
from amberlode.plans.registry import ORACLES  # noqa: E402

ORACLES["h4_pair_gate"] = f"WITH {MEDIA_SQL}, s AS (SELECT id FROM media m LEFT JOIN speakers s ON s.speaker_id = m.speaker_id WHERE license NOT IN ('restricted', 'unknown') AND visibility = 'published' AND (m.speaker_id IS NULL OR {_CONSENT})) SELECT x.id AS a, y.id AS b FROM s x JOIN s y ON y.id = x.id + 1"


@query("h5_research_funnel", f"WITH {FACTS_SQL}, d AS (SELECT source, count(*) AS chunks FROM documents WHERE lower(text) LIKE '%erend%' GROUP BY source), c AS (SELECT DISTINCT 'src' || (entity_id % 20) AS source FROM fact WHERE status <> 'rejected' GROUP BY entity_id, property, qualifier HAVING count(*) > 1) SELECT d.source, chunks, c.source IS NOT NULL AS has_conflict FROM d LEFT JOIN c ON c.source = d.source")
def _(t):
    chunks = t("documents").where(F.lower("text").contains("erend")).groupBy("source").agg(F.count("*").alias("chunks"))
    c = O.conflicts(facts(t), KEY).select(F.concat(F.lit("src"), (F.col("entity_id") % 20).cast("string")).alias("source"), F.lit(True).alias("hit")).distinct()
    return chunks.join(c, "source", "left").select("source", "chunks", F.col("hit").isNotNull().alias("has_conflict"))


@query("h6_variants", "SELECT p_partkey, trim(unnest(string_split(replace(p_name, ' ', ' / '), '/'))) AS form FROM part")
def _(t):
    forms = F.split(F.replace("p_name", F.lit(" "), F.lit(" / ")), "/")
    return t("part").select("p_partkey", F.explode(F.transform(forms, lambda x: F.trim(x))).alias("form"))
