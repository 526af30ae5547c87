"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from amberlode.functions import facts as FF
from amberlode.plans.fixtures import ASSERTIONS_SQL, ENTITIES_SQL, REVIEWED_SQL, assertions, places, reviewed
from amberlode.plans.registry import query

E = f"WITH {ENTITIES_SQL}"
PUB = "visibility = 'published' AND merged_into_id IS NULL"


def published(df):
    return df.where((F.col("visibility") == "published") & F.col("merged_into_id").isNull())


@query("p1_published", f"{E} SELECT id, type, name FROM places WHERE {PUB}")
def _(t):
    return published(places(t)).select("id", "type", "name")


@query("p2_public_facts", f"WITH {ASSERTIONS_SQL} SELECT assertion_id, entity_id, status FROM assertions WHERE status IN ('source_verified', 'community_verified', 'expert_verified', 'disputed') AND source_id > 0")
def _(t):
    return assertions(t).where(FF.is_public(F.col("status"), F.col("source_id"))).select("assertion_id", "entity_id", "status")


@query("p3_of_type", f"{E}, types(key, parent) AS (VALUES ('place', NULL), ('province', 'place'), ('county', 'place'), ('village', 'settlement'), ('port', 'settlement')), chosen AS (SELECT key FROM types WHERE key = 'place' UNION SELECT key FROM types WHERE parent = 'place') SELECT id, type FROM places WHERE type IN (SELECT key FROM chosen)")
def _(t):
    """A type and its children, one level down."""
    types = places(t).sparkSession.createDataFrame([("place", None), ("province", "place"), ("county", "place"), ("village", "settlement"), ("port", "settlement")], "key string, parent string")
    chosen = types.where((F.col("key") == "place") | (F.col("parent") == "place")).select(F.col("key").alias("type"))
    return places(t).join(F.broadcast(chosen), "type", "left_semi").select("id", "type")


@query("p4_name_search", f"{E}, alias AS (SELECT id, lower(replace(name, '#', ' ')) AS a FROM places) SELECT id, name FROM places WHERE lower(name) LIKE '%an%' OR id IN (SELECT id FROM alias WHERE a LIKE 'un%')")
def _(t):
    """Contains on the name or prefix on an alias: the alias side becomes a flag, not a nested loop."""
    p = places(t)
    by_alias = p.select("id", F.lower(F.replace("name", F.lit("#"), F.lit(" "))).alias("a")).where(F.col("a").startswith("un")).select("id").distinct().withColumn("hit", F.lit(True))
    return p.join(by_alias, "id", "left").where(F.lower("name").contains("an") | F.col("hit").isNotNull()).select("id", "name")


@query("p5_place_filter", f"{E} SELECT id, path FROM places WHERE (parent_id = 1000001 OR path LIKE '%/1000001/%') AND id <> 1000001")
def _(t):
    return places(t).where(((F.col("parent_id") == 1000001) | F.col("path").contains("/1000001/")) & (F.col("id") != 1000001)).select("id", "path")


@query("p6_multi_type", f"{E} SELECT type, count(*) AS n FROM places WHERE type IN ('county', 'port') GROUP BY type")
def _(t):
    wanted = [x for x in "county,,port".split(",") if x]
    return places(t).where(F.col("type").isin(wanted)).groupBy("type").agg(F.count("*").alias("n"))


@query("p7_bbox", f"{E} SELECT id, lat, lng FROM places WHERE lat BETWEEN 27 AND 30 AND lng BETWEEN 52 AND 56")
def _(t):
    return places(t).where(F.col("lat").between(27, 30) & F.col("lng").between(52, 56)).select("id", "lat", "lng")


VALID_SQL = """valid AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE year(least(o_orderdate, l_shipdate)) END AS year_from,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE year(greatest(o_orderdate, l_shipdate)) END AS year_to, l_linenumber AS part
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey
)"""


def valid(t):
    both = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    a, b = F.year(F.least("o_orderdate", "l_shipdate")), F.year(F.greatest("o_orderdate", "l_shipdate"))
    return both.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, a).alias("year_from"), F.when(F.col("o_orderkey") % 5 != 0, b).alias("year_to"), F.col("l_linenumber").alias("part"))


@query("p8_stabbing", f"WITH {VALID_SQL} SELECT y, count(*) AS n FROM valid JOIN (SELECT unnest(range(1992, 2000)) AS y) ON (year_from IS NULL OR year_from <= y) AND (year_to IS NULL OR y <= year_to) GROUP BY y")
def _(t):
    """Open intervals that hold each year: clipped to the asked years, a row explodes to the years it holds."""
    years = F.sequence(F.greatest(F.coalesce("year_from", F.lit(1992)), F.lit(1992)).cast("long"), F.least(F.coalesce("year_to", F.lit(1999)), F.lit(1999)).cast("long"))
    inside = (F.coalesce("year_from", F.lit(1992)) <= 1999) & (F.coalesce("year_to", F.lit(1999)) >= 1992)
    return valid(t).where(inside).select(F.explode(years).alias("y")).groupBy("y").agg(F.count("*").alias("n"))


@query("p9_overlap", f"WITH {VALID_SQL} SELECT id, part FROM valid WHERE (year_from IS NULL OR year_from <= 1996) AND (year_to IS NULL OR year_to >= 1995)")
def _(t):
    return valid(t).where((F.col("year_from").isNull() | (F.col("year_from") <= 1996)) & (F.col("year_to").isNull() | (F.col("year_to") >= 1995))).select("id", "part")


@query("p10_timeline", f"WITH {VALID_SQL} SELECT id, part, year_from, year_to FROM valid WHERE (year_to >= 1996 OR year_from >= 1996) AND year_from <= 1997")
def _(t):
    """The lower end compares either year, so rows without both drop out; the upper end compares the first only."""
    f = ((F.col("year_to") >= 1996) | (F.col("year_from") >= 1996)) & (F.col("year_from") <= 1997)
    return valid(t).where(f).select("id", "part", "year_from", "year_to")


@query("p11_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') = '42'")
def _(t):
    k = F.get_json_object("props", "$.k")
    return t("events").where(k == "42").select("event_id", k.cast("long").alias("k"))


@query("p12_topic_like", "SELECT p_partkey, p_type FROM part WHERE len(list_filter(string_split(lower(p_name), ' '), lambda x: contains(x, 're'))) > 0")
def _(t):
    return t("part").where(F.exists(F.split(F.lower("p_name"), " "), lambda x: x.contains("re"))).select("p_partkey", "p_type")


@query("p13_conditional", "SELECT doc_id, lang FROM documents WHERE lang = 'fr'")
def _(t):
    lang, source = "fr", None
    df = t("documents")
    for column, value in (("lang", lang), ("source", source)):
        df = df.where(F.col(column) == value) if value is not None else df
    return df.select("doc_id", "lang")


MEDIA_SQL = """media AS (
  SELECT p_partkey AS id, ['cc0', 'cc_by', 'restricted', 'unknown', 'public_domain'][CAST(p_partkey % 5 AS INTEGER) + 1] AS license, CASE WHEN p_size % 4 = 0 THEN 'draft' ELSE 'published' END AS visibility,
    CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 12 END AS speaker_id FROM part
), speakers AS (
  SELECT k AS speaker_id, ['granted', 'granted_restricted', 'pending', 'withdrawn'][CAST(k % 4 AS INTEGER) + 1] AS consent, CASE WHEN k % 2 = 0 THEN NULL ELSE k % 3 = 0 END AS audio FROM (SELECT unnest(range(12)) AS k)
)"""


def media(t):
    names = F.array(*map(F.lit, ["cc0", "cc_by", "restricted", "unknown", "public_domain"]))
    return t("part").select(F.col("p_partkey").alias("id"), F.get(names, (F.col("p_partkey") % 5).cast("int")).alias("license"), F.when(F.col("p_size") % 4 == 0, "draft").otherwise("published").alias("visibility"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") % 12).alias("speaker_id"))


def speakers(t):
    s = F.array(*map(F.lit, ["granted", "granted_restricted", "pending", "withdrawn"]))
    return t("part").sparkSession.range(12).select(F.col("id").alias("speaker_id"), F.get(s, (F.col("id") % 4).cast("int")).alias("consent"), F.when(F.col("id") % 2 != 0, F.col("id") % 3 == 0).alias("audio"))


def licensed():
    return ~F.col("license").isin("restricted", "unknown")


def consents():
    """Granted: a scope counts unless it is ruled out; granted with restrictions: only if it is named."""
    return F.when(F.col("consent") == "granted", F.coalesce("audio", F.lit(True))).when(F.col("consent") == "granted_restricted", F.coalesce("audio", F.lit(False))).otherwise(False)


@query("p14_license_gate", f"WITH {MEDIA_SQL} SELECT id, license FROM media WHERE license NOT IN ('restricted', 'unknown')")
def _(t):
    return media(t).where(licensed()).select("id", "license")


_CONSENT = "CASE WHEN consent = 'granted' THEN coalesce(audio, true) WHEN consent = 'granted_restricted' THEN coalesce(audio, false) ELSE false END"


@query("p15_consent", f"WITH {MEDIA_SQL} SELECT CAST(speaker_id AS BIGINT) AS speaker_id, {_CONSENT} AS allowed FROM speakers")
def _(t):
    return speakers(t).select("speaker_id", consents().alias("allowed"))


@query("p16_servable", f"WITH {MEDIA_SQL} SELECT id FROM media m LEFT JOIN speakers s ON s.speaker_id = m.speaker_id WHERE license NOT IN ('restricted', 'unknown') AND visibility = 'published' AND (m.speaker_id IS NULL OR {_CONSENT})")
def _(t):
    return servable(t).select("id")


def servable(t):
    both = media(t).join(F.broadcast(speakers(t)), "speaker_id", "left")
    return both.where(licensed() & (F.col("visibility") == "published") & (F.col("speaker_id").isNull() | consents()))


@query("p17_publish_problems", f"""{E}, {ASSERTIONS_SQL}, n AS (SELECT entity_id, count(*) AS n FROM assertions WHERE status IN ('source_verified', 'community_verified', 'expert_verified', 'disputed') AND source_id > 0 GROUP BY 1)
SELECT id, concat_ws(',', CASE WHEN visibility = 'draft' THEN 'candidate' END, CASE WHEN merged_into_id IS NOT NULL THEN 'merged' END, CASE WHEN coalesce(n, 0) < 3 THEN 'few_facts' END) AS problems
FROM places LEFT JOIN n ON n.entity_id = k WHERE type = 'village'""")
def _(t):
    return publish_problems(t)


def publish_problems(t):
    n = assertions(t).where(FF.is_public(F.col("status"), F.col("source_id"))).groupBy(F.col("entity_id").alias("k")).agg(F.count("*").alias("n"))
    found = F.array(F.when(F.col("visibility") == "draft", "candidate"), F.when(F.col("merged_into_id").isNotNull(), "merged"), F.when(F.coalesce("n", F.lit(0)) < 3, "few_facts"))
    return places(t).where("type = 'village'").join(n, "k", "left").select("id", F.array_join(F.array_compact(found), ",").alias("problems"))


@query("p18_scope_relevance", f"WITH k AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM k) OR regexp_matches(lower(text), '(^|\\s)theble')")
def _(t):
    d = t("documents")
    known = t("labels").where("quality = 1").select("doc_id").distinct()
    return d.join(known, "doc_id", "left_semi").select("doc_id").unionByName(d.where(F.lower("text").rlike(r"(^|\s)theble")).select("doc_id")).distinct()


@query("p19_projection", f"{E} SELECT p.id, p.name, p.type, q.id AS parent_id, q.name AS parent_name, p.lat, p.lng FROM places p LEFT JOIN places q ON q.id = p.parent_id")
def _(t):
    """The nested summary of an entity, flattened for comparison."""
    p = places(t)
    parent = p.select(F.col("id").alias("pid"), F.col("name").alias("pname"))
    nested = p.join(parent, F.col("parent_id") == F.col("pid"), "left").select(F.struct("id", "name", "type", F.struct(F.col("pid").alias("id"), F.col("pname").alias("name")).alias("parent"), F.struct("lat", "lng").alias("point")).alias("e"))
    return nested.select("e.id", "e.name", "e.type", F.col("e.parent.id").alias("parent_id"), F.col("e.parent.name").alias("parent_name"), "e.point.lat", "e.point.lng")


@query("p20_display_name", "SELECT n_nationkey, coalesce(nullif(CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) WHEN n_nationkey % 3 = 1 THEN '' END, ''), n_name) AS name FROM nation")
def _(t):
    local = F.when(F.col("n_nationkey") % 3 == 0, F.lower("n_name")).when(F.col("n_nationkey") % 3 == 1, "")
    return t("nation").select("n_nationkey", F.coalesce(F.nullif(local, F.lit("")), F.col("n_name")).alias("name"))


@query("p21_display_value", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR) WHEN 1 THEN format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) WHEN 2 THEN CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END ELSE o_orderpriority END AS shown FROM orders")
def _(t):
    """By value type: a year, a grouped number, a boolean, or text."""
    k = F.col("o_orderkey") % 4
    shown = F.when(k == 0, F.year("o_orderdate").cast("string")).when(k == 1, F.format_number(F.floor("o_totalprice"), 0)).when(k == 2, F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no")).otherwise(F.col("o_orderpriority"))
    return t("orders").select("o_orderkey", shown.alias("shown"))


@query("p22_citation_label", "SELECT p_partkey, concat_ws('. ', p_brand || CASE WHEN p_size % 2 = 0 THEN ' (' || p_size || ')' ELSE '' END, p_name, CASE WHEN p_size % 3 = 0 THEN p_type END) AS label FROM part")
def _(t):
    dated = F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"))).otherwise(""))
    return t("part").select("p_partkey", F.concat_ws(". ", dated, "p_name", F.when(F.col("p_size") % 3 == 0, F.col("p_type"))).alias("label"))


@query("p23_breadcrumbs", f"{E} SELECT a.id, string_agg(b.name, ' > ' ORDER BY length(b.path)) AS crumbs FROM places a JOIN places b ON a.path LIKE b.path || '%' AND b.id <> a.id GROUP BY a.id")
def _(t):
    """Ancestors by exploding the path to an equality on ids, which scales where a prefix join doesn't."""
    p = places(t)
    up = p.select("id", F.posexplode(F.filter(F.split("path", "/"), lambda x: x != "")).alias("pos", "a")).where(F.col("a") != F.col("id").cast("string")).select("id", "pos", F.col("a").cast("long").alias("aid"))
    named = up.join(p.select(F.col("id").alias("aid"), "name"), "aid")
    return named.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), " > ").alias("crumbs"))


@query("p24_best_text", "SELECT doc_id, length(coalesce(CASE WHEN doc_id % 5 = 0 THEN lang END, CASE WHEN doc_id % 3 = 0 THEN source END, text)) AS n FROM documents")
def _(t):
    best = F.coalesce(F.when(F.col("doc_id") % 5 == 0, F.col("lang")), F.when(F.col("doc_id") % 3 == 0, F.col("source")), F.col("text"))
    return t("documents").select("doc_id", F.length(best).cast("long").alias("n"))


@query("p25_permission", """WITH roles AS (SELECT DISTINCT user_id, user_id % 4 AS role_id FROM events), grants AS (SELECT role_id, role_id = 0 AS admin, role_id = 2 AS may_edit FROM (SELECT unnest(range(4)) AS role_id))
SELECT user_id, bool_or(admin OR may_edit) AS allowed FROM roles JOIN grants ON grants.role_id = roles.role_id GROUP BY user_id""")
def _(t):
    roles = t("events").select("user_id", (F.col("user_id") % 4).alias("role_id")).distinct()
    grants = roles.sparkSession.range(4).select(F.col("id").alias("role_id"), (F.col("id") == 0).alias("admin"), (F.col("id") == 2).alias("may_edit"))
    return roles.join(F.broadcast(grants), "role_id").groupBy("user_id").agg(F.bool_or(F.col("admin") | F.col("may_edit")).alias("allowed"))


@query("p26_needs_ocr", "SELECT doc_id, length(trim(text)) < 40 AS needs_ocr FROM documents")
def _(t):
    return t("documents").select("doc_id", (F.length(F.trim("text")) < 40).alias("needs_ocr"))


@query("p27_property_applies", f"{E}, props(prop, types) AS (VALUES ('population', ['county', 'village']), ('note', []), ('harbour', ['port'])) SELECT prop, count(*) AS n FROM props, places WHERE len(types) = 0 OR list_contains(types, type) GROUP BY prop")
def _(t):
    """Types are counted first, so that the registry meets one row per type and not per entity."""
    kinds = places(t).groupBy("type").agg(F.count("*").alias("n"))
    props = kinds.sparkSession.createDataFrame([("population", ["county", "village"]), ("note", []), ("harbour", ["port"])], "prop string, types array<string>")
    open_to_all = kinds.sparkSession.createDataFrame([("province",), ("county",), ("village",), ("port",)], "type string").agg(F.collect_set("type").alias("all"))
    listed = props.join(F.broadcast(open_to_all)).select("prop", F.explode(F.when(F.size("types") == 0, F.col("all")).otherwise(F.col("types"))).alias("type"))
    return F.broadcast(listed).join(kinds, "type").groupBy("prop").agg(F.sum("n").alias("n"))


@query("p28_cache_key", "SELECT page_id, md5(regexp_replace(url, '\\?.*$', '') || '?' || coalesce(array_to_string(list_sort(string_split(nullif(regexp_extract(url, '\\?([^#]*)', 1), ''), '&')), '&'), '')) AS key FROM pages")
def _(t):
    query_ = F.nullif(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit(""))
    return t("pages").select("page_id", F.md5(F.concat(F.regexp_replace("url", r"\?.*$", ""), F.lit("?"), F.coalesce(F.array_join(F.array_sort(F.split(query_, "&")), "&"), F.lit("")))).alias("key"))


@query("p29_low_confidence", "SELECT event_id, value FROM events WHERE event_type = 'error' AND value / 200 < 0.6 ORDER BY value, event_id LIMIT 100")
def _(t):
    return t("events").where("event_type = 'error'").where(F.col("value") / 200 < 0.6).select("event_id", "value").orderBy("value", "event_id").limit(100)
