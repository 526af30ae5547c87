"""Scans, sources and sinks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from amberlode.operators import graph
from amberlode.plans.fixtures import ENTITIES_SQL, places
from amberlode.plans.registry import query
from amberlode.sources import imports as I
from amberlode.sources import tables as X


@query("s1_scan", "SELECT p_partkey, p_name FROM part WHERE p_size % 10 <> 0")
def _(t):
    """A scan with the rule that deleted rows don't show."""
    deleted = F.when(F.col("p_size") % 10 == 0, F.lit("2024-01-01"))
    return t("part").where(deleted.isNull()).select("p_partkey", "p_name")


@query("s2_csv_import", """WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN 'u' || (c_custkey % 20) END AS source_uuid, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE n_name END AS place, CASE WHEN c_mktsegment <> 'BUILDING' THEN lower(c_mktsegment) END AS property, CASE WHEN c_acctbal > 0 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END AS value FROM customer JOIN nation ON n_nationkey = c_nationkey),
j AS (SELECT r.*, n_nationkey, CASE WHEN source_uuid IS NULL OR source_uuid IN ('u3', 'u4') THEN 'row has no registered source_uuid' WHEN place = '' THEN 'place is required' WHEN property IS NULL THEN 'property is required' WHEN n_nationkey % 5 = 2 THEN 'place is not resolved unambiguously' END AS reason FROM r LEFT JOIN nation ON n_name = place)
SELECT c_custkey, CAST(CASE WHEN reason IS NULL THEN n_nationkey END AS BIGINT) AS place_id, CASE WHEN reason IS NULL THEN coalesce(value, 'unknown') END AS value, reason FROM j""")
def _(t):
    """Rows of a file of place facts: registered source, required columns and an unambiguous place, or a reason."""
    c = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    k = F.col("c_custkey")
    rows = c.select(k, F.when(k % 9 != 0, F.concat(F.lit("u"), (k % 20).cast("string"))).alias("source_uuid"), F.when(k % 7 == 0, "").otherwise(F.col("n_name")).alias("place"), F.when(F.col("c_mktsegment") != "BUILDING", F.lower("c_mktsegment")).alias("property"), F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal").cast("string")).alias("value"))
    sources = c.sparkSession.range(20).where("id NOT IN (3, 4)").select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("source_uuid"))
    n = t("nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("entity_id"))
    ok, bad = I.checked(rows, "place_facts", sources, n.unionByName(n.where("entity_id % 5 = 2").withColumn("entity_id", F.col("entity_id") + 100)))
    null = lambda kind: F.lit(None).cast(kind)
    return ok.select("c_custkey", "place_id", "value", null("string").alias("reason")).unionByName(bad.select("c_custkey", null("long").alias("place_id"), null("string").alias("value"), "reason"))


@query("s3_registry", "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN bad THEN 'rejected' WHEN row_number() OVER (PARTITION BY bad, k ORDER BY p_partkey) > 1 THEN 'matched' ELSE 'accepted' END AS outcome FROM (SELECT p_partkey, p_partkey % 1000 AS k, p_size % 10 = 0 OR p_partkey % 7 = 0 AS bad FROM part)) GROUP BY outcome")
def _(t):
    e = t("part").select(
        F.col("p_partkey").alias("pos"), F.when(F.col("p_size") % 10 == 0, " ").otherwise(F.col("p_name")).alias("title"), F.when(F.col("p_partkey") % 7 == 0, "blog").otherwise("book").alias("source_type"),
        F.concat(F.lit("HTTPS://Example.org/"), (F.col("p_partkey") % 1000).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "/?utm_source=x").otherwise("")).alias("url"), F.lit(3).alias("tier"),
    )
    return X.registry(e).groupBy("outcome").agg(F.count("*").alias("n"))


@query("s4_dump", "SELECT 'Q' || c_custkey AS id, 'Q' || c_nationkey AS parent FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 5 <> 0")
def _(t):
    """Lines of a dump: prefiltered as text, then parsed."""
    c = t("customer")
    line = F.concat(
        F.lit('{"type":"item","id":"Q'), c.c_custkey.cast("string"), F.lit('","labels":{"en":{"value":"'), c.c_name, F.lit('"},"xx":{"value":"-"}},"claims":{"P17":["'),
        F.when(c.c_custkey % 5 == 0, "Q30").otherwise("Q794"), F.lit('"]'), F.when(c.c_custkey % 4 != 0, F.concat(F.lit(',"P131":["Q'), c.c_nationkey.cast("string"), F.lit('"]'))).otherwise(""), F.lit("}},"),
    )
    return X.read_dump(c.select(line.alias("value")), "Q794").select("id", F.col("parents")[0].alias("parent"))


@query("s5_linked_walk", f"WITH RECURSIVE {ENTITIES_SQL}, w AS (SELECT id, 0 AS depth FROM places WHERE id = 1000001 UNION ALL SELECT p.id, w.depth + 1 FROM w JOIN places p ON p.parent_id = w.id) SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY id")
def _(t):
    """The walk of linked data from a region downwards, over stored items instead of live ones."""
    p = places(t)
    return graph.closure(p.select("id", "parent_id").where("parent_id IS NOT NULL"), p.where("id = 1000001").select("id"))


LISTING = """<main><div id="mw-subcategories"><ul>{sub}</ul></div><div id="mw-pages"><ul>{pages}</ul></div><div id="catlinks"><a href="/wiki/Category:Root">up</a></div></main>"""


@query("s6_category_members", f"WITH {ENTITIES_SQL} SELECT 'Category:P' || p.id AS title, CAST(CASE p.type WHEN 'province' THEN 0 ELSE 1 END AS INTEGER) AS depth, (SELECT count(*) FROM places v WHERE v.parent_id = p.id AND v.type = 'village') AS pages FROM places p WHERE p.type IN ('province', 'county')")
def _(t):
    """Listings of a category tree, walked from its roots: subcategories and pages, but not the links to parents."""
    p = places(t)
    child = p.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id"), F.when(F.col("type") == "county", F.concat(F.lit('<li><a href="/wiki/Category%3AP'), F.col("id").cast("string"), F.lit('">c</a></li>'))).alias("sub"), F.when(F.col("type") == "village", F.concat(F.lit('<li><a href="/wiki/'), F.replace("name", F.lit("#"), F.lit("%23")), F.lit('">v</a></li><li><a href="/wiki/Help:X">h</a></li>'))).alias("page"))
    head, middle, tail = LISTING.replace("{sub}", "|").replace("{pages}", "|").split("|")
    html = F.concat(F.lit(head), F.array_join(F.collect_list("sub"), ""), F.lit(middle), F.array_join(F.collect_list("page"), ""), F.lit(tail))
    listings = child.groupBy("id").agg(html.alias("html")).select(F.concat(F.lit("Category:P"), F.col("id").cast("string")).alias("title"), "html")
    roots = p.where("type = 'province'").select(F.concat(F.lit("Category:P"), F.col("id").cast("string")).alias("title"))
    return I.category_tree(listings, roots).select("title", "depth", F.size("pages").cast("long").alias("pages"))


@query("s7_gallery_selection", r"""WITH f AS (SELECT CAST(substr(p_brand, 7) AS BIGINT) AS entity_id, CASE p_type WHEN 'ECONOMY' THEN NULL WHEN 'LARGE' THEN 'Old photographs of it' WHEN 'SMALL' THEN '1890s in it' WHEN 'STANDARD' THEN 'History of it' ELSE 'Maps' END AS sub, p_partkey AS pos, p_name AS file FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, sub ORDER BY pos, file) AS k FROM f WHERE sub IS NULL OR sub <> 'Maps'), c AS (SELECT * FROM r WHERE sub IS NULL OR k <= 3),
o AS (SELECT entity_id, file, arg_min(struct_pack(own := sub IS NULL, sub := sub, k := k), (CASE WHEN sub IS NULL THEN 1 ELSE 0 END) * 1000000000 + (CASE sub WHEN '1890s in it' THEN 0 WHEN 'History of it' THEN 1 ELSE 2 END) * 100000000 + k) AS o FROM c GROUP BY ALL),
p AS (SELECT entity_id, file, row_number() OVER (PARTITION BY entity_id ORDER BY o.own, o.sub DESC, o.k, file) AS place FROM o) SELECT entity_id, file, CAST(place AS INTEGER) AS place FROM p WHERE place <= 6 - entity_id % 4""")
def _(t):
    """Files of older subcategories first, each file once, and no more than an entity lacks."""
    sub = F.when(F.col("p_type") == "ECONOMY", None).when(F.col("p_type") == "LARGE", "Old photographs of it").when(F.col("p_type") == "SMALL", "1890s in it").when(F.col("p_type") == "STANDARD", "History of it").otherwise("Maps")
    files = t("part").select(F.substring("p_brand", 7, 9).cast("long").alias("entity_id"), sub.alias("subcategory"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("file"))
    return I.gallery(files, files.select("entity_id", (F.col("entity_id") % 4).alias("n")).distinct())


@query("s10_retry", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CASE event_id % 3 WHEN 0 THEN 10 * (event_id % 4) WHEN 1 THEN least(greatest(event_id % 200, 5 * (event_id % 4)), 120) END END AS wait FROM events")
def _(t):
    """How long each failed attempt waits for the next one, if there is to be one."""
    status = F.when(F.col("event_id") % 3 == 1, 503).when(F.col("event_id") % 3 == 2, 404)
    return t("events").select("event_id", I.retry_wait(status, F.col("event_id") % 4, F.col("event_id") % 200).alias("wait"))


@query("s8_fetch_gate", "SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'disabled' WHEN page_id % 7 = 0 THEN 'terms' WHEN NOT regexp_matches(url, '^https') THEN 'policy' WHEN contains(url, '/fr/') THEN 'glob' WHEN contains(url, '/de/') THEN 'robots' END AS reason FROM pages")
def _(t):
    url = F.col("url")
    reasons = [(F.col("page_id") % 11 == 0, "disabled"), (F.col("page_id") % 7 == 0, "terms"), (~url.startswith("https"), "policy"), (url.rlike("/fr/"), "glob"), (url.contains("/de/"), "robots")]
    return t("pages").select("page_id", F.coalesce(*[F.when(c, r) for c, r in reasons]).alias("reason"))


@query("s9_content_dedup", "SELECT sha256(text) AS hash, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return X.content_addressed(t("documents"), "text", "doc_id")


@query("s11_export", f"WITH {ENTITIES_SQL} SELECT p.id, count(o_orderkey) AS facts, coalesce(min(o_orderkey), 0) AS first FROM places p LEFT JOIN orders ON o_custkey = k WHERE type = 'village' GROUP BY p.id")
def _(t):
    """The nested export row of each entity, flattened for comparison."""
    facts = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("facts"))
    nested = places(t).where("type = 'village'").join(facts, "k", "left").select(F.to_json(F.struct("id", "name", F.coalesce("facts", F.array().cast("array<bigint>")).alias("facts"))).alias("row"))
    x = nested.select(F.from_json("row", "id long, name string, facts array<long>").alias("x"))
    return x.select("x.id", F.size("x.facts").cast("long").alias("facts"), F.coalesce(F.get("x.facts", F.lit(0)), F.lit(0)).alias("first"))


@query("s12_manifest", " UNION ALL ".join(f"SELECT '{x}' AS \"table\", count(*) AS n FROM {x}" for x in ("region", "nation", "customer", "supplier", "part", "orders", "documents", "pages")))
def _(t):
    return X.manifest({x: t(x) for x in ("region", "nation", "customer", "supplier", "part", "orders", "documents", "pages")})


@query("s12_listing", "SELECT 'd/' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'changed' END AS problem FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 UNION ALL SELECT 'd/x' || page_id, 'unlisted' FROM pages")
def _(t):
    """A backup's listing of hashes against the files that are there."""
    d, path = t("documents"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path")
    found = d.where("doc_id % 5 <> 0").select(path, F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    extra = t("pages").select(F.concat(F.lit("d/x"), F.col("page_id").cast("string")).alias("path"), F.sha2("html", 256).alias("sha256"))
    return I.differing(d.select(path, F.sha2("text", 256).alias("sha256")), found.unionByName(extra))


_COUNTED = ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE counter = '{c}'), 0) AS BIGINT) AS {c}" for c in I.COUNTERS[:-1])


@query("s15_report", f"WITH o AS (SELECT CASE event_type WHEN 'click' THEN 'facts_extracted' WHEN 'view' THEN 'documents_processed' WHEN 'purchase' THEN 'entities_created' WHEN 'signup' THEN 'entities_matched' END AS counter, user_id % 3 AS n, CASE WHEN event_type = 'error' THEN 'row ' || lpad(CAST(event_id AS VARCHAR), 9, '0') || ' failed' END AS message FROM events) SELECT {_COUNTED}, count(message) AS errors, (SELECT string_agg(message, ',' ORDER BY message) FROM (SELECT message FROM o WHERE message IS NOT NULL ORDER BY message LIMIT 500)) AS log FROM o")
def _(t):
    """The eleven counters of an import and its first 500 errors."""
    kind = F.col("event_type")
    counter = F.when(kind == "click", "facts_extracted").when(kind == "view", "documents_processed").when(kind == "purchase", "entities_created").when(kind == "signup", "entities_matched")
    failed = F.when(kind == "error", F.concat(F.lit("row "), F.lpad(F.col("event_id").cast("string"), 9, "0"), F.lit(" failed")))
    return I.report(t("events").select(counter.alias("counter"), (F.col("user_id") % 3).alias("n"), failed.alias("message"))).withColumn("log", F.array_join("error_log", ",")).drop("error_log")


@query("s16_html_grid", "SELECT p_partkey, r AS \"row\", h AS head, f AS form, p_name AS gloss FROM (SELECT p_partkey, p_name, 0 AS r, 'brand' AS h, p_brand AS f FROM part UNION ALL SELECT p_partkey, p_name, 0, 'type & size', p_type || ' <' || p_size || '>' FROM part WHERE p_size % 3 <> 0)")
def _(t):
    """Comparison tables of pages as (row, column, form): markup, references, unclosed cells and empty cells included."""
    size = F.when(F.col("p_size") % 3 != 0, F.concat("p_type", F.lit(" &lt;"), F.col("p_size").cast("string"), F.lit("&gt;"))).otherwise("")
    html = F.concat(F.lit('<p>x</p><TABLE class="t"><tr><th>name<th>brand<th>type &amp; size</tr>\n<tr id=a><td><a href="/x">'), "p_name", F.lit("</a></td>\n<td> <b>"), "p_brand", F.lit("</b><!-- c --></td><td>"), size, F.lit("</td></tr></TABLE>"))
    return I.columns_long(t("part").select("p_partkey", html.alias("html")), "p_partkey")


@query("s17_links", """SELECT page_id, count(DISTINCT CASE WHEN starts_with(h, '/') THEN regexp_extract(url, '^([a-z]+://[^/]+)', 1) || h ELSE h END) AS n FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"#][^"]*)"', 1)) AS h FROM pages) GROUP BY page_id""")
def _(t):
    return t("pages").select("page_id", F.size(X.links(F.col("html"), F.col("url"))).cast("long").alias("n"))


@query("s18_segments", "SELECT conv_id, turn, CAST(round(turn * 2.5 * 1000) AS BIGINT) AS start_ms, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) + 10 AS seq, trim(text) AS text FROM conversations")
def _(t):
    seq = (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")) + 10).cast("long")
    return t("conversations").select("conv_id", "turn", F.round(F.col("turn") * 2.5 * 1000).cast("long").alias("start_ms"), seq.alias("seq"), F.trim("text").alias("text"))
