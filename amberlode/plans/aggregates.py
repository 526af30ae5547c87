"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from amberlode.functions import facts as FF
from amberlode.plans.fixtures import ASSERTIONS_SQL, ENTITIES_SQL, REVIEWED_SQL, assertions, places, reviewed
from amberlode.plans.registry import query

A = f"WITH {ASSERTIONS_SQL}"
E = f"WITH {ENTITIES_SQL}"


@query("a1_totals", f"""WITH {REVIEWED_SQL} SELECT metric, n FROM (
  SELECT 'documents' AS metric, count(*) AS n FROM reviewed UNION ALL SELECT 'unverified', count(*) FROM reviewed WHERE status = 'unverified' UNION ALL SELECT 'rejected', count(*) FROM reviewed WHERE status = 'rejected'
  UNION ALL SELECT 'tier_1', count(*) FROM reviewed WHERE tier = 1 UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'errors', count(*) FROM events WHERE event_type = 'error')""")
def _(t):
    """All counts of a table in one aggregate over it, then turned to rows."""
    d = reviewed(t).agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "unverified").alias("unverified"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.count_if(F.col("tier") == 1).alias("tier_1"))
    e = t("events").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"))
    p = t("pages").agg(F.count("*").alias("pages"))
    rows = [df.unpivot([], df.columns, "metric", "n") for df in (d, e, p)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("a2_status_counts", f"WITH {REVIEWED_SQL} SELECT status, lang, count(*) AS n FROM reviewed GROUP BY status, lang")
def _(t):
    return reviewed(t).groupBy("status", "lang").agg(F.count("*").alias("n"))


@query("a3_sums", "SELECT coalesce(sum(n_chars), 0)::BIGINT AS chars, coalesce(sum(CASE WHEN lang = 'xx' THEN n_chars END), 0)::BIGINT AS none FROM documents")
def _(t):
    return t("documents").agg(F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.when(F.col("lang") == "xx", F.col("n_chars"))), F.lit(0)).alias("none"))


@query("a4_counters", f"{A} SELECT entity_id, count(*) AS facts, count(DISTINCT source_id) AS sources FROM assertions GROUP BY entity_id")
def _(t):
    return assertions(t).groupBy("entity_id").agg(F.count("*").alias("facts"), F.countDistinct("source_id").alias("sources"))


@query("a5_sources_per_fact", f"{A} SELECT entity_id, property, value, count(*) FILTER (WHERE status <> 'rejected') AS sources_count FROM assertions GROUP BY entity_id, property, value")
def _(t):
    return assertions(t).groupBy("entity_id", "property", "value").agg(F.count_if(F.col("status") != "rejected").alias("sources_count"))


@query("a6_zero_fill", "WITH kinds AS (SELECT unnest(['click', 'error', 'purchase', 'refund', 'view']) AS kind) SELECT kind, count(event_id) AS n FROM kinds LEFT JOIN events ON event_type = kind GROUP BY kind")
def _(t):
    n = t("events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    kinds = n.sparkSession.createDataFrame([(x,) for x in ("click", "error", "purchase", "refund", "view")], "kind string")
    return kinds.join(n, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@query("a7_page_facets", "SELECT lang, count(*) AS n FROM (SELECT lang FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100) GROUP BY lang")
def _(t):
    return t("documents").select("doc_id", "lang", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(100).groupBy("lang").agg(F.count("*").alias("n"))


@query("a8_region_panel", f"""{E}, r AS (SELECT CAST(split_part(path, '/', 2) AS BIGINT) AS region, type, id, name FROM places WHERE type IN ('village', 'port')),
n AS (SELECT region, type, count(*) AS n FROM r GROUP BY ALL), f AS (SELECT region, type, id FROM r QUALIFY row_number() OVER (PARTITION BY region, type ORDER BY name, id) <= 12)
SELECT f.region, f.type, n, f.id FROM f JOIN n ON n.region = f.region AND n.type = f.type""")
def _(t):
    """Count per domain and its first twelve by name: one window pass gives both."""
    r = places(t).where("type IN ('village', 'port')").select(F.split("path", "/")[1].cast("long").alias("region"), "type", "id", "name")
    w = Window.partitionBy("region", "type")
    return r.select("region", "type", "id", F.count("*").over(w).alias("n"), F.row_number().over(w.orderBy("name", "id")).alias("rn")).where("rn <= 12").drop("rn")


@query("a9_sections", f"{E}, s(section, type) AS (VALUES ('land', 'village'), ('land', 'county'), ('sea', 'port'), ('all', 'village'), ('all', 'port')) SELECT section, count(*) AS n FROM places JOIN s ON s.type = places.type GROUP BY section")
def _(t):
    n = places(t).groupBy("type").agg(F.count("*").alias("n"))
    s = n.sparkSession.createDataFrame([("land", ["village", "county"]), ("sea", ["port"]), ("all", ["village", "port"])], "section string, types array<string>").select("section", F.explode("types").alias("type"))
    return n.join(F.broadcast(s), "type").groupBy("section").agg(F.sum("n").alias("n"))


@query("a10_best_status", f"""{A}, r(status, rank) AS (VALUES ('rejected', -1), ('unverified', 0), ('ai_extracted', 1), ('source_verified', 2), ('community_verified', 3), ('expert_verified', 4))
SELECT entity_id, arg_max(a.status, rank) AS best FROM assertions a JOIN r ON r.status = a.status WHERE source_id > 0 GROUP BY entity_id""")
def _(t):
    a = assertions(t).where((F.col("source_id") > 0) & (F.col("status") != "disputed"))
    return a.groupBy("entity_id").agg(F.max_by("status", FF.rank_of(F.col("status"))).alias("best"))


@query("a11_evidence", f"{A} SELECT property, value, count(DISTINCT source_id) AS evidence, CASE WHEN count(DISTINCT source_id) >= 2 THEN 'in_review' ELSE 'needs_evidence' END AS state FROM assertions GROUP BY property, value")
def _(t):
    n = F.countDistinct("source_id")
    return assertions(t).groupBy("property", "value").agg(n.alias("evidence"), F.when(n >= 2, "in_review").otherwise("needs_evidence").alias("state"))


@query("a12_next_revision", f"{A} SELECT entity_id, property, max(rev) + 1 AS next FROM (SELECT entity_id, property, row_number() OVER (PARTITION BY entity_id, property ORDER BY ts, assertion_id) AS rev FROM assertions) GROUP BY ALL")
def _(t):
    """The last revision number of a dense sequence is its count, so no sort is needed."""
    return assertions(t).groupBy("entity_id", "property").agg((F.count("*") + 1).alias("next"))


@query("a13_mean_confidence", "SELECT event_type, round(avg(CASE WHEN event_id % 6 <> 0 THEN value END) / 100, 4) AS confidence FROM events GROUP BY event_type")
def _(t):
    conf = F.when(F.col("event_id") % 6 == 0, -1.0).otherwise(F.col("value"))
    return t("events").select("event_type", conf.alias("conf")).groupBy("event_type").agg(F.round(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))) / 100, 4).alias("confidence"))


@query("a14_public_counters", f"{E} SELECT type, count(*) AS n FROM places WHERE visibility = 'published' AND merged_into_id IS NULL GROUP BY type")
def _(t):
    return places(t).where((F.col("visibility") == "published") & F.col("merged_into_id").isNull()).groupBy("type").agg(F.count("*").alias("n"))


@query("a15_snapshot", f"WITH {REVIEWED_SQL} SELECT '{{\"documents\":' || count(*) || ',\"rejected\":' || count(*) FILTER (WHERE status = 'rejected') || '}}' AS snapshot FROM reviewed")
def _(t):
    return reviewed(t).agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "rejected").alias("rejected")).select(F.to_json(F.struct("documents", "rejected")).alias("snapshot"))


@query("a16_distinct", "SELECT DISTINCT lang, source FROM documents")
def _(t):
    return t("documents").select("lang", "source").distinct()


@query("a17_ordered_strings", "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source")
def _(t):
    return t("documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("a18_nested_groups", f"{A} SELECT entity_id, property, string_agg(value, ',' ORDER BY assertion_id) AS vals FROM assertions GROUP BY ALL")
def _(t):
    g = assertions(t).groupBy("entity_id", "property").agg(F.array_sort(F.collect_list(F.struct("assertion_id", "value"))).alias("f"))
    return g.select("entity_id", "property", F.array_join(F.col("f.value"), ",").alias("vals"))


@query("a19_job_accounting", "SELECT event_type, user_id % 3 AS grp, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def _(t):
    return t("events").groupBy("event_type", (F.col("user_id") % 3).alias("grp")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 4).alias("mean"))


@query("a20_run_log", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def _(t):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t("events").select("user_id", "event_id", F.row_number().over(w).alias("rn")).where("rn <= 5").drop("rn")


@query("a21_rollup_extension", f"WITH {REVIEWED_SQL} SELECT status, lang, tier, count(*) AS n FROM reviewed GROUP BY ROLLUP (status, lang, tier)")
def _(t):
    return reviewed(t).rollup("status", "lang", "tier").agg(F.count("*").alias("n"))
