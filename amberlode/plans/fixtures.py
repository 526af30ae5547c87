"""The knowledge-base tables that the driver's tables stand for, and the same as SQL.

Coordinates, validity years and parents are integer arithmetic on keys, so that any engine computes them alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITIES_SQL = """entities AS (
  SELECT CAST(1000000 + r_regionkey AS BIGINT) AS id, 'province' AS type, r_name AS name, CAST(NULL AS BIGINT) AS parent_id, '/' || (1000000 + r_regionkey) || '/' AS path, CAST(r_regionkey AS BIGINT) AS k FROM region
  UNION ALL SELECT 2000000 + n_nationkey, 'county', n_name, 1000000 + n_regionkey, '/' || (1000000 + n_regionkey) || '/' || (2000000 + n_nationkey) || '/', n_nationkey FROM nation
  UNION ALL SELECT 10000000 + c_custkey, 'village', c_name, 2000000 + c_nationkey, '/' || (1000000 + n_regionkey) || '/' || (2000000 + c_nationkey) || '/' || (10000000 + c_custkey) || '/', c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 20000000 + s_suppkey, 'port', s_name, 2000000 + s_nationkey, '/' || (1000000 + n_regionkey) || '/' || (2000000 + s_nationkey) || '/' || (20000000 + s_suppkey) || '/', s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey
), places AS (
  SELECT *, 25 + (k * 7919 % 10000) / 1000.0::DOUBLE AS lat, 50 + (k * 104729 % 10000) / 1000.0::DOUBLE AS lng,
    CASE WHEN k % 11 = 3 THEN 'draft' ELSE 'published' END AS visibility, CASE WHEN k % 17 = 5 AND type = 'village' THEN id - 1 END AS merged_into_id FROM entities
)"""

ASSERTIONS_SQL = """assertions AS (
  SELECT event_id AS assertion_id, user_id AS entity_id, event_type AS property, CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS value,
    CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS VARCHAR) AS qualifier, event_id % 20 AS source_id, ts,
    ['rejected', 'unverified', 'disputed', 'ai_extracted', 'source_verified', 'community_verified', 'expert_verified'][CAST(event_id % 7 AS INTEGER) + 1] AS status
  FROM events
)"""

REVIEWED_SQL = """reviewed AS (
  SELECT d.doc_id, d.lang, d.source, CAST(substr(d.source, 4) AS INTEGER) % 5 + 1 AS tier,
    CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'source_verified' WHEN quality = 0 THEN 'unverified' ELSE 'ai_extracted' END AS status
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""


def places(t) -> DataFrame:
    nation = t("nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r"), "n_name")
    p, c = F.lit(1000000), F.lit(2000000)

    def path(*ids):
        return F.concat(F.lit("/"), *[x for i in ids for x in (i.cast("string"), F.lit("/"))])

    region = t("region").select((p + F.col("r_regionkey")).cast("long").alias("id"), F.lit("province").alias("type"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("parent_id"), path(p + F.col("r_regionkey")).alias("path"), F.col("r_regionkey").cast("long").alias("k"))
    county = nation.select((c + F.col("n")).alias("id"), F.lit("county").alias("type"), F.col("n_name").alias("name"), (p + F.col("r")).alias("parent_id"), path(p + F.col("r"), c + F.col("n")).alias("path"), F.col("n").alias("k"))

    def leaves(df, key, name, at, base, kind):
        joined = df.join(nation, F.col(at) == F.col("n"))
        i = F.lit(base) + F.col(key)
        return joined.select(i.cast("long").alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"), (c + F.col("n")).alias("parent_id"), path(p + F.col("r"), c + F.col("n"), i).alias("path"), F.col(key).cast("long").alias("k"))

    every = region.unionByName(county).unionByName(leaves(t("customer"), "c_custkey", "c_name", "c_nationkey", 10000000, "village")).unionByName(leaves(t("supplier"), "s_suppkey", "s_name", "s_nationkey", 20000000, "port"))
    return every.select(
        "*", (25 + (F.col("k") * 7919 % 10000) / F.lit(1000.0)).alias("lat"), (50 + (F.col("k") * 104729 % 10000) / F.lit(1000.0)).alias("lng"),
        F.when(F.col("k") % 11 == 3, "draft").otherwise("published").alias("visibility"), F.when((F.col("k") % 17 == 5) & (F.col("type") == "village"), F.col("id") - 1).alias("merged_into_id"),
    )


def assertions(t) -> DataFrame:
    statuses = F.array(*map(F.lit, ["rejected", "unverified", "disputed", "ai_extracted", "source_verified", "community_verified", "expert_verified"]))
    return t("events").select(
        F.col("event_id").alias("assertion_id"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("property"), F.floor(F.col("value") / 50).cast("string").alias("value"),
        F.floor(F.get_json_object("props", "$.k").cast("long") / 10).cast("string").alias("qualifier"), (F.col("event_id") % 20).alias("source_id"), "ts",
        F.get(statuses, (F.col("event_id") % 7).cast("int")).alias("status"),
    )


def reviewed(t) -> DataFrame:
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "source_verified").when(F.col("quality") == 0, "unverified").otherwise("ai_extracted")
    tier = (F.substring("source", 4, 10).cast("int") % 5 + 1).alias("tier")
    return t("documents").select("doc_id", "lang", "source").join(t("labels"), "doc_id", "left").select("doc_id", "lang", "source", tier, status.alias("status"))
