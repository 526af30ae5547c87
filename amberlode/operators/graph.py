"""Edges, hierarchies, merge pointers and nearness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberlode.functions import similarity as S
from amberlode.functions.text import let
from amberlode.sources.shared import durable, remove, scratch


def touching(edges: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Edges with subject or object among `chosen`: two equality joins, since an OR would plan as a nested loop."""
    a = edges.join(chosen, F.col("subject") == F.col(key))
    return a.unionByName(edges.join(chosen, F.col("object") == F.col(key))).distinct()


def follow_merges(rows: DataFrame, hops: int = 10) -> DataFrame:
    """id, target after at most `hops` merge pointers, and no more: reaches of powers of two are composed. Only entities that
    moved go on; a pointer to an unknown entity stays where it points."""
    reach = rows.where("merged_into_id IS NOT NULL").select(F.col("id").alias("p"), F.col("merged_into_id").alias("next"))

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        return first.alias("a").join(second.alias("b"), F.col("a.next") == F.col("b.p"), "left").select(F.col("a.p").alias("p"), F.coalesce("b.next", "a.next").alias("next"))

    total = None
    while hops:
        if hops & 1:
            total = reach if total is None else then(total, reach)
        hops >>= 1
        if hops:
            reach = then(reach, reach)
    moved = rows.limit(0).select(F.col("id").alias("p"), F.col("merged_into_id").alias("next")) if total is None else total
    return rows.select("id").join(moved.select(F.col("p").alias("id"), "next"), "id", "left").select("id", F.coalesce("next", "id").alias("target"))


def cells(lat: Column, lng: Column, km: float) -> tuple[Column, Column]:
    """A point's cell, and the distinct cells in which points at most `km` away can lie, as structs (band, cell).

    Bands of latitude are as high as the distance. In each, longitudes are dealt over cells that are at least as wide as
    two such points of this and the neighbouring bands can be apart: near the poles one cell goes all the way round, and
    the last cell of a band touches the first."""
    reach = math.degrees(km / S.EARTH_KM) * (1 + 1e-9) + 1e-12
    north = F.least(F.lit(90.0), F.greatest(F.lit(-90.0), lat))
    own = F.floor((north + 90) / reach).cast("long")

    def count(band: Column) -> Column:
        far = F.greatest(F.abs((band - 1) * reach - 90), F.abs((band + 2) * reach - 90))
        apart = F.lit(math.sin(min(math.pi / 2, math.radians(reach) / 2))) / F.cos(F.radians(F.least(far, F.lit(90.0))))
        width = F.degrees(2 * F.asin(F.least(apart, F.lit(1.0)))) * (1 + 1e-9)
        return F.when(far >= 90, 1).otherwise(F.greatest(F.lit(1), F.floor(360 / width))).cast("long")

    def at(n: Column) -> Column:
        return F.least(F.floor(F.pmod(lng + 180, F.lit(360.0)) / 360 * n).cast("long"), n - 1)

    def row(band: Column, *shifts: int) -> Column:
        return let(count(band), lambda n: let(at(n), lambda x: F.array(*[F.struct(band.alias("band"), F.pmod(x + j, n).alias("cell")) for j in shifts])))

    return let(own, lambda b: row(b, 0))[0], let(own, lambda b: F.array_distinct(F.concat(*[row(b + i, -1, 0, 1) for i in (-1, 0, 1)])))


def near(left: DataFrame, right: DataFrame, km: float, by: list[str], only: Column | None = None) -> DataFrame:
    """Rows of `left` and `right` (both with lat and lng, and `by`, in which they must agree) at most `km` apart: their columns
    but lat and lng, and the distance, d. `only` is a test of both sides' columns that stands before the distance."""
    a, _ = cells(F.col("lat"), F.col("lng"), km)
    _, around = cells(F.col("lat"), F.col("lng"), km)
    x = left.where("lat IS NOT NULL AND lng IS NOT NULL").withColumn("at", a).withColumnsRenamed({"lat": "alat", "lng": "alng"})
    y = right.where("lat IS NOT NULL AND lng IS NOT NULL").withColumn("at", F.explode(around)).withColumnsRenamed({"lat": "blat", "lng": "blng"})
    d = S.haversine_km(F.col("alat"), F.col("alng"), F.col("blat"), F.col("blng"))
    met = x.join(y, [*by, "at"])
    met = met if only is None else met.where(only)
    return met.withColumn("d", d).where(F.col("d") <= km).drop("at", "alat", "alng", "blat", "blng")


def near_pairs(points: DataFrame, km: float) -> DataFrame:
    """a < b, km (6 places) of points (id, lat, lng) at most `km` apart, anywhere on the globe."""
    a, b = (points.select(F.col("id").alias(x), "lat", "lng") for x in "ab")
    return near(a, b, km, []).where("a < b").select("a", "b", F.round("d", 6).alias("km"))


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """id, depth of everything below `roots` (id) by edges (id, parent_id), however deep. Each round takes only what is new,
    so cycles end, and adds its level to a table in the shared folder."""
    spark = edges.sparkSession
    path = scratch(spark, "closure")
    level = 0
    fresh = roots.select("id").distinct()
    while True:
        fresh.withColumn("depth", F.lit(level)).write.parquet(f"{path}/level={level}")
        newest = spark.read.schema("id long, depth int").parquet(f"{path}/level={level}")
        if newest.isEmpty():
            break
        found = spark.read.schema("id long, depth int").option("recursiveFileLookup", True).parquet(path)
        fresh = edges.join(newest.select(F.col("id").alias("parent_id")), "parent_id").select(F.col("id").cast("long").alias("id")).distinct().join(found.select("id"), "id", "left_anti")
        level += 1
    return spark.read.schema("id long, depth int").option("recursiveFileLookup", True).parquet(path)


def paths(nodes: DataFrame) -> DataFrame:
    """id, path, depth of adjacency rows (id, parent_id), however deep: what is known of a path is joined to what is known of
    the path above it, so that every round doubles its length. Nodes whose parent is missing have no path; a cycle raises."""
    spark = nodes.sparkSession
    own = F.concat(F.col("id").cast("string"), F.lit("/"))
    state = durable(nodes.select("id", own.alias("path"), F.lit(0).alias("depth"), F.col("parent_id").alias("up")), "paths")
    open_before = None
    while True:
        still = state.where("up IS NOT NULL").count()
        if not still:
            return state.select("id", F.concat(F.lit("/"), "path").alias("path"), "depth")
        if still == open_before:
            raise ValueError(f"{still} nodes lie on or below a cycle")
        above = state.select(F.col("id").alias("up"), F.col("path").alias("head"), F.col("depth").alias("more"), F.col("up").alias("next"))
        moved = state.where("up IS NOT NULL").join(above, "up").select("id", F.concat("head", "path").alias("path"), (F.col("depth") + F.col("more") + 1).alias("depth"), F.col("next").alias("up"))
        then = durable(state.where("up IS NULL").unionByName(moved), "paths")
        remove(spark, state)
        state, open_before = then, still


def one_hop(edges: DataFrame, public_facts: DataFrame, published: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges that touch a seed (e), whose fact is public and both of whose ends are published."""
    shown = edges.join(public_facts, "fact_id", "left_semi")
    ends = published.select(F.col("id").alias("subject"))
    shown = shown.join(ends, "subject", "left_semi").join(ends.withColumnRenamed("subject", "object"), "object", "left_semi")
    return touching(shown, seeds, "e")
