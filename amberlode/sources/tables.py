"""Readers and writers: delimited files, registries, dumps, exports and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amberlode.functions import urls as U


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a headed file: headers without byte-order mark, lower case, trimmed; cells trimmed, short rows padded, blank rows dropped."""
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE", enforceSchema=True, multiLine=True)
    named = raw.toDF(*[c.replace("\ufeff", "").strip().lower() for c in raw.columns])
    cells = [F.trim(F.col(c)).alias(c) if c in named.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return named.select(*cells).where(F.concat_ws("", *columns) != "")


def split_valid(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason): the first failed check names the reason."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    judged = rows.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


TYPES = ["book", "article", "archive", "website", "interview"]


def registry(entries: DataFrame) -> DataFrame:
    """title, url, outcome of registry entries (title, source_type, url, tier): accepted, matched or rejected."""
    bad = F.coalesce(F.trim("title") == "", F.lit(True)) | ~F.coalesce(F.col("source_type").isin(TYPES), F.lit(False)) | ~F.coalesce(F.col("tier").between(1, 5), F.lit(True))
    e = entries.withColumn("canonical", U.canonical_url(F.col("url"))).withColumn("bad", bad)
    # an aggregate and a join on the address, so that entries without one don't meet anywhere
    first = e.where("NOT bad AND canonical IS NOT NULL").groupBy("canonical").agg(F.min("pos").alias("_first"))
    outcome = F.when(F.col("bad"), "rejected").when(F.col("_first") < F.col("pos"), "matched").otherwise("accepted")
    return e.join(first, "canonical", "left").select("pos", "title", "canonical", outcome.alias("outcome"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    schema = "sources array<struct<title:string,source_type:string,url:string,tier:int>>"
    return registry(spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("sources").alias("pos", "s")).select("pos", "s.*"))


DUMP = "struct<id:string,type:string,labels:map<string,struct<value:string>>,claims:map<string,array<string>>>"


def read_dump(lines: DataFrame, country: str, inside: str = "P131", languages: tuple[str, ...] = ("fa", "en", "ar")) -> DataFrame:
    """id, labels, parents of a dump's items of one country. A substring test stands before the parser, which is what costs."""
    likely = lines.where(F.col("value").contains(country) & F.col("value").contains(f'"{inside}"'))
    item = likely.select(F.from_json(F.rtrim(F.regexp_replace("value", r",\s*$", "")), DUMP).alias("x")).where("x.type = 'item'")
    named = F.map_filter("x.labels", lambda k, v: k.isin(list(languages)))
    return item.where(F.array_contains(F.col("x.claims")["P17"], country)).select("x.id", F.transform_values(named, lambda k, v: v["value"]).alias("labels"), F.col("x.claims")[inside].alias("parents"))


def export_jsonl(entities: DataFrame, path: str, compression: str = "gzip") -> None:
    """One nested JSON row per entity."""
    entities.select(F.to_json(F.struct(*entities.columns)).alias("value")).write.mode("overwrite").text(path, compression=compression)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n of every table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def content_addressed(rows: DataFrame, content: str, order: str) -> DataFrame:
    """hash, first, n: identical content once, under its first row."""
    return rows.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("hash")).agg(F.min(order).alias("first"), F.count("*").alias("n"))


def links(html: Column, base: Column) -> Column:
    """Absolute targets of all href attributes, in order, without mail and script links."""
    host = F.regexp_extract(base, r"^([a-z]+://[^/]+)", 1)
    scheme = F.regexp_extract(base, r"^([a-z]+:)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"/[^/]*$", "/")
    raw = F.filter(F.regexp_extract_all(html, F.lit(r'href="([^"#][^"]*)"'), 1), lambda h: ~F.lower(h).rlike("^(mailto|javascript):"))
    clean = F.transform(raw, lambda h: F.replace(h, F.lit("&amp;"), F.lit("&")))
    absolute = lambda h: F.when(h.rlike("^[a-z]+://"), h).when(h.startswith("//"), F.concat(scheme, h)).when(h.startswith("/"), F.concat(host, h)).otherwise(F.concat(folder, h))
    return F.array_distinct(F.transform(clean, absolute))
