"""Imports of tables and of listing pages: typed files, reports, category trees, galleries, table grids and fetch schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amberlode.operators import graph
from amberlode.sources.tables import read_csv, split_valid

# The kinds of delimited files, their columns, and those that a row must fill.
COMMON = ["source_uuid", "page", "locator", "quote"]
KINDS = {
    "words": (["word", "meaning_fa"], ["meaning_en", "transcription_fa", "transliteration", "ipa", "part_of_speech", "dialect", "place", "concept", "concept_en", "etymology", "usage_notes"]),
    "sentences": (["text_local"], ["text_fa", "text_en", "transcription_fa", "ipa", "category", "dialect", "place"]),
    "proverbs": (["text_local"], ["kind", "transcription_fa", "literal_meaning", "figurative_meaning", "usage_context", "backstory", "persian_equivalent", "dialect", "place"]),
    "historical_names": (["place", "historical_name"], ["local_pronunciation", "period", "year_from", "year_to", "meaning", "reason"]),
    "place_facts": (["place", "property"], ["value", "census_year"]),
}
# The counters of an import report.
COUNTERS = [
    "sources_found", "sources_accepted", "sources_rejected", "documents_processed", "facts_extracted", "entities_created", "entities_matched", "duplicates", "conflicts", "low_confidence", "errors",
]
MOST_ERRORS, MESSAGE_CHARS = 500, 1000


def columns_of(kind: str) -> list[str]:
    required, others = KINDS[kind]
    return [*required, *others, *COMMON]


def checked(rows: DataFrame, kind: str, sources: DataFrame, places: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason) of rows of a kind: a row needs a registered source (source_uuid of `sources`), its
    required columns, and, where it names a place, a name that `places` (name, entity_id) gives to one entity alone.
    Accepted rows of a named place carry place_id; a fact without value is unknown."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    known = sources.select("source_uuid").distinct().withColumn("_registered", F.lit(True))
    judged = rows.join(known, "source_uuid", "left")
    checks = {"row has no registered source_uuid": F.col("_registered").isNotNull()}
    checks |= {f"{c} is required": F.coalesce(F.col(c) != "", F.lit(False)) for c in KINDS[kind][0]}
    if places is not None and "place" in judged.columns:
        one = places.groupBy(F.col("name").alias("place")).agg(F.min("entity_id").alias("place_id"), F.countDistinct("entity_id").alias("_owners"))
        judged = judged.join(one, "place", "left")
        checks["place is not resolved unambiguously"] = F.coalesce(F.col("place") == "", F.lit(True)) | F.coalesce(F.col("_owners") == 1, F.lit(False))
    if kind == "place_facts":
        judged = judged.withColumn("value", F.when(F.coalesce(F.col("value") == "", F.lit(True)), "unknown").otherwise(F.col("value")))
    ok, bad = split_valid(judged, checks)
    return ok.drop("_registered", "_owners"), bad.drop("_registered", "_owners")


def import_csv(spark: SparkSession, kind: str, path: str, sources: DataFrame, places: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """`checked` of a headed file."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    return checked(read_csv(spark, path, columns_of(kind)), kind, sources, places)


def report(outcomes: DataFrame) -> DataFrame:
    """One row: a column for every counter, and error_log, from rows (counter, n, message): n is summed by counter, every
    message is an error, and the log holds the first `MOST_ERRORS` messages in order, shortened."""
    counts = [F.coalesce(F.sum(F.when(F.col("counter") == c, F.col("n"))), F.lit(0)).alias(c) for c in COUNTERS[:-1]]
    totals = outcomes.agg(*counts, F.count("message").alias("errors"))
    log = outcomes.where("message IS NOT NULL").orderBy("message").limit(MOST_ERRORS).agg(F.array_sort(F.collect_list(F.substring("message", 1, MESSAGE_CHARS))).alias("error_log"))
    return totals.join(log)  # one row each


def _section(html: Column, name: str, *ends: str) -> Column:
    """What follows the element of this id, up to one of `ends`."""
    stop = "|".join([*(f'id="{e}"' for e in ends), "</main>"])
    return F.regexp_extract(html, f'(?s)id="{name}"(.*?)(?:{stop})', 1)


def _titles(section: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(section, F.lit(pattern), 1), lambda h: F.try_url_decode(F.replace(h, F.lit("+"), F.lit("%2B")))))


def category_members(html: Column, prefix: str = "Category:") -> Column:
    """subcategories and pages of a category's listing: links of its own two sections, not those to its parents."""
    sub = F.filter(_titles(_section(html, "mw-subcategories", "mw-pages", "mw-category-media", "catlinks"), r'href="/wiki/([^"]+)"'), lambda t: t.startswith(prefix))
    pages = F.filter(_titles(_section(html, "mw-pages", "catlinks", "mw-category-media"), r'<li[^>]*><a href="/wiki/([^"]+)"'), lambda t: ~t.contains(":"))
    return F.struct(sub.alias("subcategories"), F.transform(pages, lambda t: F.replace(t, F.lit("_"), F.lit(" "))).alias("pages"))


def category_tree(listings: DataFrame, roots: DataFrame, prefix: str = "Category:") -> DataFrame:
    """title, depth, pages of all categories below `roots` (title), from stored listings (title, html): the walk is a closure
    over the links that the listings hold. A category without listing has no pages."""
    found = listings.select("title", category_members(F.col("html"), prefix).alias("m")).select("title", "m.*")
    ids = lambda c: F.xxhash64(c)
    links = found.select(ids("title").alias("parent_id"), F.explode("subcategories").alias("title"))
    names = links.select("title").unionByName(roots.select("title")).distinct().select(ids("title").alias("id"), "title")
    reached = graph.closure(links.select(ids("title").alias("id"), "parent_id"), roots.select(ids("title").alias("id")))
    return reached.join(names, "id").join(found.select("title", "pages"), "title", "left").select("title", "depth", F.coalesce("pages", F.array().cast("array<string>")).alias("pages"))


#: Fixed value: subcategories whose names promise old photographs.
OLDER = r"(?i)history|old photograph|1[89]\d\ds|century"


def gallery(files: DataFrame, have: DataFrame, most: int = 6, from_older: int = 3) -> DataFrame:
    """entity_id, file, place (from 1): the files to import for each entity.

    files: entity_id, subcategory (null: the category itself), pos, file. Up to `from_older` files of each older subcategory
    come first, later subcategories before earlier ones, then the category's own; each file once; and only as many as
    `have` (entity_id, n) leaves of `most`."""
    older = F.col("subcategory").rlike(OLDER)
    ranked = files.where(F.col("subcategory").isNull() | older).withColumn("k", F.row_number().over(Window.partitionBy("entity_id", "subcategory").orderBy("pos", "file")))
    chosen = ranked.where(F.col("subcategory").isNull() | (F.col("k") <= from_older))
    once = chosen.groupBy("entity_id", "file").agg(F.min(F.struct(F.col("subcategory").isNull().alias("own"), F.col("subcategory").alias("sub"), "k")).alias("o"))
    order = Window.partitionBy("entity_id").orderBy("o.own", F.desc("o.sub"), "o.k", "file")
    placed = once.withColumn("place", F.row_number().over(order)).join(have, "entity_id", "left")
    return placed.where(F.col("place") <= most - F.coalesce("n", F.lit(0))).select("entity_id", "file", "place")


def grid(html: Column) -> Column:
    """The cells of all table rows of a page, as an array of arrays of texts: markup gone, references decoded, one space."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr|<tr\b|</table|\z)"), 1)
    cells = lambda row: F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=</t[dh]|<t[dh]\b|\z)"), 1)
    return F.filter(F.transform(rows, lambda row: F.transform(cells(row), plain)), lambda r: F.size(r) > 0)


# The named character references that cells hold.
REFERENCES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def plain(markup: Column) -> Column:
    text = F.regexp_replace(markup, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for name, char in REFERENCES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def columns_long(pages: DataFrame, key: str) -> DataFrame:
    """key, row, head, form, gloss of comparison tables: the first row names the columns, the first column is the gloss, and
    every further cell is a form under its column's head."""
    g = pages.select(key, grid(F.col("html")).alias("g")).where(F.size("g") > 1).withColumn("heads", F.get("g", F.lit(0)))
    rows = g.select(key, "heads", F.posexplode(F.slice("g", 2, 2**31 - 1)).alias("row", "cells"))
    forms = rows.select(key, "row", F.get("cells", F.lit(0)).alias("gloss"), F.posexplode(F.zip_with("heads", "cells", lambda h, c: F.struct(h.alias("head"), c.alias("form")))).alias("at", "x"))
    return forms.where((F.col("at") > 0) & (F.col("x.form") != "")).select(key, "row", "x.head", "x.form", "gloss")


def fetch_times(requests: DataFrame) -> DataFrame:
    """`requests` (host, id, arrival and delay in seconds, one delay a host) with start: each request waits until the host's
    delay has passed since the one before it. With requests numbered i, start is i delays after the latest arrival less
    its own number of delays: a running maximum."""
    order = Window.partitionBy("host").orderBy("arrival", "id")
    numbered = requests.withColumn("_i", F.row_number().over(order))
    latest = F.max(F.col("arrival") - F.col("_i") * F.col("delay")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("start", latest + F.col("_i") * F.col("delay")).drop("_i")


def retry_wait(status: Column, attempt: Column, retry_after: Column, most: int = 3) -> Column:
    """Seconds before the next attempt after a failed one (attempts count from 1), or null for none: ten a try after a network
    failure (null status), and what a busy server asks for, at least five a try and at most two minutes."""
    busy = F.least(F.greatest(F.coalesce(retry_after, F.lit(0)), 5 * attempt), F.lit(120))
    return F.when(attempt < most, F.when(status.isNull(), 10 * attempt).when(status.isin(429, 503), busy))


def stale_backups(backups: DataFrame, now: Column, days: int) -> DataFrame:
    """Runs (run, made) that are older than the retention."""
    return backups.where(F.col("made") < now - F.make_dt_interval(F.lit(days)))


def differing(listed: DataFrame, found: DataFrame) -> DataFrame:
    """path, problem of a backup's listing (path, sha256) against its files: missing, changed or unlisted."""
    j = listed.select("path", F.col("sha256").alias("was")).join(found.select("path", F.col("sha256").alias("now")), "path", "full")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "unlisted").when(F.col("was") != F.col("now"), "changed")
    return j.select("path", problem.alias("problem")).where("problem IS NOT NULL")
