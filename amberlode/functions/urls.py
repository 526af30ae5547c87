"""URL, file-type, robots and free-text classifiers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Content types and their extensions.
EXTENSIONS = {
    "application/pdf": "pdf", "text/html": "html", "application/xhtml+xml": "html", "text/plain": "txt", "application/json": "json", "application/sparql-results+json": "json",
    "text/csv": "csv", "image/jpeg": "jpg", "image/png": "png", "image/tiff": "tif", "application/xml": "xml", "text/xml": "xml",
}


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no utm_ parameters, sorted query, no fragment, port, user or final slash."""
    scheme = F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.lit("")), F.lit("https")))
    rest = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), "^.*@", ""), r":\d+$", ""))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host == "", url).otherwise(F.concat(scheme, F.lit("://"), host, path, tail))


def extension(content_type: Column, url: Column) -> Column:
    kind = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    known = F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), kind)
    found = F.lower(F.regexp_extract(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""), r"\.([A-Za-z0-9]{1,5})$", 1))
    return F.coalesce(known, F.nullif(found, F.lit("")), F.lit("bin"))


def license_of(probe: Column) -> Column:
    """The license that a link and short name speak of, the most restrictive form first."""
    has = probe.contains
    return (
        F.when(has("publicdomain/zero") | has("cc0"), "cc0").when(has("public domain") | has("publicdomain") | has("pd-"), "public_domain").when(has("by-nc-sa"), "cc_by_nc_sa")
        .when(has("by-nc-nd"), "cc_by_nc_nd").when(has("by-nc"), "cc_by_nc").when(has("by-nd"), "cc_by_nd").when(has("by-sa"), "cc_by_sa")
        .when(probe.rlike(r"/by/|cc by \d|cc-by-\d|\bcc by$"), "cc_by").otherwise("unknown")
    )


def year_in(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\b(1[6-9]\d\d|20\d\d)\b", 1), F.lit("")).cast("int")


def glob_regex(pattern: Column) -> Column:
    """A pattern with * and an end mark $ as a regular expression that is anchored at the start."""
    quoted = F.regexp_replace(pattern, r"([.+?^(){}\[\]|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")))
