"""Secret scanning over an incremental blob ledger.

Every historical version of a document is a blob, addressed by the SHA-256 of its text. Blobs that the ledger has
not seen under a rule version are scanned, once each however many paths hold them; findings and the
pairs (blob, rule version) join the ledger, and findings are joined back to all paths.

Defined results: null and empty text have no findings; rows without doc_id are scanned like others; repeated rows
each get the blob's findings; other columns pass through where rows are returned, whatever their names. Offsets are
code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from amberlode.llm.common import boxed, durable, scratch, unboxed

#: Base kinds in their fixed order: pattern, group that is measured, least length.
BASE = {
    "assign": (r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
_BREAK = r"(?:\s|\\+[nrt])"
#: From BEGIN to END whatever lies between, but no other mark; where END is missing, header lines and what can be a key's body.
_PEM = (
    r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:(?s:(?!-----(?:BEGIN|END) ).)*+-----END (?:[A-Z]+ )*PRIVATE KEY-----"
    rf"|(?:{_BREAK}*+[A-Z][A-Za-z0-9-]*+:[^\r\n\\]*+)*+(?:[A-Za-z0-9+/=]|{_BREAK})*+)"
)
#: Kinds that the rules add to the base.
ADDED = {
    "pem": (_PEM, 0, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0),
    "forge": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    "userinfo": (r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s/:@]++:[^\s/:@]++@[^\s/:@]+", 0, 0),
}
#: A text must hold one of these for the kind to be searched: a substring test is far cheaper than the pattern.
_NEEDED = {"access": "AKIA", "pem": "-----BEGIN", "jwt": "eyJ", "forge": "gh", "chat": "xox", "userinfo": "://"}
_ASSIGN_HINT = re.compile(r"[:=]")


@dataclass(frozen=True)
class Rules:
    kinds: dict = field(default_factory=lambda: BASE | ADDED)

    @property
    def version(self) -> str:
        """Changes with any pattern, so that a new rule scans old blobs again."""
        return hashlib.sha256(repr(sorted(self.kinds.items())).encode()).hexdigest()[:16]


#: What `[0-9a-f]+` of 32 or more finds, without a match for every short run.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")


class Scanner:
    def __init__(self, rules: Rules) -> None:
        self.kinds = [(kind, re.compile(p), group, least) for kind, (p, group, least) in rules.kinds.items()]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """kind, start, end: by start, then by kind as listed. Matches are leftmost and don't overlap within a kind;
        a match that is too short is dropped but still uses up its characters."""
        out = []
        for order, (kind, pattern, group, least) in enumerate(self.kinds):
            if (needed := _NEEDED.get(kind)) and needed not in text or kind == "assign" and not _ASSIGN_HINT.search(text):
                continue
            if kind == "hex" and pattern.pattern == BASE["hex"][0]:
                pattern = _LONG_HEX
            out += [(m.start(), order, kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
        return [(kind, start, end) for start, _, kind, end in sorted(out)]


_SPAN = "array<struct<kind:string,start:int,end:int>>"


def scan(blobs: DataFrame, rules: Rules) -> DataFrame:
    """blob, spans of the blobs (blob, text) that have findings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            blobs, found = [], []
            for blob, text in zip(batch.column(0), batch.column(1)):
                if spans := scanner.spans(text.as_py() or ""):
                    blobs.append(blob.as_py())
                    found.append([dict(zip(("kind", "start", "end"), s)) for s in spans])
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(found, kind)], ["blob", "spans"])

    return blobs.select("blob", "text").mapInArrow(run, f"blob string, spans {_SPAN}")


class Ledger:
    """Two append-only tables: scanned (blob, version) and findings (blob, version, spans). Several may share a folder."""

    SCANNED, FINDINGS = "blob string, version string", f"blob string, version string, spans {_SPAN}"

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or scratch(spark, "ledger")
        for name, schema in (("scanned", self.SCANNED), ("findings", self.FINDINGS)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")

    def scanned(self) -> DataFrame:
        return self.spark.read.schema(self.SCANNED).parquet(f"{self.path}/scanned")

    def findings(self, version: str) -> DataFrame:
        """Findings of the blobs that were marked as scanned; those of a run that broke off are left aside."""
        done = self.scanned().where(F.col("version") == version).select("blob").distinct()
        found = self.spark.read.schema(self.FINDINGS).parquet(f"{self.path}/findings").where(F.col("version") == version)
        return found.select("blob", "spans").dropDuplicates(["blob"]).join(done, "blob", "left_semi")

    def update(self, docs: DataFrame, rules: Rules) -> DataFrame:
        """Scans the blobs of `docs` (text) that are new to this rule version; returns all of the version's findings."""
        blobs = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"), "text")
        known = self.scanned().where(F.col("version") == rules.version).select("blob")
        # the version that represents a blob is picked by row, so texts are moved only to meet the ledger
        fresh = blobs.dropDuplicates(["blob"]).join(known, "blob", "left_anti")
        new = scan(fresh, rules).withColumn("version", F.lit(rules.version))
        new.select("blob", "version", "spans").write.mode("append").parquet(f"{self.path}/findings")
        marks = blobs.select("blob").distinct().join(known, "blob", "left_anti").withColumn("version", F.lit(rules.version))
        durable(marks, "marks").write.mode("append").parquet(f"{self.path}/scanned")
        return self.findings(rules.version)


def spans_text(spans, kinds: list[str] | None = None):
    chosen = F.filter(spans, lambda s: s["kind"].isin(kinds)) if kinds else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _with_findings(docs: DataFrame, rules: Rules, ledger: Ledger | None) -> DataFrame:
    """row (the columns of `docs`) and spans: the findings of each row's text (an empty array if none)."""
    found = (ledger or Ledger(docs.sparkSession)).update(docs, rules)
    keyed = boxed(docs, F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    return keyed.join(found, F.col("key") == F.col("blob"), "left").select("row", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"))


def findings_of(docs: DataFrame, rules: Rules = Rules(), ledger: Ledger | None = None) -> DataFrame:
    """`docs` with column spans, which takes the place of one of this name."""
    return _with_findings(docs, rules, ledger).select(*unboxed([c for c in docs.columns if c != "spans"]), "spans")


def _count(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind))


def scan_digests(docs: DataFrame, rules: Rules = Rules(), ledger: Ledger | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row."""
    found = findings_of(docs.select("doc_id", "text"), rules, ledger)
    count = [_count(k).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *count, F.sha2(spans_text(F.col("spans"), list(BASE)), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def without(text: str, spans: list) -> str:
    """The text with every span replaced by [kind]; overlapping spans as one, under the first one's kind."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


@F.pandas_udf(StringType())
def _without(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else without(t, s) for t, s in zip(text, spans)], dtype=object)


def redacted(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """`docs` with every found span replaced by [kind]; texts without findings stay in the JVM."""
    found, text = F.size("spans") > 0, F.col("row.text")
    scrubbed = _without(F.when(found, text), F.when(found, F.col("spans")))
    return _with_findings(docs, rules, None).select(*unboxed(docs.columns, text=F.when(found, scrubbed).otherwise(text)))
