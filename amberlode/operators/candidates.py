"""Extracted candidates: what is admitted from a chunk, and where admitted ones go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberlode.functions import text as T

# Why an item is rejected or waits, and what a reviewer is told of a submission.
UNKNOWN = {"entity": "unknown entity type", "fact": "unknown property", "relationship": "unknown relation"}
UNQUOTED, EMPTY = "evidence quote not found in source text", "empty value"
UNRESOLVED, UNSUITED = "subject not resolved", "key does not apply to subject type"
NO_TEXT, NO_CONSENT, NO_RIGHTS = "no main text", "contributor did not consent to publication", "media rights unclear"

_ITEM = "kind:string,type:string,surface:string,key:string,object:string,value:string,quote:string,confidence:double"
PAYLOAD = (
    "struct<entities:array<struct<type:string,name:string,evidence_quote:string,confidence:double>>,"
    "facts:array<struct<subject_type:string,subject:string,property:string,value:string,evidence_quote:string,confidence:double>>,"
    "relationships:array<struct<subject_type:string,subject:string,relation:string,object:string,evidence_quote:string,confidence:double>>,"
    "historical_names:array<struct<entity_type:string,entity:string,historical_name:string,evidence_quote:string,confidence:double>>>"
)


def _items(payload: Column) -> Column:
    """All items of a payload in one shape, in their order."""

    def of(name: str, kind: str, **fields: str) -> Column:
        def item(x: Column) -> Column:
            got = {"kind": F.lit(kind), "quote": x["evidence_quote"], "confidence": x["confidence"]} | {k: x[v] for k, v in fields.items()}
            return F.struct(*[got.get(f.split(":")[0], F.lit(None)).cast(f.split(":")[1]).alias(f.split(":")[0]) for f in _ITEM.split(",")])

        return F.coalesce(F.transform(payload[name], item), F.array().cast(f"array<struct<{_ITEM}>>"))

    return F.concat(
        of("entities", "entity", type="type", surface="name"), of("facts", "fact", type="subject_type", surface="subject", key="property", value="value"),
        of("relationships", "relationship", type="subject_type", surface="subject", key="relation", object="object"), of("historical_names", "historical_name", type="entity_type", surface="entity", value="historical_name"),
    )


def admitted(chunks: DataFrame, types: list[str], properties: list[str], relations: list[str]) -> DataFrame:
    """chunk_id, seq, kind, type, surface, normalized_form, key, object, value, confidence, status, reason of every item of chunks
    (chunk_id, text, payload as JSON). The first failed rule is the reason: known type, property or relation; a quote of three
    characters or more that the text holds; a value. The text stays in its row: items are judged before they are exploded."""

    def judged(normal: Column) -> Column:
        def one(x: Column) -> Column:
            known = {"entity": x["type"].isin(types), "fact": x["key"].isin(properties), "relationship": x["key"].isin(relations)}
            unknown = F.coalesce(*[F.when((x["kind"] == k) & ~F.coalesce(ok, F.lit(False)), UNKNOWN[k]) for k, ok in known.items()])
            quoted = T.let(T.normalize(x["quote"]), lambda q: (F.length(q) >= 3) & normal.contains(q))
            reason = F.coalesce(unknown, F.when(~quoted, UNQUOTED), F.when((x["kind"] == "fact") & (F.coalesce(x["value"], F.lit("")) == ""), EMPTY))
            sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["confidence"]))
            return F.struct(x["kind"].alias("kind"), F.when(x["type"].isin(types), x["type"]).alias("type"), x["surface"].alias("surface"), T.normalize(x["surface"]).alias("normalized_form"), x["key"].alias("key"), x["object"].alias("object"), x["value"].alias("value"), F.when(x["confidence"].isNotNull(), sure).alias("confidence"), reason.alias("reason"))

        return F.transform(_items(F.from_json("payload", PAYLOAD)), one)

    items = chunks.select("chunk_id", T.let(T.normalize(F.col("text")), judged).alias("items")).select("chunk_id", F.posexplode("items").alias("seq", "x")).select("chunk_id", "seq", "x.*")
    return items.withColumn("status", F.when(F.col("reason").isNull(), "pending").otherwise("rejected"))


def routed(pending: DataFrame, decided: DataFrame, applies: DataFrame, least_sources: int = 2) -> DataFrame:
    """id, route, state, reason, evidence of pending candidates (id, kind, type, normalized_form, key, source_id).

    decided: id, entity_id, decision, entity_type of the surface's resolution; applies: key, entity_type of every property or
    relation that holds for a type. Unknown entities gather the sources that name them, and wait for `least_sources`; the
    others need their subject matched, and facts and relations a key that applies to it."""
    found = pending.join(decided, "id", "left").join(applies.select("key", "entity_type").distinct().withColumn("_ok", F.lit(True)), ["key", "entity_type"], "left")
    new = (F.col("kind") == "entity") & ~F.coalesce(F.col("decision").isin("matched", "review"), F.lit(False))
    evidence = found.where(new).groupBy(F.col("normalized_form").alias("_form"), F.col("type").alias("_type")).agg(F.countDistinct("source_id").alias("_evidence"))
    j = found.join(evidence, F.expr("normalized_form <=> _form AND type <=> _type"), "left")
    matched = F.coalesce(F.col("decision") == "matched", F.lit(False))
    of_entity = F.when(matched, "matched").when(F.col("decision") == "review", "in_review").when(F.col("_evidence") >= least_sources, "in_review").otherwise("needs_evidence")
    reason = F.when(F.col("kind") == "entity", None).when(~matched, UNRESOLVED).when(F.col("kind").isin("fact", "relationship") & F.col("_ok").isNull(), UNSUITED)
    state = F.when(F.col("kind") == "entity", of_entity).when(reason.isNotNull(), "in_review").otherwise("accepted")
    route = F.when(F.col("kind") == "historical_name", "historical_name").when(F.col("kind") == "entity", "entity").otherwise("fact")
    return j.select("id", route.alias("route"), state.alias("state"), reason.alias("reason"), F.when(new, F.col("_evidence")).alias("evidence"))


def submission_checks(submissions: DataFrame, decided: DataFrame, found: DataFrame) -> DataFrame:
    """id, place_decision, possible_duplicates (at most three entity ids, best first) and issues of submissions (id, main, kind,
    consent, own_work, license_offered). decided: the resolution of the named places; found: ranked candidates (id, entity_id,
    rank) of the main texts."""
    top = found.where("rank <= 3").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity_id"))).alias("d"))
    j = submissions.join(decided.select("id", F.col("decision").alias("place_decision")), "id", "left").join(top, "id", "left")
    issues = F.array_compact(F.array(
        F.when(F.coalesce(F.col("main"), F.lit("")) == "", NO_TEXT), F.when(~F.col("consent"), NO_CONSENT),
        F.when(F.col("kind").isin("photo", "video", "music") & ~F.col("own_work") & ~F.col("license_offered"), NO_RIGHTS),
    ))
    return j.select("id", "place_decision", F.coalesce(F.col("d.entity_id"), F.array().cast("array<bigint>")).alias("possible_duplicates"), issues.alias("issues"))


def classified(items: DataFrame, classes: DataFrame) -> DataFrame:
    """id, type of items (id, classes, hint, placed): the type of the class that comes first in the list (cls, type, priority),
    else the hint, else a place where there are coordinates."""
    listed = items.select("id", F.explode("classes").alias("cls")).join(F.broadcast(classes), "cls")  # a registry's list
    first = listed.groupBy("id").agg(F.min_by("type", "priority").alias("t"))
    return items.join(first, "id", "left").select("id", F.coalesce("t", "hint", F.when(F.col("placed"), "place")).alias("type"))


def visible(mentions: DataFrame) -> DataFrame:
    """Mentions (status, confidence) that are confirmed, or suggested with enough confidence."""
    return mentions.where((F.col("status") == "confirmed") | ((F.col("status") == "suggested") & (F.col("confidence") >= 0.8)))
