"""Keyword search, indexing, vectors, mentions and question answering over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from amberlode.functions import similarity as S
from amberlode.functions import text as T
from amberlode.operators import candidates, rag, resolve, search
from amberlode.operators import pipeline as P
from amberlode.plans.fixtures import ENTITIES_SQL, REVIEWED_SQL, places, reviewed
from amberlode.plans.kernels import normal_sql
from amberlode.plans.registry import query

#: Entities are published places and parts; names are titles, other and old names; lines are an order's priorities.
DOCS_SQL = f"""{ENTITIES_SQL}, ent AS (
  SELECT c.id, c.type, c.path, c.name AS title, p.name AS parent_title, c.k % 50 AS facts FROM places c LEFT JOIN places p ON p.id = c.parent_id WHERE c.visibility = 'published' AND c.merged_into_id IS NULL
  UNION ALL SELECT 30000000 + p_partkey, 'word', '/' || (1000000 + p_partkey % 5) || '/', p_name, NULL, p_size FROM part
), nam AS (
  SELECT id AS entity_id, title AS alias FROM ent
  UNION ALL SELECT id, 'Place ' || name FROM places WHERE k % 2 = 0
  UNION ALL SELECT id, 'Old ' || type || ' ' || (k % 100) FROM places WHERE k % 3 = 0
  UNION ALL SELECT 30000000 + p_partkey, p_brand FROM part
), nn AS (SELECT DISTINCT entity_id, {normal_sql('alias')} AS n FROM nam
), na AS (SELECT entity_id, string_agg(n, ' ' ORDER BY n) AS aliases FROM nn WHERE n <> '' GROUP BY 1
), nc AS (SELECT entity_id, string_agg(c, ' ' ORDER BY c) AS compact_text FROM (SELECT DISTINCT entity_id, replace(n, ' ', '') AS c FROM nn WHERE n <> '') GROUP BY 1
), li AS (SELECT entity_id, string_agg(line, chr(10) ORDER BY line) AS told FROM (SELECT DISTINCT 10000000 + o_custkey AS entity_id, 'priority: ' || o_orderpriority AS line FROM orders) GROUP BY 1
), docs AS (
  SELECT id, path, type, body, facts, {normal_sql('title')} AS normalized_title, coalesce(aliases, '') AS aliases, coalesce(compact_text, '') AS compact_text, {normal_sql("concat_ws(' ', title, aliases, body)")} AS normalized_text,
    CASE type WHEN 'province' THEN 1.6 WHEN 'county' THEN 1.6 WHEN 'port' THEN 1.3 WHEN 'village' THEN 1.0 ELSE 1.1 END + least(0.5, facts / 40.0::DOUBLE) AS boost
  FROM (SELECT ent.*, aliases, compact_text, concat_ws(chr(10), parent_title, told) AS body FROM ent LEFT JOIN na ON na.entity_id = id LEFT JOIN nc ON nc.entity_id = id LEFT JOIN li ON li.entity_id = id))"""


def documents(t):
    p = places(t)
    parent = p.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_title"))
    place = p.where("visibility = 'published'").join(parent, "parent_id", "left").select("id", "type", "path", F.col("name").alias("title"), "parent_title", (F.col("k") % 50).alias("facts"), "merged_into_id")
    region = F.concat(F.lit("/"), (F.col("p_partkey") % 5 + 1000000).cast("string"), F.lit("/"))
    null = lambda kind: F.lit(None).cast(kind)
    word_id = (F.col("p_partkey") + 30000000).alias("id")
    word = t("part").select(word_id, F.lit("word").alias("type"), region.alias("path"), F.col("p_name").alias("title"), null("string").alias("parent_title"), F.col("p_size").cast("long").alias("facts"), null("long").alias("merged_into_id"))
    entities = place.unionByName(word)
    other = lambda df, name, old: df.select(F.col("id").alias("entity_id"), name.alias("alias"), F.lit(old).alias("historical"))
    names = other(entities, F.col("title"), False).unionByName(other(p.where("k % 2 = 0"), F.concat(F.lit("Place "), "name"), False))
    names = names.unionByName(other(p.where("k % 3 = 0"), F.concat(F.lit("Old "), "type", F.lit(" "), (F.col("k") % 100).cast("string")), True)).unionByName(other(t("part").withColumn("id", word_id), F.col("p_brand"), False))
    lines = t("orders").select((F.col("o_custkey") + 10000000).alias("entity_id"), F.concat(F.lit("priority: "), "o_orderpriority").alias("line")).distinct()
    return search.documents(entities, names, lines)


def score_sql(q: str) -> str:
    c, words = q.replace(" ", ""), q.split()
    return f"""(CASE WHEN normalized_title = '{q}' THEN 10 WHEN starts_with(normalized_title, '{q}') THEN 6 WHEN contains(normalized_title, '{q}') THEN 4 ELSE 0 END
 + CASE WHEN contains(' ' || aliases || ' ', ' {q} ') OR contains(' ' || compact_text || ' ', ' {c} ') THEN 7 WHEN contains(compact_text, '{c}') THEN 3 ELSE 0 END {''.join(f" + CASE WHEN contains(normalized_text, '{w}') THEN 1 ELSE 0 END" for w in words)}) * boost"""


def match_sql(q: str) -> str:
    return "(" + " AND ".join(f"contains(normalized_text, '{w}')" for w in q.split()) + f" OR contains(compact_text, '{q.replace(' ', '')}'))"


T1 = f"WITH {DOCS_SQL}, s AS (SELECT id, CAST(round({score_sql("old village 7")}, 4) AS DOUBLE) AS score FROM docs WHERE {match_sql("old village 7")} AND contains(path, '/1000001/') ORDER BY score DESC, id LIMIT 50) SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM s"


@query("t1_keyword_search", T1)
def _(t):
    """Search for an old name with a place filter: the ranked list of one query."""
    return search.search(search.within(documents(t), 1000001), "old village 7", 50)


@query("t2_search_score", f"WITH {DOCS_SQL} SELECT id, CAST(round({score_sql('nation 2')}, 4) AS DOUBLE) AS score FROM docs WHERE {match_sql('nation 2')}")
def _(t):
    return documents(t).where(search.matches("nation 2")).select("id", F.round(search.score("nation 2"), 4).alias("score"))


_WHOLE = lambda q: "(" + " AND ".join(f"contains(' ' || normalized_text || ' ', ' {w} ')" for w in q.split()) + f" OR contains(compact_text, '{q.replace(' ', '')}'))"
_FREQ = lambda q: f"len(list_filter(string_split(normalized_text, ' '), lambda w: w IN ({', '.join(repr(w) for w in q.split())}))) / greatest(1, len(string_split(normalized_text, ' ')))::DOUBLE"


@query("t3_full_text", f"WITH {DOCS_SQL} SELECT id, CAST(round({score_sql('priority high')} + {_FREQ('priority high')}, 4) AS DOUBLE) AS score FROM docs WHERE {_WHOLE('priority high')}")
def _(t):
    """All words as whole words, wherever they stand; scored with the words' relevance."""
    return documents(t).where(search.phrases("priority high")).select("id", F.round(search.score("priority high", True), 4).alias("score"))


@query("t4_entity_documents", f"WITH {DOCS_SQL} SELECT id, aliases, compact_text, body, normalized_title, normalized_text, round(boost, 6) AS boost FROM docs")
def _(t):
    """The whole search document of every entity: all names, old ones too, compact keys, the parent and fact lines."""
    return documents(t).select("id", "aliases", "compact_text", "body", "normalized_title", "normalized_text", F.round("boost", 6).alias("boost"))


@query("t5_index_all", "SELECT 'sentence' AS kind, conv_id * 1000 + turn AS id, length(text) AS n FROM conversations UNION ALL SELECT 'page', page_id, length(url) FROM pages UNION ALL SELECT 'text', doc_id, length(text) FROM documents")
def _(t):
    parts = [
        t("conversations").select(F.lit("sentence").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.length("text").cast("long").alias("n")),
        t("pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.length("url").cast("long").alias("n")),
        t("documents").select(F.lit("text").alias("kind"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("t6_profile_changes", "SELECT n.doc_id, o.h IS NULL AS is_new FROM (SELECT doc_id, md5(text) AS h, doc_id % 2 AS pub FROM documents) n LEFT JOIN (SELECT doc_id, md5(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) AS h, CASE WHEN doc_id % 15 = 0 THEN 1 - doc_id % 2 ELSE doc_id % 2 END AS pub FROM documents WHERE doc_id % 4 <> 3) o ON o.doc_id = n.doc_id WHERE o.h IS NULL OR o.h <> n.h OR o.pub <> n.pub")
def _(t):
    """Profiles to write: new, or with another hash or publicity than the stored one."""
    d = t("documents")
    new = d.select("doc_id", F.md5("text").alias("h"), (F.col("doc_id") % 2).alias("pub"))
    old = d.where("doc_id % 4 <> 3").select("doc_id", F.md5(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("oh"), F.when(F.col("doc_id") % 15 == 0, 1 - F.col("doc_id") % 2).otherwise(F.col("doc_id") % 2).alias("op"))
    j = new.join(old, "doc_id", "left")
    return j.where(F.col("oh").isNull() | (F.col("oh") != F.col("h")) | (F.col("op") != F.col("pub"))).select("doc_id", F.col("oh").isNull().alias("is_new"))


@query("v2_embed_missing")
def _(t):
    """Features of the texts that have no vector yet."""
    missing = t("documents").join(t("embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")
    return P.hash_embedding(missing.select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("buckets"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("norm2"))


def _grams(words: str, longest: int) -> str:
    return " UNION ".join(f"SELECT doc_id, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i+{n - 1}], ' '))) AS gram FROM {words} WHERE len(w) >= {n}" for n in range(1, longest + 1))


ALIAS_SQL = f"al AS (SELECT item_id AS entity_id, array_to_string(list_filter(string_split({normal_sql('text')}, ' '), lambda x: x <> '')[1:2], ' ') AS gram FROM benchmark)"
WORDS_SQL = f"w AS (SELECT doc_id, list_filter(string_split({normal_sql('text')}, ' '), lambda x: x <> '') AS w FROM documents)"


def aliases(t):
    return t("benchmark").select(F.col("item_id").alias("entity_id"), F.array_join(F.slice(T.tokens(T.normalize(F.col("text"))), 1, 2), " ").alias("alias"))


@query("e5_mentions", f"WITH {ALIAS_SQL}, {WORDS_SQL}, g AS ({_grams('w', 4)}), n AS (SELECT gram, count(DISTINCT entity_id) AS n FROM al GROUP BY gram) SELECT DISTINCT g.doc_id, al.entity_id, g.gram, round(0.8 / n, 4) AS confidence FROM g JOIN al ON al.gram = g.gram JOIN n ON n.gram = g.gram WHERE length(replace(g.gram, ' ', '')) >= 3")
def _(t):
    return resolve.mentions(t("documents"), aliases(t))


@query("e6_mention_visibility", f"WITH {ALIAS_SQL}, {WORDS_SQL}, g AS ({_grams('w', 4)}), n AS (SELECT gram, count(DISTINCT entity_id) AS n FROM al GROUP BY gram), m AS (SELECT DISTINCT g.doc_id, al.entity_id, round(0.8 / n, 4) AS confidence FROM g JOIN al ON al.gram = g.gram JOIN n ON n.gram = g.gram WHERE length(replace(g.gram, ' ', '')) >= 3) SELECT doc_id, entity_id FROM m WHERE doc_id % 10 = 0 OR (doc_id % 10 > 2 AND confidence >= 0.8)")
def _(t):
    """The mentions that readers see: confirmed ones, and suggested ones of enough confidence."""
    k = F.col("doc_id") % 10
    found = resolve.mentions(t("documents"), aliases(t)).withColumn("status", F.when(k == 0, "confirmed").when(k <= 2, "rejected").otherwise("suggested"))
    return candidates.visible(found).select("doc_id", "entity_id")


@query("j15_gazetteer", f"WITH {ALIAS_SQL}, {WORDS_SQL}, g AS ({_grams('w', 2)}) SELECT al.entity_id, count(DISTINCT g.doc_id) AS docs FROM g JOIN al ON al.gram = g.gram WHERE length(replace(g.gram, ' ', '')) >= 3 GROUP BY 1")
def _(t):
    return resolve.mentions(t("documents"), aliases(t), 2).groupBy("entity_id").agg(F.countDistinct("doc_id").alias("docs"))


@query("f9_quote_offsets", f"WITH d AS (SELECT doc_id, {normal_sql('text')} AS n FROM documents), b AS (SELECT item_id, {normal_sql('text')} AS q FROM benchmark) SELECT doc_id, item_id, CAST(strpos(n, q) - 1 AS INTEGER) AS at FROM d JOIN b ON contains(n, q)")
def _(t):
    return rag.quotes(t("documents"), t("benchmark"))


@query("j16_containment", f"WITH d AS (SELECT doc_id, {normal_sql('text')} AS n FROM documents), b AS (SELECT item_id, {normal_sql('text')} AS q FROM benchmark) SELECT item_id, count(*) AS docs FROM d JOIN b ON contains(n, q) GROUP BY item_id")
def _(t):
    return rag.quotes(t("documents"), t("benchmark")).groupBy("item_id").agg(F.count("*").alias("docs"))


@query("r1_question_analysis", f"WITH {ALIAS_SQL}, qs AS (SELECT conv_id * 1000 + turn AS doc_id, list_filter(string_split({normal_sql('text')}, ' '), lambda x: x <> '') AS w FROM conversations), g AS ({_grams('qs', 3)}) SELECT doc_id AS question_id, min(entity_id) AS entity_id, count(DISTINCT entity_id) AS n FROM g JOIN al ON al.gram = g.gram WHERE length(replace(g.gram, ' ', '')) >= 3 GROUP BY doc_id")
def _(t):
    q = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return resolve.mentions(q, aliases(t), 3).groupBy(F.col("doc_id").alias("question_id")).agg(F.min("entity_id").alias("entity_id"), F.countDistinct("entity_id").alias("n"))


def _dot(a, b):
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)), lambda x, y: x + y)"


LISTS_SQL = f"""q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 7),
vec AS (SELECT 'vector' AS list, vec_id AS key, row_number() OVER (ORDER BY round({_dot('embedding', 'qe')}, 9) DESC, vec_id) - 1 AS rank FROM embeddings, q),
kw AS (SELECT 'keyword' AS list, doc_id AS key, row_number() OVER (ORDER BY n DESC, doc_id) - 1 AS rank FROM (SELECT doc_id, (CASE WHEN contains(lower(text), 'erend') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'thble') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'eauai') THEN 1 ELSE 0 END) AS n FROM documents) WHERE n > 0),
lists AS (SELECT * FROM vec WHERE rank < 20 UNION ALL SELECT * FROM kw WHERE rank < 20)"""


def lists(t):
    one = F.broadcast(t("embeddings").where("vec_id = 7").select(F.col("embedding").alias("qe")))
    near = t("embeddings").join(one, how="cross").select(F.lit("vector").alias("list"), F.col("vec_id").alias("key"), F.round(S.dot(F.col("embedding"), F.col("qe")), 9).alias("s"))
    text = F.lower("text")
    hits = sum((F.when(text.contains(w), 1).otherwise(0) for w in ("thble", "eauai")), F.when(text.contains("erend"), 1).otherwise(0))
    words = t("documents").select(F.lit("keyword").alias("list"), F.col("doc_id").alias("key"), hits.cast("double").alias("s")).where("s > 0")
    tops = [x.orderBy(F.desc("s"), "key").limit(20) for x in (near, words)]
    rank = (F.row_number().over(Window.partitionBy("list").orderBy(F.desc("s"), "key")) - 1).cast("long")
    return tops[0].unionByName(tops[1]).select("list", "key", rank.alias("rank"))


@query("r2_ranked_lists", f"WITH {LISTS_SQL} SELECT * FROM lists")
def _(t):
    return lists(t)


@query("r3_rrf", f"WITH {LISTS_SQL} SELECT key, round(sum(1.0 / (60 + rank + 1)), 6) AS score FROM lists GROUP BY key")
def _(t):
    return rag.fused(lists(t)).select("key", F.round("score", 6).alias("score"))


@query("r4_budget", "SELECT source, doc_id FROM (SELECT source, doc_id, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM documents) WHERE used < 24000")
def _(t):
    d = t("documents").select("source", "doc_id", F.length("text").alias("chars"))
    return rag.within_budget(d, ["source"], ["doc_id"], 24000).select("source", "doc_id")


@query("r5_answer_gate", "SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'insufficient' WHEN turn % 4 <> 0 AND turn >= 1 AND turn <= conv_id % 3 THEN 'answered' ELSE 'rejected_uncited' END AS state FROM conversations")
def _(t):
    answer = F.when(F.col("turn") % 4 != 0, F.concat("text", F.lit(" ["), F.col("turn").cast("string"), F.lit("]"))).otherwise(F.col("text"))
    return t("conversations").select("conv_id", "turn", rag.gate(answer, F.col("conv_id") % 3).alias("state"))
