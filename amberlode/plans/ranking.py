"""Windows, sorts, limits, pages and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from amberlode.functions import similarity as S
from amberlode.plans.registry import query


def first_of(df, by, order, n=1):
    """The first `n` rows of each group in a total order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


@query("w2_primary_per_group", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, ts, event_id) = 1")
def _(t):
    return first_of(t("events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.when(F.col("event_type") == "purchase", 0).otherwise(1), "ts", "event_id"]).drop("ts")


@query("w3_latest", "SELECT md5(text) AS h, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents GROUP BY 1")
def _(t):
    """The last row of a group by aggregation: unlike a window, it combines before the shuffle."""
    return t("documents").groupBy(F.md5("text").alias("h")).agg(F.max("doc_id").alias("doc_id"), F.max_by("source", "doc_id").alias("source"))


@query("w4_current_revision", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def _(t):
    last = F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("x")
    return t("orders").groupBy("o_custkey").agg(last).select("o_custkey", "x.o_orderkey", "x.o_orderstatus")


@query("w5_sequence", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) + 100 AS seq FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", "role", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")) + 100).cast("long").alias("seq"))


@query("o1_sorted", "SELECT p_partkey, p_name FROM part ORDER BY p_name ASC, p_partkey LIMIT 50")
def _(t):
    return t("part").select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(50)


@query("o2_multi_key", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey LIMIT 50")
def _(t):
    return t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(F.desc("o_orderpriority"), F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("o3_page", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 200")
def _(t):
    """Page 3 of at most 100 rows, with the total beside it."""
    page, per_page = 3, max(1, min(100, 250))
    found = t("orders").where("o_orderstatus = 'O'")
    rows = found.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset((page - 1) * per_page).limit(per_page)
    return rows.join(F.broadcast(found.agg(F.count("*").alias("total"))), how="cross").select("o_orderkey", "total")


@query("o4_top_k", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def _(t):
    return t("documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


def _dot(a, b):
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)), lambda x, y: x + y)"


V1_SQL = f"""WITH v AS (SELECT *, label % 2 AS model, vec_id % 9 <> 4 AS is_public FROM embeddings), q AS (SELECT model, arg_min(embedding, vec_id) AS qe FROM v GROUP BY model)
SELECT v.model, vec_id, round({_dot('embedding', 'qe')} / sqrt({_dot('embedding', 'embedding')} * {_dot('qe', 'qe')}), 6) AS score FROM v JOIN q ON q.model = v.model WHERE is_public QUALIFY row_number() OVER (PARTITION BY v.model ORDER BY score DESC, vec_id) <= 20"""


@query("v1_vector_topk", V1_SQL)
def _(t):
    """Exact cosine top-k of each model over all its public vectors; each model's query is its first vector."""
    v = t("embeddings").withColumn("model", F.col("label") % 2)
    one = v.groupBy("model").agg(F.min_by("embedding", "vec_id").alias("qe"))
    score = S.dot(F.col("embedding"), F.col("qe")) / F.sqrt(S.dot(F.col("embedding"), F.col("embedding")) * S.dot(F.col("qe"), F.col("qe")))
    scored = v.where("vec_id % 9 <> 4").join(F.broadcast(one), "model").select("model", "vec_id", F.round(score, 6).alias("score"))  # two models
    return first_of(scored, ["model"], [F.desc("score"), "vec_id"], 20)


@query("o5_vector_heap", f"SELECT label, vec_id, score FROM (SELECT a.label, b.vec_id, round({_dot('a.embedding', 'b.embedding')}, 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id = (SELECT min(vec_id) FROM embeddings c WHERE c.label = a.label)) QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 5")
def _(t):
    """Per label, the five vectors nearest to its first one."""
    e = t("embeddings")
    first = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("q"))
    scored = e.join(first, "label").where(F.col("vec_id") != F.col("q.vec_id")).select("label", "vec_id", F.round(S.dot(F.col("q.embedding"), F.col("embedding")), 6).alias("score"))
    return first_of(scored, ["label"], [F.desc("score"), "vec_id"], 5)


@query("o6_random_slot", "SELECT lang, min(doc_id) AS doc_id FROM (SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':7'), doc_id) = 1) GROUP BY lang")
def _(t):
    """One row per slot in hash order: as good as random, and the same on every run."""
    return t("documents").groupBy("lang").agg(F.min_by("doc_id", F.struct(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":7"))), "doc_id")).alias("doc_id"))


@query("o7_ordered_cap", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_orderkey, l_linenumber LIMIT 500")
def _(t):
    return t("lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber").limit(500)


@query("o8_case_order", "SELECT event_id, event_type FROM events ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, event_id LIMIT 100")
def _(t):
    return t("events").select("event_id", "event_type").orderBy(F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2), "event_id").limit(100)


@query("u1_union_all", "SELECT 'customer' AS layer, c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT 'supplier', s_suppkey, NULL FROM supplier")
def _(t):
    c = t("customer").select(F.lit("customer").alias("layer"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return c.unionByName(t("supplier").select(F.lit("supplier").alias("layer"), F.col("s_suppkey").alias("k")), allowMissingColumns=True)


@query("u2_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("u3_intersection", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def _(t):
    lines = t("lineitem")
    return lines.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).intersect(lines.where("l_quantity > 49").select("l_partkey"))


@query("u4_difference", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def _(t):
    return t("part").select(F.col("p_partkey").alias("k")).join(t("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k")), "k", "left_anti").distinct()


@query("u5_set_statements", "(SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def _(t):
    c, s = t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k"))
    return c.subtract(s).unionAll(c.intersect(s))
