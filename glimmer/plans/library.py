"""Queries: the library's relational operations. Customers are access codes, orders their items, line items children."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import crossing, nearest
from ..registry import query
from ..sources.tables import table

NOW = "1998-01-01"


@query("q1_upsert", """
SELECT l_orderkey, l_partkey, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS first_supplier, arg_max(l_shipdate, (l_linenumber, l_shipdate)) AS consent FROM lineitem GROUP BY l_orderkey, l_partkey""")
def q1(spark, sf_dir):
    """Insert or refresh by (order, part): first writes keep the supplier, later ones only renew the consent date."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("first_supplier"), F.max_by("l_shipdate", F.struct("l_linenumber", "l_shipdate")).alias("consent"))


@query("q2_point_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7 UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = 10 AND o_orderstatus = 'O'")
def q2(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return o.filter("o_orderkey = 7").unionByName(o.filter("o_custkey = 10 and o_orderstatus = 'O'"))


@query("q3_owner_list", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey))::INT AS rank FROM orders) WHERE rank <= 5")
def q3(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank")).filter("rank <= 5")


@query("q4_sparse_patch", """
WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'PATCHED' END AS seg, CASE WHEN c_custkey % 5 = 0 THEN 0.0::DOUBLE END AS bal FROM customer WHERE c_custkey % 15 IN (0, 3, 5))
SELECT c.c_custkey, coalesce(p.seg, c_mktsegment) AS c_mktsegment, coalesce(p.bal, c_acctbal) AS c_acctbal FROM customer c LEFT JOIN p ON c.c_custkey = p.c_custkey""")
def q4(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    p = c.filter((F.col("c_custkey") % 15).isin(0, 3, 5)).select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "PATCHED").alias("seg"), F.when(F.col("c_custkey") % 5 == 0, 0.0).alias("bal"))
    return c.join(p, "c_custkey", "left").select("c_custkey", F.coalesce("seg", "c_mktsegment").alias("c_mktsegment"), F.coalesce("bal", "c_acctbal").alias("c_acctbal"))


@query("q5_ready_transition", """
WITH l AS (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS last FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN l.n IS NOT NULL THEN 'ready' ELSE o_orderstatus END AS status, coalesce(l.n, 0) AS frames, l.last FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""")
def q5(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("last"))
    o = table(spark, sf_dir, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.when(F.col("n").isNotNull(), "ready").otherwise(F.col("o_orderstatus")).alias("status"), F.coalesce("n", F.lit(0)).alias("frames"), "last")


@query("q6_replace_children", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 10 <> 0
UNION ALL SELECT l_orderkey, (l_linenumber + 100)::INT, l_quantity + 1 FROM lineitem WHERE l_orderkey % 10 = 0 AND l_linenumber = 1""")
def q6(spark, sf_dir):
    """All children of the replaced parents go, the new ones come."""
    old = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = old.filter("l_orderkey % 10 = 0 and l_linenumber = 1").select("l_orderkey", (F.col("l_linenumber") + 100).alias("l_linenumber"), (F.col("l_quantity") + 1).alias("l_quantity"))
    replaced = old.filter("l_orderkey % 10 = 0").select("l_orderkey").distinct()
    return old.join(replaced, "l_orderkey", "left_anti").unionByName(new)


@query("q7_vector_similarity", """
WITH q AS (SELECT vec_id AS q, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0)
SELECT q, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS similarity FROM embeddings, q""")
def q7(spark, sf_dir):
    """The stored vectors whose id is divisible by 50 against all rows, in blocks of queries."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return crossing.every(e, e.filter("id % 50 = 0").withColumnRenamed("id", "q"), 6).withColumnRenamed("id", "vec_id")


@query("q7_nearest_vectors", """
WITH q AS (SELECT vec_id AS q, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS s FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) AS rank FROM s)
SELECT q, vec_id, round(s, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 10""")
def q7_nearest(spark, sf_dir):
    """The ten nearest of all stored vectors for each one whose id is divisible by 50."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found, _ = nearest.top_k(e, e.filter("id % 50 = 0"), 10)
    return found.select("q", F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "rank")


@query("q8_vector_literal", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: round(x, 8))), 5) AS total, len(embedding)::INT AS n FROM embeddings")
def q8(spark, sf_dir):
    """Vectors as stored: eight decimals."""
    stored = F.transform("embedding", lambda x: F.round(x.cast("double"), 8))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(stored, F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.size("embedding").alias("n"))


@query("q9_latest", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def q9(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("q10_messages", "SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS roles, count(*) AS n FROM conversations GROUP BY conv_id")
def q10(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"), F.count(F.lit(1)).alias("n"))
    return c.select("conv_id", F.array_join(F.col("m.role"), ",").alias("roles"), "n")


@query("q11_cascade_delete", """
WITH o AS (SELECT o_orderkey, c_acctbal < 0 AS gone FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
SELECT 'orders' AS kind, count(*) FILTER (WHERE gone IS NOT TRUE) AS kept, count(*) FILTER (WHERE gone) AS deleted FROM o UNION ALL SELECT 'lineitem', count(*) FILTER (WHERE gone IS NOT TRUE), count(*) FILTER (WHERE gone) FROM lineitem LEFT JOIN o ON l_orderkey = o_orderkey""")
def q11(spark, sf_dir):
    """Owners in debt go with their orders and those orders' items; what stays and what goes is counted."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") < 0).alias("gone"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(orders, "o_orderkey", "left")
    gone = F.coalesce("gone", F.lit(False))
    n = lambda d, kind: d.agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("deleted")).select(F.lit(kind).alias("kind"), "kept", "deleted")
    return n(orders, "orders").unionByName(n(items, "lineitem"))


@query("q12_correlated_counts", f"""
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderdate > TIMESTAMP '{NOW}') AS n_live FROM customer""")
def q12(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderdate") > F.lit(NOW).cast("timestamp_ntz")).alias("live"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("live", F.lit(0)).alias("n_live"))


@query("q13_prefix_resolution", """
WITH p(prefix) AS (VALUES ('149'), ('12'), ('zzz')), m AS (SELECT prefix, min(c_custkey) AS c_custkey, count(c_custkey) AS n FROM p LEFT JOIN customer ON starts_with(c_custkey::VARCHAR, prefix) GROUP BY prefix)
SELECT prefix, n, CASE WHEN n = 1 THEN c_custkey END AS c_custkey FROM m""")
def q13(spark, sf_dir):
    """A prefix names a code only if exactly one starts with it."""
    p = F.broadcast(spark.createDataFrame([("149",), ("12",), ("zzz",)], "prefix string"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    hits = c.join(p, F.startswith(F.col("c_custkey").cast("string"), F.col("prefix"))).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("k"))
    return p.join(hits, "prefix", "left").select("prefix", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("k")).alias("c_custkey"))


@query("q14_transfer", """
SELECT l_orderkey, l_partkey FROM lineitem v WHERE l_suppkey = 1 AND NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_suppkey = 2 AND o.l_partkey = v.l_partkey)""")
def q14(spark, sf_dir):
    """What can move from owner 1 to owner 2, who may hold the same part already."""
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return v.filter("l_suppkey = 1").join(v.filter("l_suppkey = 2").select("l_partkey"), "l_partkey", "left_anti").select("l_orderkey", "l_partkey")


@query("q16_valid_sessions", f"""
SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderdate > TIMESTAMP '1996-01-01' AND c_acctbal >= 0 AND (nullif(c_mktsegment, 'BUILDING') IS NULL OR c_nationkey > 5)""")
def q16(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter((F.col("c_acctbal") >= 0) & (F.nullif("c_mktsegment", F.lit("BUILDING")).isNull() | (F.col("c_nationkey") > 5)))
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") > F.lit("1996-01-01").cast("timestamp_ntz"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_custkey")


@query("q17_login", """
WITH s AS (SELECT o_orderkey, o_custkey, sha256(o_orderkey::VARCHAR) AS h, o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 900 DAY AS valid FROM orders), p AS (SELECT DISTINCT sha256(l_orderkey::VARCHAR) AS h FROM lineitem)
SELECT s.o_orderkey, s.o_custkey, p.h IS NOT NULL AS logged_in FROM s LEFT JOIN p ON s.h = p.h WHERE valid""")
def q17(spark, sf_dir):
    """Sessions (orders) after the expired ones are purged, and which of them a presented token's hash logs in."""
    o = table(spark, sf_dir, "orders")
    now = o.agg(F.max("o_orderdate").alias("now"))
    s = o.crossJoin(F.broadcast(now)).filter(F.col("o_orderdate") > F.col("now") - F.expr("interval 900 days")).select("o_orderkey", "o_custkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("h"))
    p = table(spark, sf_dir, "lineitem").select(F.sha2(F.col("l_orderkey").cast("string"), 256).alias("h")).distinct().withColumn("logged_in", F.lit(True))
    return s.join(p, "h", "left").select("o_orderkey", "o_custkey", F.coalesce("logged_in", F.lit(False)).alias("logged_in"))


@query("q18_guarded_counter", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def q18(spark, sf_dir):
    w = W.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", (F.row_number().over(w) <= 2).alias("allowed"))


@query("q19_refund", """
WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS n FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT r.user_id, e.i, CASE WHEN e.event_type = 'error' THEN greatest(r.n - 1, 0) WHEN r.n < 20 THEN r.n + 1 ELSE r.n END FROM r JOIN e ON r.user_id = e.user_id AND e.i = r.i + 1)
SELECT user_id, arg_max(n, i)::INT AS count FROM r GROUP BY user_id""")
def q19(spark, sf_dir):
    """An ordered fold: each event charges up to a cap of 20, each error gives one back, never below zero."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("es"))
    step = lambda n, x: F.when(x["event_type"] == "error", F.greatest(n - 1, F.lit(0))).when(n < 20, n + 1).otherwise(n)
    return e.select("user_id", F.aggregate("es", F.lit(0), step).alias("count"))


@query("q20_cap_day", """
SELECT event_id, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin')::DATE AS day, (((ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin')::DATE + 1)::TIMESTAMP AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC' AS resets_at FROM events""")
def q20(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("Europe/Berlin"), F.col("ts"))))
    reset = F.convert_timezone(F.lit("Europe/Berlin"), F.lit("UTC"), F.date_add("day", 1).cast("timestamp_ntz"))
    return e.select("event_id", "day", reset.alias("resets_at"))


_CODE = "CASE c_custkey % 4 WHEN 0 THEN concat('glim-', substr(md5(c_name), 1, 8), '-', substr(md5(c_name), 9, 8)) WHEN 1 THEN concat('O ', substr(md5(c_name), 1, 15)) WHEN 2 THEN substr(md5(c_name), 1, 10) ELSE concat(substr(md5(c_name), 1, 15), 'u') END"


@query("q21_code_hash", f"""
WITH r AS (SELECT c_custkey, regexp_replace(upper({_CODE}), '[^0-9A-Z]', '', 'g') AS r FROM customer), s AS (SELECT c_custkey, translate(CASE WHEN starts_with(r, 'GLIM') AND length(r) = 20 THEN substr(r, 5) ELSE r END, 'OIL', '011') AS s FROM r),
v AS (SELECT c_custkey, CASE WHEN regexp_full_match(s, '[0123456789ABCDEFGHJKMNPQRSTVWXYZ]{{16}}') THEN s END AS code FROM s)
SELECT c_custkey, code, sha256(code) AS hash FROM v""")
def q21(spark, sf_dir):
    """Customers' codes as people type them: with prefix and dashes, with look-alike letters, too short, with a letter that is none."""
    c = table(spark, sf_dir, "customer").withColumn("typed", F.expr(_CODE)).select("c_custkey", T.normalize_code("typed").alias("code"))
    return c.withColumn("hash", F.sha2("code", 256))


@query("q22_claim_unowned", "SELECT c_custkey, coalesce(CASE WHEN c_nationkey % 4 <> 0 THEN c_nationkey END, 99)::INT AS owner FROM customer")
def q22(spark, sf_dir):
    owner = F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(owner, F.lit(99)).alias("owner"))


@query("j13_anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def j13(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(r, "o_orderkey", "left_anti")


@query("j14_semi_join", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.08)")
def j14(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").filter("l_discount > 0.08").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(r, "o_orderkey", "left_semi")


@query("j15_expected_left_join", "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j15(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


@query("j10_attach", """
SELECT c.conv_id, c.turn, c.role, d.source, l.quality FROM conversations c LEFT JOIN documents d ON c.conv_id = d.doc_id LEFT JOIN labels l ON c.conv_id = l.doc_id""")
def j10(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), "source")
    q = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), "quality")
    return c.join(d, "conv_id", "left").join(q, "conv_id", "left")


@query("x3_intersection", """
WITH o AS (SELECT user_id, event_type FROM events WHERE value > 50)
SELECT user_id FROM o GROUP BY user_id HAVING count(DISTINCT event_type) = 5""")
def x3(spark, sf_dir):
    """Ids present in every condition."""
    o = table(spark, sf_dir, "events").filter("value > 50")
    return o.groupBy("user_id").agg(F.count_distinct("event_type").alias("n")).filter("n = 5").select("user_id")


@query("x5_difference", """
SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'dead' ELSE 'pending' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(l.quality, 0) <> 1""")
def x5(spark, sf_dir):
    """Wanted but not there, split into dead and pending."""
    d, q = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    missing = d.join(q.filter("quality = 1").select("doc_id"), "doc_id", "left_anti")
    dead = q.filter("toxic = 1").select("doc_id")
    return missing.join(dead, "doc_id", "left_semi").withColumn("state", F.lit("dead")).unionByName(missing.join(dead, "doc_id", "left_anti").withColumn("state", F.lit("pending")))
