"""Joins, aggregates, windows, samples, set operations and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import relational as R

from .registry import ORACLE_SQL, query, table
from .url_queries import _HREFS, _links


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return R.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("""SELECT user_id, arg_max(CASE WHEN event_type = 'purchase' THEN value END, (ts, event_id)) FILTER (event_type = 'purchase' AND value IS NOT NULL) AS purchase, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY user_id""")
def last_non_null(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("kind"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("purchase"))
    return R.last_known(e, "user_id", ["ts", "event_id"], ["purchase", "kind"])


@query("""WITH o AS (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS a FROM events WHERE event_id % 2 = 0 GROUP BY 1), n AS (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS a FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT n.user_id, n.a AS kinds, o.user_id IS NULL AS is_new FROM n LEFT JOIN o USING (user_id) WHERE o.user_id IS NULL OR o.a IS DISTINCT FROM n.a""")
def insert_if_changed(spark, sf_dir):
    """New observations whose set of values isn't the one known; order and repeats don't count."""
    e = table(spark, sf_dir, "events")
    seen = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("a"))
    joined = seen(1).join(seen(0).withColumnRenamed("a", "old").withColumn("known", F.lit(True)), "user_id", "left")
    return joined.where(F.col("known").isNull() | ~F.col("a").eqNullSafe(F.col("old"))).select("user_id", F.array_join("a", ",").alias("kinds"), F.col("known").isNull().alias("is_new"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join_todo(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem a WHERE l_returnflag = 'A' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'R' AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey)")
def anti_join_composite(spark, sf_dir):
    pairs = lambda flag: table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select("l_partkey", "l_suppkey").distinct()
    return pairs("A").join(pairs("R"), ["l_partkey", "l_suppkey"], "left_anti")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_join_live(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(urgent, "c_custkey", "left_semi")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, -1.0 FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0")
def upsert_do_nothing(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.where(F.col("o_orderkey") % 3 == 0).select("o_orderkey", "o_totalprice")
    return R.insert_missing(old, o.where(F.col("o_orderkey") % 2 == 0).select("o_orderkey", F.lit(-1.0).alias("o_totalprice")), ["o_orderkey"])


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'N' END AS s, o_totalprice * 2 AS p FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(b.s, a.s) AS s, coalesce(b.p, a.p) AS p FROM a FULL JOIN b USING (o_orderkey)""")
def upsert_coalesce_new(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.where(F.col("o_orderkey") % 3 == 0).select("o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    new = o.where(F.col("o_orderkey") % 2 == 0).select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.lit("N")).alias("s"), (F.col("o_totalprice") * 2).alias("p"))
    return R.upsert(old, new, ["o_orderkey"])


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN s_nationkey + 100 ELSE s_nationkey END AS s_nationkey FROM supplier")
def guarded_update(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") < 0, F.col("s_nationkey") + 100).otherwise(F.col("s_nationkey")).alias("s_nationkey"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def delete_done(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == "F").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("(SELECT s_nationkey AS k FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9800) UNION (SELECT c_nationkey FROM customer WHERE c_acctbal > 9800 EXCEPT SELECT s_nationkey FROM supplier)")
def symmetric_difference(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    return R.symmetric_difference(s, table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 9800).select(F.col("c_nationkey").alias("k")).distinct(), ["k"])


@query("SELECT s_name AS name, s_nationkey AS nation, 'supplier' AS feed, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_name, c_nationkey, 'customer', NULL, c_mktsegment FROM customer")
def union_feeds(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("feed"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.lit("customer").alias("feed"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def set_difference(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey").subtract(table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 40).select("l_partkey"))


@query("SELECT count(*) AS shared FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1)")
def intersect_guard(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.where("o_orderkey % 2 = 0").intersect(o.where("o_orderkey % 2 = 1")).agg(F.count("*").alias("shared"))


@query("SELECT c_custkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '5-LOW') ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) = 0")
def having_zero(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "5-LOW").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return c.join(o, "c_custkey", "left").where(F.coalesce("n", F.lit(0)) == 0).select("c_custkey")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
def having_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 15")


@query("SELECT label % 3 AS campaign, array_to_string(list_sort(list(DISTINCT label)), ',') AS clusters FROM embeddings GROUP BY 1")
def array_agg_campaign(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy((F.col("label") % 3).alias("campaign")).agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("clusters"))


@query(f"""WITH {_HREFS}, g AS (SELECT page_id AS doc, (pos // 5)::BIGINT AS page, href FROM h), c AS (SELECT doc, page, count(*) AS n FROM g GROUP BY 1, 2),
d AS (SELECT doc, count(*) AS tot_num_urls, count(DISTINCT href) AS num_unique_urls, count(*) FILTER (page = 0) AS n_uris_first_page FROM g GROUP BY 1),
e AS (SELECT doc, round_even(avg(n), 2) AS avg_uris_per_page, round_even(stddev_samp(n), 2) AS stdev_uris_per_page, string_agg(page || ':' || n, ',' ORDER BY page) AS per_page FROM c GROUP BY 1) SELECT * FROM d JOIN e USING (doc)""")
def doc_aggregate(spark, sf_dir):
    """Link counts of a document and of its pages; rounding is half to even."""
    g = _links(spark, sf_dir).select(F.col("page_id").alias("doc"), F.floor(F.col("pos") / 5).alias("page"), "href")
    d = g.groupBy("doc").agg(F.count("*").alias("tot_num_urls"), F.countDistinct("href").alias("num_unique_urls"), F.count_if(F.col("page") == 0).alias("n_uris_first_page"))
    c = g.groupBy("doc", "page").agg(F.count("*").alias("n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "n"))), lambda x: F.concat_ws(":", x["page"].cast("string"), x["n"].cast("string"))), ",")
    e = c.groupBy("doc").agg(F.bround(F.avg("n"), 2).alias("avg_uris_per_page"), F.bround(F.stddev_samp("n"), 2).alias("stdev_uris_per_page"), listed.alias("per_page"))
    return d.join(e, "doc")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY md5(o_orderkey::VARCHAR || '|7')) <= 10")
def top10_per_key(spark, sf_dir):
    return R.first_per(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [R.draw(F.col("o_orderkey"))], 10)


@query("SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR || '|7')) <= 20")
def anchors20(spark, sf_dir):
    return R.first_per(table(spark, sf_dir, "embeddings").select("label", "vec_id"), ["label"], [R.draw(F.col("vec_id"))], 20)


@query("""WITH a AS (SELECT p_brand, arg_min(p_partkey, md5(p_partkey::VARCHAR || '|1')) AS k FROM part GROUP BY 1), b AS (SELECT p_brand, arg_min(p_partkey, md5(p_partkey::VARCHAR || '|2')) AS k FROM part GROUP BY 1) SELECT * FROM a UNION SELECT * FROM b""")
def two_per_group(spark, sf_dir):
    """One or two rows of each group: two independent draws, with replacement."""
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(*[F.min_by("p_partkey", R.draw(F.col("p_partkey"), seed=s)).alias(f"k{s}") for s in "12"])
    return p.select("p_brand", F.explode(F.array_distinct(F.array("k1", "k2"))).alias("k"))


@query("SELECT l_orderkey, l_linenumber, ntile(7) OVER (ORDER BY md5(l_orderkey::VARCHAR || '|' || l_linenumber || '|7'), l_orderkey, l_linenumber)::INT AS part FROM lineitem")
def ntile_assign(spark, sf_dir):
    """Seven near-equal parts of a shuffled table, by numbers that ranges of the order are given in turn."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", R.draw(F.col("l_orderkey"), F.col("l_linenumber")).alias("draw"))
    rows, total = R.numbered(d, ["draw", "l_orderkey", "l_linenumber"])
    return rows.select("l_orderkey", "l_linenumber", R.near_equal(F.col("row"), total, 7).alias("part"))


@query("SELECT o_orderkey, 'agent' || ((row_number() OVER (ORDER BY o_orderkey) - 1) % 5) AS agent, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 50)::BIGINT AS chunk FROM orders")
def round_robin(spark, sf_dir):
    """Workers in turn, and chunks of fifty, by a row's place in the order of keys."""
    rows, _ = R.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])
    return rows.select("o_orderkey", F.concat(F.lit("agent"), (F.col("row") % 5).cast("string")).alias("agent"), F.floor(F.col("row") / 50).alias("chunk"))


@query("""WITH x AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR || '|7')) AS n, count(*) OVER (PARTITION BY label) AS c FROM embeddings)
SELECT vec_id, CASE WHEN c < 40 THEN 'test' WHEN n <= 20 THEN 'train' WHEN n <= 30 THEN 'val' ELSE 'test' END AS split FROM x""")
def split_train_val_test(spark, sf_dir):
    """Fixed numbers of each class for training and validation, the rest for the test; small classes only for the test."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return R.split_by_class(e, "label", [R.draw(F.col("vec_id"))], 20, 10, 40).select("vec_id", "split")


@query("SELECT p_brand, p_partkey FROM part QUALIFY count(*) OVER (PARTITION BY p_brand) >= 10 AND row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey::VARCHAR || '|7')) <= 30")
def clamp_sizes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey")
    big = p.groupBy("p_brand").agg(F.count("*").alias("n")).where("n >= 10").select("p_brand")
    return R.first_per(p.join(big, "p_brand", "left_semi"), ["p_brand"], [R.draw(F.col("p_partkey"))], 30)


@query("""WITH s AS (SELECT p_type, p_brand, count(*) AS n_s FROM part GROUP BY 1, 2), c AS (SELECT p_type, sum(n_s) AS n_c, count(*) AS k_c FROM s GROUP BY 1), t AS (SELECT sum(n_c) AS n, sum(1.0 / n_c) AS inv FROM c)
SELECT p_type, p_brand, round(1.0 / (n_c * inv), 8) AS class_weight, round(n_c / k_c / n_s, 8) AS sub_weight FROM s JOIN c USING (p_type), t""")
def class_weights(spark, sf_dir):
    """Sampling weights that make classes, and subclasses within a class, equally likely."""
    s = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n_s"))
    c = s.groupBy("p_type").agg(F.sum("n_s").alias("n_c"), F.count("*").alias("k_c"))
    t = c.agg(F.sum(F.lit(1.0) / F.col("n_c")).alias("inv"))
    return s.join(c, "p_type").join(F.broadcast(t)).select("p_type", "p_brand", F.round(1.0 / (F.col("n_c") * F.col("inv")), 8).alias("class_weight"), F.round(F.col("n_c") / F.col("k_c") / F.col("n_s"), 8).alias("sub_weight"))


@query("""WITH v AS (SELECT user_id, event_type = 'error' AS failed, ts, event_id, max(CASE WHEN event_type <> 'error' THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS ok FROM events)
SELECT user_id, count(*) FILTER (failed AND (ok IS NULL OR (ts, event_id) > ok)) AS offline_count, min(ts) FILTER (NOT failed) AS first_online, min(ts) FILTER (failed AND (ok IS NULL OR (ts, event_id) > ok)) AS first_offline, max(ts) AS last_updated FROM v GROUP BY user_id""")
def visit_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return R.fold_visits(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY 1")
def progress_counters(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH a AS (SELECT conv_id, turn, role, text FROM conversations), j AS (SELECT coalesce(x.conv_id, y.conv_id) AS conv_id, coalesce(x.role, y.role) AS role, coalesce(y.v, x.v + 1) AS version, x.t AS old, y.t AS new
 FROM (SELECT conv_id, turn // 2 AS v, role, text AS t FROM a WHERE turn // 2 < (SELECT max(turn) FROM a z WHERE z.conv_id = a.conv_id) // 2) x FULL JOIN (SELECT conv_id, turn // 2 AS v, role, text AS t FROM a WHERE turn >= 2) y ON x.conv_id = y.conv_id AND x.role = y.role AND x.v + 1 = y.v)
SELECT conv_id, version::BIGINT AS version, role, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN old <> new THEN 'modified' ELSE 'same' END AS change, count(*) AS n FROM j GROUP BY ALL""")
def change_log(spark, sf_dir):
    """What each version of a conversation adds, changes and removes against the version before."""
    a = table(spark, sf_dir, "conversations").select("conv_id", F.floor(F.col("turn") / 2).alias("v"), "role", "text")
    last = a.groupBy("conv_id").agg(F.max("v").alias("last"))
    old = a.join(last, "conv_id").where("v < last").select("conv_id", (F.col("v") + 1).alias("version"), "role", F.col("text").alias("old"))
    new = a.where("v >= 1").select("conv_id", F.col("v").alias("version"), "role", F.col("text").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified").otherwise("same")
    return old.join(new, ["conv_id", "version", "role"], "full").groupBy("conv_id", "version", "role", change.alias("change")).agg(F.count("*").alias("n"))
