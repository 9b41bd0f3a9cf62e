"""Streaming queries over the events table, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmesh.functions import variants
from quillmesh.operators.storage import shared_root
from quillmesh.sources.queue import StreamQueue

from quillmesh.streaming import passes
from quillmesh.streaming import retries as T
from quillmesh.streaming import visits as S

from . import extra_queries, relational_queries  # noqa: F401  (their SQL holds for streams, too)
from .registry import ORACLE_SQL, query, table


def stream_of(spark, sf_dir, name):
    """A table as a stream; a pattern, as a stream takes a folder or files that match one."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


@query(ORACLE_SQL["visit_state"])
def stream_visit_state(spark, sf_dir):
    """The state of each key from a stream of its visits; the same rows as the batch fold."""
    path = f"{sf_dir}/[e]vents.parquet"  # a pattern: a stream takes a folder or a file that matches one
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(path).select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("failed"))
    return S.run_to_end(spark, S.visit_states(e)).drop("seen")


@query(ORACLE_SQL["spaced_retries"])
def stream_retries(spark, sf_dir):
    """Attempts of each key from a stream with timers; the same rows as the batch fold, `spaced_retries`."""
    e = stream_of(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"))
    with T.rocks(spark):
        events = S.drained(spark, T.retries(e, "user_id", "ts", "failed", wait_ms=5 * 3_600_000, keep_ms=10_000 * 86_400_000))
    return T.outcomes(events, "user_id")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, (SELECT count(*) FROM events) AS seen, (SELECT count(*) FROM events WHERE event_type = 'error') AS failed FROM events GROUP BY 1")
def stream_progress(spark, sf_dir):
    """Counts by kind, with the counters that were taken while the stream ran."""
    e = stream_of(spark, sf_dir, "events").select("user_id", "event_type")
    rows, counters = S.metered(spark, e, {"seen": F.count("*"), "failed": F.count_if(F.col("event_type") == "error")})
    total = {name: sum(c[name] for c in counters) for name in ("seen", "failed")}
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).select("*", *[F.lit(v).alias(k) for k, v in total.items()])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 1 THEN 'first' ELSE 'second' END AS since, c_custkey % 5 = 0 AS done FROM customer WHERE c_custkey % 3 <> 1 OR c_custkey % 2 = 0")
def queue_stream(spark, sf_dir):
    """Customers that overlapping pushes brought into a queue, one of them repeated, as two runs of a stream took them out."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    at = f"{shared_root(spark)}/quillmesh/queue-{uuid.uuid4().hex}"
    q = StreamQueue(spark, at, "c_custkey long, c_name string", ["c_custkey"])
    one, two = c.where("c_custkey % 3 <> 1"), c.where("c_custkey % 2 = 0")
    q.push(one.unionByName(one), "first")
    S.drained(spark, q.stream(), f"{at}/worker")
    for run in ("second", "first", "second"):
        q.push(two if run == "second" else one, run)
    taken = S.drained(spark, q.stream(), f"{at}/worker")
    q.finish(taken.where("c_custkey % 5 = 0"), "fifth")
    return taken.join(q.waiting().select("c_custkey", F.lit(False).alias("_w")), "c_custkey", "left").select("c_custkey", "since", F.coalesce("_w", F.lit(True)).alias("done"))


@query("""WITH j AS (SELECT click_id, props::JSON AS p FROM clicks WHERE json_valid(props)),
x AS (SELECT j.click_id, regexp_replace(replace(substr(fullkey, 3), '"', ''), '\\[\\d+\\]', '[]', 'g') AS path, type, atom FROM j, json_tree(j.p) WHERE type NOT IN ('OBJECT', 'ARRAY') AND fullkey <> '$')
SELECT path, count(*) AS n, count(DISTINCT click_id) AS clicks, min(json_extract_string(atom, '$')) AS least, max(json_extract_string(atom, '$')) AS most FROM x GROUP BY path""")
def click_labels(spark, sf_dir):
    """Every label in the clicks' properties, known ahead or not; broken JSON has none."""
    found = variants.labels(table(spark, sf_dir, "clicks").select("click_id", "props"), "props", ["click_id"])
    return found.groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("click_id").alias("clicks"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("""WITH d AS (SELECT o_orderkey, o_orderdate AS at, o_orderkey % 3 = 0 AS ok, 'direct' AS source FROM orders), r AS (SELECT o_orderkey, o_orderdate + INTERVAL 30 MINUTE AS at, true AS ok, 'rescan' AS source FROM orders WHERE o_orderkey % 2 = 0)
SELECT d.o_orderkey, coalesce(r.at, d.at) AS at, coalesce(r.ok, d.ok) AS ok, coalesce(r.source, d.source) AS source FROM d LEFT JOIN r ON r.o_orderkey = d.o_orderkey AND NOT d.ok WHERE d.at < (SELECT max(o_orderdate) - INTERVAL 1 DAY FROM orders)""")
def stream_two_pass(spark, sf_dir):
    """Orders as results of a scan and of a later one, joined as they arrive; those of the last day still wait."""
    o = stream_of(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    direct = o.select("o_orderkey", "at", (F.col("o_orderkey") % 3 == 0).alias("ok"), F.lit("direct").alias("source"))
    again = stream_of(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 30 MINUTES")).alias("at")).where("o_orderkey % 2 = 0")
    rescan = again.select("o_orderkey", "at", F.lit(True).alias("ok"), F.lit("rescan").alias("source"))
    out = S.drained(spark, passes.two_pass(direct, rescan, "o_orderkey", "at", "ok"), mode="append")
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("m"))  # one row
    start = F.col("at") - F.when(F.col("second"), F.expr("INTERVAL 30 MINUTES")).otherwise(F.expr("INTERVAL 0 MINUTES"))
    out = out.join(F.broadcast(last), start.cast("timestamp_ntz") < F.col("m") - F.expr("INTERVAL 1 DAY"))
    return out.select("o_orderkey", F.col("at").cast("timestamp_ntz").alias("at"), "ok", "source")
