"""Upserts, deletions and state folds as merges of a stored table, one run after the other, with runs that are repeated."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmesh.operators import relational as R
from quillmesh.operators.storage import shared_root
from quillmesh.sources.merged import MergedTable

from .registry import query, table
from .relational_queries import ORACLE_SQL


def fresh(spark, schema: str, key: list[str]) -> MergedTable:
    """An empty table in the shared folder."""
    return MergedTable(spark, f"{shared_root(spark)}/quillmesh/table-{uuid.uuid4().hex}", schema, key)


@query(ORACLE_SQL["upsert_coalesce_new"])
def stored_upsert(spark, sf_dir):
    """Orders of two feeds, the later one preferred where it isn't null; the second run comes twice."""
    o = table(spark, sf_dir, "orders")
    old = o.where(F.col("o_orderkey") % 3 == 0).select("o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    new = o.where(F.col("o_orderkey") % 2 == 0).select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.lit("N")).alias("s"), (F.col("o_totalprice") * 2).alias("p"))
    t = fresh(spark, "o_orderkey long, s string, p double", ["o_orderkey"])
    for run, rows in (("first", old), ("second", new), ("second", new)):
        t.merge(rows, lambda a, b: R.upsert(a, b, ["o_orderkey"]), run)
    return t.read()


@query(ORACLE_SQL["visit_state"])
def stored_visit_state(spark, sf_dir):
    """The state of each key, folded day by day into a stored table; a day that comes again changes nothing."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("failed"))
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    cuts = [low + (high - low) * k / 3 for k in (1, 2)] if low else []
    t = fresh(spark, "user_id long, offline_count long, first_online timestamp_ntz, first_offline timestamp_ntz, last_updated timestamp_ntz", ["user_id"])
    edges = [None, *cuts, None]
    for k in [*range(len(edges) - 1), 0]:
        lo, hi = edges[k], edges[k + 1]
        part = e.where((F.lit(True) if lo is None else F.col("ts") >= F.lit(lo)) & (F.lit(True) if hi is None else F.col("ts") < F.lit(hi)))
        t.merge(R.fold_visits(part, "user_id", ["ts", "event_id"], F.col("failed")), lambda a, b: R.fold_states(a, b, "user_id"), f"part-{k}")
    return t.read()


_ROW = "source, segment, city, balance"


@query(f"""WITH c AS (SELECT client_id, seq, change_id, op, {_ROW} FROM client_changes WHERE client_id IS NOT NULL),
w AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY seq DESC NULLS LAST, change_id DESC NULLS LAST, op DESC, source DESC NULLS LAST, segment DESC NULLS LAST, city DESC NULLS LAST, balance DESC NULLS LAST) = 1),
b AS (SELECT client_id, {_ROW} FROM clients WHERE client_id IS NOT NULL AND client_id NOT IN (SELECT client_id FROM w))
SELECT client_id, {_ROW} FROM w WHERE op <> 'D' UNION ALL SELECT client_id, {_ROW} FROM b""")
def stored_clients(spark, sf_dir):
    """Clients after all their changes: a load, then changes in three runs by their number, the last run first, as they may arrive.

    The change with the greatest (seq, change_id) holds, whenever it comes; a deletion stays as a mark, so that an older
    change that comes later finds it.
    """
    row = ["source", "segment", "city", "balance"]
    base = table(spark, sf_dir, "clients").where("client_id IS NOT NULL").select("client_id", F.lit(-1).cast("long").alias("seq"), F.lit(-1).cast("long").alias("change_id"), F.lit("I").alias("op"), *row)
    changes = table(spark, sf_dir, "client_changes").where("client_id IS NOT NULL").select("client_id", "seq", "change_id", "op", *row)
    newest = lambda df: R.latest(df, ["client_id"], ["seq", "change_id", "op", *row])
    t = fresh(spark, "client_id long, seq long, change_id long, op string, source string, segment string, city string, balance double", ["client_id"])
    fold = lambda old, new: newest(old.unionByName(new))
    t.merge(R.latest(base, ["client_id"], row), fold, "load")
    for k in (2, 0, 1, 2):
        t.merge(newest(changes.where(F.pmod(F.coalesce("change_id", F.lit(0)), F.lit(3)) == k)), fold, f"changes-{k}")
    return t.read().where("op <> 'D'").select("client_id", *row)
