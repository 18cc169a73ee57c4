"""Source/sink queries: keyed upserts, delete, recent window.

The incoming batches are derived from the given tables by fixed rules (open
orders get closed with a new price; urgent orders are re-issued under a new
(negative) key), so the work grows with the tables."""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import functions as F

from perflog.plans.registry import register
from perflog.plans.sqlbits import R4, r4
from perflog.session import checkpoint_dir
from perflog.sources import store as S
from perflog.sources.tables import read_table

_INC_SQL = f"""
  select o_orderkey, 'F' as o_orderstatus, o_totalprice + 100.0 as o_totalprice, 'closed' as note
  from orders where o_orderstatus = 'O'
  union all
  select -o_orderkey - 1, o_orderstatus, o_totalprice, 'reissued' from orders
  where o_orderpriority = '1-URGENT'"""


def _incoming(o):
    closed = o.filter(F.col("o_orderstatus") == "O").select(
        "o_orderkey", F.lit("F").alias("o_orderstatus"), (F.col("o_totalprice") + 100.0).alias("o_totalprice"),
        F.lit("closed").alias("note"))
    reissued = o.filter(F.col("o_orderpriority") == "1-URGENT").select(
        (-F.col("o_orderkey") - 1).alias("o_orderkey"), "o_orderstatus", "o_totalprice",
        F.lit("reissued").alias("note"))
    return closed.unionByName(reissued)


_BASE = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@register("upsert_partial", "A9", f"""
with inc as ({_INC_SQL}),
e as (select {', '.join(_BASE)} from orders)
select coalesce(e.o_orderkey, i.o_orderkey) as o_orderkey, cast(e.o_custkey as double) as o_custkey,
  case when i.o_orderkey is not null then i.o_orderstatus else e.o_orderstatus end as o_orderstatus,
  {R4('case when i.o_orderkey is not null then i.o_totalprice else e.o_totalprice end')} as o_totalprice,
  e.o_orderpriority, i.note
from e full outer join inc i on e.o_orderkey = i.o_orderkey
""")
def upsert_partial(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select(*_BASE)
    out = S.upsert_partial(o, _incoming(o), ["o_orderkey"], ["note"])
    # inserted rows have no customer: a nullable id surfaces as double
    return out.withColumns({"o_totalprice": r4("o_totalprice"), "o_custkey": F.col("o_custkey").cast("double")})


@register("upsert_latest", "A8 A9 H2", f"""
with inc as (select *, timestamp '2021-01-01 00:00:00' as updated_at from ({_INC_SQL})),
e as (select o_orderkey, o_orderstatus, o_totalprice, null as note, timestamp '2020-01-01 00:00:00' as updated_at
      from orders),
u as (select *, row_number() over (partition by o_orderkey order by updated_at desc) as v
      from (select * from e union all select * from inc))
select o_orderkey, o_orderstatus, {R4('o_totalprice')} as o_totalprice, note,
       cast(year(updated_at) as int) as version_year
from u where v = 1
""")
def upsert_latest(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    e = S.stamp(o.select("o_orderkey", "o_orderstatus", "o_totalprice"), _dt.datetime(2020, 1, 1))
    inc = S.stamp(_incoming(o), _dt.datetime(2021, 1, 1))
    out = S.upsert_latest(e, inc, ["o_orderkey"])
    return out.select("o_orderkey", "o_orderstatus", r4("o_totalprice").alias("o_totalprice"), "note",
                      F.year("updated_at").cast("int").alias("version_year"))


_BATCH = """select o_orderkey, 'F' as o_orderstatus, o_totalprice + 100.0 as o_totalprice from orders
  where o_orderstatus = 'P' and o_orderdate >= (select date_trunc('year', max(o_orderdate)) from orders)"""


@register("upsert_stored", "A8 A9 A12", f"""
with inc as ({_BATCH})
select o_orderkey, o_custkey, coalesce(i.o_orderstatus, e.o_orderstatus) as o_orderstatus, {R4('coalesce(i.o_totalprice, e.o_totalprice)')} as o_totalprice,
  cast(year(e.o_orderdate) as int) as season
from orders e left join inc i using (o_orderkey)
where not (coalesce(i.o_orderstatus, e.o_orderstatus) = 'O' and year(e.o_orderdate) = (select min(year(o_orderdate)) from orders))
""")
def upsert_stored(spark, sf_dir):
    """Orders stored by year; the pending ones of the last year are closed at another price, the open ones of the first
    year deleted.  Both rewrite one partition."""
    o = read_table(spark, sf_dir, "orders")
    path = f"{checkpoint_dir(spark)}/orders-{uuid.uuid4().hex}"
    rows = o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("season"))
    rows.write.partitionBy("season").parquet(path)
    first, last = rows.agg(F.min("season"), F.max("season")).first()
    batch = rows.where((F.col("o_orderstatus") == "P") & (F.col("season") == last)).select(
        "o_orderkey", F.lit("F").alias("o_orderstatus"), (F.col("o_totalprice") + 100.0).alias("o_totalprice"))
    S.merge_stored(spark, path, batch, ["o_orderkey"], ["o_totalprice"], ["season"])
    S.delete_stored(spark, path, (F.col("o_orderstatus") == "O") & (F.col("season") == first), ["season"])
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", "o_orderstatus", r4("o_totalprice").alias("o_totalprice"), "season")


@register("delete_where", "A12 A10", """
select o_orderkey, o_custkey from orders
where not coalesce(o_orderstatus = 'P' and o_totalprice < 100000, false)
""")
def delete_where(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    pred = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 100000)
    return S.delete_where(o, pred).select("o_orderkey", "o_custkey")


@register("recent_window", "A6 E8", """
select event_id, user_id from events
where ts >= (select max(ts) from events) - interval 7 day and ts <= (select max(ts) from events)
""")
def recent_window(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    as_of = ev.agg(F.max("ts")).first()[0]      # freshness: one scalar from a partial aggregate
    return S.recent_window(ev, "ts", 7, as_of).select("event_id", "user_id")
