"""Typed readers for the landing-zone tables.

Reads declare their schema instead of inferring it, so a scan touches only
the parquet footer and the columns a plan actually needs (column pruning and
filter pushdown reach the scan through Catalyst).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

# Fixed schemas of the driver tables (part 2 of FIXTURES.md).
DRIVER_SCHEMAS: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
              "props string",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = DRIVER_SCHEMAS.get(name)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_where(spark: SparkSession, path: str, predicate: Column | None = None,
               columns: list[str] | None = None, schema: T.StructType | str | None = None,
               fmt: str = "parquet") -> DataFrame:
    """A10: read with predicate and projection; both reach the scan."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    df = r.load(path)
    if predicate is not None:
        df = df.filter(predicate)
    if columns:
        df = df.select(*columns)
    return df


def exists(df: DataFrame, predicate: Column | None = None) -> bool:
    """Existence test; stops at the first matching row (``limit 1``)."""
    if predicate is not None:
        df = df.filter(predicate)
    return not df.isEmpty()
