"""An orders table with planted issues, from SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_Y, _M, _D = "cast(year(o_orderdate) as string)", "lpad(cast(month(o_orderdate) as string), 2, '0')", "lpad(cast(day(o_orderdate) as string), 2, '0')"
_NAME = "case month(o_orderdate) " + " ".join(f"when {k} then '{m}'" for k, m in enumerate(_MONTHS, 1)) + " end"

COLUMNS = ["order_id", "channel", "status", "segment_cd", "total_amount", "qty", "age", "order_date", "is_gift", "notes"]
ORDERS = f"""
SELECT o_orderkey AS row_id,
 'ORD-' || cast(50000 + o_orderkey as string) AS order_id,
 case o_orderkey % 7 when 0 then 'WEB' when 1 then 'web' when 2 then ' Web ' when 3 then 'Store' when 4 then 'store' when 5 then 'Phone' end AS channel,
 case when o_orderkey % 53 = 0 then 'Fulfiled' when o_orderstatus = 'F' then 'Fulfilled' when o_orderstatus = 'O' then 'Open' else 'Pending' end AS status,
 case when o_custkey % 31 = 0 then '' else 'S' || cast(o_custkey % 8 as string) end AS segment_cd,
 case when o_orderkey % 41 = 0 then 'N/A' when o_orderkey % 43 = 0 then '' when o_orderkey % 47 = 0 then '  ' when o_orderkey % 101 = 0 then '1e5'
      else cast(cast(o_totalprice as decimal(12,2)) as string) end AS total_amount,
 case when o_orderkey % 997 = 1 then 5000 else o_orderkey % 20 + 1 end AS qty,
 18 + o_custkey % 60 AS age,
 case when o_orderkey % 37 = 0 then '' when o_orderkey % 1009 = 5 then '2999-01-01' when o_orderkey % 1013 = 7 then '1850-06-15'
      else case o_orderkey % 6 when 0 then {_Y} || '-' || {_M} || '-' || {_D} when 1 then {_M} || '/' || {_D} || '/' || {_Y}
        when 2 then {_D} || '.' || {_M} || '.' || {_Y} when 3 then {_Y} || '/' || {_M} || '/' || {_D}
        when 4 then {_NAME} || ' ' || cast(day(o_orderdate) as string) || ', ' || {_Y}
        else {_Y} || '-' || {_M} || '-' || {_D} || 'T10:00:00Z' end end AS order_date,
 case o_orderkey % 3 when 0 then 'yes' when 1 then 'No' else 'TRUE' end AS is_gift,
 cast(null as string) AS notes
FROM {{orders}}"""
DIRTY = f"""
SELECT row_id, {", ".join(COLUMNS)} FROM ({ORDERS}) a
UNION ALL SELECT row_id + 10000000, {", ".join(COLUMNS)} FROM ({ORDERS}) b WHERE row_id % 500 = 0"""


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DIRTY, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def sql(body: str) -> str:
    """DuckDB SQL with the dirty orders as d."""
    return f"WITH RECURSIVE d AS ({DIRTY.format(orders='orders')})" + body


