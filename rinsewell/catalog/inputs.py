"""Input tables of the catalog. The given tables hold no dirt, so contact data is derived from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# One text for both engines: every order becomes a contact with typical dirt, and every 37th a
# second time under another row_id, so that there are duplicates to find. No order is left out.
CONTACTS_SQL = """
WITH k AS (
  SELECT o_orderkey AS row_id, o_orderkey AS n, o_custkey AS c, o_orderstatus AS st,
         lpad(CAST(2000000000 + (o_orderkey * 7919) % 7999999999 AS STRING), 10, '0') AS d,
         lpad(CAST((o_orderkey * 131) % 100000 AS STRING), 5, '0') AS z
  FROM orders
  UNION ALL
  SELECT o_orderkey + 1000000000, o_orderkey, o_custkey, o_orderstatus,
         lpad(CAST(2000000000 + (o_orderkey * 7919) % 7999999999 AS STRING), 10, '0'),
         lpad(CAST((o_orderkey * 131) % 100000 AS STRING), 5, '0')
  FROM orders WHERE o_orderkey % 37 = 0
)
SELECT row_id,
  CASE n % 101 WHEN 7 THEN NULL ELSE
    CASE n % 6 WHEN 0 THEN concat('  Ann O''Neil-', CAST(c % 50 AS STRING), ' ')
      WHEN 1 THEN concat('BOB  smith', chr(9), CAST(c % 50 AS STRING))
      WHEN 2 THEN concat(chr(160), 'carol_', CAST(c % 50 AS STRING), chr(160))
      WHEN 3 THEN concat('Dave', chr(7), ' (jr.) ', CAST(c % 50 AS STRING))
      WHEN 4 THEN concat(chr(201), 'va 3rd ', CAST(c % 50 AS STRING))
      ELSE concat('frank', CAST(c % 50 AS STRING)) END END AS name,
  CASE n % 9 WHEN 0 THEN concat('(', substr(d,1,3), ') ', substr(d,4,3), '-', substr(d,7,4))
    WHEN 1 THEN concat(substr(d,1,3), '.', substr(d,4,3), '.', substr(d,7,4))
    WHEN 2 THEN concat('+1 ', substr(d,1,3), ' ', substr(d,4,7))
    WHEN 3 THEN concat('1', d) WHEN 4 THEN concat('2', d)
    WHEN 5 THEN 'invalid' WHEN 6 THEN NULL WHEN 7 THEN '  ' ELSE concat(' ', d, ' ') END AS phone,
  CASE n % 7 WHEN 0 THEN z WHEN 1 THEN concat(z, '-', substr(d,1,4)) WHEN 2 THEN concat(z, substr(d,1,4))
    WHEN 3 THEN concat(' ', z, ' ') WHEN 4 THEN ' 123 ' WHEN 5 THEN NULL ELSE concat('ZIP ', z) END AS zip,
  CASE n % 10 WHEN 0 THEN 'CA' WHEN 1 THEN 'texas' WHEN 2 THEN ' ny ' WHEN 3 THEN 'new-york' WHEN 4 THEN 'New Jersey'
    WHEN 5 THEN 'Ontario' WHEN 6 THEN ' ' WHEN 7 THEN NULL WHEN 8 THEN 'dc' ELSE 'District of Columbia' END AS state,
  CASE n % 13 WHEN 0 THEN concat('1,', lpad(CAST(c % 1000 AS STRING), 3, '0'), '.50') WHEN 1 THEN concat('$', CAST(c AS STRING))
    WHEN 2 THEN concat('€ ', CAST(c AS STRING)) WHEN 3 THEN 'abc' WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN '1e3'
    WHEN 7 THEN '1_000' WHEN 8 THEN '5d' WHEN 9 THEN ' 12 ' WHEN 10 THEN '(5)' WHEN 11 THEN '-.5' ELSE CAST(c AS STRING) END AS amount,
  CASE n % 8 WHEN 6 THEN '2024-02-30' WHEN 1 THEN 'garbage' WHEN 2 THEN NULL
    WHEN 3 THEN concat(CAST(1 + n % 12 AS STRING), '/', CAST(1 + n % 28 AS STRING), '/2024')
    ELSE concat('2024-', lpad(CAST(1 + n % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + n % 28 AS STRING), 2, '0')) END AS signup_date,
  CASE n % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN ' - ' WHEN 2 THEN '   ' WHEN 3 THEN NULL WHEN 4 THEN 'y' ELSE st END AS status,
  CASE WHEN n % 2 = 0 THEN '' ELSE NULL END AS mostly_empty,
  CASE WHEN n % 53 = 0 THEN NULL ELSE CAST(c AS DOUBLE) END AS cust
FROM k
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def contacts(spark: SparkSession, folder: str) -> DataFrame:
    """Derived contacts; ``row_id`` is the order of the rows."""
    sql = CONTACTS_SQL.replace("FROM orders", "FROM {orders}")
    return spark.sql(sql, orders=table(spark, folder, "orders"))
