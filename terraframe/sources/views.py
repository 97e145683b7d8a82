"""Point-cloud views over the driver tables; Spark and the oracle run the same text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POINTS_L = """
SELECT concat('CL_', cast(l_suppkey % 10 AS string), '_', cast(year(l_shipdate) AS string)) AS cloud,
       cast(year(l_shipdate) AS int) AS survey_year,
       cast((l_partkey * 7919 + l_orderkey * 31) % 6000 AS double) / 100 AS x,
       cast((l_orderkey * 104729 + l_linenumber * 17) % 6000 AS double) / 100 AS y,
       cast((l_partkey * 7919 + l_orderkey * 31) % 6000 AS double) / 2000
         + CASE WHEN l_returnflag = 'R' THEN l_quantity / 4 ELSE cast(0 AS double) END AS z,
       CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 5 END AS cls,
       l_linenumber AS nret, cast(1 + l_orderkey % l_linenumber AS int) AS rnum, l_extendedprice AS intensity
FROM lineitem
"""

POINTS_O = """
SELECT o_orderkey AS pid, concat('CL_', cast(year(o_orderdate) AS string)) AS cloud,
       cast((o_orderkey * 7919 + o_custkey * 31) % 6000 AS double) / 100 AS x,
       cast((o_orderkey * 104729 + o_custkey * 17) % 6000 AS double) / 100 AS y,
       cast((o_orderkey * 7919 + o_custkey * 31) % 6000 AS double) / 2000
         + CASE WHEN o_orderstatus = 'P' THEN cast(o_custkey % 12 AS double) ELSE cast(0 AS double) END AS z,
       CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 5 END AS cls,
       o_totalprice AS intensity
FROM orders
"""

#: Points with a true label, a ground probability and two predictions, the second after refinement.
SCORED = f"""
SELECT pid, cloud, x, y, z, CASE WHEN cls = 2 THEN 1 WHEN pid % 11 = 0 THEN 2 ELSE 0 END AS label,
       cast((pid * 7919) % 1000 AS double) / 1000 AS p_ground,
       CASE WHEN (pid * 7919) % 1000 >= 500 OR (cls = 2 AND pid % 3 > 0) THEN 1 ELSE 0 END AS pred,
       CASE WHEN ((pid * 7919) % 1000 >= 500 AND pid % 7 > 0) OR (cls = 2 AND pid % 3 > 0) THEN 1 ELSE 0 END AS refined
FROM ({POINTS_O}) AS p
"""

#: Survey tiles with names, boxes and sizes, made from parts; two epochs a tile, some without a twin.
CATALOG = """
SELECT p_partkey AS tile_id,
       concat(CASE cast(p_partkey % 4 AS int) WHEN 0 THEN 'canterbury' WHEN 1 THEN 'NZ_North' WHEN 2 THEN 'otago-south' ELSE 'Wairau.valley' END,
              '_', CASE WHEN p_partkey % 5 = 0 THEN concat(cast(2010 + p_partkey % 9 AS string), '-', cast(2011 + p_partkey % 9 AS string))
                        WHEN p_partkey % 5 = 1 THEN concat('NZ', cast(10 + p_partkey % 14 AS string))
                        ELSE cast(2008 + p_partkey % 12 AS string) END) AS survey,
       concat('PNOA_', cast(2010 + p_partkey % 2 AS string), '_', CASE WHEN p_partkey % 3 = 0 THEN 'GAL-W' ELSE 'AST' END, '_',
              cast(400 + (p_partkey // 2) % 20 AS string), '-', cast(4700 + (p_partkey // 40) % 30 AS string), '_ORT.copc.laz') AS tile,
       cast(1000 + (p_partkey * 7919) % 9000 AS bigint) AS size, cast((p_partkey * 31) % 97 AS double) / 10 AS density,
       cast((p_partkey * 7919) % 4000 AS double) AS min_x, cast((p_partkey * 104729) % 4000 AS double) AS min_y
FROM part
"""


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The rows of a view's text over the tables of sf_dir."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "part", "events", "customer", "supplier") if f"FROM {t}" in text}
    for t in tables:
        text = text.replace(f"FROM {t}", "FROM {" + t + "}")
    return spark.sql(text.replace("//", " div "), **tables)


def points_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, POINTS_L)


def points_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, POINTS_O)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SCORED)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CATALOG)
