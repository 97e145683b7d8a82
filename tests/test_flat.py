"""Ground that lies exactly on a plane: d4 and its SQL keep the same seeds where the deviations are rounding alone."""

from terraframe.plans import ORACLE, QUERIES


def test_seeds_of_a_plane(spark, tmp_path):
    import duckdb

    duckdb.sql(f"""COPY (SELECT CAST(13 * i AS BIGINT) AS o_orderkey, CAST((i * 7) % 997 AS BIGINT) AS o_custkey, 'F' AS o_orderstatus, 1.0 AS o_totalprice,
        TIMESTAMP '1995-03-01' AS o_orderdate FROM range(3000) AS r(i) UNION ALL SELECT CAST(13 * i AS BIGINT), CAST(i AS BIGINT), 'F', 1.0, TIMESTAMP '1996-03-01' FROM range(3000, 3004) AS r(i)) TO '{tmp_path}/orders.parquet'""")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    want = sorted(con.sql(ORACLE["d4_purify_seeds"]).fetchall())
    assert sorted(map(tuple, QUERIES["d4_purify_seeds"](spark, str(tmp_path)).collect())) == want
    assert sum(c == "CL_1996" for c, _ in want) == 4  # too few seeds for a plane: all stay
