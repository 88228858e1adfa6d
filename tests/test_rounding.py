import duckdb


def test_halves_are_cast_as_in_the_sql(spark, tmp_path):
    from trialspark.plans.registry import SQL, otsu_histogram

    # 10.5 counts as 10: with 11 a third value would come between the two classes
    prices = [10.5] * 3 + [10.0, 40.5, 41.0, 12.5, 13.5, 199.5, 200.5]
    con = duckdb.connect()
    con.execute("CREATE TABLE prices AS SELECT unnest(?::DOUBLE[]) AS p", [prices])
    con.execute("CREATE TABLE lineitem AS SELECT k::BIGINT AS l_partkey, p + k % 5 AS l_extendedprice FROM prices, range(20) r(k)")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    got = {tuple(r) for r in otsu_histogram(spark, str(tmp_path)).collect()}
    assert got == set(con.execute(SQL["otsu_histogram"]).fetchall())
