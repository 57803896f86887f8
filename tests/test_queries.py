"""Every registered query that has SQL gives the same rows as DuckDB; plans hold what they promise."""

import pytest

from rasterloom.plans import catalog


def as_sets(rows):
    def plain(v):
        return round(v, 9) if isinstance(v, float) else bytes(v) if isinstance(v, bytearray) else v

    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert as_sets(got.select(columns).collect()) == as_sets(want.fetchall())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_lifting_shuffles_once(spark, sf_dir):
    for name in ("q_dwt53_1d", "q_dwt97_1d", "q_idwt53_1d"):
        assert plan_of(catalog.QUERIES[name](spark, sf_dir)).count("Exchange hashpartitioning") == 1


def test_planes_do_not_shuffle(spark, sf_dir):
    for name in ("q_dwt53_2d", "q_idwt53_2d", "q_dwt97_2d", "q_sycc", "q_significance", "q_window_synthesis"):
        assert "Exchange" not in plan_of(catalog.QUERIES[name](spark, sf_dir))


def test_region_lookups_are_equality_joins(spark, sf_dir):
    plan = plan_of(catalog.QUERIES["q_codeblock_select"](spark, sf_dir))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = plan_of(catalog.QUERIES["q_range_merge"](spark, sf_dir))
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert schema.count(":") == 3


def test_partition_counts_do_not_change_results(spark, sf_dir):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append([as_sets(catalog.QUERIES[k](spark, sf_dir).collect()) for k in ("q_dwt53_1d", "q_range_merge", "q_order_rpcl")])
        assert seen[0] == seen[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_segments_without_a_place_come_last_as_in_sql(spark, tmp_path):
    import duckdb

    rows = [(1, 1, 7, 4), (1, 2, 8, 4), (1, None, 9, 1), (2, 1, 7, 4), (2, 2, 8, 4), (2, 3, 5, None), (3, 1, 6, 4), (3, 2, 7, 4), (3, 3, None, 2), (None, 1, 1, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        want = con.execute(catalog.ORACLE_SQL["q_segment_classes"]).fetchall()
    assert as_sets(catalog.QUERIES["q_segment_classes"](spark, str(tmp_path)).collect()) == as_sets(want)
