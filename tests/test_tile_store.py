import pytest

from rasterloom.sources import tile_store


def test_index_round_trip_and_refusals(spark, tmp_path):
    rows = [("a", t, t * 10, t * 10 + 9) for t in range(5)] + [("b", 0, 7, 9)]
    index = spark.createDataFrame(rows, tile_store.SCHEMA)
    path = str(tmp_path / "index")
    tile_store.export_index(index, path)
    back = tile_store.import_index(spark, path)
    assert sorted(map(tuple, back.collect())) == rows
    only = tile_store.import_index(spark, path, ["b"])
    assert [tuple(r) for r in only.collect()] == [("b", 0, 7, 9)]
    assert "PushedFilters: [In(key" in only._jdf.queryExecution().executedPlan().toString() or "EqualTo(key" in only._jdf.queryExecution().executedPlan().toString()
    asked = spark.createDataFrame([(1, "a", 3), (2, "b", 0)], "req_id long, key string, tile int")
    assert sorted(r["start"] for r in tile_store.wanted_tiles(asked, back).collect()) == [7, 30]
    with pytest.raises(Exception, match="no tile 9"):
        tile_store.wanted_tiles(spark.createDataFrame([(1, "a", 9)], "req_id long, key string, tile int"), back).collect()
    with pytest.raises(Exception, match="indexed twice"):
        tile_store.checked(index.unionByName(index.limit(1))).collect()
