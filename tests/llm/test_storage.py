import os

import pytest
from pyspark.sql import functions as F

from rasterloom.llm.storage import drop_ids, id_bitmap, remove_staged, shared_dir, stage
from tests.llm.helpers import frame


def test_bitmap_has_every_id(spark):
    ids = spark.range(0, 5000, 7)
    for bits in (12, 15, 20):
        bitmap = id_bitmap(ids, "id", bits)
        places = ids.select(F.pmod(F.xxhash64("id"), F.lit(1 << bits)).alias("p")).collect()
        assert all(bitmap[r["p"] >> 3] >> (r["p"] & 7) & 1 for r in places)
        assert sum(bin(b).count("1") for b in bitmap) == len({r["p"] for r in places})


def test_drop_ids_equals_an_anti_join(spark):
    docs = frame(spark, [(i, f"t{i}") for i in range(2000)] + [(None, "n"), (7, "again")])
    ids = spark.range(0, 2000, 3).withColumnRenamed("id", "doc_id")
    got = drop_ids(docs, ids.unionByName(ids), "doc_id")
    assert got.columns == docs.columns
    kept = [r["doc_id"] for r in got.collect()]
    assert sorted(i for i in kept if i is not None) == sorted([i for i in range(2000) if i % 3] + [7]) and kept.count(None) == 1
    assert drop_ids(docs, ids.where("false"), "doc_id").count() == docs.count()


def test_stage_writes_to_the_shared_folder(spark):
    df = stage(spark.range(10).withColumn("v", F.col("id") * 2), "probe")
    assert df.count() == 10 and df.columns == ["id", "v"]
    assert shared_dir(spark) in df.inputFiles()[0].replace("file://", "")


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="share"):
        shared_dir(Session())


def test_staged_tables_can_be_removed(spark):
    path = stage(spark.range(3), "gone").inputFiles()[0].replace("file://", "")
    assert os.path.exists(path)
    remove_staged(spark)
    assert not os.path.exists(path)
    assert stage(spark.range(3), "after").count() == 3
