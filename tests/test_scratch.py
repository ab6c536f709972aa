import os

import pytest
from helpers import garden_store, queries
from lexifold import build_index, prepare, search
from lexifold.sources.bucketed import write_bucketed
from lexifold.sources.scratch import materialize, scratch_run, shared_folder
from pyspark.sql import functions as F


def test_a_run_leaves_nothing_behind(spark):
    folder = f"{shared_folder(spark)}/lexifold"
    tables = {t.name for t in spark.catalog.listTables()}
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with scratch_run(spark):
        index = build_index(garden_store(spark))
        rows = search(index, prepare(index, queries(spark, "anahtar"))).hits.collect()
        assert rows and set(os.listdir(folder)) - before
    assert set(os.listdir(folder)) == before
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_a_failed_run_is_removed_too(spark):
    with pytest.raises(ZeroDivisionError), scratch_run(spark):
        path = materialize(spark.range(3), "numbers").inputFiles()[0]
        _ = 1 / 0
    assert not os.path.exists(path.removeprefix("file://"))


def test_without_a_checkpoint_folder_the_warehouse_is_used(spark):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: "/somewhere/warehouse/" if key == "spark.sql.warehouse.dir" else default)

        class sparkContext:
            @staticmethod
            def getConf():
                return {}

    assert shared_folder(Session) == "/somewhere/warehouse"


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def files():
        found = blocks.getAllFiles()
        return {found.apply(i).getName() for i in range(found.length()) if found.apply(i).getName().startswith("shuffle_")}

    rows = spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 5).alias("key")).agg(F.count("*").alias("n"))
    with scratch_run(spark):
        before = files()
        assert sorted(map(tuple, materialize(rows, "rows").collect())) == [(i, 200) for i in range(5)]
        write_bucketed(rows.repartition(2, "key"), str(tmp_path / "bucketed"), 2, "key")
        assert not files() - before
        assert sorted(map(tuple, rows.collect())) == [(i, 200) for i in range(5)]  # the same frame again
    assert spark.conf.get(setting) == "false"
