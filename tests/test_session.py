import pytest
from pyspark.sql import functions as F

from gristmill import session as S


def test_one_per_key_of_a_scan_and_of_other_inputs(spark, tmp_path):
    rows = [(f"k{i % 70}" if i % 70 else None, f"text of {i % 70}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, loaded_at int")
    df.repartition(5).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    want = sorted({(k, t) for k, t, _ in rows}, key=repr)
    for given in (scan, scan.select("chunk_id", "text"), df):
        once = S.one_per_key(given, "chunk_id")
        assert once.columns == given.columns
        assert sorted(((r.chunk_id, r.text) for r in once.collect()), key=repr) == want
    assert S.one_per_key(scan.limit(0), "chunk_id").collect() == []
    plan = S.one_per_key(scan.select("chunk_id", "text"), "chunk_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_index" in plan  # the way that leaves texts where they are
    opened = scan.select(F.explode(F.array(F.lit("x"), F.lit("x"))).alias("chunk_id"), "text")
    assert S.one_per_key(opened, "chunk_id").count() == 1


def test_written_tables_can_be_released(spark):
    df = S.cut_lineage(spark.range(10))
    assert df.count() == 10
    S.release_tables(spark)
    with pytest.raises(Exception):
        df.agg(F.sum("id")).collect()


def test_no_folder_of_one_machine_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError):
        S.shared_folder(Session())
