import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.sources import vector_files, vector_source


def vectors(spark, n, dim=5):
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (F.col("id") + i / 8).cast("float")).alias("vector"))


def test_records_are_read_in_ranges(spark, tmp_path):
    """Ranges that end inside records and small files that share a range: every record once, at its place."""
    x = np.random.default_rng(2).normal(size=(203, 7)).astype(np.float32)
    (tmp_path / "in").mkdir()
    for i, (a, b) in enumerate(((0, 100), (100, 101), (101, 203))):
        (tmp_path / "in" / f"{i}.fvecs").write_bytes(vector_files.encode_vecs(list(x[a:b])))
    (tmp_path / "in" / "empty.fvecs").write_bytes(b"")
    (tmp_path / "in" / "_notes").write_bytes(b"abc")
    vector_source.register(spark)
    for size in (33, 200, 10**6):
        df = spark.read.format("fvecs").option("rangeBytes", size).load(f"file:{tmp_path}/in")
        rows = sorted(df.collect(), key=lambda r: (r.file, r.pos))
        assert np.array_equal(np.array([r.vector for r in rows], np.float32), x)
        assert [r.pos for r in rows] == [*range(100), 0, *range(102)]


def test_a_folder_of_many_files_is_one_scan_without_a_job(spark, tmp_path):
    for i in range(1000):
        (tmp_path / f"{i:04d}.ivecs").write_bytes(vector_files.encode_vecs([[i, 2 * i]], "<i4"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    df = vector_files.read_ivecs(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and "Union" not in plan
    assert len(tracker.getJobIdsForGroup("planning")) == 0
    assert df.agg(F.sum(F.col("vector")[1])).first()[0] == sum(2 * i for i in range(1000))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_written_by_tasks_and_read_again(spark, tmp_path):
    path = str(tmp_path / "out")
    df = vectors(spark, 100)
    vector_files.write_fvecs(df.repartition(4), path)
    assert sorted(r.vector for r in vector_files.read_fvecs(spark, path).collect()) == [r.vector for r in df.orderBy("id").collect()]
    vector_files.write_fvecs(df.limit(3), path)
    assert vector_files.read_fvecs(spark, path).count() == 103
    vector_files.write_fvecs(df.limit(7), path, "overwrite")
    assert vector_files.read_fvecs(spark, path).count() == 7
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = tmp_path / "out"
    bad = vectors(spark, 50).withColumn("vector", F.when(F.col("id") == 33, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("vector")))
    with pytest.raises(Exception, match="one length"):
        vector_files.write_fvecs(bad.repartition(4), str(path))
    assert not path.exists() or not list(path.iterdir())
    with pytest.raises(Exception, match="null"):
        vector_files.write_fvecs(vectors(spark, 3).withColumn("vector", F.when(F.col("id") != 1, F.col("vector"))), str(path))


def test_truth_is_numbered_through(spark, tmp_path):
    path = str(tmp_path / "truth")
    lists = spark.range(40).select((F.col("id") * 10).alias("query_id"), F.expr("transform(sequence(0, int(id % 4)), i -> int(i + id))").alias("ids")).withColumn("ids", F.when(F.col("query_id") % 7 == 0, F.array().cast("array<int>")).otherwise(F.col("ids")))
    vector_files.write_truth(lists.repartition(3), path)
    assert [(10 * r.query_id, r.ids) for r in vector_files.read_truth(spark, path).orderBy("query_id").collect()] == [(r.query_id, r.ids) for r in lists.orderBy("query_id").collect()]
    (tmp_path / "t.bin").write_bytes(vector_files.encode_truth([[5, 6, 7], [], [9]]))
    assert [(r.query_id, r.ids) for r in vector_files.read_truth(spark, str(tmp_path / "t.bin")).orderBy("query_id").collect()] == [(0, [5, 6, 7]), (1, []), (2, [9])]
    (tmp_path / "cut.bin").write_bytes(vector_files.encode_truth([[5, 6, 7], [9]])[:-2])
    with pytest.raises(Exception, match="ends before"):
        vector_files.read_truth(spark, str(tmp_path / "cut.bin")).collect()


def test_odd_files(spark, tmp_path):
    for content, said in ((b"\x02\0\0\0abc", "whole records"), (vector_files.encode_vecs([[1, 2]]) + vector_files.encode_vecs([[3]]) + b"\0" * 4, "differ in dimension")):
        (tmp_path / "bad.fvecs").write_bytes(content)
        with pytest.raises(Exception, match=said):
            vector_files.read_fvecs(spark, str(tmp_path / "bad.fvecs")).collect()
    with pytest.raises(Exception, match="missing"):
        vector_files.read_fvecs(spark, str(tmp_path / "missing")).collect()
    with pytest.raises(ValueError):
        vector_files.write_fvecs(vectors(spark, 3), str(tmp_path / "x"), "ignore")
