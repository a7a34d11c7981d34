import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from nearfield.operators import budgeted, cell_index, exact
from nearfield.operators.storage import fresh_path
from nearfield.streaming import index_stream, progress, standing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@pytest.fixture(scope="module")
def asked(items):
    return items.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_cells_grow_with_a_stream_and_answer_one(spark, items, asked, tmp_path):
    path, heard = fresh_path(spark, "cells"), []
    cell_index.create(items.where("id < 100"), path, n_cells=4)
    for i in range(3):
        items.where(f"id >= 100 AND id % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    listener = progress.listen(spark, lambda *a: heard.append(a))
    index_stream.append_to_cells(stream, path, str(tmp_path / "c1"), (200, 0.1)).awaitTermination()
    index_stream.append_to_cells(stream, path, str(tmp_path / "c1"), (200, 0.1)).awaitTermination()  # nothing new
    index = cell_index.load(spark, path)
    assert rows(index.items().select("id")) == rows(items.select("id")) and len(index.parts) < 4
    asked.write.parquet(str(tmp_path / "q"))
    queries = spark.readStream.schema("query_id long, vector array<float>").parquet(str(tmp_path / "q"))
    index_stream.search_cells(queries, path, str(tmp_path / "c2"), str(tmp_path / "out"), 5, 4).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).drop("batch")) == rows(exact.knn(items, asked, 5))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.streams.removeListener(listener)
    assert sum(h[2] for h in heard) >= items.count() - 100 and all(h[3] >= 0 for h in heard)


def test_standing_answers_survive_a_restart(spark, items, asked, tmp_path):
    schema = "id long, vector array<float>"
    odd = spark.createDataFrame([(None, [1.0] * 64), (7, None)], schema)
    for i in range(2):
        items.where(f"id % 2 = {i}").select("id", "vector").union(odd).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        standing.keep(arriving, asked, 5, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        so_far = items.where(f"id % 2 <= {i}")
        assert rows(standing.current(spark, str(tmp_path / "out"))) == rows(exact.knn(so_far, asked, 5))


def test_counters_only_for_a_listener(spark, items, asked):
    watch = Observation()
    exact.knn(items, asked, 5, watch=watch).collect()
    assert watch.get["distances"] == items.count() * asked.count() and watch.get["block_pairs"] >= 1
    for w, n in ((None, 0), (Observation(), 1)):
        plan = exact.knn(items, asked, 5, watch=w)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("CollectMetrics") == n


def test_budgets(spark, items, asked):
    index = cell_index.create(items, fresh_path(spark, "cells"), n_cells=8)
    nothing, status = budgeted.search(index, asked, 5, deadline_s=0.0)
    assert nothing.count() == 0 and not any(r.exact for r in status.collect())
    some, status = budgeted.search(index, asked, 5, most_waves=1)
    assert {r.cells for r in status.collect()} == {1} and some.count() > 0
    found, status = budgeted.search(index, asked, 5, where="label = 3")
    assert rows(found) == rows(exact.knn(items, asked, 5, where="label = 3")) and all(r.exact for r in status.collect())


def test_far_cells_are_not_searched(spark):
    at = F.pmod(F.xxhash64("id"), F.lit(8))
    x = spark.range(400).select("id", F.array(at * 10.0 + F.rand(1), (at % 3) * 10.0 + F.rand(2)).alias("vector"))
    x.write.parquet(path := fresh_path(spark, "x"))
    x = spark.read.parquet(path)
    q = x.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    index = cell_index.create(x, fresh_path(spark, "cells"), n_cells=8, metric="l2sq")
    found, status = budgeted.search(index, q, 5)
    assert rows(found) == rows(exact.knn(x, q, 5, "l2sq"))
    assert all(r.exact and r.cells < 8 for r in status.collect())
