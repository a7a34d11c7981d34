import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import vectors as v
from nearfield.operators import commits, exact, layered
from nearfield.operators import graph as g
from nearfield.plans.params import IndexParams, strategy
from nearfield.queries import items
from nearfield.sources import vector_files
from nearfield.streaming import index_stream

SF = "/root/testdata/sf0.001"
PARAMS = IndexParams(m=32, ef_construction=64, heuristic="diverse", keep_pruned=True)  # few layers: a test's rounds are jobs


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def some(spark):
    return items(spark, SF).where("id < 120")


@pytest.fixture(scope="module")
def asked(some):
    return some.where("id % 30 = 0").select(F.col("id").alias("query_id"), "vector")


@pytest.mark.parametrize("options", [{}, {"heuristic": "diverse", "expand_best": True, "keep_pruned": True}, {"heuristic": "first", "keep_pruned": True}])
def test_recall_and_self(some, asked, options):
    found, _ = layered.search(layered.build(some, IndexParams(m=24, ef_construction=64, **options)), asked, 10, 80)
    truth, got = set(rows(exact.knn(some, asked, 10).select("query_id", "id"))), set(rows(found.select("query_id", "id")))
    assert len(truth & got) >= 0.95 * len(truth)
    assert all(r.id == r.query_id and r.distance < 5.96e-7 for r in found.where("rank = 1").collect())


def test_edge_cases(spark):
    schema = "id long, vector array<float>"
    empty = spark.createDataFrame([], schema)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    assert exact.knn(empty, asked, 3).count() == 0
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (4, [1.0, 0.0])], schema)
    assert [(r.id, r.distance) for r in exact.knn(rows.limit(4), asked, 9).collect()] == [(1, 0.0), (4, 0.0), (2, 1.0)]
    for bad in (0, -1):
        with pytest.raises(ValueError):
            exact.knn(rows, asked, bad)
    with pytest.raises(Exception, match="differ in length"):
        exact.knn(spark.createDataFrame([(1, [1.0])], schema), asked, 1).collect()
    with pytest.raises(ValueError):
        IndexParams(m=1)


def test_same_graph_whatever_the_partitions(some):
    got = [rows(layered.build(some.repartition(n), PARAMS).edges) for n in (1, 5)]
    assert got[0] == got[1] and len(got[0])


def test_grown_filtered_and_read_as_before(spark, some, asked, tmp_path):
    path = str(tmp_path / "a")
    assert layered.save(layered.build(some.where("id < 100"), PARAMS), path) == 1
    old = layered.load(spark, path)
    assert [layered.grow(spark, path, some) for _ in range(2)] == [2, 2]  # again: nothing new
    now = layered.load(spark, path)
    assert (old.nodes.count(), now.nodes.count()) == (100, some.count())
    assert rows(layered.search(now, asked, 5, 1000)[0]) == rows(exact.knn(some, asked, 5))
    assert rows(layered.search(now, asked, 5, 1000, some.where("label = 3"))[0]) == rows(exact.knn(some, asked, 5, where="label = 3"))


def test_writers_that_lose_add_to_what_the_others_wrote(spark, some, tmp_path, monkeypatch):
    path = str(tmp_path / "a")
    layered.save(layered.build(some.where("id < 12"), PARAMS), path)
    stale = layered.load(spark, path)
    layered.grow(spark, path, some.where("id < 16"))
    with pytest.raises(commits.Conflict):
        layered.save(layered.add(stale, some.where("id >= 16 AND id < 18")), path)
    real, met = layered.load, []

    def slow(*args, **more):  # another writer commits between the load and the save of the first try
        out = real(*args, **more)
        if not met:
            met.append(1)
            layered.save(layered.add(real(spark, path), some.where("id >= 20 AND id < 22")), path)
        return out

    monkeypatch.setattr(layered, "load", slow)
    assert layered.grow(spark, path, some.where("id >= 16 AND id < 18")) == 4
    assert rows(real(spark, path).nodes.select("id")) == rows(some.where("id < 18 OR id >= 20 AND id < 22").select("id"))
    assert layered.save(real(spark, path), str(tmp_path / "b")) == 1  # elsewhere no version is awaited


def test_streams(spark, some, asked, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "index")
    layered.save(layered.build(some.where("id < 100").select("id", "vector"), PARAMS), path)
    for i in range(2):
        some.where(f"id >= 100 AND id % 2 = {i}").select("id", "vector").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long, vector array<float>").option("maxFilesPerTrigger", 1).parquet(source)
    index_stream.append_stream(stream, path, str(tmp_path / "c1")).awaitTermination()
    assert layered.load(spark, path).nodes.count() == some.count()
    asked.write.parquet(str(tmp_path / "q"))
    queries = spark.readStream.schema("query_id long, vector array<float>").parquet(str(tmp_path / "q"))
    index_stream.search_stream(queries, path, str(tmp_path / "c2"), str(tmp_path / "out"), 5, 1000).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).drop("batch")) == rows(exact.knn(some, asked, 5))


def test_files(spark, tmp_path):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(50, 7)).astype(np.float32)
    (tmp_path / "a.fvecs").write_bytes(vector_files.encode_vecs(list(x)))
    (tmp_path / "a.ivecs").write_bytes(vector_files.encode_vecs([[1, 2], [3, -4]], "<i4"))
    (tmp_path / "t.bin").write_bytes(vector_files.encode_truth([[5, 6, 7], [], [9]]))
    got = vector_files.read_fvecs(spark, str(tmp_path / "a.fvecs")).orderBy("pos").collect()
    assert np.array_equal(np.array([r.vector for r in got], np.float32), x)
    assert [r.vector for r in vector_files.read_ivecs(spark, str(tmp_path / "a.ivecs")).orderBy("pos").collect()] == [[1, 2], [3, -4]]
    assert [(r.query_id, r.ids) for r in vector_files.read_truth(spark, str(tmp_path / "t.bin")).collect()] == [(0, [5, 6, 7]), (1, []), (2, [9])]
    (tmp_path / "bad.fvecs").write_bytes(b"\x02\0\0\0abc")
    with pytest.raises(Exception, match="whole records"):
        vector_files.read_fvecs(spark, str(tmp_path / "bad.fvecs")).collect()


def test_random_vectors_and_sql_functions(spark):
    df = vector_files.random_unit_vectors(spark, 20, 16)
    assert all(abs(r.m - 1) < 1e-6 for r in df.select(v.magnitude(F.col("vector")).alias("m")).collect())
    assert df.collect() == df.repartition(3).orderBy("id").collect()
    v.register(spark)
    r = spark.sql("SELECT vec_dot(a, b) d, vec_l2sq(a, b) s, vec_l1(a, b) t, vec_norm(a) n, vec_cosine(a, b) c, vec_cosine(a, array(0D, 0D)) z FROM (SELECT array(3D, 4D) a, array(4D, 3D) b)").first()
    assert (r.d, r.s, r.t, r.n, round(r.c, 9), r.z) == (24, 2, 2, 5, 0.04, 1)


def test_strategy_and_levels(spark):
    assert [strategy(1000, 5), strategy(10**7, 5), strategy(10**7, 5, 0.2), strategy(10**8, 5, 0.01)] == ["exact", "ann", "filtered", "exact"]
    counts = {r.l: r["count"] for r in spark.range(20000).groupBy(g.level(F.col("id"), 16).alias("l")).count().collect()}
    assert 0.92 < counts[0] / 20000 < 0.955
    u = spark.range(100000).select(g.drawn(F.col("id"), 3).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 < u[0] and u[1] < 1 and abs(u[2] - 0.5) < 0.01


def test_reachable_walks_on_until_nothing_is_new(spark):
    """A chain longer than any bound on hops, with short cuts, cycles and a part that can't be reached, against a plain walk."""
    edges = [(i, i + 1) for i in range(68)] + [(3, 1), (20, 22), (40, 40), (68, 60), (100, 0), (100, 101)]
    depth, queue = {0: 0}, [0]
    for node in queue:
        for a, b in edges:
            if a == node and b not in depth:
                depth[b] = depth[a] + 1
                queue.append(b)
    assert max(depth.values()) > 64
    found = g.reachable(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,)], "id long")).collect()
    assert sorted((r.node, r.depth) for r in found) == sorted(depth.items())


def test_ids_are_dense_whatever_the_columns(spark):
    """Many rows of several columns: ranges dealt twice would be cut elsewhere."""
    x = spark.range(1_500_000).selectExpr("(id * 7919) % 1500007 AS id", "repeat('x', int(id % 40)) AS a", "id % 7 AS b")
    r = g.assign_ids(x, "id", 5).selectExpr("min(item_id) AS l", "max(item_id) AS h", "count(DISTINCT item_id) AS n", "max(id) AS m").first()
    assert (r.l, r.h, r.n) == (5, 1_500_004, 1_500_000)


def test_cells(spark):
    from nearfield.operators import cells

    x = items(spark, SF)
    asked = x.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    centres = cells.centroids(x, 8)
    celled = cells.with_cells(x, centres)
    assert celled.count() == x.count()
    found = cells.search(celled, centres, asked, 5, 8)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, exact.knn(x, asked, 5).collect()))
    none = x.where("false")
    assert cells.search(cells.with_cells(none, cells.centroids(none, 8)), cells.centroids(none, 8), asked, 5, 3).count() == 0


def test_hashes_of_large_ids(spark):
    ids = spark.createDataFrame([(x,) for x in (0, 1, 2**32 - 1, 2**40 + 7, 2**62, -5)], "id long")
    from nearfield.operators import evaluation as ev

    rows = ids.select(g.level(F.col("id"), 16).alias("l"), ev.random_attribute(F.col("id")).alias("a")).collect()
    assert all(0 <= r.l <= 31 and 1 <= r.a <= 12 for r in rows)
    counts = {r.a: r["count"] for r in spark.range(24000).groupBy(ev.random_attribute(F.col("id")).alias("a")).count().collect()}
    assert sorted(counts) == list(range(1, 13)) and all(1800 < n < 2200 for n in counts.values())
