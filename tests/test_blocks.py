import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions.vectors import cosine_distance, rounded
from nearfield.operators import descent, exact, masked, pruned
from nearfield.operators.masked import item, query

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", F.concat(F.lit("L"), F.col("label").cast("string")).alias("name"))


@pytest.fixture(scope="module")
def asked(items):
    return items.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector", F.col("label").alias("q_label"), F.col("name").alias("q_name"))


def rows(df):
    return sorted(map(tuple, df.collect()))


CONDITIONS = [
    (query("q_label") < item("label"), "q_label < label"),
    ((query("q_label") < item("label")) & (item("id") % 3 != query("query_id") % 7), "q_label < label AND id % 3 <> query_id % 7"),
    (~(query("q_label") <= item("label")) | (item("name") == "L9"), "NOT q_label <= label OR name = 'L9'"),
    (query("q_name") == item("name"), "q_name = name"),
    ((item("label") - query("q_label")) * 2 >= 14, "(label - q_label) * 2 >= 14"),
    (item("label") + 0 != item("label") * 1, "label <> label"),
]


@pytest.mark.parametrize("condition,sql", CONDITIONS)
def test_conditions_as_row_by_row(items, asked, condition, sql):
    """Also in small blocks, of which some are left out."""
    truth = rows(exact.knn_by(items, asked, 7, cosine_distance, where=sql))
    assert rows(masked.knn(items, asked, 7, where=condition)) == truth
    assert rows(masked.knn(items, asked, 7, where=condition, cluster_by="label", item_block=16, query_block=2)) == truth


def test_blocks_that_cannot_match_are_left_out(items, asked):
    narrow = masked.pairs_kept(items.coalesce(1), asked.coalesce(1), CONDITIONS[4][0], cluster_by="label", item_block=32, query_block=1).first()
    assert 0 < narrow.kept < 0.5 * narrow.pairs
    none = masked.pairs_kept(items, asked, item("label") > 100, item_block=32).first()
    assert none.kept == 0 < none.pairs
    exact_ = masked.pairs_kept(items.coalesce(1), asked.coalesce(1), item("name") == "no such name", item_block=32).first()
    assert exact_.kept <= exact_.pairs


def test_nulls_match_nothing(spark, items, asked):
    holes = items.withColumn("label", F.when(F.col("label") != 4, F.col("label")))
    for condition, sql in ((item("label") == 4, "label = 4"), (~(item("label") < 4), "NOT label < 4"), ((item("label") < 2) | (query("q_label") > 5), "label < 2 OR q_label > 5")):
        from nearfield.functions.vectors import cosine_distance

        assert rows(masked.knn(holes, asked, 5, where=condition, item_block=16)) == rows(exact.knn_by(holes, asked, 5, cosine_distance, where=sql))


def test_small_blocks_of_the_same_bounds_are_searched_as_one(spark, items, asked):
    q, where = asked.select("query_id", "vector", "q_label"), item("label") - query("q_label") >= 3
    options = {"cluster_by": "label", "item_block": 4, "query_block": 1}
    small, large = (masked.block_pairs(items, q, where, merged=m, **options) for m in (False, True))
    assert 3 * large[0].count() < small[0].count() and large[1].count() <= small[1].count()
    truth = exact.knn_by(items, q, 10, cosine_distance, "label - q_label >= 3")
    assert rows(masked.knn(items, q, 10, where=where, **options)) == rows(truth)
    kept = small[0].join(small[1], small[2]).count()
    assert masked.pairs_kept(items, q, where, **options).first() == (small[0].count() * small[1].count(), kept)


def test_large_integers_and_other_types(spark, items, asked):
    large = items.withColumn("label", F.lit((1 << 53) + 1) + F.col("id") % 2).withColumn("day", F.current_date())
    q = asked.withColumn("q_label", F.lit(1 << 53))
    found = masked.knn(large, q, 3, where=(query("q_label") < item("label")) & (item("label") == (1 << 53) + 1), item_block=16)
    assert found.count() == 3 * asked.count() and found.where("id % 2 = 1").count() == 0
    with pytest.raises(ValueError):
        masked.knn(large, q, 3, where=item("day") == "x")


def test_any_metric(spark, items, asked):
    largest = lambda q, x: np.abs(q[:, None] - x[None]).max(-1)
    truth = exact.knn_by(items, asked, 5, lambda u, v: F.array_max(F.zip_with(u, v, lambda a, b: F.abs(a.cast("double") - b.cast("double")))))
    assert rows(masked.knn(items, asked, 5, largest)) == rows(truth)
    with pytest.raises(ValueError):
        masked.knn(items, asked, 0)
    with pytest.raises(Exception, match="a metric gives"):
        masked.knn(items, asked, 5, lambda q, x: np.zeros(3)).collect()


def clustered(spark, n):
    """Vectors around twenty far points."""
    at = F.pmod(F.xxhash64("id"), F.lit(20))
    noise = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 17320.508
    return spark.range(n).select("id", F.array(*(F.pmod(at * (7 + i), F.lit(20)) * 3.0 + noise(i) for i in range(6))).alias("vector"))


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_skipping_is_exact(spark, items, metric):
    near = clustered(spark, 2000)
    for rows_, k in ((items.select("id", "vector"), 10), (near, 10), (near, 150)):
        q = rows_.where("id % 40 = 0").withColumnRenamed("id", "query_id")
        assert rows(pruned.knn(rows_, q, k, metric, n_cells=16, item_block=64, query_block=16)) == rows(exact.knn(rows_, q, k, metric))


def test_far_blocks_are_skipped(spark, items):
    near = clustered(spark, 2000)
    q = near.where("id % 40 = 0").withColumnRenamed("id", "query_id")
    r = pruned.pairs_kept(near, q, 5, "l2sq", n_cells=32, item_block=64, query_block=8).first()
    assert r.pairs == 2000 * 50 and r.kept < 0.2 * r.pairs
    with pytest.raises(ValueError):
        pruned.knn(near, q, 5, "l1")
    assert pruned.knn(near.limit(0), q, 5).count() == 0 == pruned.knn(near, q.limit(0), 5).count()


def test_descent_finds_the_graph(spark, items):
    k, pool = 5, 24
    edges, history = descent.knn_graph(items, k, pool=pool)
    truth = set(rows(exact.knn(items, items.withColumnRenamed("id", "query_id"), k, skip_self=True).select("query_id", "id")))
    found = rows(edges.select("src", "dst"))
    n = items.count()
    assert len(found) == n * k and len(truth & set(found)) >= 0.9 * len(truth)
    assert all(h["neighbours"] <= 2 * pool * n for h in history)
    assert history[-1]["changed"] < history[0]["changed"]
    pairs = items.alias("a").join(edges, F.col("a.id") == F.col("src")).join(items.alias("b"), F.col("b.id") == F.col("dst"))
    assert pairs.where(rounded(cosine_distance(F.col("a.vector"), F.col("b.vector"))) != F.col("distance")).count() == 0


def test_descent_of_few_and_odd_items(spark):
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (None, [1.0, 1.0]), (4, [0.0, 1.0])], "id long, vector array<double>")
    edges, _ = descent.knn_graph(odd, 5)
    assert sorted((r.src, r.pos, r.dst) for r in edges.collect()) == [(1, 1, 2), (1, 2, 4), (2, 1, 1), (2, 2, 4), (4, 1, 2), (4, 2, 1)]
    assert descent.knn_graph(odd.limit(0), 3)[0].count() == 0
    assert descent.knn_graph(odd.limit(1), 3)[0].count() == 0


def test_descent_finds_neighbours_without_structure(spark, monkeypatch):
    """Even directions, many of a node's neighbours beyond those of its neighbours, and a group of copies: rounds that have settled miss more than a tenth."""
    monkeypatch.setattr(descent, "LEAF", 100)
    draw = np.random.default_rng(5)
    x = draw.normal(size=(2000, 64))
    x[::20] = x[0]
    rows_ = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    edges, history = descent.knn_graph(rows_, 5, pool=10)
    d = np.round(exact.distances("cosine", x, x), 6)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(2000) for j in np.lexsort((np.arange(2000), d[i]))[:5]}
    assert len(want & set(rows(edges.select("src", "dst")))) >= 0.9 * len(want)
    assert all(h["neighbours"] <= 20 * 2000 for h in history) and "recall" in history[-1]


def test_null_ids_are_left_out(spark):
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None)], "id long, vector array<double>")
    q = odd.withColumnRenamed("id", "query_id")
    assert rows(exact.knn(odd, q, 3)) == [(1, 1, 0.0, 1)] == rows(masked.knn(odd, q, 3))


def test_a_task_passes_on_its_nearest_alone(spark):
    """Three blocks of items in a task, with ties: k rows a query leave it, not k a block; and so by parts that aren't broadcast."""
    draw = np.random.default_rng(3)
    x = np.round(draw.normal(size=(3 * exact.ITEM_BLOCK, 3)), 1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").coalesce(1)
    asked = rows.where("id % 500 = 0").withColumnRenamed("id", "query_id")
    for metric in ("cosine", "l2sq", "inner_product", "l1"):
        d = np.round(exact.distances(metric, x[::500].astype(np.float32), x.astype(np.float32)), 6)
        want = [(500 * i, int(j)) for i, row in enumerate(d) for j in np.lexsort((np.arange(len(x)), row))[:7]]
        assert exact.near_by_block(rows, asked, 7, metric).count() == len(want)
        assert sorted((r.query_id, r.id) for r in exact.knn(rows, asked, 7, metric).collect()) == sorted(want)


def test_queries_that_are_not_broadcast_meet_all_items(spark, monkeypatch):
    monkeypatch.setattr(exact, "QUERY_PART", 40)
    monkeypatch.setattr(exact, "ITEM_PART", 90)
    x = np.random.default_rng(4).normal(size=(200, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    d = np.round(exact.distances("cosine", x, x), 6)
    np.fill_diagonal(d, np.inf)
    want = sorted((i, int(j)) for i in range(200) for j in np.lexsort((np.arange(200), d[i]))[:6])
    assert sorted((r.query_id, r.id) for r in exact.knn(rows, rows.withColumnRenamed("id", "query_id"), 6, skip_self=True).collect()) == want


def test_candidates_by_tiles(monkeypatch):
    """Queries looked through in tiles, some without a bound, and ids that equal ones leave out: the pairs of a plain search, few products held at once."""
    monkeypatch.setattr(exact, "TILE", 7)
    draw = np.random.default_rng(6)
    q, x = np.round(draw.normal(size=(50, 4)), 1), np.round(draw.normal(size=(83, 4)), 1)
    ids, own = draw.permutation(90)[:50], draw.permutation(90)[:83]
    for metric in ("cosine", "l2sq", "inner_product", "l1"):
        d = np.round(exact.distances(metric, q, x), 6) + 0.0
        d[ids[:, None] == own[None]] = np.inf
        bound = np.where(np.arange(50) % 3 == 0, np.inf, np.partition(d, 4, axis=1)[:, 4])
        row, column, found = exact.candidates(metric, q, x, bound, 5, 6, (ids, own))
        assert np.allclose(found, d[row, column]) and np.isfinite(d[row, column]).all()
        near = d <= np.partition(d, 4, axis=1)[:, 4:5]
        assert set(zip(*np.nonzero(near), strict=True)) <= set(zip(row.tolist(), column.tolist(), strict=True))


def test_blocks_of_one_cell_are_tight(spark):
    """Even points in one cell: most of its blocks are far from a block of queries."""
    x = np.random.default_rng(8).random((4000, 2))
    near = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").coalesce(1)
    q = near.where("id % 40 = 0").withColumnRenamed("id", "query_id")
    r = pruned.pairs_kept(near, q, 5, "l2sq", n_cells=1, item_block=64, query_block=8).first()
    assert r.pairs == 4000 * 100 and r.kept < 0.5 * r.pairs
    assert rows(pruned.knn(near, q, 5, "l2sq", n_cells=1, item_block=64, query_block=8)) == rows(exact.knn(near, q, 5, "l2sq"))
