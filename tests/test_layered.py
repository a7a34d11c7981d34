import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import exact, graph, layered
from nearfield.operators.storage import fresh_path
from nearfield.plans.params import IndexParams

SF = "/root/testdata/sf0.001"
PARAMS = IndexParams(m=12, ef_construction=64, heuristic="diverse", keep_pruned=True)


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 200").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@pytest.fixture(scope="module")
def asked(items):
    return items.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


@pytest.fixture(scope="module")
def built(items):
    return layered.build(items, PARAMS)


def rows(df):
    return sorted(map(tuple, df.collect()))


def share(found, truth):
    truth = set(rows(truth.select("query_id", "id")))
    return len(truth & set(rows(found.select("query_id", "id")))) / len(truth)


def test_layers_degrees_and_entry(built, items):
    levels = {r.id: r.level for r in built.nodes.collect()}
    assert levels == {r.id: r.level for r in items.select("id", graph.level(F.col("id"), 12, 0).alias("level")).collect()}
    assert built.top == sorted(levels.values())[-2] <= levels[built.entry]
    edges = built.edges.collect()
    assert all(levels[e.src] >= e.layer and levels[e.dst] >= e.layer and e.src != e.dst for e in edges)
    degrees = {}
    for e in edges:
        degrees.setdefault((e.layer, e.src), []).append(e.pos)
    assert all(sorted(p) == list(range(1, len(p) + 1)) and len(p) <= PARAMS.degree(layer) for (layer, _), p in degrees.items())
    assert {src for layer, src in degrees if layer == 0} == set(levels)


def test_budgets_end_early(built, items, asked):
    some, cut = layered.search(built, asked, 10, 60, most_visited=20)
    assert max(r.visited for r in cut.collect()) < items.count() and 0 < some.count() <= 10 * asked.count()
    late, _ = layered.search(built, asked, 10, 50, deadline_s=0.0)
    assert late.count() == asked.count()  # where the way began


def test_where_nothing_passes_all_is_walked(built, items, asked):
    none, stats = layered.search(built, asked.limit(2), 5, 50, items.where("false"))
    assert none.count() == 0 and all(r.visited >= items.count() for r in stats.collect())


def test_a_graph_made_for_filters(items, asked):
    index = layered.build(items, IndexParams(m=12, ef_construction=64, heuristic="simple", optimize_for_filtering=True, gamma=2, mb=12))
    passing = items.where("label >= 5")
    found, _ = layered.search(index, asked, 10, 60, passing)
    assert share(found, exact.knn(items, asked, 10, where="label >= 5")) >= 0.85
    assert found.join(passing, "id", "left_anti").count() == 0


def test_steps_look_through_what_fails(spark):
    """Node 0 with neighbours 1 (fails), 2 (passes), 3 (fails), which have 4, 5 (fails), 6 behind them; node 9 with none that pass."""
    links = [(0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 1, 4), (1, 2, 5), (3, 1, 6), (2, 1, 6), (9, 1, 5)]
    passing = {2, 4, 6}
    edges = spark.createDataFrame([(a, p, b, b in passing) for a, p, b in links], "src long, pos long, dst long, ok boolean")
    open_ = spark.createDataFrame([(7, 0), (7, 9)], "query_id long, id long")

    def steps(layer, through, **options):
        return sorted(r.id for r in layered._steps(edges, open_, IndexParams(m=2, optimize_for_filtering=True, **options), layer, through).collect())

    assert steps(0, False) == [1, 2, 3, 5]
    assert steps(0, True, gamma=1) == [2, 4, 5, 6]  # 9 goes on to 5, as nothing passes
    assert steps(0, True, gamma=2, mb=2) == [2, 5, 6]  # what passes of the first two, and behind the others
    assert steps(0, True, gamma=2, mb=1) == [5, 6]
    assert steps(1, True) == [2, 5]


def test_batches_are_added(spark, items, asked):
    first = layered.build(items.where("id < 120"), PARAMS)
    heard = []
    both = layered.add(first, items, lambda *x: heard.append(x))
    assert (first.nodes.count(), both.nodes.count()) == (120, items.count())
    assert heard[-1] == (both.top + 1, both.top + 1)
    near = both.edges.where("layer = 0 AND pos = 1").select(F.col("src").alias("query_id"), F.col("dst").alias("id"))
    truth = exact.knn(items, items.select(F.col("id").alias("query_id"), "vector"), 1, skip_self=True)
    assert share(near, truth) >= 0.9  # old and new nodes know their nearest
    degrees = both.edges.groupBy("layer", "src").count().groupBy("layer").agg(F.max("count").alias("most")).collect()
    assert all(r.most <= PARAMS.degree(r.layer) for r in degrees)
    assert layered.add(both, items).nodes.count() == items.count()


def test_saved_and_loaded(spark, built, items, asked):
    path = fresh_path(spark, "layered")
    assert layered.save(built, path) == 1
    again = layered.load(spark, path, metric="cosine")
    assert (again.entry, again.top) == (built.entry, built.top)
    assert all(rows(getattr(again, t)) == rows(getattr(built, t)) for t in ("nodes", "edges"))
    assert layered.save(layered.empty(spark, PARAMS), path) == 2
    assert layered.load(spark, path).nodes.count() == 0 and layered.load(spark, path, 1).nodes.count() == items.count()
    with pytest.raises(ValueError):
        layered.load(spark, path, metric="l2sq")


def test_selection_by_loops(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(60, 4))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    d = np.round(exact.distances("l2sq", x, x), 6)
    pairs = [(i, j, float(d[i, j])) for i in range(60) for j in range(60) if i != j]
    near = spark.createDataFrame(pairs, "src long, dst long, distance double")
    for keep in (False, True):
        params = IndexParams(m=4, ef_construction=60, heuristic="diverse", keep_pruned=keep, metric="l2sq")
        got = {}
        for r in sorted(layered.select(near, items, 6, params).collect(), key=lambda r: (r.src, r.pos)):
            got.setdefault(r.src, []).append(r.dst)
        for i in range(60):
            kept, left = [], []
            for j in sorted((j for j in range(60) if j != i), key=lambda j: (d[i, j], j)):
                if len(kept) < 6:
                    (left if any(d[j, o] < d[i, j] for o in kept) else kept).append(j)
            assert got[i] == kept + (left[: 6 - len(kept)] if keep else [])
    assert layered.compressed([1, 2, 3, 4, 5], [[], [], [4], [], []], 9, 2) == [0, 1, 2, 4]


def test_odd_items(spark):
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (None, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0])], "id long, vector array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id long, vector array<double>")
    assert [(r.query_id, r.id) for r in layered.search(layered.build(odd, PARAMS), q, 9)[0].orderBy("rank").collect()] == [(7, 1), (7, 3), (7, 4)]
    none = layered.build(odd.limit(0), PARAMS)
    assert layered.search(none, q, 3)[0].count() == 0
    one = layered.build(odd.where("id = 4"), PARAMS)
    assert [r.id for r in layered.search(one, q, 3)[0].collect()] == [4]
    with pytest.raises(ValueError):
        layered.search(one, q, 0)


def test_links_are_exact_if_asked_for(items, monkeypatch):
    monkeypatch.setattr(layered, "MOST_EXACT", 8)
    built = layered.build(items, IndexParams(m=6, ef_construction=64, heuristic="simple"), exact=True)
    near = built.edges.where("layer = 0 AND pos <= 12").select(F.col("src").alias("query_id"), F.col("dst").alias("id"), F.round("distance", 6))
    truth = exact.knn(items, items.select(F.col("id").alias("query_id"), "vector"), 12, skip_self=True)
    assert rows(near) == rows(truth.select("query_id", "id", F.round("distance", 6)))


def test_a_beam_as_wide_as_the_graph_walks_once(built, items, asked, monkeypatch):
    """Over 2 nodes that only lead out: they are reached, too."""
    monkeypatch.setattr(layered, "WIDE", 100)
    alone = layered.replace(built, edges=built.edges.where("dst NOT IN (3, 50)"))
    for where in (None, "label >= 5"):
        found, stats = layered.search(alone, asked, 10, 300, None if where is None else items.where(where))
        assert rows(found) == rows(exact.knn(items, asked, 10, where=where))
        assert {r.visited for r in stats.collect()} == {items.count()}


def test_the_size_of_a_graph_does_not_switch_searches(built, items, asked, monkeypatch):
    """A beam of an eighth of the nodes or more stays a beam; a search without a width is whole at any size."""
    alone = layered.replace(built, edges=built.edges.where("dst NOT IN (3, 50)"))
    walked = []
    for wide in (10, 1 << 40):
        monkeypatch.setattr(layered, "WIDE", wide)
        walked.append([rows(x) for x in layered.search(alone, asked, 10, 30)])
        found, stats = layered.search(alone, asked, 10, None)
        assert rows(found) == rows(exact.knn(items, asked, 10)) and {r.visited for r in stats.collect()} == {items.count()}
    assert walked[0] == walked[1]


def test_beams_by_loops(built, items, asked):
    """Found, visited and rounds are those of a walk in plain loops, though a round only knows the beams."""
    x = {r.id: np.array(r.vector, float) for r in items.collect()}
    links = {}
    for e in built.edges.collect():
        links.setdefault((e.layer, e.src), []).append(e.dst)
    want = {}
    for q in asked.collect():
        far = lambda i: round(float(exact.apart("cosine", np.array([q.vector], float), x[i][None])[0]), 6) + 0.0  # noqa: B023, E731
        start, total, rounds = built.entry, 0, 0
        for layer in range(built.top, -1, -1):
            width, met, done = 20 if layer == 0 else 1, {start: far(start)}, set()
            while True:
                order = sorted(met, key=lambda i: (met[i], i))  # noqa: B023
                bound = met[order[width - 1]] if len(order) >= width else np.inf
                opened = [i for i in order if i not in done and met[i] <= bound][: max(width, 16)]
                if not opened:
                    break
                done.update(opened)
                met.update({j: far(j) for i in opened for j in links.get((layer, i), [])})
            total, start = total + len(met), order[0]
        want[q.query_id] = (order[:10], total - built.top)
    found, stats = layered.search(built, asked, 10, 20)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.id)
    assert {r.query_id: (got[r.query_id], r.visited) for r in stats.collect()} == want


def test_links_of_many_nodes_at_once(spark, monkeypatch):
    """Nodes of one to fifteen candidates, some at a time and some cut by a batch, against a loop for each."""
    monkeypatch.setattr(layered, "MOST_AT_ONCE", 500)
    draw = np.random.default_rng(2)
    for metric in ("cosine", "l2sq", "l1", "inner_product", "cosine_units"):
        x = draw.normal(size=(40, 5)).astype(np.float32)
        d = np.round(exact.distances(metric, x, x), 6)
        near = [sorted(draw.choice(40, n, replace=False).tolist(), key=lambda j: (d[i, j], j)) for i, n in enumerate(draw.integers(1, 16, 40))]  # noqa: B023
        flat = [(i, j, float(d[i, j]), x[j].tobytes()) for i, row in enumerate(near) for j in row]
        whole = layered.pa.Table.from_arrays([layered.pa.array(c) for c in zip(*flat, strict=True)], names=["src", "dst", "distance", "v"])
        for keep in (False, True):
            params, want = IndexParams(m=3, heuristic="diverse", keep_pruned=keep, metric=metric), []
            for i, row in enumerate(near):
                kept, left = [], []
                for j in row:
                    if len(kept) < 6:
                        (left if any(d[j, o] < d[i, j] for o in kept) else kept).append(j)
                want += [(i, p, j) for p, j in enumerate(kept + (left[: 6 - len(kept)] if keep else []), 1)]
            got = layered.pa.Table.from_batches(layered._picked(params, 6, np.float32)(iter(whole.to_batches(max_chunksize=17))))
            assert list(zip(*(got.column(c).to_pylist() for c in ("src", "pos", "dst")), strict=True)) == want
