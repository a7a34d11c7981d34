import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import cell_index, exact, graph, skyline
from nearfield.operators import evaluation as ev
from nearfield.operators.storage import fresh_path

FOUND = "query_id long, id long, rank long"


def test_recall_counts_each_id_once(spark):
    found = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 6, 3)], FOUND)
    truth = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3)], FOUND)
    r = ev.recall_at_k(found, truth, 2).first()
    assert (r.matches, r.recall, r.recall_vs_available) == (1, 0.5, 0.5)
    r = ev.recall_at_k(found, truth, 10).first()
    assert (r.matches, r.recall, r.recall_vs_available) == (2, 0.2, round(2 / 3, 6))
    again = found.union(found)
    assert ev.hit_rate(again, truth, 1).first().n_queries == 1 == ev.recall_at_1(again, truth).first().n_queries


@pytest.mark.parametrize("goals", [1, 2, 3])
def test_skyline_by_loops(spark, monkeypatch, goals):
    """In blocks of a few points, so that several meet."""
    monkeypatch.setattr(skyline, "BLOCK", 4)
    draw = random.Random(goals)
    rows = [(draw.choice(["a", "b", None]), i, *(draw.choice([None, 1.0, 7.0]) if draw.random() < 0.1 else draw.randint(0, 12) * 1.5 for _ in range(goals))) for i in range(300)]
    names = [f"g{i}" for i in range(goals)]
    df = spark.createDataFrame(rows, ", ".join(["k string", "n long", *(f"{g} double" for g in names)])).repartition(5)
    known = [r for r in rows if None not in r[2:]]
    best = [r for r in known if not any(o[0] == r[0] and all(x >= y for x, y in zip(o[2:], r[2:], strict=True)) and o[2:] != r[2:] for o in known)]
    assert sorted(map(tuple, skyline.skyline(df, ["k"], names).collect()), key=str) == sorted(best, key=str)
    whole = [r for r in known if not any(all(x >= y for x, y in zip(o[2:], r[2:], strict=True)) and o[2:] != r[2:] for o in known)]
    assert sorted(map(tuple, skyline.skyline(df, [], names).collect()), key=str) == sorted(whole, key=str)


def test_skyline_of_points_that_all_stay(spark):
    df = spark.range(3000).select(F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b")).repartition(6)
    assert skyline.skyline(df, [], ["a", "b"]).count() == 3000
    assert skyline.skyline(df.limit(0), [], ["a", "b"]).count() == 0


def test_first_rows_by_counting(spark):
    draw = random.Random(4)
    values = [draw.choice([-(2**62), -5, 0, 7, 7, 7, 10**6, 2**62, draw.randint(-(10**9), 10**9)]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "id long").repartition(4)
    ordered = sorted(values)
    for k in (1, 100, 499, 900):
        assert sorted(r.id for r in ev.first_rows(df, k).collect()) == ordered[:k]
    assert ev.first_rows(df.limit(0), 3).count() == 0 and ev.kth_value(df, "id", 501) is None
    some = ev.first_rows(df, 100)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_runs_and_reports(spark, tmp_path):
    x = spark.range(60).select("id", F.array(F.sin("id"), F.cos("id"), F.col("id") % 3 * 0.1).alias("vector"))
    q = x.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    truth = exact.knn(x, q, 5)
    heard = []
    index = cell_index.create(x, fresh_path(spark, "cells"), 6)
    found = ev.runs(index, q, truth, cell_index.search, ev.param_grid(spark, probes=[1, 6]), 5, repeats=1, listener=lambda *a: heard.append(a))
    rows = {r.probes: r for r in found.collect()}
    assert rows[6].recall == 1.0 and 0 < rows[1].recall < 1 and heard == [(1, 2), (2, 2)]
    assert all(r.qps > 0 and abs(r.qps * r.ms_a_query - 1000) < 1e-6 * 1000 for r in rows.values())
    for form in ("json", "csv"):
        ev.write_report(found, str(tmp_path / form), [], form=form)
        front = spark.read.schema(found.schema).option("header", True).format(form).load(str(tmp_path / form / "front"))
        assert 6 in {r.probes for r in front.collect()}
    for name, text in (("recall_m16_ef50", "0.91\n"), ("recall_m32_ef400", " 0.99 "), ("recall_m8_ef1", "none"), ("notes", "5")):
        (tmp_path / "values").mkdir(exist_ok=True)
        (tmp_path / "values" / name).write_text(text)
    table = ev.read_values(spark, str(tmp_path / "values"), r"recall_m(\d+)_ef(\d+)", m="int", ef="int")
    assert sorted((r.m, r.ef, r.value) for r in table.collect() if r.value) == [(16, 50, 0.91), (32, 400, 0.99)] and table.count() == 3


def test_ids_with_equal_values_and_clashing_columns(spark):
    df = spark.range(1000).select(F.lit(3).alias("id"), F.col("id").alias("_part"), F.lit("x").alias("row"), F.lit(1).alias("tie"))
    out = graph.assign_ids(df, "id", 7)
    assert sorted(r.item_id for r in out.collect()) == list(range(7, 1007))
    assert out.columns == [*df.columns, "item_id"]
    parts = df.repartition(4)
    assert np.array_equal(sorted(r.item_id for r in graph.append_ids(graph.append_ids(None, parts, "id"), parts, "id").collect()), np.arange(2000))


def test_lines_by_level_in_the_order_of_a_queue(spark):
    edges = spark.createDataFrame([(1, 0, 1, 5, 0.1), (0, 0, 1, 2, 0.1), (0, 0, 2, 1, 0.2), (0, 1, 1, 4, 0.1), (0, 2, 1, 3, 0.1), (0, 2, 2, 4, 0.1), (0, 9, 1, 0, 0.1), (1, 5, 1, 0, 0.1)], "layer long, src long, pos long, dst long, distance double")
    lines = [r.line for r in graph.printed_reachable(edges, spark.createDataFrame([(0,)], "id long")).collect()]
    assert lines == ["[LEVEL 1]", "(0) -> {5}", "(5) -> {0}", "[LEVEL 0]", "(0) -> {2, 1}", "(2) -> {3, 4}", "(1) -> {4}"]


def test_points_of_many_keys_are_thinned_at_once(monkeypatch):
    """Keys of one to thirty points with ties and copies, some over the bound, against a loop for each."""
    monkeypatch.setattr(skyline, "FEW", 8)
    draw = np.random.default_rng(4)
    for goals in (1, 2, 3):
        own = np.repeat(np.arange(50), draw.integers(1, 31, 50))
        points, order = draw.integers(0, 6, (len(own), goals)).astype(float), draw.permutation(len(own))
        points[::17, 0] = -np.inf
        want = {(k, *p) for k in range(50) for p in map(tuple, points[own == k][~skyline.dominated(points[own == k], points[own == k])])}
        keys, left = skyline.thinned(own[order], points[order])
        assert len(keys) == len(want) and {(k, *p) for k, p in zip(keys.tolist(), map(tuple, left), strict=True)} == want


def test_a_key_of_few_points_is_one_block(spark, monkeypatch):
    """Points of each key in eight tasks: blocks are about as many as keys, so that pairs of blocks don't grow with tasks."""
    tables, put = [], skyline.Scratch.put
    monkeypatch.setattr(skyline.Scratch, "put", lambda self, df: tables.append(put(self, df)) or tables[-1])
    df = spark.range(8000).selectExpr("id % 300 AS k", "double(id % 7) AS a", "double(hash(id) % 50) AS b").repartition(8)
    found = skyline.skyline(df, ["k"], ["a", "b"])
    assert found.select("k").distinct().count() == 300
    blocks = next(t for t in tables if "points" in t.columns)
    assert 300 <= blocks.count() <= 300 + 2 * 8
