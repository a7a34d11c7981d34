import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import cell_index, commits, exact
from nearfield.operators.storage import fresh_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@pytest.fixture(scope="module")
def asked(items):
    return items.where("id % 100 = 0").withColumnRenamed("id", "query_id")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_saved_once_and_exact_with_all_cells(spark, items, asked):
    path = fresh_path(spark, "cells")
    cell_index.create(items, path, n_cells=8)
    index = cell_index.load(spark, path, metric="cosine")
    assert (index.version, index.n_items) == (1, items.count())
    assert rows(cell_index.search(index, asked, 10, 8)) == rows(exact.knn(items, asked, 10))
    assert rows(cell_index.search(index, asked, 10, 8, where="label = 3")) == rows(exact.knn(items, asked, 10, where="label = 3"))
    assert sorted(index.items().columns) == sorted(items.columns)
    with pytest.raises(ValueError):
        cell_index.create(items, path)
    with pytest.raises(ValueError):
        cell_index.load(spark, path, metric="l2sq")
    with pytest.raises(ValueError):
        cell_index.load(spark, path, version=9)


def test_fewer_probes_open_fewer_files(spark, items, asked):
    index = cell_index.create(items, fresh_path(spark, "cells"), n_cells=8, rows_a_file=20)
    assert index.n_files > 16  # cells of more than twenty rows are more than one file
    read = [cell_index.reads(index, asked.where("query_id = 0"), p).first() for p in (1, 3, 8)]
    assert [r.cells_read for r in read] == [1, 3, 8]
    assert read[0].files_read < read[1].files_read < read[2].files_read == index.n_files
    found = cell_index.search(index, asked.where("query_id = 0"), 5, 1)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_append_without_clustering_again(spark, items, asked):
    path = fresh_path(spark, "cells")
    first = cell_index.create(items.where("id < 300"), path, n_cells=8, pieces=8)
    before = rows(cell_index.search(first, asked, 10, 8))
    more = cell_index.append(spark, path, items.where("id >= 250"))
    assert (more.version, more.n_items) == (2, items.count())  # those that it had are left out
    assert (more.centres == first.centres).all() and len(more.parts) == 2
    assert rows(cell_index.search(more, asked, 10, 8)) == rows(exact.knn(items, asked, 10))
    assert rows(cell_index.search(cell_index.load(spark, path, version=1), asked, 10, 8)) == before == rows(cell_index.search(first, asked, 10, 8))
    again = cell_index.append(spark, path, items.where("id >= 400"), batch=1)  # a batch of the same number takes the place of the old one
    assert again.n_items == 300 + items.where("id >= 400").count()


def test_compaction_by_its_predicate(spark, items, asked):
    path = fresh_path(spark, "cells")
    cell_index.create(items.where("id < 300"), path, n_cells=4)
    kept = cell_index.append(spark, path, items.where("id >= 300 AND id < 320"), compact_when=(50, 0.1))
    assert len(kept.parts) == 2 and not cell_index.needs_compaction(kept, 50, 0.1)
    merged = cell_index.append(spark, path, items.where("id >= 320"), compact_when=(50, 0.1))
    assert len(merged.parts) == 1 and merged.n_items == items.count()
    assert rows(cell_index.search(merged, asked, 10, 4)) == rows(exact.knn(items, asked, 10))
    again = cell_index.append(spark, path, items.where("id >= 320"), batch=2)  # a replay of a batch that was merged changes nothing
    assert again.version == merged.version and again.n_items == items.count()
    assert rows(cell_index.search(kept, asked, 10, 4)) == rows(exact.knn(items.where("id < 320"), asked, 10))
    assert len(cell_index.vacuum(spark, path, older_than_s=0)) == 3
    assert rows(cell_index.search(cell_index.load(spark, path), asked, 10, 4)) == rows(exact.knn(items, asked, 10))


def test_ten_writers_at_once(spark, items):
    path = fresh_path(spark, "cells")
    cell_index.create(items.where("id < 50"), path, n_cells=4)
    failed = []

    def one(i):
        try:
            cell_index.append(spark, path, items.where(f"id >= 50 AND id % 10 = {i}"), skip_known=False)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=one, args=(i,)) for i in range(10)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    index = cell_index.load(spark, path)
    assert index.version == 11 and sorted(p["batch"] for p in index.parts.values()) == list(range(11))
    assert rows(index.items().select("id")) == rows(items.select("id"))
    assert cell_index.vacuum(spark, path, older_than_s=0) == []


def test_lost_compaction_leaves_no_orphan(spark, items, monkeypatch):
    path = fresh_path(spark, "cells")
    cell_index.create(items.where("id < 50"), path, n_cells=4)
    write = cell_index._written

    def slow(*a):
        out = write(*a)
        monkeypatch.setattr(cell_index, "_written", write)
        cell_index.append(spark, path, items.where("id < 10"), batch=0, skip_known=False)  # meanwhile the part is replaced
        return out

    monkeypatch.setattr(cell_index, "_written", slow)
    with pytest.raises(commits.Conflict):
        cell_index.compact(spark, path)
    assert cell_index.load(spark, path).n_items == 10
    assert len(cell_index.vacuum(spark, path, older_than_s=0)) == 1


def test_log_puts_once_and_keeps_states(spark):
    path = fresh_path(spark, "log")
    assert commits.state(spark, path) == commits.empty()
    for i in range(40):
        commits.commit(spark, path, lambda now, i=i: {"add": {f"p{i}": {"n": i}}, "remove": [f"p{i - 1}"]})
    assert commits.state(spark, path)["parts"] == {"p39": {"n": 39}}
    assert commits.state(spark, path, 17)["parts"] == {"p16": {"n": 16}}
    assert not commits.put(spark, f"{path}/_log", f"{40:020d}.json", {})
    names = [s.getPath().getName() for s in commits._list(spark, f"{path}/_log")]
    assert sum(n.endswith(".state") for n in names) == 2 and not any(n.startswith(".0") and not n.endswith(".crc") for n in names)


def test_codes_find_what_vectors_do(spark, items, asked):
    index = cell_index.create(items, fresh_path(spark, "cells"), n_cells=8, pieces=16)
    for where in (None, "label = 3"):
        truth = set(rows(exact.knn(items, asked, 10, where=where).select("query_id", "id")))
        found = rows(cell_index.search(index, asked, 10, 8, where=where, rerank=19))
        assert len(truth & {r[:2] for r in found}) >= 0.9 * len(truth)
    every = cell_index.search(index, asked, 10, 8, rerank=items.count())
    assert rows(every) == rows(exact.knn(items, asked, 10))
    with pytest.raises(ValueError):
        cell_index.search(index, asked, 10, 8, rerank=5)


def test_codes_are_nearest_centres():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 12))
    books = cell_index.codebooks_of(x, 4, centres=16)
    codes = cell_index.coded(x, books)
    for j, (part, book) in enumerate(zip(np.array_split(x, 4, axis=1), books, strict=True)):
        assert (codes[:, j] == [((book - v) ** 2).sum(1).argmin() for v in part]).all()


def test_odd_items(spark):
    odd = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (None, [0.0, 1.0], 1), (3, [0.0, 0.0], 2)], "id long, vector array<double>, cell long")
    index = cell_index.create(odd, fresh_path(spark, "cells"), n_cells=4, pieces=2)
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None), (None, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [(r.query_id, r.id) for r in cell_index.search(index, q, 3, 4).collect() if r.query_id] == [(7, 1), (7, 1), (7, 3)]
    none = cell_index.create(odd.limit(0), fresh_path(spark, "cells"), n_cells=4, pieces=2)
    assert cell_index.search(none, q, 3, 4).count() == 0 and cell_index.search(none, q, 3, 4, rerank=3).count() == 0
    with pytest.raises(ValueError):
        cell_index.append(spark, none.path, odd)
    with pytest.raises(ValueError):
        cell_index.create(odd.withColumnRenamed("cell", "_cell"), fresh_path(spark, "cells"))
