"""Evaluation of searches as relational plans: ground truth, recall, fronts, sweeps and summaries."""

from __future__ import annotations

import time
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .exact import knn, near_by_block
from .skyline import skyline
from .storage import durable


def hybrid_ground_truth(items: DataFrame, queries: DataFrame, k: int, attribute: str, metric: str = "l2sq") -> DataFrame:
    """The k nearest items that share each query's attribute."""
    return knn(items, queries, k, metric, same=attribute)


def random_attribute(item_id: Column, most: int = 12, seed: int = 42) -> Column:
    """An attribute from 1 to `most`, evenly spread, from a hash of the id: the same wherever it is computed."""
    spread = (F.pmod(item_id, F.lit(1 << 31)) * 2654435761 + seed) % (1 << 32)
    return (F.floor(spread * most / float(1 << 32)) + 1).cast("long")


def _first(ranked: DataFrame, limit: int) -> DataFrame:
    """The different ids among the first of each query."""
    return ranked.where(F.col("rank") <= limit).select("query_id", "id").distinct()


def recall_at_k(found: DataFrame, truth: DataFrame, limit: int) -> DataFrame:
    """By query, of the ids among the first `limit` on both sides, each once: matches / limit, and matches / size of its truth, which may be less than limit."""
    hits = _first(truth, limit).join(_first(found, limit).withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    out = hits.groupBy("query_id").agg(F.count("hit").alias("matches"), F.count("*").alias("available"))
    return out.select("query_id", "matches", F.round(F.col("matches") / float(limit), 6).alias("recall"), F.round(F.col("matches") / F.col("available"), 6).alias("recall_vs_available"))


def recall_at_1(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of queries whose first result is the true nearest."""
    first = found.where("rank = 1").groupBy("query_id").agg(F.min("id").alias("found"))
    return _first(truth, 1).join(first, "query_id", "left").agg(F.round(F.avg(F.coalesce(F.col("found") == F.col("id"), F.lit(False)).cast("double")), 6).alias("recall_at_1"), F.count("*").alias("n_queries"))


def hit_rate(found: DataFrame, truth: DataFrame, limit: int = 10) -> DataFrame:
    """Share of queries whose true nearest is among the first results."""
    near = _first(found, limit).withColumn("hit", F.lit(1.0))
    return _first(truth, 1).join(near, ["query_id", "id"], "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("hit_rate"), F.count("*").alias("n_queries"))


def self_recall(found: DataFrame) -> DataFrame:
    """Queries that are items: how many don't find themselves first, and the largest best distance."""
    first = found.where("rank = 1")
    return first.agg(F.sum((F.col("id") != F.col("query_id")).cast("long")).alias("wrong"), F.max("distance").alias("max_error"), F.count("*").alias("n"))


def pareto_front(results: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rows that none of the same keys dominates: at least as good in both and better in one. Equal optima all stay; rows without either goal don't."""
    return skyline(results, keys, [x, y])


def distinct_configs(results: DataFrame, *columns: str) -> DataFrame:
    return results.select(*columns).distinct().orderBy(*columns)


def selectivity_sweep(items: DataFrame, queries: DataFrame, k: int, steps: range = range(0, 101, 10)) -> DataFrame:
    """For each excluded percentage p, the k nearest items with id % 100 < 100 - p: how many, and their mean distance.

    One search: items are blocked by the steps that they pass, each block gives its k nearest, and steps rank what they pass.
    """
    passing = F.filter(F.array(*(F.lit(p).cast("long") for p in steps)), lambda p: F.col("id") % 100 < 100 - p)
    near = near_by_block(items, queries, k, "cosine", same=False, item_group=F.size(passing))
    order = Window.partitionBy("pct", "query_id").orderBy("distance", "id")
    found = near.select("query_id", "id", "distance", F.explode(passing).alias("pct")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.groupBy("pct").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 9).alias("mean_distance"))


def param_grid(spark: SparkSession, **values: list) -> DataFrame:
    """All combinations of parameter values, a column for each."""
    out = spark.range(1).select()
    for name, some in values.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, some))).alias(name))
    return out


def metric_summary(df: DataFrame, value: str | Column, *by: str) -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("sd"), F.max(v).alias("largest"), F.round(F.sum(v), 4).alias("total"))


def kth_value(items: DataFrame, column: str, k: int, bins: int = 4096) -> tuple[int, int] | None:
    """The k-th value of an integer column in ascending order, from 1, and how many of the rows with it are among the first k.

    Counts by histogram, each of the bin that holds the k-th: at most six rounds for 64 bits, over the column alone. None where there are fewer rows.
    """
    rows = items.where(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("v"))
    low, high, n = rows.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not 1 <= k <= n:
        return None
    while low < high:
        width = -(-(high - low + 1) // bins)
        place = F.floor((F.col("v").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("int")
        counts = rows.where(F.col("v").between(low, high)).groupBy(place.alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()  # a row a bin
        for r in counts:
            if k <= r.n:
                low, high = low + r.b * width, min(high, low + (r.b + 1) * width - 1)
                break
            k -= r.n
    return low, k


def first_rows(items: DataFrame, k: int, column: str = "id") -> DataFrame:
    """The first k rows by an integer column: of rows with the last value that is in, any. Rows stay where they are: only those with that value are counted off."""
    if k >= (n := items.where(F.col(column).isNotNull()).count()):
        return items.where(F.col(column).isNotNull())
    found = kth_value(items, column, k) if n else None
    if found is None:
        return items.where("false")
    value, taken = found
    return items.where(F.col(column) < value).union(items.where(F.col(column) == value).limit(taken))


def subset_fraction(items: DataFrame, share: float) -> DataFrame:
    """The first rows by id: the share of the table, at least one. Rows without id don't count."""
    return first_rows(items, max(1, int(items.where("id IS NOT NULL").count() * share)))


def runs(items, queries: DataFrame, truth: DataFrame, search, grid: DataFrame | list[dict], limit: int = 10, repeats: int = 3, listener=None) -> DataFrame:
    """A row for each setting of a grid: its columns, recall at the limit against a truth, queries per second, milliseconds a query and n_queries.

    search(items, queries, limit, **setting) gives query_id, id, distance and rank. Each setting runs once to warm up, which gives the
    recall (the share of the truth's first ids that were found), and `repeats` times to be timed; the median counts. A grid is settings, or a frame of
    them such as `param_grid` gives. listener(done, total) hears of each setting that is done. `pareto_front` takes the result.
    """
    rows, names = [], None
    n = queries.count()
    wanted = durable(_first(truth, limit))
    total = wanted.count()
    settings = [r.asDict() for r in grid.collect()] if isinstance(grid, DataFrame) else list(grid)  # parameters, not data
    for done, setting in enumerate(settings, 1):
        names = names or list(setting)
        hits = _first(search(items, queries, limit, **setting), limit).join(wanted, ["query_id", "id"]).count()
        seconds = []
        for _ in range(repeats):
            began = time.perf_counter()
            search(items, queries, limit, **setting).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - began)
        took = max(sorted(seconds)[len(seconds) // 2], 1e-9) if seconds else float("nan")
        rows.append((*(setting[c] for c in names), hits / max(1, total), n / took, 1000 * took / max(1, n), n))
        if listener:
            listener(done, len(settings))
    spark = queries.sparkSession
    kind = lambda v: {bool: "boolean", int: "long", float: "double"}.get(type(v), "string")
    fields = [f"`{c}` {kind(settings[0][c])}" for c in names or []]
    return spark.createDataFrame(rows, ", ".join([*fields, "recall double, qps double, ms_a_query double, n_queries long"]))


def write_report(results: DataFrame, path: str, keys: list[str], x: str = "qps", y: str = "recall", form: str = "json") -> None:
    """Writes all runs under `runs` and their front under `front`, as CSV with a header or as JSON."""
    if form not in ("csv", "json"):
        raise ValueError("form must be csv or json")
    for name, rows in (("runs", results), ("front", pareto_front(results, keys, x, y))):
        rows.coalesce(1).write.mode("overwrite").option("header", True).format(form).save(f"{path}/{name}")  # a row a setting


def read_values(spark: SparkSession, path: str, pattern: str, **columns: str) -> DataFrame:
    """A metrics table from text files that hold one number each and name their parameters: file, a column for each group of the pattern with the type given for it, and value.

    read_values(spark, folder, r"recall_m(\\d+)_ef(\\d+)", m="int", ef="int"). Files of other names are left out; a file without a number has a null.
    """
    names = F.element_at(F.split(F.input_file_name(), "/"), -1)
    rows = spark.read.text(path, wholetext=True).select(names.alias("file"), F.expr("try_cast(trim(BOTH ' \n\r\t' FROM value) AS DOUBLE)").alias("value"))
    groups = [F.regexp_extract("file", pattern, i).cast(kind).alias(c) for i, (c, kind) in enumerate(columns.items(), 1)]
    return rows.where(F.col("file").rlike(pattern)).select("file", *groups, "value")
