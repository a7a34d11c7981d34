import hashlib
import re

import numpy as np
import pytest

from nearfield.llm.fill_in_middle import EliasFano, boundaries, distinct_texts, restored, transformed
from pyspark.sql import functions as F


def by_loops(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, s = len(tokens), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, x = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{x}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{x}<M>{m}"


@pytest.mark.parametrize("most_copies", [1, 256])
def test_by_loops(cases, most_copies):
    """Also with every text that occurs twice salted."""
    marked = cases.selectExpr("doc_id + 5000 AS doc_id", "concat(coalesce(text, ''), ' <S> ', coalesce(text, '')) AS text").limit(30)
    docs = cases.select("doc_id", "text").union(marked)
    key = lambda r: (r[0] is None, str(r))
    ours = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.t) for r in transformed(docs, most_copies=most_copies).select("*", restored(F.col("output"), F.col("form")).alias("t")).collect()), key=key)
    assert ours == sorted(((r.doc_id, *by_loops(r.doc_id, r.text), r.text or "") for r in docs.collect()), key=key)
    assert {r[2] for r in ours} == {"plain", "psm", "spm"}


def test_texts_are_indexed_once(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 2 else f"text {i}") for i in range(1000)], "doc_id long, text string").repartition(7)
    groups = distinct_texts(docs).collect()
    assert sum(len(g.members) for g in groups) == 1000
    assert max(len(g.members) for g in groups) < 400  # salted by twos
    assert sum(g.texts == ["same text"] for g in groups) == 2 and all(len(g.texts) == 1 for g in groups)


def test_odd_columns_and_empty_table(odd):
    assert transformed(odd.withColumn("_key", F.lit(1)).withColumn("n", F.lit(1))).count() == odd.count()
    assert transformed(odd.limit(0)).count() == 0


def test_lists_select(spark):
    rng = np.random.default_rng(1)
    for gaps in (1, 3, 100, 10**6):
        for n in (1, 2, 63, 64, 65, 1000):
            values = np.cumsum(rng.integers(1, gaps + 1, n))
            ends = EliasFano(values)
            assert [ends.select(k) for k in range(n)] == values.tolist()
            assert len(ends.low) + len(ends.high) <= 8 + n * (2 + np.log2(values[-1] / n + 2)) / 8
    assert EliasFano(boundaries("")).n == 0
    assert boundaries("ab1 çd").tolist() == [2, 3, 4, 5, 6]
