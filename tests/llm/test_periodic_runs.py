import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm.periodic_runs import least_overlap, most_repeated, periodic_runs, repeated_words, runs_of, with_periods


def by_loops(words, least=24, repeats=3):
    found, n = {}, len(words)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, repeats * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_overlap():
    assert least_overlap(24, 3) == 16
    assert least_overlap(5, 2) == 3


def words_of(kind, n, rng):
    if kind == "few letters":
        return [rng.choice("ab") for _ in range(n)]
    if kind == "thue-morse":
        return ["ab"[bin(i).count("1") % 2] for i in range(n)]
    if kind == "fibonacci":
        a, b = "a", "ab"
        while len(b) < n:
            a, b = b, b + a
        return list(b[:n])
    out = []
    while len(out) < n:
        part = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))]
        out += part * rng.choice([1, 2, 3, 4, 9])
    return out[:n]


@pytest.mark.parametrize("kind", ["few letters", "thue-morse", "fibonacci", "blocks"])
def test_runs_by_loops(kind):
    rng = random.Random(3)
    for least, repeats in ((24, 3), (5, 2), (6, 3)):
        texts = [words_of(kind, rng.randint(0, 260), rng) for _ in range(25)]
        ours = runs_of([[w.encode() for w in t] for t in texts], least, repeats)
        assert [sorted(map(tuple, r.tolist())) for r in ours] == [by_loops(t, least, repeats) for t in texts]


def test_masked_words_are_in_no_run():
    words = [b"x%d" % i for i in range(100)] + [b"a", b"b", b"c"] * 9 + [b"y%d" % i for i in range(100)]
    inside = repeated_words(np.unique(words, return_inverse=True)[1], np.array([0, len(words)]), 16)
    assert inside[100:127].all() and inside.sum() == 27


def test_documents_by_loops(cases):
    rows = {(r.doc_id, r.n_words, str(r.runs), r.collapsed) for r in periodic_runs(with_periods(cases)).collect()}
    n = 0
    for r in with_periods(cases).collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        if len(words) > 3000:
            continue
        runs = by_loops(words)
        n += len(runs)
        found = [x for x in rows if x[0] == r.doc_id and x[1] == len(words) and x[3] == collapsed(words, runs)]
        assert found and all(f"Row(start={s}, length={m}, period={q})" in found[0][2] for s, m, q in runs)
    assert n > 10


def test_long_text_of_one_word(odd):
    r = periodic_runs(odd).where("n_words = 30000").first()
    assert [tuple(x) for x in r.runs] == [(0, 30000, 1)] and r.collapsed == "word"


def test_fixture(spark):
    import zlib

    rows = [(i, " ".join(f"w{j}" for j in range(40 + i))) for i in range(100)]
    for r in with_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        words, h = rows[r.doc_id][1].split(), zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        assert r.text == " ".join(words)


def test_best_run(spark):
    runs = [(9, 30, 10), (4, 24, 2), (1, 36, 3), (0, 12, 1)]
    df = spark.createDataFrame([(runs,), ([],)], "runs array<struct<start:long,length:long,period:long>>")
    assert [r.b and tuple(r.b) for r in df.select(most_repeated(F.col("runs")).alias("b")).collect()] == [(0, 12, 1), None]


def test_odd_rows(odd):
    assert periodic_runs(odd.withColumn("runs", F.lit(1))).count() == odd.count()
    assert periodic_runs(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(odd, repeats=1)
