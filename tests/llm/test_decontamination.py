import hashlib
import re

from nearfield.llm import decontamination as d


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    windows = [(tuple(iw[i : i + 10]), item) for item, t in items if (iw := words(t)) for i in range(max(1, len(iw) - 9))]
    for size in {len(x) for x, _ in windows}:
        at = {}
        for i in range(len(w) - size + 1):
            at.setdefault(tuple(w[i : i + size]), []).append(i)
        for win, item in windows:
            for i in at.get(win, ()) if len(win) == size else ():
                hit |= set(range(i, i + size))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def check(spark, docs, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = d.contamination(docs.selectExpr("doc_id", "text"), bench, **options).collect()
    assert len(found) == docs.count()
    known = {}
    for r in found:
        if r.text not in known:
            known[r.text] = brute(r.text, items)
        n = sum(b - a for a, b in r._ranges)
        assert (r._n_words, n, len(r._items), hashlib.sha256(",".join(r._items).encode()).hexdigest(), n > 0) == known[r.text]
        for (a, b), (x, y) in zip(r._ranges, d.original_spans(r.text or "", r._ranges), strict=True):
            assert words(r.text[x:y]) == words(r.text)[a:b]


def test_brute_force(spark, cases):
    from .conftest import SF

    rows = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    items = [(r.item_id, r.text) for r in rows] + [(900, None), (901, ""), (902, "a B"), (903, "word " * 14), (904, "one! two"), (905, "one two"), (906, "NUL")]
    check(spark, cases, items)
    check(spark, cases.limit(60), items, block_bytes=300)


def test_empty_benchmark(spark, odd):
    check(spark, odd, [])


def test_stretches_of_items_that_share_words(spark):
    """Items that repeat themselves and each other, documents of pieces of them, around the window's length."""
    import random

    draw = random.Random(5)
    word = lambda: draw.choice("abc") * draw.randrange(1, 3)
    items = [(i, " ".join(word() for _ in range(draw.choice((3, 5, 9, 10, 11, 14, 25, 60))))) for i in range(40)]
    docs = []
    for i in range(150):
        parts = []
        for _ in range(draw.randrange(1, 5)):
            w = draw.choice(items)[1].split()
            a = draw.randrange(len(w))
            parts += [*w[a : a + draw.randrange(1, 30)], *(draw.choice(["zz", word()]) for _ in range(draw.randrange(3)))]
        docs.append((i, " ".join(parts)))
    check(spark, spark.createDataFrame(docs, "doc_id long, text string"), items)


def test_repetitive_texts_take_linear_time():
    import time

    scanner = d.Scanner([("a", "word " * 20_000), ("b", "word other " * 10_000)], 10)
    began = time.perf_counter()
    assert scanner.hits(["word"] * 20_000) == ([[0, 20_000]], {"a"})
    assert scanner.hits(["word", "other"] * 10_000) == ([[0, 20_000]], {"b"})
    assert time.perf_counter() - began < 5
