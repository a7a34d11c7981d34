import hashlib

import xxhash
from pyspark.sql import functions as F

from nearfield.llm.fingerprints import ATTEMPTS, BINS, as_text, compared, edited, fingerprint, fingerprinted, likeness, op11_fingerprints

from .conftest import SF

MASK = (1 << 64) - 1


def chained(values):
    """Spark's xxhash64 of columns: bytes of strings, longs or ints."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v, h)
    return h


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def long(x):
    return (x & MASK).to_bytes(8, "little")


def digits(text):
    """The fingerprint of a text by loops."""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    if not words:
        return ""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    shingles = [chained(map(long, h[i : i + 5])) for i in range(max(1, len(h) - 4))]
    least = {}
    for x in sorted(signed(s) for s in shingles):
        least.setdefault(x >> 56, x)
    bins = [least[b] & 15 if b in least else None for b in range(-128, 128)]
    out = []
    for i in range(BINS):
        value, t = bins[i], 0
        while value is None and t < ATTEMPTS:
            value = bins[signed(chained([i.to_bytes(4, "little"), t.to_bytes(4, "little")])) % BINS]
            t += 1
        if value is None:
            value = min((signed(chained([i.to_bytes(4, "little"), j.to_bytes(4, "little"), ATTEMPTS.to_bytes(4, "little")])), b) for j, b in enumerate(bins) if b is not None)[1]
        out.append("%x" % value)
    return "".join(out)


def alike(a, b):
    if not a or not b:
        return float(a == b)
    return min(1.0, max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / BINS - 1 / 16) / (15 / 16)))


def test_fingerprints_by_loops(cases):
    rows = cases.where("length(coalesce(text, '')) < 60000").select("text", as_text(fingerprint(F.col("text"))).alias("f")).collect()
    assert all(r.f == digits(r.text or "") for r in rows)


def test_query_by_loops(spark, small):
    docs = sorted(((r.doc_id, r.text or "") for r in small.collect()), reverse=True)
    rows = {r.doc_id: r for r in op11_fingerprints(spark, SF).collect()}
    assert len(rows) == len(docs)
    for (i, text), (_, following) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r, f, e = rows[i], digits(text), digits(changed)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(changed.encode()).hexdigest(), f, e)
        assert abs(r.near_edited - alike(f, e)) < 1e-12 and abs(r.near_next - alike(f, digits(following))) < 1e-12


def test_estimates_are_unbiased_and_near(spark):
    """Texts of 400 words of which so many are shared: the mean error of 40 pairs is small, and so is each."""
    made, real = [], []
    for shared in (0, 100, 200, 300, 380):
        for t in range(40):
            a = [f"w{t}x{i}" for i in range(400)]
            b = a[:shared] + [f"v{t}x{i}" for i in range(400 - shared)]
            sets = [{tuple(x[i : i + 5]) for i in range(396)} for x in (a, b)]
            made.append((shared, " ".join(a), " ".join(b)))
            real.append(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    rows = spark.createDataFrame(made, "s int, a string, b string").select("s", likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("j")).collect()
    errors = [r.j - t for r, t in zip(rows, real, strict=True)]
    assert all(abs(e) < 0.15 for e in errors)
    for k in range(1, 5):
        assert abs(sum(errors[40 * k : 40 * k + 40]) / 40) < 0.02


def test_short_texts_spread_evenly(spark):
    """A text of few shingles fills all bins from the filled ones, and half of the shingles give half of the bins."""
    rows = [(f"a{i} b c d e f{i} g h i j", f"a{i} b c d e f{i} g h i j " + f"q{i} r s t u v") for i in range(60)]
    found = spark.createDataFrame(rows, "a string, b string").select(likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("j")).collect()
    assert abs(sum(r.j for r in found) / 60 - 6 / 12) < 0.06


def test_odd_rows(odd):
    rows = compared(odd).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r for r in fingerprinted(odd).collect()}
    assert {i for i, r in texts.items() if not r.fingerprint} == {0, 1, 2, 5}  # null, empty, spaces, lines
    assert texts[15].fingerprint == texts[16].fingerprint and texts[13].fingerprint != []
    same = [r for r in rows if r.doc_id == 5]
    assert len(same) == 3 and len({(bytes(r.edited_digest), r.near_next) for r in same}) == 1


def test_order_wraps_and_nulls_come_last(spark):
    docs = spark.createDataFrame([(7, "seven7"), (None, "null!!"), (9, "nine99"), (8, None)], "doc_id long, text string").withColumn("_a", F.lit(1)).withColumn("ahead", F.lit("x"))
    rows = {r.doc_id: r.ahead for r in edited(docs).collect()}
    assert rows == {9: "", 8: "", 7: "nul", None: "nin"}
    one = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    r = compared(one).first()
    assert (r.near_next, bytes(r.edited_digest)) == (1.0, hashlib.sha256(b"one one").digest())


def test_empty_table_and_plan(spark, small):
    assert compared(small.limit(0)).count() == 0
    plan = edited(small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
