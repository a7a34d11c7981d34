import hashlib
import re

from pyspark.sql import functions as F

from nearfield.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, x):
    d = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if good(k, m[0])] for k, p in PLAIN.items()}


MORE = [
    "a@b.c_d@e.f x@y", "a@b@c.d", "..@-.-.", "u.v%+-@h-1.co.uk. next a@b.", "1.2.3.4.5.6.7.8.9", "999.1.1.1.5.6.7.8 001.002.003.0255 1.2.3.4", "é 💥 4111 1111 1111 1111 é", "4111-1111-1111-1111-1", "41111111111111111111111111", "0000 0000 0000 00", "+1 (017) 555-7713.", "+1+12345678901234567890 +44 20 7946 0958 +1 2",
    "1" * 5000, "a" * 5000 + "@b.c", "a@" * 2000, "1.2." * 2000, "john (at) example (dot) com 5.6[.]7.8", "(555) 123-4567 555.123.4567890",
]


def test_base_spans_match_plain_patterns(spark, cases):
    docs = cases.select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(MORE)], "doc_id long, text string"))
    model = pii.fit(docs)
    rows = pii.found(docs, model).select("*", pii._joined(pii._all_spans(False)).alias("base"), pii._joined(pii._all_spans(True)).alias("spans")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        expected = brute(r.text)
        for k in pii.KINDS:
            assert [(s.start, s.end) for s in r[f"_base_{k}"]] == expected[k], (k, r.text)
        spans = sorted((a, pii.KINDS.index(k), b, k) for k in pii.KINDS for a, b in expected[k])
        assert r.base == ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert set(filter(None, r.base.split(","))) <= set(filter(None, r.spans.split(",")))


def test_query_digests(spark):
    from .conftest import SF

    rows = pii.op8_pii(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        expected = brute(texts[r.doc_id])
        spans = sorted((a, pii.KINDS.index(k), b, k) for k in pii.KINDS for a, b in expected[k])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(expected[k]) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()


def test_redacted(spark):
    docs = spark.createDataFrame([(1, "x a@b.co y 10.0.0.1, z"), (2, None), (3, "")], "doc_id long, text string")
    rows = pii.found(docs, None).select("doc_id", pii.redacted().alias("t")).orderBy("doc_id").collect()
    assert [r.t for r in rows] == ["x [EMAIL] y [IP], z", None, ""]


def test_trees_as_expression_equal_trees(spark, small):
    tree = ("a", 1.0, ("b", 2.0, 0.5, -0.5), 3.0)
    import numpy as np

    x = {"a": np.array([0.0, 0.5, 2.0]), "b": np.array([1.0, 5.0, 0.0])}
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x["a"], x["b"], strict=True)], "a double, b double")
    assert [r.v for r in df.select(pii._expression(tree, {"a": F.col("a"), "b": F.col("b")}).alias("v")).collect()] == pii._value(tree, x, 3).tolist()


def test_empty(small):
    assert pii.fit(small.limit(0)) is None
    assert pii.found(small.limit(0), None).count() == 0


def test_wide_forms_are_added_and_look_alikes_are_not(spark):
    """Values and most contexts are not those of the labelled table."""
    planted = [
        ("You can call (212) 867-5309 after nine", "phone", "(212) 867-5309"), ("her phone is 415-867-5310 at home", "phone", "415-867-5310"), ("tel 303.867.5311 or", "phone", "303.867.5311"),
        ("é 💥 send it to mary.k (at) firma (dot) org please", "email", "mary.k (at) firma (dot) org"), ("ask tim[at]house[dot]net", "email", "tim[at]house[dot]net"),
        ("traffic came from 203[.]0[.]113[.]9 all night", "ip", "203[.]0[.]113[.]9"), ("she gave card 4242.4242.4242.4242 then", "card", "4242.4242.4242.4242"),
    ]
    alike = ["isbn 978-0-306-40615-7", "order 212-867-5309 has left", "built 2022-08-09 11:45", "version 4[.]2[.]1[.]9", "the card 4242.4242.4242.4243 is none", "at 999[.]1[.]1[.]1 nothing", "we all met @ seven. then", "took 1650000000 steps", "points 1 . 3 . 5 . 7", "serial 4242.4242.4242.4242"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([p[0] for p in planted] + alike)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.found(docs, pii.fit(docs)).collect()}
    for i, (text, kind, value) in enumerate(planted):
        assert [(s.kind, text[s.start : s.end]) for s in rows[i]._added] == [(kind, value)], text
    for i, text in enumerate(alike, len(planted)):
        assert not rows[i]._added, text
