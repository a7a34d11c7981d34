import zlib

import numpy as np

from nearfield.llm import language_id as g


def test_held_out_accuracy_on_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = g.predicted(docs, g.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(found) == docs.count()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95


def test_never_learns_from_held_out_documents(spark, small):
    a = g.learn(small)
    b = g.learn(small.selectExpr("doc_id", "IF(crc32(string(doc_id)) % 3 = 1, 'zz', lang) AS lang", "IF(crc32(string(doc_id)) % 3 = 1, 'zzzz', text) AS text"))
    assert a.languages == b.languages and (a.masks == b.masks).all()


def test_counts_match_brute_force(small):
    filters = g.learn(small)
    text = "Élan the of, und\nx  1 y"
    data = np.frombuffer(text.encode(), np.uint8)
    share = g.shares(filters, np.concatenate([data, data[:0], data]), np.array([0, len(data), len(data), 2 * len(data)]))
    padded = b" " + "élan the of  und x    y".encode() + b" "
    hits, seen = np.zeros(len(filters.languages)), 0
    for size in g.SIZES:
        for i in range(len(padded) - size + 1):
            gram = padded[i : i + size]
            if b"  " not in gram:
                seen += 1
                a, b = g.slots_of(g.mix(np.array([int.from_bytes(gram, "little")])), 20)
                both = int(filters.masks[0][a[0]] & filters.masks[0][b[0]])
                hits += [both >> j & 1 for j in range(len(hits))]
    expected = np.clip((hits / seen - filters.false_rate) / (1 - filters.false_rate), 0, 1)
    assert np.allclose(share[:, 0], expected) and np.allclose(share[:, 2], expected) and not share[:, 1].any()


def test_odd_texts_and_empty_tables(odd, small):
    rows = g.predicted(odd, g.learn(small)).join(odd.select("doc_id", "text").distinct(), "doc_id").collect()
    for r in rows:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
    assert g.predicted(odd, g.learn(odd)).count() == odd.count()
    nothing = g.learn(small.limit(0))
    assert {r.lang_pred for r in g.predicted(odd, nothing).collect()} == {"und"}
    assert g.predicted(small.limit(0), nothing).count() == 0
