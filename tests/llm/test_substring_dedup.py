import hashlib
import random

from nearfield.llm import substring_dedup as s


def chunked(data, bits=5, smallest=8, largest=128):
    out, last, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(s.GEAR[b])) % (1 << 32)
        size = i + 1 - last
        if h >> (32 - bits) == 0 and size > largest:
            raise AssertionError
        if (h >> (32 - bits) == 0 and size >= smallest) or size == largest:
            out.append((last, i + 1))
            last = i + 1
    return out + [(last, len(data))] * (last < len(data))


def brute(rows, least=80):
    docs = sorted({(d is not None, d or 0, t or "") for d, t in rows})
    first, out = {}, {}
    order = [(d, t, t.encode()) for d, t in ((x[1] if x[0] else None, x[2]) for x in docs)]
    for d, t, data in order:
        for a, b in chunked(data):
            first.setdefault(data[a:b], (d, a))
    for d, t, data in order:
        spans = []
        for a, b in chunked(data):
            if first[data[a:b]] != (d, a):
                if spans and spans[-1][1] == a:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
        spans = [x for x in spans if x[1] - x[0] >= least]
        edges = [0, *(e for x in spans for e in x), len(data)]
        left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        out[d, t] = (len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(t or "")
    expected, found = brute(rows), s.deduplicated(df).collect()
    assert len(found) == len(rows)
    for r in found:
        assert any((r.n_bytes, r.n_removed, r.spans, r.kept_sha256) == expected[r.doc_id, t] for t in texts[r.doc_id])


def test_brute_force(spark, cases):
    check(spark, [(r.doc_id, r.text) for r in cases.collect()])


def test_passages_of_fifty_words_are_found_wherever_they_stand(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghijklmno") for _ in range(draw.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(55)) for _ in range(30)]
    rows = [(i, " ".join([word() for _ in range(draw.randrange(60))] + [passages[i // 4]] + [word() for _ in range(draw.randrange(60))])) for i in range(120)]
    clean = [(1000 + i, " ".join(word() for _ in range(150))) for i in range(50)]
    found = {r.doc_id: r for r in s.deduplicated(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    assert all(found[d].n_removed == 0 for d, _ in clean)
    assert all(found[d].n_removed == 0 for d, _ in rows if d % 4 == 0)
    assert sum(found[d].n_removed > 0 and found[d].copied_from == [d - d % 4] for d, _ in rows if d % 4) >= 89


def test_empty(spark):
    check(spark, [])
    check(spark, [(1, None), (2, "")])
