import hashlib
import random

import pytest

from nearfield.llm import suffix_dedup as s


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - length + 1):
            w = hashlib.blake2b(d[i : i + length], digest_size=16).digest()
            seen[w] = seen.get(w, 0) + 1
    out = []
    for d in data:
        spans = []
        for i in range(len(d) - length + 1):
            if seen[hashlib.blake2b(d[i : i + length], digest_size=16).digest()] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        edges = [0, *(e for x in spans for e in x), len(d)]
        left = b"".join(d[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        out.append((len(d), len(d) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return out


def check(spark, rows, plan=None):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sorted(((r.doc_id, (r.n_bytes, r.n_removed, r.spans, r.kept_sha256)) for r in s.deduplicated(df, plan).collect()), key=str)
    assert found == sorted(zip([d for d, _ in rows], brute([t for _, t in rows]), strict=True), key=str)


def passages(seed):
    """Passages around the length, shared whole or in part, next to each other, overlapping themselves, and in many texts."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randrange(2, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    pool = [some(draw.randrange(20, 90)) for _ in range(12)] + ["ab" * 130, "xyz" * 90, "q" * 230]
    rows = []
    for i in range(70):
        parts = []
        for _ in range(draw.randrange(5)):
            x = draw.choice(pool)
            a, b = sorted(draw.randrange(len(x) + 1) for _ in range(2))
            parts += [some(draw.randrange(0, 15)), x if draw.random() < 0.6 else x[a:b]]
        rows.append((i, " ".join(parts) + some(draw.randrange(12))))
    hot = some(60)
    return rows + [(100 + i, some(draw.randrange(25)) + " " + hot + " " + some(draw.randrange(25))) for i in range(40)] + rows[:3]


@pytest.mark.parametrize("plan", [None, s.Plan(most_held=4)], ids=["sorted", "digests by Spark"])
def test_brute_force_passages(spark, plan):
    check(spark, passages(2), plan)


def test_brute_force_tables(spark, cases):
    check(spark, [(r.doc_id, r.text) for r in cases.collect()])


def test_empty(spark):
    check(spark, [])
    check(spark, [(1, None), (None, ""), (3, "x" * 199)])
    check(spark, [(1, "x" * 200), (2, "x" * 200), (3, "y" * 201)])


def test_maximal_repeats_of_a_text():
    text = b"xabcdyabcdzabcqbcd"
    sa = sorted(range(len(text)), key=lambda i: text[i:])
    common = lambda a, b: next((k for k in range(len(text)) if max(a, b) + k >= len(text) or text[a + k] != text[b + k]), 0)
    lcp = [common(a, b) for a, b in zip(sa, sa[1:], strict=False)]
    left = [text[i - 1] if i else -1 for i in sa]
    found = sorted((text[sa[a] : sa[a] + n].decode(), sorted(sa[a : b + 1])) for a, b, n in s.maximal_repeats(lcp, left, 2))
    expected = {}
    for n in range(2, len(text)):
        for i in range(len(text) - n + 1):
            w = text[i : i + n]
            places = [j for j in range(len(text) - n + 1) if text[j : j + n] == w]
            if len(places) > 1 and len({text[j + n : j + n + 1] or j for j in places}) > 1 and len({text[j - 1] if j else -1 - j for j in places}) > 1:
                expected[w.decode()] = places
    assert found == sorted(expected.items())


def test_repeats_have_all_their_occurrences(spark):
    rows = passages(4)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, set()).add((t or "").encode())
    found = {}
    for r in s.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        found.setdefault((r.repeat, r.length), []).append((r.doc_id, r.start))
    assert found
    for (name, length), places in found.items():
        assert length >= 200 and len(places) > 1
        for d, start in places:
            assert any(hashlib.sha256(t[start : start + length]).hexdigest() == name for t in texts[d])
