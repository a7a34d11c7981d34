import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as c
from nearfield.llm import pii, quality_rules
from nearfield.llm.tables import table

from . import test_decontamination, test_jaccard_join, test_quality_rules
from .conftest import SF


def test_stages_against_brute_force(spark, small, odd):
    """Each stage judged on its own input, on the smallest tables and odd rows with clashing columns."""
    docs = small.selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars", "1 AS n_words", "2 AS _n", "'k' AS kept", "3 AS _items").union(odd.selectExpr("doc_id", "text", "lang", "source", "n_chars", "1", "2", "'k'", "3"))
    rules = quality_rules.fit(docs, table(spark, SF, "labels"))
    one = c.good_documents(spark, docs, SF)
    assert one.columns == docs.columns
    kept = {(r.doc_id, r.text) for r in one.collect()}
    for r in quality_rules.judged(docs, rules, ["doc_id", "text"]).collect():
        n, _, _, _, repeated, _ = test_quality_rules.brute(r.text)
        assert not (n < 50 or 100 * repeated > 50 * n) or (r.doc_id, r.text) not in kept
        assert r.kept == ((r.doc_id, r.text) in kept)

    two = c.one_of_each_group(spark, docs, SF)
    assert two.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]

    def sets(text):
        return test_jaccard_join.shingles(text, 5)

    left = [(r.doc_id, r.text) for r in two.collect()]
    assert len(set(left)) == len(left)
    texts = [sets(t) for _, t in left]
    for i, a in enumerate(texts):
        for b in texts[:i]:
            assert not a or not b or 100 * len(a & b) < 80 * len(a | b)
    for _, t in rows:  # what went has a like among all rows
        if t not in {x for _, x in left}:
            s = sets(t)
            assert any(100 * len(s & o) >= 80 * len(s | o) for o in (sets(x) for _, x in rows if x != t) if o)

    three = c.uncontaminated(spark, docs, SF)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert three.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in three.collect()], key=str) == sorted([r for r in rows if not test_decontamination.brute(r[1], items)[-1]], key=str)

    four = c.without_personal_data(spark, docs, SF)
    assert four.columns == docs.columns and four.count() == docs.count()
    assert not [r for r in four.collect() if re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]", r.text or "") or r.n_chars != (len(r.text) if r.text is not None else None)]

    five = c.token_ids(spark, docs, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(five) == len(rows) and all(r.decodes for r in five)
    known = {r.doc_id: r.ids for r in five}
    for d, t in rows[:50]:
        assert known[d] == library.encode(t or "", add_special_tokens=False).ids


def test_run(spark):
    out = c.run(spark, SF)
    assert 0 < out.count() < 200 and out.where("NOT decodes").isEmpty()


def test_empty(spark, small):
    docs = small.limit(0)
    for _, stage in c.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_planted_data_goes(spark):
    docs = spark.createDataFrame([(1, "x a@b.co y +1 (017) 555-7713, z", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.text for r in pii.masked(docs, None).collect()] == ["x [EMAIL] y [PHONE], z"]
