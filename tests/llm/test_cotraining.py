import numpy as np

from nearfield.llm import cotraining as c

from .conftest import SF


def test_held_out_accuracy_and_use_of_both_views(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("pmod(xxhash64(doc_id), 5) = 0")
    model = c.fit(docs, labels.subtract(held), most_labelled=1500, most_unlabelled=1500)
    assert sum(model.rounds) > 100
    rows = c.scored(docs.join(held, "doc_id", "left_semi"), model).join(held, "doc_id").collect()
    right = np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows])
    assert right > 0.95
    assert np.mean([r.score >= 0.5 for r in rows if r.quality == 1]) > 0.97
    # calibrated: mean score near the share of good ones
    assert abs(np.mean([r.score for r in rows]) - np.mean([r.quality for r in rows])) < 0.05


def test_fast_scores_equal_matrix_scores(cases):
    draw = np.random.default_rng(1)
    model = c.Model(draw.normal(size=c.PAIRS + c.WORDS + c.SHAPES + 1), draw.normal(size=c.META + 1), (np.array([1.1, 0.1]), np.array([0.9, -0.2])), np.array([0.5, 0.6, 0.1]))
    rows = c.scored(cases, model, ["text", "lang", "source", "n_chars"]).collect()
    assert len(rows) == cases.count()
    for r in rows:
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        x = c.text_features(data, np.array([0, len(data)]))
        m = np.zeros((1, c.META))
        m[0, c.meta_slots(r.lang, r.source)] = 1
        views = [c.logit(k, v[:, None]) for k, v in zip(model.calibration, (c.logit(model.text, x), c.logit(model.meta, m)), strict=True)]
        assert abs(1 / (1 + np.exp(-c.logit(model.combined, np.stack(views, axis=1))[0])) - r.score) < 1e-6


def test_empty_and_odd(spark, odd, small):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert {r.score for r in c.scored(odd, c.fit(odd, labels.limit(0))).collect()} == {0.5}
    assert c.scored(small.limit(0), c.fit(small.limit(0), labels)).count() == 0
    assert c.scored(odd.select("doc_id", "text"), c.fit(small, labels)).count() == odd.count()
