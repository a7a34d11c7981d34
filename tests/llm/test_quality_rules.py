import re
from collections import Counter

import numpy as np

from nearfield.llm import quality_rules as q

from .conftest import SF


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    marked = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), len(set(words))


def test_statistics_match_brute_force(cases):
    rows = q.statistics(cases, ["text"]).collect()
    assert len(rows) == cases.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_distinct_words) == brute(r.text)


def test_learned_rules_keep_clean_and_reject_bad(spark, small):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rules = q.fit(small, labels)
    assert rules
    both = q.judged(small, rules).join(labels, "doc_id").where("NOT base_failed").collect()
    good = [r.kept for r in both if r.quality == 1]
    assert np.mean(good) > 0.95


def test_empty_tables(spark, small):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert q.judged(small.limit(0), q.fit(small.limit(0), labels)).count() == 0
    assert q.fit(small, labels.limit(0)) == []
    assert q.judged(small, []).where("kept = base_failed").count() == 0


def test_columns_named_like_its_own(spark, small):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    plain = q.fit(small, labels)
    clashing = small.selectExpr("*", "'x' AS quality", "1 AS row", "2 AS n_words")
    assert q.fit(clashing.union(clashing), labels) == plain
    assert q.accepted(clashing, plain).columns == clashing.columns
