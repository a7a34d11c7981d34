"""Quality rules: a decision list learned from labelled statistics, applied as Spark conditional expressions.

1. `statistics` computes countable properties of every whole text in one pass, without a shuffle.
2. `learn` does sequential covering on a bounded labelled sample: it grows a conjunction of
   thresholds by information gain on two thirds of the rows, prunes it on the rest, keeps it if it
   is precise there, removes the rows it covers, and goes on.
3. `verdict` turns the ordered rules into one CASE expression over the statistics.

Defined results: a null or empty text has no words and fails the base rules; a null or repeated
doc_id and repeated rows change nothing, as each row is judged by itself; an empty table gives an
empty result; without usable labels the list is empty and the base rules decide alone. Columns of
the input whose names clash with a statistic don't matter to `statistics`, which reads only the
columns to keep and the text; of a clash among those, the statistic stands. `accepted` returns all
columns of the input as they were.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .flat import NOT_SPACE, Fingerprints, column, mix, owners, runs_of, slices, totals, window_hashes, words
from .tables import packed, sampled, table, unpacked

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_lines", "n_chars_seen", "n_distinct_words"]
#: What rules may test, as (numerator, denominator) of the counts.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "repeats_per_word": ("n_repeat_words", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "upper_per_char": ("n_upper", "n_chars_seen"),
    "digits_per_char": ("n_digits", "n_chars_seen"),
    "marks_per_word": ("n_marks", "n_words"),
    "distinct_per_word": ("n_distinct_words", "n_words"),
    "words": ("n_words", None),
}
SYMBOLS, UPPER, DIGITS, MARKS, WHOLE = (np.array([chr(i) in s for i in range(256)]) for s in ("#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?:;\"'()[]{}", ""))
WHOLE = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def repeats(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of each item: 0 if its key is alone in its document, 1 if it is the first of several, 2 if a later one."""
    out = np.zeros(len(keys), np.int8)
    if len(keys):
        mixed = mix(keys ^ mix(doc))
        order = np.argsort(mixed, kind="stable")
        same = mixed[order][1:] == mixed[order][:-1]
        out[order[:-1][same]] = 1
        out[order[1:][same]] = 2
    return out


def count(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """COUNTS of each document of a slice."""
    starts, ends, first = words(data, offsets, NOT_SPACE)
    n_words, doc = np.diff(first), owners(first)
    prints = Fingerprints(data)
    hashes = mix(prints.of(starts, ends))
    at, of = runs_of(first, 3)
    twice = repeats(window_hashes(hashes, at, 3), of) > 0
    in_window = np.zeros(len(starts) + 3, bool)
    for i in range(3):
        in_window[at[twice] + i] = True
    # lines: cut at \n and at document ends
    breaks = np.flatnonzero(data == 10)
    line_starts = np.union1d(breaks + 1, offsets[:-1])
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data)) if len(line_starts) else line_starts
    line_ends = np.where((line_ends > 0) & (data[line_ends - 1] == 10), line_ends - 1, line_ends) if len(line_starts) else line_starts
    full = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    again = repeats(prints.of(line_starts, line_ends) ^ mix(line_ends - line_starts), line_doc) == 2
    n = len(offsets) - 1
    later = repeats(hashes, doc) == 2
    whole = WHOLE[data]
    return [
        n_words, totals(whole & NOT_SPACE[data], offsets), totals(SYMBOLS[data], offsets), np.bincount(line_doc[again], minlength=n), totals(in_window[: len(starts)], first),
        totals(UPPER[data], offsets), totals(DIGITS[data], offsets), totals(MARKS[data], offsets), np.bincount(line_doc, minlength=n), totals(whole, offsets), n_words - np.bincount(doc[later], minlength=n),
    ]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [count(data, offsets) for _, _, data, offsets in slices(column(batch, "text"))]
        counts = [np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for i in range(len(COUNTS))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, counts)], names=[*batch.schema.names, *COUNTS])


def statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """COUNTS of every row's whole text, beside the columns to keep (doc_id if not given). Reads only those and the text."""
    keep = ["doc_id"] if keep is None else keep
    keep = [c for c in keep if c not in COUNTS]
    read = docs.select(*dict.fromkeys([*keep, "text"]))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema)
    return read.mapInArrow(_counted, f"{types}, " + ", ".join(f"{c} long" for c in COUNTS)).select(*keep, *COUNTS)


@dataclasses.dataclass(frozen=True)
class Rule:
    """Rejects documents for which all tests (feature, is at least, threshold) hold."""

    tests: tuple[tuple[str, bool, float], ...]
    precision: float
    covered: int


def _features(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: counts[a] / np.maximum(counts[b], 1) if b else counts[a].astype(float) for k, (a, b) in RATIOS.items()}


def _holds(tests, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(np.logical_and, [(x[f] >= t) if up else (x[f] < t) for f, up, t in tests], np.ones(n, bool))


def _grown(x: dict[str, np.ndarray], bad: np.ndarray, most_tests: int):
    """Adds the test of greatest gain until only bad rows are covered."""
    tests, inside = [], np.ones(len(bad), bool)
    while len(tests) < most_tests and inside.any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), inside.sum()
        best = (1e-9, None)
        for f, v in x.items():
            for t in np.unique(np.quantile(v[inside], np.linspace(0, 1, 65)[1:])):
                for up in (True, False):
                    new = inside & ((v >= t) if up else (v < t))
                    if p := bad[new].sum():
                        gain = p * (np.log2(p / new.sum()) - np.log2(p0 / n0))
                        best = max(best, (gain, (f, up, float(t))), key=lambda b: b[0])
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= _holds(tests[-1:], x, len(bad))
    return tests


def learn(counts: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.97, least: int = 4, most_rules: int = 12, most_tests: int = 4, seed: int = 7) -> list[Rule]:
    """Ordered rejecting rules by sequential covering; those below the precision, on all rows they cover, aren't kept."""
    x, rules = _features(counts), []
    left = np.ones(len(bad), bool)
    draw = np.random.default_rng(seed)
    while len(rules) < most_rules and bad[left].sum() >= least:
        grow = left & (draw.random(len(bad)) < 2 / 3)
        prune = left & ~grow
        tests = _grown({k: v[grow] for k, v in x.items()}, bad[grow], most_tests)
        held = {k: v[prune] for k, v in x.items()}

        def worth(tests):
            on = _holds(tests, held, prune.sum())
            return (2 * bad[prune][on].sum() - on.sum()) / max(1, on.sum()), bad[prune][on].sum()  # noqa: B023

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests = tests[:-1]
        on = left & _holds(tests, x, len(bad)) if tests else np.zeros(len(bad), bool)
        if on.sum() < least or bad[on].mean() < precision:
            break
        rules.append(Rule(tuple(tests), float(bad[on].mean()), int(on.sum())))
        left &= ~on
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True if the first rule that applies doesn't reject: CASE WHEN <rule 1> THEN false WHEN ... ELSE true."""
    value = {k: F.col(a) / F.greatest(F.col(b), F.lit(1)) if b else F.col(a).cast("double") for k, (a, b) in RATIOS.items()}
    out = None
    for rule in rules:
        tests = reduce(lambda a, b: a & b, [(value[f] >= t) if up else (value[f] < t) for f, up, t in rule.tests])
        out = F.when(tests, False) if out is None else out.when(tests, False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 4000, **options) -> list[Rule]:
    """Rules from at most `most_labelled` documents with a quality label, chosen by a hash of their identifiers.

    The bound makes the chosen identifiers small enough to broadcast and the statistics to learn on the driver. Of the
    rows of one doc_id, the one of the least statistics counts.
    """
    chosen = sampled(labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", most_labelled)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    least = statistics(known, ["doc_id", "quality"]).groupBy("doc_id").agg(F.min(F.struct("quality", *COUNTS)).alias("row"))
    rows = least.orderBy("doc_id").select("row.*").collect()
    if not rows:
        return []
    counts = {c: np.array([r[c] for r in rows], np.int64) for c in COUNTS}
    failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
    bad = np.array([r["quality"] == 0 for r in rows])
    return learn({k: v[~failed] for k, v in counts.items()}, bad[~failed], **options)


def judged(docs: DataFrame, rules: list[Rule], keep: list[str] | None = None) -> DataFrame:
    """The columns to keep, COUNTS, base_failed and kept of every row."""
    return statistics(docs, keep).withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict(rules)))


def accepted(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows that the rules keep, with the columns they came with."""
    return unpacked(judged(packed(docs), rules, ["_row", "text"]).where("kept"), docs)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judged(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
