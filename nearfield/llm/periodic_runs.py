"""Periodic runs of words in a text: maximal stretches that repeat a period, and texts with each run cut to its first period.

A run of smallest period q has at least max(least_words, repeats * q) words, so from its first word on, words q apart agree
over at least `k` = min over q of (least length - q) words: every word of a run lies in a k-gram that occurs again in the
document. A first pass hashes k-grams and drops the words outside repeated ones; a clash of hashes lets more through and
loses nothing. The surviving segments of many documents, apart from each other, are one flat array of word numbers on which
Main and Lorentz's divide and conquer runs level by level: for every middle and every shift the common extensions to both
sides are found at once, exactly, by numbers of equal stretches of 2, 4, 8, ... words. A stretch that several
shifts find has the least of them as its period.

Work is in line with n log n of the survivors, in Arrow batches without a shuffle; a slice of about half a megabyte (one document
at least) bounds memory.

Defined results: null or no words gives no runs and an empty collapsed text; words are `[^\\x20\\x09-\\x0D]+`, compared exactly;
repeated rows give repeated results; an empty table gives an empty one; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .flat import mix, owners
from .tables import table

LEAST_WORDS = 24
REPEATS = 3
SLICE_CHARS = 1 << 19


def least_overlap(least_words: int, repeats: int) -> int:
    """The fewest words over which a run agrees with itself a period later."""
    return min(max(least_words, repeats * q) - q for q in range(1, least_words + 1))


def repeated_words(ids: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Whether each word lies in a k-gram that its document has twice or more; ids of the words of all documents, first their first indices."""
    n = len(ids)
    out = np.zeros(n, bool)
    if n < k:
        return out
    doc = owners(first)
    at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    hashes, size = mix(ids.astype(np.uint64)), 1
    while size < k:
        step = min(size, k - size)  # overlapping halves where k is no power of two
        hashes = mix(hashes[: len(hashes) - step] ^ mix(hashes[step:] + np.uint64(size)))
        size += step
    keys = mix(hashes[at] ^ mix(doc[at].astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at[again], 1)
    np.add.at(steps, at[again] + k, -1)
    return np.cumsum(steps[:-1]) > 0


class Stretches:
    """Numbers of equal stretches of 1, 2, 4, ... words of an array; with them, common extensions of pairs of places."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.names = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
        while (2 << (len(self.names) - 1)) <= longest:
            size, last = 1 << (len(self.names) - 1), self.names[-1]
            pairs = last[:-size] * (int(last.max()) + 1) + last[size:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))

    def ahead(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words agree from places a and b on, b the later, at most limit."""
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            fits = np.flatnonzero(out + (1 << j) <= limit)
            x, y = a[fits] + out[fits], b[fits] + out[fits]
            fits = fits[self.names[j][x] == self.names[j][y]]
            out[fits] += 1 << j
        return out

    def behind(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words agree before places a and b, those not included."""
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            fits = np.flatnonzero(out + (1 << j) <= limit)
            x, y = a[fits] - out[fits] - (1 << j), b[fits] - out[fits] - (1 << j)
            fits = fits[self.names[j][x] == self.names[j][y]]
            out[fits] += 1 << j
        return out


def main_lorentz(ids: np.ndarray, segments: np.ndarray, least_words: int, repeats: int) -> np.ndarray:
    """(start, end, period) of all runs in the segments (start, end) of ids, which aren't compared with each other.

    A run that crosses the middle of a block of its segment, and lies within the block, has a whole period on one side of it: the place
    of the middle and the one a period before or after it agree over all of the run but one period.
    """
    found = []
    names = Stretches(ids, int((segments[:, 1] - segments[:, 0]).max())) if len(segments) else None
    blocks = np.column_stack([segments, segments])  # begin and end of the block, of the segment
    while len(blocks := blocks[blocks[:, 1] - blocks[:, 0] >= least_words]):
        middle = (blocks[:, 0] + blocks[:, 1]) // 2
        for side in (1, -1):
            room = (blocks[:, 1] - middle if side > 0 else middle - blocks[:, 0]).astype(np.int64)
            room = np.minimum(room, (blocks[:, 1] - blocks[:, 0]) // repeats)  # longer periods can't lie in the block often enough
            own = np.repeat(np.arange(len(blocks)), room)
            shift = np.arange(len(own)) - np.repeat(np.cumsum(room) - room, room) + 1
            a = middle[own] if side > 0 else middle[own] - shift
            b = a + shift
            low, high = blocks[own, 2], blocks[own, 3]
            right = names.ahead(a, b, high - b)
            left = names.behind(a, b, a - low)
            good = left + right + shift >= np.maximum(least_words, repeats * shift)
            found.append(np.column_stack([a - left, b + right, shift])[good])
        halves = [np.column_stack([blocks[:, 0], middle, blocks[:, 2:]]), np.column_stack([middle, blocks[:, 1], blocks[:, 2:]])]
        blocks = np.concatenate(halves)
    out = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:, :2] != out[:-1, :2]).any(1)  # the least period of a stretch comes first
    return out[fresh]


def runs_of(words: list[list[bytes]], least_words: int = LEAST_WORDS, repeats: int = REPEATS) -> list[np.ndarray]:
    """(start, length, period) of the runs of each list of words, by start and period."""
    first = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=first[1:])
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for own in words for w in own), np.int64, int(first[-1]))
    inside = repeated_words(ids, first, least_overlap(least_words, repeats))
    doc = owners(first)
    edge = np.ones(len(ids) + 1, bool)  # a change of document or of survival
    if len(ids):
        edge[1:-1] = (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])
    cuts = np.flatnonzero(edge)
    segments = np.column_stack([cuts[:-1], cuts[1:]]) if len(ids) else np.zeros((0, 2), np.int64)
    segments = segments[inside[segments[:, 0]] & (segments[:, 1] - segments[:, 0] >= least_words)] if len(segments) else segments
    if not len(segments):
        return [np.zeros((0, 3), np.int64)] * len(words)
    sizes = segments[:, 1] - segments[:, 0]
    ends = np.cumsum(sizes)
    close = np.column_stack([ends - sizes, ends])  # the survivors alone
    places = np.arange(ends[-1]) + np.repeat(segments[:, 0] - close[:, 0], sizes)
    runs = main_lorentz(ids[places], close, least_words, repeats)
    start = places[runs[:, 0]]
    own = doc[start]
    runs = np.column_stack([start - first[own], runs[:, 1] - runs[:, 0], runs[:, 2]])
    order = np.lexsort((runs[:, 2], runs[:, 0], own))
    return np.split(runs[order], np.searchsorted(own[order], np.arange(1, len(words))))


def _dropped(n: int, runs: np.ndarray) -> np.ndarray:
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0


def _run(least_words: int, repeats: int):
    triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def some(ids: list, texts: list[str | None]) -> pa.RecordBatch:
        words = [(t or "").encode().split() for t in texts]  # on the same bytes as the word pattern
        runs = runs_of(words, least_words, repeats)
        kept = [own if not len(r) else [own[i] for i in np.flatnonzero(~_dropped(len(own), r))] for own, r in zip(words, runs, strict=True)]
        flat = np.concatenate(runs)
        at = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(triple)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), lists, pa.array([b" ".join(k).decode() for k in kept])], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for i in range(batch.num_rows):
                ids.append(batch.column(0)[i].as_py())
                texts.append(batch.column(1)[i].as_py())
                size += len(texts[-1] or "")
                if size >= SLICE_CHARS:
                    yield some(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield some(ids, texts)

    return run


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, repeats: int = REPEATS) -> DataFrame:
    """doc_id, n_words, runs (start, length and period of each, in words) and collapsed, the words outside of runs' repetitions joined by a space."""
    if least_words < 1 or repeats < 2:
        raise ValueError("least_words must be 1 or more, repeats 2 or more")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_run(least_words, repeats), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def most_repeated(runs: Column) -> Column:
    """The run of the greatest length a period; of equal ones the first, then that of the least period. Null without runs."""
    more = lambda x, y: (y["length"] * x["period"] > x["length"] * y["period"]) | ((y["length"] * x["period"] == x["length"] * y["period"]) & (F.struct(y["start"], y["period"]) < F.struct(x["start"], x["period"])))
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(more(best, r), r).otherwise(best))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the documents with their words from a place on repeated periodically, all by a hash of doc_id: a fixture of known runs."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def periodic(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        at = lambda i: F.when(i >= a, a + F.pmod(i - a, p)).otherwise(i)
        return F.array_join(F.transform(words, lambda _, i: F.get(words, at(i).cast("int"))), " ")

    plain = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    made = F.transform(F.array(plain), lambda w: F.when(F.size(w) > 0, periodic(w)).otherwise(""))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, made).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(with_periods(table(spark, sf_dir, "documents"))).withColumn("best", most_repeated(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")), F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
