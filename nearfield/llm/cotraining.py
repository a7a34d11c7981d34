"""Quality classifier by co-training of two views of a document.

The text view sees the text: frequencies of its words, hashed, of pairs of character classes, and
repetitions. The metadata view sees lang and source only. Both are logistic regressions. First either view is
fitted on labelled rows alone, and all documents are scored by both. Those of which a view is surest, at either end, are
the pool of the rounds: in each, either view marks the documents of the pool that it is surest of, in the proportion of
the labels, and these pseudo-labels join the other view's training rows. Then each view is calibrated
on labelled rows that neither has seen, and a logistic regression of the calibrated log-odds combines
them. All documents are scored by that in one pass without a shuffle.

The driver fits on at most `most_labelled` labelled documents, chosen by a hash of doc_id, and as many of the pool as
`most_unlabelled` says; both passes of scoring cover every row and whole texts. Of rows that repeat a doc_id, the one
of the least text is fitted.

Defined results: null and empty texts, and null metadata, are values like any others; rows are scored
one by one, so repeated rows and null identifiers are fine; without labels of both kinds every score
is the share of good labels, or 0.5 without any; empty tables give empty results; columns besides
doc_id, text, lang and source aren't read, and those of the last two that lack are null.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .flat import ALNUM, LOWER, U64, Fingerprints, column, mix, slices, totals, words
from .quality_rules import count
from .tables import durable, sampled, table

#: Character classes of the text view, by what bytes they hold; others are class 0.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:", "!", "?", "#$%&*", "|<>", "'\"`", "()[]{}", "-_=+~", "/\\@^"]
CLASS = np.zeros(256, np.int64)
for _i, _bytes in enumerate(CLASSES):
    CLASS[[ord(c) for c in _bytes]] = _i + 1
CLASS[128:] = 15
PAIRS = 256
WORDS = 256
SHAPES = 6
META = 256


def shapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lengths and repetitions of each text, as SHAPES columns of small numbers."""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat, n_upper, n_digits, n_marks, n_lines, n_chars, n_distinct = (np.asarray(x, float) for x in count(data, offsets))
    some = np.maximum(n_words, 1)
    return np.stack([np.log1p(n_words) / 5, word_chars / some / 10, n_repeat / some, n_distinct / some, n_dup_lines / np.maximum(n_lines, 1), n_symbols / some], axis=1)


def pair_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class pair that begins at each byte, and which of them lie in one text."""
    kinds = CLASS[data]
    codes = np.zeros(len(data), np.int64)
    codes[:-1] = kinds[:-1] * 16 + kinds[1:]
    inside = np.ones(len(data), bool)
    inside[offsets[1:][offsets[1:] > 0] - 1] = False
    return codes, inside


def word_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each word, A-Z lowered, and where each text's words begin."""
    lowered = LOWER[data]
    starts, ends, first = words(lowered, offsets, ALNUM)
    return (mix(Fingerprints(lowered).of(starts, ends)) % U64(WORDS)).astype(np.int64), first


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    codes, inside = pair_codes(data, offsets)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))[inside]
    pairs = np.bincount(doc * PAIRS + codes[inside], minlength=n * PAIRS).reshape(n, PAIRS) / np.maximum(1, np.bincount(doc, minlength=n))[:, None]
    slots, first = word_slots(data, offsets)
    counts = np.bincount(np.repeat(np.arange(n), np.diff(first)) * WORDS + slots, minlength=n * WORDS).reshape(n, WORDS) / np.maximum(1, np.diff(first))[:, None]
    return np.hstack([10 * pairs, 10 * counts, shapes(data, offsets)])


def meta_slots(lang: str | None, source: str | None) -> list[int]:
    """The features of the metadata view that a document has: three of META."""
    return [zlib.crc32(f"{name}={value}".encode()) % META for name, value in (("lang", lang), ("source", source), ("both", f"{lang}/{source}"))]


def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.ones(len(y)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return w


def logit(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


@dataclasses.dataclass(frozen=True)
class Model:
    text: np.ndarray
    meta: np.ndarray
    calibration: tuple[np.ndarray, np.ndarray]
    combined: np.ndarray
    rounds: tuple[int, ...] = ()


def constant(share: float) -> Model:
    """The model that gives every document the same score."""
    one = np.array([0.0, 0.0, np.log(share / (1 - share))])
    return Model(np.zeros(PAIRS + WORDS + SHAPES + 1), np.zeros(META + 1), (np.zeros(2), np.zeros(2)), one)


def cotrained(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = 5, share: float = 0.05) -> Model:
    """Two views trained on two thirds of the labelled rows and each other's confident pseudo-labels of the pool."""
    train = np.arange(len(y)) % 3 != 0
    good = float(np.mean(y[train])) if train.any() else 0.5
    if not train.any() or good in (0.0, 1.0) or len(set(y[~train])) < 2:
        return constant(min(max(float(np.mean(y)) if len(y) else 0.5, 1e-3), 1 - 1e-3))
    views, pools = [text[train], meta[train]], [pool_text, pool_meta]
    labels = [np.full(len(pool_text), -1.0) for _ in views]  # what the other view says of the pool
    added = []

    def fit(v: int) -> np.ndarray:
        known = labels[v] >= 0
        return regression(np.vstack([views[v], pools[v][known]]), np.concatenate([y[train], labels[v][known]]), np.concatenate([np.ones(train.sum()), np.full(known.sum(), 0.5)]))

    models = [fit(0), fit(1)]
    for _ in range(rounds if len(pool_text) else 0):
        fresh = 0
        for v in (0, 1):
            score = logit(models[v], pools[v])
            open_ = np.flatnonzero(labels[1 - v] < 0)
            order = open_[np.argsort(score[open_], kind="stable")]
            take = max(1, int(share * len(score)))
            low, high = order[: max(1, int(take * (1 - good)))], order[len(order) - max(1, int(take * good)) :]
            low, high = low[score[low] < -1], high[score[high] > 1]  # only what it is sure of
            labels[1 - v][low], labels[1 - v][high] = 0, 1
            fresh += len(low) + len(high)
        added.append(fresh)
        if not fresh:
            break
        models = [fit(0), fit(1)]
    held = [logit(m, x[~train]) for m, x in zip(models, (text, meta), strict=True)]
    calibration = tuple(regression(h[:, None], y[~train], ridge=1e-2) for h in held)
    both = np.stack([logit(c, h[:, None]) for c, h in zip(calibration, held, strict=True)], axis=1)
    return Model(models[0], models[1], calibration, regression(both, y[~train], ridge=1.0), tuple(added))


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in slices(column(batch, "text")):
            x = text_features(data, offsets).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(column(batch, c)[first:end] for c in ("place", "quality", "lang", "source")), lists], names=["place", "quality", "lang", "source", "x"])


def with_metadata(docs: DataFrame, *more: str) -> DataFrame:
    have = {"lang": "string", "source": "string"}
    return docs.select(*more, "text", *((F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in have.items()))


def _gathered(docs: DataFrame, chosen: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text features, metadata features, quality) of the chosen documents (doc_id, quality), in an order of their own; a row a doc_id."""
    rows = with_metadata(docs, "doc_id").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "quality")).alias("row"))
    read = rows.select(F.xxhash64(F.lit(11), "doc_id").alias("place"), "row.*")
    found = read.select("place", "quality", "text", "lang", "source").mapInArrow(_wide, "place long, quality int, lang string, source string, x array<float>").orderBy("place").toArrow()
    n, width = len(found), PAIRS + WORDS + SHAPES
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(n, width).astype(float) if n else np.zeros((0, width))
    meta = np.zeros((n, META))
    for i, row in enumerate(zip(*(found.column(c).to_pylist() for c in ("lang", "source")), strict=True)):
        meta[i, meta_slots(*row)] = 1
    return x, meta, found.column("quality").to_numpy()


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 3000, most_unlabelled: int = 3000, **options) -> Model:
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    x, meta, quality = _gathered(docs, sampled(known, "doc_id", most_labelled).select("doc_id", "quality"))
    y = (quality > 0).astype(float)
    none = np.zeros((0, x.shape[1])), np.zeros((0, META))
    first = cotrained(x, meta, y, *none)
    if not first.text.any():
        return first
    views = durable(scored(docs.where("doc_id IS NOT NULL"), first).select("doc_id", "p_text", "p_meta").join(known, "doc_id", "left_anti"))
    ends = [views.orderBy(F.col(p) if low else F.col(p).desc(), F.xxhash64("doc_id"), "doc_id").limit(most_unlabelled // 4).select("doc_id") for p in ("p_text", "p_meta") for low in (True, False)]
    pool = _gathered(docs, reduce(DataFrame.union, ends).distinct().withColumn("quality", F.lit(-1)))
    return cotrained(x, meta, y, *pool[:2], **options)


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (doc_id if not given), p_text and p_meta (calibrated views) and score, the probability of good quality, of every row."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        slots: dict = {}
        for batch in batches:
            meta_columns = [column(batch, c).to_pylist() for c in ("lang", "source")]
            for first, end, data, offsets in slices(column(batch, "text")):
                codes, inside = pair_codes(data, offsets)
                pairs = totals(inside, offsets)
                sums = np.append(0.0, np.cumsum(np.where(inside, m.text[codes], 0.0)))
                by_pairs = 10 * (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(pairs, 1)
                in_words, first_word = word_slots(data, offsets)
                sums = np.append(0.0, np.cumsum(m.text[PAIRS + in_words]))
                by_words = 10 * (sums[first_word[1:]] - sums[first_word[:-1]]) / np.maximum(np.diff(first_word), 1)
                text = np.clip(by_pairs + by_words + shapes(data, offsets) @ m.text[PAIRS + WORDS : -1] + m.text[-1], -30, 30)
                meta = np.empty(end - first)
                for i, row in enumerate(zip(*(c[first:end] for c in meta_columns), strict=True)):
                    if row not in slots:
                        if len(slots) > 100_000:
                            slots.clear()
                        slots[row] = m.meta[sorted(set(meta_slots(*row)))].sum() + m.meta[-1]
                    meta[i] = slots[row]
                views = [logit(c, v[:, None]) for c, v in zip(m.calibration, (text, np.clip(meta, -30, 30)), strict=True)]
                both = logit(m.combined, np.stack(views, axis=1))
                columns = [pa.array(np.round(1 / (1 + np.exp(-v)), 9)) for v in (*views, both)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[first:end] for i in range(len(keep))), *columns], names=[*keep, "p_text", "p_meta", "score"])

    read = with_metadata(docs, *(F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep)))
    types = [docs.schema[c].dataType.simpleString() for c in keep]
    return read.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in zip(keep, types, strict=True)), "p_text double, p_meta double, score double"]))


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels"))).withColumn("good", F.col("score") >= 0.5)
