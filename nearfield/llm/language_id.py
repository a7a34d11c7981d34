"""Language identification by n-gram Bloom filters that answer for all languages at once.

Every slot of one table holds a bitmask with a bit for each language (the languages' Bloom filters,
sliced by bit). ANDing the slots of an n-gram gives all languages whose filter contains it; the set
bits are counted by language over the whole text, each count is corrected for that filter's rate of
false positives, and the language with the largest share of the n-grams wins.

n-grams are 3 to 5 bytes of the lower-cased letters with word boundaries. The filters hold n-grams
that at least a share of a language's sampled documents contain. The sample is bounded
(`most_documents` of each language, those of the least hashes of doc_id) and the table has a fixed size.

Defined results: null texts and texts without letters are `und` with score 0, as is everything when
nothing could be learned; ties go to the first language in order; a null doc_id isn't held out and
isn't learned from; repeated rows are judged alike; only doc_id, text and lang are read.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .flat import column, mix, slices, totals
from .tables import durable, table

SIZES = (3, 4, 5)
#: Bytes as n-grams see them: letters lowered, anything else in ASCII a space. Spark lowers all other letters before.
SEEN = np.array([i if 97 <= i <= 122 or i > 127 else i + 32 if 65 <= i <= 90 else 32 for i in range(256)], np.uint8)
LETTER = np.array([65 <= i <= 90 or 97 <= i <= 122 for i in range(256)])


@dataclasses.dataclass(frozen=True)
class Filters:
    languages: list[str]
    masks: np.ndarray  # words x slots, a bit for each language
    false_rate: np.ndarray  # by language


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: (n-grams as integers, which of them count, offsets of the documents' first ones)."""
    n_docs = len(offsets) - 1
    seen = SEEN[data]
    upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    seen[upper] += 32  # capital letters of Latin-1 in UTF-8
    flat = np.full(len(data) + n_docs + max(SIZES), 32, np.uint8)
    flat[np.arange(len(data)) + np.repeat(np.arange(1, n_docs + 1), np.diff(offsets))] = seen
    at = offsets + np.arange(n_docs + 1)  # of the space before each document
    n = at[-1]
    last = np.repeat(at[1:], np.diff(at))  # of the space after each document
    wide = flat.astype(np.uint64)
    blank = flat == 32
    double = blank[:-1] & blank[1:]
    packed, bad = wide[:n].copy(), np.zeros(n, bool)
    for size in range(2, max(SIZES) + 1):
        packed |= wide[size - 1 : size - 1 + n] << np.uint64(8 * (size - 1))
        bad |= double[size - 2 : size - 2 + n]
        if size in SIZES:
            yield packed, ~bad & (np.arange(n) + size - 1 <= last), at


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language number, mixed n-gram) once for each document and n-gram."""
    for batch in batches:
        language = column(batch, "_language").to_numpy(zero_copy_only=False)
        for first, end, data, offsets in slices(column(batch, "text")):
            for packed, good, at in grams(data, offsets):
                doc = np.repeat(np.arange(end - first), np.diff(at))[good]
                keys = mix(packed[good])
                order = np.lexsort((keys, doc))
                doc, keys = doc[order], keys[order]
                once = np.append(True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]))[: len(keys)]
                yield pa.RecordBatch.from_arrays([pa.array(language[first:end][doc[once]], pa.int32()), pa.array(keys[once].astype(np.int64))], names=["language", "gram"])


def slots_of(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << bits) - 1)
    return (keys & low).astype(np.int64), ((keys >> np.uint64(32)) & low).astype(np.int64)


def learn(docs: DataFrame, most_documents: int = 600, least_share: float = 0.02, bits: int = 20) -> Filters:
    """Filters from at most `most_documents` documents of each language that aren't held out."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    spark = docs.sparkSession
    totals_ = known.groupBy("lang").agg(F.count("*").alias("n"))
    # hashes are spread evenly: those under a bound by language are about twice as many as needed, however many rows there are
    share = totals_.select("lang", F.least(F.lit(1.0), (2 * most_documents + 50) / F.col("n")).alias("share"))
    place = (F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / float(1 << 53)).alias("place")
    near = known.select("doc_id", "lang", place).join(F.broadcast(share), "lang").where("place < share OR share = 1").groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min("place").alias("place"))
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    chosen = durable(near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most_documents).select("doc_id", "lang"))
    counts = {r.lang: r.n for r in chosen.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    n_words = max(1, -(-len(languages) // 64))
    masks = np.zeros((n_words, 1 << bits), np.uint64)
    if languages:
        numbers = spark.createDataFrame([(x, i, max(2, int(np.ceil(least_share * counts[x])))) for i, x in enumerate(languages)], "lang string, _language int, least int")
        ids = chosen.join(F.broadcast(numbers), "lang").select("doc_id", "_language")
        found = known.select("doc_id", F.lower("text").alias("text")).join(F.broadcast(ids), "doc_id").select("_language", "text").mapInArrow(_distinct, "language int, gram long")
        often = found.groupBy("language", "gram").agg(F.count("*").alias("n")).join(F.broadcast(numbers), F.col("language") == F.col("_language")).where("n >= least")
        low = (1 << bits) - 1
        slots = often.select((F.col("language") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, language % 64)").alias("mask"), F.explode(F.array(F.col("gram").bitwiseAND(low), F.shiftrightunsigned("gram", 32).bitwiseAND(low))).alias("slot"))
        for r in slots.groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
            masks[r.word, r.slot] = np.uint64(r.mask % (1 << 64))
    fill = np.array([((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    if len(languages) <= 8:
        masks = masks.astype(np.uint8)
    return Filters(languages, masks, fill**2)


def shares(filters: Filters, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """By language and document: the corrected share of the text's n-grams that the language's filter contains."""
    n_docs = len(offsets) - 1
    hits, seen = np.zeros((len(filters.languages), n_docs)), np.zeros(n_docs)
    bits = filters.masks.shape[1].bit_length() - 1
    kind = filters.masks.dtype.type
    for packed, good, at in grams(data, offsets):
        first, second = slots_of(mix(packed), bits)
        seen += totals(good, at)
        for word in range(len(filters.masks)):
            both = filters.masks[word][first] & filters.masks[word][second]
            both[~good] = 0
            for i in range(64 * word, min(64 * word + 64, len(filters.languages))):
                hits[i] += totals((both >> kind(i % 64)) & kind(1), at)
    rate = filters.false_rate[:, None]
    return np.clip((hits / np.maximum(seen, 1) - rate) / np.maximum(1 - rate, 1e-9), 0, 1)


def predicted(docs: DataFrame, filters: Filters, keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (doc_id if not given), lang_pred and score of every row."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        names = np.array([*f.languages, "und"], object)
        for batch in batches:
            texts = batch.column(len(keep))
            for first, end, data, offsets in slices(texts):
                lettered = totals(LETTER[data], offsets) > 0
                for i in np.flatnonzero(~lettered & (totals(data > 127, offsets) > 0)):
                    lettered[i] = any(map(str.isalpha, texts[first + int(i)].as_py()))
                lettered &= bool(f.languages)
                share = shares(f, data, offsets) if f.languages else np.zeros((1, end - first))
                best = np.where(lettered, share.argmax(axis=0), len(f.languages))
                score = np.where(lettered, share.max(axis=0), 0.0)
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[first:end] for i in range(len(keep))), pa.array(names[best], pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    read = docs.select(*keep, F.lower("text").alias("_text"))
    return read.mapInArrow(run, ", ".join([*(f"`{c}` {read.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double"]))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
