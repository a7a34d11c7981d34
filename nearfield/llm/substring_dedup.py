"""Substring deduplication by content-defined chunks.

A gear hash rolls over each text's bytes; where its top bits are zero a chunk may end, so that cuts
depend on the 32 bytes before them and fall in the same places of a passage wherever it stands.
Chunks are kept between two sizes and known by 128-bit digests. Of equal chunks the first one, by
(doc_id, place), stays; runs of later ones of at least `least` bytes are removed from their texts.

The corpus meets twice on digests: an aggregation, partial in each task, finds the digests that occur
more than once and where first; only these are joined with the chunks, of which a bitmap of bounded
size holds most others back, on a join whose hot keys Spark can split. Texts are shuffled once, by document, to have their spans removed.

What is lost at a passage's ends is part of a chunk at each. On 10,000 documents of the given tables, runs from 80 bytes on
touch 1777 of 2747 documents that hold a string of 200 bytes that occurs elsewhere (most others hold first copies) and 69
of 7253 that hold none; from 64 bytes on 1782 and 155, from 96 on 1772 and 39, but then more passages of 50 short words are missed.

Defined results: null and empty texts have no chunks and keep nothing; a doc_id, an integer, stands for
one document, and rows that repeat it never lose a chunk to each other at the same place; a document
without one is ordered by a hash of its text and isn't named as a source; bytes left by a cut inside
a character are kept as bytes in digests and replaced in texts; an empty table gives an empty result;
only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .flat import Fingerprints, column, mix, slices
from .membership import bitmap_of, maybe_in
from .tables import keyed, table, written

#: Texts that a task cuts at a time.
ROWS = 256
GEAR = mix(np.arange(256) + 5000).astype(np.uint32)


def cut_points(data: np.ndarray, offsets: np.ndarray, bits: int, smallest: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all chunks of a slice of texts."""
    rolled = GEAR[data]
    within = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for step in (1, 2, 4, 8, 16):
        rolled[step:] += np.where(within[step:] >= step, rolled[:-step] << np.uint32(step), np.uint32(0))
    places = np.flatnonzero(rolled >> np.uint32(32 - bits) == 0) + 1
    groups = np.searchsorted(places, offsets, "right")
    places, ends, starts = places.tolist(), [], []
    for i, (begin, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        last = begin
        for at in places[groups[i] : groups[i + 1]]:
            if at - last < smallest:
                continue
            while at - last > largest:
                starts.append(last)
                last += largest
                ends.append(last)
            if at - last >= smallest:
                starts.append(last)
                ends.append(at)
                last = at
        while last < stop:
            starts.append(last)
            last = min(last + largest, stop)
            ends.append(last)
    return np.array(starts, np.int64), np.array(ends, np.int64)


def _chunks(bits: int, smallest: int, largest: int, wanted=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, unnamed = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("key", "id", "unnamed"))
            for first, _, data, offsets in slices(column(batch, "text")):
                starts, ends = cut_points(data, offsets, bits, smallest, largest)
                doc = np.searchsorted(offsets, starts, "right") - 1
                digests = [mix(Fingerprints(data, which).of(starts, ends) ^ mix(ends - starts)).astype(np.int64) for which in (0, 1)]
                if wanted is not None:
                    use = maybe_in(wanted.value, *digests)
                    starts, ends, doc, digests = starts[use], ends[use], doc[use], [d[use] for d in digests]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*digests, ids[first + doc], unnamed[first + doc], keys[first + doc], (starts - offsets[doc]).astype(np.int32), (ends - starts).astype(np.int32))], names=["low", "high", "id", "unnamed", "key", "at", "size"])

    return run


def chunks(docs: DataFrame, bits: int = 5, smallest: int = 8, largest: int = 128, wanted=None) -> DataFrame:
    """low, high (a digest), id (the doc_id, or the key of a document that is unnamed), unnamed, key (of the row), at and size (in bytes) of all chunks, or of those whose digests a broadcast bitmap lets through."""
    docs = docs if "key" in docs.columns else keyed(docs)
    read = docs.select("text", "key", F.coalesce(F.col("doc_id").cast("long"), "key").alias("id"), F.col("doc_id").isNull().alias("unnamed"))
    return read.mapInArrow(_chunks(bits, smallest, largest, wanted), "low long, high long, id long, unnamed boolean, key long, at int, size int")


def _cut(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            out = []
            for text, copies in zip(column(batch, "text"), column(batch, "copies").to_pylist(), strict=True):
                data = (text.as_py() or "").encode()
                spans, sources = [], []
                for c in sorted(copies or [], key=lambda c: c["at"]):
                    if spans and spans[-1][1] >= c["at"]:
                        spans[-1][1] = max(spans[-1][1], c["at"] + c["size"])
                        sources[-1].append(c["first_id"])
                    else:
                        spans.append([c["at"], c["at"] + c["size"]])
                        sources.append([c["first_id"]])
                kept = [i for i, (a, b) in enumerate(spans) if b - a >= least]
                spans, sources = [spans[i] for i in kept], sorted({x for i in kept for x in sources[i] if x is not None})
                edges = [0, *(e for s in spans for e in s), len(data)]
                left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(data), len(data) - len(left), spans, sources, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64()), pa.string(), pa.string()]
            names = ["n_bytes", "n_removed", "spans", "copied_from", "kept_sha256", "kept_text"]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], names=["doc_id", *names])

    return run


def deduplicated(docs: DataFrame, least: int = 80, **sizes) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed, in bytes), copied_from (documents that hold the first copies), kept_sha256 and kept_text of every row."""
    docs = keyed(docs.select("doc_id", "text"))
    found = chunks(docs, **sizes)
    place = F.struct("id", "at", "unnamed")
    firsts = written(found.groupBy("low", "high").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("low", "high", "first"))
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap_of(firsts.select("low", "high")))
    copies = chunks(docs, **sizes, wanted=wanted).join(firsts, ["low", "high"]).where((F.col("id") != F.col("first.id")) | (F.col("at") != F.col("first.at")))
    by_document = copies.groupBy("key").agg(F.collect_set(F.struct("at", "size", F.when(~F.col("first.unnamed"), F.col("first.id")).alias("first_id"))).alias("copies"))
    both = docs.join(by_document, "key", "left").select("doc_id", "text", "copies")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(_cut(least), f"doc_id {kind}, n_bytes long, n_removed long, spans array<array<long>>, copied_from array<long>, kept_sha256 string, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "copied_from")
