"""Fill-in-middle transformation over an index of distinct texts.

Identical texts are grouped by a 64-bit key, and the set that a key gathers tells unequal texts of one key apart by content. The
token boundaries of a distinct text (tokens `[A-Za-z]+|[^A-Za-z]`, ends in code points) are a monotone list, kept in
Elias-Fano form: low bits packed, high parts in unary with counts by block for selection. It is made once for a text; each
document of the group selects its two boundaries from it by its own seed. Texts are shuffled once, a copy for each task that
read one; the few keys of more than `most_copies` documents (or 1/65536 of all) are salted by doc_id, so that
no task gets a large group, and each salt has a copy of the text.

Defined results: null reads as empty; a text without tokens or with a marker of its own stays plain, as do those whose seed says so;
a null doc_id counts as no digits. Repeated rows give repeated results; an empty table gives an empty one; only doc_id and text
are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Copies of one text that a task takes together.
MOST_COPIES = 256
#: Keys that are counted as hot are at most so many.
MOST_HOT = 1 << 16
BLOCK = 64


class EliasFano:
    """An ascending list of numbers: the low bits of each packed, the rest as ones in a bit string, a zero for each step up."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        last = int(values[-1]) if self.n else 0
        self.width = max(0, (last // max(1, self.n)).bit_length() - 1)
        low = values[:, None] >> np.arange(self.width) & 1 if self.width else np.zeros((self.n, 0), np.int64)
        self.low = np.packbits(low.astype(bool).ravel())
        ones = np.zeros((last >> self.width) + self.n, bool)
        ones[(values >> self.width) + np.arange(self.n)] = True
        self.high = np.packbits(ones)
        self.before = np.concatenate([[0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), BLOCK)))]) if len(ones) else np.zeros(1, np.int64)

    def select(self, k: int) -> int:
        """The k-th number, from 0."""
        block = int(np.searchsorted(self.before, k, "right")) - 1
        bits = np.unpackbits(self.high[block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        at = block * BLOCK + int(np.flatnonzero(bits)[k - self.before[block]])
        first = k * self.width
        low = np.unpackbits(self.low[first // 8 : (first + self.width + 7) // 8])[first % 8 : first % 8 + self.width]
        return ((at - k) << self.width) + int((low.astype(np.int64) << np.arange(self.width)).sum())


def boundaries(text: str) -> np.ndarray:
    """Where each token ends, in code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((points | 32) >= 97) & ((points | 32) <= 122) & (points < 128)
    joined = np.append(letter[:-1] & letter[1:], False) if len(points) else letter
    return np.flatnonzero(~joined) + 1


def seeded(doc_id: int | None, seed: str) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def _transformed(seed: str, plain_percent: int, spm_percent: int):
    def of(text: str, marked: bool, ends: EliasFano, doc_id: int | None) -> tuple:
        n = ends.n
        h1, h2, h3, h4 = seeded(doc_id, seed)
        if marked or not n or h3 % 100 >= 100 - plain_percent:
            return doc_id, n, "plain", None, None, text
        a, b = (0 if k == 0 else ends.select(k - 1) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < spm_percent:
            return doc_id, n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        return doc_id, n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts, members = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for nth, text in enumerate(texts):
                    ends, marked = EliasFano(boundaries(text)), any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
                    rows, size = [], 0
                    for m in members:
                        if m["nth"] == nth:
                            rows.append(of(text, marked, ends, m["doc_id"]))
                            size += len(text)
                            if size > 1 << 22:
                                yield batch_of(rows)
                                rows, size = [], 0
                    if rows:
                        yield batch_of(rows)

    return run


def distinct_texts(docs: DataFrame, most_copies: int = MOST_COPIES) -> DataFrame:
    """texts, the different texts of a key (one, but for clashes of hashes), and members, the documents with one of them: (doc_id, nth of the texts)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("_key"))
    hot = max(most_copies, docs.count() // MOST_HOT)
    salts = rows.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > hot)  # fewer than MOST_HOT keys, of 16 bytes
    salts = salts.select("_key", F.ceil(F.col("_n") / most_copies).alias("_salts"))
    salt = F.coalesce(F.pmod(F.xxhash64(F.lit("salt"), "doc_id"), F.col("_salts")), F.lit(0))
    dealt = rows.join(F.broadcast(salts), "_key", "left").select("doc_id", "text", "_key", salt.alias("_salt"), F.xxhash64(F.lit(1), "text").alias("_other"))
    groups = dealt.groupBy("_key", "_salt").agg(F.collect_set("text").alias("texts"), F.collect_list(F.struct("doc_id", "_other")).alias("m"))
    others = F.transform("texts", lambda t: F.xxhash64(F.lit(1), t))
    nth = lambda m: F.when(F.size("texts") == 1, 0).otherwise(F.array_position(others, m["_other"]).cast("int") - 1)
    return groups.select("texts", F.transform("m", lambda m: F.struct(m["doc_id"].cast("long").alias("doc_id"), nth(m).alias("nth"))).alias("members"))


def transformed(docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, most_copies: int = MOST_COPIES) -> DataFrame:
    """doc_id, n (tokens), form (`psm`, `spm` or `plain`), prefix_chars, middle_chars and output of each document."""
    run = _transformed(seed, plain_percent, spm_percent)
    return distinct_texts(docs, most_copies).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    size = lambda a, b: F.locate(b, output) - F.locate(a, output) - len(a) if b else F.length(output)
    piece = lambda a, b: F.substring(output, F.locate(a, output) + len(a), size(a, b))
    psm = F.concat(piece(PREFIX, SUFFIX), piece(MIDDLE, None), piece(SUFFIX, MIDDLE))
    spm = F.concat(piece(PREFIX, MIDDLE), piece(MIDDLE, None), piece(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transformed(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
