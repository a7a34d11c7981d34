"""Document fingerprints by one-permutation MinHash, as Spark expressions alone.

A text's shingles are its runs of five lower-cased words (`[^\\x20\\x09-\\x0D]+`; of fewer words, all of them as one). Each
is hashed once; the top eight bits of a hash are its bin, and a bin keeps its least hash. An empty bin takes the value of
another by optimal densification: its own universal hashes name one bin after another until one is filled (after eight
attempts the filled bin of the least hash with it, which is as even a choice). Of each bin the four low bits are kept, sixteen
bins to a long. Two texts' likeness is the share of equal bins, less what equals by chance in four bits: an
unbiased estimate of their shingles' Jaccard similarity with a standard deviation of at most 0.033, cut to 0 to 1.

Defined results: null reads as empty; a text without words has an empty fingerprint, of likeness 1 with another one and 0 with
any other; equal texts have equal fingerprints, whatever else their rows hold. Other columns aren't read. doc_id is an integer.
`edited` orders rows by descending doc_id, null last, those of one doc_id by a hash of the text; rows with equal doc_id and text
are one place of that order, so they have the same next document. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Scratch, table

BINS = 256
BITS = 4
SHINGLE = 5
ATTEMPTS = 8
#: A hash's bits below its bin's.
_REST = (1 << 56) - 1
_ONES = 0x1111111111111111


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """64-bit hashes of the shingles, repeated ones too; empty for a text without words."""

    def of(h: Column) -> Column:
        runs = F.transform(F.slice(h, F.lit(1), F.size(h) - (size - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, size))))
        return F.when(F.size(h) >= size, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    return _bound(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def _least(hashes: Column) -> Column:
    """By bin, in order: the low bits of its least hash, null where it is empty. A mark that ranks last in its bin gives each bin an entry."""
    marks = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda b: F.shiftleft(b.cast("long"), 56).bitwiseOR(F.lit(_REST)))

    def first(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(F.get(s, i - 1), 56) != F.shiftright(x, 56)))

    firsts = _bound(F.sort_array(F.concat(hashes, marks)), first)
    return F.transform(firsts, lambda x: F.when(x.bitwiseAND(F.lit(_REST)) != F.lit(_REST), x.bitwiseAND(F.lit((1 << BITS) - 1))))


def _densified(least: Column) -> Column:
    """All bins filled, where one is."""
    at = F.sequence(F.lit(0), F.lit(BINS - 1))

    def fill(v: Column, filled: Column) -> Column:
        def value(i: Column) -> Column:
            tries = [F.get(v, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(ATTEMPTS)]
            nearest = F.array_min(F.transform(filled, lambda j: F.struct(F.xxhash64(i, j, F.lit(ATTEMPTS)).alias("h"), F.get(v, j).alias("v"))))["v"]
            return F.coalesce(F.get(v, i), *tries, nearest)

        return F.transform(at, value)

    return _bound(least, lambda v: _bound(F.filter(at, lambda j: F.get(v, j).isNotNull()), lambda filled: fill(v, filled)))


def _packed(values: Column) -> Column:
    a_long = 64 // BITS
    one = lambda k: F.aggregate(F.slice(values, k * a_long + 1, a_long), F.lit(0).cast("long"), lambda c, x: F.shiftleft(c, BITS).bitwiseOR(x))
    return F.transform(F.sequence(F.lit(0), F.lit(BINS // a_long - 1)), one)


def fingerprint(text: Column) -> Column:
    """Sixteen longs of sixteen bins each, or an empty array."""
    empty = F.array().cast("array<long>")
    return _bound(shingle_hashes(F.coalesce(text, F.lit(""))), lambda h: F.when(F.size(h) == 0, empty).otherwise(_bound(_densified(_least(h)), _packed)))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, from 0 to 1."""

    def differing(x: Column, y: Column) -> Column:
        z = lambda d: F.bit_count((d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3))).bitwiseAND(F.lit(_ONES)))
        return _bound(x.bitwiseXOR(y), z)

    unequal = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda c, x: c + x)
    chance = 1 / (1 << BITS)
    share = (1 - unequal / float(BINS) - chance) / (1 - chance)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def as_text(fingerprint: Column) -> Column:
    """A digit for each bin."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of each row (doc_id, text)."""
    return docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), fingerprint(F.col("text")).alias("fingerprint"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and _a, _b, the place of the row's order without nulls."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    return rows.withColumns({"_a": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_b": F.when(F.col("doc_id").isNull(), F.xxhash64(tie, F.lit("no doc_id"))).otherwise(tie)})


def _linked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """_a and _b of each place; of the place before it those, whether its doc_id is null, and half its characters.

    Ids alone are dealt by ranges and written with the number of their part; a row a part links the ranges.
    """
    order = [F.col("_null"), F.desc("_a"), F.col("_b")]
    places = rows.groupBy("_a", "_b", F.col("doc_id").isNull().alias("_null")).agg(F.floor(F.max(F.length("text")) / 2).cast("int").alias("_half"))
    places = scratch.put(places.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    within, place = Window.partitionBy("_part").orderBy(*order), F.struct("_a", "_b", "_null", "_half")
    numbered = places.select("*", F.lag(place).over(within).alias("_before"))
    lasts = places.groupBy("_part").agg(F.max_by(place, F.struct("_null", F.bitwise_not("_a").alias("_a"), "_b")).alias("_last"))
    parts = Window.orderBy("_part")  # a row for each partition of the ids
    ends = lasts.select("_part", F.coalesce(F.lag("_last").over(parts), F.last("_last").over(parts.rowsBetween(0, Window.unboundedFollowing))).alias("_last"))
    before = F.coalesce("_before", "_last")
    return numbered.join(F.broadcast(ends), "_part").select("_a", "_b", before["_a"].alias("_to_a"), before["_b"].alias("_to_b"), before["_null"].alias("_null"), before["_half"].alias("_half"))


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, text, ahead (what of the next document's beginning takes the place of the last half), and the next one's place _next_a, _next_b, besides the own place _a, _b.

    Each document sends the beginning that the one before it needs; texts are dealt by their place once, and beginnings once.
    """
    rows = _keyed(docs)
    texts = rows.select("_a", "_b", "text")  # the same columns on both sides, so that they are dealt once
    sent = texts.join(_linked(rows, Scratch(docs.sparkSession)), ["_a", "_b"]).select(F.col("_to_a").alias("_a"), F.col("_to_b").alias("_b"), "_null", F.col("_a").alias("_next_a"), F.col("_b").alias("_next_b"), F.expr("left(text, _half)").alias("ahead"))
    both = texts.join(sent.dropDuplicates(["_a", "_b"]), ["_a", "_b"])
    return both.select(F.when(~F.col("_null"), F.col("_a")).alias("doc_id"), "_a", "_b", "text", "_next_a", "_next_b", "ahead")


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_digest, fingerprint, edited_fingerprint, near_edited and near_next of each row."""
    kept = F.expr("left(text, length(text) - int(floor(length(text) / 2)))")
    rows = edited(docs).withColumn("edited", F.concat(kept, "ahead"))
    rows = rows.select("doc_id", "_a", "_b", "_next_a", "_next_b", F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("edited_digest"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"))
    rows = Scratch(docs.sparkSession).put(rows)
    following = rows.select(F.col("_a").alias("_next_a"), F.col("_b").alias("_next_b"), F.col("fingerprint").alias("_other")).dropDuplicates(["_next_a", "_next_b"])
    near = likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_other")).alias("near_next")
    return rows.join(following, ["_next_a", "_next_b"]).select("doc_id", "n_chars", "edited_digest", "fingerprint", "edited_fingerprint", *near)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compared(table(spark, sf_dir, "documents"))
    digest = F.lower(F.hex("edited_digest")).alias("edited_sha256")
    return rows.select("doc_id", "n_chars", digest, *(as_text(F.col(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")), "near_edited", "near_next")
