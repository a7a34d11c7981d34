"""Exact Jaccard self-join of word n-gram sets with set-relation skipping, down to linked components.

Index lists. Two sets of at most given sizes that link differ in at most D elements. The elements'
hash range is cut into more than D parts, so that some part is the same in both; each set enters one
index list for each of its parts, under a digest of the part's elements. A list therefore holds sets
that share a whole run of elements, not just one, and a passage that many documents share doesn't
make long lists. Sets pair with sets of like size only, so parts are cut by size class; each set
enters its own class and the next one up if a larger partner can be there. Empty parts match anything
and are not listed; a set with so few filled parts that empty ones might be its only common ones
enters lists of its least elements as well (prefix filtering among such sets). A pair of such a set
and one with more filled parts meets in a list of a part: it differs in too few of the latter's parts
for all of them.

Block skipping. A list is ordered by the position that the part has in each set. Positions further
apart than D prove that the sets before and after differ too much: the list is cut there into blocks,
and no pair across blocks is looked at. Lists are streamed, whatever their length.

Answers from similar sets. The set of a block that most other blocks hold too is its pivot.
1. A pivot's answers are computed: each member of its blocks is compared with it by exact
   intersection, which also gives the elements that the member has more and those that it has less.
   Members that a bound already proves to be remote are left out: parities, an exclusive or of one
   bit for each element, of twice as many bits as elements at least.
2. Members' answers are derived from the pivot's by these differences alone (`derived`). Members that
   link with the pivot are one component and need no comparison. For the others, differences are
   what is joined: a pair of which one doesn't link with the pivot must share an element among the
   first few of both differences, in an order with the rarest of the group first (`candidates`). So a
   rare edit that copies have in common brings them together, and neither the text that all copies share
   nor what many of them lack alike does.
3. Remote members of a block have little but the block's part in common with the pivot. They are compared
   by sizes and parities, in tiles of bounded size (`remote_pairs`), and what that leaves exactly.

Every set is shipped once for each pivot that it is compared with. Groups of a pivot are cut into
shares of bounded size, each with the pivot's set. Equal sets are one class from the start. Sets are
compared by 64-bit hashes of their elements; classes are known by 64 bits of their digests, or by
another 64 where two classes have the first in common.

Defined results: null and empty texts have the empty set and link with nothing, themselves apart;
texts of fewer words than an n-gram are one element; repeated rows are copies; a null doc_id is in
its component but never names it unless all are null; an empty table gives an empty result; only
doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .flat import LOWER, NOT_SPACE, U64, Fingerprints, column, mix, runs_of, slices, window_hashes, words
from .membership import bitmap_of, maybe_in
from .tables import Scratch, packed, table, unpacked

GROWTH = 1.5
HELD = 1 << 18  # entries of a list that a task looks at together; the same blocks come out at any value
SHARE = 1024  # sets in a share of a group
TILE = 1024  # sets on either side of a tile
COUNTED = 1 << 21  # elements of differences that a share counts together
TALLY = 1 << 12  # elements of a share of which it says how often they are there
NO_ID = -(1 << 63)


class Limits:
    """What a link at a similarity of part / whole allows."""

    def __init__(self, part: int, whole: int):
        self.part, self.whole = part, whole

    def remote(self, least, total):
        """Whether two sets, which differ in so many elements at least, of so many in both together, are so far apart that nothing links with both.

        What links with both has at most whole / part times the elements of either, and differs from them in so many less than these two differ.
        """
        return least * self.part > total * (self.whole - self.part)

    def most_different(self, total):
        """Elements in one of two linked sets only, of so many elements in both together."""
        return total * (self.whole - self.part) // (self.whole + self.part)

    def classes(self, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of the size classes, and by class the most differing elements and the number of parts."""
        bounds = [1]
        while bounds[-1] <= largest * self.whole // self.part + 1:
            bounds.append(max(bounds[-1] + 1, int(bounds[-1] * GROWTH)))
        bounds = np.array(bounds)
        differ = self.most_different(2 * (bounds[1:] - 1))
        return bounds, differ, differ + 3 + differ // 16


def element_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the documents' n-grams, and where each document's begin."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets, NOT_SPACE)
    hashes = mix(Fingerprints(data).of(starts, ends) ^ mix(ends - starts))
    at, doc = runs_of(first, n)
    grams = window_hashes(hashes, at, n)
    counts = np.diff(first)
    for k in range(1, n):  # documents of k words
        few = np.flatnonzero(counts == k)
        grams = np.append(grams, mix(window_hashes(hashes, first[few], k) ^ U64(k)))
        doc = np.append(doc, few)
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    once = np.append(True, (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1]))[: len(grams)]
    return grams[once], np.searchsorted(doc[once], np.arange(len(offsets)))


def _sums(values: np.ndarray, first: np.ndarray, add=np.add) -> np.ndarray:
    """Of consecutive ranges, 0 for empty ones."""
    out = np.zeros(len(first) - 1, values.dtype)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = add.reduceat(values, first[:-1][full])
    return out


def class_ids(grams: np.ndarray, first: np.ndarray, seed: int = 17) -> np.ndarray:
    return mix(_sums(mix(grams ^ U64(seed)), first) ^ mix(np.diff(first) + seed)).astype(np.int64)


def named(grams: np.ndarray, first: np.ndarray, clashes: np.ndarray) -> np.ndarray:
    """The names of the sets' classes: their digests, or second digests where those are shared by several classes."""
    ids = class_ids(grams, first)
    return np.where(np.isin(ids, clashes), class_ids(grams, first, 99), ids) if len(clashes) else ids


def parities(grams: np.ndarray, first: np.ndarray) -> list[bytes]:
    """By set, the exclusive or of a bit for each element, of a power of two of bits, twice its size at least."""
    sizes = np.diff(first)
    bits = np.maximum(512, 1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64))
    begins = np.append(0, np.cumsum(bits))
    at = np.repeat(begins[:-1], sizes) + ((grams >> U64(20)).astype(np.int64) & np.repeat(bits - 1, sizes))
    flat = np.packbits(np.bincount(at, minlength=begins[-1]).astype(np.uint8) & 1, bitorder="little").tobytes()
    return [flat[a:b] for a, b in zip((begins[:-1] // 8).tolist(), (begins[1:] // 8).tolist(), strict=True)]


def folded(parity: int, bits: int, to: int) -> int:
    """A parity as one of fewer bits."""
    while bits > to:
        bits //= 2
        parity = (parity >> bits) ^ (parity & ((1 << bits) - 1))
    return parity


def least_different(a: bytes, b: bytes) -> int:
    """A lower bound of the number of elements in one of two sets only, from their parities."""
    to = 8 * min(len(a), len(b))
    return (folded(int.from_bytes(a, "little"), 8 * len(a), to) ^ folded(int.from_bytes(b, "little"), 8 * len(b), to)).bit_count()


def list_entries(grams: np.ndarray, first: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, set number, position in the set) of all index entries of some sets."""
    sizes = np.diff(first)
    bounds, differ, parts = limits.classes(int(sizes.max(initial=1)))
    own = np.searchsorted(bounds, sizes, "right") - 1
    out = []
    step = 0
    while True:
        k = own + step
        # in higher classes as the smaller set of a pair
        docs = (sizes > 0) & (sizes * limits.whole >= limits.part * bounds[np.minimum(k, len(bounds) - 1)]) if step else sizes > 0
        docs &= k < len(parts)
        docs[docs] &= differ[k[docs]] > 0
        if step and not docs.any():
            break
        step += 1
        of = np.repeat(np.arange(len(sizes)), np.where(docs, sizes, 0))
        index = np.flatnonzero(np.repeat(docs, sizes))
        g, level = grams[index], k[of]
        part = ((g >> U64(32)) * parts[level].astype(U64) >> U64(32)).astype(np.int64)
        begins = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (part[1:] != part[:-1]))[: len(of)])
        if not len(begins):
            continue
        doc, level = of[begins], level[begins]
        digest = np.add.reduceat(mix(g ^ U64(0x5851F42D4C957F2D)), begins)
        lists = mix(digest ^ mix(part[begins] + (level << 40)))
        position = index[begins] - first[doc]
        filled = np.bincount(doc, minlength=len(sizes))
        enough = filled > np.where(docs, differ[np.minimum(k, len(differ) - 1)], 0)
        out.append((lists, doc, position))  # those of sets with few filled parts too: a partner may have enough
        few = docs & ~enough
        if few.any():
            prefix = sizes - -(-sizes * limits.part // limits.whole) + 1
            of, rank = index_of_prefixes(np.where(few, prefix, 0))
            out.append((mix(grams[first[of] + rank] ^ mix((k[of] << 40) + 1)), of, rank))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def index_of_prefixes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def _classes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first_row, end, data, offsets in slices(column(batch, "text")):
                grams, first = element_sets(data, offsets, n)
                carried = [column(batch, c)[first_row:end] for c in ("doc_id", "row", "exact")]
                found = [pa.array(np.diff(first)), pa.array(class_ids(grams, first)), pa.array(class_ids(grams, first, 99)), pa.array(parities(grams, first), pa.binary())]
                yield pa.RecordBatch.from_arrays([*carried, *found], names=["doc_id", "row", "exact", "size", "class", "check", "parity"])

    return run


def row_keys(text: str = "text", doc_id: str = "doc_id") -> list[Column]:
    """row and exact: 128 bits together that tell apart rows of different doc_id or text."""
    return [F.xxhash64(doc_id, text).alias("row"), F.xxhash64(text).alias("exact")]


def classes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, row keys, size, digests and parity of the set of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *row_keys()).mapInArrow(_classes(n), f"doc_id {kind}, row long, exact long, size long, class long, check long, parity binary")


def _entries(n: int, limits: Limits, clashes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()  # copies within a task enter the lists once
        for batch in batches:
            for _, _, data, offsets in slices(column(batch, "text")):
                grams, first = element_sets(data, offsets, n)
                ids = named(grams, first, clashes)
                _, where = np.unique(ids, return_index=True)
                new = np.zeros(len(ids), bool)
                new[[i for i in where.tolist() if ids[i] not in met]] = True
                met.update(ids[new].tolist())
                sizes = np.diff(first)
                grams, sizes, ids = grams[np.repeat(new, sizes)], sizes[new], ids[new]
                first = np.append(0, np.cumsum(sizes))
                lists, of, position = list_entries(grams, first, limits)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (lists.astype(np.int64), position.astype(np.int32), sizes[of].astype(np.int32), ids[of]))], names=["list", "position", "size", "class"])

    return run


def gaps(lists: np.ndarray, position: np.ndarray, size: np.ndarray, limits: Limits) -> np.ndarray:
    """Where blocks of ordered entries begin."""
    # no set of a list is smaller than its class's least partner, which bounds what all pairs may differ in
    gap = limits.most_different((2 * GROWTH * size * limits.whole / limits.part).astype(np.int64) + 4)
    return np.append(True, (lists[1:] != lists[:-1]) | (position[1:] - position[:-1] > gap[1:]))[: len(lists)]


def blocks_of(lists: np.ndarray, position: np.ndarray, size: np.ndarray, ids: np.ndarray, limits: Limits) -> tuple[np.ndarray, ...]:
    """(block, class, number of members) of the members of blocks of several classes, of entries in order of (list, position, size, class). Blocks of the same members have the same name."""
    once = np.append(True, (lists[1:] != lists[:-1]) | (ids[1:] != ids[:-1]))[: len(lists)]
    lists, position, size, ids = lists[once], position[once], size[once], ids[once]
    if not len(lists):
        return lists, ids, ids
    begins = np.flatnonzero(gaps(lists, position, size, limits))
    members = np.diff(np.append(begins, len(lists)))
    block = np.repeat(np.add.reduceat(mix(ids), begins), members).astype(np.int64)
    members = np.repeat(members, members)
    return block[members > 1], ids[members > 1], members[members > 1]


def _blocks(limits: Limits):
    names = ["block", "class", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in range(4)]  # of the last block so far
        known = None  # the name of that block, once part of it has been sent

        def sent(rows: list[np.ndarray], name: int | None) -> pa.RecordBatch:
            found = (np.full(len(rows[0]), name), rows[3], np.full(len(rows[0]), HELD)) if name is not None else blocks_of(*rows, limits)
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(np.int64)) for x in found], names=names)

        for batch in batches:
            new = [column(batch, c).to_numpy().astype(np.int64) for c in ("list", "position", "size", "class")]
            now = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if not len(now[0]):
                continue
            begins = np.flatnonzero(gaps(*now[:3], limits))
            if known is not None:
                end = begins[1] if len(begins) > 1 else len(now[0])
                yield sent([x[1:end] for x in now], known)  # the first was sent before
                if len(begins) < 2:
                    held = [x[-1:] for x in now]
                    continue
                now, begins, known = [x[end:] for x in now], begins[1:] - end, None
            last = int(begins[-1])
            yield sent([x[:last] for x in now], None)
            held = [x[last:] for x in now]
            if len(held[0]) > HELD:  # too long to hold until it ends: its name is that of its first entry
                known = int(mix(held[0][:1].astype(U64) ^ mix(held[1][:1])).astype(np.int64)[0])
                yield sent(held, known)
                held = [x[-1:] for x in held]
        if known is None:
            yield sent(held, None)

    return run


def blocks(docs: DataFrame, n: int, limits: Limits, clashes: np.ndarray) -> DataFrame:
    """block, class and weight (the block's number of members, or a bound below it) of the members of all blocks of several sets, equal blocks once."""
    entries = docs.select("text").mapInArrow(_entries(n, limits, clashes), "list long, position int, size int, class long")
    ordered = entries.repartition("list").sortWithinPartitions("list", "position", "size", "class")
    return ordered.mapInArrow(_blocks(limits), "block long, class long, weight long").distinct()


def _bounded(limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (column(batch, c).to_numpy() for c in ("pivot_size", "size"))
            least = np.array([least_different(a, b) for a, b in zip(column(batch, "pivot_parity").to_pylist(), column(batch, "parity").to_pylist(), strict=True)], np.int64)
            remote = limits.remote(np.maximum(least, np.abs(x - y)), x + y)
            yield pa.RecordBatch.from_arrays([column(batch, "pivot"), column(batch, "class"), pa.array(remote)], names=["pivot", "class", "remote"])

    return run


def stars(members: DataFrame, info: DataFrame, limits: Limits) -> DataFrame:
    """pivot, class and remote, whether their sizes and parities prove them far apart, of each member and each pivot of its blocks."""
    pairs = members.where("class <> pivot").select("pivot", "class").distinct()
    both = pairs.join(info.select(F.col("class").alias("pivot"), F.col("size").alias("pivot_size"), F.col("parity").alias("pivot_parity")), "pivot").join(info.select("class", "size", "parity"), "class")
    return both.mapInArrow(_bounded(limits), "pivot long, class long, remote boolean")


def _sets(n: int, clashes: np.ndarray, bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, sent = bitmap.value, set()  # a row that repeats is sent once
        for batch in batches:
            keys = column(batch, "key").to_numpy()
            for first_row, end, data, offsets in slices(column(batch, "text")):
                grams, first = element_sets(data, offsets, n)
                ids = named(grams, first, clashes)
                own = keys[first_row:end]
                take = maybe_in(wanted, ids, own)
                for i in np.flatnonzero(take).tolist():
                    take[i] = (row := (int(ids[i]), int(own[i]))) not in sent
                    sent.add(row)
                sizes = np.diff(first)
                grams = grams[np.repeat(take, sizes)]
                ends = 8 * np.append(0, np.cumsum(sizes[take]))
                elements = pa.LargeBinaryArray.from_buffers(pa.large_binary(), int(take.sum()), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(grams)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids[take]), pa.array(own[take]), elements], names=["class", "key", "elements"])

    return run


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _answers(limits: Limits):
    names = ["pivot", "share", "shares", "class", "pivot_size", "size", "near", "more", "less", "far", "whole"]
    kinds = [pa.int64()] * 6 + [pa.bool_()] + [pa.list_(pa.int64())] * 2 + [pa.bool_()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, None
        held: list[np.ndarray] = []  # differences of the share that have not been counted
        many, any_far, whole = 0, False, True

        def tally(ended: bool) -> tuple:
            elements, counts = np.unique(np.concatenate(held), return_counts=True)
            elements, counts = elements[counts > 1], counts[counts > 1]
            often = np.lexsort((elements, -counts))[:TALLY]
            return (*group, group[0], len(own), 0, None, elements[often], counts[often], any_far, ended and whole and len(elements) <= TALLY)

        def sent(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            keys = zip(*(column(batch, c).to_pylist() for c in ("pivot", "share", "shares")), strict=True)
            out: list[tuple] = []
            for key, class_, elements in zip(keys, column(batch, "class").to_pylist(), column(batch, "elements"), strict=True):
                grams = np.frombuffer(elements.as_buffer(), U64)
                if key[0] == class_:  # comes first in its share
                    if held:
                        out.append(tally(True))
                    if group != key:
                        any_far, whole = False, True
                    else:  # the pivot again, by a row that repeats
                        whole = whole and not held
                    group, own, held, many = key, grams.copy(), [], 0
                    continue
                assert group == key
                at = np.minimum(np.searchsorted(own, grams), len(own) - 1)
                common = own[at] == grams
                missing = np.ones(len(own), bool)
                missing[at[common]] = False
                n = int(common.sum())
                near = limits.whole * n >= limits.part * (len(own) + len(grams) - n)
                more, less = grams[~common].astype(np.int64), own[missing].astype(np.int64)
                out.append((*key, class_, len(own), len(grams), near, more, less, not near, None))
                any_far |= not near
                held += [more, less]
                many += len(more) + len(less)
                if many > COUNTED:
                    out.append(tally(False))
                    held, many, whole = [], 0, False
            yield sent(out)
        if held:
            yield sent([tally(True)])

    return run


def answers(docs: DataFrame, pairs: DataFrame, groups: DataFrame, n: int, limits: Limits, clashes: np.ndarray, scratch: Scratch) -> DataFrame:
    """For pairs (pivot, class): sizes, near (whether they link), far (whether they don't), more (elements that the pivot lacks) and less (those that the class lacks), by exact comparison.

    Rows that come before them with no value of near are tallies of a share: elements that several of its differences hold, the most frequent ones, in
    more, their numbers in less; far, whether any member so far doesn't link; whole, whether no other element is in two differences of the share.
    A bitmap of bounded size tells tasks which sets to send; those it lets through by chance go in the join.
    """
    counts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
    dealt = pairs.select("pivot", "class").join(counts, "pivot").withColumn("share", F.pmod(F.hash("class"), F.col("shares")))
    asked = dealt.select("pivot", "share", "shares", "class").union(counts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "shares", F.col("pivot").alias("class")))
    keys = groups.select("class", "key")
    wanted = scratch.put(pairs.select("class").union(pairs.select("pivot")).distinct().join(keys, "class").select("class", "key"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted))
    sets = docs.select(_key().alias("key"), "text").mapInArrow(_sets(n, clashes, shared), "class long, key long, elements binary")
    rows = asked.join(sets, "class").select("pivot", "share", "shares", "class", "elements").repartition("pivot", "share")
    ordered = rows.sortWithinPartitions("pivot", "share", F.col("class") != F.col("pivot"))
    return ordered.mapInArrow(_answers(limits), "pivot long, share long, shares long, class long, pivot_size long, size long, near boolean, more array<long>, less array<long>, far boolean, whole boolean")


def _ordered(limits: Limits):
    names = ["pivot", "class", "size", "n", "far", "probed", "listed", "elements", "at"]
    kinds = [pa.int64()] * 4 + [pa.bool_()] + [pa.int64()] * 2 + [pa.list_(pa.int64()), pa.list_(pa.int32())]

    def lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
        flat = column(batch, name)
        ends = flat.offsets.to_numpy()
        return np.split(flat.values.to_numpy(), ends)[1:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, tallies, any_far, whole = None, [], False, False
        known, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            out: list[tuple] = []
            columns = [column(batch, c).to_pylist() for c in ("pivot", "share", "shares", "class", "pivot_size", "size", "near", "far", "whole")]
            for pivot, share, shares, class_, pivot_size, size, near, far, all_, more, less in zip(*columns, lists(batch, "more"), lists(batch, "less"), strict=True):
                if near is None:  # tallies of the whole group come first in each share
                    if group != (pivot, share):
                        group, tallies, any_far, whole = (pivot, share), [], False, shares == 1
                    tallies.append((more, less))
                    any_far, whole = any_far or far, whole and all_
                    continue
                assert group == (pivot, share)
                if not any_far:
                    continue
                if tallies:
                    known, at = np.unique(np.concatenate([t[0] for t in tallies]), return_inverse=True)
                    times = np.bincount(at, np.concatenate([t[1] for t in tallies]), len(known)).astype(np.int64)
                    tallies = []
                d = np.concatenate([more, less])
                n, rank = len(d), np.zeros(len(d), np.int64)
                if not n:
                    continue
                if len(known):
                    at = np.minimum(np.searchsorted(known, d), len(known) - 1)
                    rank = np.where(known[at] == d, times[at], 0)
                largest = limits.most_different(size + size * limits.whole // limits.part)
                slack = limits.most_different(size - pivot_size) + 1 if size > pivot_size else 0
                probed, listed = min(n, largest + 1) if far else 0, n - max(1, -((slack - n - 1) // 2), n - largest) + 1
                first = np.argsort(rank, kind="stable")[: max(probed, listed, 0)]
                place = np.arange(len(first), dtype=np.int32)
                if whole:  # all other elements are in no other difference
                    place = place[rank[first] > 0]
                if len(place):
                    out.append((pivot, class_, size, n, far, probed, listed, d[first[place]], place))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

    return run


def candidates(found: DataFrame, labels: DataFrame, limits: Limits, scratch: Scratch) -> DataFrame:
    """Pairs (pivot, a, b) of members of a pivot's group in different components, one of which at least doesn't link with the pivot, that their differences from it allow to link.

    With p the pivot and d the difference from it, x and y differ in as many elements as d(x) and d(y) do. A far x,
    d(x) > most_different(x, p), that links with y has at least (d(x) + d(y) - most_different(x, y)) / 2 elements of its d in d(y), and
    the first of these, in any order that holds for the whole group, stands before the last of d but so many, in both. What that
    number is at least follows for y from x being far, and for x from d(y) having all of them. The order is by the tallies of all
    shares, elements without one first, then those that the pivot lacks first. So elements that many differences hold are seldom
    among the first, and pairs grow with the members, not with their square. In a group of one share the tallies also tell which
    elements are in one difference only; these aren't sent.
    """
    own = labels.select(F.col("node").alias("class"), "label")
    tallies = found.where("near IS NULL").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    dealt = tallies.union(found.where("near IS NOT NULL").select(tallies.columns)).repartition("pivot", "share").sortWithinPartitions("pivot", "share", F.col("near").isNotNull())
    firsts = dealt.mapInArrow(_ordered(limits), "pivot long, class long, size long, n long, far boolean, probed long, listed long, elements array<long>, at array<int>")
    rows = scratch.put(firsts.join(own, "class", "left").withColumn("label", F.coalesce("label", "class")))

    def entries(upto: str, side: str) -> DataFrame:
        out = rows.where("far") if upto == "probed" else rows
        out = out.select("pivot", "class", "label", "size", "n", upto, F.explode(F.arrays_zip("elements", "at")).alias("one")).where(F.col("one.at") < F.col(upto))
        return out.select("pivot", F.col("one.elements").alias("element"), F.col("one.at").alias(f"{side}_at"), *(F.col(c).alias(f"{side}_{c}") for c in ("class", "label", "size", "n")))

    most = F.floor((F.col("x_size") + F.col("y_size")) * (limits.whole - limits.part) / F.lit(limits.whole + limits.part))
    common = F.ceil((F.col("x_n") + F.col("y_n") - most) / 2)
    left = 1 + F.least(F.col("x_n") - F.col("x_at") - 1, F.col("y_n") - F.col("y_at") - 1)
    alike = (F.least("x_size", "y_size") * limits.whole >= F.greatest("x_size", "y_size") * limits.part) & (left >= common)
    met = entries("probed", "x").join(entries("listed", "y"), ["pivot", "element"]).where((F.col("x_label") != F.col("y_label")) & alike)
    pairs = scratch.put(met.select("pivot", F.least("x_class", "y_class").alias("a"), F.greatest("x_class", "y_class").alias("b")).distinct())
    scratch.drop(rows)
    return pairs


def derived(found: DataFrame, labels: DataFrame, limits: Limits, scratch: Scratch) -> DataFrame:
    """Links (a, b) among `candidates`, from their differences from the pivot alone.

    The common elements of x and y are those of the pivot in neither's `less` and those in both's `more`.
    """
    pairs = candidates(found, labels, limits, scratch)
    sides = found.where("near IS NOT NULL").select("pivot", "pivot_size", "class", "size", "more", "less").join(pairs.select("pivot").distinct(), "pivot", "left_semi")
    both = pairs.join(sides.toDF("pivot", "pivot_size", "a", "x", "x_more", "x_less"), ["pivot", "a"]).join(sides.drop("pivot_size").toDF("pivot", "b", "y", "y_more", "y_less"), ["pivot", "b"])
    n_common = F.col("pivot_size") - F.size(F.array_union("x_less", "y_less")) + F.size(F.array_intersect("x_more", "y_more"))
    both = both.withColumn("common", n_common).where(limits.whole * F.col("common") >= limits.part * (F.col("x") + F.col("y") - F.col("common")))
    return both.select("a", "b").distinct()


def _tile_pairs(limits: Limits):
    def pairs(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids, labels, sizes, remote, chunks, parity = rows
        to = 8 * min(map(len, parity))
        flat = np.stack([np.frombuffer(p if 8 * len(p) == to else folded(int.from_bytes(p, "little"), 8 * len(p), to).to_bytes(to // 8, "little"), U64) for p in parity])
        split = chunks.min() != chunks.max()
        a, b = [], []
        for i in range(len(ids) - 1):
            j = np.arange(i + 1, len(ids))
            j = j[(labels[j] != labels[i]) & (remote[j] | remote[i]) & ((chunks[j] != chunks[i]) | (not split)) & (np.minimum(sizes[j], sizes[i]) * limits.whole >= np.maximum(sizes[j], sizes[i]) * limits.part)]
            j = j[np.bitwise_count(flat[j] ^ flat[i]).sum(1, dtype=np.int64) <= limits.most_different(sizes[j] + sizes[i])]
            a.append(np.full(len(j), ids[i]))
            b.append(ids[j])
        return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("class", "label", "size", "remote", "chunk")
        tile, held = None, []
        for batch in batches:
            keys = list(zip(*(column(batch, c).to_pylist() for c in ("block", "first", "second")), strict=True))
            columns = [column(batch, c).to_numpy(zero_copy_only=False) for c in names] + [np.array([*column(batch, "parity").to_pylist(), None], object)[:-1]]
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and keys[a] != tile:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, pairs([np.concatenate(x) for x in zip(*held, strict=True)]))], names=["a", "b"])
                    held = []
                tile = keys[a]
                held.append([x[a:b] for x in columns])
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, pairs([np.concatenate(x) for x in zip(*held, strict=True)]))], names=["a", "b"])

    return run


def remote_pairs(members: DataFrame, star: DataFrame, found: DataFrame, labels: DataFrame, info: DataFrame, limits: Limits) -> DataFrame:
    """Pairs (pivot, class) of members of a block in different components, one of them remote from the block's pivot, whose sizes and parities allow a link.

    Members that link with the pivot differ too much from remote ones, and pairs in its ball have been looked at.
    """
    state = star.join(found.where("near").select("pivot", "class"), ["pivot", "class"], "left_anti")
    rest = members.join(state, ["pivot", "class"]).join(labels.select(F.col("node").alias("class"), "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    open_ = rest.groupBy("block").agg(F.max("remote").alias("any"), F.min("label").alias("l"), F.max("label").alias("h"), F.ceil(F.count("*") / TILE).alias("chunks")).where("any AND l < h")
    rows = rest.select("block", "class", "label", "remote").join(open_.select("block", "chunks"), "block").join(info.select("class", "size", "parity"), "class")
    rows = rows.withColumn("chunk", F.pmod(F.hash("class"), F.col("chunks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("block", F.least("chunk", "other").alias("first"), F.greatest("chunk", "other").alias("second"), "class", "label", "size", "remote", "chunk", "parity")
    # a tile of one chunk with itself is there once, one of two chunks from both sides
    tiles = rows.repartition("block", "first", "second").sortWithinPartitions("block", "first", "second", "class")
    pairs = tiles.mapInArrow(_tile_pairs(limits), "a long, b long")
    return pairs.select(F.least("a", "b").alias("pivot"), F.greatest("a", "b").alias("class")).distinct()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for batch in batches:
        for a, b in zip(column(batch, "a").to_pylist(), column(batch, "b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    for i in range(0, len(nodes), 100_000):
        some = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], names=["a", "b"])


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and label, the least node it is connected to, of all nodes of links (a, b) but those that are labels themselves.

    Each round unites the links that one task holds, brings all that a node is linked with together, and lets
    labels of labels replace labels, until every node has one label and that one none.
    """
    edges = scratch.put(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").mapInArrow(_united, "a long, b long"))
    while True:
        united = edges.repartition("a").mapInArrow(_united, "a long, b long")
        once = scratch.put(united)
        jump = once.groupBy("a").agg(F.min("b").alias("b"))
        stepped = scratch.put(once.alias("x").join(jump.alias("y"), F.col("x.b") == F.col("y.a"), "left").select("x.a", F.coalesce("y.b", "x.b").alias("b"), F.col("y.a").isNotNull().alias("moved")))
        scratch.drop(edges, once)
        moved, n, nodes = stepped.agg(F.max("moved"), F.count("*"), F.countDistinct("a")).first()
        if not moved and n == nodes:
            return stepped.select(F.col("a").alias("node"), F.col("b").alias("label"))
        edges = stepped


def labelled(docs: DataFrame, part: int, whole: int, n: int) -> tuple[DataFrame, Scratch]:
    """doc_id, row, exact, size, class and label (the least class of the component) of every row."""
    limits, scratch = Limits(part, whole), Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = scratch.put(classes(docs, n))
    clashes = np.array([r[0] for r in rows.groupBy("class").agg(F.min("check").alias("l"), F.max("check").alias("h")).where("l < h").select("class").collect()], np.int64)
    if len(clashes):
        rows = rows.withColumn("class", F.when(F.col("class").isin(*clashes.tolist()), F.col("check")).otherwise(F.col("class")))
    groups = scratch.put(rows.where("size > 0").withColumn("key", _key()).groupBy("class").agg(F.first("size").alias("size"), F.first("parity").alias("parity"), F.min("key").alias("key")))
    found = scratch.put(blocks(docs, n, limits, clashes))
    central = F.struct(F.col("central"), F.col("class"))
    ranked = found.join(found.groupBy("class").agg(F.sum("weight").alias("central")), "class")
    pivots = ranked.groupBy("block").agg(F.max(central).alias("one")).select("block", F.col("one.class").alias("pivot"))
    members = scratch.put(found.join(pivots, "block").select("block", "class", "pivot"))
    star = scratch.put(stars(members, groups, limits))
    answered = scratch.put(answers(docs, star.where("NOT remote"), groups, n, limits, clashes, scratch))
    links = [answered.where("near").select(F.col("pivot").alias("a"), F.col("class").alias("b"))]
    labels = components(links[0], scratch)
    links.append(scratch.put(derived(answered, labels, limits, scratch)))
    rest = scratch.put(remote_pairs(members, star, answered, labels, groups, limits))
    if not rest.isEmpty():
        more = scratch.put(answers(docs, rest, groups, n, limits, clashes, scratch).where("near").select(F.col("pivot").alias("a"), F.col("class").alias("b")))
        links.append(more)
    if any(not x.isEmpty() for x in links[1:]):
        labels = components(reduce(DataFrame.union, links[1:], labels.toDF("a", "b")), scratch)
    out = rows.select("doc_id", "row", "exact", "size", "class").join(labels.withColumnRenamed("node", "class"), "class", "left")
    return out.withColumn("label", F.coalesce("label", "class")), scratch


def joined(docs: DataFrame, part: int = 85, whole: int = 100, n: int = 4) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows, scratch = labelled(docs, part, whole, n)
    named_ = rows.where("size > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(named_, "label", "left")
    out = scratch.put(out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))
    scratch.clear(out)
    return out


def representatives(docs: DataFrame, part: int = 80, whole: int = 100, n: int = 5) -> DataFrame:
    """One document of each component with the columns it came with: of the least doc_id, rows without one last, and of equal ones the least class.

    Rows that repeat both doc_id and text stay once. Rows of empty sets link with nothing and stay.
    """
    rows, scratch = labelled(docs, part, whole, n)
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "class", "exact", "row")
    chosen = rows.where("size > 0").groupBy("label").agg(F.min(order).alias("one")).select("one.row", "one.exact")
    kept = scratch.put(chosen.union(rows.where("size = 0").select("row", "exact")).distinct())
    scratch.clear(kept)
    keyed = packed(docs).select("_row", "text", *row_keys(doc_id="_row.doc_id")).join(kept, ["row", "exact"], "left_semi")
    first = Window.partitionBy("row", "exact").orderBy(F.lit(1))
    return unpacked(keyed.withColumn("_n", F.row_number().over(first)).where("_n = 1"), docs)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))
