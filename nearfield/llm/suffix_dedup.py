"""Exact removal of repeated substrings of at least a given length, by enhanced suffix arrays over anchored contexts.

A string of `length` bytes occurs again only where its anchor does: of the `anchor`-byte substrings of a
window of that length the ones of least hash, which the window's content alone decides. So windows are
compared among equal anchors only, each anchor with its context, the bytes of all windows around it.

1. Tasks list every text's anchors with a fingerprint of their contexts, the bytes of the windows whose anchor
   they are; contexts that occur again in the same slice of texts are one row, and what they cover is settled
   there. Spark counts the places of each anchor, and of each anchor and context, in aggregates that
   combine before they shuffle, so a very common passage costs a row a task. Anchors that occur once go
   no further: a bitmap of bounded size keeps most of them from the second listing, and a join the rest.
   Where a whole context occurs again, all its windows are repeated.
2. One context of each kind goes on, where an anchor has several, and these meet by anchor: a sparse
   enhanced suffix array, of the suffixes behind the anchors in order, with the lengths that neighbours have in
   common. Its intervals of a common prefix are told apart by what stands before the anchor, by the same
   array of the reversed left parts: a window with so many bytes before its anchor occurs again where both
   an interval and a left class hold another context (`repeated_in`).
3. Spans go back to their texts, which are shuffled once, by row.

`repeats` sorts all window starts of contexts by ranks of doubling prefixes, walks the interval tree of that
suffix array by a stack, and returns all repeats that can't be extended to the left (`maximal_repeats`), each
with all its occurrences.

An anchor of over `most_held` different contexts doesn't go to one task: Spark counts the digests of
its windows instead, with the same result.

Occurrences are judged on the input: overlaps count, and the same place never counts as two. Fingerprints
of whole contexts have 128 bits.

Defined results: null and empty texts have no bytes; a repeated row is another text, so both lose what
they share; null identifiers are fine; texts under the length lose nothing; an empty table gives an empty
result; bytes left of a cut character are kept in digests and replaced in texts; only doc_id and text are
read.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .flat import U64, Fingerprints, column, mix, slices
from .membership import bitmap_of, maybe_in
from .tables import Scratch, keyed, table

BUCKET_BYTES = 1 << 21
ROWS = 256
LEVELS = (8, 16, 32, 64, 128, 256)


@dataclasses.dataclass(frozen=True)
class Plan:
    length: int = 200
    anchor: int = 72
    most_held: int = 30_000

    @property
    def places(self) -> int:
        """Of an anchor in a window."""
        return self.length - self.anchor + 1


def doubled(values: np.ndarray, width: int) -> list[np.ndarray]:
    """By power of two up to width: the least of each value and those that follow it; past the end nothing changes."""
    out = [values]
    while 2 ** len(out) <= width:
        step, have = 2 ** (len(out) - 1), out[-1]
        more = have.copy()
        if step < len(have):
            more[:-step] = np.minimum(have[:-step], have[step:])
        out.append(more)
    return out


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """The best of each value and the width - 1 that follow it; past the end nothing changes."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        if step < len(out):
            out[:-step] = best(out[:-step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, plan: Plan, contexts: bool = True) -> tuple[np.ndarray, ...]:
    """(anchor hash, document, position in it) of a slice's anchors, and (fingerprint, bytes before, bytes from there on) of their contexts."""
    n, reach = len(data), plan.places - 1
    lengths = np.diff(offsets)
    stop = np.repeat(offsets[1:], lengths)
    first = Fingerprints(data, 0)
    at = np.arange(n)
    fits = at + plan.anchor <= stop
    short = np.full(n, 0xFFFFFFFF, np.uint32)
    hashes = first.of(at[fits], at[fits] + plan.anchor)
    short[fits] = np.maximum((hashes * U64(0x9E3779B97F4A7C15)) >> U64(32), U64(1)).astype(np.uint32)
    tables = doubled(short, plan.places)
    rest = plan.places - 2 ** (len(tables) - 1)
    least = tables[-1].copy()
    least[: max(n - rest, 0)] = np.minimum(tables[-1][: max(n - rest, 0)], tables[-1][rest:])
    least[at + plan.length > stop] = 0
    chosen = sliding(least[::-1], plan.places, np.maximum)[::-1]
    p = np.flatnonzero(fits & (chosen == short))
    doc = np.searchsorted(offsets, p, "right") - 1
    names = mix(first.of(p, p + plan.anchor))
    if not contexts:
        return names, doc, p - offsets[doc]
    # how far nothing less stands to the left and to the right bounds the windows in which each is the least
    left, right, own = p.copy(), p + 1, short[p]
    for power in range(len(tables) - 1, -1, -1):
        step = 2**power
        for _ in range(2 if power == len(tables) - 1 else 1):
            to = left - step
            more = (to >= np.maximum(p - reach, 0)) & (tables[power][np.maximum(to, 0)] >= own)
            left = np.where(more, to, left)
            more = (right + step <= np.minimum(p + 1 + reach, n)) & (tables[power][np.minimum(right, n - 1)] >= own)
            right = np.where(more, right + step, right)
    begin = np.maximum(left, offsets[doc])
    last = np.minimum(np.minimum(p, right - 1 - reach), offsets[doc + 1] - plan.length)
    # nothing stands behind the end of the slice
    last = np.where(right == n, np.minimum(p, offsets[doc + 1] - plan.length), last)
    before, after = p - begin, last + plan.length - p
    context = mix(Fingerprints(data, 1).of(begin, last + plan.length) ^ mix(before * 4096 + after))
    return names, doc, p - offsets[doc], context, before, after


def _anchor_rows(plan: Plan, wanted=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = column(batch, "key").to_numpy()
            for first, _, data, offsets in slices(column(batch, "text")):
                if wanted is None:
                    names, count = np.unique(anchors(data, offsets, plan, contexts=False)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(np.minimum(count, 2))], names=["anchor", "weight"])
                    continue
                hashes, doc, at, context, before, after = anchors(data, offsets, plan)
                # contexts that occur again in the slice: one stands for all in the shuffle, and what they cover is known
                order = np.lexsort((context, hashes))
                new = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (context[order][1:] != context[order][:-1]))[: len(order)]
                number, one = np.cumsum(new) - 1, order[new]
                count = np.bincount(number, minlength=len(one))
                weight = np.minimum(count, 2)
                again = order[count[number] > 1]
                of, start, end = united(doc[again], (at - before)[again], (at + after)[again])
                through = maybe_in(wanted.value, hashes[one].astype(np.int64), np.zeros(len(one), np.int64))
                one, weight, none = one[through], weight[through], np.zeros(len(of), np.int64)
                spread = mix(keys[first + of].astype(U64) ^ mix(start))
                columns = [np.append(hashes[one], spread).astype(np.int64), np.append(context[one], spread).astype(np.int64), np.append(keys[first + doc[one]], keys[first + of])]
                columns += [x.astype(np.int32) for x in (np.append(at[one], start), np.append(before[one], none), np.append(after[one], end - start), np.append(weight, none))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["anchor", "context", "key", "at", "before", "after", "weight"])

    return run


def united(of: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in order, those of one owner that overlap or touch joined."""
    if not len(of):
        return of, start, end
    order = np.lexsort((start, of))
    of, start, end = of[order], start[order], end[order]
    owner = np.cumsum(np.append(0, of[1:] != of[:-1]))
    room = int(end.max()) + 2
    reach = np.maximum.accumulate(end + owner * room)
    begins = np.flatnonzero(np.append(True, (start + owner * room)[1:] > reach[:-1]))
    return of[begins], start[begins], np.maximum.reduceat(end, begins)


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with its bytes for each listed context of each text."""
    for batch in batches:
        keys, listed = column(batch, "key"), column(batch, "listed")
        flat, ends = listed.flatten(), listed.offsets.to_numpy()
        ends = ends - ends[0]
        fields = {c: flat.field(c) for c in ("anchor", "at", "before", "after")}
        at, before, after = (fields[c].to_numpy() for c in ("at", "before", "after"))
        for first, end, data, offsets in slices(column(batch, "text")):
            doc = np.repeat(np.arange(end - first), np.diff(ends[first : end + 1]))
            for some in range(0, len(doc), 20_000):
                part = slice(some, some + 20_000)
                whole = slice(int(ends[first]) + some, min(int(ends[first]) + some + 20_000, int(ends[end])))
                begins, sizes = offsets[doc[part]] + at[whole] - before[whole], (before[whole] + after[whole]).astype(np.int64)
                stops = np.append(0, np.cumsum(sizes))
                cut = data[np.arange(stops[-1]) + np.repeat(begins - stops[:-1], sizes)]
                bytes_ = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(cut)])
                yield pa.RecordBatch.from_arrays([fields["anchor"][whole], keys.take(pa.array(first + doc[part])), *(fields[c][whole] for c in ("at", "before")), bytes_], names=["anchor", "key", "at", "before", "bytes"])


def maximal_repeats(lcp: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, length) of the intervals of a suffix array whose suffixes share `length` bytes, at least `least`, and not the byte before.

    lcp[i] is the common prefix of suffixes i and i + 1; left[i] the byte before suffix i, below 0 where there is none, which differs from all.
    """
    stack: list[list[int]] = []  # [length, first, its one byte before, or -1 if they differ]
    n = len(left)
    for i in range(n):
        begin, byte = i, left[i]
        now = lcp[i] if i < n - 1 else 0
        while stack and stack[-1][0] > now:
            length, begin, before = stack.pop()
            before = before if before == byte else -1
            if length >= least and before < 0:
                yield begin, i, length
            byte = before
            if stack and stack[-1][0] >= now:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == byte else -1
                byte = stack[-1][2]
        if stack and stack[-1][0] == now:
            stack[-1][2] = stack[-1][2] if stack[-1][2] == byte else -1
        elif now >= least:
            stack.append([now, begin, byte])


@dataclasses.dataclass
class Contexts:
    """Contexts of some anchors: numbers of their groups, keys and places of their texts, bytes before the anchor, and all bytes with ends."""

    group: np.ndarray
    keys: np.ndarray
    at: np.ndarray
    before: np.ndarray
    data: np.ndarray
    ends: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ends)

    def some(self, index: np.ndarray) -> Contexts:
        sizes = self.sizes[index]
        ends = np.append(0, np.cumsum(sizes))
        data = self.data[np.arange(ends[-1]) + np.repeat(self.ends[:-1][index] - ends[:-1], sizes)]
        return Contexts(self.group[index], self.keys[index], self.at[index], self.before[index], data, ends)


def ranks_of(text: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    """By level: the rank of the first so many symbols from each place, among places of its group; 0 past the end."""
    n = len(text)
    packed = np.zeros(n + LEVELS[0], U64)
    packed[:n] = text
    word = np.zeros(n, U64)
    for i in range(LEVELS[0]):
        word = word << U64(8) | packed[i : n + i]
    order = np.lexsort((word, group))
    new = np.append(True, (word[order][1:] != word[order][:-1]) | (group[order][1:] != group[order][:-1]))
    out = []
    for level in LEVELS:
        rank = np.zeros(n + 2 * LEVELS[-1], np.int32)
        rank[order] = np.cumsum(new)
        out.append(rank)
        if level == LEVELS[-1]:
            break
        key = rank[:n] * np.int64(n + 1) + rank[level : n + level]
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order][1:] != key[order][:-1])
    return out


def common_prefixes(text: np.ndarray, ranks: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many symbols from places p and q on are the same, of contexts whole."""
    out = np.zeros(len(p), np.int64)
    for level, rank in [(LEVELS[-1], ranks[-1]), *zip(LEVELS[::-1], ranks[::-1], strict=True)]:
        last = len(rank) - 1
        out += level * (rank[np.minimum(p + out, last)] == rank[np.minimum(q + out, last)])
    open_ = np.ones(len(p), bool)
    last = len(text) - 1
    for _ in range(LEVELS[0] - 1):
        open_ &= text[np.minimum(p + out, last)] == text[np.minimum(q + out, last)]
        out += open_
    return out


def suffixes(c: Contexts, plan: Plan) -> tuple[np.ndarray, ...]:
    """(text, ranks, p, number, place): of all window starts, each place of a text once, where they are in the contexts' text, of which context and where in its text."""
    sizes = c.sizes
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    text = np.zeros(ends[-1], np.uint8)
    text[np.arange(len(c.data)) + np.repeat(np.arange(len(sizes)), sizes)] = c.data
    ranks = ranks_of(text, np.repeat(c.group, sizes + 1))
    starts = np.minimum(c.before, sizes - plan.length) + 1
    number = np.repeat(np.arange(len(sizes)), starts)
    within = np.arange(len(number)) - np.repeat(np.cumsum(starts) - starts, starts)
    place = c.at[number] - c.before[number] + within
    order = np.lexsort((place, c.keys[number], c.group[number]))
    group, key, there = c.group[number][order], c.keys[number][order], place[order]
    once = np.sort(order[np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]) | (there[1:] != there[:-1]))])
    return text, ranks, begins[number[once]] + within[once], number[once], place[once]


def classes_by_depth(parts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """[depth, row]: which rows of a group have so many first bytes in common, from their order and the common prefixes of neighbours."""
    padded = np.zeros((len(parts), -(-parts.shape[1] // 8) * 8), np.uint8)
    padded[:, : parts.shape[1]] = parts
    words_ = padded.view(">u8")
    order = np.lexsort((*words_.T[::-1], group))
    differ = parts[order[1:]] != parts[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), parts.shape[1])
    common[group[order[1:]] != group[order[:-1]]] = -1
    out = np.zeros((parts.shape[1] + 1, len(parts)), np.int32)
    out[:, order[1:]] = np.cumsum(common < np.arange(parts.shape[1] + 1)[:, None], axis=1)
    return out


def around(c: Contexts, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """The bytes behind the anchors, and those before them in reverse, each row filled up with zeros."""
    step, here = np.arange(plan.places - 1), c.ends[:-1] + c.before
    last = max(len(c.data) - 1, 0)
    right, left = here[:, None] + plan.anchor + step, here[:, None] - 1 - step
    return (np.where(right < c.ends[1:, None], c.data[np.minimum(right, last)], 0), np.where(left >= c.ends[:-1, None], c.data[np.maximum(left, 0)], 0))


def repeated_in(c: Contexts, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, end) of the spans of texts that occur again in a group.

    Equal windows have their anchor at the same place in them. Of a tie, each anchor has the window in its context.
    """
    order = np.lexsort((c.at, c.keys, c.group))
    group, keys, at = c.group[order], c.keys[order], c.at[order]
    c = c.some(order[np.append(True, (group[1:] != group[:-1]) | (keys[1:] != keys[:-1]) | (at[1:] != at[:-1]))])  # a place counts once
    behind, ahead = (classes_by_depth(x, c.group) for x in around(c, plan))
    windows = c.sizes - plan.length + 1
    number = np.repeat(np.arange(len(windows)), windows)
    lead = c.before[number] - np.arange(len(number)) + np.repeat(np.cumsum(windows) - windows, windows)  # bytes before the anchor
    class_ = lead << 56 | behind[plan.places - 1 - lead, number].astype(np.int64) << 28 | ahead[lead, number]
    order = np.argsort(class_)
    same = class_[order[1:]] == class_[order[:-1]]
    found = order[np.append(same, False) | np.append(False, same)]
    start = c.at[number[found]] - lead[found]
    return united(c.keys[number[found]], start, start + plan.length)


def maximal_in(c: Contexts, plan: Plan) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, context numbers, places in their texts) of every repeat of a group's contexts that can't be extended to the left, in all its occurrences."""
    text, ranks, p, number, place = suffixes(c, plan)
    follows = np.append(False, (number[1:] == number[:-1]) & (place[1:] == place[:-1] + 1))
    # a place whose neighbour on the left is taken from another context differs from all
    left = np.where(follows, text[p - 1].astype(np.int64), -1)
    tail = ranks[-1]
    order = np.lexsort((tail[p + LEVELS[-1]], tail[p]))
    p, number, place, left = p[order], number[order], place[order], left[order]
    ends = np.cumsum(c.sizes + 1) - 1
    room = ends[number] - p
    lcp = np.minimum(common_prefixes(text, ranks, p[:-1], p[1:]), np.minimum(room[:-1], room[1:]))
    lcp[c.group[number[1:]] != c.group[number[:-1]]] = 0
    deep = lcp >= plan.length
    begins = np.flatnonzero(deep & ~np.append(False, deep[:-1]))
    stops = np.flatnonzero(deep & ~np.append(deep[1:], False)) + 1
    for a, b in zip(begins.tolist(), stops.tolist(), strict=True):  # each run of neighbours with enough in common
        for first, last, length in maximal_repeats(lcp[a:b].tolist(), left[a : b + 1].tolist(), plan.length):
            rows = slice(a + first, a + last + 1)
            yield length, number[rows], place[rows]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Contexts]:
    """Contexts of whole anchors, some bytes at a time."""
    held: list[list[np.ndarray]] = []
    size, last = 0, None

    def bucket() -> Contexts:
        anchor, keys, at, before, sizes, data = (np.concatenate(x) for x in zip(*held, strict=True))
        return Contexts(np.cumsum(np.append(0, anchor[1:] != anchor[:-1])), keys, at, before, data, np.append(0, np.cumsum(sizes)))

    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, keys, at, before = (column(batch, c).to_numpy().astype(np.int64) for c in ("anchor", "key", "at", "before"))
        rows = column(batch, "bytes")
        _, ends, data = rows.buffers()
        ends = np.frombuffer(ends, np.int32, len(rows) + 1, 4 * rows.offset).astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        starts = np.append(0, np.flatnonzero(anchor[1:] != anchor[:-1]) + 1)
        first = 0
        for cut in [*starts.tolist(), len(anchor)]:  # to the beginning of each anchor
            full = size + ends[cut] - ends[first] >= BUCKET_BYTES
            if cut > first and (full or cut == len(anchor)):
                some = slice(first, cut)
                held.append([anchor[some], keys[some], at[some], before[some], np.diff(ends[first : cut + 1]), data[ends[first] : ends[cut]].copy()])
                size, last, first = size + ends[cut] - ends[some.start], int(anchor[cut - 1]), cut
            if held and cut < len(anchor) and size >= BUCKET_BYTES and anchor[cut] != last:
                yield bucket()
                held, size = [], 0
    if held:
        yield bucket()


def _span_rows(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _buckets(batches):
            key, start, end = repeated_in(bucket, plan)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["key", "start", "end"])

    return run


def _repeat_rows(plan: Plan):
    names = ["repeat", "length", "key", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _buckets(batches):
            for length, number, places in maximal_in(bucket, plan):
                i = number[0]
                at = int(bucket.ends[i] + places[0] - bucket.at[i] + bucket.before[i])
                name = hashlib.sha256(bucket.data[at : at + length].tobytes()).hexdigest()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(number)), pa.array(np.full(len(number), length)), pa.array(bucket.keys[number]), pa.array(places)], names=names)

    return run


def window_digests(at: np.ndarray, before: np.ndarray, contexts: list[bytes], plan: Plan) -> tuple[np.ndarray, ...]:
    """(low, high, context number, place in the text) of every window of contexts."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    begins = np.cumsum(sizes) - sizes
    starts = np.minimum(before, sizes - plan.length) + 1
    number = np.repeat(np.arange(len(contexts)), starts)
    within = np.arange(len(number)) - np.repeat(np.cumsum(starts) - starts, starts)
    p = begins[number] + within
    low, high = (mix(Fingerprints(data, w).of(p, p + plan.length)) for w in (0, 1))
    return low, high, number, at[number] - before[number] + within


def _digest_rows(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, before = (column(batch, c).to_numpy().astype(np.int64) for c in ("key", "at", "before"))
            for some in range(0, batch.num_rows, 500):
                part = slice(some, some + 500)
                low, high, number, place = window_digests(at[part], before[part], column(batch, "bytes")[part].to_pylist(), plan)
                yield pa.RecordBatch.from_arrays([pa.array(low.astype(np.int64)), pa.array(high.astype(np.int64)), pa.array(keys[part][number]), pa.array(place.astype(np.int32))], names=["low", "high", "key", "start"])

    return run


def merged(spans) -> list[list[int]]:
    """Sorted spans (..., start, end) with those of the same head that overlap or touch joined."""
    out: list[list[int]] = []
    for *head, a, b in sorted(spans):
        if out and out[-1][:-2] == head and a <= out[-1][-1]:
            out[-1][-1] = max(out[-1][-1], b)
        else:
            out.append([*head, a, b])
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
        out = []
        for text, spans in zip(column(batch, "text"), column(batch, "spans"), strict=True):
            data = (text.as_py() or "").encode()
            spans = merged([(s["start"], s["end"]) for s in spans.as_py()]) if spans.is_valid else []
            edges = [0, *(e for s in spans for e in s), len(data)]
            left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string(), pa.string()]
        columns = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept_text"])


def _check(plan: Plan) -> None:
    if plan.length + plan.places > 2 * LEVELS[-1] or not 0 < plan.anchor <= plan.length or plan.places > 127 + 2 or plan.most_held >= 1 << 28:
        raise ValueError("windows of that length or with so many places of an anchor aren't sorted")


def _found(rows: DataFrame, plan: Plan, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Places of contexts that recur as a whole or whose anchor has others, and one context of each kind of the latter."""
    read = rows.select("key", "text")
    counts = read.mapInArrow(_anchor_rows(plan), "anchor long, weight long").groupBy("anchor").agg(F.sum("weight").alias("total"))
    again = scratch.put(counts.where("total > 1").select("anchor"))
    wanted = rows.sparkSession.sparkContext.broadcast(bitmap_of(again.select("anchor", F.lit(0).cast("long"))))
    listed = read.mapInArrow(_anchor_rows(plan, wanted), "anchor long, context long, key long, at int, before int, after int, weight int")
    # weight: 1 for one place, 2 for several of one slice, 0 for a span that a slice knows
    listed = scratch.put(listed.join(again.withColumn("again", F.lit(True)), "anchor", "left").where("again OR weight = 0").drop("again"))
    kinds = listed.where("weight > 0").groupBy("anchor", "context").agg(F.sum("weight").alias("n"), F.min("key").alias("first_key"))
    sizes = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"))
    kinds = scratch.put(kinds.join(sizes, "anchor").where("n > 1 OR kinds > 1"))
    shared = scratch.put(listed.join(kinds, ["anchor", "context"], "left").where("weight = 0 OR n IS NOT NULL"))
    ones = shared.where("kinds > 1 AND key = first_key").select("anchor", "key", "at", "before", "after", "kinds")
    scratch.drop(listed, kinds, again)
    return shared, ones


def _contexts(rows: DataFrame, some: DataFrame) -> DataFrame:
    by_row = some.groupBy("key").agg(F.collect_list(F.struct("anchor", "at", "before", "after")).alias("listed"))
    return rows.select("key", "text").join(by_row, "key").mapInArrow(_context_rows, "anchor long, key long, at int, before int, bytes binary")


def deduplicated(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed, in bytes), kept_sha256 and kept_text of every row."""
    plan = plan or Plan()
    _check(plan)
    rows, scratch = keyed(docs.select("doc_id", "text")), Scratch(docs.sparkSession)
    shared, ones = _found(rows, plan, scratch)
    whole = shared.where("weight = 0 OR n > 1").select("key", (F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.col("after")).alias("end"))
    held = _contexts(rows, ones.where(F.col("kinds") <= plan.most_held)).repartition("anchor").sortWithinPartitions("anchor")
    spans = whole.union(held.mapInArrow(_span_rows(plan), "key long, start int, end int"))
    if not ones.where(F.col("kinds") > plan.most_held).isEmpty():
        digests = scratch.put(_contexts(rows, ones.where(F.col("kinds") > plan.most_held)).mapInArrow(_digest_rows(plan), "low long, high long, key long, start int").distinct())
        again = digests.groupBy("low", "high").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        spans = spans.union(digests.join(again, ["low", "high"]).select("key", "start", (F.col("start") + plan.length).alias("end")))
    by_row = spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    both = rows.join(by_row, "key", "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(_cut, f"doc_id {kind}, n_bytes long, n_removed long, spans array<array<long>>, kept_sha256 string, kept_text string")


def repeats(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """repeat (the SHA-256 of its bytes), length, doc_id and start of all occurrences of all repeats of an anchor's contexts that can't be extended to the left.

    Of contexts that recur as a whole, one stands for its copies. Anchors of over `most_held` contexts are left to `deduplicated`.
    """
    plan = plan or Plan()
    _check(plan)
    rows, scratch = keyed(docs.select("doc_id", "text")), Scratch(docs.sparkSession)
    _, ones = _found(rows, plan, scratch)
    held = _contexts(rows, ones.where(F.col("kinds") <= plan.most_held)).repartition("anchor").sortWithinPartitions("anchor")
    found = held.mapInArrow(_repeat_rows(plan), "repeat string, length long, key long, start long")
    return found.join(rows.select("key", "doc_id").distinct(), "key").select("repeat", "length", "doc_id", "start").distinct()


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
