"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark, one scan of each text.

Texts are normalised as bytes: A-Z lowered, every run of other separators one space, and cut into words.
The benchmark's words are numbered, and the automaton reads word numbers; the words of a document that the
benchmark doesn't have are one number that leads back to its root. Its patterns are every second half window of
each item, as any window holds one of those whole: a node for each word of the benchmark. The windows of a document around what it
finds are looked up by their hashes among the different windows of the items and compared word by word, so a text costs time in line
with its length, however repetitive it and the items are.
Occurrences are mapped back through word numbers to code-point offsets of the original text.

A worker builds the automaton once and keeps it for all its tasks. It holds the benchmark only; one of over
`block_bytes` of text is dealt into blocks with an automaton each. One block is the usual case.

Defined results: null texts and items have no words; an item of fewer words than a window is one
window, one of none has no window; equal windows of several items count for each of them; repeated
rows and null identifiers are carried through row by row; null item_ids are left out of the item
list but their windows hit; empty tables give empty or clean results.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .flat import ALNUM, LOWER, U64, column, slices, window_hashes, words
from .tables import packed, table, unpacked

NORMAL = bytes(LOWER[i] if ALNUM[LOWER[i]] else 32 for i in range(256))


def normal_words(text: str | None) -> list[str]:
    """The words of a text, each byte one character."""
    return [w for w in (text or "").encode().translate(NORMAL).decode("latin-1").split(" ") if w]


class Scanner:
    """The windows of some items: an automaton over word numbers, and the different windows by hash."""

    def __init__(self, items: list[tuple[str | None, str]], length: int):
        self.length, self.half, self.numbers = length, (length + 1) // 2, {}
        self.names = [item for item, _ in items]
        numbered = [np.array([self.numbers.setdefault(x, len(self.numbers) + 1) for x in normal_words(text)], np.int64) for _, text in items]
        whole: dict[tuple, set[int]] = defaultdict(set)  # items of fewer words than a window
        halves: set[tuple] = set()
        for i, w in enumerate(numbered):
            if len(w) >= length:
                halves.update(tuple(w[at : at + self.half].tolist()) for at in range(0, len(w) - self.half + 1, self.half))
            elif len(w):
                whole[tuple(w.tolist())].add(i)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if whole or halves else None
        for w in halves | set(whole):
            self.automaton.add_word(w, (len(w), w in halves, tuple(sorted(whole.get(w, ())))))
        if self.automaton is not None:
            self.automaton.make_automaton()
        self._index([(i, w) for i, w in enumerate(numbered) if len(w) >= length])

    def _index(self, long: list[tuple[int, np.ndarray]]) -> None:
        """flat: the words of all longer items. hashes, places, ends, owners: of the different windows in order of hash, where one stands, and the items that have it."""
        length = self.length
        self.flat = np.concatenate([w for _, w in long]) if long else np.zeros(0, np.int64)
        sizes = np.array([len(w) for _, w in long], np.int64)
        firsts = np.cumsum(sizes) - sizes
        counts = sizes - length + 1
        at = np.arange(counts.sum()) + np.repeat(firsts - (np.cumsum(counts) - counts), counts)
        own = np.repeat(np.array([i for i, _ in long], np.int64), counts)
        hashes = window_hashes(self.flat.astype(U64), at, length)
        order = np.lexsort((own, hashes))
        hashes, at, own = hashes[order], at[order], own[order]
        fresh = np.ones(len(at), bool)
        if len(at):
            fresh[1:] = (hashes[1:] != hashes[:-1]) | ~self._same(self.flat, at[1:], self.flat, at[:-1])
        self.hashes, self.places = hashes[fresh], at[fresh]
        group = np.cumsum(fresh) - 1
        once = np.ones(len(at), bool)
        once[1:] = (group[1:] != group[:-1]) | (own[1:] != own[:-1])
        self.owners = own[once]
        self.ends = np.searchsorted(group[once], np.arange(len(self.places) + 1))

    def _same(self, a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray) -> np.ndarray:
        out = np.ones(len(at), bool)
        for i in range(self.length):
            out &= a[at + i] == b[bt + i]
        return out

    def hits(self, words_: list[str]) -> tuple[list[list[int]], set[str | None]]:
        """The stretches of a document that windows cover, and the items that these are of."""
        if self.automaton is None or not words_:
            return [], set()
        get, marks, ranges, seen = self.numbers.get, [], [], set()
        text = tuple([get(w, 0) for w in words_])
        for last, (size, is_half, items) in self.automaton.iter(text):
            if is_half:
                marks.append(last + 1 - size)
            if items:
                ranges.append([last + 1 - size, last + 1])
                seen.add(items)
        found = {i for items in seen for i in items}
        if marks and len(text) >= self.length:
            flat, marks = np.array(text, np.int64), np.array(marks)
            steps = np.zeros(len(text) + 1, np.int64)
            np.add.at(steps, np.maximum(marks - (self.length - self.half), 0), 1)
            np.add.at(steps, marks + 1, -1)
            at = np.flatnonzero(np.cumsum(steps)[: len(text) - self.length + 1] > 0)
            hashes = window_hashes(flat.astype(U64), at, self.length)
            place = np.searchsorted(self.hashes, hashes)
            hit = np.zeros(len(at), bool)
            while True:  # once, but for windows whose hashes clash
                near = np.flatnonzero(~hit & (place < len(self.hashes)))
                near = near[self.hashes[place[near]] == hashes[near]]
                if not len(near):
                    break
                good = near[self._same(flat, at[near], self.flat, self.places[place[near]])]
                hit[good] = True
                place[near[~hit[near]]] += 1
            for p in np.unique(place[hit]).tolist():
                found.update(self.owners[self.ends[p] : self.ends[p + 1]].tolist())
            ranges += [[a, a + self.length] for a in at[hit].tolist()]
        return merged(ranges), {self.names[i] for i in found}


_scanners: dict[tuple[str, int], Scanner] = {}


def _kept(shared, name: str, length: int) -> Scanner:
    """The worker's scanner of a broadcast block, which has a name of its own."""
    key = (name, length)
    if key not in _scanners:
        while len(_scanners) > 1:
            _scanners.pop(next(iter(_scanners)))
        _scanners[key] = Scanner(shared.value, length)
    return _scanners[key]


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """Item texts in blocks of bounded size, read one after another."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text IS NOT NULL").toLocalIterator():
        if block and size + len(row.text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.item, row.text))
        size += len(row.text)
    yield block


def _scanner(shared, name: str, length: int, key_columns: int):
    """Adds hits of one block of items: item ids and covered word ranges, to those of earlier blocks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _kept(shared, name, length)
        for batch in batches:
            items_before, ranges_before = column(batch, "_items").to_pylist(), column(batch, "_ranges").to_pylist()
            items, ranges, n_words, row = [], [], [], 0
            for _, _, data, offsets in slices(column(batch, "text")):
                flat = data.tobytes().translate(NORMAL).decode("latin-1")
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    w = flat[a:b].split(" ")
                    w = [x for x in w if x]
                    n_words.append(len(w))
                    covered, names = scanner.hits(w)
                    items.append(sorted({*items_before[row], *names} - {None}))
                    ranges.append(merged(ranges_before[row] + covered) if ranges_before[row] else covered)
                    row += 1
            kept = [batch.column(i) for i in range(key_columns)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(ranges, pa.list_(pa.list_(pa.int64())))], names=[*batch.schema.names[:key_columns], "_n_words", "_items", "_ranges"])

    return scan


def merged(ranges: list[list[int]]) -> list[list[int]]:
    """Sorted, overlapping and touching ranges joined."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """The columns to keep (doc_id if not given), text, _n_words, _items and _ranges (of word numbers, end exclusive) of every row."""
    keep = [c for c in (["doc_id"] if keep is None else keep) if c != "text"]
    context = docs.sparkSession.sparkContext
    out = docs.select(*keep, "text", F.lit(0).cast("long").alias("_n_words"), F.array().cast("array<string>").alias("_items"), F.array().cast("array<array<long>>").alias("_ranges"))
    for block in blocks(benchmark, block_bytes):
        out = out.mapInArrow(_scanner(context.broadcast(block), uuid.uuid4().hex, window, len(keep) + 1), out.schema)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no window of the benchmark, with the columns they came with."""
    return unpacked(contamination(packed(docs), benchmark, ["_row"]).where(F.size("_ranges") == 0), docs)


def original_spans(text: str, ranges: list[list[int]]) -> list[list[int]]:
    """Code-point offsets of word ranges in the text as it was."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = words(LOWER[data], np.array([0, len(data)]), ALNUM)
    code_points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [[int(code_points[starts[a]]), int(code_points[ends[b - 1]])] for a, b in ranges]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, items, ranges = (column(batch, c) for c in ("text", "_items", "_ranges"))
        ranges = ranges.to_pylist()
        spans = [original_spans(texts[i].as_py(), r) if r else [] for i, r in enumerate(ranges)]
        ids = items.to_pylist()
        columns = [
            batch.column(0), column(batch, "_n_words"), pa.array([sum(b - a for a, b in r) for r in ranges], pa.int64()), pa.array(map(len, ids), pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids], pa.string()), pa.array([bool(r) for r in ranges], pa.bool_()), pa.array(spans, pa.list_(pa.list_(pa.int64()))),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    kind = found.schema["doc_id"].dataType.simpleString()
    rows = found.mapInArrow(_summed, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<long>>")
    return rows.drop("spans")
