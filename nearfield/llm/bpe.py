"""Byte-level BPE encoding and decoding with a public vocabulary file, in batched numpy merge rounds.

`Vocabulary` reads a tokenizer file once, on the driver, into flat arrays of bounded size that tasks
share by broadcast. A task splits texts into words, and encodes the words it hasn't met yet together:
the symbols of all words stand in one flat array; each round looks every neighbouring pair up by
binary search in the sorted pair keys, finds each word's lowest rank, and merges that pair wherever
it stands in the word, until no word has a pair left. Known words are kept in a table of bounded size.

Merging all of a word's lowest pairs at once equals merging them one by one, as a pair that
contains a merged symbol always has a higher rank than the merge that made it.

Defined results: a null or empty text has no ids and decodes to an empty text; special tokens in a
text become their ids; rows are independent, so null or repeated identifiers, repeated rows and
empty tables need no care. A word of over LONG_WORD symbols is merged by a queue instead of rounds,
with the same result and in time near its length. Other columns are kept only if asked for.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .flat import column, gathered, slices
from .tables import table

LONG_WORD = 2000
MOST_WORDS = 200_000
#: The splitting pattern of byte-level BPE, with the characters of Unicode's White_Space written out.
SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: The same for texts below U+0250, for the standard library's faster matcher.
LATIN, NUMBERS, BLANKS = r"A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\u024F", r"0-9\xB2\xB3\xB9\xBC-\xBE", r"\t-\r \x85\xA0"
LATIN_PATTERN = rf"'(?:[stmd]|re|ve|ll)| ?[{LATIN}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LATIN}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
NONE = np.int64(1 << 60)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """A byte-level BPE vocabulary as flat arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"] or not pre.get("use_regex", True):
            raise ValueError("only byte-level BPE vocabularies without a normaliser are known")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take in their neighbours aren't known")
        vocab, letters = model["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = {i: bytes(letters[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        n = max(pieces) + 1
        self.bytes, self.byte_ends = _table([pieces.get(i, b"") for i in range(n)])
        self.of_byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of pairs of symbols; NONE if they don't merge."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    @functools.cached_property
    def by_pair(self) -> dict[int, int]:
        """The rank of each pair that merges."""
        return dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    def decode(self, ids: np.ndarray) -> bytes:
        return gathered(self.bytes, self.byte_ends, ids)[0].tobytes()


def _table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum([len(p) for p in pieces], out=ends[1:])
    return np.frombuffer(b"".join(pieces), np.uint8), ends


def merged_by_queue(vocabulary: Vocabulary, symbols: list[int]) -> list[int]:
    """The symbols of one long word after all merges, lowest rank and leftmost first."""
    rank, made, n = vocabulary.by_pair, vocabulary.made, len(symbols)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    queue = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get(symbols[i] << 32 | symbols[i + 1])) is not None]
    heapq.heapify(queue)
    while queue:
        r, i, left, right = heapq.heappop(queue)
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:
            continue
        symbols[i], symbols[j] = int(made[r]), -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (r := rank.get(symbols[a] << 32 | symbols[b])) is not None:
                heapq.heappush(queue, (r, a, symbols[a], symbols[b]))
    return [s for s in symbols if s >= 0]


def merged_in_rounds(vocabulary: Vocabulary, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words given as bytes, one word after another, and where each word's ids end (from 0)."""
    n = len(ends) - 1
    symbols, word = vocabulary.of_byte[data], np.repeat(np.arange(n), np.diff(ends))
    ranks = np.full(len(symbols), NONE)  # of each symbol with the next one of its word
    inner = np.flatnonzero(word[1:] == word[:-1])
    ranks[inner] = vocabulary.rank(symbols[inner], symbols[inner + 1])
    done_symbols, done_words = [], []
    while len(symbols):
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        sizes = np.diff(np.append(starts, len(symbols)))
        lowest = np.repeat(np.minimum.reduceat(ranks, starts), sizes)
        active = lowest < NONE
        if not active.all():
            done_symbols.append(symbols[~active])
            done_words.append(word[~active])
        at = np.flatnonzero((ranks == lowest) & active)
        if not len(at):
            break
        # of pairs that overlap, every second one, from the left
        close = np.append(False, np.diff(at) == 1)
        if close.any():
            run_start = at[np.maximum.accumulate(np.where(close, 0, np.arange(len(at))))]
            at = at[(at - run_start) % 2 == 0]
        symbols[at] = vocabulary.made[ranks[at]]
        active[at + 1] = False
        place = np.cumsum(active) - 1
        symbols, word, ranks = symbols[active], word[active], ranks[active]
        at = place[at]
        touched = np.zeros(len(symbols) + 1, bool)
        touched[at] = touched[at - 1] = True
        changed = np.flatnonzero(touched[:-1])
        ranks[changed] = NONE
        changed = changed[changed + 1 < len(symbols)]
        changed = changed[word[changed] == word[changed + 1]]
        ranks[changed] = vocabulary.rank(symbols[changed], symbols[changed + 1])
    words = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
    ids = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
    order = np.argsort(words, kind="stable")
    return ids[order], np.searchsorted(words[order], np.arange(n + 1))


class Encoder:
    """Encodes texts, keeping the ids of the words it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split_any, self.split_latin = regex.compile(PATTERN).findall, re.compile(LATIN_PATTERN).findall
        self.beyond_latin = re.compile("[^\\x00-\\u024F]").search
        self.cut = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(vocabulary.special, key=len, reverse=True))) if vocabulary.special else None
        self.forget()

    def split(self, text: str) -> list[str]:
        return self.split_any(text) if self.beyond_latin(text) else self.split_latin(text)

    def forget(self) -> None:
        self.known: dict = {}
        self.ids, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _add(self, words: list, ids: np.ndarray, ends: np.ndarray) -> None:
        self.known |= zip(words, range(len(self.known), len(self.known) + len(words)), strict=True)
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends[1:]])

    def learn(self, words: set) -> None:
        """Encodes the words that aren't known yet."""
        new = sorted(words - self.known.keys())
        pieces = [w.encode() for w in new]
        short = [i for i, p in enumerate(pieces) if len(p) <= LONG_WORD]
        self._add([new[i] for i in short], *merged_in_rounds(self.vocabulary, *_table([pieces[i] for i in short])))
        for i, p in enumerate(pieces):
            if len(p) > LONG_WORD:
                ids = merged_by_queue(self.vocabulary, self.vocabulary.of_byte[np.frombuffer(p, np.uint8)].tolist())
                self._add([new[i]], np.array(ids), np.array([0, len(ids)]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after another, and where each text's ids end (from 0)."""
        words, ends, marks = [], [0], []
        for text in texts:
            if self.cut and "<" in text and (parts := self.cut.split(text))[1:]:
                for part in parts:
                    if part in self.vocabulary.special:
                        marks.append((len(words), part))
                        words.append("")
                    elif part:
                        words += self.split(part)
            else:
                words += self.split(text)
            ends.append(len(words))
        new = set(words)
        if len(self.known) + len(new) > MOST_WORDS:
            self.forget()
        self.learn(new)
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        ids, word_ends = gathered(self.ids, self.ends, index)
        if marks:
            at = word_ends[[i for i, _ in marks]]
            extra = np.zeros(len(words) + 1, np.int64)
            extra[[i + 1 for i, _ in marks]] = 1
            ids = np.insert(ids, at, [self.vocabulary.special[t] for _, t in marks])
            word_ends = word_ends + np.cumsum(extra)
        return ids, word_ends[ends]


def encoded(docs: DataFrame, path: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns to keep (doc_id if not given) and ids, an array of integers, of every row's whole text."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(len(keep))
            for first, end, _, _ in slices(texts):
                ids, ends = encoder.encode([x or "" for x in texts[first:end].to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[first:end] for i in range(len(keep))), lists], names=[*keep, "ids"])

    read = docs.select(*keep, F.col(text).alias("_text"))
    return read.mapInArrow(run, ", ".join([*(f"`{c}` {read.schema[c].dataType.simpleString()}" for c in keep), "ids array<int>"]))


def decoded(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns and decoded, the text of the ids; bytes that aren't UTF-8 become U+FFFD."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            lists = column(batch, ids)
            lists = lists.fill_null([]) if lists.null_count else lists
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            texts = [vocabulary.decode(flat[a:b]).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(run, _with(df, "decoded string"))


def coded(docs: DataFrame, path: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """As `encoded`, and decoded, the text of the ids, in one pass."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(len(keep))
            for first, end, _, _ in slices(texts):
                ids, ends = encoder.encode([x or "" for x in texts[first:end].to_pylist()])
                back = [encoder.vocabulary.decode(ids[a:b]).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[first:end] for i in range(len(keep))), lists, pa.array(back, pa.string())], names=[*keep, "ids", "decoded"])

    read = docs.select(*keep, F.col(text).alias("_text"))
    return read.mapInArrow(run, ", ".join([*(f"`{c}` {read.schema[c].dataType.simpleString()}" for c in keep), "ids array<int>, decoded string"]))


def _with(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), more])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them."""
    return coded(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
