import random
import re

import numpy as np
import pytest

from nearfield.llm import jaccard_join as j


def shingles(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, part=85, whole=100):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if whole * common >= part * (len(sets[a]) + len(sets[b]) - common):
                    up[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.joined(df, **options).collect()), key=str)
    assert found == brute(rows, **options)


def chains(seed):
    """Chains and stars of edited copies around the threshold, of many sizes, and a passage that many texts share."""
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefghij") + str(draw.randrange(3000))
    rows, passage = [], [word() for _ in range(40)]
    for size in (4, 5, 6, 8, 9, 12, 15, 20, 30, 50, 80, 130, 200, 420):
        base = [word() for _ in range(size + 3)]
        for k in range(8):
            text = base[:]
            for _ in range(draw.randrange(1 + max(1, size // 40))):
                at = draw.randrange(len(text))
                text[at : at + draw.randrange(2)] = [word() for _ in range(draw.randrange(3))]
            if k % 3 == 0:
                base = text
            rows.append(text)
    rows += [[*passage, *(word() for _ in range(draw.randrange(4, 24)))] for _ in range(60)]
    rows += [r for r in rows[::9]]
    draw.shuffle(rows)
    return [(7 * i % 1009, " ".join(r)) for i, r in enumerate(rows)]


def test_brute_force_chains(spark):
    check(spark, chains(1))


def test_brute_force_tables(spark, cases):
    check(spark, [(r.doc_id, r.text) for r in cases.collect()])


def test_empty(spark):
    check(spark, [])
    check(spark, [(1, None), (2, ""), (3, None)])


@pytest.mark.parametrize("part, whole", [(85, 100), (80, 100), (60, 100)])
def test_every_link_shares_a_block(part, whole):
    """Index lists alone: any linked pair of different sets meets in a list, within a gap that isn't cut."""
    limits, draw = j.Limits(part, whole), np.random.default_rng(5)
    for _ in range(300):
        size = int(draw.integers(2, 200))
        a = np.unique(draw.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[draw.random(len(a)) < 0.92], draw.integers(0, 1 << 63, int(draw.integers(0, 1 + size // 8))).astype(np.uint64)]))
        common, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if not len(b) or whole * common < part * union or common == union:
            continue
        first = np.array([0, len(a), len(a) + len(b)])
        lists, of, position = j.list_entries(np.concatenate([a, b]), first, limits)
        order = np.lexsort((position, lists))
        found = j.blocks_of(lists[order], position[order], np.diff(first)[of[order]], of[order], limits)
        assert len(found[0])


@pytest.mark.parametrize("part, whole", [(85, 100), (80, 100)])
def test_links_of_sets_with_few_and_with_enough_filled_parts_share_a_block(part, whole):
    """Sizes across class bounds, hashes of all 64 bits, similarities from the threshold on."""
    limits, draw = j.Limits(part, whole), np.random.default_rng(7)
    mixed = 0
    for bound in (62, 94, 141, 211, 316, 474, 711, 1066):
        for _ in range(150):
            small = int(bound * draw.uniform(0.85, 1.12))
            large = int(small * draw.uniform(1, whole / part))
            least = -(-part * (small + large) // (whole + part))  # elements in common of a pair that just links
            common = min(small, least + int(draw.integers(0, 1 + small // 20)))
            if common < least:
                continue
            drawn = np.unique(draw.integers(0, 1 << 64, small + large - common, dtype=np.uint64))
            draw.shuffle(drawn)
            a, b = np.sort(drawn[:small]), np.sort(np.append(drawn[:common], drawn[small:]))
            overlap = len(np.intersect1d(a, b))
            assert whole * overlap >= part * len(np.union1d(a, b))
            if overlap == len(a) == len(b):
                continue
            lists, of, position = j.list_entries(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), limits)
            order = np.lexsort((position, lists))
            found = j.blocks_of(lists[order], position[order], np.array([len(a), len(b)])[of[order]], of[order], limits)
            assert len(found[0]), (len(a), len(b), overlap)
            bounds, differ, parts = limits.classes(len(b))
            level = np.searchsorted(bounds, len(b), "right") - 1
            filled = [len(np.unique((x >> np.uint64(32)) * np.uint64(parts[level]) >> np.uint64(32))) for x in (a, b)]
            mixed += (filled[0] > differ[level]) != (filled[1] > differ[level])
    assert part != 80 or mixed > 50


def edited_copies(seed, copies=260):
    """Near copies of one text, few of which link directly: edits come from a small pool, so that copies share some; cut copies; a passage in unrelated texts."""
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefghij") + str(draw.randrange(100000))
    base = [word() for _ in range(90)]
    pool = [(draw.randrange(90), word()) for _ in range(40)]
    rows = []
    for _ in range(copies):
        text = base[:]
        for at, new in draw.sample(pool, draw.randrange(8)):
            text[at] = new if draw.random() < 0.8 else word()
        if draw.random() < 0.3:
            text = text[: draw.randrange(60, 91)]
        if draw.random() < 0.1:
            text += [word() for _ in range(draw.randrange(20))]
        rows.append(text)
    passage = [word() for _ in range(25)]
    for _ in range(120):
        rows.append([*(word() for _ in range(draw.randrange(30))), *passage, *(word() for _ in range(draw.randrange(30)))])
        if draw.random() < 0.3:
            rows.append([*rows[-1][:-1], word()])
    draw.shuffle(rows)
    return [(5 * i % 1013, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("options", [{}, {"part": 80}, {"part": 60}], ids=["85", "80", "60"])
def test_brute_force_edited_copies(spark, options, monkeypatch):
    monkeypatch.setattr(j, "SHARE", 7)
    monkeypatch.setattr(j, "TILE", 5)
    check(spark, edited_copies(3), **options)


def test_long_lists_are_cut_into_the_same_blocks(monkeypatch):
    """Streamed with little held: every pair that shared a block shares one still, and no other does."""
    import pyarrow as pa

    draw, limits = np.random.default_rng(2), j.Limits(85, 100)
    lists = np.sort(draw.integers(0, 6, 3000))
    position = draw.integers(0, 400, 3000) * 3
    order = np.lexsort((position, lists))
    rows = [lists[order], position[order], np.full(3000, 60), draw.permutation(3000)]

    def together(held, size):
        monkeypatch.setattr(j, "HELD", held)
        batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + size]) for x in rows], names=["list", "position", "size", "class"]) for i in range(0, 3000, size)]
        blocks = {}
        for out in j._blocks(limits)(iter(batches)):
            for block, one in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
                blocks.setdefault(block, set()).add(one)
        return {frozenset(b) for b in blocks.values()}

    whole = together(1 << 18, 3000)
    assert len(whole) > 6
    for held, size in ((20, 7), (20, 500), (3, 1), (300, 64)):
        assert together(held, size) == whole


@pytest.mark.parametrize("shares", [1, 3])
def test_what_many_members_have_alike_brings_no_pairs_together(spark, shares):
    """Members far from their pivot that share a passage and a gap, and little else: only the two that link are compared, not all pairs."""
    from nearfield.llm.tables import Scratch

    draw, limits = np.random.default_rng(11), j.Limits(80, 100)
    drawn = lambda n: draw.integers(0, 1 << 64, n, dtype=np.uint64)
    pivot, passage = drawn(3000), drawn(300)
    sets = [np.concatenate([pivot[300:], passage, drawn(400)]) for _ in range(30)]
    sets.append(np.append(sets[0][:-20], drawn(20)))
    rows = [(7, s, shares, 7, np.sort(pivot).tobytes()) for s in range(shares)]
    rows += [(7, i % shares, shares, 100 + i, np.sort(s).tobytes()) for i, s in enumerate(sets)]
    asked = spark.createDataFrame(rows, "pivot long, share long, shares long, class long, elements binary").coalesce(1).sortWithinPartitions("share", "class")
    found = asked.mapInArrow(j._answers(limits), "pivot long, share long, shares long, class long, pivot_size long, size long, near boolean, more array<long>, less array<long>, far boolean, whole boolean").cache()
    assert found.where("far AND near IS NOT NULL").count() == 31
    labels = spark.createDataFrame([], "node long, label long")
    pairs = j.candidates(found, labels, limits, Scratch(spark)).collect()
    assert [(r.a, r.b) for r in pairs] == [(100, 130)]
    assert [(r.a, r.b) for r in j.derived(found, labels, limits, Scratch(spark)).collect()] == [(100, 130)]


@pytest.mark.parametrize("counted, tally", [(50, 1 << 12), (1 << 21, 3)])
def test_brute_force_edited_copies_with_partial_tallies(spark, counted, tally, monkeypatch):
    monkeypatch.setattr(j, "COUNTED", counted)
    monkeypatch.setattr(j, "TALLY", tally)
    check(spark, edited_copies(4), part=80)
