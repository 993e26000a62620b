import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from loomspark.llm import overlap
from loomspark.llm.overlap import EDITS, MATCHES, Q, SHORT, SPOILT, _bags, _cell, _probe, _signatures, _verify, aligned, banded_distances, class_overlaps, distances, kept_segments, split_overlaps
from tests.llm.test_neardup import WORDS


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), max_size=12), st.lists(st.integers(1, 4), max_size=12), st.integers(0, 6)), max_size=6))
def test_banded_distances(cases):
    pairs = [(np.array(a, np.uint16), np.array(b, np.uint16)) for a, b, _ in cases]
    limits = np.array([k for *_, k in cases], np.int64)
    got = banded_distances(pairs, limits)
    for (a, b), k, d in zip(pairs, limits, got):
        true = distance(a.tolist(), b.tolist())
        assert (d == true) if true <= k else d > k


def test_aligned_undoes_reordering():
    a = np.array([1, 2, 3, 0, 4, 5, 6, 0, 7, 8], np.uint16)
    b = np.array([7, 8, 0, 1, 2, 9, 0, 4, 5, 6], np.uint16)
    x, y = aligned(a, b)
    assert x.tolist() == [1, 2, 3, 4, 5, 6, 7, 8] and y.tolist() == [1, 2, 9, 4, 5, 6, 7, 8]


def texts(seed):
    rng = random.Random(seed)
    rows = []
    for f in range(40):
        lines = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(6, 14))) for _ in range(rng.randrange(4, 9))]
        rows.append((len(rows), False, "\n".join(lines)))
        kind = f % 4
        if kind == 0:
            rows.append((len(rows), True, "\n".join(lines)))
        elif kind == 1:
            rng.shuffle(lines)
            words = [x.split() for x in lines]
            words[0][2] = "edited"
            words[-1].append("added")
            rows.append((len(rows), True, "\n".join(" ".join(x) for x in words)))
        elif kind == 2:  # shares half of its entries only
            other = [" ".join(rng.choice(WORDS) for _ in range(10)) for _ in lines]
            rows.append((len(rows), True, "\n".join(lines[: len(lines) // 2] + other[len(lines) // 2 :])))
    return rows


def test_finds_what_was_planted(spark):
    rows = texts(1)
    df = spark.createDataFrame([(i, h, t, "x") for i, h, t in rows], "row long, held boolean, text string, digest string")
    got = {(r["held_row"], r["train_row"]) for r in split_overlaps(df, "row", "text", "held").collect()}
    want, f = set(), 0
    i = 0
    while i < len(rows):
        if f % 4 in (0, 1):
            want.add((i + 1, i))
        i += 1 if f % 4 == 3 else 2
        f += 1
    assert got == want


def test_hot_group_at_the_production_share(spark):
    """What the members share is frequent; each has rare tokens of its own, as many as the guarantee allows for two."""
    rng = random.Random(8)
    base = [rng.choice(WORDS) for _ in range(80)]

    def member(i):
        words = list(base)
        for k, at in enumerate(rng.sample(range(80), 4)):
            words[at] = f"own{i}x{k}"
        return " ".join(words)

    rows = [(i, i < 20, member(i)) for i in range(420)] + [(1000 + i, i % 5 == 0, " ".join(rng.choice(WORDS) for _ in range(80))) for i in range(500)]
    df = spark.createDataFrame(rows, "row long, held boolean, text string")
    got = {(r["held_row"], r["train_row"]) for r in split_overlaps(df, "row", "text", "held").collect()}
    assert got == {(i, j) for i in range(20) for j in range(20, 420)}


def test_short_texts_within_the_allowed_edits(spark):
    rng = random.Random(10)
    rows = []
    for i in range(120):
        n = (6, 20, 40, 60)[i % 4]
        base = [rng.choice(WORDS) for _ in range(n)]
        for held in (True, False):
            words = list(base)
            for k, at in enumerate(rng.sample(range(n), int(0.15 * n))):
                words[at] = f"own{i}x{k}{held}"
            rows.append((2 * i + (not held), held, " ".join(words)))
    df = spark.createDataFrame(rows, "row long, held boolean, text string")
    got = {(r["held_row"], r["train_row"]) for r in split_overlaps(df, "row", "text", "held").collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(120)}


def test_edits_in_all_rare_entries_of_a_text(spark):
    rng = random.Random(9)
    common = WORDS[:200]

    def wording():
        return "\n".join(" ".join(rng.choice(common) for _ in range(8)) for _ in range(10))

    rows = [(i, False, f"name{i} " + " ".join(f"n{i}x{k}" for k in range(11)) + "\n" + wording()) for i in range(1000)]
    rows += [(5000 + i, True, " ".join(f"m{i}x{k}" for k in range(12)) + "\n" + rows[i][2].split("\n", 1)[1]) for i in range(10)]
    df = spark.createDataFrame(rows, "row long, held boolean, text string")
    got = {(r["held_row"], r["train_row"]) for r in split_overlaps(df, "row", "text", "held").collect()}
    assert got == {(5000 + i, i) for i in range(10)}


def test_copies_nulls_and_blanks(spark):
    rows = [(1, False, "same text here now ok"), (2, False, "Same  text here now ok"), (3, True, "same text here now ok"), (4, True, "same text here now ok"), (5, None, "same text here now ok"), (6, True, None), (7, False, ""), (8, True, " "), (9, True, "other")]
    df = spark.createDataFrame(rows, "row long, held boolean, text string")
    got = {(r["held_row"], r["train_row"]) for r in split_overlaps(df, "row", "text", "held").collect()}
    assert got == {(3, 1), (3, 2), (4, 1), (4, 2), (8, 7)}


def test_every_evaluation_text_has_its_k_and_more_segments(spark):
    """k + 1 with one match to make; k + 2 as two must match."""
    rng = random.Random(12)
    rows = [(i, "\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 24))) for _ in range(rng.randrange(1, 30)))) for i in range(200)]
    coded = []
    for i, t in rows:
        seq = np.array([x for line in t.split("\n") for x in [*(1 + int(w[1:]) for w in line.split()), 0]][:-1], np.uint16)
        coded.append((i, bytearray(seq.tobytes()), int(np.count_nonzero(seq))))
    df = spark.createDataFrame(coded, "row long, seq binary, n int")
    segments = df.mapInArrow(_probe(True, Q, EDITS), "h long, row long, n int, off int")
    for matches in (1, MATCHES):
        kept = kept_segments(segments, segments.limit(0), EDITS, SPOILT, matches).groupBy("row", "n", "k", "need").count().collect()
        assert len(kept) == 200
        for r in kept:
            k = int(EDITS / (1 - EDITS) * r["n"] + 1e-9) if r["n"] <= SHORT else int(SPOILT * r["n"] + 1e-9)
            assert (r["k"], r["need"]) == (k, 1 if r["n"] <= SHORT else matches)
            assert r["count"] == k + r["need"] or r["n"] <= SHORT and r["count"] <= r["n"]


def test_recall_against_all_pairs(spark):
    """Spoilt segments up to the guarantee, wherever they are; entries moved."""
    rng = random.Random(13)
    rows = []
    for i in range(150):
        lines = [[rng.choice(WORDS) for _ in range(rng.randrange(8, 15))] for _ in range(rng.randrange(7, 20))]
        n = sum(map(len, lines))
        near = [list(x) for x in lines]
        for k in range(int(SPOILT * n)):
            x = rng.choice(near)
            x[rng.randrange(len(x))] = f"own{i}x{k}"
        rng.shuffle(near)
        rows += [(2 * i, True, "\n".join(map(" ".join, lines))), (2 * i + 1, False, "\n".join(map(" ".join, near)))]
    df = spark.createDataFrame(rows, "row long, held boolean, text string")
    got = {(r["held_row"], r["train_row"]) for r in split_overlaps(df, "row", "text", "held").collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(150)}


def test_long_strings_and_pairs_by_classes(spark):
    rng = random.Random(14)
    long_ = [rng.choice(WORDS) for _ in range(20_000)]
    near = list(long_)
    for k in range(300):
        near[rng.randrange(len(near))] = f"own{k}"
    rows = [(1, True, " ".join(long_)), (2, False, " ".join(near)), (3, False, " ".join(near)), (4, True, " ".join(long_)), (5, None, "x")]
    df = spark.createDataFrame(rows, "row long, held boolean, text string")
    pairs, classes = class_overlaps(df, "row", "text", "held")
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)]
    assert {(r["row"], r["class"]) for r in classes.collect()} == {(1, 1), (4, 1), (2, 2), (3, 2)}
    assert split_overlaps(df, "row", "text", "held").where(F.col("held_row") == 4).count() == 2


def test_no_rows(spark):
    assert split_overlaps(spark.createDataFrame([], "row long, held boolean, text string"), "row", "text", "held").count() == 0


def test_edits_scattered_over_all_segments(spark):
    """Up to the allowed edits, wherever they are: replaced, left out (so that lengths differ), and entries cut otherwise."""
    rng = random.Random(15)
    rows = []
    for i in range(60):
        n = (70, 100, 250, 300, 700)[i % 5]
        base = [rng.choice(WORDS) for _ in range(n)]
        near = list(base)
        kind = i // 5 % 3
        if kind == 0:
            for k, at in enumerate(range(0, n, 3 if i % 2 else 4)):
                if k < int(EDITS * n):
                    near[at] = f"own{i}x{k}"
        elif kind == 1:
            near = [w for at, w in enumerate(base) if at % 4]
        sides = [" ".join(base), ("\n" if kind == 2 else " ").join(near)]
        if i % 2:
            sides.reverse()
        rows += [(2 * i, True, sides[0]), (2 * i + 1, False, sides[1])]
    df = spark.createDataFrame(rows, "row long, held boolean, text string")
    got = {(r["held_row"], r["train_row"]) for r in split_overlaps(df, "row", "text", "held").collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(60)}


def test_edits_within_entries_too_unlike_to_be_ordered(spark):
    """The whole strings are near as they stand, though two entries that were written anew are no counterparts."""
    rng = random.Random(16)
    lines = [[rng.choice(WORDS) for _ in range(12)] for _ in range(9)]
    near = [[f"own{i}x{k}" for k in range(12)] if i in (1, 4, 7) else line for i, line in enumerate(lines)]
    df = spark.createDataFrame([(1, True, "\n".join(map(" ".join, lines))), (2, False, "\n".join(map(" ".join, near)))], "row long, held boolean, text string")
    assert [tuple(r) for r in split_overlaps(df, "row", "text", "held").collect()] == [(1, 2)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([0.1, EDITS, 0.6]), st.sampled_from([0, 5, 512]))
def test_no_pair_of_near_bags_is_lost(seed, edits, known):
    """Against all pairs of bags: each pair that may be within the edits comes from one cell, few others do."""
    rng = np.random.default_rng(seed)
    bases = [rng.integers(1, rng.integers(3, 4000), rng.integers(1, 1200)) for _ in range(6)]
    seqs = []
    for _ in range(80):
        seq = bases[rng.integers(6)].copy()
        seq[rng.random(len(seq)) < rng.random() * 0.7] = rng.integers(1, 60_000)
        seqs.append(np.insert(seq[rng.random(len(seq)) > rng.random() * 0.5], 0, 7).astype(np.uint16))
    held = rng.random(80) < 0.4
    frequent = np.sort(np.unique(_bags([s.tobytes() for s in seqs])[1])[:known])
    batch = pa.record_batch([pa.array(range(80), pa.int64()), pa.array(held), pa.array([s.tobytes() for s in seqs]), pa.array([len(s) for s in seqs], pa.int32())], names=["row", "held", "seq", "n"])
    table = pa.Table.from_batches(_signatures(frequent, edits)([batch]))
    got = []
    for level in set(table.column("level").to_pylist()):
        found = _cell(edits)(table.filter(pc.equal(table.column("level"), level)))
        got += zip(found.column("held").to_pylist(), found.column("train").to_pylist())
    assert len(got) == len(set(got))
    bags = [Counter(s.tolist()) for s in seqs]
    for i in np.flatnonzero(held):
        for j in np.flatnonzero(~held):
            longer = max(len(seqs[i]), len(seqs[j]))
            assert longer - (bags[i] & bags[j]).total() > int(edits * longer) or (i, j) in got


def test_blocks_of_both_sides_meet_once(spark, monkeypatch):
    """Many blocks, as of large tables, give what one does."""
    rows = texts(3)
    df = spark.createDataFrame(rows, "row long, held boolean, text string")
    want = {tuple(r) for r in split_overlaps(df, "row", "text", "held").collect()}
    monkeypatch.setattr(overlap, "BLOCK_BYTES", 1000)
    assert want and {tuple(r) for r in split_overlaps(df, "row", "text", "held").collect()} == want


def edited(rng, n, edits):
    """A sequence and another of it by so many edits of all kinds."""
    a = [rng.randrange(1, 300) for _ in range(n)]
    b = list(a)
    for _ in range(edits):
        at = rng.randrange(len(b) + 1)
        b[at : at + rng.randrange(2)] = [rng.randrange(1, 300)] * rng.randrange(2)
    return np.array(a, np.uint16), np.array(b, np.uint16)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([0, 3, 100, 1024]), st.sampled_from([1, 3000, 2**18]))
def test_distances(seed, whole, bits):
    """Of lengths about a word's 64 bits, by bits and by bands, alone and many together, on both sides of the limits."""
    rng = random.Random(seed)
    pairs = [edited(rng, rng.choice([0, 1, 2, 30, 63, 64, 65, 127, 128, 129, 150]), rng.choice([0, 1, 5, 20, 60])) for _ in range(12)]
    true = [distance(a.tolist(), b.tolist()) for a, b in pairs]
    limits = np.array([max(0, d + rng.choice([-20, -1, 0, 1, 20])) for d in true], np.int64)
    was = overlap.WHOLE, overlap.BITS
    overlap.WHOLE, overlap.BITS = whole, bits
    try:
        got = distances(pairs, limits)
    finally:
        overlap.WHOLE, overlap.BITS = was
    assert all(x == d if d <= k else x > k for x, d, k in zip(got, true, limits))


def test_distances_cost_a_fraction_of_bands():
    """For texts of usual lengths, a third of them edited, which need the widest bands."""
    rng = random.Random(17)
    pairs = [edited(rng, n, n // 2) for n in [rng.randrange(80, 270) for _ in range(600)]]
    limits = np.array([int(EDITS * max(len(a), len(b))) for a, b in pairs], np.int64)

    def seconds(f):
        began = time.thread_time()
        return f(pairs, limits), time.thread_time() - began

    (got, fast), (want, slow) = min((seconds(distances) for _ in range(3)), key=lambda x: x[1]), seconds(banded_distances)
    assert ((got <= limits) == (want <= limits)).all() and (got <= limits).any() and not (got <= limits).all()
    assert 3 * fast < slow


def test_verification_by_all_pairs(monkeypatch):
    """Pairs within the edits, as they stand or with their entries in order, and no others; bands aren't needed."""
    rng = random.Random(18)
    pairs = []
    for i in range(90):
        entries = [[rng.randrange(1, 60) for _ in range(rng.randrange(1, 14))] for _ in range(rng.randrange(1, 12))]
        share = (0.1, 0.3, 0.4, 0.6)[i // 2 % 4]
        near = [[rng.randrange(1, 60) if rng.random() < share else c for c in e] for e in entries]
        if i % 2:
            rng.shuffle(near)
        pairs.append([np.array([c for e in x for c in [*e, 0]][:-1], np.uint16) for x in (entries, near)])
    want = []
    for a, b in pairs:
        limit = int(EDITS * max(np.count_nonzero(a), np.count_nonzero(b)))
        want.append(min(distance(a[a != 0].tolist(), b[b != 0].tolist()), distance(*(x.tolist() for x in aligned(a, b)))) <= limit)
    monkeypatch.setattr(overlap, "_banded", None)
    monkeypatch.setattr(overlap, "VERIFIED", 1000)
    n = [pa.array([np.count_nonzero(x) for x in side], pa.int32()) for side in zip(*pairs)]
    seqs = [pa.array([x.tobytes() for x in side], pa.binary()) for side in zip(*pairs)]
    ids = pa.array(range(90), pa.int64())
    got = [i for b in _verify(EDITS)([pa.record_batch([ids, ids, *seqs, *n], names=["held", "train", "seq_held", "seq_train", "n_held", "n_train"])]) for i in b.column(0).to_pylist()]
    assert got == [i for i, w in enumerate(want) if w] and 10 < len(got) < 80
