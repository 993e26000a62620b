import itertools
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm.forest import NARROW, Forest, candidates, links_between, links_within
from loomspark.llm.neardup import LEAST, PLAIN, THRESHOLD, WORDS as TOKEN, _signatures, duplicate_pairs, near_duplicate_classes, unpacked
from loomspark.llm.tokens import tokens
from loomspark.runtime import shared_dir, written

WORDS = [f"w{i}" for i in range(4000)]


def edited(rng, words):
    words = list(words)
    for _ in range(max(1, len(words) // 25)):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    if rng.random() < 0.5:
        k = rng.randrange(len(words))
        words = words[k:] + words[:k]
    return words


def corpus(seed, families=25, most=6):
    rng = random.Random(seed)
    rows = []
    for _ in range(families):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(30, 90))]
        rows.append(" ".join(base))
        rows += [" ".join(edited(rng, base)) for _ in range(rng.randrange(most))]
    rng.shuffle(rows)
    return list(enumerate(rows))


def shingles(text):
    words = tokens(text)
    return frozenset(zip(*[words[i:] for i in range(TOKEN)])) if len(words) >= TOKEN else frozenset([tuple(words)] if words else [])


def brute(rows, threshold=THRESHOLD):
    sets = {i: shingles(t) for i, t in rows if t is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i in sets:
        least[root(i)] = min(least.get(root(i), i), i)
    return {i: least[root(i)] for i in sets}


def classes(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "row long, text string, center long")
    return {r["row"]: r["class_row"] for r in near_duplicate_classes(df, "row", "text", **more).collect()}


@pytest.mark.parametrize("tile", [4096, 3])
def test_against_brute_force(spark, tile):
    rows = corpus(3)
    assert classes(spark, rows, tile=tile) == brute(rows)


def test_recall_of_links_against_brute_force(spark):
    """Pairs in no larger group, close to the threshold: nothing but their own tokens can find them."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        n = rng.choice((12, 30, 80, 200, 500))
        base = [rng.choice(WORDS) for _ in range(n)]
        near = list(base)
        at = rng.randrange(n)
        for k in range(int(rng.uniform(0.02, 0.42) * n)):
            near[(at + k) % n] = f"own{i}x{k}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
    want, got = brute(rows), classes(spark, rows)
    linked = {i for i, r in want.items() if i != r}
    found = {i for i, r in got.items() if i != r}
    # Tokens of 16 bits coincide now and then, which moves a pair at the very threshold.
    assert len(found - linked) <= 1 and len(linked - found) <= 0.005 * len(linked)


def test_hot_group_of_near_copies_in_small_tiles(spark):
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(60)]
    rows = [(i, " ".join(edited(rng, base))) for i in range(120)] + [(1000 + i, " ".join(rng.choice(WORDS) for _ in range(50))) for i in range(240)]
    assert classes(spark, rows, tile=10) == brute(rows)


@pytest.mark.parametrize("members, others", [(3, 220), (400, 500)])
def test_hot_groups(spark, members, others):
    """Each member has words of its own; what the members share is in up to half of the rows."""
    rng = random.Random(6)
    base = [rng.choice(WORDS) for _ in range(80)]

    def member(i):
        words = list(base)
        for run in range(2):
            at = rng.randrange(76)
            words[at : at + 4] = [f"own{i}x{run}{k}" for k in range(4)]
        return " ".join(words)

    rows = [(i, member(i)) for i in range(members)] + [(1000 + i, " ".join(rng.choice(WORDS) for _ in range(80))) for i in range(others)]
    assert classes(spark, rows) == brute(rows)


def test_fixed_wordings_link_nothing(spark):
    """Half of each text is the same in all of them."""
    rng = random.Random(8)
    head = [rng.choice(WORDS) for _ in range(40)]
    rows = [(i, " ".join(head + [rng.choice(WORDS) for _ in range(45)])) for i in range(300)]
    rows += [(1000 + i, rows[i][1].replace(" w", " v", 3)) for i in range(20)]
    assert classes(spark, rows, tile=64) == brute(rows)


def test_edited_copy_of_a_text_with_many_exact_copies(spark):
    rng = random.Random(7)
    base = [rng.choice(WORDS) for _ in range(80)]
    near = [f"own{k}" if k % 20 == 0 else w for k, w in enumerate(base)]
    rows = [(i, " ".join(base)) for i in range(300)] + [(500, " ".join(near))] + [(1000 + i, " ".join(rng.choice(WORDS) for _ in range(80))) for i in range(500)]
    df = spark.createDataFrame(rows, "row long, text string")
    got = {r["row"]: (r["class_row"], r["size"]) for r in near_duplicate_classes(df, "row", "text").collect()}
    assert got[500] == (0, 301)


def test_nulls_empty_blank_copies_and_long_texts(spark):
    long_ = " ".join(WORDS) * 5
    rows = [(1, None), (2, ""), (3, "  "), (4, "one two"), (5, " ONE  two"), (6, long_), (7, long_ + " x"), (8, "!!!"), (9, "こんにちは世界"), (10, "こんにちは世界")]
    df = spark.createDataFrame(rows, "row long, text string")
    got = {r["row"]: (r["class_row"], r["size"]) for r in near_duplicate_classes(df, "row", "text").collect()}
    assert 1 not in got and got[4] == got[5] == (4, 2) and got[6] == got[7] == (6, 2) and got[9] == got[10] == (9, 2)
    assert got[2] == got[3] == (2, 2) and got[8] == (8, 1)


def test_very_long_texts_are_told_apart(spark):
    """Their tokens would fill 16 bits."""
    rng = random.Random(9)
    long_ = [" ".join(f"{rng.randrange(10**9)}" for _ in range(n)) for n in (60_000, 60_000, 1_500, 2_500)]
    rows = [(i, t) for i, t in enumerate(long_)] + [(10, long_[0] + " more"), (11, long_[2] + " " + " ".join(f"x{k}" for k in range(900)))]
    assert classes(spark, rows) == {0: 0, 1: 1, 2: 2, 3: 3, 10: 0, 11: 2}


def test_no_rows(spark):
    df = spark.createDataFrame([], "row long, text string")
    assert near_duplicate_classes(df, "row", "text").count() == 0
    assert duplicate_pairs(spark.createDataFrame([], "row long, class_row long, size long"), "row").count() == 0


def _sets(rng, n, most=120):
    sigs = [np.unique(rng.integers(0, 400, rng.integers(1, most)).astype(np.uint32) << np.uint32(16)) for _ in range(n)]
    return sigs, np.concatenate(sigs), np.array([len(s) for s in sigs])


def _near(a, b, t):
    i = len(np.intersect1d(a, b))
    return i >= t * (len(a) + len(b) - i)


def test_traversal_prunes_nothing_that_qualifies():
    rng = np.random.default_rng(0)
    sigs, joined, sizes = _sets(rng, 200)
    block = np.repeat([0, 1, 2, 3], [120, 1, 9, 70])
    f = Forest(block, joined, sizes)
    kept = {frozenset((int(f.order[i]), int(f.order[j]))) for x, y in candidates(f, f, 0.3) for i, j in zip(x, y)}
    assert all(block[i] == block[j] for i, j in map(tuple, kept))
    for a, b in itertools.combinations(range(200), 2):
        if block[a] == block[b] and _near(sigs[a], sigs[b], 0.3):
            assert frozenset((a, b)) in kept


def test_links_span_the_components_of_each_block_and_between_forests():
    rng = np.random.default_rng(1)
    sigs, joined, sizes = _sets(rng, 160, 40)
    block = np.repeat([0, 1, 2], [100, 20, 40])

    def components(links, n):
        label = list(range(n))
        for i, j in links:
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
        return label

    true = [(i, j) for i, j in itertools.combinations(range(160), 2) if block[i] == block[j] and _near(sigs[i], sigs[j], 0.15)]
    got, _ = links_within(Forest(block, joined, sizes), block, 0.15)
    assert set(map(frozenset, got)) <= set(map(frozenset, true)) and components(got, 160) == components(true, 160)
    cut = 80
    a, b = Forest(np.zeros(cut, int), np.concatenate(sigs[:cut]), sizes[:cut], 4), Forest(np.zeros(160 - cut, int), np.concatenate(sigs[cut:]), sizes[cut:], 4)
    across = [(i, j) for i in range(cut) for j in range(cut, 160) if _near(sigs[i], sigs[j], 0.15)]
    got = [(i, j + cut) for i, j in links_between(a, b, 0.15)]
    assert set(got) <= set(across) and components(got, 160) == components(across, 160)


def test_production_links_come_from_node_pairs(spark, sf_dir, monkeypatch):
    """Without the traversal's node pairs there is no link at all but exact copies."""
    from loomspark.llm import forest

    rng = np.random.default_rng(2)
    sigs, joined, sizes = _sets(rng, 30, 20)
    monkeypatch.setattr(forest, "candidates", lambda *a, **k: iter(()))
    assert links_within(Forest(np.zeros(30, int), joined, sizes), np.zeros(30, int), 0.1)[0] == []
    assert 0 < LEAST < THRESHOLD


def test_sets_are_written_in_fewer_bytes_and_read_again():
    """16 bits a token, as before, would be 2 bytes each; sizes around the limits of the three ways to write a set."""
    rng = np.random.default_rng(3)
    sizes = np.array([0, 1, PLAIN, PLAIN + 1, 150, 0, 600, NARROW, NARROW + 1, 5000, 2])
    of = np.repeat(np.arange(len(sizes)), sizes)
    h = np.concatenate([rng.choice(1 << 16, n, replace=False) for n in sizes[:-3]] + [rng.choice(1 << 32, n, replace=False) for n in sizes[-3:]])
    h[:-7051] <<= 16
    h = h.astype(np.uint32)
    sigs = _signatures(h, of, len(sizes))
    got, n = unpacked(sigs)
    want = [np.sort(h[of == i] if k > NARROW else h[of == i] & np.uint32(0xFFFF0000)) for i, k in enumerate(sizes)]
    assert n.tolist() == sizes.tolist() and got.tolist() == np.concatenate(want).tolist()
    assert all(len(s) <= 0.7 * 2 * k for s, k in zip(sigs, sizes) if 100 < k <= NARROW)
    # The extremes of high and low bytes.
    ends = np.array([0, 1, 0x00FF, 0xFF00, 0xFFFF, *range(0x8000, 0x8028)], np.uint32) << np.uint32(16)
    assert unpacked(_signatures(ends, np.zeros(len(ends), int), 1))[0].tolist() == np.sort(ends).tolist()


def test_what_is_shuffled_follows_the_texts(spark):
    """Routing tokens are shuffled once, sets in few bytes: 4.5 bytes a word of these texts, where they were 5.8 before."""
    rng = random.Random(10)
    rows = []
    for i in range(700):
        base = [rng.choice(WORDS) for _ in range(150)]
        rows += [(3 * i + k, " ".join(edited(rng, base))) for k in range(3)]
    spark.createDataFrame(rows, "row long, text string").write.mode("overwrite").parquet(at := f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}")

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = shuffled()
    assert near_duplicate_classes(spark.read.parquet(written(at)), "row", "text").where("size > 1").count() == len(rows)
    assert 0 < shuffled() - before < 5.1 * 150 * len(rows)
