import random
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from loomspark.llm.evaluate import held_out
from loomspark.llm.lang import train_languages
from loomspark.llm.reading import ALPHABET, HALF, ORDERS, _sentences, _words, pool_adjacent_violators, prose, reading_levels, word_surprisals

EASY = "the cat sat on a mat . we like it . it was big . they go out".split()
HARD = "notwithstanding heterogeneity substantiates longitudinal interpretations epistemological corroboration taxonomies presupposes juxtaposition".split()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(1, 5)), min_size=1, max_size=30))
def test_isotonic_regression(points):
    x, y = np.array([p[0] for p in points], float), np.array([p[1] for p in points], float)
    at, fit = pool_adjacent_violators(x, y)
    assert (np.diff(fit) > 0).all() and (np.diff(at) > 0).all()
    # Against the max-min formula.
    xs = np.unique(x)
    for k, v in enumerate(xs):
        want = max(min(y[(x >= xs[i]) & (x <= xs[j])].mean() for j in range(k, len(xs))) for i in range(k + 1))
        assert np.isclose(fit[np.searchsorted(at, v, "right") - 1], want)


def corpus(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(240):
        level = i % 5 + 1
        words = [rng.choice(HARD if rng.random() < (level - 1) / 4 else EASY) for _ in range(80)]
        rows.append((i, " ".join(words) + ".", "en"))
        if i % 2:
            labels.append((i, level if i % 11 else None, "r1"))
    rows += [(1000, None, None), (1001, "", "en"), (1002, " 123 ", "en"), (1003, "short", None), (1004, "cat " * 20_000, "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, level int, rater string")


def test_held_out_levels(spark):
    docs, labels = corpus(spark)
    model = train_languages(docs, "lang", "text")
    got = {r["doc_id"]: r for r in reading_levels(docs, labels, "doc_id", "text", model).collect()}
    assert len(got) == 245
    held = [(got[i]["level"], i % 5 + 1) for i in range(0, 240, 2)]
    assert np.mean([abs(a - b) for a, b in held]) < 0.6
    assert got[1000]["level"] is None and got[1001]["level"] is None and got[1002]["level"] is None and 1 <= got[1003]["level"] <= 5 and got[1004]["level"] is not None


def test_without_labels_or_rows(spark):
    docs, labels = corpus(spark)
    model = train_languages(docs, "lang", "text")
    assert {r["level"] for r in reading_levels(docs.where("doc_id < 3"), labels.where("false"), "doc_id", "text", model).collect()} == {3}
    assert reading_levels(docs.where("false"), labels, "doc_id", "text", model).count() == 0


def test_words_looked_up_and_joined_give_the_same(spark):
    docs, labels = corpus(spark)
    model = train_languages(docs, "lang", "text")
    one, other = (sorted((r["doc_id"], r["detected"], r["score"] and round(r["score"], 9), r["level"]) for r in reading_levels(docs, labels, "doc_id", "text", model, most).collect()) for most in (1 << 20, 0))
    assert one == other and len(one) == 245


def test_surprisal_against_brute_force(spark):
    words = {"cat": 30, "cap": 7, "a": 50, "juxtaposition": 1, "ねこ": 2}
    df = spark.createDataFrame([(0, w, n) for w, n in words.items()] + [(1, "cat", 5)], "lang int, word string, n long")
    got = {r["word"]: r["surprisal"] for r in word_surprisals(df).where("lang = 0").collect()}
    counts = [Counter() for _ in ORDERS]
    for w, n in words.items():
        s = " " * 5 + w + " "
        for i in range(4, len(s)):
            for k in range(5):
                counts[k][s[i - k : i + 1]] += n
    for w in words:
        s, total = " " * 5 + w + " ", 0.0
        for i in range(5, len(s)):
            p = (counts[0][s[i]] + 0.5) / (sum(counts[0].values()) + 0.5 * ALPHABET)
            for k in range(1, 5):
                context = counts[k - 1][s[i - k : i]]
                weight = context / (context + HALF)
                p = weight * min(counts[k][s[i - k : i + 1]] / max(context, 1), 1) + (1 - weight) * p
            total -= np.log2(p)
        assert np.isclose(got[w], total)


def test_prose_and_words():
    assert prose('<|turn>model\n{"a": "One two. Three", "b": ["four"]}').split() == ["One", "two.", "Three", "four"]
    assert _words("Das Café, 3 mal; 東京タワーへ行きました") == ["das", "café", "mal", "東京", "タワー", "へ", "行", "きました"]
    assert _sentences("One two. Three! 四。五") == [7, 5, 1, 1] and _sentences("") == [1]


def test_the_evaluation_script(spark):
    docs, labels = corpus(spark)
    found = held_out(docs, labels, "doc_id", "text", "lang")
    assert found["documents"] > 20 and found["error"] < 0.7 < found["constant_error"] and found["correlation"] > 0.8
