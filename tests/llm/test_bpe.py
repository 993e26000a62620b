import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from loomspark.llm.bpe import PATTERN, Counter, Encoder, Vocabulary


@pytest.fixture(scope="module")
def tools():
    v = Vocabulary()
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=v.rank, special_tokens={})
    return Counter(v), Encoder(v), enc.encode_ordinary


def same(tools, texts):
    counter, encoder, public = tools
    ids, offsets = encoder.batch(texts)
    for i, t in enumerate(texts):
        want = public(t) if t else []
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want, t[:80]
        assert (counter.text(t) if t else 0) == len(want)


def test_fixed_texts(tools):
    same(tools, ["", None, " ", "a", "don't  we'LL", "x\n\n \n y", "<|endoftext|>hi", "é́ ​퟿", "日本語のテキストです。", "🙂🙃" * 5, "\t\t\t  end ", "http://a.b/c?d=e&f", "0123456789" * 30])


def test_very_long_words(tools):
    rng = random.Random(0)
    same(tools, ["a" * 5000, " " * 3000 + "x", "ab" * 3000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "-" * 4000])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(tools, texts):
    same(tools, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="etaoin shrdlu'", max_size=80), max_size=5))
def test_plain_letters(tools, texts):
    same(tools, texts)


def test_memory_is_bounded():
    v = Vocabulary()
    e = Encoder(v, remembered=3)
    ids, offsets = e.batch(["one two three four five six", "one two"])
    assert ids[offsets[1] :].tolist() == ids[: 2].tolist() and isinstance(ids, np.ndarray)


@pytest.mark.parametrize("characters", [4_000_000, 30])
def test_a_batch_is_one_trie(characters):
    """Words with a common prefix cost the same tests in one text and in as many texts of a batch."""
    words = [" antidisestablishment" + "".join(random.Random(i).choices("abcdefgh", k=5)) for i in range(20)]

    def tests(texts):
        v = Vocabulary()
        n, plain = [0], v.compatible
        v.compatible = lambda a, b: (n.__setitem__(0, n[0] + 1), plain(a, b))[1]
        e = Encoder(v, characters=characters)
        got = e.batch(texts)[0].tolist()
        return n[0], got

    one, many = tests(["".join(words)]), tests(words)
    assert one[1] == many[1]
    assert (one[0] == many[0]) if characters > 1000 else (one[0] < many[0])
