"""Reading level by the surprisal of interpolated n-gram models, mapped to grades by isotonic regression.

1. One pass over the texts writes each text's language (what the language model says, not its column), its words and the
   lengths of its sentences. Nothing after it reads a text again.
2. Words are counted per language, and character n-grams of the orders 1 to 5 from the counted words, exactly: tables of
   words and of n-grams grow with the corpus and are joined, never hashed into a fixed number of bins.
3. Interpolated, they give each character of a word a surprisal given what comes before it in the word; a word's surprisal is
   their sum. What a word says also depends on how often it occurs.
4. A text becomes the distribution of its words' surprisals over the whole text: mean, spread and quantiles, beside the
   frequencies and lengths of words and the lengths of sentences, each relative to the texts of its language, so that
   levels are comparable within languages. Known words are looked up in a broadcast table where there are at most
   ``MOST_KNOWN`` of them; otherwise the words of texts are joined with the table. Both give the same.
5. Ridge regression on the labelled texts makes one score of it, and isotonic regression (pool adjacent violators) maps
   the score monotonically to the levels. Several judgements of one text count with their mean.

Only the fit uses labels; at most ``MOST_LABELS`` labelled texts, the first by a hash of the id, reach it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomspark.llm.defects import FENCE, INVISIBLE, MARKER
from loomspark.llm.lang import LanguageModel
from loomspark.runtime import discard, materialize

ORDERS = (1, 2, 3, 4, 5)
#: Occurrences of a context at which the longer order counts half.
HALF = 20.0
#: Characters that may occur, for those never seen.
ALPHABET = 5000
MOST_LABELS = 20_000
MOST_KNOWN = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Scripts without spaces are cut where the kind of character changes, and into pieces of four at most.
_WORD = re.compile(r"[぀-ゟ]{1,4}|[゠-ヿ]+|[㐀-鿿]{1,4}|[^\W\d_぀-ヿ㐀-鿿]+")
_ASCII_WORDS = re.compile("[a-z]+").findall
_OTHER_ENDS = ("! ", "? ", "\n", "。", "！", "？")
_KEY = re.compile(r'"[A-Za-z_]+"\s*:')
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"(\s*:)?')
_HIDDEN = re.compile(r"[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\u3164]")
FEATURES = ("mean", "deviation", "q50", "q75", "q90", "q97", "word_mean", "word_q90", "word_length", "long_words", "sentence_length", "sentence_q90", "comma_rate", "spread_of_words", "per_character", "distinct_words", "word_q50")
#: Ridge penalty, in observations.
PENALTY = 10.0


def prose(text: str) -> str:
    """What there is to read: without markers; of an object or list its string values, a line each."""
    if "<" in text:
        text = MARKER.sub(" ", text)
    if "`" in text or "~" in text:
        text = FENCE.sub(" ", text)
    t = " ".join(text.split()) if text.isascii() or not _HIDDEN.search(text) else INVISIBLE.sub(" ", text).strip()
    if t[:1] in "{[" and '"' in t:
        return "\n".join(v.replace("\\n", "\n") for v, key in _STRING.findall(t) if not key) or t
    return t


def _words(read: str) -> list[str]:
    low = (_KEY.sub(" ", read) if '":' in read else read).lower()
    return _ASCII_WORDS(low) if low.isascii() else _WORD.findall(low)


def _sentences(read: str) -> list[int]:
    """Lengths of the sentences and lines."""
    for end in _OTHER_ENDS if not read.isascii() else _OTHER_ENDS[:3]:
        if end in read:
            read = read.replace(end, ". ")
    return [len(x) for x in read.split(". ") if x and not x.isspace()] or [max(len(read), 1)]


def prepared(documents: DataFrame, row: str, text: str, model: LanguageModel) -> DataFrame:
    """``(row, lang INT, words, shape ARRAY<DOUBLE>)``: words joined by blanks, the language's number, lengths of sentences and commas.

    All but ``row`` are null for a null text or one without words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            langs, words, shapes = [None] * n, [None] * n, [None] * n
            for at in range(0, n, 256):
                texts = batch.column(1).slice(at, 256).to_pylist()
                some = [i for i, t in enumerate(texts) if t]
                reads = [prose(texts[i]) for i in some]
                best = model.scores([_KEY.sub(" ", r) if '":' in r else r for r in reads]).argmax(1) if some and model.languages else np.zeros(len(some), np.int64)
                for i, read, lang in zip(some, reads, best.tolist()):
                    found = _words(read)
                    if found:
                        lengths = sorted(_sentences(read))
                        top = 0.9 * (len(lengths) - 1)
                        low, high = lengths[int(top)], lengths[min(int(top) + 1, len(lengths) - 1)]
                        langs[at + i], words[at + i] = lang, " ".join(found)
                        shapes[at + i] = [math.log(sum(lengths) / len(lengths)), math.log(low + (top - int(top)) * (high - low)), sum(map(read.count, ",;、，")) / len(found)]
            yield pa.record_batch([batch.column(0), pa.array(langs, pa.int32()), pa.array(words, pa.string()), pa.array(shapes, pa.list_(pa.float64()))], names=[row, "lang", "words", "shape"])

    return documents.select(row, text).mapInArrow(run, f"{row} {documents.schema[row].dataType.simpleString()}, lang int, words string, shape array<double>")


def word_counts(texts: DataFrame) -> DataFrame:
    """``(lang, word, n)`` of all words of ``texts(lang, words)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = {}

        def flush():
            rows = [(k, w, n) for k, c in held.items() for w, n in c.items()]
            held.clear()
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for lang, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, Counter()).update(words.split(" "))
            if sum(map(len, held.values())) > 500_000:
                yield flush()
        yield flush()

    return texts.select("lang", "words").where("words IS NOT NULL").mapInArrow(count, "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character of `` word `` but the first: whose it is, its place, and the n-grams that end there, a column per order."""
    pad = len(ORDERS)
    codes = np.frombuffer("".join(" " * pad + w + " " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + pad + 1 for w in words), np.int64, len(words))
    of = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes) - (pad - 1)
    out, h = np.empty((len(codes), pad), np.uint64), np.zeros(len(codes), np.uint64)
    for n in ORDERS:
        before = np.concatenate([np.zeros(n - 1, np.uint64), codes[: len(codes) - n + 1]])
        h = (h ^ (before + np.uint64(n))) * _MIX
        h ^= h >> np.uint64(29)
        out[:, n - 1] = h
    keep = place >= 0  # place 0 is the blank before the word
    return of[keep], place[keep], out[keep]


def gram_counts(words: DataFrame) -> DataFrame:
    """``(lang, k, gram, n)``: how often each character n-gram of order k + 1 occurs in the words as often as they occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            of, _, grams = _grams(batch.column(1).to_pylist())
            for lang in np.unique(langs):
                mine = langs[of] == lang
                for k in range(len(ORDERS)):
                    g, inverse = np.unique(grams[mine, k], return_inverse=True)
                    sums = np.bincount(inverse, n[of[mine]]).astype(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(g), lang, np.int32)), pa.array(np.full(len(g), k, np.int32)), pa.array(g.view(np.int64)), pa.array(sums)], names=["lang", "k", "gram", "n"])

    return words.select("lang", "word", "n").mapInArrow(count, "lang int, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))


def word_surprisals(words: DataFrame) -> DataFrame:
    """``(lang, word, surprisal, rarity)`` in bits, of ``words(lang, word, n)``: by the n-gram model, and by how often the word occurs."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                of, place, grams = _grams(part.column(1).to_pylist())
                whose = pa.array(np.repeat(of, len(ORDERS)))
                yield pa.record_batch(
                    [part.column(0).take(whose), part.column(1).take(whose), pa.array(np.repeat(place, len(ORDERS)).astype(np.int32)), pa.array(np.tile(np.arange(len(ORDERS), dtype=np.int32), len(of))), pa.array(grams.ravel().view(np.int64))],
                    names=["lang", "word", "place", "k", "gram"],
                )

    counts = materialize(gram_counts(words))
    all_ = words.groupBy("lang").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
    # A row per language, of which there are few.
    sums = counts.where("k = 0").groupBy("lang").agg(F.sum("n").alias("characters")).join(all_, "lang").collect()
    known = {name: F.create_map(*[F.lit(x) for r in sums for x in (r["lang"], float(r[name]))]) if sums else F.create_map().cast("map<int,double>") for name in ("characters", "all", "kinds")}
    at_place = words.select("lang", "word").mapInArrow(spread, "lang int, word string, place int, k int, gram long").join(counts, ["lang", "k", "gram"])
    # Every n-gram of a word has been counted, so the list has no gaps.
    entries = F.sort_array(F.collect_list(F.struct((F.col("place") * len(ORDERS) + F.col("k")).alias("at"), "n")))
    seen = at_place.groupBy("lang", "word").agg(entries.alias("entries")).select("lang", "word", F.transform("entries", lambda e: e["n"].cast("double")).alias("seen"))
    made = seen.join(words, ["lang", "word"]).select("lang", "word", "n", "seen", *[m[F.col("lang")].alias(name) for name, m in known.items()])

    def at(i, k: int):
        return F.get(F.col("seen"), i * len(ORDERS) + k)

    def bits(i):
        p = (at(i, 0) + 0.5) / (F.col("characters") + 0.5 * ALPHABET)
        # The context of order k + 1 ends one character before; weights let frequent contexts speak.
        for k in range(1, len(ORDERS)):
            context = at(i - 1, k - 1)
            weight = context / (context + HALF)
            p = weight * F.least(at(i, k) / F.greatest(context, F.lit(1.0)), F.lit(1.0)) + (1 - weight) * p
        return -F.log2(F.greatest(p, F.lit(1e-9)))

    total = F.aggregate(F.sequence(F.lit(1), F.char_length("word") + 1), F.lit(0.0), lambda sum_, i: sum_ + bits(i))
    return made.select("lang", "word", total.alias("surprisal"), (-F.log2((F.col("n") + 1) / (F.col("all") + F.col("kinds") + 1))).alias("rarity"))


def _quantile(sorted_: np.ndarray, first: np.ndarray, n: np.ndarray, q: float) -> np.ndarray:
    """Linear interpolation in runs of rising values that begin at ``first`` and have ``n`` values each."""
    at = q * (n - 1)
    low = np.floor(at).astype(np.int64)
    x, y = sorted_[first + low], sorted_[first + np.minimum(low + 1, n - 1)]
    return x + (at - low) * (y - x)


def _features(values: np.ndarray, n: np.ndarray, shapes: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """A row of features for each text, from its words' ``values`` (surprisal, rarity, length), ``n`` to a text, joined."""
    of = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    surprisal, rarity, lengths = values[:, 0], values[:, 1], values[:, 2]

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(of, x, len(n)) / n

    def deviation(x: np.ndarray) -> np.ndarray:
        return np.sqrt(mean((x - mean(x)[of]) ** 2))

    def rising(x: np.ndarray) -> np.ndarray:
        """Sorted within each text: by value, then stably by the text's small number, which is a radix sort."""
        order = np.argsort(x)
        return x[order[np.argsort(of[order].astype(np.uint16), kind="stable")]]

    per_word, per_rarity = rising(surprisal), rising(rarity)
    return np.column_stack([
        mean(surprisal), deviation(surprisal), *(_quantile(per_word, first, n, q) for q in (0.5, 0.75, 0.9, 0.97)), mean(rarity), _quantile(per_rarity, first, n, 0.9), mean(lengths), mean(lengths > 9),
        shapes, deviation(rarity), mean(surprisal / (lengths + 1)), distinct / n, _quantile(per_rarity, first, n, 0.5),
    ])


def with_features(texts: DataFrame, row: str, known: DataFrame, languages: list[str], most_known: int = MOST_KNOWN) -> DataFrame:
    """``(row, detected, features ARRAY<DOUBLE>)`` of :func:`prepared` texts; both null for a text without words."""
    kind = texts.schema[row].dataType.simpleString()
    names = languages or ["?"]
    schema = f"{row} {kind}, detected string, features array<double>"

    def described(rows, langs, values) -> pa.RecordBatch:
        return pa.record_batch([rows, pa.array([None if k is None else names[k] for k in langs], pa.string()), pa.array(values, pa.list_(pa.float64()))], names=[row, "detected", "features"])

    if known.count() <= most_known:
        table = known.toPandas()
        tables: dict[int, dict[str, tuple[float, float]]] = {}
        for lang, part in table.groupby("lang"):
            tables[int(lang)] = dict(zip(part["word"], zip(part["surprisal"], part["rarity"])))
        held = texts.sparkSession.sparkContext.broadcast(tables)

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index: dict[int, dict[str, int]] = {}
            numbers: dict[int, np.ndarray] = {}
            for k, words in held.value.items():
                index[k] = {w: i for i, w in enumerate(words)}
                numbers[k] = np.array([(*v, len(w)) for w, v in words.items()])
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    langs, values = part.column(1).to_pylist(), [None] * part.num_rows
                    found, shapes, distinct, rows = [], [], [], []
                    for i, (lang, words, shape) in enumerate(zip(langs, part.column(2).to_pylist(), part.column(3).to_pylist())):
                        if words is not None:
                            each = words.split(" ")
                            found.append(numbers[lang][np.fromiter(map(index[lang].__getitem__, each), np.int64, len(each))])
                            shapes.append(shape), distinct.append(len(set(each))), rows.append(i)
                    if rows:
                        got = _features(np.concatenate(found), np.array([len(f) for f in found]), np.array(shapes), np.array(distinct))
                        for i, row_ in zip(rows, got.tolist()):
                            values[i] = row_
                    yield described(part.column(0), langs, values)

        return texts.select(row, "lang", "words", "shape").mapInArrow(look_up, schema)

    each = texts.where("words IS NOT NULL").select(row, "lang", F.explode(F.split("words", " ")).alias("word")).groupBy(row, "lang", "word").agg(F.count("*").alias("times"))
    found = each.join(known, ["lang", "word"]).groupBy(row).agg(F.collect_list(F.struct("surprisal", "rarity", F.char_length("word").alias("length"), "times")).alias("each"))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, values = batch.column(1).to_pylist(), []
            for words, shape in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist()):
                if words is None:
                    values.append(None)
                    continue
                each = np.repeat(np.array([[w[c] for c in ("surprisal", "rarity", "length")] for w in words], float), [w["times"] for w in words], 0)
                values.append(_features(each, np.array([len(each)]), np.array([shape]), np.array([len(words)]))[0].tolist())
            yield described(batch.column(0), langs, values)

    return texts.select(row, "lang", "shape").join(found, row, "left").select(row, "lang", "shape", "each").mapInArrow(gathered, schema)


def pool_adjacent_violators(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: thresholds of x, rising, and the fitted value from each on. Ties of x are one point."""
    xs, inverse, n = np.unique(x, return_inverse=True, return_counts=True)
    means = np.bincount(inverse, y) / n
    blocks: list[list[float]] = []  # value, weight, first x
    for v, w, at in zip(means, n, xs):
        blocks.append([v, w, at])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, _ = blocks.pop()
            v1, w1, a1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, a1])
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


def _columns(z: np.ndarray) -> np.ndarray:
    """A constant, the features, and their squares where they aren't extreme."""
    return np.column_stack([np.ones(len(z)), np.clip(z, -4, 4), np.clip(z, -2, 2) ** 2])


@dataclass
class Grader:
    centers: dict[str, tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def score(self, values: np.ndarray, langs: list[str]) -> np.ndarray:
        z = np.stack([(v - self.centers[k][0]) / self.centers[k][1] for v, k in zip(values, langs)]) if len(values) else np.zeros((0, len(FEATURES)))
        return _columns(z) @ self.weights

    def level(self, score: np.ndarray) -> np.ndarray:
        """The fitted level between 1 and 5, interpolated between the blocks."""
        if not len(self.x):
            return np.full(len(score), 3.0)
        return np.clip(np.interp(score, self.x, self.y), 1, 5)


def fit_grader(described: DataFrame, labels: DataFrame, row: str, most: int = MOST_LABELS) -> Grader:
    """``described`` from :func:`with_features`, ``labels(row, level)``; null levels don't count."""
    named = described.where("features IS NOT NULL")
    each = named.select("detected", F.posexplode("features").alias("k", "v")).groupBy("detected", "k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    centers = {}
    for r in each:
        m, s = centers.setdefault(r["detected"], (np.zeros(len(FEATURES)), np.ones(len(FEATURES))))
        m[r["k"]], s[r["k"]] = r["m"], max(r["s"] or 0, 1e-6)
    judged = labels.where("level IS NOT NULL").groupBy(row).agg(F.avg("level").alias("level"))
    got = named.join(judged, row).orderBy(F.xxhash64(row), row).limit(most).select("detected", "features", "level").collect()
    if not got:
        return Grader(centers, np.zeros(2 * len(FEATURES) + 1), np.zeros(0), np.zeros(0))
    values, langs, y = np.array([r["features"] for r in got]), [r["detected"] for r in got], np.array([r["level"] for r in got])
    g = Grader(centers, np.zeros(2 * len(FEATURES) + 1), np.zeros(0), np.zeros(0))
    z = _columns(np.stack([(v - centers[k][0]) / centers[k][1] for v, k in zip(values, langs)]))
    penalty = np.eye(z.shape[1]) * PENALTY
    penalty[0, 0] = 0
    g.weights = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    g.x, g.y = pool_adjacent_violators(z @ g.weights, y)
    return g


def reading_levels(documents: DataFrame, labels: DataFrame, row: str, text: str, model: LanguageModel, most_known: int = MOST_KNOWN) -> DataFrame:
    """``(row, detected, score, level INT)`` for every document; all but ``row`` null for null texts and those without words.

    ``row`` must be unique. With no usable label every level is 3.
    """
    texts = materialize(prepared(documents, row, text, model))
    words = materialize(word_counts(texts))
    known = materialize(word_surprisals(words))
    described = materialize(with_features(texts, row, known, model.languages, most_known))
    for table in (texts, words, known):
        discard(table)
    grader = fit_grader(described, labels.select(row, "level"), row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, values = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            ok = [i for i, v in enumerate(values) if v is not None]
            score = grader.score(np.array([values[i] for i in ok]), [langs[i] for i in ok])
            level = np.floor(grader.level(score) + 0.5)
            scores, levels = [None] * len(values), [None] * len(values)
            for i, s, v in zip(ok, score, level):
                scores[i], levels[i] = float(s), int(v)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(levels, pa.int32())], names=[row, "detected", "score", "level"])

    return described.mapInArrow(run, f"{row} {documents.schema[row].dataType.simpleString()}, detected string, score double, level int")
