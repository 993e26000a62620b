"""Texts that were cut off before their end.

A backward character n-gram model says how likely a text goes on after its last characters. Contexts grow backwards from the
end of a value; of each, all texts are counted for what follows it: the end of a sentence, line or text, the rest of a
word, or more of the same sentence. The orders are interpolated, longer ones over shorter ones, and the log-odds of "more
follows" are held against a threshold per language and column.

Two things are part of the context beside its characters: whether it lies inside an object or list, and whether inside one of
its strings. Inside, nothing but the text's own end is an end, and no complete text ends there, which is how the model
knows an unfinished object. A brace in prose isn't the inside of anything. White space, invisible characters and markers
of turns at a text's end say nothing, so they aren't in the context.

Lengths (in characters, bytes or tokens of the sample) that occur far more often than their neighbours are limits; a value as
long as a limit needs less evidence.

The model isn't kept for all contexts: filters of the contexts that values end with decide which of the corpus's contexts are
counted. Each has a bounded size; when one would be too full, contexts are split by their hash over as many passes as
it takes. Every position of every text is looked at, at every size of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomspark.functions.text import LOSS_PREFIX
from loomspark.runtime import discard, materialize

FILTER_BITS = 2**28
#: Bits of the filters for each context.
BITS_EACH = 16
#: Lengths of the contexts: of the text itself, and of its shape (digits and capitalised words generalised).
RAW, SHAPE = (6, 12), (8, 16, 32)
PAD = 40
#: The weight of the next shorter context, in occurrences of the longer one.
SHORTER = 1.5
#: How likely more follows inside an object where no context has been seen: the text's end is one place of many there.
UNSEEN_INSIDE = 0.95
#: How often the text's last characters must have been seen to tell the inside of a word.
LEAST_SEEN = 3
#: … and how much of it must be inside one.
WITHIN = 0.88
#: Names of what follows a context.
END, INSIDE, MORE, LAST = 0, 1, 2, 3
#: Log-odds of "more follows" from which a value counts as cut.
THRESHOLD = 1.0
#: … where sentences do end like this, too. A cut falls on one place of many, an end without a mark on one of few ends, so
#: the odds must make up for that.
THRESHOLD_ENDS = 3.0
#: … and after a full stop.
THRESHOLD_STOP = 3.0
#: What a limit adds to the log-odds.
AT_LIMIT = 1.5
_MARKS = re.compile(r"(?:<\|?[a-z_]+\|?>(?:thought|model|user)?|<\|channel>thought\n<channel\|>)$")
_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u200c\u200d\u2028\u2029\u202f\u2060\u3000\ufeff"
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]*")
_DIGITS = re.compile(r"\d+")
_SPACES = re.compile(r"[^\S\n]{2,}|[^\S\n ]")
#: A full stop after a number or a short word may be that of an ordinal or an abbreviation.
_SHORT = re.compile(r"(?:\d|(?<![^\W\d_])[^\W\d_]{1,4})\.$")
_SENTENCE = ".!?。！？…"
_ODD_SPACES = ("  ", "\t", "\r", "\x0b", "\x0c", "\xa0", "\u2002", "\u2003", "\u2009", "\u200a", "\u202f", "\u3000")


def stripped(text: str) -> str:
    """Without white space, invisible characters and turn markers at the end."""
    t = text.rstrip(_BLANKS)
    while t.endswith(">") or t.endswith(("thought", "model", "user")):
        cut = _MARKS.sub("", t[-80:])
        if len(cut) == len(t[-80:]):
            break
        t = (t[:-80] + cut).rstrip(_BLANKS)
    return t


def shape(text: str) -> str:
    return _DIGITS.sub("0", _CAPITAL.sub("¤", text))


def _cleaned(text: str) -> str:
    text = text.removeprefix(LOSS_PREFIX)
    return text if not any(c in text for c in _ODD_SPACES) else _SPACES.sub(" ", text)


def _zeros(codes: np.ndarray) -> np.ndarray:
    """Digits are all alike."""
    return np.where((codes >= 48) & (codes <= 57), np.uint32(48), codes)


class _Contexts:
    """Hashes of the last n characters at each position of an array of code points, by doubling."""

    BASE = 6364136223846793005

    def __init__(self, codes: np.ndarray):
        self.h = {1: (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)}

    def of(self, n: int) -> np.ndarray:
        """For n characters ending at i; valid from position n - 1 on."""
        if n not in self.h:
            k = 1 << ((n - 1).bit_length() - 1)
            a, b = self.of(n - k), self.of(k)
            with np.errstate(over="ignore"):
                out = b.copy()
                out[k:] += a[:-k] * np.uint64(pow(self.BASE, k, 1 << 64))
            self.h[n] = out
        return self.h[n]


def _final(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_PADDING = "\0" * PAD
_KINDS = [("raw", n) for n in RAW] + [("shape", n) for n in SHAPE]


_STATE = np.uint64(0xA0761D6478BD642F)
_INSIDE = np.zeros(128, bool)
_INSIDE[[ord(c) for c in "{}[],:\" \n\t0123456789"]] = True


def states(codes: np.ndarray) -> np.ndarray:
    """Of each character of texts joined by zeros: 1 inside an object or list, 2 inside one of its strings, else 0.

    Only what may stand there is inside: a brace in prose opens nothing, as words follow. Texts without an object at all
    aren't asked: their brackets are punctuation.
    """
    nul = codes == 0
    quote = codes == 34
    quote[1:] &= codes[:-1] != 92
    many = np.cumsum(quote, dtype=np.int32)
    in_string = (many - np.maximum.accumulate(np.where(nul, many, 0))) & 1 == 1
    # The closing quote is outside already, the opening one inside.
    step = (((codes == 123) | (codes == 91)) & ~in_string).astype(np.int32) - (((codes == 125) | (codes == 93)) & ~in_string)
    depth = np.cumsum(step, dtype=np.int32)
    begin = np.maximum.accumulate(np.where(nul, np.arange(len(codes)), 0))
    deep = depth - depth[begin] > 0
    return np.where(deep & ~nul, np.where(in_string, np.int8(2), _INSIDE[np.minimum(codes, 127)].astype(np.int8)), np.int8(0))


def final_states(texts: list[str]) -> np.ndarray:
    """The state of each text's last character."""
    out = np.zeros(len(texts), np.int8)
    part, size, at, of = ["\0"], 1, [], []
    for i, t in enumerate([*texts, None]):
        if t is not None and "{" in t:
            part += [t, "\0"]
            size += len(t) + 1
            at.append(size - 2), of.append(i)
        if at and (t is None or size > _AT_A_TIME):
            out[of] = states(_codes("".join(part)))[at]
            part, size, at, of = ["\0"], 1, [], []
    return out


def _final_shape(text: str) -> str:
    """The shape of as much of the end as the longest context needs: runs of digits and words shrink."""
    most = 200
    while True:
        s = shape(_cleaned(text[-most:]))
        if len(s) >= PAD or most >= len(text):
            return s
        most *= 4


def ending_contexts(texts: list[str], shapes: list[str], state: np.ndarray) -> np.ndarray:
    """Hashes of the contexts that stripped values end with: a row per value, a column per context, as signed integers."""
    if not texts:
        return np.zeros((0, len(_KINDS)), np.int64)
    out = np.zeros((len(texts), len(_KINDS)), np.uint64)
    state = state.astype(np.uint64) * _STATE
    both = {"raw": [_cleaned(t[-200:]) for t in texts], "shape": shapes}
    for which, values in both.items():
        joined = "".join((_PADDING + t)[-PAD:] for t in values)
        codes = _zeros(_codes(joined)) if which == "raw" else _codes(joined)
        h = (codes.astype(np.uint64).reshape(len(texts), PAD) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for k, (w, n) in enumerate(_KINDS):
            if w == which:
                powers = np.array([pow(_Contexts.BASE, j, 1 << 64) for j in range(n - 1, -1, -1)], np.uint64)
                out[:, k] = _final((h[:, PAD - n :] * powers).sum(1, dtype=np.uint64) + state, k)
    return out.view(np.int64)


_WORD, _MARK, _BLANK, _LOW, _WIDE, _LINE, _NUL, _DOT = (np.uint8(1 << k) for k in range(8))
_T: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    if not _T:
        t = np.zeros(0x10000, np.uint8)
        for i in range(0x10000):
            ch = chr(i)
            wide = 0x3040 <= i <= 0x30FF or 0x3400 <= i <= 0x9FFF or 0xAC00 <= i <= 0xD7AF
            flags = [ch.isalnum() or ch == "¤", ch in _SENTENCE, ch.isspace() and ch != "\n", ch.islower(), wide, ch == "\n", i == 0, ch == "."]
            t[i] = sum(1 << k for k, f in enumerate(flags) if f)
        _T.append(t)
    return _T[0]


def _following(codes: np.ndarray) -> np.ndarray:
    """What follows each position: END of a sentence or line, INSIDE a word, MORE, the text's LAST position, or -1."""
    f = _kinds()[np.minimum(codes, 0xFFFF)]
    f1, f2 = np.zeros_like(f), np.zeros_like(f)
    f1[:-1], f2[:-2] = f[1:], f[2:]
    over = (f2 & (_BLANK | _NUL | _LINE | _WIDE)) != 0
    wide_stop = (f1 & (_MARK | _DOT)) == _MARK  # marks of wide scripts end sentences without a blank; so do ! and ?
    end = ((f1 & _LINE) != 0) | (((f1 & _MARK) != 0) & (over | wide_stop)) | (((f1 & _BLANK) != 0) & ((f2 & _MARK) != 0))
    # After a full stop itself: the sentence ended unless a lower-case word or no blank follows.
    end |= ((f & _MARK) != 0) & (((f1 & _LINE) != 0) | (((f1 & _BLANK) != 0) & ((f2 & _LOW) == 0)) | (((f1 & _WIDE) != 0) & ((f & _DOT) == 0)))
    inside = ((f & f1 & _WORD) != 0) & (((f | f1) & _WIDE) == 0)
    out = np.where(end, np.int8(END), np.where(inside, np.int8(INSIDE), np.int8(MORE)))
    out[((f1 & _LINE) != 0) & ((f2 & _NUL) != 0)] = -1
    out[(f1 & _NUL) != 0] = LAST
    out[(f & _NUL) != 0] = -1
    return out


#: Characters that are hashed at a time; the arrays then stay in a processor's cache.
_AT_A_TIME = 60_000


def _count(bits: np.ndarray, part_: int = 0, parts: int = 1):
    """All contexts (of one part) of all texts that pass the filter, with what follows them."""
    mask = np.uint64(len(bits) * 64 - 1)

    def hits(codes: np.ndarray, which: str, objects: bool):
        follow = _following(codes)
        inside = np.uint64(0)
        if objects:
            state = states(codes)
            follow[(state > 0) & (follow == END)] = MORE
            inside = state.astype(np.uint64) * _STATE
        known = follow >= 0
        contexts = _Contexts(codes)
        for k, (w, n) in enumerate(_KINDS):
            if w == which:
                h = _final(contexts.of(n) + inside, k) & ~np.uint64(3)  # the low bits say what follows
                i = h & mask
                ok = ((bits[(i >> np.uint64(6)).view(np.int64)] >> (i & np.uint64(63))) & np.uint64(1)).astype(bool) & known
                if parts > 1:
                    ok &= (h >> np.uint64(40)) % np.uint64(parts) == np.uint64(part_)
                ok = np.flatnonzero(ok)
                yield h[ok] | follow[ok].astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            parts_, sizes = ([_PADDING], [_PADDING]), [0, 0]  # of texts without objects, and with
            texts = (t for v in batch.column(0).to_pylist() for t in v or () if t)
            for text in (*texts, None):
                if text is not None:
                    which = "{" in text
                    parts_[which].extend((_cleaned(text), _PADDING))
                    sizes[which] += len(text)
                for which in (False, True):
                    if sizes[which] > _AT_A_TIME or (text is None and sizes[which]):
                        joined = "".join(parts_[which])
                        found += [*hits(_zeros(_codes(joined)), "raw", which), *hits(_codes(shape(joined)), "shape", which)]
                        parts_[which][1:] = []
                        sizes[which] = 0
                if found and (text is None or len(found) > 256):
                    both, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.record_batch(
                        [pa.array((both & ~np.uint64(3)).view(np.int64)), pa.array((both & np.uint64(3)).astype(np.int32)), pa.array(n.astype(np.int64))], names=["context", "follows", "n"]
                    )
                    found = []

    return run


def ending_of(t: str, inside: bool = False) -> str:
    """How a value ends, given what is left of it without blanks and markers and whether that is inside an object."""
    if not t:
        return "nothing"
    last = t[-1]
    if last == "�":
        return "half"
    if inside:
        return "open"
    if last in "!?。！？…`}]":
        return "mark"
    if last == ".":
        return "stop" if _SHORT.search(t[-12:]) else "mark"
    return "open"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        left = [stripped(t).removeprefix(LOSS_PREFIX) for t in texts]
        state = final_states(left)
        ending = [ending_of(t, s > 0) for t, s in zip(left, state.tolist())]
        cjk = [bool(t) and ord(t[-1]) >= 0x3000 for t in left]
        asked = [i for i, e in enumerate(ending) if e in ("open", "stop")]
        shapes = [_final_shape(left[i]) for i in asked]
        contexts: list[list[int] | None] = [None] * len(texts)
        reach = [PAD] * len(texts)
        for i, form, row in zip(asked, shapes, ending_contexts([left[i] for i in asked], shapes, state[asked]).tolist()):
            contexts[i] = row
            reach[i] = len(form)
        single = [" " not in t and len(t) <= (8 if c else 24) for t, c in zip(left, cjk)]
        yield pa.record_batch(
            [*batch.columns[:-1], pa.array(single), pa.array(ending), pa.array(cjk), pa.array(state > 0), pa.array(reach, pa.int32()), pa.array(contexts, pa.list_(pa.int64()))],
            names=[*batch.schema.names[:-1], "single", "ending", "cjk", "inside", "reach", "contexts"],
        )


def _filters(contexts: DataFrame, most_bits: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """A bitmap of the contexts, or several of parts of them. They reach the driver one by one; each has ``most_bits`` at most."""
    n = contexts.count()
    parts = max(1, -(-BITS_EACH * n // most_bits))
    bits = 1 << 16
    while bits < min(most_bits, BITS_EACH * n):
        bits *= 2
    low = F.col("context").bitwiseAND(F.lit(bits - 1))
    for part in range(parts):
        mine = contexts if parts == 1 else contexts.where(F.pmod(F.shiftrightunsigned("context", 40), F.lit(parts)) == part)
        words = mine.groupBy(F.shiftright(low, 6).cast("int").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(context & 63 AS INT))")).alias("w")).toPandas()
        out = np.zeros(bits // 64, np.int64)
        out[words["i"].to_numpy(np.int64)] = words["w"].to_numpy(np.int64)
        yield out.view(np.uint64), part, parts


def limits(lengths: DataFrame, least: int = 8, factor: float = 4.0, width: int = 12, shortest: int = 100) -> DataFrame:
    """``(column, unit, length)`` that occur at least ``least`` times and ``factor`` times as often as their neighbours.

    ``lengths`` has (column, unit, length); lengths below ``shortest`` are fixed phrases rather than limits. The
    neighbours are the lengths within ``width``; at most the number of different lengths reaches one task per column.
    """
    from pyspark.sql import Window

    counts = lengths.where(F.col("length") >= shortest).groupBy("column", "unit", "length").agg(F.count("*").alias("n"))
    near = Window.partitionBy("column", "unit").orderBy("length").rangeBetween(-width, width)
    around = (F.sum("n").over(near) - F.col("n")) / (2 * width)
    return counts.withColumn("around", around).where((F.col("n") >= least) & (F.col("n") >= factor * F.col("around"))).select("column", "unit", "length")


def truncated_values(
    values: DataFrame, corpus: DataFrame, extra_lengths: DataFrame | None = None, threshold: float = THRESHOLD, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """``(row, pos, column, lang, ending, limit, odds, reason, cut)`` for each value of ``values(row BIGINT, pos INT, column, lang, text)``.

    ``corpus(texts ARRAY<STRING>)`` is what the model counts. ``extra_lengths(row, pos, unit, length)`` adds lengths
    known from elsewhere, e.g. a sample's tokens. Null texts aren't values; empty ones aren't cut. A complete text
    without a final mark isn't cut, as its last words end sentences elsewhere. Values whose ends are seen nowhere else
    are judged by shorter contexts. ``reason`` of a cut value: ``word`` (the model, inside a word), ``object`` (the model,
    inside an object or list), ``sentence`` (the model), ``half`` a character.
    """
    v = values.where("text IS NOT NULL")
    described = materialize(
        v.select("row", "pos", "column", "lang", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), "text").mapInArrow(
            _describe, "row long, pos int, column string, lang string, chars int, bytes int, single boolean, ending string, cjk boolean, inside boolean, reach int, contexts array<long>"
        )
    )
    wanted = described.where("contexts IS NOT NULL").select("row", "pos", F.posexplode("contexts").alias("kind", "context"))
    wanted = wanted.withColumn("context", F.col("context").bitwiseAND(F.lit(-4)))
    seen = None
    for bits, part, parts in _filters(wanted.select("context"), filter_bits):
        some = corpus.select("texts").mapInArrow(_count(bits, part, parts), "context long, follows int, n long")
        seen = some if seen is None else seen.unionByName(some)
    counts = seen.groupBy("context").agg(*[F.sum(F.when(F.col("follows") == k, F.col("n")).otherwise(0)).alias(name) for k, name in ((END, "ends"), (INSIDE, "inside"), (MORE, "more"), (LAST, "last"))])
    of_value = wanted.join(counts, "context").groupBy("row", "pos").agg(
        *[F.max(F.when(F.col("kind") == k, F.struct("ends", "inside", "more", "last"))).alias(f"k{k}") for k in range(len(_KINDS))]
    )
    lengths = described.select("row", "pos", "column", F.explode(F.map_from_arrays(F.array(F.lit("chars"), F.lit("bytes")), F.array("chars", "bytes"))).alias("unit", "length"))
    if extra_lengths is not None:
        own = described.select("row", "pos", "column")
        lengths = lengths.unionByName(extra_lengths.join(own, ["row", "pos"]).select("row", "pos", "column", "unit", "length"))
    lengths = materialize(lengths)
    found = limits(lengths)
    # A limit in bytes leaves up to three bytes unused where the next character didn't fit.
    slack = found.where("unit = 'bytes'").select("column", "unit", F.explode(F.sequence(F.col("length") - 3, F.col("length") - 1)).alias("length"))
    at_limit = lengths.join(found.unionByName(slack).distinct(), ["column", "unit", "length"]).select("row", "pos", F.lit(True).alias("limit")).distinct()
    scored = described.join(of_value, ["row", "pos"], "left").join(at_limit, ["row", "pos"], "left").withColumn("limit", F.coalesce("limit", F.lit(False)))
    stop = F.col("ending") == "stop"

    def count(k: int, name: str):
        return F.coalesce(F.col(f"k{k}")[name], F.lit(0))

    odds = F.when(F.col("inside"), UNSEEN_INSIDE).otherwise(0.5)
    ended = F.lit(False)
    for k in (0, *range(len(RAW), len(_KINDS))):
        # After a full stop the ends of other texts are ends of sentences, too; so are, in a context that holds the whole
        # value, texts that are no more than it. One of them is this value itself.
        of_texts = stop | (F.col("reach") < _KINDS[k][1])
        ends = count(k, "ends") + F.when(of_texts, F.greatest(count(k, "last") - 1, F.lit(0))).otherwise(0)
        goes_on = count(k, "more") + count(k, "inside")
        odds = (goes_on + SHORTER * odds) / (goes_on + ends + SHORTER)
        ended = ended | (ends > 0) if k else ended
    within = count(0, "inside") / F.greatest(count(0, "inside") + count(0, "ends") + count(0, "more"), F.lit(1))
    often = count(0, "inside") + count(0, "ends") + count(0, "more") >= LEAST_SEEN
    # "Winter" is no half "Wintergarten" where texts of this one word are the more frequent.
    whole = F.col("single") & (count(1, "last") - 1 > count(1, "inside"))
    scored = scored.withColumns({
        "odds": F.when(F.col("contexts").isNotNull(), F.log(odds / (1 - odds + 1e-9) + 1e-9)), "ended": ended, "in_word": often & (within > WITHIN) & ~F.col("cjk") & ~stop & ~whole
    })
    scored = materialize(scored.select("row", "pos", "column", "lang", "single", "ending", "inside", "limit", "odds", "ended", "in_word"))
    for table in (described, lengths):
        discard(table)
    # The threshold of a language and column moves with how common cut values are in it, within one nat of the column's.
    decided = scored.where("ending = 'open' AND NOT inside AND odds IS NOT NULL")
    share = F.log((F.count_if(F.col("odds") > 0) + 1) / (F.count_if(F.col("odds") <= 0) + 1))
    by_column = decided.groupBy("column").agg(share.alias("usual"))
    by_both = decided.groupBy("column", "lang").agg(share.alias("prior")).join(by_column, "column")
    moved = by_both.select("column", F.coalesce("lang", F.lit("")).alias("_lang"), F.least(F.greatest(F.col("prior") - F.col("usual"), F.lit(-1.0)), F.lit(1.0)).alias("shift"))
    scored = scored.withColumn("_lang", F.coalesce("lang", F.lit(""))).join(moved, ["column", "_lang"], "left").drop("_lang")
    least = F.when(stop, THRESHOLD_STOP).when(F.col("ended"), THRESHOLD_ENDS).otherwise(threshold) - F.coalesce("shift", F.lit(0.0))
    by_odds = F.col("odds") + F.when(F.col("limit") & ~stop, AT_LIMIT).otherwise(0.0) > least
    cut = (
        F.when(F.col("ending") == "half", True)
        .when(F.col("ending").isin("nothing", "mark"), False)
        # A single word stands alone; only half of one tells.
        .when(F.col("single") & ~F.col("limit") & ~F.col("inside"), F.col("in_word"))
        .otherwise(F.col("in_word") | F.coalesce(by_odds, F.lit(False)))
    )
    reason = F.when(~F.col("cut"), None).when(F.col("ending") == "half", "half").when(F.col("inside"), "object").when(F.col("in_word"), "word").otherwise("sentence")
    return scored.withColumn("cut", cut).withColumn("reason", reason).select("row", "pos", "column", "lang", "ending", "limit", "odds", "reason", "cut")
