"""Records of held-out splits that also stand in train, exactly or nearly: an edit-distance segment join.

Strings are the token sequences of texts, as lists of entries (lines, sentences, objects). The steps:

1. Exact copies on one side are one class; equal classes of both sides are pairs at once.
2. Strings within the allowed edits have all but so many tokens in common, whatever the order of their entries and wherever
   they are cut into entries. So each string is its bag of tokens, as bits: one for each of the ``FREQUENT`` most frequent
   elements of all bags, and hashed ones for the rest, more of them the longer the string.
3. Evaluation and train strings are dealt into blocks, and each block of the one side meets each of the other in a cell.
   There the train strings are ordered into groups of like strings. What the common bits, and the tokens without a bit of
   their own, leave of a possible bag in common is held against groups first and then against the strings of those groups
   that are left. These are bounds from above, so no pair within the edits is lost.
4. Pairs that are left are verified by their bags and then by dynamic programming over the whole strings, as they stand or
   after the train string's entries have been put in the evaluation string's order. It is done by bits, vectorised over
   pairs, or in bands for very long strings, and allows ``edits`` of the longer one's tokens.

Nothing but the edits decides, so all pairs within them are found. Cells look at all pairs of groups: the time of step 3
grows with the product of both sides, at a few nanoseconds for a pair of strings.
:func:`kept_segments` and what it needs are the segments by which candidates were found before: no query uses them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loomspark.llm.tokens import Hashes, has_cjk, tokens
from loomspark.runtime import materialize

#: Edits that the verification allows, as a share of the longer string's tokens: entries left out count whole.
EDITS = 0.34
#: Segments that may be spoilt, as a share of the evaluation string's tokens.
SPOILT = 0.1
MATCHES = 2
Q = 4
SHORT = 64
#: Elements of bags with a bit of their own; bits of the others, for strings of up to ``BASE`` tokens.
FREQUENT, WIDTH, BASE = 512, 1024, 256
#: Train strings of a group, and strings (evenly taken) by whose likeness they are ordered before.
GROUP, CENTRES = 64, 64
#: Bytes of a block of one side of a cell; groups and strings, or strings and strings, that are looked at together.
BLOCK_BYTES, LOOKED_AT = 2**25, 2**19
#: Cells of the dynamic programme, of many pairs, that are worked out together.
CELLS = 4_000_000
#: Tokens of the longest strings whose dynamic programme is worked out by bits, without bands; bits of many pairs that are worked out together.
WHOLE, BITS = 1024, 2**18
#: Tokens of pairs that are verified together.
VERIFIED = 2**20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = re.compile(r"\{[^{}]*\}?|[^{}]+")
_LINE = re.compile(r"\n+|(?<=[.!?])\s+|(?<=[。！？])")


def entries(text: str) -> list[str]:
    """Objects in braces, else lines and sentences."""
    out: list[str] = []
    for m in _BLOCK.finditer(text):
        part = m.group()
        out.extend([part] if part[0] == "{" else _LINE.split(part))
    return out


class _Codes(dict):
    """Token -> 16 bits of its hash; never 0, which stands between entries: separators have it."""

    def __init__(self):
        super().__init__(_SEPARATORS)
        self.hashes = Hashes()

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
            self.update(_SEPARATORS)
        h = self.hashes[token]
        v = self[token] = max((h ^ (h >> 16)) & 0xFFFF, 1)
        return v


_OBJECT = re.compile(r"\{[^{}]*\}")
_PIECES = re.compile(r"[^\W_]+|[\n{}]|[.!?](?=\s)").findall
_SEPARATORS = dict.fromkeys("\n{}.!?", 0)


def encode(text: str, codes: _Codes) -> np.ndarray:
    """Codes of the tokens with 0 between entries (as :func:`entries` has them)."""
    if text.isascii() or not has_cjk(text):
        text = text.lower()
        if "{" in text:
            text = _OBJECT.sub(lambda m: m.group().replace("\n", " ").replace(". ", "  "), text)
        pieces = _PIECES(text)
        seq = np.fromiter(map(codes.__getitem__, pieces), np.uint16, len(pieces))
    else:
        seq = np.array([c for e in entries(text) for c in (*map(codes.__getitem__, tokens(e)), 0)], np.uint16)
    full = seq != 0
    keep = full.copy()
    keep[1:] |= full[:-1]
    seq = seq[keep]
    return seq[:-1] if len(seq) and seq[-1] == 0 else seq


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, held, text, digest) -> token sequences of 16 bits with 0 between entries, and lengths."""
    codes = _Codes()
    for batch in batches:
        seqs, sizes = [], []
        for text in batch.column(2).to_pylist():
            seq = encode(text, codes)
            seqs.append(seq.tobytes()), sizes.append(np.count_nonzero(seq))
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(3), pa.array(seqs, pa.binary()), pa.array(sizes, pa.int32())], names=["row", "held", "digest", "seq", "n"])


def _bags(seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bags of many sequences: which sequence an element is of, rising, and the elements: the second occurrence of a token has a number of its own."""
    codes = np.frombuffer(b"".join(seqs), np.uint16)
    of = np.repeat(np.arange(len(seqs)), np.fromiter((len(s) // 2 for s in seqs), np.int64, len(seqs)))
    key = np.sort((of << 16 | codes)[codes != 0])
    at = np.arange(len(key))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return key >> 16, (key & 0xFFFF) << 16 | np.minimum(at - np.maximum.accumulate(np.where(first, at, 0)), 0xFFFF)


def _frequent(seqs: DataFrame) -> np.ndarray:
    """The ``FREQUENT`` elements that most bags have, rising."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                element, n = np.unique(_bags(batch.column(0).slice(at, 2048).to_pylist())[1], return_counts=True)
                yield pa.record_batch([pa.array(element), pa.array(n)], names=["element", "n"])

    counts = seqs.select("seq").mapInArrow(count, "element long, n long").groupBy("element").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "element").limit(FREQUENT).collect()
    return np.sort(np.array([r["element"] for r in top], np.int64))


def _level(n: int) -> int:
    """Strings of up to ``BASE`` tokens have level 0; each level allows twice as many."""
    return (max(n - 1, 0) // BASE).bit_length()


def _signatures(frequent: np.ndarray, edits: float):
    """(row, held, seq, n) -> bits for each level at which the string may meet others: those of the shorter ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                n = part.column(3).to_pylist()
                of, element = _bags(part.column(2).to_pylist())
                own = np.minimum(np.searchsorted(frequent, element), max(len(frequent) - 1, 0))
                known = frequent[own] == element if len(frequent) else np.zeros(len(element), bool)
                hashed = (element.astype(np.uint64) * _MIX) >> np.uint64(24)
                bound = np.searchsorted(of, np.arange(len(n) + 1))
                index, levels, bits = [], [], []
                for i, m in enumerate(n):
                    mine = slice(bound[i], bound[i + 1])
                    k = known[mine]
                    # The longer one of two strings allows the edits, so this is the shortest that m tokens can meet.
                    for level in range(_level(m - int(edits * m)), _level(m) + 1):
                        b = np.zeros(FREQUENT + (WIDTH << level), bool)
                        b[own[mine][k]] = True
                        b[FREQUENT + (hashed[mine][~k] & np.uint64((WIDTH << level) - 1)).astype(np.int64)] = True
                        index.append(i), levels.append(level), bits.append(np.packbits(b).tobytes())
                take = pa.array(index, pa.int64())
                yield pa.record_batch(
                    [part.column(0).take(take), part.column(1).take(take), part.column(3).take(take), pa.array(levels, pa.int32()), pa.array(bits, pa.binary())], names=["row", "held", "n", "level", "bits"]
                )

    return run


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common bits of all pairs of bitmaps of up to 65,535 bits, whose words are the rows of ``a`` and ``b``."""
    out = np.zeros((a.shape[1], b.shape[1]), np.uint16)
    both, count = np.empty(out.shape, np.uint64), np.empty(out.shape, np.uint8)
    for x, y in zip(a, b):
        np.bitwise_and(x[:, None], y[None, :], out=both)
        np.bitwise_count(both, out=count)
        out += count
    return out


def candidates(held: tuple[np.ndarray, np.ndarray], train: tuple[np.ndarray, np.ndarray], edits: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the strings of both sides whose bags may be within the edits. A side is its lengths and its bitmaps."""
    (ne, be), (nt, bt) = held, train
    f = FREQUENT // 64
    # What strings within the edits have in common at least, as the longer one of them allows it.
    need_e, need_t = (n - np.floor(edits * n).astype(np.int32) for n in (ne, nt))
    own_t = np.bitwise_count(bt[:, :f]).sum(1, dtype=np.int32)
    centres = bt[:: -(-len(bt) // CENTRES), :f]
    like = np.empty(len(bt), np.int64)
    for at in range(0, len(bt), 4096):
        both = _common(bt[at : at + 4096, :f].T, centres.T)
        like[at : at + 4096] = (both / np.maximum(own_t[at : at + 4096, None] + np.bitwise_count(centres).sum(1, dtype=np.int64) - both, 1)).argmax(1)
    order = np.lexsort((nt, like))
    nt, bt, need_t, own_t, like = nt[order], bt[order], need_t[order], own_t[order], like[order]
    new = np.ones(len(like), bool)
    new[1:] = like[1:] != like[:-1]
    place = np.arange(len(like))
    starts = np.flatnonzero((place - np.maximum.accumulate(np.where(new, place, 0))) % GROUP == 0)
    ends = np.append(starts[1:], len(like))
    own_e = np.bitwise_count(be[:, :f]).sum(1, dtype=np.int32)
    rest_e, rest_t = ne - own_e, nt - own_t
    spare_e, spare_t = rest_e - np.bitwise_count(be[:, f:]).sum(1, dtype=np.int32), rest_t - np.bitwise_count(bt[:, f:]).sum(1, dtype=np.int32)
    any_bits = np.ascontiguousarray(np.bitwise_or.reduceat(bt[:, :f], starts, 0).T)
    most_rest, most_n, least_need = np.maximum.reduceat(rest_t, starts), np.maximum.reduceat(nt, starts), np.minimum.reduceat(need_t, starts)
    own_words_e, own_words_t = np.ascontiguousarray(be[:, :f].T), np.ascontiguousarray(bt[:, :f].T)
    # What the bits of frequent elements leave, until it is held against the others: pairs and their common frequent elements.
    left: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    most_left, waiting = max(1, 2**22 // be.shape[1]), 0

    def look_closer():
        e, t, both = (np.concatenate(c) for c in zip(*left))
        left.clear()
        for i in range(0, len(e), most_left):
            x, y = e[i : i + most_left], t[i : i + most_left]
            common = np.bitwise_count(be[x, f:] & bt[y, f:]).sum(1, dtype=np.int64) + np.minimum(spare_e[x], spare_t[y]) + both[i : i + most_left]
            near = common >= np.maximum(need_e[x], need_t[y])
            found.append((x[near], order[y[near]]))

    step = max(1, LOOKED_AT // len(starts))
    for at in range(0, len(ne), step):
        part = slice(at, at + step)
        n, need = ne[part, None], need_e[part, None]
        possible = _common(own_words_e[:, part], any_bits) + np.minimum(rest_e[part, None], most_rest) >= np.maximum(need, least_need)
        possible &= (n >= least_need) & (most_n >= need)
        for g in np.flatnonzero(possible.any(0)):
            of_group, t = at + np.flatnonzero(possible[:, g]), slice(starts[g], ends[g])
            for i in range(0, len(of_group), LOOKED_AT // GROUP):
                e = of_group[i : i + LOOKED_AT // GROUP]
                both = _common(own_words_t[:, t], own_words_e[:, e])
                y, x = np.nonzero(both + np.minimum(rest_e[e], rest_t[t, None]) >= np.maximum(need_e[e], need_t[t, None]))
                left.append((e[x], starts[g] + y, both[y, x]))
                waiting += len(x)
                if waiting > most_left:
                    look_closer()
                    waiting = 0
    if left:
        look_closer()
    x, y = (np.concatenate(c) for c in zip(*found))
    return x, y


def _cell(edits: float):
    """A block of evaluation strings and one of train strings -> the pairs that may be within the edits."""

    def run(cell: pa.Table) -> pa.Table:
        row, n, is_held = (cell.column(c).to_numpy() for c in ("row", "n", "held"))
        level = cell.column("level")[0].as_py()
        bits = np.frombuffer(b"".join(cell.column("bits").to_pylist()), np.uint64).reshape(len(n), -1)
        e, t = np.flatnonzero(is_held), np.flatnonzero(~is_held)
        if len(e) and len(t):
            x, y = candidates((n[e], bits[e]), (n[t], bits[t]), edits)
            e, t = e[x], t[y]
            # Two strings that both have a higher level meet there.
            here = np.minimum(n[e], n[t]) <= BASE << level
            e, t = e[here], t[here]
        else:
            e = t = e[:0]
        return pa.table({"held": row[e], "train": row[t]})

    return run


def _blocks(strings: dict[bool, int], width: int, cells: int) -> dict[bool, int]:
    """In how many blocks each side is dealt: of bounded size, and ``cells`` cells at least where there is work for them."""
    blocks = {side: -(-n * width // BLOCK_BYTES) for side, n in strings.items()}
    while blocks[True] * blocks[False] < min(cells, strings[True] * strings[False] // 2**18):
        blocks[max(blocks, key=lambda side: strings[side] / blocks[side])] += 1
    return blocks


def near_bags(strings: DataFrame, edits: float) -> DataFrame:
    """``(held, train)``: rows of both sides whose bags of tokens may be within the edits, from ``(row, held, seq, n)``."""
    spark = strings.sparkSession
    strings = strings.where("n > 0")
    signatures = materialize(strings.select("row", "held", "seq", "n").mapInArrow(_signatures(_frequent(strings), edits), "row long, held boolean, n int, level int, bits binary"))
    counts: dict[int, dict[bool, int]] = {}
    for r in signatures.groupBy("level", "held").count().collect():  # two rows for each doubling of the length
        counts.setdefault(r["level"], {})[r["held"]] = r["count"]
    cells = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = [(level, *(_blocks(c, (FREQUENT + (WIDTH << level)) // 8, cells)[side] for side in (True, False))) for level, c in counts.items() if len(c) == 2]
    blocks = F.broadcast(spark.createDataFrame(dealt, "level int, held_blocks int, train_blocks int"))
    mine, others = (F.when(F.col("held") == side, F.col("held_blocks")).otherwise(F.col("train_blocks")) for side in (True, False))
    met = signatures.join(blocks, "level").select(
        "row", "held", "n", "level", "bits", F.pmod(F.xxhash64("row"), mine).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), others - 1)).alias("other")
    )
    cell = [F.when(F.col("held") == side, F.col("mine")).otherwise(F.col("other")).alias(name) for side, name in ((True, "held_block"), (False, "train_block"))]
    return met.select("row", "held", "n", "level", "bits", *cell).groupBy("level", "held_block", "train_block").applyInArrow(_cell(edits), "held long, train long")


def _window_hashes(codes: np.ndarray, w: int) -> np.ndarray:
    """Hash of the ``w`` tokens from each position on (of what is left, near the end)."""
    x = np.concatenate([codes.astype(np.uint64), np.zeros(w, np.uint64)])
    out = np.full(len(codes), w, np.uint64)
    for j in range(w):
        out = (out ^ x[j : j + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _places(codes: np.ndarray, row_of: np.ndarray, rows: int, held: bool, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows stand in the joined sequences of a batch: their starts, widths and the starts of their entries.

    Long evaluation strings (``held``) give their disjoint segments, train strings all windows.
    """
    full = codes != 0
    begin = np.flatnonzero(full & ~np.concatenate([[False], full[:-1]]))
    end = np.flatnonzero(full & ~np.concatenate([full[1:], [False]])) + 1
    if held:
        mine = np.bincount(row_of[full], minlength=rows)[row_of[begin]] > SHORT
        begin, end = begin[mine], end[mine]
    length = end - begin
    width = np.minimum(length, q)
    m = np.maximum(1, length // q) if held else length - width + 1
    e = np.repeat(np.arange(len(begin)), m)
    j = np.arange(len(e)) - np.repeat(np.cumsum(m) - m, m)
    start = begin[e] + (j * length[e] // m[e] if held else j)
    return start, width[e], begin[e]


def _short_places(codes: np.ndarray, row_of: np.ndarray, rows: int, held: bool, edits: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`_places`, for short strings: more segments than the allowed edits."""
    full = codes != 0
    begin = np.flatnonzero(full & ~np.concatenate([[False], full[:-1]]))
    end = np.flatnonzero(full & ~np.concatenate([full[1:], [False]])) + 1
    n = np.bincount(row_of[full], minlength=rows)
    mine = n[row_of[begin]] <= (SHORT if held else SHORT / (1 - edits))
    begin, end = begin[mine], end[mine]
    of, length = row_of[begin], end - begin
    if held:
        # A train string near enough has n / (1 - edits) tokens at most.
        allowed = np.floor(edits * n / (1 - edits) + 1e-9)
        step = np.where(np.bincount(of, (length + 1) // 2, rows) > allowed, 2, 1)[of]
        m = -(-length // step)
    else:
        step, m = np.ones_like(length), length
    e = np.repeat(np.arange(len(begin)), m)
    start = begin[e] + step[e] * (np.arange(len(e)) - np.repeat(np.cumsum(m) - m, m))
    if held:
        return start, np.minimum(step[e], end[e] - start), begin[e]
    two = start + 1 < end[e]
    return np.concatenate([start, start[two]]), np.repeat([1, 2], [len(start), np.count_nonzero(two)]), np.concatenate([begin[e], begin[e][two]])


def _probe(held: bool, q: int, edits: float, bits: np.ndarray | None = None):
    """(row, seq, n) -> the hashes of its windows, with the row, its length and the window's place in its entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                seqs = part.column(1).to_pylist()
                codes = np.frombuffer(b"\0\0".join(seqs), np.uint16)
                sizes = np.fromiter((len(s) // 2 + 1 for s in seqs), np.int64, len(seqs))
                row_of = np.repeat(np.arange(len(seqs)), sizes)[: len(codes)]
                long_, short = _places(codes, row_of, len(seqs), held, q), _short_places(codes, row_of, len(seqs), held, edits)
                start, width, entry = (np.concatenate(x) for x in zip(long_, short))
                h = np.zeros(len(start), np.uint64)
                for w in range(1, max(q, 2) + 1):
                    if (mine := width == w).any():
                        h[mine] = _window_hashes(codes, w)[start[mine]]
                if bits is not None:
                    i = h & np.uint64(len(bits) * 64 - 1)
                    keep = (bits[(i >> np.uint64(6)).astype(np.int64)] >> (i & np.uint64(63))) & np.uint64(1) != 0
                    h, start, entry = h[keep], start[keep], entry[keep]
                of = row_of[start]
                yield pa.record_batch(
                    [pa.array(h.view(np.int64)), part.column(0).take(pa.array(of)), part.column(2).take(pa.array(of)), pa.array((start - entry).astype(np.int32))], names=["h", "row", "n", "off"]
                )

    return run


def _entries(seq: np.ndarray) -> list[list[int]]:
    """The codes of each entry."""
    codes = seq.tolist()
    out, begin = [], 0
    for _ in range(codes.count(0)):
        end = codes.index(0, begin)
        out.append(codes[begin:end])
        begin = end + 1
    return [*out, codes[begin:]]


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sequences without separators, b's entries in the order of the entries of a that they resemble most."""
    ea, eb = _entries(a), _entries(b)
    free: dict[tuple[int, ...], list[int]] = {}
    for j in range(len(eb) - 1, -1, -1):
        free.setdefault(tuple(eb[j]), []).append(j)
    match = [js.pop() if (js := free.get(tuple(e))) else -1 for e in ea]
    sets = {j: set(eb[j]) for j in sorted(j for js in free.values() for j in js)}
    for i, e in enumerate(ea):
        if match[i] < 0 and sets:
            s = set(e)
            best, n = -1.0, len(s)
            for j, t in sets.items():
                both = len(s & t)
                like = both / (n + len(t) - both or 1)
                if like > best:
                    best, at, least = like, j, 3 * both >= n + len(t) - both
            if least:
                match[i] = at
                del sets[at]
    return a[a != 0], np.array([c for j in [*(j for j in match if j >= 0), *sets] for c in eb[j]], np.uint16)


def distances(pairs: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray) -> np.ndarray:
    """Edit distances of pairs of sequences where they are at most their limits, else something greater."""
    out = np.asarray(limits, np.int64) + 1
    size = np.array([max(len(a), len(b)) for a, b in pairs], np.int64) if pairs else np.zeros(0, np.int64)
    long_ = np.flatnonzero(size > WHOLE)
    out[long_] = banded_distances([pairs[i] for i in long_], limits[long_])
    todo = np.argsort(size, kind="stable")[: len(size) - len(long_)]
    at = 0
    while at < len(todo):
        part = todo[at : at + max(1, int(np.searchsorted(np.arange(1, len(todo) - at + 1) * size[todo[at:]], BITS, "right")))]
        out[part] = _by_bits([pairs[i] for i in part], limits[part])
        at += len(part)
    return out


def _by_bits(pairs: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray) -> np.ndarray:
    """As :func:`distances`: the differences down a column of the dynamic programme are two bits for a token (Myers 1999, Hyyrö 2003)."""
    na, nb = (np.array([len(x) for x in side], np.int64) for side in zip(*pairs))
    words = max(1, -(-int(na.max()) // 64))
    A, B = np.zeros((len(pairs), words * 64), np.uint16), np.zeros((int(nb.max()), len(pairs)), np.uint16)
    for i, (a, b) in enumerate(pairs):
        A[i, : len(a)] = a
        B[: len(b), i] = b
    counted = np.packbits(np.arange(words * 64) < na[:, None], axis=1, bitorder="little").view(np.uint64).T.copy()
    one, top = np.uint64(1), np.uint64(63)
    more, less = np.full(counted.shape, ~np.uint64(0)), np.zeros(counted.shape, np.uint64)
    out, left = np.where(nb == 0, na, limits + 1), np.flatnonzero(nb)
    A, B, more, less, counted = A[left], B[:, left], more[:, left], less[:, left], counted[:, left]
    for j in range(1, len(B) + 1):
        same = np.packbits(A == B[j - 1][:, None], axis=1, bitorder="little").view(np.uint64).T.copy()
        up, down = one, np.uint64(0)  # what the row above a word adds and takes off
        for x, p, m in zip(same, more, less):
            v = x | m
            x |= down
            h = x & p
            h += p
            h ^= p
            h |= x
            right, back = ~(h | p) | m, h & p
            next_up, next_down = right >> top, back >> top
            right <<= one
            right |= up
            back <<= one
            back |= down
            np.bitwise_and(right, v, out=m)
            np.bitwise_or(back, ~(right | v), out=p)
            up, down = next_up, next_down
        ends = nb[left] == j
        if j % 16 == 0 or ends.any():
            now = j + np.bitwise_count(more & counted).sum(0, dtype=np.int64) - np.bitwise_count(less & counted).sum(0, dtype=np.int64)
            out[left[ends]] = now[ends]
            # A column changes the distance by one at most.
            if not (on := ~ends & (now - (nb[left] - j) <= limits[left])).all():
                left, A, B, more, less, counted = left[on], A[on], B[:, on], more[:, on], less[:, on], counted[:, on]
                if not len(left):
                    break
    return out


def banded_distances(pairs: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Edit distances of pairs of sequences where they are at most their limits, else something greater.

    Bands begin narrow and widen for the pairs that need it, so a pair costs its length times its distance. Pairs of
    like length are worked out together, as many as ``cells`` allow.
    """
    out = np.asarray(limits, np.int64) + 1
    size = np.array([max(len(a), len(b)) for a, b in pairs], np.int64) if pairs else np.zeros(0, np.int64)
    todo, band = np.arange(len(pairs)), 16
    while len(todo):
        todo = todo[np.argsort(size[todo], kind="stable")]
        at = 0
        while at < len(todo):
            k = np.minimum(limits[todo[at:]], band)
            taken = max(1, int(np.searchsorted(np.arange(1, len(k) + 1) * size[todo[at:]] * (2 * k.max() + 1), cells, "right")))
            part = todo[at : at + taken]
            out[part] = _banded([pairs[i] for i in part], np.minimum(limits[part], band), limits[part] + 1)
            at += taken
        todo = todo[(out[todo] > limits[todo]) & (limits[todo] > band)]
        band *= 4
    return out


def _banded(pairs: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray, beyond: np.ndarray) -> np.ndarray:
    k = int(limits.max())
    p, na, nb = len(pairs), np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    top, big = int(na.max(initial=0)), np.int32(1 << 28)
    A = np.zeros((p, top), np.int32)
    B = np.full((p, top + 2 * k + 2), -1, np.int32)  # shifted by k
    for i, (a, b) in enumerate(pairs):
        A[i, : len(a)] = a
        m = min(len(b), top + k + 1)
        B[i, k : k + m] = b[:m]
    lane = np.arange(2 * k + 1, dtype=np.int32)
    row = np.where(lane >= k, lane - k, big)[None, :].repeat(p, 0)  # D[0][j], j = lane - k
    row = np.where(lane[None, :] - k > nb[:, None], big, row).astype(np.int32)
    out = np.full(p, big, np.int64)
    done = na == 0
    out[done] = np.where(nb[done] <= k, nb[done], big)
    edge = np.full((p, 1), big, np.int32)
    for i in range(1, top + 1):
        diagonal = row + (B[:, i - 1 : i + 2 * k] != A[:, i - 1 : i])
        new = np.minimum(diagonal, np.concatenate([row[:, 1:], edge], 1) + 1)
        j = i + lane - k
        new[:, j < 0] = big
        if i <= k:
            new[:, k - i] = i
        new = np.minimum.accumulate(new - lane, 1) + lane
        new[:, j < 0] = big
        row = np.where(j[None, :] > nb[:, None], big, new)
        at = np.flatnonzero(na == i)
        if len(at):
            end = k + nb[at] - i
            ok = (end >= 0) & (end <= 2 * k)
            out[at[ok]] = row[at[ok], end[ok]]
    return np.where(out <= limits, out, beyond)


def _verify(edits: float):
    """Pairs with their sequences and lengths -> those within the edits."""

    def near(seq_e: list[bytes], seq_t: list[bytes]) -> np.ndarray:
        """Which pairs are."""
        place: dict[bytes, int] = {}
        e, t = (np.array([place.setdefault(s, len(place)) for s in seqs], np.int64) for seqs in (seq_e, seq_t))
        seqs = list(place)
        of, element = _bags(seqs)
        bound = np.searchsorted(of, np.arange(len(seqs) + 1))
        n, element = np.diff(bound), element.tolist()
        bags = [set(element[x:y]) for x, y in zip(bound[:-1].tolist(), bound[1:].tolist())]
        longer = np.maximum(n[e], n[t])
        limits = np.floor(edits * longer).astype(np.int64)
        out = np.zeros(len(e), bool)
        # A token that only one side has costs an edit.
        todo = np.flatnonzero(longer - np.array([len(bags[x] & bags[y]) for x, y in zip(e.tolist(), t.tolist())], np.int64) <= limits)
        del element, bags
        codes = {i: np.frombuffer(seqs[i], np.uint16) for i in {*e[todo].tolist(), *t[todo].tolist()}}
        plain = {i: c[c != 0] for i, c in codes.items()}
        out[todo] = distances([(plain[e[i]], plain[t[i]]) for i in todo], limits[todo]) <= limits[todo]
        todo = todo[~out[todo]]
        ordered = [aligned(codes[e[i]], codes[t[i]]) for i in todo]
        moved = np.array([not np.array_equal(b, plain[t[i]]) for i, (_, b) in zip(todo, ordered)], bool)
        out[todo[moved]] = distances([pair for pair, is_moved in zip(ordered, moved) if is_moved], limits[todo[moved]]) <= limits[todo[moved]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens_until, at = np.cumsum(batch.column("n_held").to_numpy().astype(np.int64) + batch.column("n_train").to_numpy()), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(tokens_until, (tokens_until[at - 1] if at else 0) + VERIFIED, "right")))
                part = batch.slice(at, end - at)
                seq_e, seq_t = (part.column(c).to_pylist() for c in ("seq_held", "seq_train"))
                yield pa.record_batch([part.column(c) for c in ("held", "train")], names=["held", "train"]).filter(pa.array(near(seq_e, seq_t)))
                at = end

    return run


def class_overlaps(records: DataFrame, row: str, text: str, held: str, edits: float = EDITS) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes of exact copies, ``(held_class, train_class)``, and the classes: ``(row, held, class)``.

    A class is named by its smallest row and has the rows of one side only. See :func:`split_overlaps`.
    """
    texts = records.select(F.col(row).cast("long").alias("row"), F.col(held).alias("held"), F.col(text).alias("text")).where("text IS NOT NULL AND held IS NOT NULL")
    digest = F.unhex(F.md5(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")).cast("binary")))
    coded = materialize(texts.select("row", "held", "text", digest.alias("digest")).mapInArrow(_encode, "row long, held boolean, digest binary, seq binary, n int"))
    reps = materialize(coded.groupBy("digest", "held").agg(F.min("row").alias("class")))
    strings = coded.join(reps.select(F.col("class").alias("row")), "row", "left_semi").select("row", "held", "seq", "n")
    near = near_bags(strings, edits)
    of = {name: coded.where(F.col("held") == is_held).select(F.col("row").alias(name), F.col("seq").alias(f"seq_{name}"), F.col("n").alias(f"n_{name}")) for name, is_held in (("held", True), ("train", False))}
    both = [f"{c}_{side}" for c in ("seq", "n") for side in ("held", "train")]
    verified = near.join(of["held"], "held").join(of["train"], "train").select("held", "train", *both).mapInArrow(_verify(edits), "held long, train long")
    same = reps.where("held").select("digest", F.col("class").alias("held")).join(reps.where("NOT held").select("digest", F.col("class").alias("train")), "digest")
    pairs = verified.unionByName(same.select("held", "train")).distinct().toDF("held_class", "train_class")
    return pairs, coded.select("row", "held", "digest").join(reps, ["digest", "held"]).select("row", "held", "class")


def kept_segments(segments: DataFrame, windows: DataFrame, edits: float, spoilt: float, matches: int) -> DataFrame:
    """The ``k + need`` segments of each evaluation string that the fewest train strings hold; ``need`` must match."""
    short, n = F.col("n") <= SHORT, F.col("n")
    k = F.when(short, F.floor(edits / (1 - edits) * n + 1e-9)).otherwise(F.floor(spoilt * n + 1e-9)).cast("int")
    counts = windows.groupBy("h").agg(F.count("*").alias("times"))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.coalesce("times", F.lit(0)), "h", "off"))
    ranked = segments.join(counts, "h", "left").withColumns({"k": k, "need": F.when(short, 1).otherwise(matches), "rank": rank})
    return ranked.where(F.col("rank") <= F.col("k") + F.col("need")).select("h", "row", "n", "off", "k", "need")


def split_overlaps(records: DataFrame, row: str, text: str, held: str, **parameters) -> DataFrame:
    """``(held_row, train_row)`` of every pair that is the same or within ``edits`` (a share of the longer one's tokens).

    ``records`` has a unique BIGINT ``row``, a ``text`` and the BOOLEAN ``held`` (true: of an evaluation split, false: of
    train, null: of neither). Null texts are in no pair; texts without tokens are in pairs with their exact copies only.
    Repeated rows all occur. Other columns aren't read. All pairs of two classes are listed: :func:`class_overlaps` is the
    form without. ``parameters`` are its own.
    """
    pairs, classes = class_overlaps(records, row, text, held, **parameters)
    of_held = classes.where("held").select(F.col("class").alias("held_class"), F.col("row").alias("held_row"))
    of_train = classes.where("NOT held").select(F.col("class").alias("train_class"), F.col("row").alias("train_row"))
    return pairs.join(of_held, "held_class").join(of_train, "train_class").select("held_row", "train_row")
