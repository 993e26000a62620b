"""Groups of records that are the same or differ by small edits, in any order of their entries.

Two texts are linked when the Jaccard similarity of their sets of ``WORDS``-word tokens is ``threshold`` or more; groups are
the connected components of the links. Links are found by a forest of signature trees (:mod:`loomspark.llm.forest`):

1. One pass over the texts gives each a digest, its set of tokens (16 bits each, 32 in long texts; sets of 16 bits are
   written in about 11 bits a token, without loss) and its *routing tokens*: those of its
   ``ROUTE_WORDS``-word tokens whose hashes end in as many zeros as leave about ``ROUTE`` to a text. Long and short texts
   keep them by the same rule, so what two texts share is kept by both. Exact copies are one class with one representative.
2. The root of the forest has a child for each routing token. A text hangs below its rarest ones only: with those sorted by
   the number of texts that have them, two texts that share ``least`` of their routing tokens share one of the first
   ``(1 - least) * n + 1``. Children of different tokens are node pairs that can't reach the overlap and aren't visited.
   The numbers are exact and come with the join, so there is no list of frequent tokens, and what only one text has,
   or what every text of a wording has, costs nothing. Tokens in equally many texts are ordered by their smallest text, which
   names the child, so the token itself needn't travel: which of those with the same child comes first makes no difference.
3. Children are named by their smallest text, so those with the same texts are one, and are trees over the bitmaps and
   sizes of their texts. A dual traversal of all trees of a task at once prunes node pairs by their greatest possible
   overlap and compares what is left exactly.
4. Children of more than ``tile`` texts are cut into tiles that all hold the first text. What that isn't linked to meets
   every tile in a second traversal between two forests, so no link between different components is lost.

No rows are capped or dropped. A pair over the threshold can be missed only if, by chance, fewer than ``least`` of its routing
tokens are common ones: a test measures it against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomspark.llm.components import SMALL_GRAPH_EDGES, connected_components
from loomspark.llm.forest import NARROW, Forest, links_between, links_within
from loomspark.llm.tokens import Hashes, tokens
from loomspark.runtime import discard, materialize

WORDS = 4
ROUTE_WORDS = 6
#: Routing tokens of a text: between this and twice as many, or all it has.
ROUTE = 16
THRESHOLD = 0.43
#: Share of the routing tokens that a pair over the threshold has in common at least.
LEAST = 0.25
TILE = 4096
#: Texts whose trees are traversed together.
_TOGETHER = 20_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Sets of up to so many 16-bit tokens are written as they are; larger ones, up to NARROW, by their low bytes and, as a bit
#: each, their rising high bytes. The bytes that takes for each size: more than 2 * PLAIN, and never two sizes alike.
PLAIN = 36
_CODED = np.arange(NARROW + 1) + (np.arange(NARROW + 1) + 263) // 8


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _shingles(words: np.ndarray, sizes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``w`` words from each place on, and whose they are; a shorter text has the one hash of all its words."""
    ends = np.cumsum(sizes)
    out = np.zeros(len(words), np.uint64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    left = ends[of] - np.arange(len(words))  # words from here to the text's end
    x = np.concatenate([words.astype(np.uint64), np.zeros(w, np.uint64)])
    for j in range(w):
        out = _mixed(out + np.where(left > j, x[j : j + len(out)], np.uint64(0)) + np.uint64(j + 1))
    keep = (left >= w) | (left == sizes[of])
    return out[keep], of[keep]


def _distinct(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, rising."""
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], of[new]


def _signatures(h: np.ndarray, of: np.ndarray, n: int) -> list[bytes]:
    """Sets of 16-bit tokens; of 32-bit ones for texts of more than ``NARROW``, where 16 bits would often coincide. :func:`unpacked` reads them."""
    wide = np.zeros(n, bool)
    if np.bincount(of, minlength=n).max(initial=0) > NARROW:
        h, of = _distinct(h, of)
        wide = np.bincount(of, minlength=n) > NARROW
    if wide.any():
        h = np.where(wide[of], h, h & np.uint32(0xFFFF0000))
    else:
        h = h & np.uint32(0xFFFF0000)
    both = np.sort(of.astype(np.uint64) << np.uint64(32) | h)
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    h, of = both.astype(np.uint32), (both >> np.uint64(32)).astype(np.int64)
    sizes = np.bincount(of, minlength=n)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    high = (h >> np.uint32(16)).astype(np.uint16)
    coded = ~wide & (sizes > PLAIN)
    # The k-th token of a set has the bit (high byte + k) of its bits, which fill whole bytes.
    held = np.where(coded, _CODED[np.minimum(sizes, NARROW)] - sizes, 0)
    at = np.concatenate([[0], np.cumsum(held)])
    bits = np.zeros(8 * at[-1], bool)
    mine = coded[of]
    bits[(8 * at[of] + (high >> np.uint16(8)) + np.arange(len(h)) - cuts[of])[mine]] = True
    bits, low, high, full = np.packbits(bits).tobytes(), high.astype(np.uint8).tobytes(), high.tobytes(), h.tobytes() if wide.any() else b""
    return [
        full[4 * a : 4 * b] if w else low[a:b] + bits[c:d] if d > c else high[2 * a : 2 * b]
        for w, a, b, c, d in zip(wide.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), at[:-1].tolist(), at[1:].tolist())
    ]


def unpacked(sigs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of signatures in the high bits of uint32, joined, and the sizes of the sets. The length says how a set is written."""
    lengths = np.fromiter(map(len, sigs), np.int64, len(sigs))
    plain, wide = lengths <= 2 * PLAIN, lengths > _CODED[-1]
    coded = ~plain & ~wide
    sizes = np.where(plain, lengths // 2, lengths // 4)
    sizes[coded] = np.searchsorted(_CODED, lengths[coded])
    out = np.empty(sizes.sum(), np.uint32)

    def joined(which: np.ndarray, kind) -> np.ndarray:
        return np.frombuffer(b"".join(s for s, w in zip(sigs, which.tolist()) if w), kind)

    out[np.repeat(plain, sizes)] = joined(plain, np.uint16).astype(np.uint32) << np.uint32(16)
    if wide.any():
        out[np.repeat(wide, sizes)] = joined(wide, np.uint32)
    if coded.any():
        raw, n, size = joined(coded, np.uint8), sizes[coded], lengths[coded]
        low = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size) < np.repeat(n, size)
        begin = 8 * (np.cumsum(size - n) - (size - n)) - (np.cumsum(n) - n)
        high = np.flatnonzero(np.unpackbits(raw[~low])) - np.arange(len(raw[low])) - np.repeat(begin, n)
        out[np.repeat(coded, sizes)] = (high.astype(np.uint32) << np.uint32(8) | raw[low]) << np.uint32(16)
    return out, sizes


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = Hashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            lists = [np.fromiter(map(cache.__getitem__, tokens(t)), np.uint32) for t in part.column(1).to_pylist()]
            n, sizes = len(lists), np.fromiter(map(len, lists), np.int64, len(lists))
            words = np.concatenate(lists) if lists else np.zeros(0, np.uint32)
            h, of = _shingles(words, sizes, WORDS)
            sigs = _signatures((h >> np.uint64(32)).astype(np.uint32), of, n)
            h, of = _shingles(words, sizes, ROUTE_WORDS)
            zeros = np.maximum(np.ceil(np.log2(np.maximum(np.bincount(of, minlength=n), 1) / (2 * ROUTE))), 0).astype(np.uint64)
            keep = h & ((np.uint64(1) << zeros) - np.uint64(1))[of] == 0
            keep |= (np.bincount(of[keep], minlength=n) == 0)[of]  # where chance leaves none, all
            h, of = _distinct(h[keep], of[keep])
            cuts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
            yield pa.record_batch(
                [
                    part.column(0), part.column(2),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(h.view(np.int64))),
                    pa.array(sigs, pa.binary()),
                ],
                names=["row", "digest", "route", "sig"],
            )


def _links(out: list[tuple[int, int, bool]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.bool_())], names=["src", "dst", "linked"])


def _join_blocks(center: np.ndarray, block: np.ndarray, row: np.ndarray, tokens_: np.ndarray, sizes: np.ndarray, flag: np.ndarray, threshold: float, second: bool) -> list[tuple[int, int, bool]]:
    """Links within blocks whose ``flag`` says that they are tiles; or, the second time, between the flagged texts of a block and the others."""
    if not second:
        links, labels = links_within(Forest(block, tokens_, sizes), block, threshold)
        out = [(int(row[i]), int(row[j]), True) for i, j in links]
        if flag.any():
            root = labels.roots()
            home = {b: root[i] for i, b in enumerate(block.tolist()) if row[i] == center[i]}
            # Texts of a tile outside the centre's component are named with a link to themselves.
            out += [(int(row[i]), int(center[i]), False) for i in np.flatnonzero(flag).tolist() if root[i] != home.get(int(block[i]), -1)]
        return out
    both = np.intersect1d(block[flag], block[~flag])
    mine = np.isin(block, both)
    starts = np.concatenate([[0], np.cumsum(sizes)])

    def side(which: np.ndarray, levels: int = 0) -> tuple[Forest, np.ndarray]:
        at = np.flatnonzero(mine & which)
        held = np.concatenate([tokens_[starts[i] : starts[i + 1]] for i in at]) if len(at) else tokens_[:0]
        return Forest(block[at], held, sizes[at], levels), row[at]

    (a, ra), (b, rb) = side(flag), side(~flag)
    if len(a.levels) < len(b.levels):
        a, ra = side(flag, len(b.levels))
    elif len(b.levels) < len(a.levels):
        b, rb = side(~flag, len(a.levels))
    return [(int(ra[i]), int(rb[j]), True) for i, j in links_between(a, b, threshold)]


def _blocks(threshold: float, second: bool):
    """Consecutive rows of one (center, tile) form a block; the centre, if it is there, has row == center."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush():
            nonlocal held, size
            center, tile, row, flag = (np.concatenate([h[k] for h in held]) for k in (0, 1, 2, 4))
            sigs = [s for h in held for s in h[3]]
            joined, sizes = unpacked(sigs)
            new = np.append(True, (center[1:] != center[:-1]) | (tile[1:] != tile[:-1]))
            held, size = [], 0
            return _links(_join_blocks(center, np.cumsum(new), row, joined, sizes, flag, threshold, second))

        for batch in batches:
            if not batch.num_rows:
                continue
            center, tile, row = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
            sigs, flag = batch.column(3).to_pylist(), np.array(batch.column(4).to_pylist(), bool)
            new = (center != np.append(center[:1], center[:-1])) | (tile != np.append(tile[:1], tile[:-1]))
            new[0] = last is None or last != (center[0], tile[0])
            cut = 0
            for at in np.flatnonzero(new).tolist():
                if size + at - cut >= _TOGETHER:
                    if at > cut:
                        held.append((center[cut:at], tile[cut:at], row[cut:at], sigs[cut:at], flag[cut:at]))
                    if held:
                        yield flush()
                    cut = at
            held.append((center[cut:], tile[cut:], row[cut:], sigs[cut:], flag[cut:]))
            size += len(center) - cut
            last = (center[-1], tile[-1])
        if held:
            yield flush()

    return run


def near_duplicate_classes(
    records: DataFrame, row: str, text: str, threshold: float = THRESHOLD, least: float = LEAST, tile: int = TILE, small_graph_edges: int = SMALL_GRAPH_EDGES
) -> DataFrame:
    """``(row, class_row, size)`` for each record with a text; class_row is the smallest row of its group.

    ``row`` must be a unique BIGINT. Null texts are left out; texts without any word are one group if they are the
    same but for case and white space; a text of fewer words than a token takes is like its copies only. Copies but
    for case and white space are always together. Other columns of ``records`` are not read.
    """
    texts = records.select(F.col(row).cast("long").alias("row"), F.col(text).alias("text")).where("text IS NOT NULL")
    digest = F.md5(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")).cast("binary"))
    described = materialize(
        texts.select("row", "text", F.unhex(digest).alias("digest")).mapInArrow(_describe, "row long, digest binary, route array<long>, sig binary")
    )
    copies = materialize(described.groupBy("digest").agg(F.min("row").alias("rep"), F.count("*").alias("n")))
    pairs, used = similar_links(described, copies.select(F.col("rep").alias("row")), threshold, least, tile)
    comps = connected_components(pairs, small_graph_edges)  # a written table
    for table in used:
        discard(table)
    grouped = (
        copies.join(comps.withColumnRenamed("vertex", "rep"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    total = grouped.groupBy("component").agg(F.min("rep").alias("class_row"), F.sum("n").alias("size"))
    of_digest = grouped.select("digest", "component").join(total, "component").select("digest", "class_row", "size")
    return described.select("row", "digest").join(of_digest, "digest").select(F.col("row").alias(row), "class_row", "size")


def similar_links(described: DataFrame, reps: DataFrame, threshold: float, least: float, tile: int) -> tuple[DataFrame, list[DataFrame]]:
    """``(src, dst)``: links that span the components of ``described(row, route, sig)``; and the tables they read.

    ``reps(row)`` is one of each set of copies, the smallest; no other is compared.
    """
    # Shuffled once, for the numbers and the join; a filter that only the join's side got would keep Spark from reusing it.
    posted = described.select("row", F.explode("route").alias("token")).where("row IS NOT NULL AND token IS NOT NULL").repartition("token")
    shared = posted.groupBy("token").agg(F.count("*").alias("n"), F.min("row").alias("center")).where("n > 1")
    # Tokens of no other text come first in the order, so each text hangs below what is left of its prefix.
    hits = posted.join(shared, "token").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("n", "center"))).alias("hits"))
    of = described.select("row", F.size("route").alias("all")).join(reps, "row", "left_semi").join(hits, "row")
    prefix = F.floor(F.col("all") * (1 - least)) + 1 - (F.col("all") - F.size("hits"))
    below = of.where(prefix > 0).select("row", F.explode(F.array_distinct(F.transform(F.slice("hits", F.lit(1), prefix.cast("int")), lambda h: h["center"]))).alias("center"))
    member = materialize(below.where("row <> center").select("center", "row"))
    sigs = described.select("row", "sig")
    sizes = member.groupBy("center").agg(F.count("*").alias("m"))
    wanted = member.unionByName(sizes.select("center", F.col("center").alias("row")))
    flag = F.col("m") > tile
    links = materialize(_run(_tiled(wanted.join(sizes, "center"), tile).join(sigs, "row").withColumn("flag", flag), threshold, False))
    pairs = links.where("linked").select("src", "dst")
    outside = links.where("NOT linked").select(F.col("src").alias("row"), F.col("dst").alias("center")).distinct().join(sizes.where(flag), "center")
    outside = materialize(outside)
    if not outside.isEmpty():
        n = F.ceil(F.col("m") / tile).cast("int")
        every = F.explode(F.sequence(F.lit(0), n - 1))
        at = F.pmod(F.xxhash64("row"), n).cast("int")
        here = outside.select("center", "row", n.alias("n"), at.alias("i"), every.alias("j"), F.lit(True).alias("flag"))
        theirs = _tiled(wanted.join(outside.select("center", "m").distinct(), "center"), tile)
        there = theirs.select("center", "row", n.alias("n"), every.alias("i"), F.col("tile").alias("j"), F.lit(False).alias("flag"))
        again = here.unionByName(there).select("center", "row", "flag", (F.col("i") * F.col("n") + F.col("j")).alias("tile")).join(sigs, "row")
        pairs = pairs.unionByName(_run(again, threshold, True).select("src", "dst"))
    return pairs, [member, links, outside]


def _tiled(members: DataFrame, tile: int) -> DataFrame:
    """Spreads a block over tiles by the hash of the row; its centre goes to all of them."""
    n = F.ceil(F.col("m") / tile).cast("int")
    at = F.when(F.col("row") == F.col("center"), F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.pmod(F.xxhash64("row"), n).cast("int")))
    return members.select("center", "row", "m", F.explode(at).alias("tile"))


def _run(blocks: DataFrame, threshold: float, second: bool) -> DataFrame:
    ready = blocks.select("center", "tile", "row", "sig", "flag").repartition("center", "tile").sortWithinPartitions("center", "tile", "row")
    return ready.mapInArrow(_blocks(threshold, second), "src long, dst long, linked boolean")


def duplicate_pairs(classes: DataFrame, row: str, rep: Column | None = None) -> DataFrame:
    """All pairs ``(row_a, row_b)``, a < b, of each class; only for results that are defined as all pairs."""
    c = classes.where("size > 1")
    a = c.select(F.col("class_row"), F.col(row).alias("row_a"))
    b = c.select(F.col("class_row"), F.col(row).alias("row_b"))
    return a.join(b, "class_row").where("row_a < row_b").select("row_a", "row_b")
