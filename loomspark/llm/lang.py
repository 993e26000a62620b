"""Language of a text by hashed 4-grams of characters, trained on the corpus's own labels.

The labels may be partly missing or wrong: every labelled text is counted, and the majority decides what an n-gram
says. Names and keys that occur in all languages alike hence say nothing. The model is a table of fixed size.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BINS = 1 << 16
LEAST_SHARE = 0.005
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(0x10000)), bool, 0x10000))
    return _LETTER[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the 4-grams of letters and blanks of the joined texts, and where each text begins in them."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer((" " + "   ".join(lowered) + "   ").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[np.minimum(codes, 0xFFFF)], codes, 32).astype(np.uint64)
    two = codes[:-1] * np.uint64(1_000_003) + codes[1:]
    four = two[:-2] * np.uint64(1_000_003 * 1_000_003) + two[2:]
    bins = ((four * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    bins[(codes[1:-2] == 32) & (codes[2:-1] == 32)] = -1  # between words
    starts = np.concatenate([[0], np.cumsum([len(t) + 3 for t in lowered])[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)
    return bins, starts


#: Characters that are looked at together, which bounds the memory however long texts are.
_TOGETHER = 200_000


def pieces(texts: list[str], most: int = _TOGETHER) -> Iterator[tuple[list[int], list[str]]]:
    """Runs of at most about ``most`` characters: whose they are, and the texts or parts of long ones.

    Parts overlap by three characters, so that every 4-gram is in one of them.
    """
    owners, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text), 1), most):
            part = text[at : at + most + 3]
            owners.append(i), parts.append(part)
            size += len(part)
            if size > most:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # (BINS + 1, languages): log-probabilities less their mean; the last row is 0

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-likelihoods (texts, languages), relative to the mean of all languages."""
        out = np.zeros((len(texts), len(self.languages)), np.float32)
        for owners, parts in pieces(texts):
            bins, starts = grams(parts)
            np.add.at(out, owners, np.add.reduceat(self.weights[bins], starts, axis=0))
        return out

    def detect(self, texts: list[str], margin: float = 4.0) -> tuple[list[str | None], np.ndarray]:
        """The likeliest language of each text, or None where it leads by less than ``margin`` nats; and the scores."""
        s = self.scores(texts)
        if not len(texts) or not self.languages:
            return [None] * len(texts), s
        order = np.sort(s, 1)
        lead = order[:, -1] - (order[:, -2] if s.shape[1] > 1 else 0)
        return [self.languages[i] if d >= margin else None for i, d in zip(s.argmax(1), lead)], s


def train_languages(labelled: DataFrame, lang: str, text: str, least_share: float = LEAST_SHARE) -> LanguageModel:
    """Counts the n-grams of all texts (STRING or ARRAY<STRING>) with a label; languages below ``least_share`` of the rows are ignored.

    Labels are counted first, and only those that many rows have are counted further: at most ``1 / least_share`` languages
    times ``BINS`` counts reach a task or the driver (4 bytes each there, 52 MB by default), whatever the numbers of texts and labels.
    """
    per_label = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n"))
    enough = per_label.join(F.broadcast(per_label.agg(F.sum("n").alias("all"))), F.col("n") >= least_share * F.col("all"))  # one row
    languages = sorted(r["lang"] for r in enough.select("lang").collect())
    labelled = labelled.where(F.col(lang).isin(languages)) if languages else labelled.where("false")
    many = labelled.schema[text].dataType.typeName() == "array"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for label, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if label is None or value is None:
                    continue
                held.setdefault(label, np.zeros(BINS + 1, np.int64))
                by.setdefault(label, []).extend([t for t in value if t] if many else [value])
            for label, texts in by.items():
                for _, parts in pieces(texts):
                    bins = grams(parts)[0]
                    held[label] += np.bincount(np.where(bins < 0, BINS, bins), minlength=BINS + 1)
        for label, counts in held.items():
            nz = np.flatnonzero(counts[:BINS])
            yield pa.record_batch(
                [pa.array([label] * len(nz), pa.string()), pa.array(nz), pa.array(counts[nz])], names=["lang", "bin", "n"]
            )

    sums = labelled.select(lang, text).mapInArrow(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    got = sums.toPandas()
    weights = np.zeros((BINS + 1, len(languages)), np.float32)
    for i, k in enumerate(languages):
        part = got[got["lang"] == k]
        counts = np.zeros(BINS)
        counts[part["bin"].to_numpy(np.int64)] = part["n"].to_numpy()
        total = max(counts.sum(), 1)
        weights[:BINS, i] = np.log((counts + 2e-6 * total) / (total * (1 + 2e-6 * BINS)))
    weights[:BINS] -= weights[:BINS].mean(1, keepdims=True) if languages else 0
    return LanguageModel(languages, weights)
