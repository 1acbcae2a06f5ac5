"""Language identification by string kernels.

The kernel of two texts counts the character n-grams, of several lengths, that are
present in both, and is normalised by the number in each.  A bounded sample of labelled
texts gives landmarks (Nystroem): a text is described by its kernel values with them,
whitened by their own kernel matrix, and one ridge regression per language against the
rest gives its scores.  Texts are scored in batches: a matrix of n-gram presence times
that of the landmarks, times the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm import arrays
from tallygrid.llm.store import Scratch

LENGTHS = (1, 2, 3)
#: Bounds of the sample, over all languages: texts that serve as landmarks, and texts
#: that the regression learns from.
LANDMARKS = 128
TRAIN_TEXTS = 2048
#: Letters told apart, the most frequent of the sample; all others are one symbol more.
ALPHABET = 62
RIDGE = 1e-4
MANY_LANGUAGES = 10_000
UNKNOWN = "und"

_tables: list[np.ndarray] = []


def lower_letters() -> np.ndarray:
    """Lower case of each code point that is a letter; 0 for all others."""
    if not _tables:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _tables.append(table)
    return _tables[0]


def letters_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of a run of texts with 0 for each run of anything else, and where
    each text begins; a text begins and ends with 0."""
    texts = column.to_pylist()
    joined = "\0" + "\0\0".join(t or "" for t in texts) + "\0"
    letter = lower_letters()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    size = np.array([len(t or "") + 2 for t in texts], np.int64)
    first = np.append(0, np.cumsum(size))
    keep = letter > 0
    keep[1:] |= letter[:-1] > 0
    keep[first[:-1]] = True
    place = np.append(0, np.cumsum(keep))
    return letter[keep], place[first]


@dataclass
class Grams:
    """Numbers of n-grams over a small alphabet: lengths first, then symbols."""

    symbol: np.ndarray  # of each code point: 0 blank, 1 to n known letters, n + 1 others

    @classmethod
    def over(cls, alphabet: list[int]) -> Grams:
        table = np.full(0x110000, len(alphabet) + 1, np.int32)
        table[0] = 0
        table[alphabet] = np.arange(1, len(alphabet) + 1)
        return cls(table)

    @property
    def base(self) -> int:
        return int(self.symbol.max()) + 1

    @property
    def size(self) -> int:
        return sum(self.base**n for n in LENGTHS)

    def sets(self, column: pa.Array) -> Iterator[np.ndarray | None]:
        """The distinct n-grams of each text; None where it has no letter."""
        letter, first = letters_of(column)
        symbol = self.symbol[letter]
        codes, shift = [], 0
        for n in LENGTHS:
            code = symbol[: max(0, len(symbol) - n + 1)]
            for j in range(1, n):
                code = code * self.base + symbol[j : len(symbol) - n + 1 + j]
            codes.append(code + shift)
            shift += self.base**n
        last = np.zeros(self.size, np.int32)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if not letter[a:b].any():
                yield None
                continue
            own = np.concatenate([c[a : max(a, b - n + 1)] for n, c in zip(LENGTHS, codes, strict=True)])
            at = np.arange(len(own), dtype=np.int32)
            last[own] = at  # one place of each n-gram stays
            yield own[last[own] == at]


@dataclass
class Model:
    grams: Grams
    langs: list[str]
    known: np.ndarray  # number of each n-gram among those of the landmarks, or -1
    marks: np.ndarray  # n-gram x landmark, presence
    size: np.ndarray  # n-grams of each landmark
    weights: np.ndarray | None = None  # landmark x language
    bias: np.ndarray | None = None

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Normalised kernel values of texts with the landmarks."""
        present = np.zeros((len(sets), len(self.marks)), np.float32)
        for i, s in enumerate(sets):
            at = self.known[s]
            present[i, at[at >= 0]] = 1
        own = np.array([len(s) for s in sets], np.float64)
        return (present @ self.marks) / np.sqrt(np.outer(own, self.size))

    def fit(self, rows: np.ndarray, langs: list[str]) -> None:
        """Ridge regression of +1 / -1 per language on whitened kernel rows."""
        among = (self.marks.T @ self.marks) / np.sqrt(np.outer(self.size, self.size))
        values, vectors = np.linalg.eigh(among.astype(np.float64))
        use = values > 1e-6 * values.max()
        white = vectors[:, use] / np.sqrt(values[use])
        x = rows @ white
        y = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        mean = x.mean(axis=0)
        x = x - mean
        gram = x.T @ x + RIDGE * len(x) * np.eye(x.shape[1])
        beta = np.linalg.solve(gram, x.T @ (y - y.mean(axis=0)))
        self.weights = white @ beta
        self.bias = y.mean(axis=0) - mean @ beta

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        sets = list(self.grams.sets(column))
        there = [i for i, s in enumerate(sets) if s is not None]
        pred, score = [UNKNOWN] * len(sets), np.zeros(len(sets))
        for at in range(0, len(there), 256):
            some = there[at : at + 256]
            value = self.kernel([sets[i] for i in some]) @ self.weights + self.bias
            best = value.argmax(axis=1)
            score[some] = np.clip((value[np.arange(len(some)), best] + 1) / 2, 0, 1)
            for i, b in zip(some, best.tolist(), strict=True):
                pred[i] = self.langs[b]
        return pred, score


def _sample(rows: DataFrame, texts: int) -> DataFrame:
    """``lang, text, rank``: about as many texts of each language, by hash of the id."""
    counts = rows.groupBy("lang").count()
    n = counts.count()
    quota = max(1, texts // max(n, 1))
    # twice the quota by a threshold, so that few texts are sorted
    share = F.least(F.lit(1.0), (F.lit(2.0 * quota) + 20) / F.col("count"))
    named = counts.select(F.col("lang").alias("_lang"), share.alias("share"))
    if n <= MANY_LANGUAGES:
        named = F.broadcast(named)  # of counted length; more are joined by exchange
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / (1 << 30)
    some = rows.join(named, F.col("lang") == F.col("_lang")).where(place < F.col("share"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    ranked = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= quota)
    return ranked.select("lang", "text", "rank")


def train(rows: DataFrame, landmarks: int, texts: int, scratch: Scratch) -> Model | None:
    """A model from labelled ``rows`` (doc_id, text, lang); None where there are none."""
    sample = scratch.keep(_sample(rows, texts), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in arrays.slices(batches):
            letter, _ = letters_of(batch.column("text"))
            at, n = np.unique(letter, return_counts=True)
            total[at] += n
        at = np.flatnonzero(total[1:]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["letter", "n"])

    letters = sample.select("text").mapInArrow(count, "letter long, n long")
    letters = letters.groupBy("letter").agg(F.sum("n").alias("n"))
    found = letters.orderBy(F.desc("n"), "letter").limit(ALPHABET).collect()
    if not found:
        return None
    grams = Grams.over([r["letter"] for r in found])
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())

    def mark_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches):
            sets = [s for s in grams.sets(batch.column("text")) if s is not None]
            blobs = [s.astype(np.int32).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary())], ["grams"])

    per_lang = max(1, landmarks // len(langs))
    first = sample.where(F.col("rank") <= per_lang).select("text")
    marks = first.mapInArrow(mark_sets, "grams binary").collect()
    sets = [np.frombuffer(r["grams"], np.int32) for r in sorted(marks, key=lambda r: bytes(r["grams"]))]
    vocab = np.unique(np.concatenate(sets))
    known = np.full(grams.size, -1, np.int32)
    known[vocab] = np.arange(len(vocab))
    presence = np.zeros((len(vocab), len(sets)), np.float32)
    for j, s in enumerate(sets):
        presence[known[s], j] = 1
    model = Model(grams, langs, known, presence, np.array([len(s) for s in sets], np.float64))
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def kernel_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches):
            sets = list(shared.value.grams.sets(batch.column("text")))
            there = [i for i, s in enumerate(sets) if s is not None]
            if there:
                rows = shared.value.kernel([sets[i] for i in there])
                lang = batch.column("lang").take(pa.array(there))
                yield pa.RecordBatch.from_arrays(
                    [lang, pa.array(rows.tolist(), pa.list_(pa.float64()))], ["lang", "row"]
                )

    learned = sample.select("lang", "text").mapInArrow(kernel_rows, "lang string, row array<double>")
    learned = sorted(((r["lang"], r["row"]) for r in learned.collect()))
    model.fit(np.array([r for _, r in learned]), [lang for lang, _ in learned])
    return model


def identify(
    docs: DataFrame,
    held_out: Column | None = None,
    landmarks: int = LANDMARKS,
    train_texts: int = TRAIN_TEXTS,
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row of ``docs``.

    Learns from the rows that are not ``held_out`` (by default those whose
    ``crc32(doc_id) mod 4`` is 2) and have id, text and lang: at most ``train_texts`` of
    them, spread over the languages.  Whole texts are read, and nothing but the text
    decides.  A null or empty text, or one without letters, is ``und`` with score 0; so
    is every text where nothing could be learned.  A null doc_id is neither held out nor
    learned from.  One row per input row; other columns than doc_id, text and lang are
    not read.
    """
    scratch = Scratch(docs.sparkSession, "language")
    doc_id = docs["doc_id"].cast("long")
    if held_out is None:
        held_out = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2
    rows = docs.select(
        doc_id.alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
        docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"),
    )
    labelled = rows.where("not held_out and doc_id is not null and lang is not null and text is not null")
    model = train(labelled.drop("held_out"), landmarks, train_texts, scratch)
    if model is None:
        return rows.select(
            "doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches):
            pred, score = shared.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    texts = rows.select("doc_id", "held_out", "text")
    return texts.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
