"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths mark, in each text, the words that lie in an
n-gram found twice or more; the rules bound the share of word characters so covered,
and the share of lines, and of their characters, that repeat an earlier line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm import arrays

#: Largest share of word characters inside repeated n-grams, by n.  Fixed values, as
#: published for repetition rules of large web corpora.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.30
LINE_CHAR_LIMIT = 0.20
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def measures(texts: arrays.Texts, limits: dict[int, float] | None = None) -> dict[str, np.ndarray]:
    """All measures of a run of texts, one value per text."""
    limits = NGRAM_LIMITS if limits is None else limits
    words = texts.spans()
    n_words = np.diff(words.first)
    leads = texts.counts(arrays.LEADS)
    chars = leads[words.end] - leads[words.start]
    word_chars = arrays.per_text(chars, words.first)
    salt = arrays.mix(np.arange(1, len(texts) + 1, dtype=np.uint64))

    symbols = texts.counts(SYMBOLS)[texts.offsets]
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": np.diff(symbols)}

    lines = texts.spans(breaks=arrays.NEWLINE)
    filled = texts.counts(~arrays.SPACES)
    has_word = filled[lines.end] > filled[lines.start]
    owner = lines.owner[has_word]
    again = arrays.later_copies(arrays.mix(lines.hash[has_word] ^ salt[owner]))
    line_chars = (leads[lines.end] - leads[lines.start])[has_word]
    count = lambda w=None: np.bincount(owner, w, minlength=len(texts))
    out["n_lines"] = count().astype(np.int64)
    out["n_dup_lines"] = count(again).astype(np.int64)
    out["line_chars"] = count(line_chars).astype(np.int64)
    out["dup_line_chars"] = count(line_chars * again).astype(np.int64)

    where = words.owner
    for n, grams, at in arrays.windows(words, sorted({5, *limits})):
        at = at[arrays.seen_twice(arrays.mix(grams ^ salt[where[at]]))]
        size = len(chars) + 1
        steps = np.bincount(at, minlength=size) - np.bincount(at + n, minlength=size)
        inside = np.cumsum(steps[: len(chars)]) > 0
        if n == 5:
            out["n_repeat_words"] = arrays.per_text(inside, words.first)
        if n in limits:
            out[f"dup_chars_{n}"] = arrays.per_text(chars * inside, words.first)
    return out


def score(docs: DataFrame, limits: dict[int, float] | None = None) -> DataFrame:
    """Measures and verdict per document: doc_id, n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, line_chars, dup_line_chars, n_repeat_words, dup_chars_<n>, base_failed, kept.

    Reads ``doc_id`` and ``text`` alone, so other columns may have any name.  One row
    per input row, repeated rows included.  A null or empty text has no words and is
    not kept; a null doc_id stays null.  An empty table gives an empty result.  No
    shuffle: whole texts are measured where they are read.
    """
    limits = NGRAM_LIMITS if limits is None else limits
    longs = [
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "line_chars",
        "dup_line_chars", "n_repeat_words", *(f"dup_chars_{n}" for n in limits),
    ]
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in longs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches):
            found = measures(arrays.texts_of(batch.column("text")), limits)
            cols = [batch.column("doc_id"), *(pa.array(found[c], pa.int64()) for c in longs)]
            cols += [pa.array(base_failed(found)), pa.array(verdict(found, limits))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *longs, "base_failed", "kept"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"{schema}, base_failed boolean, kept boolean")


def base_failed(found: dict[str, np.ndarray]) -> np.ndarray:
    n = found["n_words"]
    return (n < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * n)


def verdict(found: dict[str, np.ndarray], limits: dict[int, float]) -> np.ndarray:
    """Passes the base, and no share exceeds its limit."""
    bad = base_failed(found)
    bad |= found["n_dup_lines"] > LINE_LIMIT * found["n_lines"]
    bad |= found["dup_line_chars"] > LINE_CHAR_LIMIT * found["line_chars"]
    for n, limit in limits.items():
        bad |= found[f"dup_chars_{n}"] > limit * found["word_chars"]
    return ~bad


def keep_good(docs: DataFrame, limits: dict[int, float] | None = None) -> DataFrame:
    """The documents that pass, all columns as they were.

    The verdict is taken from the text of the row itself and adds no column, so no name
    clashes and neither a null nor a repeated doc_id matters.
    """
    limits = NGRAM_LIMITS if limits is None else limits

    @F.arrow_udf("boolean")
    def kept(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        parts = [np.zeros(0, bool)]
        for piece in arrays.slices(iter([batch])):
            parts.append(verdict(measures(arrays.texts_of(piece.column("text")), limits), limits))
        return pa.array(np.concatenate(parts), pa.bool_())

    return docs.where(kept(F.coalesce(docs["text"].cast("string"), F.lit(""))))
