"""Benchmark decontamination by greedy string tiling.

A document is searched for runs of words that it shares with a benchmark item.  Seeds,
the windows of ``min_match`` words under a rolling hash, are joined with those of the
items; hits on one diagonal grow into maximal runs.  The longest run is marked in both
texts, what overlaps it is cut down to its unmarked rest, and so on until no run of
``min_match`` words is left.  The tiles do not overlap, so their sum is the part of the
item that the document holds, in whatever order.

The benchmark is the stated query set: it is cut into blocks of bounded size, and every
document meets every block in turn.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm import arrays

MIN_MATCH = 4
MIN_COVERAGE = 0.5
#: Text of one block of the benchmark, in bytes.
BLOCK_BYTES = 32 << 20

_U = np.uint64
#: Words are runs of letters and digits; case is folded before.
BREAKS = np.ones(256, bool)
BREAKS[ord("0") : ord("9") + 1] = False
BREAKS[ord("a") : ord("z") + 1] = False
BREAKS[0x80:] = False


@dataclass
class Block:
    """Seeds of some items: per window size the sorted hashes, and for each occurrence
    the item and the place in it."""

    ids: list
    words: np.ndarray  # words of each item
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def lowered(column: pa.Array) -> pa.Array:
    """Lower case, one character by one: the same for items and for documents."""
    return pc.utf8_lower(column)


def block_of(ids: list, texts: list[str], min_match: int = MIN_MATCH) -> Block:
    found = arrays.texts_of(lowered(pa.array(texts, pa.large_string())))
    spans = found.spans(BREAKS)
    n = np.diff(spans.first)
    seeds = {}
    for size, h, at in arrays.windows(spans, list(range(1, min_match + 1))):
        item = spans.owner[at]
        use = n[item] >= min_match if size == min_match else n[item] == size
        h, item, at = h[use], item[use], at[use]
        if len(h):
            order = np.argsort(h, kind="stable")
            h, item, at = h[order], item[order], at[order]
            near = np.zeros(1 << 20, bool)
            near[h >> _U(44)] = True
            seeds[size] = (h, item, at - spans.first[item], near)
    return Block(ids, n, seeds)


def tiles(hits: np.ndarray, size: int, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from ``hits``, rows (place in the item, place in the text) of equal
    windows of ``size`` words: (item start, text start, words), longest first; ties go
    to the earlier place in the item, then in the text."""
    hits = hits[np.lexsort((hits[:, 0], hits[:, 1] - hits[:, 0]))]
    diagonal = hits[:, 1] - hits[:, 0]
    new = np.ones(len(hits), bool)
    new[1:] = (diagonal[1:] != diagonal[:-1]) | (hits[1:, 0] != hits[:-1, 0] + 1)
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(hits))) + size - 1
    runs = [(-int(m), int(i), int(j)) for m, (i, j) in zip(lengths, hits[starts], strict=True)]
    heapq.heapify(runs)
    item_marked, text_marked, out = set(), set(), []
    while runs:
        m, i, j = heapq.heappop(runs)
        free = [i + k not in item_marked and j + k not in text_marked for k in range(-m)]
        if all(free):
            out.append((i, j, -m))
            item_marked.update(range(i, i - m))
            text_marked.update(range(j, j - m))
            continue
        at = 0
        while at < -m:
            to = at
            while to < -m and free[to]:
                to += 1
            if to - at >= min_match:
                heapq.heappush(runs, (at - to, i + at, j + at))
            at = to + 1
    return out


def matches(
    column: pa.Array, block: Block, min_match: int, min_coverage: float
) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
    """(text, item, words matched, tiles) where the tiles cover enough of the item."""
    texts = arrays.texts_of(lowered(column))
    spans = texts.spans(BREAKS)
    for size, h, at in arrays.windows(spans, list(range(1, min_match + 1))):
        if size not in block.seeds:
            continue
        known, item, place, near = block.seeds[size]
        maybe = np.flatnonzero(near[h >> _U(44)])
        lo, hi = (np.searchsorted(known, h[maybe], side) for side in ("left", "right"))
        maybe, lo, hi = (x[hi > lo] for x in (maybe, lo, hi))
        if not len(maybe):
            continue
        times = hi - lo
        seed = np.repeat(lo - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(times.sum())
        word = np.repeat(at[maybe], times)
        text = spans.owner[word]
        rows = np.stack([text, item[seed], place[seed], word - spans.first[text]], axis=1)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        cut = np.flatnonzero((np.diff(rows[:, :2], axis=0) != 0).any(axis=1)) + 1
        for part in np.split(rows, cut):
            t, q = int(part[0, 0]), int(part[0, 1])
            reach = np.unique((part[:, 2][:, None] + np.arange(size)).ravel())
            if len(reach) < min_coverage * block.words[q]:
                continue  # no tiling can cover more than all hits do
            found = tiles(part[:, 2:], size, min(size, min_match))
            matched = sum(m for _, _, m in found)
            if matched >= min_coverage * block.words[q]:
                yield t, q, matched, found


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[DataFrame]:
    """The benchmark in parts of about ``block_bytes`` of text each."""
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    ).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // block_bytes)
    for k in range(parts):
        yield items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)


def _shared(part: DataFrame, min_match: int):
    """One block, of checked size, for every task."""
    rows = part.collect()
    found = block_of([r["item_id"] for r in rows], [r["text"] for r in rows], min_match)
    return part.sparkSession.sparkContext.broadcast(found)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    min_match: int = MIN_MATCH,
    min_coverage: float = MIN_COVERAGE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document and benchmark item of which it holds ``min_coverage`` or more:
    ``doc_id, item_id, item_words, matched_words, n_tiles, coverage, tiles`` (each tile
    item start, document start and length, in words).

    Words are runs of letters and digits, case folded.  An item shorter than
    ``min_match`` words matches as a whole.  Null and empty texts on either side match
    nothing; null ids stay null; repeated rows give repeated results.  Only ``doc_id``,
    ``item_id`` and the texts are read.  Empty tables give an empty result.
    """
    names = ["doc_id", "item_id", "item_words", "matched_words", "n_tiles", "coverage", "tiles"]
    schema = (
        "doc_id long, item_id long, item_words long, matched_words long, n_tiles long, "
        "coverage double, tiles array<array<int>>"
    )
    kinds = [pa.int64()] * 5 + [pa.float64(), pa.list_(pa.list_(pa.int32()))]
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for part in blocks(benchmark, block_bytes):
        shared = _shared(part, min_match)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in arrays.slices(batches):
                rows = []
                ids = batch.column("doc_id")
                for t, q, matched, found in matches(
                    batch.column("text"), block, min_match, min_coverage
                ):
                    n = int(block.words[q])
                    tiled = [list(x) for x in found]
                    rows.append((ids[t].as_py(), block.ids[q], n, matched, len(found), matched / n, tiled))
                cols = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names
                )

        found = source.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    min_match: int = MIN_MATCH,
    min_coverage: float = MIN_COVERAGE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents that hold no item's share of ``min_coverage``; all columns as they were."""
    for part in blocks(benchmark, block_bytes):
        shared = _shared(part, min_match)

        @F.arrow_udf("boolean")
        def leaking(column: pa.Array) -> pa.Array:
            out = []
            for piece in arrays.slices(iter([pa.RecordBatch.from_arrays([column], ["text"])])):
                bad = np.zeros(piece.num_rows, bool)
                text = piece.column("text")
                for t, *_ in matches(text, shared.value, min_match, min_coverage):  # noqa: B023
                    bad[t] = True
                out.append(bad)
            return pa.array(np.concatenate([np.zeros(0, bool), *out]), pa.bool_())

        docs = docs.where(~leaking(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    return docs
