"""Near-duplicate lines by an edit-distance join on segments.

If two lines are within an edit distance of t, one of the t + 1 equal segments of the
one stands unchanged in the other, shifted by a few places at most.  Every line is
indexed by its segments; every line probes, for each length that its partner may have,
the substrings at those places where the segment can stand.  What meets is verified by
a banded bit-parallel edit distance.

Groups never expand into all pairs: lines that meet on one key are compared with hubs
first, and only those left in different classes are compared with one another.  Lengths
and the parities of their pairs of characters, of which an edit changes four at most, are
compared as the lines meet, so pairs that cannot link are never made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm import arrays, graph
from tallygrid.llm.store import Scratch

#: Largest edit distance, in characters, and how many characters a line must have for
#: each edit that is allowed.
EDITS = 2
CHARS_PER_EDIT = 10
#: Numbers of 64 bits for the parities of a line, and bits that one edit may change.
PARITIES = 4
PER_EDIT = 4
#: Below this size a list of lines goes to every task; a larger one is joined.
BROADCAST_BYTES = 16 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5


def within(a: str, b: str, most: int) -> bool:
    """Is the edit distance of two strings ``most`` or less?

    Common ends are cut off.  Each character of ``b`` then updates a window of
    ``2 most + 1`` rows of the distance table, kept as the bits of two numbers.
    """
    n = min(len(a), len(b))
    if abs(len(a) - len(b)) > most:
        return False
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    head = np.flatnonzero(x[:n] != y[:n])
    head = int(head[0]) if len(head) else n
    n -= head
    tail = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
    tail = int(tail[0]) if len(tail) else n
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) <= most or len(b) <= most:
        return len(a) <= most and len(b) <= most or _table(a, b) <= most
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, low = (1 << (2 * most + 1)) - 1, 1 << (2 * most)
    up, down, distance = full & ~((1 << most) - 1), 0, most
    for j, c in enumerate(b, 1):
        at = j - most - 1  # place in ``a`` of the window's first row
        equal = where.get(c, 0)
        equal = (equal >> at if at >= 0 else equal << -at) & full
        same = ((((equal & up) + up) ^ up) | equal | down) & full
        right = (down | ~(same | up)) & full
        left = same & up
        if j + most <= len(a):
            distance += not same & low
        else:
            row = 1 << (len(a) - j + most)
            distance += bool(right & row) - bool(left & row)
        if distance > most + min(len(b) - j, len(b) - len(a) + most):
            return False
        up, down = (left | ~(same >> 1 | right)) & full, same >> 1 & right
    return distance <= most


def _table(a: str, b: str) -> int:
    """Edit distance of strings of which one is very short."""
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def allowed(length, edits: int = EDITS, chars: int = CHARS_PER_EDIT):
    """Edits allowed to a pair whose longer line has this length."""
    return np.minimum(edits, np.asarray(length) // chars)


class Lines:
    """The lines with a word of some texts, with running hashes over characters."""

    def __init__(self, column: pa.Array):
        texts = column.fill_null("").to_pylist()
        joined = "\n".join([*texts, ""])
        data = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.flatnonzero(data == 10)
        starts = np.append(0, ends[:-1] + 1)
        blank = (data == 32) | (data >= 9) & (data <= 13)
        filled = np.append(0, np.cumsum(~blank))
        owner = np.repeat(np.arange(len(texts)), [t.count("\n") + 1 for t in texts])
        number = np.arange(len(owner)) - np.searchsorted(owner, owner)
        use = filled[ends] > filled[starts]
        self.start, self.size = starts[use], (ends - starts)[use]
        self.owner, self.number = owner[use], number[use]
        ups, self.down = arrays._power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(arrays.mix(data.astype(np.uint64) + _U(1)) * ups[: len(data)], out=self.sums[1:])
        self.hash = arrays.mix(self.part(self.start, self.size) + self.size.astype(np.uint64))

    def part(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start]

    def parities(self, at: np.ndarray) -> np.ndarray:
        """Whether the number of pairs of neighbouring characters that fall on a bit is odd:
        one row of numbers for each of the lines ``at``."""
        bits = 64 * PARITIES
        size = np.maximum(self.size[at] - 1, 0)
        ends = np.cumsum(size)
        place = np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        pair = arrays.mix(self.part(place, np.full(len(place), 2))) % _U(bits)
        line = np.repeat(np.arange(len(at)), size)
        odd = np.bincount(line * bits + pair.astype(np.int64), minlength=len(at) * bits) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(len(at), PARITIES)

    def entries(self, at: np.ndarray, edits: int, chars: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the lines ``at``, and twice the number of the line in ``at``, plus one
        where the key is an index entry (the longer line of a pair is the indexed one)."""
        keys, who = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        size, start = self.size[at], self.start[at]
        for longer in range(edits + 1):
            whole = size + longer
            most = allowed(whole, edits, chars)
            for t in range(max(1, longer), edits + 1):
                lines = np.flatnonzero(most == t)
                if not len(lines):
                    continue
                length = whole[lines]
                for i in range(t + 1):
                    place, stop = i * length // (t + 1), (i + 1) * length // (t + 1)
                    lo = max(-i, -longer - (t - i))
                    hi = min(i, -longer + (t - i))
                    for shift in range(lo, hi + 1):
                        ok = (place + shift >= 0) & (stop + shift <= size[lines])
                        some = lines[ok]
                        part = self.part(start[some] + place[ok] + shift, (stop - place)[ok])
                        tag = (length[ok].astype(np.uint64) << _U(8)) + _U(i)
                        keys.append(arrays.mix(arrays.mix(part) + tag))
                        who.append(2 * some + (longer == 0 and shift == 0))
        return np.concatenate(keys), np.concatenate(who)


def _keys(source: DataFrame, edits: int, chars: int) -> DataFrame:
    """``key, line``: entries of every line, once per task; an indexed line is even."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.uint64)
        for batch in arrays.slices(batches):
            lines = Lines(batch.column("text"))
            _, at = np.unique(lines.hash, return_index=True)
            place = np.searchsorted(known, lines.hash[at])
            place[place == len(known)] = 0
            if len(known):
                at = at[known[place] != lines.hash[at]]
            known = np.sort(np.concatenate([known, lines.hash[at]]))
            keys, who = lines.entries(at, edits, chars)
            name = lines.hash[at][who >> 1] & ~_U(1)
            name |= (1 - (who & 1)).astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(name.view(np.int64))], ["key", "line"]
            )

    return source.select("text").mapInArrow(run, "key long, line long")


def occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id, at, number, line`` for every line with a word: its document (``at`` is the
    row's place, for ids that repeat), its number there, and its 63-bit name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches):
            lines = Lines(batch.column("text"))
            owner = pa.array(lines.owner)
            name = (lines.hash & ~_U(1)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(owner), batch.column("at").take(owner),
                    pa.array(lines.number), pa.array(name),
                ],
                ["doc_id", "at", "number", "line"],
            )

    rows = docs.select("doc_id", "at", "text")
    return rows.mapInArrow(run, "doc_id long, at long, number long, line long")


def _texts(source: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """``line, text, n`` and parities ``s0``, ``s1``, ... of the ``wanted`` lines."""
    count = wanted.count()
    small = 8 * count <= BROADCAST_BYTES
    names = np.sort(wanted.toArrow().column("line").to_numpy()) if small else None
    shared = source.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches):
            texts = batch.column("text").fill_null("").to_pylist()
            lines = Lines(batch.column("text"))
            name = (lines.hash & ~_U(1)).view(np.int64)
            _, at = np.unique(name, return_index=True)
            if shared.value is not None:
                at = at[np.isin(name[at], shared.value)]
            split: dict[int, list[str]] = {}
            found = []
            for o, k in zip(lines.owner[at].tolist(), lines.number[at].tolist(), strict=True):
                if o not in split:
                    split[o] = texts[o].split("\n")
                found.append(split[o][k])
            sizes = pa.array(lines.size[at], pa.int32())
            bits = [pa.array(x) for x in lines.parities(at).T]
            yield pa.RecordBatch.from_arrays([pa.array(name[at]), pa.array(found, pa.string()), sizes, *bits], names)

    names = ["line", "text", "n", *(f"s{i}" for i in range(PARITIES))]
    kinds = "line long, text string, n int, " + ", ".join(f"s{i} long" for i in range(PARITIES))
    found = source.select("text").mapInArrow(run, kinds)
    if not small:
        found = found.join(wanted, "line", "left_semi")
    return scratch.keep(found.dropDuplicates(["line"]), f"texts-{count}")


def _linked(pairs: DataFrame, texts: DataFrame, edits: int, chars: int) -> DataFrame:
    """Those ``a, b`` of the pairs whose lines are within the edits allowed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            most = allowed([max(len(p), len(q)) for p, q in zip(x, y, strict=True)], edits, chars)
            keep = [within(p, q, t) for p, q, t in zip(x, y, most.tolist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("line").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("line").alias("b"), F.col("text").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    close = F.abs(F.length("x") - F.length("y")) <= edits
    return both.where(close).mapInArrow(run, "a long, b long")


def line_classes(
    source: DataFrame, scratch: Scratch, edits: int = EDITS, chars: int = CHARS_PER_EDIT
) -> tuple[DataFrame, DataFrame]:
    """``line, component`` of every line that meets another on a key, and the ``links``
    (a, b) that were found: enough to connect each class, not all of its pairs."""
    keys = _keys(source, edits, chars)
    line = F.col("line").bitwiseAND(F.lit(-2)).alias("line")
    index = F.col("line").bitwiseAND(F.lit(1)) == 0
    name = F.col("line").bitwiseAND(F.lit(-2))
    shared = keys.groupBy("key").agg(
        F.min(name).alias("lo"), F.max(name).alias("hi"), F.max(index.cast("int")).alias("indexed")
    )
    shared = shared.where("lo <> hi and indexed = 1").select("key")
    posts = keys.join(shared, "key").select("key", line, index.cast("int").alias("indexed"))
    posts = scratch.keep(posts.groupBy("key", "line").agg(F.max("indexed").alias("indexed")), "posts")
    lines = posts.select("line").distinct()
    texts = _texts(source, lines, scratch)
    labels = lines.select("line", F.col("line").alias("component"))

    # three hubs of each key among the indexed lines
    hashed = [F.when(F.col("indexed") == 1, F.xxhash64("line", F.lit(k))) for k in range(3)]
    hubs = posts.groupBy("key").agg(*(F.min_by("line", h).alias(f"h{k}") for k, h in enumerate(hashed)))
    met = posts.join(hubs, "key").select("line", F.explode(F.array("h0", "h1", "h2")).alias("hub"))
    stars = met.where("line <> hub").select(F.least("line", "hub").alias("a"), F.greatest("line", "hub").alias("b"))
    first = scratch.keep(_linked(stars.distinct(), texts, edits, chars), "links-1")
    labels = _merged(labels, first, scratch, "1")

    known = posts.join(labels, "line")
    ends = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    left = known.join(ends.where("lo <> hi").select("key"), "key")
    shorts = [f"s{i}" for i in range(PARITIES)]
    left = scratch.keep(left.join(texts.select("line", "n", *shorts), "line"), "across")
    one = left.where("indexed = 1").select(
        "key", F.col("line").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"),
        *[F.col(c).alias(f"a_{c}") for c in shorts],
    )
    two = left.select(
        F.col("key").alias("_key"), F.col("line").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"),
        *[F.col(c).alias(f"b_{c}") for c in shorts],
    )
    differ = sum(F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in shorts)
    near = (F.abs(F.col("na") - F.col("nb")) <= edits) & (differ <= PER_EDIT * edits)
    pairs = one.join(two, F.expr("key = _key and a <> b and ca <> cb") & near)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    second = scratch.keep(_linked(pairs, texts, edits, chars), "links-2")
    return _merged(labels, second, scratch, "2"), first.union(second)


def _merged(labels: DataFrame, found: DataFrame, scratch: Scratch, step: str) -> DataFrame:
    a = labels.select(F.col("line").alias("a"), F.col("component").alias("ca"))
    b = labels.select(F.col("line").alias("b"), F.col("component").alias("cb"))
    links = found.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joined = graph.components(links, scratch, f"graph-{step}")
    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = labels.join(joined, "component", "left")
    return scratch.keep(
        moved.select("line", F.coalesce("to", "component").alias("component")), f"labels-{step}"
    )


def near_lines(docs: DataFrame, edits: int = EDITS, chars: int = CHARS_PER_EDIT) -> DataFrame:
    """``doc_id, at, number, line, class, removed`` for every line with a word.

    Two lines link when their edit distance, in characters, is at most ``edits`` and at
    most one for every ``chars`` characters of the longer; equal lines are one line; a
    class is what links connect.  Its first occurrence, by doc_id (null last), row and
    number, stays; all others are ``removed``.  Null, empty and blank texts have no
    lines; documents with one id count as different rows.  Only doc_id and text are
    read.  The input should be a stored table, whose rows keep their places.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    source = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"),
        F.monotonically_increasing_id().alias("at"),
    )
    labels, _ = line_classes(source, scratch, edits, chars)
    rows = scratch.keep(occurrences(source), "occurrences")
    rows = rows.join(labels, "line", "left").withColumn("class", F.coalesce("component", "line"))
    rows = scratch.keep(rows.drop("component"), "classed")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at", "number")
    first = rows.groupBy("class").agg(F.min(place).alias("first"))
    both = rows.join(first, "class")
    stays = (F.col("at") == F.col("first.at")) & (F.col("number") == F.col("first.number"))
    return both.select("doc_id", "at", "number", "line", "class", (~stays).alias("removed"))


def per_document(docs: DataFrame, edits: int = EDITS, chars: int = CHARS_PER_EDIT) -> DataFrame:
    """``doc_id, n_lines, n_removed`` per row of ``docs``: lines with a word, and those of
    them that a line elsewhere, or before, makes needless.  Rows without lines have zeros."""
    lines = near_lines(docs, edits, chars)
    counts = lines.groupBy("at").agg(
        F.count("*").alias("n_lines"), F.sum(F.col("removed").cast("long")).alias("n_removed")
    )
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("at")
    )
    zero = F.lit(0).cast("long")
    return rows.join(counts, "at", "left").select(
        "doc_id", F.coalesce("n_lines", zero).alias("n_lines"),
        F.coalesce("n_removed", zero).alias("n_removed"),
    )
