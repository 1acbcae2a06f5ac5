"""Phrase collocations by Toivonen's sampling.

Words are counted first.  A sample of the texts is then mined level by level with a lowered
threshold: it proposes the longer phrases that are likely frequent.  One pass over all
texts counts these and their negative border, the phrases that are not proposed though both
their parts, without the last and without the first word, are.  A border phrase that turns
out to be frequent may hide longer ones: the last pass counts all that it opens, phrases of
any length whose parts are frequent or are counted in this pass too.  So every frequent
phrase is counted over all texts, whatever the sample proposed.

Until then phrases are hashes of 48 bits, which tasks add up and send as packed, sorted
arrays; those that reach the threshold form a bitmap of fixed size.  Where hashes or bits
coincide, more is taken for frequent.  The last pass counts what was so found once more,
spelled out, and only its counts are results: coincidences cost time, never a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallygrid.llm import arrays, katz
from tallygrid.llm.store import Scratch

LONGEST = 5
LEAST = 100
#: One row in so many is in the sample, copies one by one; there, a phrase is proposed
#: from this share of the threshold on.
SAMPLE = 8
LOWERED = 0.5
#: Bits of a bitmap: 16 MB.
BITS = 27
#: Entries that a task collects before it sends them; of spelled phrases, and of hashes.
ENTRIES = 1 << 20
HASHES = 1 << 19
#: Bytes of text that are worked on at a time.
SLICE = 1 << 19
#: Text for each part over which the hashes are dealt.
PART_BYTES = 8 << 20
#: Phrases that are put together at a time.
SPELLED = 1 << 14
#: One-word parts occur in many phrases: their joins are dealt over so many keys.
SALTS = 32
LANGUAGE_SALTS = 256

_U = np.uint64
CUTS = np.zeros(256, bool)
CUTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BREAKS = CUTS | arrays.SPACES
COUNTED = "lang string, phrase string, times long"


class Bitmap:
    """A set of hashes, each by two bits taken from its upper 48."""

    def __init__(self, words: np.ndarray):
        self.bits = words.view(np.uint8)

    @staticmethod
    def places(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = names & _U((1 << BITS) - 1)
        return low.astype(np.int64), (names >> _U(48 - BITS)).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        a, b = self.places(hashes >> _U(16))
        first = (self.bits[a >> 3] >> (a & 7).astype(np.uint8)) & 1
        second = (self.bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1
        return (first & second).astype(bool)


def salts(column: pa.Array) -> np.ndarray:
    """A hash of each language, so that equal words of two languages differ.  It is mixed once
    more than the hash of a phrase: a word that is its language's name would cancel it."""
    spans = arrays.texts_of(column)
    whole = spans.spans(breaks=np.zeros(256, bool))
    out = np.zeros(len(spans), np.uint64)
    out[whole.owner] = whole.hash
    return arrays.mix(arrays.mix(out + _U(1)) + _U(LONGEST + 1))


def pieces(texts: arrays.Texts) -> tuple[arrays.Spans, np.ndarray]:
    """Words of all texts, grouped by the piece they stand in, and the text of each word."""
    words = texts.spans(breaks=BREAKS, fold=arrays.LOWER)
    owner = words.owner
    cuts = texts.counts(CUTS)[words.start]
    fresh = (np.diff(owner, prepend=-1) != 0) | (np.diff(cuts, prepend=-1) != 0)
    first = np.append(np.flatnonzero(fresh), len(owner))
    return arrays.Spans(words.hash, words.start, words.end, first), owner


def grams(words: arrays.Spans, salt: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For lengths 1 to ``longest``: hash and first word of every phrase inside a piece."""
    found = arrays.windows(words, list(range(1, longest + 1)))
    return [(arrays.mix(h ^ salt[at]), at) for _, h, at in found]


def spelled(data: np.ndarray, words: arrays.Spans, at: np.ndarray, size: int) -> pa.Array:
    """The phrases of ``size`` words that begin at the words ``at``, joined by one space."""
    blocks = [_spelled(data, words, at[i : i + SPELLED], size) for i in range(0, len(at), SPELLED)]
    return pa.concat_arrays(blocks) if blocks else pa.array([], pa.large_string())


def _spelled(data: np.ndarray, words: arrays.Spans, at: np.ndarray, size: int) -> pa.Array:
    which = (at[:, None] + np.arange(size)).ravel()
    start, length = words.start[which], words.end[which] - words.start[which] + 1
    ends = np.cumsum(length)
    # every word with the byte after it, which becomes a space
    take = np.repeat(start - (ends - length), length) + np.arange(ends[-1])
    out = arrays.LOWER[data[np.minimum(take, len(data) - 1)]]
    out[ends - 1] = 0x20
    per_phrase = ends.reshape(-1, size)[:, -1]
    keep = np.ones(len(out), bool)
    keep[per_phrase - 1] = False
    offsets = np.concatenate([[0], per_phrase - np.arange(1, len(at) + 1)])
    parts = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[keep])]
    return pa.Array.from_buffers(pa.large_string(), len(at), parts)


def distinct(names: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct names, the place of one of each, and how often it occurs."""
    order = np.argsort(names)
    ordered = names[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(names) else order
    if times is None:
        total = np.diff(np.append(first, len(names)))
    else:
        total = np.add.reduceat(times[order], first) if len(names) else times
    return ordered[first], order[first], total


class Collected:
    """Counts of one task by phrase.  A phrase is spelled when it is met first; later on
    only its count grows.  All are sent when they are many."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.names, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted; where they stand
        self.times = np.zeros(0, np.int64)
        self.langs: list[pa.Array] = []
        self.phrases: list[pa.Array] = []

    def add(self, names: np.ndarray, times: np.ndarray, spell) -> None:
        """Count distinct sorted names; ``spell`` gives languages and phrases of some."""
        at = np.searchsorted(self.names, names)
        known = np.zeros(len(names), bool)
        inside = at < len(self.names)
        known[inside] = self.names[at[inside]] == names[inside]
        self.times[self.place[at[known]]] += times[known]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            langs, phrases = spell(fresh)
            self.langs.append(langs)
            self.phrases.append(phrases)
            places = np.arange(len(self.times), len(self.times) + len(fresh))
            self.names = np.insert(self.names, at[fresh], names[fresh])
            self.place = np.insert(self.place, at[fresh], places)
            self.times = np.concatenate([self.times, times[fresh]])

    def sent(self) -> Iterator[pa.RecordBatch]:
        start = 0
        for langs, phrases in zip(self.langs, self.phrases, strict=True):
            for i in range(0, len(langs), 1 << 16):
                some = slice(i, i + (1 << 16))
                part = langs[some]
                times = self.times[start + i : start + i + len(part)]
                yield pa.RecordBatch.from_arrays(
                    [part.cast(pa.string()), phrases[some].cast(pa.string()), pa.array(times, pa.int64())],
                    ["lang", "phrase", "times"],
                )
            start += len(langs)
        self.clear()


def candidates(
    text: arrays.Texts, langs: pa.Array, sizes: range, known: Bitmap, sure: Bitmap | None
) -> Iterator[tuple[int, np.ndarray, np.ndarray, arrays.Spans, np.ndarray]]:
    """Of every length: hashes and first words of the phrases to count, and the words.

    Without ``sure`` these are the phrases whose two parts are both known; single words
    have no parts.  With it, those of them that are sure, and in place of those that
    have a part that is not known the ones whose parts may both be frequent.
    """
    words, owner = pieces(text)
    last_at, was_known, possible = None, None, None
    for size, (names, at) in enumerate(grams(words, salts(langs)[owner], sizes[-1]), 1):
        wanted = counted = np.ones(len(at), bool)
        if size > 1:  # parts begin at the same word and at the next
            here, there = (np.searchsorted(last_at, at + i) for i in (0, 1))
            wanted = counted = was_known[here] & was_known[there]
        if sure:
            opened = possible[here] & possible[there] if size > 1 else counted
            wanted = possible_now = np.where(counted, sure.has(names), opened)
        if size in sizes:
            yield size, names[wanted], at[wanted], words, owner
        if size < sizes[-1]:
            last_at, was_known = at, known.has(names)
            possible = possible_now if sure else None


def likely(texts: DataFrame, sizes: range, known, least: int, parts: int) -> DataFrame:
    """``name``: the hashes, of phrases of so many words whose two parts are both ``known``,
    that occur ``least`` times or more."""

    def sent(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        names, _, times = distinct(*(np.concatenate(x) for x in zip(*found, strict=True)))
        edges = np.searchsorted(names, [np.uint64((k << 48) // parts) for k in range(1, parts)])
        rows = []
        for k, (a, b) in enumerate(zip([0, *edges], [*edges, len(names)], strict=True)):
            if b > a:
                steps = np.diff(names[a:b], prepend=_U(0))
                rows.append((k, katz.pack(steps), katz.pack(times[a:b].astype(np.int64))))
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "names", "times"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size, held = [], 0, Bitmap(known.value)
        for batch in arrays.slices(batches, most=SLICE):
            langs = batch.column("lang").cast(pa.large_string())
            for _, hashes, *_ in candidates(arrays.texts_of(batch.column("text")), langs, sizes, held, None):
                names, _, times = distinct(hashes >> _U(16), None)
                found.append((names, times))
                size += len(names)
            if size >= 2 * HASHES:
                names, _, times = distinct(*(np.concatenate(x) for x in zip(*found, strict=True)))
                found, size = [(names, times)], len(names)
            if size >= HASHES:
                yield sent(found)
                found, size = [], 0
        if size:
            yield sent(found)

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held = [(names, times)]
        for batch in batches:
            for a, b in zip(batch.column("names"), batch.column("times"), strict=True):
                steps = katz.unpack(a.as_py(), np.uint64)
                held.append((np.cumsum(steps, dtype=np.uint64), katz.unpack(b.as_py(), np.int64)))
            if sum(len(x) for x, _ in held[1:]) >= HASHES:
                names, _, times = distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = [(names, times)]
        names, _, times = distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(names[times >= least].view(np.int64))], ["name"])

    packed = texts.mapInArrow(run, "part int, names binary, times binary")
    return packed.groupBy("part").applyInArrow(total, "name long")


def bitmap(names: DataFrame) -> np.ndarray:
    """The bitmap of a table of hashes: bits are joined by the tasks, and its words, at most
    2 million of 8 bytes, reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.concatenate(Bitmap.places(batch.column("name").to_numpy(False).view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(places), pa.int64())], ["place"])

    places = names.mapInArrow(run, "place long")
    bit = F.expr("shiftleft(1L, int(place & 63))")
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    found = words.toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def spelled_counts(texts: DataFrame, longest: int, known, sure) -> DataFrame:
    """``lang, phrase, times`` of the phrases that are ``sure`` or that these open; and, with
    a null phrase, the number of words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, often = Collected(), Bitmap(known.value), Bitmap(sure.value)
        for batch in arrays.slices(batches, most=SLICE):
            langs = batch.column("lang").cast(pa.large_string())
            text = arrays.texts_of(batch.column("text"))
            for size, hashes, at, words, owner in candidates(text, langs, range(1, longest + 1), held, often):
                keys, one, times = distinct(hashes, None)

                def spell(fresh, first=at[one], size=size, words=words, owner=owner, langs=langs, data=text.data):
                    which = first[fresh]
                    return langs.take(pa.array(owner[which])), spelled(data, words, which, size)

                found.add(keys, times, spell)
            rows, n = np.unique(owner, return_counts=True)
            keys, one, times = distinct(arrays.mix(salts(langs)[rows]), n)
            own = langs.take(pa.array(rows[one]))
            found.add(keys, times, lambda fresh, own=own: (own.take(pa.array(fresh)), pa.nulls(len(fresh), own.type)))
            if len(found.times) >= ENTRIES:
                yield from found.sent()
        yield from found.sent()

    rows = texts.mapInArrow(run, COUNTED)
    # dealt by phrase before any aggregation: tasks have merged their own counts already
    return rows.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("times").alias("f"))


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """``lang, phrase, f`` of every phrase of 1 to ``longest`` words that occurs ``least``
    times or more in its language, overlaps counted; and, with a null phrase, the number of
    words of every language.

    Words are lower-cased (A-Z), split at spaces and tabs, and stand in pieces cut at line
    ends and ``.,;:!?``.  Reads ``text`` and ``lang`` alone, so other columns may have any
    name; null texts count as empty, a null language is ``und``; an empty table gives an
    empty result.  Repeated rows count as often as they occur.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    share = docs.sparkSession.sparkContext.broadcast
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    whole = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-whole // PART_BYTES) or 1
    bits = np.zeros(1 << (BITS - 6), np.int64)
    sure = bits = bitmap(likely(texts, range(1, 2), share(bits), least, parts))
    if longest > 1:
        sample = scratch.keep(texts.where(F.rand(SAMPLE) < 1 / SAMPLE), "sample")
        lowered = max(2, int(LOWERED * least / SAMPLE))
        for size in range(2, longest):
            found = likely(sample, range(size, size + 1), share(bits), lowered, -(-parts // SAMPLE))
            proposed = bitmap(found)
            bits = bits | proposed
            if not proposed.any():
                break
        sure = sure | bitmap(likely(texts, range(2, longest + 1), share(bits), least, 2 * parts))
    found = spelled_counts(texts, longest, share(bits), share(sure))
    often = (F.col("f") >= least) | F.col("phrase").isNull()
    return scratch.keep(found.where(often), "frequent")


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered_percent: int = 100
) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of phrases of 2 to ``longest`` words.

    ``a`` is the count of the phrase, ``l`` and ``r`` those of its parts at the cut that
    scores lowest (ties: the earliest), ``n`` the number of words of the language and
    score = floor(1000 * a * n / (l * r)), in exact decimals.  A phrase that lies inside a
    longer one of at least ``covered_percent`` of its count is left out.  For nulls, empty
    texts and empty tables see :func:`frequent`.
    """
    return scored(frequent(docs, least, longest), longest, covered_percent)


def scored(found: DataFrame, longest: int, covered_percent: int) -> DataFrame:
    """The collocations among counted phrases, see :func:`collocations`."""
    total = found.where("phrase is null").select("lang", F.col("f").alias("n"))
    counted = found.where("phrase is not null").withColumn("words", F.split("phrase", " "))
    counted = counted.withColumn("k", F.size("words"))
    longer = counted.where("k > 1")

    # any longer phrase passes through those of one word more, each at least as frequent
    parts = F.array(F.slice("words", 1, F.col("k") - 1), F.slice("words", 2, F.col("k") - 1))
    inside = longer.where("k > 2").select("lang", "f", F.explode(parts).alias("part"))
    inside = inside.groupBy("lang", F.array_join("part", " ").alias("phrase")).agg(F.max("f").alias("over"))
    covered = F.coalesce(100 * F.col("over") >= covered_percent * F.col("f"), F.lit(False))
    open_ = longer.join(inside, ["lang", "phrase"], "left").where(~covered)

    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = open_.select("lang", "phrase", "f", "words", "k", cut)
    join = lambda a: F.array_join(a, " ")
    cuts = cuts.select(
        "lang", "phrase", "f", "cut", join(F.slice("words", F.lit(1), F.col("cut"))).alias("left"),
        join(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut"))).alias("right"),
    )
    copies = F.explode(F.when(F.col("k") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    sized = counted.where(F.col("k") < longest).select("lang", F.col("phrase").alias("part"), "f", copies.alias("salt"))
    for side in ("left", "right"):
        salt = F.when(F.instr(side, " ") == 0, F.pmod(F.hash("phrase"), F.lit(SALTS))).otherwise(0)
        one = sized.select("lang", F.col("part").alias(side), F.col("f").alias(f"f_{side}"), "salt")
        cuts = cuts.withColumn("salt", salt).join(one, ["lang", side, "salt"]).drop("salt", side)
    big = lambda c: F.col(c).cast("decimal(18,0)")
    dealt = total.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(LANGUAGE_SALTS - 1))))
    cuts = cuts.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(LANGUAGE_SALTS))).join(dealt, ["lang", "salt"])
    over = ((big("f") * 1000).cast("decimal(19,0)") * big("n")).cast("decimal(38,0)")
    under = (big("f_left") * big("f_right")).cast("decimal(38,0)")
    cuts = cuts.withColumn("over", over).withColumn("under", under).withColumn("score", F.expr("over div under"))
    best = F.min(F.struct("score", "cut", "f_left", "f_right")).alias("b")
    lowest = cuts.groupBy("lang", "phrase", "f", "n").agg(best)
    return lowest.select(
        "lang", "phrase", F.col("f").alias("a"), F.col("b.f_left").alias("l"), F.col("b.f_right").alias("r"),
        "n", F.col("b.score").alias("score"),
    )


def top(scored: DataFrame, most: int = 2000) -> DataFrame:
    """The first phrases of every language by score, then count, then phrase; ranks from 1."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
