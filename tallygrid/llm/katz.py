"""Language-model scores by a Katz backoff model over words, of order two or three.

Counts are Good-Turing discounted; what the discounts free goes to the words not seen
after a history, by a backoff weight that makes the probabilities of every history sum
to one, with a single unknown word in the vocabulary.

Texts are cut into chunks.  A chunk sends its distinct n-grams, with their training
counts, to the table partition that their hash names, which adds up and answers with
the totals, so a frequent word or pair costs one entry per chunk.  Both tables, requests
and answers, are stored by partition and chunk; entries travel as packed arrays.
Histories that hold a large share of all tokens are divided over the partitions.
Order three does the same once more: the answers about a chunk's pairs give the counts
and backoff probabilities that its triples are requested and scored with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.llm import arrays
from tallygrid.llm.store import Scratch

_U = np.uint64
END = _U(0x8A5CD789635D2DFF)
BOS = _U(0x121FD2155C472F96)
#: Counts up to this one are discounted.
K = 5
#: Text of one chunk, and entries of one table partition.  Pieces number their product,
#: so both should grow with the memory of executors when the corpus does.
CHUNK_BYTES = 12 << 20
PART_ENTRIES = 1 << 20
#: A history with more than one in so many tokens is divided.
HOT_SHARE = 4096

BLOBS = list("abcdef")
PACKED = "kind int, part int, " + ", ".join(f"{c} binary" for c in BLOBS)


def pack(values: np.ndarray) -> bytes:
    """Byte planes under zstd: small numbers in wide types cost little."""
    width = values.nbytes // max(len(values), 1)
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), width).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes, dtype, width: int = 0) -> np.ndarray:
    """What :func:`pack` made of an array; ``width`` bytes each if not the type's own."""
    n = int.from_bytes(data[:8], "little")
    own = np.dtype(dtype).itemsize
    width = width or own
    raw = pa.decompress(data[8:], n * width, "zstd", asbytes=True) if n else b""
    planes = np.frombuffer(raw, np.uint8).reshape(width, n)
    out = np.zeros((n, own), np.uint8)
    out[:, :width] = planes.T
    return out.view(dtype).ravel()


def good_turing(n: np.ndarray) -> np.ndarray:
    """Discounts of the counts 0 to K, from the numbers of types with count 1 to K + 1.
    Where these do not give a discount between 0 and 1, the count stays as it is."""
    d = np.ones(K + 1)
    if n[0]:
        common = (K + 1) * n[K] / n[0]
        for r in range(1, K + 1):
            if n[r - 1] and common < 1:
                value = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)
                if 0 < value < 1:
                    d[r] = value
    return d


@dataclass
class Unigrams:
    """Total of training tokens, distinct words, discounts."""

    total: int
    types: int
    discount: np.ndarray
    freed: float  # tokens' worth of mass for the unknown word

    @classmethod
    def of(cls, stats: np.ndarray) -> Unigrams:
        d = good_turing(stats[2:])
        freed = float(sum((1 - d[r]) * r * stats[1 + r] for r in range(1, K + 1)))
        return cls(int(stats[0]), int(stats[1]), d, freed)

    def prob(self, count: np.ndarray) -> np.ndarray:
        """Probability of words with these counts; 0 is the unknown word."""
        whole = self.total if self.freed > 0 else self.total + 1
        kept = np.where(count <= K, self.discount[np.minimum(count, K)], 1.0) * count
        return np.where(count > 0, kept, self.freed if self.freed > 0 else 1.0) / max(whole, 1)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.total + 0.1 * (self.types + 1)))


def chunks(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """One row per chunk of ``rows`` (doc_id, held_out, text): its id, the number of
    distinct words and of tokens, and the packed arrays."""

    def emit(chunk: int, parts: list) -> pa.RecordBatch:
        tokens, lengths, ids, flags = (np.concatenate(x) for x in zip(*parts, strict=True))
        vocab, word = np.unique(tokens, return_inverse=True)
        train = np.repeat((flags & 1) == 0, lengths)
        counts = np.bincount(word[train], minlength=len(vocab))
        blobs = [word.astype(np.uint32), vocab, counts.astype(np.int64), lengths, flags, ids]
        cols = [[chunk], [len(vocab)], [len(tokens)], [0], [0], *([pack(x)] for x in blobs)]
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()] * 6
        names = ["chunk", "n_types", "n_tokens", "kind", "part", *BLOBS]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, size, parts = TaskContext.get().partitionId() << 24, 0, []
        for batch in arrays.slices(batches, most=min(chunk_bytes, 1 << 20)):
            texts = arrays.texts_of(batch.column("text"))
            words = texts.spans(fold=arrays.LOWER)
            n = len(texts)
            tokens = np.full(len(words.hash) + n, END)
            tokens[np.arange(len(words.hash)) + words.owner] = words.hash
            ids = batch.column("doc_id")
            flags = batch.column("held_out").to_numpy(False).astype(np.uint8)
            flags |= ids.is_null().to_numpy(False).astype(np.uint8) << 1
            ids = ids.fill_null(0).to_numpy(False)
            parts.append((tokens, np.diff(words.first) + 1, ids, flags))
            size += len(texts.data) + 8 * n
            if size >= chunk_bytes:
                yield emit(chunk, parts)
                chunk, size, parts = chunk + 1, 0, []
        if parts:
            yield emit(chunk, parts)

    return rows.mapInArrow(run, f"chunk long, n_types long, n_tokens long, {PACKED}")


def _rows(names: list[str], kinds: list, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names
    )


def _edges(vocab: np.ndarray, parts: int) -> np.ndarray:
    """Where each partition's words begin among sorted hashes."""
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(vocab, bounds), [len(vocab)]])


def _word_requests(table: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vocab, counts = unpack(row["b"], np.uint64), unpack(row["c"], np.int64)
                cut = _edges(vocab, parts)
                out = [
                    (i, row["chunk"], pack(vocab[lo:hi]), pack(counts[lo:hi]))
                    for i, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True))
                ]
                yield _rows(
                    ["part", "chunk", "a", "b"],
                    [pa.int32(), pa.int64(), pa.binary(), pa.binary()], out,
                )

    return table.select("chunk", "b", "c").mapInArrow(
        run, "part int, chunk long, a binary, b binary"
    )


def _word_answers(requests: DataFrame) -> DataFrame:
    """Total counts for each chunk; and, without a chunk, what the partition holds:
    tokens, types, and types with count 1 to K + 1."""
    names = ["chunk", "kind", "part", *BLOBS, "stats"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6, pa.list_(pa.int64())]

    def run(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        part = key[0].as_py()
        ids, keys, counts = [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                ids.append(row["chunk"])
                keys.append(unpack(row["a"], np.uint64))
                counts.append(unpack(row["b"], np.int64))
        cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        types, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts), len(types)).astype(np.int64)
        none = [None] * 5
        for i, chunk in enumerate(ids):
            answer = pack(total[at[cut[i] : cut[i + 1]]])
            yield _rows(names, kinds, [(chunk, 1, part, answer, *none, None)])
        stats = [total.sum(), (total > 0).sum(), *((total == r).sum() for r in range(1, K + 2))]
        yield _rows(names, kinds, [(None, 1, part, None, *none, [int(x) for x in stats])])

    return requests.groupBy("part").applyInArrow(run, f"chunk long, {PACKED}, stats array<long>")


@dataclass
class Chunk:
    """A chunk put together again: its stream of words and what the tables answered."""

    word: np.ndarray
    vocab: np.ndarray
    lengths: np.ndarray
    flags: np.ndarray
    ids: np.ndarray
    count: np.ndarray  # of each word, then of the history at the start of a text

    @classmethod
    def of(cls, batches: Iterator[pa.RecordBatch], tables: dict[int, dict] | None = None) -> Chunk:
        own, answers = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    own = row
                elif row["kind"] == 1:
                    answers[row["part"]] = unpack(row["a"], np.int64)
                else:
                    tables[row["kind"]][row["part"]] = row
        count = np.concatenate([answers[i] for i in sorted(answers)])
        return cls(
            unpack(own["a"], np.uint32), unpack(own["b"], np.uint64), unpack(own["d"], np.int64),
            unpack(own["e"], np.uint8), unpack(own["f"], np.int64), count,
        )

    def entries(self, parts: int, uni: Unigrams) -> Entries:
        starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        end = self.count[np.searchsorted(self.vocab, END)]  # texts of the training part
        count = np.append(self.count, end)
        vocab = np.append(self.vocab, BOS)
        before = np.empty(len(self.word), np.uint64)
        before[1:] = self.word[:-1]
        before[starts] = len(self.vocab)
        code, at = np.unique(before << _U(32) | self.word.astype(np.uint64), return_inverse=True)
        history, word = (code >> _U(32)).astype(np.int32), (code & _U(0xFFFFFFFF)).astype(np.int32)
        at = at.astype(np.int32)
        del before, code
        return Entries.of(
            at, history, word, vocab[history], vocab[word], count[history], count[word], parts, uni
        )

    def triples(self, e: Entries, total: np.ndarray, parts: int, uni: Unigrams) -> Entries:
        """Those of the tokens that have two words, or the start and a word, before them;
        ``total`` are the training counts of the pairs ``e``."""
        inside = self.inside()
        history, pair = e.at[inside - 1], e.at[inside]
        code, first, at = np.unique(
            history.astype(np.uint64) << _U(32) | self.word[inside].astype(np.uint64),
            return_index=True, return_inverse=True,
        )
        at = at.astype(np.int32)
        history, pair = history[first], pair[first]
        del code
        name = arrays.mix(arrays.mix(e.name[history]) + self.vocab[e.word[history]])
        return Entries.of(
            at, history, pair, name, self.vocab[self.word[inside][first]], total[history], total[pair],
            parts, uni,
        )

    def inside(self) -> np.ndarray:
        """The tokens that do not begin a text."""
        starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        return np.delete(np.arange(len(self.word), dtype=np.int32), starts)


@dataclass
class Entries:
    """Distinct pairs, or triples, of a chunk by table partition, then history; ``at``
    leads from each token to its entry."""

    at: np.ndarray
    part: np.ndarray
    history: np.ndarray  # a word, or a pair
    word: np.ndarray  # the entry without its first word: a word, or a pair
    name: np.ndarray
    key: np.ndarray
    times: np.ndarray  # training count of the history
    count: np.ndarray  # training count of ``word``
    hot: np.ndarray

    @classmethod
    def of(cls, at, history, word, name, last, times, count, parts: int, uni: Unigrams) -> Entries:
        key = arrays.mix(arrays.mix(name) + last) >> _U(16)
        hot = times * HOT_SHARE > uni.total
        place = arrays.mix(name + np.where(hot, key, _U(0))) >> _U(32)
        part = (place * _U(parts) >> _U(32)).astype(np.int32)
        del place
        order = np.argsort(part, kind="stable")  # histories come in order
        rank = np.empty(len(order), np.int32)  # a chunk has far fewer tokens than 2**31
        rank[order] = np.arange(len(order), dtype=np.int32)
        return cls(
            rank[at], part[order], history[order], word[order], name[order], key[order],
            times[order], count[order], hot[order],
        )

    def requests(self, chunk: int, seen: np.ndarray, whole: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Per table partition: histories, their counts and sizes; entries, their counts in
        this chunk and those of ``word``, and, per history, what the latter are divided by."""
        names = ["part", "chunk", *BLOBS, "g"]
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 7]
        for part, mine, first in self.pieces():
            size = np.diff(np.append(first, mine.stop - mine.start))
            bare = self.key[mine].view(np.uint8).reshape(-1, 8)[:, :6]
            blobs = (
                self.name[mine][first], self.times[mine][first], size.astype(np.uint32), bare,
                seen[mine].astype(np.uint32), self.count[mine], whole[mine][first],
            )
            yield _rows(names, kinds, [(part, chunk, *(pack(x) for x in blobs))])

    def probs(self, answers: dict, discount: np.ndarray, hot: dict, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each entry: its probability, ``lower`` being those of ``word``; its training
        count; and what the counts of its history are divided by."""
        prob, count, over = np.empty(len(self.part)), np.empty(len(self.part), np.int64), np.empty(len(self.part))
        for part, mine, first in self.pieces():
            row = answers.pop(part)
            total, mask = unpack(row["a"], np.int64), unpack(row["b"], np.uint8)
            size = np.diff(np.append(first, len(total)))
            lack = np.logical_or.reduceat(total == 0, first)
            low = np.zeros((len(first), K), np.int64)
            low[lack] = unpack(row["c"], np.int64).reshape(-1, K)
            mass = np.zeros(len(first))
            mass[lack] = unpack(row["d"], np.float64)
            for g in np.flatnonzero(self.hot[mine][first]):
                low[g], mass[g] = hot[int(self.name[mine][first[g]].view(np.int64))]
                mask[g] = ((low[g] > 0) << np.arange(K)).sum()
            times = self.times[mine][first].astype(float)
            bits = (mask[:, None] >> np.arange(K)) & 1
            frees = (bits * (discount[1:] < 1)).any(axis=1)
            whole = np.where(frees, times, times + 1)
            left = np.where(frees, (low * np.arange(1, K + 1) * (1 - discount[1:])).sum(axis=1), 1.0)
            weight = np.where(times > 0, left / whole / np.maximum(1 - mass, 1e-12), 1.0)
            kept = np.where(total <= K, discount[np.minimum(total, K)], 1.0) * total
            over[mine], count[mine] = np.repeat(whole, size), total
            prob[mine] = np.where(total > 0, kept / over[mine], lower[mine] * np.repeat(weight, size))
        return prob, count, over

    def pieces(self) -> Iterator[tuple[int, slice, np.ndarray]]:
        """Per partition: its number, its entries, and where each history begins."""
        cut = np.flatnonzero(np.diff(self.part, prepend=-1, append=-2))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            yield int(self.part[lo]), slice(lo, hi), np.flatnonzero(np.diff(self.history[lo:hi], prepend=-1))


REQUESTS = "part int, chunk long, " + ", ".join(f"{c} binary" for c in [*BLOBS, "g"])


def _pair_requests(joined: DataFrame, parts: int, uni: Unigrams) -> DataFrame:
    def run(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        chunk = Chunk.of(batches)
        e = chunk.entries(parts, uni)
        train = np.repeat((chunk.flags & 1) == 0, chunk.lengths)
        seen = np.bincount(e.at[train], minlength=len(e.part))
        yield from e.requests(key[0].as_py(), seen, np.ones(len(e.part)))

    return joined.groupBy("chunk").applyInArrow(run, REQUESTS)


def _triple_requests(joined: DataFrame, parts: int, wide: int, uni: Unigrams, discount: np.ndarray, hot: dict) -> DataFrame:
    def run(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        tables: dict[int, dict] = {2: {}}
        chunk = Chunk.of(batches, tables)
        e = chunk.entries(parts, uni)
        _, total, whole = e.probs(tables[2], discount, hot, np.ones(len(e.part)))
        e.part = e.history = e.key = e.times = e.count = e.hot = None
        t = chunk.triples(e, total, wide, uni)
        whole = whole[t.word]
        del e, total
        train = np.repeat((chunk.flags & 1) == 0, chunk.lengths)[chunk.inside()]
        seen = np.bincount(t.at[train], minlength=len(t.part))
        yield from t.requests(key[0].as_py(), seen, whole)

    return joined.groupBy("chunk").applyInArrow(run, REQUESTS)


def _answers(requests: DataFrame, uni: Unigrams, discount: np.ndarray | None = None) -> DataFrame:
    """For each chunk: total counts, which of the counts 1 to K its histories have, and,
    for histories with an entry that is not in the table, how many and the lower order's
    probability of the words that are.  Without a chunk: entries with count 1 to K + 1;
    divided histories.  Of pairs, or of triples if the ``discount`` of pairs is given.
    """
    kind = 2 if discount is None else 3
    names = ["chunk", "kind", "part", *BLOBS, "stats", "hot", "low", "mass"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6, pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.float64()]

    def run(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        part = key[0].as_py()
        ids, groups, keys, seen, counts, wholes = [], [], [], [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                ids.append(row["chunk"])
                name, times, size = unpack(row["a"], np.uint64), unpack(row["b"], np.int64), unpack(row["c"], np.uint32)
                groups.append((name, times, size.astype(np.int64)))
                keys.append(arrays.mix(np.repeat(arrays.mix(name), size) ^ unpack(row["d"], np.uint64, 6)))
                seen.append(unpack(row["e"], np.uint32))
                counts.append(unpack(row["f"], np.int64))
                wholes.append(unpack(row["g"], np.float64))
        cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        owner = np.concatenate([np.repeat(n, s) for n, _, s in groups])
        every = np.concatenate(keys)
        del keys
        _, first, at = np.unique(every, return_index=True, return_inverse=True)
        del every
        total = np.bincount(at, np.concatenate(seen), len(first)).astype(np.int64)
        del seen
        names_of = np.concatenate([n for n, _, _ in groups])
        times_of = np.concatenate([t for _, t, _ in groups])
        known, where = np.unique(names_of, return_index=True)
        mine = np.searchsorted(known, owner[first])
        word = np.concatenate(counts)[first]
        there = total > 0
        if discount is None:
            mass = np.bincount(mine[there], uni.prob(word[there]), len(known))
        else:
            kept = np.where(word <= K, discount[np.minimum(word, K)], 1.0) * word
            mass = np.bincount(mine[there], kept[there], len(known)) / np.concatenate(wholes)[where]
        low = np.stack([np.bincount(mine[total == r], minlength=len(known)) for r in range(1, K + 1)], axis=1)
        mask = ((low > 0) << np.arange(K)).sum(axis=1).astype(np.uint8)
        for i, chunk in enumerate(ids):
            answer = total[at[cut[i] : cut[i + 1]]]
            name, _, size = groups[i]
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            g = np.searchsorted(known, name)
            lack = np.logical_or.reduceat(answer == 0, start)
            blobs = (answer, mask[g], low[g[lack]].ravel(), mass[g[lack]])
            yield _rows(names, kinds, [(chunk, kind, part, *(pack(x) for x in blobs), None, None, None, None, None, None)])
        none = [None] * 6
        stats = [int((total == r).sum()) for r in range(1, K + 2)]
        rows = [(None, kind, part, *none, stats, None, None, None)]
        for g in np.flatnonzero(times_of[where] * HOT_SHARE > uni.total):
            rows.append((None, kind, part, *none, None, int(known[g].view(np.int64)), low[g].tolist(), float(mass[g])))
        yield _rows(names, kinds, rows)

    return requests.groupBy("part").applyInArrow(
        run, f"chunk long, {PACKED}, stats array<long>, hot long, low array<long>, mass double"
    )


def _scores(joined: DataFrame, uni: Unigrams, levels: list[tuple[int, np.ndarray, dict]]) -> DataFrame:
    """``levels``: number of table partitions, discounts and divided histories of the pairs,
    and of the triples if there are any."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        tables: dict[int, dict] = {2: {}, 3: {}}
        chunk = Chunk.of(batches, tables)
        parts, discount, hot = levels[0]
        e = chunk.entries(parts, uni)
        prob, total, _ = e.probs(tables[2], discount, hot, uni.prob(e.count))
        log = np.log10(prob)[e.at]
        e.part = e.history = e.key = e.times = e.count = e.hot = None
        if len(levels) > 1:
            parts, discount, hot = levels[1]
            t = chunk.triples(e, total, parts, uni)
            log[chunk.inside()] = np.log10(t.probs(tables[3], discount, hot, prob[t.word])[0])[t.at]
        edges = np.concatenate([[0], np.cumsum(chunk.lengths)])
        count = chunk.count[chunk.word]
        add = lambda x: arrays.per_text(x, edges)
        ids = pa.array(chunk.ids, mask=(chunk.flags & 2) > 0)
        n = len(chunk.lengths)
        cols = [
            ids, pa.array((chunk.flags & 1) > 0), pa.array(chunk.lengths), pa.array(add(count > 0)),
            pa.array(np.full(n, uni.total, np.int64)), pa.array(add(uni.base(count))), pa.array(add(log)),
        ]
        yield pa.RecordBatch.from_arrays(cols, names)

    return joined.groupBy("chunk").applyInArrow(
        run,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
    )


def _found(answers: DataFrame) -> tuple[np.ndarray, dict]:
    """Discounts, and the divided histories' numbers and mass, from a table's answers."""
    stats = answers.where("stats is not null").select(F.posexplode("stats").alias("k", "n"))
    found = {r["k"]: r["n"] for r in stats.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    discount = good_turing(np.array([found.get(i, 0) for i in range(K + 1)], np.int64))
    # no more than HOT_SHARE histories can be divided
    low = [F.sum(F.col("low")[r]).alias(f"n{r}") for r in range(K)]
    divided = answers.where("hot is not null").groupBy("hot").agg(F.sum("mass").alias("mass"), *low)
    return discount, {r["hot"]: ([r[f"n{i}"] for i in range(K)], r["mass"]) for r in divided.collect()}


def score(docs: DataFrame, held_out: Column | None = None, chunk_bytes: int = CHUNK_BYTES, part_entries: int = PART_ENTRIES, order: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    The model learns from the rows that are not ``held_out`` (by default those with
    ``crc32(doc_id) mod 10`` = 0; a null doc_id is not) and scores all.  Tokens are
    words, A-Z lower-cased, and one end per text, so a null or empty text is its end
    alone.  ``base_score`` adds up additively smoothed word probabilities, ``score`` those
    of the model, both as log10.  With ``order`` three a word's history is the two words
    before it, backed off to the last one and then to none; a text's first word has its
    start alone as history in either order.  Repeated rows count and are scored each.  Only doc_id
    and text are read.  Without training rows every word is unknown and the score is
    finite still; an empty table gives an empty result.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    scratch = Scratch(docs.sparkSession, "katz")
    if held_out is None:
        held_out = F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(10)) == 0
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"), docs["text"].cast("string").alias("text"),
    )
    table = scratch.keep(chunks(rows, chunk_bytes), "chunks")
    n_types, n_tokens = table.agg(F.sum("n_types"), F.sum("n_tokens")).first()
    parts = -(-(n_types or 1) // part_entries)
    words = scratch.keep(_word_answers(_word_requests(table, parts)), "words")
    stats = words.where("stats is not null").select(F.posexplode("stats").alias("k", "n"))
    found = {r["k"]: r["n"] for r in stats.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    uni = Unigrams.of(np.array([found.get(i, 0) for i in range(K + 3)], np.int64))

    own = table.drop("n_types", "n_tokens")
    answers = words.where("chunk is not null").drop("stats")
    joined = own.union(answers.select(*own.columns))
    parts = -(-(n_tokens or 1) // (2 * part_entries))
    pairs = scratch.keep(_answers(_pair_requests(joined, parts, uni), uni), "pairs")
    discount, hot = _found(pairs)
    levels = [(parts, discount, hot)]
    joined = joined.union(pairs.where("chunk is not null").select(*own.columns))
    if order == 3:
        wide = -(-(n_tokens or 1) // part_entries)
        requests = _triple_requests(joined, parts, wide, uni, discount, hot)
        triples = scratch.keep(_answers(requests, uni, discount), "triples")
        levels.append((wide, *_found(triples)))
        joined = joined.union(triples.where("chunk is not null").select(*own.columns))
    return _scores(joined, uni, levels)
