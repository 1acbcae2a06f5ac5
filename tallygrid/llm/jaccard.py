"""Jaccard join of documents on word shingles, exact, by prefixes under several orders.

Under any total order of shingles, two sets of similarity t or more share one of the
first ``n - ceil(t n) + 1`` shingles of each.  Candidates come from the first order and
must pass the same test under the others before sets are compared.  Every order puts
frequent shingles last (a sketch of fixed size counts all shingles) and differs in the
hash that orders equally frequent ones, so shared passages rarely make candidates.
Lengths and a bitmap of parities, which bounds the difference of two sets from below,
turn away most candidates before any set is fetched.

Only components are wanted, so groups never expand into all pairs: equal sets are one
node; the nodes of a list that share a shingle are first compared with three hubs; what
the hubs link needs no further look, and only pairs across components are left.  All of
those are compared, whatever the length of the list, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.llm import arrays, graph
from tallygrid.llm.store import Scratch

_U = np.uint64
CELL_BITS = 22
BLOCK_BITS = 18
#: One seed per order.
ORDERS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)
HUBS = 3
#: Numbers of 64 bits in the short bitmap that travels with every candidate list.
SHORT = 8
#: Bytes of text that are worked on at a time.
SLICE = 1 << 19
#: Up to this size the list of texts to read goes to every task.
BROADCAST_BYTES = 16 << 20


def shingle_sets(texts: arrays.Texts, width: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as sorted hashes: runs of ``width`` words, or all
    words as one where there are fewer, or none."""
    words = texts.spans(fold=arrays.LOWER)
    n_words = np.diff(words.first)
    short = np.zeros(len(texts), np.uint64)
    for n, h, at in arrays.windows(words, list(range(1, width + 1))):
        if n < width:
            whole = np.flatnonzero(n_words == n)
            short[whole] = h[np.searchsorted(at, words.first[whole])]
    cuts = np.searchsorted(at, words.first)
    for i, n in enumerate(n_words.tolist()):
        if n >= width:
            yield np.unique(h[cuts[i] : cuts[i + 1]])
        else:
            yield short[i : i + 1] if n else short[:0]


def node_of(shingles: np.ndarray) -> int:
    """64-bit name of a set: equal sets share it, others with odds of 2**-64 a pair."""
    total = arrays.mix(shingles ^ _U(0x452821E638D01377)).sum(dtype=np.uint64)
    return int(arrays.mix(np.array([total + _U(len(shingles))], np.uint64)).view(np.int64)[0])


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def ranked(shingles: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """Place of each shingle in an order: frequency class, then a seeded hash."""
    cell = (shingles >> _U(64 - CELL_BITS)).astype(np.int64)
    spread = arrays.mix(shingles ^ _U(ORDERS[order])) >> _U(8)
    return (classes[cell].astype(np.uint64) << _U(56)) | spread


def prefix(shingles: np.ndarray, classes: np.ndarray, order: int, percent: int) -> np.ndarray:
    p = prefix_length(len(shingles), percent)
    places = ranked(shingles, classes, order)
    return np.partition(places, p - 1)[:p] if p < len(places) else places


def parities(shingles: np.ndarray, bits: int = 0) -> np.ndarray:
    """Whether the number of shingles that fall on a bit is odd, for 2n to 4n bits if not
    told.  Two sets differ in at least as many shingles as their bitmaps in bits."""
    bits = bits or max(64, 1 << (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def apart(x: Column, y: Column) -> Column:
    """Bits in which two bitmaps differ; the longer is folded to the length of the other."""

    def fit(z: Column, other: Column) -> Column:
        half = F.size(other)
        folded = F.zip_with(
            F.slice(z, F.lit(1), half), F.slice(z, half + 1, half), lambda p, q: p.bitwiseXOR(q)
        )
        return F.when(F.size(z) > half, folded).otherwise(z)

    bits = F.zip_with(fit(x, y), fit(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(bits, F.lit(0), lambda total, v: total + v)


def lists(parts: list[np.ndarray]) -> pa.Array:
    """Arrays of longs as one Arrow column."""
    edges = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=edges[1:])
    flat = np.concatenate([np.zeros(0, np.int64), *(x.view(np.int64) for x in parts)])
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))


def jaccard_classes(
    docs: DataFrame, width: int = 4, percent: int = 85, scratch: Scratch | None = None
) -> DataFrame:
    """``doc_id, n_shingles, node, component, component_id`` per row of ``docs``.

    Two documents link when ``100 * |intersection| >= percent * |union|`` of their sets
    of distinct shingles; component_id is the smallest doc_id reachable.  Null, empty
    and blank texts have no shingles, link with nothing and keep their own doc_id.  A
    null doc_id is passed over where a component has another, and is its own component
    else.  Repeated rows are repeated in the result.  Only ``doc_id`` and ``text`` are
    read.  An empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    members, classes = _members(source, width, scratch)
    labels = _label(source, members, classes, width, percent, scratch)
    named = members.select("doc_id", "node", "n_shingles").join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    least = least.where("component_id is not null and component is not null")
    return named.join(least, "component", "left").select(
        "doc_id", "n_shingles", "node", "component",
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def _members(source: DataFrame, width: int, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """One pass over all texts: the node of each document, and the frequency class of
    each cell of the sketch (its size is fixed, so it may go to every task)."""
    names = ["doc_id", "copy", "node", "n_shingles", "bits", "short", "block", "cells"]
    schema = (
        "doc_id long, copy long, node long, n_shingles long, bits array<long>, short array<long>, "
        "block int, cells binary"
    )
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.uint64)
        for batch in arrays.slices(batches, most=SLICE):
            sets = list(shingle_sets(arrays.texts_of(batch.column("text")), width))
            nodes = [node_of(s) if len(s) else None for s in sets]
            bits = [parities(s) if len(s) else np.zeros(0, np.int64) for s in sets]
            short = [parities(s, 64 * SHORT) for s in sets]
            every = np.concatenate(sets) >> _U(64 - CELL_BITS)
            np.add.at(cells, every.astype(np.int64), _U(1))
            n = len(nodes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("copy"), pa.array(nodes, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()), lists(bits), lists(short),
                    pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                ],
                names,
            )
        blocks = cells.reshape(-1, 1 << BLOCK_BITS)
        full = [i for i in range(len(blocks)) if blocks[i].any()]
        packed = [pa.compress(blocks[i].tobytes(), "zstd", asbytes=True) for i in full]
        none = [pa.nulls(len(full), t) for t in (*[pa.int64()] * 4, longs, longs)]
        yield pa.RecordBatch.from_arrays(
            [*none, pa.array(full, pa.int32()), pa.array(packed, pa.binary())], names
        )

    copy = F.xxhash64("text").alias("copy")
    raw = scratch.keep(source.select("doc_id", copy, "text").mapInArrow(run, schema), "members")

    def total(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << BLOCK_BITS, np.uint64)
        for batch in batches:
            for part in batch.column("cells"):
                data = pa.decompress(part.as_py(), 8 << BLOCK_BITS, "zstd", asbytes=True)
                cells += np.frombuffer(data, np.uint64)
        packed = pa.compress(cells.tobytes(), "zstd", asbytes=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([packed], pa.binary())],
            ["block", "cells"],
        )

    # 8 bytes a cell reach the driver: 32 MB, whatever the size of the corpus
    blocks = raw.where("block is not null").select("block", "cells")
    part = F.pmod(F.xxhash64("cells"), F.lit(32))
    some = blocks.groupBy("block", part).applyInArrow(total, "block int, cells binary")
    found = some.groupBy("block").applyInArrow(total, "block int, cells binary").collect()
    cells = np.zeros(1 << CELL_BITS, np.uint64)
    for row in found:
        at = row["block"] << BLOCK_BITS
        cells[at : at + (1 << BLOCK_BITS)] = np.frombuffer(
            pa.decompress(bytes(row["cells"]), 8 << BLOCK_BITS, "zstd", asbytes=True), np.uint64
        )
    usual = max(1.0, float(np.median(cells)))
    classes = np.floor(np.log2(1 + cells / usual) * 2).clip(0, 255).astype(np.uint8)
    return raw.where("block is null").drop("block", "cells"), classes


def _prefixes(source: DataFrame, classes, width: int, percent: int) -> DataFrame:
    """``token, node``: the prefix of every document under the first order."""
    shared = source.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches, most=SLICE):
            tokens, nodes, sizes = [np.zeros(0, np.uint64)], [], []
            for s in shingle_sets(arrays.texts_of(batch.column("text")), width):
                if len(s):
                    tokens.append(prefix(s, shared.value, 0, percent))
                    nodes.append(node_of(s))
                    sizes.append(len(tokens[-1]))
            node = np.repeat(np.array(nodes, np.int64), sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(node)], ["token", "node"]
            )

    return source.select("text").mapInArrow(run, "token long, node long")


def node_column(width: int):
    """A function of a text column: its node, null without shingles."""

    @F.arrow_udf("long")
    def name(column: pa.Array) -> pa.Array:
        out = []
        for piece in arrays.slices(iter([pa.RecordBatch.from_arrays([column], ["text"])]), most=SLICE):
            for s in shingle_sets(arrays.texts_of(piece.column("text")), width):
                out.append(node_of(s) if len(s) else None)
        return pa.array(out, pa.int64())

    return lambda text: name(F.coalesce(text, F.lit("")))


def _sets(source: DataFrame, wanted: DataFrame, classes, width: int, percent: int) -> DataFrame:
    """``node, shingles, p1, p2`` of the ``wanted`` nodes: the set, and its prefixes under
    the second and third order.  ``wanted`` names for each node the text to read."""
    shared = source.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in arrays.slices(batches, most=SLICE):
            nodes, rows = [], []
            sets = shingle_sets(arrays.texts_of(batch.column("text")), width)
            for node, s in zip(batch.column("node").to_pylist(), sets, strict=True):
                if node != last and node_of(s) == node:  # the join brings copies in a row
                    nodes.append(node)
                    rows.append((s, *(prefix(s, shared.value, o, percent) for o in (1, 2))))
                last = node
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), *(lists([r[j] for r in rows]) for j in range(3))],
                ["node", "shingles", "p1", "p2"],
            )

    texts = source.select(F.xxhash64("text").alias("copy"), "text")
    found = texts.join(wanted, "copy").select("node", "text")
    kind = "node long, shingles array<long>, p1 array<long>, p2 array<long>"
    return found.mapInArrow(run, kind).dropDuplicates(["node"])


def _beside(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs with the facts of a, and those of b under names with an underscore."""
    right = facts.select(*(F.col(c).alias("b" if c == "node" else f"_{c}") for c in facts.columns))
    return pairs.join(facts.withColumnRenamed("node", "a"), "a").join(right, "b")


def _label(source, members: DataFrame, classes, width: int, percent: int, scratch) -> DataFrame:
    """``node, component`` of every node that shares a prefix shingle with another."""
    tokens = _prefixes(source, classes, width, percent)
    shared = tokens.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    shared = shared.where("lo <> hi").select("token")
    posts = scratch.keep(tokens.join(shared, "token").distinct(), "posts")
    facts = members.select("node", "copy", F.col("n_shingles").alias("n"), "bits", "short")
    facts = facts.join(posts.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    facts = scratch.keep(facts, "facts")
    labels = facts.select("node", F.col("node").alias("component"))

    def linked(pairs: DataFrame, step: str) -> DataFrame:
        """The pairs that link.  Bitmaps first, then the other orders, then the sets."""
        near = _beside(pairs, facts.select("node", "copy", "n", "bits"))
        differ = apart(F.col("bits"), F.col("_bits"))
        may = differ * (100 + percent) <= (F.col("n") + F.col("_n")) * (100 - percent)
        near = scratch.keep(near.where(may).select("a", "b", "copy", "_copy"), f"near-{step}")
        ends = near.select(F.col("a").alias("node"), "copy").union(near.select("b", "_copy"))
        ends = scratch.keep(ends.distinct(), f"ends-{step}")
        if 16 * ends.count() <= BROADCAST_BYTES:
            ends = F.broadcast(ends)  # of checked size; a longer list is joined by exchange
        sets = _sets(source, ends, classes, width, percent)
        sets = scratch.keep(sets, f"sets-{step}")
        both = _beside(near.select("a", "b"), sets)
        n, m = F.size("shingles"), F.size("_shingles")
        shared = F.size(F.array_intersect("shingles", "_shingles"))
        agree = F.arrays_overlap("p1", "_p1") & F.arrays_overlap("p2", "_p2")
        enough = 100 * shared >= percent * (n + m - shared)
        return scratch.keep(both.where(agree).where(enough).select("a", "b"), f"links-{step}")

    def merge(found: DataFrame, step: str) -> DataFrame:
        a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        links = found.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        joined = graph.components(links, scratch, f"graph-{step}")
        joined = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
        moved = labels.join(joined, "component", "left")
        return scratch.keep(
            moved.select("node", F.coalesce("to", "component").alias("component")), f"labels-{step}"
        )

    sized = posts.join(facts.select("node", "n"), "node")
    labels = merge(linked(_stars(sized, percent), "stars"), "stars")
    rest = scratch.keep(_across(sized.join(labels, "node")), "across")
    return merge(linked(_all_pairs(rest, facts, percent), "pairs"), "pairs")


def _fits(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _stars(posts: DataFrame, percent: int) -> DataFrame:
    """Every node with the hubs of its lists: those that come first by one hash each."""
    hash_of = [F.xxhash64("node", F.lit(k)) for k in range(HUBS)]
    hubs = posts.groupBy("token").agg(
        *(F.min_by("node", h).alias(f"hub{k}") for k, h in enumerate(hash_of)),
        *(F.min_by("n", h).alias(f"m{k}") for k, h in enumerate(hash_of)),
    )
    each = [F.struct(F.col(f"hub{k}").alias("hub"), F.col(f"m{k}").alias("m")) for k in range(HUBS)]
    met = posts.join(hubs, "token").select("node", "n", F.explode(F.array(*each)).alias("h"))
    met = met.where((F.col("h.hub") != F.col("node")) & _fits(F.col("n"), F.col("h.m"), percent))
    return met.select(
        F.least("node", "h.hub").alias("a"), F.greatest("node", "h.hub").alias("b")
    ).distinct()


def _across(posts: DataFrame) -> DataFrame:
    """The lists that hold more than one component, with their length."""
    ends = posts.groupBy("token").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("length")
    )
    return posts.join(ends.where("lo <> hi").select("token", "length"), "token")


def _all_pairs(posts: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs of one list that belong to different components and may link.

    The tokens of one passage, or of one group of copies, give lists of much the same
    nodes.  Every node has a home, the longest of its lists; nodes with one home meet
    there alone.  Lengths and short bitmaps are compared as the lists meet, so pairs
    that cannot link are never made.
    """
    home = posts.groupBy("node").agg(F.max(F.struct("length", "token")).alias("home"))
    short = [F.col("short")[i].alias(f"s{i}") for i in range(SHORT)]
    more = home.join(facts.select("node", *short), "node")
    side = posts.select("token", "node", "component", "n").join(
        more.select("node", F.col("home.token").alias("home"), *(f"s{i}" for i in range(SHORT))), "node"
    )
    left = side.select(*(F.col(c).alias(f"l_{c}") for c in side.columns))
    right = side.select(*(F.col(c).alias(f"r_{c}") for c in side.columns))
    met = F.expr(
        "l_token = r_token and l_node < r_node and l_component <> r_component "
        "and (l_home <> r_home or l_home = l_token)"
    )
    differ = sum(F.bit_count(F.col(f"l_s{i}").bitwiseXOR(F.col(f"r_s{i}"))) for i in range(SHORT))
    may = differ * (100 + percent) <= (F.col("l_n") + F.col("r_n")) * (100 - percent)
    pairs = left.join(right, met & _fits(F.col("l_n"), F.col("r_n"), percent) & may)
    return pairs.select(F.col("l_node").alias("a"), F.col("r_node").alias("b")).distinct()


def one_per_class(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each class kept, all columns as they were.

    The row kept is that of the smallest doc_id; of rows that repeat it, any one.  Rows
    without shingles are classes of their own and all stay.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    found = jaccard_classes(docs, width, percent, scratch).where("node is not null")
    first = found.where("doc_id = component_id or component_id is null")
    leaders = scratch.keep(
        first.groupBy("component").agg(
            F.min("node").alias("_node"), F.min("component_id").alias("_id")
        ),
        "leaders",
    )
    text, doc_id = docs["text"].cast("string"), docs["doc_id"].cast("long")
    packed = docs.select(
        F.struct("*").alias("row"), doc_id.alias("id"), node_column(width)(text).alias("node")
    )
    # both keys: copies of one text spread over the tasks and all but the leader's go there
    led = (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("_id"))
    kept = packed.join(leaders, led, "left_semi").dropDuplicates(["node", "id"])
    blank = docs.where(~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return kept.select("row.*").union(blank)
