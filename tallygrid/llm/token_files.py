"""Token counts from flat token files that have no index.

A file is the token numbers of many documents, each closed by an end-of-document number.
It is cut into blocks; a vector comparison finds the ends in each block, and a prefix
scan over the blocks gives every block the number of documents before it and the place
where the document that is open at its start began.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm import arrays
from tallygrid.llm.store import Scratch
from tallygrid.llm.warc_zip import open_fs
from tallygrid.partitioning import neighbours, running_sums

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the vocabulary's text is cut before its merges (a fixed value of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
BLOCK_TOKENS = 1 << 21
FILE_BYTES = 256 << 20
KIND = np.dtype("<u2")


def encoder(ranks: str):
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def write_tokens(
    docs: DataFrame, folder: str, ranks: str = RANKS, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Flat files under ``folder``: ``path, size, doc_ids``, the documents in file order.

    A null or empty text is its end alone.  Only files that the result names count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = open_fs(folder)
        system.create_dir(root, recursive=True)
        encode = encoder(ranks).encode_to_numpy
        name = f"{root}/{task.partitionId():05d}-{task.taskAttemptId()}"
        made, stream, size, ids = 0, None, 0, []

        def done() -> pa.RecordBatch:
            stream.close()
            cols = [pa.array([path]), pa.array([size]), pa.array([ids], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, ["path", "size", "doc_ids"])

        for batch in arrays.slices(batches):
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)
            for doc_id, text in rows:
                if stream is None:
                    path = f"{name}-{made:05d}.bin"
                    stream, size, ids = system.open_output_stream(path), 0, []
                tokens = encode(text.as_py() or "", disallowed_special=())
                data = np.append(tokens, END).astype(KIND).tobytes()
                stream.write(data)
                size += len(data)
                ids.append(doc_id)
                if size >= file_bytes:
                    yield done()
                    stream, made = None, made + 1
        if stream is not None:
            yield done()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "path string, size long, doc_ids array<long>")


def scan(
    files: DataFrame, folder: str, scratch: Scratch, end: int = END, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """``path, ordinal, start, n_tokens, closed`` of every document in ``files`` (path,
    size): its number in the file, its first token, its tokens without the end.

    Tokens after the last end are a document that is not ``closed``.  An empty file has
    no document; an end that follows an end closes one without tokens.
    """
    width = block_tokens * KIND.itemsize
    last = F.greatest((F.col("size") + (width - 1)) / width, F.lit(1)).cast("long") - 1
    blocks = files.where("size > 0").select(
        "path", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(row["path"]) as file:
                    file.seek(row["block"] * width)
                    tokens = np.frombuffer(file.read(min(width, row["size"] - row["block"] * width)), KIND)
                ends = np.flatnonzero(tokens == end) + row["block"] * block_tokens
                cols = [
                    pa.array([row["path"]]), pa.array([row["block"]]), pa.array([row["size"]]),
                    pa.array([len(ends)]), pa.array([int(ends[-1]) + 1 if len(ends) else None], pa.int64()),
                    pa.array([ends], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(
                    cols, ["path", "block", "size", "n_ends", "open_from", "ends"]
                )

    spread = blocks.repartition(F.xxhash64("path", "block"))
    found = scratch.keep(
        spread.mapInArrow(
            run,
            "path string, block long, size long, n_ends long, open_from long, ends array<long>",
        ),
        "blocks",
    )
    light = found.select("path", "block", "n_ends", "open_from")
    chunk = F.shiftright("block", 12)
    before = running_sums(
        light.withColumn("row_chunk", chunk), {"ordinal": F.col("n_ends")}, ("path",), "block", inclusive=False
    )
    before = neighbours(
        before.drop("row_chunk"), {"begun": F.col("open_from")}, {}, ("path",), "block", chunk
    )
    joined = found.select("path", "block", "ends", "size").join(
        before.select("path", "block", "ordinal", F.coalesce("begun", F.lit(0)).alias("begun")),
        ["path", "block"],
    )
    total = (F.col("size") / KIND.itemsize).cast("long")
    final = (F.col("block") == ((F.col("size") - 1) / width).cast("long")) & (
        F.coalesce(F.try_element_at("ends", F.lit(-1)) + 1, F.col("begun")) < total
    )
    # start and stop of every document in one array: nothing of the block's length is copied
    since = lambda i: F.when(i == 0, F.col("begun")).otherwise(F.get(F.col("ends"), i - 1) + 1)
    closed = F.transform(
        "ends", lambda e, i: F.struct(since(i).alias("start"), e.alias("stop"), F.lit(True).alias("closed"))
    )
    tail = F.coalesce(F.try_element_at("ends", F.lit(-1)) + 1, F.col("begun"))
    rest = F.array(F.struct(tail.alias("start"), total.alias("stop"), F.lit(False).alias("closed")))
    each = F.when(final, F.concat(closed, rest)).otherwise(closed)
    rows = joined.select("path", "ordinal", F.posexplode(each).alias("k", "doc"))
    return rows.select(
        "path", (F.col("ordinal") + F.col("k")).alias("ordinal"), F.col("doc.start").alias("start"),
        (F.col("doc.stop") - F.col("doc.start")).alias("n_tokens"), F.col("doc.closed").alias("closed"),
    )


def token_counts(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``doc_id, n_tokens`` per row of ``docs``: written as flat token files, and counted
    by scanning these.  Null and empty texts have no tokens; a null doc_id stays null;
    repeated rows count each.  An empty table gives an empty result."""
    scratch = Scratch(docs.sparkSession, "tokens")
    folder = scratch.path("files")
    written = scratch.keep(write_tokens(docs, folder, ranks), "written")
    counts = scan(written.select("path", "size"), folder, scratch)
    order = written.select("path", F.posexplode("doc_ids").alias("ordinal", "doc_id"))
    order = order.withColumn("ordinal", F.col("ordinal").cast("long"))
    return order.join(counts, ["path", "ordinal"]).select("doc_id", "n_tokens")
