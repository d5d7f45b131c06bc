"""Token counts of documents in flat token files, found by a scan for separators.

A flat file is nothing but token ids of a fixed width, with an end-of-document id after each document, and no index.
Files are read in blocks of bytes; in a block all separators are found at once. A document may begin in one block and
end in another, so a prefix scan over one row per block carries the place of the last separator and the number of
documents so far. Rows of documents are made from that and the places inside the block.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenhand.llm.scratch import Scratch, remove

BLOCK_BYTES = 8 << 20

_encoders: dict[tuple[str, str], object] = {}


def encoder(path: str, pattern: str):
    """The tokenizer of a rank file (base64 token and rank a line), one per worker."""
    if (path, pattern) not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path, pattern] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def write_token_files(docs: DataFrame, folder: str, path: str, pattern: str, end: int, width: int = 2, text_col: str = "text") -> None:
    """Each task writes the ids of its texts to a flat file, little-endian, ``end`` after each text.

    Null and empty texts have no ids and still an end. The text writer puts bytes down as they are, so no library but
    Spark touches the files.
    """
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            for a in range(0, b.num_rows, 500):
                texts = b.column(0).slice(a, 500).to_pylist()
                ids = [np.array(enc.encode_ordinary(t or ""), dtype=kind).tobytes() for t in texts]
                yield pa.record_batch([pa.array(ids, pa.binary())], names=["ids"])

    rows = docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "ids binary").select(F.col("ids").cast("string").alias("value"))
    stop = np.array([end], dtype=kind).tobytes().decode("iso-8859-1")
    rows.write.option("lineSep", stop).option("encoding", "ISO-8859-1").text(folder)


def read_range(path: str, start: int, size: int) -> bytes:
    fs, at = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    with fs.open_input_file(at) as f:
        return f.read_at(size, start)


def scan_blocks(spark: SparkSession, folder: str, end: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block: ``file, block, start, n`` (tokens), ``seps, first, last`` (places in the file), and ``inner``,
    the numbers of tokens between the block's separators as bytes of 32-bit numbers."""
    block_bytes -= block_bytes % width
    files = spark.read.format("binaryFile").load(folder).select("path", "length")  # names and lengths only
    last = F.greatest(F.ceil(F.col("length") / block_bytes) - 1, F.lit(0)).cast("bigint")
    blocks = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))
    blocks = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length, block in zip(*(c.to_pylist() for c in b.columns)):
                if length % width:
                    raise ValueError(f"{path} is no file of {width}-byte tokens: it has {length} bytes")
                start = block * block_bytes
                ids = np.frombuffer(read_range(path, start, min(block_bytes, length - start)), dtype=f"<u{width}")
                at = np.flatnonzero(ids == end)
                base = start // width
                ends = [base + int(at[0]), base + int(at[-1])] if len(at) else [None, None]
                inner = (np.diff(at) - 1).astype("<u4").tobytes()
                row = [path, block, base, len(ids), len(at), *ends, inner]
                kinds = [pa.string(), *[pa.int64()] * 6, pa.binary()]
                yield pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds)], names=["file", "block", "start", "n", "seps", "first", "last", "inner"])

    return blocks.select("path", "length", "block").mapInArrow(
        run, "file string, block bigint, start bigint, n bigint, seps bigint, first bigint, last bigint, inner binary")


def count_tokens(blocks: DataFrame) -> DataFrame:
    """``file, doc, start, n_tokens, ended`` for every document of scanned blocks.

    ``doc`` numbers the documents of a file from 0, ``start`` is the place of its first token. Tokens after the last
    separator of a file are a document with ``ended`` false; without any, none is added. Documents without tokens
    count. An empty file, and an empty folder, give no rows.
    """
    order = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.drop("inner").select(
        "file", "block", F.coalesce(F.max("last").over(order), F.lit(-1)).alias("before"), F.coalesce(F.sum("seps").over(order), F.lit(0)).alias("doc"))
    ready = blocks.filter("seps > 0").select("file", "block", "first", "inner").join(carried, ["file", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, first, inner, before, doc in zip(*(b.column(c).to_pylist() for c in ("file", "first", "inner", "before", "doc"))):
                n = np.concatenate([[first - before - 1], np.frombuffer(inner, dtype="<u4").astype(np.int64)])
                start = before + 1 + np.concatenate([[0], np.cumsum(n[:-1] + 1)])
                yield pa.record_batch(
                    [pa.array([file] * len(n)), pa.array(doc + np.arange(len(n))), pa.array(start.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array([True] * len(n))],
                    names=["file", "doc", "start", "n_tokens", "ended"])

    whole = ready.mapInArrow(run, "file string, doc bigint, start bigint, n_tokens bigint, ended boolean")
    ends = blocks.groupBy("file").agg(
        (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max(F.col("start") + F.col("n")).alias("stop"), F.sum("seps").alias("doc"))
    rest = ends.filter("stop > start").select("file", "doc", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.union(rest)


def token_counts_of(docs: DataFrame, folder: str, path: str, pattern: str, end: int, text_col: str = "text") -> DataFrame:
    """Tokenise documents into flat files in ``folder`` (shared by all executors), scan them, and remove them again."""
    spark = docs.sparkSession
    write_token_files(docs, folder, path, pattern, end, text_col=text_col)
    blocks = Scratch(spark).table(scan_blocks(spark, folder, end))
    remove(spark, folder)
    return count_tokens(blocks)
