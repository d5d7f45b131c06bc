"""Documents dealt into blocks of a few megabytes, and sketches of the blocks merged shard by shard.

Several operators must know which of a document's hashes occur elsewhere. Moving every hash costs more than the
text, and no task can hold a sketch of all. So the space of hashes is cut into shards of about a million, each with
its own count-min sketch: every block sends a shard only the cells it touches (about two bytes each), one group per
shard adds them up, and sends each block one bit per cell in return. A key that is in every document is one cell of
each block, so hot keys stay small; the work of a shard follows the number of hashes, not their repetition.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.words import mix, tidy, U64

#: Text of a block, hashes of a shard, and what a shard's sketch has: rows of so many cells.
BLOCK_BYTES = 4_000_000
SHARD_KEYS = 1_000_000
DEPTH = 2
WIDTH = 1 << 22

CELLS = "shard int, block int, row int, cells binary"
REPLIES = "block int, shard int, row int, bits binary, counts binary"


@dataclass(frozen=True)
class Layout:
    blocks: int
    shards: int


def layout(docs: DataFrame, text_col: str, keys_per_byte: float = 0.16, block_bytes: int = BLOCK_BYTES) -> Layout:
    """Numbers of blocks and shards, in proportion to the bytes of text (one pass over one column)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return Layout(max(2 * parts, -(-size // block_bytes)), max(parts, int(size * keys_per_byte / SHARD_KEYS) + 1))


def blocked(docs: DataFrame, id_col: str, text_col: str, blocks: int, extra: list[str] = ()) -> DataFrame:
    """``block, id, body`` (the text's bytes) and the extra columns as ``x0, x1, ...``.

    Rows of one id share a block. Grouping by ``block`` is the one shuffle of the text: later passes of the same plan
    over the same frame reuse it.
    """
    c = lambda name: F.col(f"`{name}`")
    return docs.select(
        F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block"), c(id_col).cast("bigint").alias("id"),
        c(text_col).cast("binary").alias("body"), *[c(x).alias(f"x{i}") for i, x in enumerate(extra)],
    )


def ids_of(column) -> np.ndarray:
    """Ids as numbers; a null id sorts first."""
    return column.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)


# --- what a block sends -------------------------------------------------------------------------

def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each hash; never falls as the hash rises."""
    return ((keys >> U64(32)) * U64(shards)) >> U64(32)


def cell_keys(keys: np.ndarray, shards: int, row: int) -> np.ndarray:
    """Shard and cell of each hash in one number."""
    seed = (0x2545F4914F6CDD1D * (row + 1)) & ((1 << 64) - 1)
    return shard_of(keys, shards) * U64(WIDTH) + (mix(keys ^ U64(seed)) & U64(WIDTH - 1))


def entries(keys: np.ndarray, shards: int, row: int) -> np.ndarray:
    """Sorted cells that a block reports; a cell met more than once is reported twice."""
    cells = np.sort(cell_keys(keys, shards, row))
    keep = np.ones(len(cells), dtype=bool)
    keep[2:] = cells[2:] != cells[:-2]
    return cells[keep]


def pack(sorted_cells: np.ndarray) -> bytes:
    """Ascending numbers as differences of two or four bytes."""
    d = np.diff(sorted_cells.astype(np.int64), prepend=0)
    kind = np.uint16 if not len(d) or d.max() < 1 << 16 else np.uint32
    return bytes([kind().itemsize]) + d.astype(kind).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, dtype=f"<u{data[0]}", offset=1), dtype=np.int64)


def cuts(sorted_shards: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, from, to) of each run."""
    if not len(sorted_shards):
        return []
    at = np.flatnonzero(np.diff(sorted_shards)) + 1
    return list(zip(sorted_shards[np.r_[0, at]].tolist(), np.r_[0, at].tolist(), np.r_[at, len(sorted_shards)].tolist()))


def report(block: int, keys: np.ndarray, shards: int) -> pa.Table:
    """The rows of ``CELLS`` of one block."""
    rows = []
    for row in range(DEPTH):
        e = entries(keys, shards, row)
        high, low = e // U64(WIDTH), e & U64(WIDTH - 1)
        rows += [(s, block, row, pack(low[a:b])) for s, a, b in cuts(high)]
    return table_of(rows, [("shard", pa.int32()), ("block", pa.int32()), ("row", pa.int32()), ("cells", pa.binary())])


def table_of(rows: list[tuple], fields: list) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(cols, fields)], schema=pa.schema(fields))


# --- what a shard answers ------------------------------------------------------------------------

def merge_cells(cells: DataFrame, with_counts: bool = False) -> DataFrame:
    """One group per shard adds the blocks' cells and answers each block: is the count of a cell 2 or more?

    With counts, the counts of those cells (at most 65,535) follow in the order of the cells.
    """

    def merge(t: pa.Table) -> pa.Table:
        shard, row_no = t["shard"][0].as_py(), t["row"].to_numpy()
        blocks, packs, out = t["block"].to_pylist(), t["cells"].to_pylist(), []
        for row in range(DEPTH):
            mine = np.flatnonzero(row_no == row)
            got = [unpack(packs[i]) for i in mine]
            if not got:
                continue
            total = np.bincount(np.concatenate(got), minlength=WIDTH)
            for i, c in zip(mine, got):
                n = total[c]
                more = np.minimum(n[n > 1], 65535).astype(np.uint16).tobytes() if with_counts else None
                out.append((blocks[i], shard, row, np.packbits(n > 1).tobytes(), more))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return table_of(out, list(zip(["block", "shard", "row", "bits", "counts"], kinds)))

    return cells.groupBy("shard").applyInArrow(tidy(merge), REPLIES)


def estimates(keys: np.ndarray, shards: int, replies: list[tuple], with_counts: bool = False) -> np.ndarray:
    """Estimate of each hash's count over all blocks, from the replies to this block: exact at 1, else an upper bound.

    ``replies`` holds (row, shard, bits, counts). Without counts the estimate is 1 or 2 (for 2 or more).
    """
    est = np.full(len(keys), np.iinfo(np.int64).max)
    todo = np.arange(len(keys))
    for row in range(DEPTH):
        e = entries(keys, shards, row)
        runs = {s: (a, b) for s, a, b in cuts(e // U64(WIDTH))}
        n = np.ones(len(e), dtype=np.int64)
        for _, s, bits, counts in (r for r in replies if r[0] == row):
            a, b = runs[s]
            heavy = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=b - a).astype(bool)
            n[a:b][heavy] = np.frombuffer(counts, dtype=np.uint16) if with_counts else 2
        mine = cell_keys(keys[todo], shards, row)
        est[todo] = np.minimum(est[todo], n[np.searchsorted(e, mine)])
        todo = todo[est[todo] > 1]
    return est


def reply_rows(t: pa.Table) -> list[tuple]:
    return list(zip(*(t[c].to_pylist() for c in ("row", "shard", "bits", "counts"))))




def runs_of(texts: list, size: int = BLOCK_BYTES) -> list[tuple[int, int]]:
    """Cuts a batch into runs (from, to) of about ``size`` bytes; a longer text is a run of its own."""
    out, a, total = [], 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            out.append((a, i + 1))
            a, total = i + 1, 0
    return out + [(a, len(texts))] * (a < len(texts))
