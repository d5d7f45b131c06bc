"""Substring dedup: a count-min prefilter, then an exact grouping of the windows it lets through.

Pass 1: every block of documents reports the sketch cells of its windows (``blocks.report``); shards merge them.
Pass 2: a window whose estimate is 2 or more may be repeated. Each block sends such windows once, with the smallest
document that has it there; a shard finds the smallest document over all blocks, exactly (96 bits of hash).
Pass 3: a block gets the hashes that begin in a smaller document of another block, adds what repeats inside the
block itself, and takes the covered words out. A sketch never underestimates, so no repeated window is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.blocks import (
    CELLS, blocked, cuts, estimates, ids_of, layout, merge_cells, reply_rows, report, shard_of, table_of,
)
from evenhand.llm.words import give_back, split_words, tidy, tidy_both, U64, Words

ASKS = "shard int, block int, h1 binary, h2 binary, ids binary"
ASK_FIELDS = [("shard", pa.int32()), ("block", pa.int32()), ("h1", pa.binary()), ("h2", pa.binary()), ("ids", pa.binary())]
LOST = "block int, shard int, lost binary"
LOST_FIELDS = [("block", pa.int32()), ("shard", pa.int32()), ("lost", pa.binary())]


def _block(t: pa.Table) -> tuple[pa.Table, np.ndarray, Words]:
    """The block's rows by ascending id, their ids and words."""
    ids = ids_of(t["id"].combine_chunks())
    order = np.argsort(ids, kind="stable")
    t = t.take(pa.array(order))
    return t, ids[order], split_words(t["body"].to_pylist())


def _firsts(h: np.ndarray, doc_id: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the earliest window of each distinct hash, and whether each window is later than that one."""
    order = np.lexsort((start, doc_id, h))
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[order][1:] != h[order][:-1]
    lead = order[new][np.cumsum(new) - 1] if len(h) else order
    later = np.zeros(len(h), dtype=bool)
    later[order] = (doc_id[order] != doc_id[lead]) | (start[order] != start[lead])
    return order[new], later


def repeated_spans(
    docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", extra: list[str] = (), verbatim: bool = False,
) -> DataFrame:
    """One row per document: ``id``, extras as ``x0..``, ``n_words``, ``n_removed`` and ``kept``.

    With ``verbatim`` a text that loses no word is kept byte for byte, and a null text stays null.

    A window is ``window`` consecutive words of one text. A word goes if a window over it also starts earlier: in a
    smaller id, or in the same id at an earlier word. ``kept`` joins the other words by one space. Null or empty text
    has no words; texts shorter than a window lose none; a null id counts as the smallest; rows that repeat an id and
    a text do not remove each other, as neither starts earlier. An empty table gives no rows.
    """
    plan = layout(docs, text_col)
    base = blocked(docs, id_col, text_col, plan.blocks, list(extra))
    shards = plan.shards

    def cells(t: pa.Table) -> pa.Table:
        w = split_words(t["body"].to_pylist())
        return report(t["block"][0].as_py(), w.window_hashes(w.windows(window), window), shards)

    def ask(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return table_of([], ASK_FIELDS)
        t, ids, w = _block(t)
        at = w.windows(window)
        h1 = w.window_hashes(at, window)
        hit = np.flatnonzero(estimates(h1, shards, reply_rows(replies)) > 1)
        doc, start = w.doc[at[hit]], at[hit]
        first, _ = _firsts(h1[hit], ids[doc], start - w.first[doc])
        first = first[np.argsort(h1[hit][first], kind="stable")]
        k1, k_id = h1[hit][first], ids[doc[first]]
        k2 = (w.window_hashes(at, window, 1)[hit][first] >> U64(32)).astype(np.uint32)
        b = t["block"][0].as_py()
        rows = [(s, b, k1[i:j].tobytes(), k2[i:j].tobytes(), k_id[i:j].tobytes()) for s, i, j in cuts(shard_of(k1, shards))]
        return table_of(rows, ASK_FIELDS)

    def answer(t: pa.Table) -> pa.Table:
        h1, h2, ids = (
            [np.frombuffer(x, dtype=k) for x in t[c].to_pylist()] for c, k in (("h1", U64), ("h2", np.uint32), ("ids", np.int64))
        )
        sizes = [len(x) for x in h1]
        a, b, d = np.concatenate(h1), np.concatenate(h2), np.concatenate(ids)
        order = np.lexsort((d, b, a))
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        later = np.zeros(len(a), dtype=bool)
        later[order] = d[order] > d[order[new]][np.cumsum(new) - 1]
        ends, shard, rows = np.cumsum(sizes), t["shard"][0].as_py(), []
        for block, x, lost in zip(t["block"].to_pylist(), h1, np.split(later, ends[:-1])):
            if lost.any():
                rows.append((block, shard, x[lost].tobytes()))
        return table_of(rows, LOST_FIELDS)

    kinds = base.schema
    out_schema = ", ".join(
        ["id bigint", *(f"x{i} {kinds[f'x{i}'].dataType.simpleString()}" for i in range(len(extra)))]
        + ["n_words bigint", "n_removed bigint", "kept string"]
    )
    names = ["id", *(f"x{i}" for i in range(len(extra)))]

    def cut(t: pa.Table, lost: pa.Table) -> pa.Table:
        t, ids, w = _block(t)
        at = w.windows(window)
        h1 = w.window_hashes(at, window)
        doc = w.doc[at]
        _, gone = _firsts(h1, ids[doc], at - w.first[doc])
        if lost.num_rows:
            known = np.sort(np.concatenate([np.frombuffer(x, dtype=U64) for x in lost["lost"].to_pylist()]))
            gone |= known[np.minimum(np.searchsorted(known, h1), len(known) - 1)] == h1
        edge = np.zeros(len(w.start) + 1, dtype=np.int32)
        np.add.at(edge, at[gone], 1)
        np.add.at(edge, at[gone] + window, -1)
        dead = np.cumsum(edge)[:-1] > 0
        before = np.concatenate([[0], np.cumsum(dead)])
        removed = before[w.first[1:]] - before[w.first[:-1]]
        raw, kept, whole = w.buf.tobytes(), [], t["body"].to_pylist() if verbatim else []
        for i, n in enumerate(removed.tolist()):
            a, b = w.first[i], w.first[i + 1]
            if not n and verbatim:
                kept.append(whole[i])
            elif not n:
                kept.append(b" ".join(raw[w.start[a] : w.end[b - 1]].split()) if b > a else b"")
            else:
                live = np.flatnonzero(~dead[a:b]) + a
                kept.append(b" ".join([raw[x:y] for x, y in zip(w.start[live].tolist(), w.end[live].tolist())]))
        cols = [t[c].combine_chunks() for c in names]
        give_back()
        return pa.table(
            [*cols, pa.array(np.diff(w.first)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())],
            names=[*names, "n_words", "n_removed", "kept"],
        )

    sketch = merge_cells(base.groupBy("block").applyInArrow(tidy(cells), CELLS))
    asks = base.groupBy("block").cogroup(sketch.groupBy("block")).applyInArrow(tidy_both(ask), ASKS)
    lost = asks.groupBy("shard").applyInArrow(tidy(answer), LOST)
    return base.groupBy("block").cogroup(lost.groupBy("block")).applyInArrow(tidy_both(cut), out_schema)


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated words cut out of their text; untouched texts stay as they are, byte for byte.

    Columns and their order stay; a document keeps its row even if no word is left (its text is then empty).
    """
    names = docs.columns
    rest = [c for c in names if c != text_col]  # the text moves once
    cut = repeated_spans(docs, window, id_col, text_col, rest, verbatim=True)
    pick = {text_col: F.col("kept")} | {c: F.col(f"x{i}") for i, c in enumerate(rest)}
    return cut.select(*[pick[c].alias(c) for c in names])
