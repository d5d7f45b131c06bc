"""Spelling variants: words one letter apart, each sent to its far more frequent neighbour.

Every prefix of a word is a node of a trie, every suffix a node of the trie of reversed words. Nodes are numbered by
their paths (64 bits each), so that tasks number alike without a common table. A word of length L gives the pairs

* (prefix before i, suffix after i) for each i: letter i is skipped,
* (prefix before i, suffix from i) for each i up to L: nothing is skipped, a letter could be inserted here.

Two words differ by a replaced letter if they share a skipping pair, by an inserted or deleted one if a skipping pair of
the longer is a plain pair of the shorter. A pair has one plain word at most and, as its skipping words differ in one
letter only, no more of them than there are letters; it yields sums and its two best words, never pairs of words.
In a run of equal letters only the first skip counts as an insertion, so a neighbour is met exactly once.

Word numbers follow the order of code points, so ties of counts need no text. Pairs are dealt into buckets of bounded
size; long words give many pairs but no pair carries text. Forms point to words of at least ``ratio`` times the count,
so chains are short and are followed by doubling.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.language import _parts
from evenhand.llm.scratch import Scratch
from evenhand.llm.words import BASES, U64, mix, span_hash

#: Words or bytes that a task counts before its sums go on; pairs of a bucket; letters of words numbered at a time.
FLUSH, FLUSH_BYTES = 300_000, 32_000_000
BUCKET_PAIRS = 400_000
POINTS = 200_000
#: Bytes of text scanned at a time.
RUN_BYTES = 1_000_000
#: Longer runs have their checksum taken one by one.
SHORT = 64

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = bytes(x + 32 if 65 <= x < 91 else x for x in range(256))
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def runs_of_letters(texts: list[bytes], least: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts as one, and start, end and text of each maximal run of ``least`` letters or more.

    Letters are A-Z, a-z and U+00C0 to U+00FF, which are the two-byte characters that start with C3.
    """
    body = b"\n" + b"\n".join(texts) + b"\n"
    buf = np.frombuffer(body, dtype=np.uint8)
    lead = buf == 0xC3
    first = _LETTER[buf] | lead
    inside = first.copy()
    inside[1:] |= lead[:-1]
    turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = turn[::2], turn[1::2]
    seen = np.concatenate([[0], np.cumsum(first)])
    keep = seen[end] - seen[start] >= least
    start, end = start[keep], end[keep]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return body.translate(_LOWER), start, end, np.searchsorted(bounds, start, side="right")


def checksums(body: bytes, start: np.ndarray, end: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """crc32 of each span, continued from ``seeds``; one step takes the same byte of all spans."""
    out = np.zeros(len(start), dtype=np.uint32)
    size = end - start
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = zlib.crc32(body[start[i] : end[i]], int(seeds[i]))
    some = np.flatnonzero(size <= SHORT)
    some = some[np.argsort(-size[some], kind="stable")]
    if not len(some):
        return out
    buf = np.frombuffer(body, dtype=np.uint8)
    crc, at, left = ~seeds[some], start[some], np.sort(size[some])
    for k in range(int(left[-1])):
        n = len(left) - int(np.searchsorted(left, k, side="right"))
        crc[:n] = _CRC[(crc[:n] ^ buf[at[:n] + k]) & 255] ^ (crc[:n] >> 8)
    out[some] = ~crc
    return out


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7, min_count: int = 2, slip_every: int | None = None,
) -> DataFrame:
    """``word, n``: runs of letters of all whole texts, A-Z lower-cased, of so many letters and occurrences at least.

    With ``slip_every`` a run loses a letter where that number divides the checksum of ``<id>:<run>`` (a null id is
    written as nothing): letter checksum modulo length. Tasks send sums. Null and empty texts have no words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[bytes] = Counter()
        size = 0

        def rows() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(sums), pa.binary()).cast(pa.string()), pa.array(list(sums.values()), pa.int64())], names=["word", "n"])
            sums.clear()
            return out

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _parts(texts, RUN_BYTES):
                body, start, end, doc = runs_of_letters([texts[i] or b"" for i in part], min_length)
                words = [body[a:b] for a, b in zip(start.tolist(), end.tolist())]
                if slip_every:
                    seeds = np.array([zlib.crc32(f"{'' if ids[i] is None else ids[i]}:".encode()) for i in part], dtype=np.uint32)
                    h = checksums(body, start, end, seeds[doc])
                    for j in np.flatnonzero(h % np.uint32(slip_every) == 0).tolist():
                        text = words[j].decode()
                        at = int(h[j]) % len(text)
                        words[j] = (text[:at] + text[at + 1 :]).encode() if len(text) > min_length else b""
                before = len(sums)
                sums.update(words)
                sums.pop(b"", None)
                size += (len(sums) - before) * (1 + len(body) // max(1, len(words)))
                if len(sums) > FLUSH or size > FLUSH_BYTES:
                    size = 0
                    yield rows()
        yield rows()

    given = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return given.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# --- pairs of trie nodes --------------------------------------------------------------------------

SKIP, FIRST_SKIP, PLAIN = 0, 1, 2


def node_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, prefix node, suffix node, kind) of all pairs of some words."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    values = points.astype(U64) + U64(1)
    size = np.array([len(w) for w in words])
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    word = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(points))
    again = np.zeros(len(points), dtype=bool)
    again[1:] = (points[1:] == points[:-1]) & (word[1:] == word[:-1])
    every = np.repeat(np.arange(len(words)), size + 1)
    place = np.arange(len(every)) - np.repeat(begin + np.arange(len(words)), size + 1) + begin[every]
    who = np.concatenate([word, every])
    stop, go = np.concatenate([at, place]), np.concatenate([at + 1, place])
    forward = span_hash(values, begin[who], stop, BASES[0][0])
    backward = span_hash(values, go, begin[who] + size[who], BASES[1][0])
    return who, forward, backward, np.concatenate([np.where(again, SKIP, FIRST_SKIP), np.full(len(every), PLAIN)]).astype(np.int8)


def neighbours_of(p: np.ndarray, s: np.ndarray, kind: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(id, number of near words, largest count and smallest id of them) for each member of each pair that has any."""
    order = np.lexsort((ids, -n, s, p))
    p, s, kind, ids, n = p[order], s[order], kind[order], ids[order], n[order]
    head = np.ones(len(p), dtype=bool)
    head[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
    group = np.cumsum(head) - 1
    groups = int(group[-1]) + 1 if len(group) else 0
    skip, first, plain = kind != PLAIN, kind == FIRST_SKIP, kind == PLAIN
    per = lambda which: np.bincount(group[which], minlength=groups)
    skips, firsts, plains = per(skip), per(first), per(plain)

    def best_of(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the best and second best of each group, -1 where there is none."""
        out, at = [np.full(groups, -1), np.full(groups, -1)], np.flatnonzero(which)
        g = group[at]
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        out[0][g[start]] = at[start]
        more = start[start + 1 < len(g)]
        more = more[g[more + 1] == g[more]]
        out[1][g[more]] = at[more + 1]
        return out[0], out[1]

    (one, two), (first_best, _), (the_plain, _) = best_of(skip), best_of(first), best_of(plain)
    me = np.arange(len(p))
    near = np.where(plain, firsts[group], skips[group] - 1 + first * plains[group])
    rival = np.where(plain, first_best[group], np.where(one[group] == me, two[group], one[group]))
    other = np.where(first, the_plain[group], -1)
    rival_n, other_n = np.where(rival >= 0, n[rival], -1), np.where(other >= 0, n[other], -1)
    take = (other_n > rival_n) | ((other_n == rival_n) & (other >= 0) & (ids[other] < ids[rival]))
    best = np.where(take, other, rival)
    keep = near > 0
    return ids[keep], near[keep], n[best[keep]], ids[best[keep]]


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a table of distinct words and their counts ``n``.

    Two words are near if they differ by one inserted, deleted or replaced code point. The form is the near word with
    the largest count (of equals the smallest by code points) if that is ``ratio`` times the word's own at least, else
    null; the root is where forms lead to. Repeated rows of a word count as one with the sum; null words take no part;
    an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, else forms could lead in a circle")
    spark = words.sparkSession
    scratch = Scratch(spark)
    once = scratch.table(words.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("bigint").alias("n")))
    sorted_ = once.repartitionByRange("word").sortWithinPartitions("word")
    known = scratch.table(sorted_.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    pairs = known.agg(F.sum(2 * F.length("word") + 1)).first()[0] or 0
    buckets = max(1, -(-pairs // BUCKET_PAIRS))

    def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, text, n = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_numpy()
            for part in _parts(text, POINTS):
                who, p, s, kind = node_pairs([text[i] for i in part])
                own = np.array(part)[who]
                bucket = ((mix(p ^ (s * U64(3))) >> U64(32)) * U64(buckets)) >> U64(32)
                cols = [bucket.astype(np.int32), p.view(np.int64), s.view(np.int64), kind, ids[own], n[own]]
                yield pa.record_batch([pa.array(c) for c in cols], names=["bucket", "p", "s", "kind", "id", "n"])

    def meet(t: pa.Table) -> pa.Table:
        found = neighbours_of(*(t[c].to_numpy() for c in ("p", "s", "kind", "id", "n")))
        return pa.table([pa.array(c.astype(np.int64)) for c in found], names=["id", "near", "best_n", "best"])

    spread = known.mapInArrow(pair_rows, "bucket int, p bigint, s bigint, kind tinyint, id bigint, n bigint")
    met = spread.groupBy("bucket").applyInArrow(meet, "id bigint, near bigint, best_n bigint, best bigint")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    near = met.groupBy("id").agg(F.sum("near").alias("n_near"), best.alias("b"))
    near = near.select("id", "n_near", F.col("b.best").alias("best"), (-F.col("b.m")).alias("best_n"))
    own = scratch.table(known.join(near, "id", "left"))
    leads = F.col("best_n") >= F.lit(ratio) * F.col("n")
    form = scratch.table(own.filter(leads).select("id", F.col("best").alias("form_id")))
    root = scratch.table(form.withColumnRenamed("form_id", "to"))
    while True:  # each round doubles the steps taken; counts grow by the ratio at each, so few are needed
        on = root.select(F.col("id").alias("to"), F.col("to").alias("next"))
        after = scratch.table(root.join(on, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        root = after.select("id", "to")
        if not after.filter("moved").limit(1).count():
            break
    text = lambda key, name: known.select(F.col("id").alias(key), F.col("word").alias(name))
    named = form.join(root, "id").join(text("form_id", "form"), "form_id").join(text("to", "root"), "to").select("id", "form", "root")
    out = scratch.table(
        own.join(named, "id", "left").select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(leads, F.col("best_n")).alias("form_n"),
        )
    )
    scratch.drop([out])
    return out
