"""BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over the bytes of a text sets chunk ends by content, so equal passages give equal chunks wherever they
stand. Chunks are counted over all documents; one that occurs more than once is encoded by one block, and the ids of
its inner part (between its first and last white space) go to every block that has it. A chunk may begin or end inside
a word; those ends are joined with their neighbours and encoded anew. A join holds if encoding it together with the
words around it gives the same ids as the pieces; if not, the piece re-encoded grows on both sides until it does.

The tokenizer must drop white space before its model sees a word (as the default vocabulary does); then white space is
a safe cut. Chunks are counted where the texts lie. Text moves once, compressed, for encoding shared chunks and whole
texts in one query; the ids of shared chunks move once per block that needs them.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.blocks import layout, table_of
from evenhand.llm.scratch import Scratch
from evenhand.llm.words import BASES, give_back, mix, powers, powers_at, tidy_both, tidy_map, U64

#: Bytes under the rolling hash, and a chunk's mean length as a power of two.
ROLL = 32
MEAN_BITS = 11
#: Words whose ids a worker remembers (a block's words come on top), and words encoded at a time.
MEMO, BATCH = 150_000, 400
#: Text of a block; its chunks, hashes and ids are in memory together.
BLOCK_BYTES = 2_000_000

_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")
_loaded: dict[str, Encoder] = {}


class Encoder:
    """The tokenizer of a file, one per worker, with a memory of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            if json.load(f)["decoder"] is not None:
                raise ValueError("this decoding joins tokens by spaces; the vocabulary names another decoder")
        self.memo: dict[bytes, bytes] = {}  # ids as four bytes each, a third of what numbers take
        self.old: dict[bytes, bytes] = {}
        size = max(self.tok.get_vocab().values()) + 1
        self.digits = [b"%d" % i for i in range(size)]
        self.names = [(self.tok.id_to_token(i) or "").encode() for i in range(size)]

    @staticmethod
    def get(path: str) -> Encoder:
        if path not in _loaded:
            _loaded[path] = Encoder(path)
        return _loaded[path]

    def plain(self, texts: list[bytes]) -> list[list[int]]:
        """What the library gives, text by text."""
        return [e.ids for e in self.tok.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def learn(self, words: set[bytes]) -> None:
        """Remember these words at least until the next call; words not met for two generations are forgotten."""
        if len(self.memo) > MEMO:
            self.old, self.memo = self.memo, {}
        new = []
        for w in words:
            if w not in self.memo:
                if w in self.old:
                    self.memo[w] = self.old[w]
                else:
                    new.append(w)
        for i in range(0, len(new), 50 * BATCH):
            self._encode_words(new[i : i + 50 * BATCH])

    def _encode_words(self, words: list[bytes]) -> None:
        """Many words in one text cost less than one by one; tokens go to words by their place in it."""
        groups = [[w.decode() for w in words[i : i + BATCH]] for i in range(0, len(words), BATCH)]
        at = 0
        for group, e in zip(groups, self.tok.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4").tobytes()
            place = np.fromiter((x for x, _ in e.offsets), dtype=np.int64, count=len(ids) // 4)
            cut = (4 * np.searchsorted(place, np.cumsum([len(w) + 1 for w in group]))).tolist()
            for a, b in zip([0, *cut[:-1]], cut):
                self.memo[words[at]] = ids[a:b]
                at += 1

    def ids(self, words: list[bytes]) -> list[int]:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, words)), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        """Tokens joined by one space, as the library does without a decoder."""
        return b" ".join(map(self.names.__getitem__, ids))


class Chunks:
    """Content-defined chunks of some texts: text i has chunks ``first[i]:first[i + 1]``, bytes ``start:end``."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"".join(texts)
        buf = np.frombuffer(self.raw, dtype=np.uint8)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        n = len(buf)
        sums = []
        for base, _ in BASES:
            s = np.zeros(n + 1, dtype=U64)
            np.cumsum((buf.astype(U64) + U64(1)) * powers(base, n)[:n], dtype=U64, out=s[1:])
            sums.append((s, pow(base, -1, 1 << 64)))
        s, inverse = sums[0]
        cut = np.zeros(0, dtype=np.int64)
        if n > ROLL:
            rolled = (s[ROLL:] - s[:-ROLL]) * powers(inverse, n - ROLL)
            cut = np.flatnonzero((rolled >> U64(64 - MEAN_BITS)) == 0) + ROLL  # a chunk ends before this byte
            begin = np.concatenate([[0], ends])[np.searchsorted(ends, cut - 1, side="right")]
            cut = cut[cut - begin >= ROLL]
        full = ends[np.diff(ends, prepend=0) > 0]
        self.end = np.union1d(cut, full)
        self.start = np.concatenate([[0], self.end[:-1]]).astype(np.int64) if len(self.end) else self.end
        self.first = np.concatenate([[0], np.searchsorted(self.end, ends, side="right")])
        self.keys = [mix((s[self.end] - s[self.start]) * powers_at(inverse, self.start)).view(np.int64) for s, inverse in sums]

    def bytes_of(self, i: int, j: int) -> bytes:
        """Chunks i to j - 1 as one piece."""
        return self.raw[self.start[i] : self.end[j - 1]]


def ends_of(piece: bytes) -> tuple[bytes, bytes, bytes] | None:
    """(head, inner, tail): what stands before the first and after the last white space; None without any."""
    m = _SPACE.search(piece)
    if m is None:
        return None
    last = len(piece) - 1
    while not _SPACE.match(piece, last):
        last -= 1
    return piece[: m.start()], piece[m.start() : last + 1], piece[last + 1 :]




def assemble(docs: list[list[tuple[bytes, list[int] | None]]], enc: Encoder) -> list[list[int]]:
    """Ids of documents given as pieces; a piece may come with the ids of its inner part.

    Joins are encoded anew and held against an encoding together with the words beside them.
    """
    plans: list[list[tuple[list[bytes], list[int] | None, bool]]] = []
    learn: set[bytes] = set()
    for pieces in docs:
        plan, carry = [], b""
        for piece, ids in pieces:
            cut = ends_of(piece)
            if cut is None:
                carry += piece
                continue
            head, inner, tail = cut
            if carry or head:
                plan.append(([carry + head], None, True))
            plan.append((inner.split(), ids, False))
            carry = tail
        if carry:
            plan.append(([carry], None, True))
        plans.append(plan)
        for words, ids, _ in plan:
            if ids is None:
                learn.update(words)
            elif words:
                learn.update((words[0], words[-1]))
    enc.learn(learn)
    out, windows, at = [], [], []
    for d, plan in enumerate(plans):
        got = [enc.ids(words) if ids is None else ids for words, ids, _ in plan]
        for i, (words, _, is_join) in enumerate(plan):
            if is_join:
                before = plan[i - 1][0][-1:] if i else []
                after = plan[i + 1][0][:1] if i + 1 < len(plan) else []
                if before or after:
                    windows.append(b" ".join([*before, *words, *after]))
                    at.append((d, enc.ids([*before, *words, *after])))
        out.append([x for part in got for x in part])
    wrong = {d for (d, want), got in zip(at, enc.plain(windows)) if got != want} if windows else set()
    for d in wrong:
        out[d] = repaired(plans[d], enc)
    return out


def repaired(plan: list[tuple[list[bytes], list[int] | None, bool]], enc: Encoder) -> list[int]:
    """Re-encode around the joins of one document with twice as many words each time, until pieces and whole agree."""
    words = [w for part, _, _ in plan for w in part]
    joins, n = [], 0
    for part, _, is_join in plan:
        joins += [n] * is_join
        n += len(part)
    reach = 2
    while reach < n:
        spans: list[list[int]] = []
        for j in joins:
            a, b = max(0, j - reach), min(n, j + reach + 1)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        done, out, agree = 0, [], True
        for a, b in spans:
            out += [x for w in enc.plain([b" ".join(words[done:a])]) for x in w]
            inner, wide = enc.plain([b" ".join(words[a:b]), b" ".join(words[max(0, a - reach) : min(n, b + reach)])])
            sides = enc.plain([b" ".join(words[max(0, a - reach) : a]), b" ".join(words[b : min(n, b + reach)])])
            agree &= wide == sides[0] + inner + sides[1]
            out += inner
            done = b
        out += enc.plain([b" ".join(words[done:])])[0]
        if agree:
            return out
        reach *= 2
    return enc.plain([b" ".join(words)])[0]


KEYS = "block int, h1 bigint, h2 bigint, n bigint"
GIVEN = "h1 bigint, h2 bigint, ids binary"
DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, extra: list[str] = (),
) -> DataFrame:
    """``id``, extras as ``x0..``, then ``n_tokens, ids`` (or digests of ids and decoded text) of every whole text.

    ``path`` names a vocabulary file that executors have. Ids equal the library's for the whole text without special
    tokens added. Null and empty texts have no ids. Repeated rows are encoded each; an empty table gives no rows.
    """
    plan = layout(docs, text_col, block_bytes=BLOCK_BYTES)
    kinds = docs.schema
    c = lambda name: F.col(f"`{name}`")
    names = ["id", *(f"x{i}" for i in range(len(extra)))]
    given = docs.select(
        F.pmod(F.xxhash64(c(id_col), c(text_col)), F.lit(plan.blocks)).cast("int").alias("block"), c(id_col).alias("id"),
        *[c(x).alias(f"x{i}") for i, x in enumerate(extra)], c(text_col).cast("binary").alias("body"),
    )

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            body = pa.array([z.compress(t.as_py() or b"") for t in b.column("body")], pa.binary())
            yield pa.record_batch([*b.columns[:-1], body], names=b.schema.names)
        give_back()

    lead = ", ".join(f"{n} {kinds[s].dataType.simpleString()}" for n, s in zip(names, [id_col, *extra]))
    base = given.mapInArrow(tidy_map(squeeze), f"block int, {lead}, body binary")

    def texts_of(t: pa.Table) -> list[bytes]:
        z = zstandard.ZstdDecompressor()
        return [z.decompress(x) for x in t["body"].to_pylist()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body, block = b.column("body"), b.column("block").to_numpy()
            size = pc.fill_null(pc.binary_length(body), 0).to_numpy().astype(np.int64)
            cut = np.flatnonzero(np.diff((np.cumsum(size) - size) // BLOCK_BYTES)) + 1
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(body)]):  # a batch may hold many blocks' worth of text
                ch = Chunks([x or b"" for x in body.slice(i, j - i).to_pylist()])
                k = np.column_stack([np.repeat(block[i:j].astype(np.int64), np.diff(ch.first)), *ch.keys])
                k, n = np.unique(k, axis=0, return_counts=True)
                yield pa.record_batch([pa.array(k[:, 0].astype(np.int32)), pa.array(k[:, 1]), pa.array(k[:, 2]), pa.array(n)], names=["block", "h1", "h2", "n"])
                del ch
            give_back()

    # chunks are counted where the texts lie: only their keys move
    counted = given.select("block", "body").mapInArrow(tidy_map(count), KEYS)
    scratch = Scratch(docs.sparkSession)
    seen = scratch.table(counted.groupBy("block", "h1", "h2").agg(F.sum("n").alias("n")))
    owners = seen.groupBy("h1", "h2").agg(F.sum("n").alias("all"), F.min("block").alias("owner")).filter("all > 1")
    shared = scratch.table(seen.join(owners.select("h1", "h2", "owner"), ["h1", "h2"]).select("block", "h1", "h2", "owner"))

    def own(t: pa.Table, mine: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if t.num_rows and mine.num_rows:
            ch, enc, z = Chunks(texts_of(t)), Encoder.get(path), zstandard.ZstdCompressor(level=1)
            want, inner = set(zip(mine["h1"].to_pylist(), mine["h2"].to_pylist())), {}
            for i, key in enumerate(zip(ch.keys[0].tolist(), ch.keys[1].tolist())):
                if key in want and key not in inner:
                    cut = ends_of(ch.bytes_of(i, i + 1))
                    inner[key] = cut[1].split() if cut else []
            enc.learn({w for words in inner.values() for w in words})
            rows = [(*key, z.compress(np.array(enc.ids(words), dtype="<u4").tobytes())) for key, words in inner.items()]
        give_back()
        return table_of(rows, [("h1", pa.int64()), ("h2", pa.int64()), ("ids", pa.binary())])

    mine = shared.filter("block = owner").select("block", "h1", "h2")
    # not written first: within the query of the last step it reads the same shuffle of the texts, alone it would make another
    owned = base.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(tidy_both(own), GIVEN)
    handed = shared.select("block", "h1", "h2").join(owned, ["h1", "h2"])
    scratch.drop([shared])

    def finish(t: pa.Table, got: pa.Table) -> pa.Table:
        enc, z = Encoder.get(path), zstandard.ZstdDecompressor()
        known = {
            (a, b): np.frombuffer(z.decompress(x), dtype="<u4").tolist()
            for a, b, x in zip(*(got[x].to_pylist() for x in ("h1", "h2", "ids")))
        }
        ch = Chunks(texts_of(t))
        keys = list(zip(ch.keys[0].tolist(), ch.keys[1].tolist()))
        docs = []
        for a, b in zip(ch.first[:-1].tolist(), ch.first[1:].tolist()):
            pieces, run = [], a
            for i in range(a, b):
                if keys[i] in known:
                    if run < i:
                        pieces.append((ch.bytes_of(run, i), None))
                    pieces.append((ch.bytes_of(i, i + 1), known[keys[i]]))
                    run = i + 1
            if run < b:
                pieces.append((ch.bytes_of(run, b), None))
            docs.append(pieces)
        out = assemble(docs, enc)
        give_back()
        cols = [t[x].combine_chunks() for x in names] + [pa.array([len(x) for x in out], pa.int64())]
        if not digests:
            return pa.table([*cols, pa.array(out, pa.list_(pa.int32()))], names=[*names, "n_tokens", "ids"])
        sha = lambda x: hashlib.sha256(x).hexdigest()
        one = pa.array([sha(b" ".join(map(enc.digits.__getitem__, x))) for x in out], pa.string())
        two = pa.array([sha(enc.decode(x)) for x in out], pa.string())
        return pa.table([*cols, one, two], names=[*names, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"{lead}, {DIGESTS if digests else 'n_tokens bigint, ids array<int>'}"
    return base.groupBy("block").cogroup(handed.groupBy("block")).applyInArrow(tidy_both(finish), schema)


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with ``decoded``: their tokens joined by spaces; null ids give null."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.get(path)
        for b in batches:
            texts = [None if x is None else enc.decode(x).decode() for x in b.column(ids_col).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])

    return rows.mapInArrow(tidy_map(run), f"{kind}, decoded string")
