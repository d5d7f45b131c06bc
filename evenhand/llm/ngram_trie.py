"""N-gram Jaccard join by prefix trees.

Every document is the set of its word n-grams. Two sets link when their Jaccard similarity reaches the threshold.

1. Documents with the same set fall into one class by a 128-bit fingerprint; one document stands for each class.
2. A sharded sketch estimates in how many classes an n-gram occurs. N-grams of a single class overlap with nothing, so
   a set needs only its shared n-grams, and a set with too few of them is done. The rest are ordered globally, rare
   n-grams first, by (estimate, hash).
3. Two rounds of min-hash groups, joined by ``Trie``, link most near copies. Then the exact part: linked sets share one
   of their first ``n - ceil(t n) + 1`` n-grams. A bucket of such an n-gram whose members are in one component by now
   has nothing to add. In every other small bucket a trie of the prefixes alone shows which sets could still link, by
   what is left beyond the prefixes; a large bucket counts as one in which all could. Components that could link form
   clusters, and the whole sets of a cluster are joined. So no link is lost, and a set moves once, not once a bucket.
4. In a group the sets are a prefix tree in global order (``Trie``): a traversal adds up the overlap of a shared path
   once for all sets below it, and leaves a subtree when the rest of the path cannot reach the threshold.

Groups above ``CHUNK`` sets are cut: min-hash groups at random, clusters into all pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.blocks import CELLS, blocked, estimates, ids_of, layout, merge_cells, reply_rows, report, runs_of
from evenhand.llm.components import components
from evenhand.llm.scratch import Scratch
from evenhand.llm.words import BASES, mix, span_hash, split_words, tidy, tidy_both, tidy_map, U64

NGRAM = 5
#: Threshold as a fraction, so that comparisons stay in whole numbers.
SIMILAR = (75, 100)
CHUNK = 64
ROUNDS = 2


class Sets:
    """The distinct n-gram hashes of each text, ascending: text i has ``hashes[first[i]:first[i + 1]]``."""

    def __init__(self, texts: list[bytes | None], k: int):
        w = split_words(texts, lower=True)
        words, n = w.hashes(), np.diff(w.first)
        at = w.windows(k)
        short = np.flatnonzero((n > 0) & (n < k))
        doc = np.concatenate([w.doc[at], short])
        begin = np.concatenate([at, w.first[short]])
        end = np.concatenate([at + k, w.first[short + 1]])
        h = span_hash(words, begin, end, BASES[0][1])
        if len(short):
            order = np.argsort(doc, kind="stable")
            doc, h = doc[order], h[order]
        edges = np.searchsorted(doc, np.arange(len(n) + 1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            h[a:b].sort()
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.hashes = h[new]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(n)))]).astype(np.int64)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit fingerprints of each set: sums of its mixed hashes."""
        out = []
        for seed in (0x9FB21C651E98DF25, 0xD1342543DE82EF95):
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(self.hashes * U64(seed) + U64(seed)), dtype=U64)])
            out.append((sums[self.first[1:]] - sums[self.first[:-1]]).view(np.int64))
        return out[0], out[1]


def needed(n: int, m: int, similar: tuple[int, int]) -> int:
    """Smallest overlap with which sets of sizes n and m link."""
    num, den = similar
    return -(-num * (n + m) // (num + den))


def linked(overlap: int, n: int, m: int, similar: tuple[int, int]) -> bool:
    return overlap * similar[1] >= similar[0] * (n + m - overlap)


class Trie:
    """A prefix tree with compressed paths over sets that are sorted sequences of numbers.

    A set may have more tokens than the sequence shows, all above its last (``beyond`` says how many); pairs are then
    those that could link. ``joins`` yields linked pairs that are enough for the components: sets known to be connected are not compared.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int], similar: tuple[int, int], beyond: list[int] | None = None):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.order, self.sets = order, [sets[i] for i in order]
        self.sizes, self.similar = [sizes[i] for i in order], similar
        self.beyond = [0] * len(sets) if beyond is None else [beyond[i] for i in order]
        n = len(sets)
        shared = np.zeros(n + 1, dtype=np.int64)
        for i in range(1, n):
            a, b = self.sets[i - 1], self.sets[i]
            k = min(len(a), len(b))
            off = np.flatnonzero(a[:k] != b[:k])
            shared[i] = off[0] if len(off) else k
        #: (from, to, depth, end): sets of the subtree, and the part of the path that its edge holds.
        self.nodes: list[tuple[int, int, int, int]] = []
        self.children: list[list[int]] = []
        self.bounds: list[tuple[int, int, int]] = []  # smallest and largest size, longest rest after the edge
        todo = [(0, n, 0, -1)]
        while todo:
            a, b, depth, parent = todo.pop()
            end = int(shared[a + 1 : b].min()) if b - a > 1 else len(self.sets[a])
            me = len(self.nodes)
            self.nodes.append((a, b, depth, end))
            self.children.append([])
            self.bounds.append((min(self.sizes[a:b]), max(self.sizes[a:b]), max(len(x) + y for x, y in zip(self.sets[a:b], self.beyond[a:b])) - end))
            if parent >= 0:
                self.children[parent].append(me)
            if b - a > 1:
                split = [a, *(np.flatnonzero(shared[a + 1 : b] == end) + a + 1).tolist(), b]
                todo += [(x, y, end, me) for x, y in zip(split[:-1], split[1:])]

    def joins(self, group: list[int], width: int) -> Iterator[tuple[int, int]]:
        """``group`` gives a known component for each set; yields pairs of indices whose link joins two of them."""
        num, den = self.similar
        owner = {g: g for g in group}

        def root(x: int) -> int:
            while owner[x] != x:
                owner[x] = owner[owner[x]]
                x = owner[x]
            return x

        apart = len(owner)
        mine = [group[i] for i in self.order]
        inside = np.zeros(width, dtype=bool)
        for i, probe in enumerate(self.sets):
            if apart < 2:
                return
            inside[:] = False
            inside[probe] = True
            n, more = self.sizes[i], self.beyond[i]
            last = int(probe[-1]) if more and len(probe) else width
            todo = [(0, 0)]
            while todo:
                node, overlap = todo.pop()
                a, b, depth, end = self.nodes[node]
                low, high, rest = self.bounds[node]
                if a >= i or high * den < num * n or low * num > den * n:
                    continue
                path = self.sets[a]
                if end > depth:
                    overlap += int(np.count_nonzero(inside[path[depth:end]]))
                at = int(path[end - 1]) if end else -1
                left = len(probe) - int(np.searchsorted(probe, at, side="right")) + more
                if at > last:  # tokens of the path that the probe may have beyond its last
                    rest += end - int(np.searchsorted(path[:end], last, side="right"))
                if overlap + min(rest, left) < needed(n, low, self.similar):
                    continue
                if b - a > 1:
                    todo += [(c, overlap) for c in self.children[node]]
                elif linked(overlap + min(rest, left), n, self.sizes[a], self.similar):
                    x, y = root(mine[a]), root(mine[i])
                    if x != y:
                        owner[max(x, y)] = min(x, y)
                        apart -= 1
                        yield self.order[a], self.order[i]


SHARED = "id bigint, n int, tokens binary, order binary, keys array<bigint>"


def _join(t: pa.Table, similar: tuple[int, int]) -> pa.Table:
    """Rows (comp, n, tokens, order, beyond) of one group; edges between components that a link joins."""
    comp, n, beyond = t["comp"].to_pylist(), t["n"].to_pylist(), t["beyond"].to_pylist()
    edges: list[tuple[int, int]] = []
    if len(set(comp)) > 1:
        tokens = [np.frombuffer(x, dtype=U64) for x in t["tokens"].to_pylist()]
        order = [np.frombuffer(x, dtype=np.uint16) for x in t["order"].to_pylist()]
        every, rarity = np.concatenate(tokens), np.concatenate(order)
        by = np.lexsort((every, rarity))
        new = np.ones(len(by), dtype=bool)
        new[1:] = every[by][1:] != every[by][:-1]
        rank = np.empty(len(by), dtype=np.int64)
        rank[by] = np.cumsum(new) - 1
        sets = np.split(rank, np.cumsum([len(x) for x in tokens])[:-1])
        edges = [(comp[i], comp[j]) for i, j in Trie(sets, n, similar, beyond).joins(comp, int(new.sum()))]
    return pa.table([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = NGRAM, similar: tuple[int, int] = SIMILAR,
) -> DataFrame:
    """``id, n_shingles, component``: the smallest id that links reach, for every row.

    Letters A-Z are lowered; a text with fewer than ``k`` words is one n-gram, one without words has none, links with
    nothing and is its own component. Rows with one id are one document in the sense of links; a null id counts as the
    smallest and is given back as null. Repeated rows give repeated results; an empty table gives none.
    """
    lowest = F.lit(-(1 << 63))
    scratch = Scratch(docs.sparkSession)
    durable = scratch.table

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in runs_of(texts):
                s = Sets(texts[a:b], k)
                one, two = s.prints()
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(s.sizes), pa.array(one), pa.array(two)], names=["id", "n", "p", "q"])

    given = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("body"))
    rows = durable(given.mapInArrow(tidy_map(describe), "id bigint, n bigint, p bigint, q bigint"))
    named = rows.withColumn("id", F.coalesce("id", lowest))
    classes = durable(named.filter("n > 0").groupBy("n", "p", "q").agg(F.min("id").alias("rep")))

    plan = layout(docs, text_col)
    shards, (num, den) = plan.shards, similar
    base = blocked(docs, id_col, text_col, plan.blocks)
    real = F.when(F.col("rep") == lowest, None).otherwise(F.col("rep"))
    reps = classes.select(F.pmod(F.xxhash64(real), F.lit(plan.blocks)).cast("int").alias("block"), "rep", "p")

    def chosen(t: pa.Table, reps: pa.Table) -> tuple[np.ndarray, Sets]:
        """Rows of the block that stand for their class."""
        known = set(zip(reps["rep"].to_pylist(), reps["p"].to_pylist()))
        s = Sets(t["body"].to_pylist(), k)
        ids, pick = ids_of(t["id"].combine_chunks()), []
        for i, key in enumerate(zip(ids.tolist(), s.prints()[0].tolist())):
            if key in known:
                known.discard(key)
                pick.append(i)
        keep = np.zeros(len(ids), dtype=bool)
        keep[pick] = True
        sizes = s.sizes
        s.hashes = s.hashes[np.repeat(keep, sizes)]
        s.first = np.concatenate([[0], np.cumsum(sizes[keep])]).astype(np.int64)
        return ids[keep], s

    def cells(t: pa.Table, reps: pa.Table) -> pa.Table:
        if not t.num_rows or not reps.num_rows:
            return report(0, np.zeros(0, U64), shards)
        return report(t["block"][0].as_py(), chosen(t, reps)[1].hashes, shards)

    def shared(t: pa.Table, got: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if t.num_rows and got.num_rows:
            is_rep = pc.is_valid(got["rep"])
            ids, s = chosen(t, got.filter(is_rep))
            est = estimates(s.hashes, shards, reply_rows(got.filter(pc.invert(is_rep))), True)
            for i, (a, b) in enumerate(zip(s.first[:-1].tolist(), s.first[1:].tolist())):
                n, e = b - a, est[a:b]
                m = int(np.count_nonzero(e > 1))
                if m * den < num * n:
                    continue
                h = s.hashes[a:b]
                by = np.lexsort((h, e))[n - m :]
                keys = [int(mix(h[by] ^ U64(977 * (r + 1))).min().view(np.int64)) for r in range(ROUNDS)]
                for col, x in zip(out, (int(ids[i]), n, h[by].tobytes(), e[by].astype(np.uint16).tobytes(), keys)):
                    col.append(x)
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, x) for c, x in zip(out, kinds)], names=["id", "n", "tokens", "order", "keys"])

    sketch = merge_cells(base.groupBy("block").cogroup(reps.groupBy("block")).applyInArrow(tidy_both(cells), CELLS), with_counts=True)
    none = lambda kind: F.lit(None).cast(kind)
    told = sketch.select("block", "shard", "row", "bits", "counts", none("bigint").alias("rep"), none("bigint").alias("p")).union(
        reps.select("block", F.lit(-1), F.lit(-1), none("binary"), none("binary"), "rep", "p"))
    sets = durable(base.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(tidy_both(shared), SHARED))

    # most near copies: groups of equal min-hashes
    keys = sets.select("id", F.posexplode("keys").alias("round", "key"))
    counts = keys.groupBy("round", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    part = F.pmod(F.xxhash64("id", "round"), F.ceil(F.col("size") / CHUNK)).cast("int")
    tried = keys.join(durable(counts), ["round", "key"]).select("id", "round", "key", part.alias("part"))
    body = sets.select("id", "n", "tokens", "order")
    first = tried.join(body, "id").withColumn("comp", F.col("id")).withColumn("beyond", F.lit(0))
    near = durable(first.groupBy("round", "key", "part").applyInArrow(tidy(lambda t: _join(t, similar)), "a bigint, b bigint"))
    found = components(near)

    # what is left: buckets of prefix tokens with more than one component
    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], []]
            for i, p, data in zip(*(batch.column(c).to_pylist() for c in ("id", "p", "tokens"))):
                cols[0].append(np.frombuffer(data, dtype=np.int64)[:p])
                cols[1].append(np.full(p, i))
                cols[2].append(np.arange(p, dtype=np.int32))
            if cols[0]:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in cols], names=["token", "id", "at"])

    comp = F.coalesce("component", "id").alias("comp")
    member = durable(body.select("id").join(found, "id", "left").select("id", comp))
    shown = F.expr("length(tokens) DIV 8")
    p = F.lit(1) + F.floor(F.col("n") * (den - num) / den) - (F.col("n") - shown)  # of n - ceil(t n) + 1, those that are shared
    body = body.withColumn("p", p.cast("int"))
    entries = durable(body.select("id", "p", "tokens").mapInArrow(tidy_map(prefix), "token bigint, id bigint, at int").join(member, "id"))
    open_ = entries.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("size"))
    open_ = durable(open_.filter("x <> y").select("token", "x", "size"))
    cut = lambda c, size: F.expr(f"substring({c}, at * {size} + 1, (p - at) * {size})").alias(c)
    small = entries.join(open_.filter(F.col("size") <= CHUNK), "token").join(body, "id")
    small = small.select("token", "comp", "n", cut("tokens", 8), cut("order", 2), (shown - F.col("p")).cast("int").alias("beyond"))
    could = small.groupBy("token").applyInArrow(tidy(lambda t: _join(t, similar)), "a bigint, b bigint")
    large = entries.join(open_.filter(F.col("size") > CHUNK), "token").select(F.col("comp").alias("a"), F.col("x").alias("b"))
    clusters = components(could.union(large.distinct()))
    clusters = clusters.select(F.col("id").alias("comp"), F.col("component").alias("cluster"))
    again = durable(member.join(clusters, "comp"))
    parts = again.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
    todo = again.join(durable(parts), "cluster").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    todo = todo.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    todo = todo.select("id", "comp", "cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    whole = todo.join(body.drop("p"), "id").withColumn("beyond", F.lit(0))
    more = durable(whole.groupBy("cluster", "i", "j").applyInArrow(tidy(lambda t: _join(t, similar)), "a bigint, b bigint"))
    last = components(more)

    tag = last.select(F.col("id").alias("comp"), F.col("component").alias("wider"))
    names = classes.join(member, classes["rep"] == member["id"], "left").select("n", "p", "q", F.coalesce("comp", "rep").alias("comp"))
    names = durable(names.join(tag, "comp", "left").select("n", "p", "q", F.coalesce("wider", "comp").alias("component")))
    scratch.drop([rows, names])
    out = named.join(names, ["n", "p", "q"], "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    back = lambda c: F.when(F.col(c) != lowest, F.col(c))
    return out.select(back("id").alias("id"), F.col("n").alias("n_shingles"), back("component").alias("component"))
