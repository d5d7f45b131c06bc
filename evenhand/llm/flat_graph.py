"""Embedding near-dedup over a robust-pruned flat graph.

1. Equal directions fall into one class with a count; one vector stands for it.
2. Every vector joins the ``OVERLAP`` shards of its nearest centres (k-means on a bounded sample). Shards above
   ``PART`` vectors are dealt into parts, and a tile is a pair of parts of one shard, so that every pair of vectors of a
   shard meets in exactly one tile however large the shard is.
3. In each tile robust pruning turns nearest neighbours into a sparse graph: a neighbour is dropped if one already
   taken is closer to it by the factor ``ALPHA``. Adjacency lists of all tiles are united per vector.
4. A search walks the united graph inside a tile from the medoids: greedily with a beam, then from every vector found
   within the radius to its neighbours until no more are found. Each find is a cosine in double precision, so no link
   is below the threshold; how many are missed is measured by ``recall``.
5. A pair is counted in the first shard that both share, so overlapping shards do not count it twice.
6. Where every link is asked for (``exact``), all pairs are compared after the walk: the work is the square of the
   vectors. They are written once in blocks of about ``PAIRED``; a task holds some blocks, reads the others one after
   the other from the shared folder, and gives back one row per vector it found links of. So disk is in proportion to
   the vectors, and no vector is moved or copied for a pair. Links count from these pairs; the components of the walk
   are joined where a pair links two of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.components import components
from evenhand.llm.scratch import Scratch

THRESHOLD = 0.9
OVERLAP = 3
PART = 512
#: Vectors that place the centres, and the most centres there are; larger shards are dealt into parts.
SAMPLE, CENTRES = 16_384, 4096
DEGREE, POOL, ALPHA, BEAM, MEDOIDS = 24, 64, 1.2, 24, 4
#: Vectors of a block where all pairs are compared.
PAIRED = 1024
#: Far neighbours that every vector gets besides, to keep tiles connected.
FAR = 2


def units(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, dim, unit`` (the direction as bytes of doubles; null for vectors that link with nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col, out = b.column(1), []
            for v in col.to_pylist():
                unit = None
                if v is not None and None not in v:
                    x = np.array(v, dtype=np.float64)
                    top = np.abs(x).max(initial=0.0)
                    if np.isfinite(top) and top > 0:
                        x = x / top  # no overflow of the squares
                        unit = (x / np.sqrt(x @ x) + 0.0).tobytes()
                out.append(unit)
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], names=["id", "unit"])

    vec = F.col(f"`{vec_col}`").cast("array<double>")
    out = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), vec.alias("v")).mapInArrow(run, "id bigint, unit binary")
    return out.withColumn("dim", (F.length("unit") / 8).cast("int"))


def stack(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dim)


def centres_of(vectors: DataFrame, dim: int, n: int) -> np.ndarray:
    """Centres by k-means on a bounded sample in the order of hashed ids."""
    some = stack(vectors.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("unit").toArrow()["unit"], dim)
    k = int(min(CENTRES, len(some), max(1, -(-OVERLAP * n // (PART * 3 // 4)))))
    c = some[np.linspace(0, len(some) - 1, k).astype(int)].copy()
    for _ in range(8):
        near = np.concatenate([(some[a : a + 1024] @ c.T).argmax(axis=1) for a in range(0, len(some), 1024)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, some)
        size = np.sqrt((sums**2).sum(axis=1))
        c[size > 0] = sums[size > 0] / size[size > 0][:, None]
    return c


def pruned(x: np.ndarray, seed: int) -> np.ndarray:
    """Adjacency of a tile, ``[n, at most 2 * DEGREE + FAR]``, -1 where empty: robust pruning, then reverse edges."""
    n = len(x)
    if n < 2:
        return np.full((n, 1), -1)
    sims = x @ x.T
    np.fill_diagonal(sims, -2.0)
    pool = min(POOL, n - 1)
    near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
    s = np.take_along_axis(sims, near, axis=1)
    by = np.argsort(-s, axis=1, kind="stable")
    near, s = np.take_along_axis(near, by, axis=1), np.take_along_axis(s, by, axis=1)
    between = sims[near[:, :, None], near[:, None, :]]
    alive, out, row = np.ones((n, pool), dtype=bool), np.full((n, DEGREE), -1), np.arange(n)
    for r in range(min(DEGREE, pool)):
        any_left = alive.any(axis=1)
        first = alive.argmax(axis=1)
        out[any_left, r] = near[row, first][any_left]
        alive[row, first] = False
        covered = ALPHA * (1 - between[row, first]) <= 1 - s
        alive &= ~(covered & any_left[:, None])
    a, b = np.repeat(row, DEGREE), out.ravel()
    a, b = a[b >= 0], b[b >= 0]
    order = np.argsort(b, kind="stable")
    place = np.arange(len(b)) - np.searchsorted(b[order], b[order])
    back = np.full((n, DEGREE), -1)
    ok = place < DEGREE
    back[b[order][ok], place[ok]] = a[order][ok]
    far = np.random.default_rng(seed).integers(0, n, (n, FAR))
    far[far == row[:, None]] = -1
    return np.concatenate([out, back, far], axis=1)


def walk(x: np.ndarray, adjacency: np.ndarray, threshold: float) -> np.ndarray:
    """Vectors within the radius of each vector that the walk finds, ``[n, n]``."""
    n = len(x)
    mean = x.mean(axis=0)
    seeds = [int((x @ mean).argmax())]
    spread = x @ x[seeds[0]]
    for _ in range(min(MEDOIDS, n) - 1):  # further medoids: each the least like those taken
        seeds.append(int(spread.argmin()))
        spread = np.maximum(spread, x @ x[seeds[-1]])
    row = np.arange(n)
    sims = np.full((n, n), -2.0)  # -2: not visited
    seeds = np.array(seeds)
    sims[:, seeds] = x @ x[seeds].T
    sims[row, row] = 1.0  # a query is a vertex of the graph: its own list is a way in as well
    expanded = np.zeros((n, n), dtype=bool)

    def expand(queries: np.ndarray, at: np.ndarray) -> None:
        expanded[queries, at] = True
        near = adjacency[at]
        q = np.broadcast_to(queries[:, None], near.shape)
        new = near >= 0
        q, near = q[new], near[new]
        new = sims[q, near] < -1.5
        q, near = q[new], near[new]
        sims[q, near] = np.einsum("ij,ij->i", x[q], x[near])

    expand(row, row)
    beam = min(BEAM, n)
    active = row
    while len(active):  # greedy: the best of the beam that is not expanded yet
        top = np.argpartition(-sims[active], beam - 1, axis=1)[:, :beam]
        s = np.take_along_axis(sims[active], top, axis=1)
        s[np.take_along_axis(expanded[active], top, axis=1)] = -3.0
        best = s.argmax(axis=1)
        going = s[np.arange(len(active)), best] > -1.5
        active, at = active[going], top[np.arange(len(going)), best][going]
        expand(active, at)
    while True:  # range expansion
        q, at = np.nonzero((sims >= threshold) & ~expanded)
        if not len(q):
            break
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        expand(q[first], at[first])
    found = sims >= threshold
    found |= found.T
    np.fill_diagonal(found, False)
    return found


def _first_common(shards: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest shard that both vectors of a pair are in; the largest number there is for none."""
    common = np.full(len(a), np.iinfo(np.int64).max)
    for u in range(shards.shape[1]):
        for v in range(shards.shape[1]):
            eq = shards[a, u] == shards[b, v]
            common[eq] = np.minimum(common[eq], shards[a, u][eq])
    return common


def _roots(found: np.ndarray) -> np.ndarray:
    """For each vector of a tile the first one that links reach."""
    root = np.arange(len(found))
    while True:
        low = np.minimum(root, np.where(found, root[None, :], len(root)).min(axis=1, initial=len(root)))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _links(t: pa.Table, dim: int, threshold: float) -> pa.Table:
    """``rep, links, root`` for the vectors of one tile."""
    rep, part = t["rep"].to_numpy(), t["part"].to_numpy()
    shard, i, j = t["shard"][0].as_py(), t["i"][0].as_py(), t["j"][0].as_py()
    order = np.argsort(rep, kind="stable")
    t, rep, part = t.take(pa.array(order)), rep[order], part[order]
    x, many = stack(t["unit"], dim), t["many"].to_numpy()
    lists = [np.unique(np.frombuffer(b"".join(v), dtype=np.int64)) for v in t["near"].to_pylist()]
    flat = np.concatenate(lists)
    owner = np.repeat(np.arange(len(rep)), [len(v) for v in lists])
    place = np.minimum(np.searchsorted(rep, flat), len(rep) - 1)
    here = (rep[place] == flat) & (place != owner)  # the part of a united list that lies in this tile
    owner, place = owner[here], place[here]
    count = np.bincount(owner, minlength=len(rep))
    adjacency = np.full((len(rep), max(1, count.max(initial=0))), -1)
    adjacency[owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)] = place
    found = walk(x, adjacency, threshold)
    a, b = np.nonzero(found)
    right = _first_common(np.array(t["shards"].to_pylist()), a, b) == shard
    if i != j:
        right &= part[a] != part[b]
    links = np.bincount(a[right], weights=many[b[right]], minlength=len(rep)).astype(np.int64)
    return pa.table([pa.array(rep), pa.array(links), pa.array(rep[_roots(found)])], names=["rep", "links", "root"])


def _close_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of two blocks within the radius: in single precision, and in double where that leaves it open."""
    sims = x.astype(np.float32) @ y.astype(np.float32).T
    off = (x.shape[1] + 4) * 2.0**-23  # more than rounding can do to a cosine
    a, b = np.nonzero(sims >= threshold - off)
    open_ = np.flatnonzero(sims[a, b] < threshold + off)
    keep = np.ones(len(a), dtype=bool)
    for k in range(0, len(open_), 1 << 16):
        some = open_[k : k + (1 << 16)]
        keep[some] = np.einsum("ij,ij->i", x[a[some]], y[b[some]]) >= threshold
    return a[keep], b[keep]


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after joining ``a`` and ``b``; ``parent`` holds roots, the smallest place of each set."""
    for x, y in np.unique(np.stack([parent[a], parent[b]], axis=1), axis=0).tolist():
        while parent[x] != x:
            x = parent[x]
        while parent[y] != y:
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _all_pairs(placed: DataFrame, comp: DataFrame, dim: int, n: int, threshold: float, scratch: Scratch) -> DataFrame:
    """``rep, links, root`` from all pairs: a task's links of each vector, and a row for each two components it joins."""
    spark, count = placed.sparkSession, -(-n // PAIRED)
    known = placed.select("rep", "unit", "many").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select(F.pmod(F.xxhash64("rep"), F.lit(count)).cast("int").alias("block"), "rep", "unit", "many", F.coalesce("component", "rep").alias("comp"))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        cells = [b"".join(t["unit"].to_pylist()), *(t[c].to_numpy().tobytes() for c in ("rep", "many", "comp"))]
        return pa.table([t["block"][:1], *(pa.array([c], pa.binary()) for c in cells)], names=["block", "unit", "rep", "many", "comp"])

    blocks = scratch.table(known.groupBy("block").applyInArrow(pack, "block int, unit binary, rep binary, many binary, comp binary"))
    files = sorted(re.sub(r"^file:/+", "file:///", f) for f in blocks.inputFiles())

    def read(columns: list[str]):
        for uri in files:
            fs, at = pafs.FileSystem.from_uri(uri)
            with fs.open_input_file(at) as f:
                for b in pq.ParquetFile(f).iter_batches(batch_size=1, columns=columns):
                    for i in range(b.num_rows):
                        yield [b.column(c)[i].as_py() for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = {}
        for b in batches:
            for block, unit in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                mine[block] = np.frombuffer(unit, dtype=np.float64).reshape(-1, dim)
        if not mine:
            return
        at, parts, size = {}, [], 0
        for block, *cells in read(["block", "rep", "many", "comp"]):
            parts.append([np.frombuffer(c, dtype=np.int64) for c in cells])
            at[block], size = size, size + len(parts[-1][0])
        rep, many, comp = (np.concatenate([p[k] for p in parts]) for k in range(3))
        names, parent = np.unique(comp, return_inverse=True)  # a set per component of the walk
        sets, joined, links = parent, np.arange(len(names)), np.zeros(size, dtype=np.int64)
        for other, unit in read(["block", "unit"]):
            y, q = np.frombuffer(unit, dtype=np.float64).reshape(-1, dim), at[other]
            for block, x in mine.items():
                ahead = (other - block) % count  # each two blocks meet in the task of one of them
                if 2 * ahead > count or (2 * ahead == count and block > other):
                    continue
                a, b = _close_pairs(x, y, threshold)
                if not ahead:
                    a, b = a[a < b], b[a < b]
                p = at[block]
                links[p : p + len(x)] += np.bincount(a, many[q + b], len(x)).astype(np.int64)
                links[q : q + len(y)] += np.bincount(b, many[p + a], len(y)).astype(np.int64)
                u, v = sets[p + a], sets[q + b]
                new = joined[u] != joined[v]
                if new.any():
                    joined = _unite(joined, u[new], v[new])
        some, met = np.flatnonzero(links), np.flatnonzero(joined != np.arange(len(joined)))
        for k in range(0, len(some), 100_000):
            part = some[k : k + 100_000]
            yield pa.record_batch([pa.array(rep[part]), pa.array(links[part]), pa.array(rep[part])], names=["rep", "links", "root"])
        for k in range(0, len(met), 100_000):
            part = met[k : k + 100_000]
            yield pa.record_batch([pa.array(names[part]), pa.array(np.zeros(len(part), dtype=np.int64)), pa.array(names[joined[part]])], names=["rep", "links", "root"])

    tasks = max(1, min(count, 2 * spark.sparkContext.defaultParallelism))
    dealt = blocks.select("block", "unit").repartition(tasks, F.pmod("block", F.lit(tasks)))
    return dealt.mapInArrow(run, "rep bigint, links bigint, root bigint")


def near_vectors(
    df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", exact: bool = False,
) -> DataFrame:
    """``id, n_links, component`` for every row: other rows with cosine at least ``threshold`` that the walk found, or
    with ``exact`` all there are. Below about 0.9 vectors link across shards, and a walk alone misses some.

    Vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different lengths
    do not link. Rows of equal direction are linked with each other and with the same others. Rows without an id take
    no part and are given back with null. Equal rows of one id are one vector, given back as often as they stand; an id
    with several vectors has the links of each. An empty table gives no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    durable = scratch.table
    rows = durable(units(df, id_col, vec_col))
    good = rows.filter("unit IS NOT NULL AND id IS NOT NULL")
    classes = durable(good.groupBy("dim", "unit").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("many")))
    linked = spark.createDataFrame([], "rep bigint, links bigint, root bigint")
    for r in sorted(classes.groupBy("dim").count().collect()):
        linked = linked.union(_search(classes.filter(F.col("dim") == r["dim"]), r["dim"], r["count"], threshold, scratch, exact))
    linked = durable(linked)
    comp = components(linked.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    known = durable(classes.join(links, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select(
        "dim", "unit", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"), F.coalesce("component", "rep").alias("component")))
    scratch.drop([rows, known])
    out = rows.join(known, ["dim", "unit"], "left")
    whole = F.col("id").isNotNull()
    return out.select("id", F.when(whole, F.coalesce("links", F.lit(0))).otherwise(0).alias("n_links"), F.when(whole, F.coalesce("component", "id")).alias("component"))


def _search(classes: DataFrame, dim: int, n: int, threshold: float, scratch: Scratch, exact: bool = False) -> DataFrame:
    centres = centres_of(classes, dim, n)
    overlap, durable = min(OVERLAP, len(centres)), scratch.table

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = stack(b.column(1), dim)
                near = np.concatenate([np.argpartition(-(x[a : a + 1024] @ centres.T), overlap - 1, axis=1)[:, :overlap] for a in range(0, len(x), 1024)])
                near.sort(axis=1)
                shards = pa.FixedSizeListArray.from_arrays(pa.array(near.astype(np.int32).ravel()), overlap).cast(pa.list_(pa.int32()))
                yield pa.record_batch([*b.columns, shards], names=["rep", "unit", "many", "shards"])

    placed = durable(classes.select("rep", "unit", "many").mapInArrow(assign, "rep bigint, unit binary, many bigint, shards array<int>"))
    sizes = {r["shard"]: r["count"] for r in placed.select(F.explode("shards").alias("shard")).groupBy("shard").count().collect()}  # at most CENTRES rows
    parts = placed.sparkSession.createDataFrame([(s, -(-k // PART)) for s, k in sorted(sizes.items())], "shard int, parts int")

    def tiles(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("shard", F.explode("shards")).join(F.broadcast(parts), "shard")
        out = rows.withColumn("part", F.pmod(F.xxhash64("rep", "shard"), F.col("parts")).cast("int"))
        out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return out.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other", "parts")

    def build(t: pa.Table) -> pa.Table:
        rep = t["rep"].to_numpy()
        order = np.argsort(rep, kind="stable")
        adjacency = pruned(stack(t["unit"], dim)[order], t["shard"][0].as_py())
        rep = rep[order]
        near = [rep[a[a >= 0]].tobytes() for a in adjacency]
        return pa.table([pa.array(rep), pa.array(near, pa.binary())], names=["rep", "near"])

    graph = tiles(placed.select("rep", "unit", "shards")).groupBy("shard", "i", "j").applyInArrow(build, "rep bigint, near binary")
    flat = durable(graph.groupBy("rep").agg(F.collect_list("near").alias("near")))  # a list per tile of the vector
    ready = tiles(placed.join(flat, "rep"))
    kind = "rep bigint, links bigint, root bigint"
    near = ready.groupBy("shard", "i", "j").applyInArrow(lambda t: _links(t, dim, threshold), kind)
    if not exact:
        return near
    walked = durable(near.filter("rep <> root").select("rep", F.lit(0).cast("bigint").alias("links"), "root"))
    comp = components(walked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    return walked.union(_all_pairs(placed, comp, dim, n, threshold, scratch))


def recall(df: DataFrame, found: DataFrame, sample: int = 200, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """Links found over links there are, for a bounded sample of vectors held against all rows."""
    rows = Scratch(df.sparkSession).table(units(df, id_col, vec_col).filter("unit IS NOT NULL AND id IS NOT NULL"))
    some = rows.orderBy(F.xxhash64("id", F.lit(1))).limit(sample).toArrow()
    have = {r["id"]: r["n_links"] for r in found.join(rows.sparkSession.createDataFrame([(i,) for i in some["id"].to_pylist()], "id bigint"), "id").collect()}
    asked = [(i, np.frombuffer(u, dtype=np.float64)) for i, u in zip(some["id"].to_pylist(), some["unit"].to_pylist())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), dtype=np.int64)
        for b in batches:
            units_of = [np.frombuffer(u, dtype=np.float64) for u in b.column(1).to_pylist()]
            for k, (_, q) in enumerate(asked):
                same = [u for u in units_of if len(u) == len(q)]
                total[k] += int((np.array(same) @ q >= threshold).sum()) if same else 0
        yield pa.record_batch([pa.array([i for i, _ in asked]), pa.array(total)], names=["id", "n"])

    true = rows.select("id", "unit").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    there = sum(r["n"] - 1 for r in true)
    return sum(min(have[r["id"]], r["n"] - 1) for r in true) / there if there else 1.0
