"""Near-duplicate vectors by NN-descent.

1. Equal vectors collapse to a node, the smallest id that has them, with their count.
2. Start: in each of some random-hyperplane orders, blocks of BLOCK neighbouring vectors are compared in full,
   with overlap; every vector lists its K best. The number of hyperplanes grows with the table, so a block stays near
   one bucket, and the number of orders with it, so that a pair at the threshold shares a bucket
   but with probability APART; a hot bucket is just several blocks.
3. Descent: at each vector whose list is new, its neighbours and a bounded share of those that list it are compared
   with each other. A list that is saturated, full of entries at the threshold, is enlarged to twice its length, up to MOST_K.
   Rounds end when few entries change and no list grows.
4. Every comparison also gives joins: edges at the threshold that span the components within it. They are kept
   beside the lists, so no list's bound loses a component; they are the graph's threshold edges. Each component is
   compared tile by tile; a tile gives one count a vector, never pairs. So the number of links is exact.
5. At every size every pair of vectors of different components is compared, block by block; the links so found join
   components, so no link is lost. The descent finds almost all of them before, so hardly a pair leaves a task.

Vectors travel as stored (32-bit floats as such). Cosines are taken in single precision first; those within
its error of the threshold are taken again in double.

Defined cases: null, zero, empty or non-finite vectors, and null components, link with nothing; vectors of different
length don't link; repeated rows of an id count as vectors each, and several vectors of an id each by itself; a row without
an id links with nothing, has no component and is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icspark.llm.common import Scratch, components, numbered

THRESHOLD = 0.9
#: Length of a list, and of a saturated one at most; entries a row gains from one comparison; vectors of a block.
K, MOST_K, GAIN, BLOCK = 8, 32, 3, 256
#: Rounds at most; share of changed entries that ends them; reverse neighbours, and candidates of a list, by hash slot.
MOST_ROUNDS, SETTLED, REVERSE, SLOTS = 8, 0.01, 8, 128
TILE, LEAST_TILE, TABLES = 512, 128, 8
#: Bytes of vectors that one broadcast of the exact pass holds.
PASS_BYTES = 16 << 20
#: A pair at the threshold shares no bucket with this probability at most.
APART = 1e-3


def _unit(raw: list[bytes], stored: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), stored).reshape(len(raw), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _cosines(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cosines in single precision, whether they reach the threshold in double) of unit vectors."""
    sims = x.astype(np.float32) @ y.astype(np.float32).T
    near = sims >= THRESHOLD
    r, c = np.nonzero(np.abs(sims - np.float32(THRESHOLD)) < x.shape[1] * 2.0**-22 + 1e-6)
    for k in range(0, len(r), 50_000):
        p, q = r[k : k + 50_000], c[k : k + 50_000]
        near[p, q] = (x[p] * y[q]).sum(1) >= THRESHOLD
    return sims, near


def _spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(child, parent) places of a forest that spans the components of a comparison; no vector is a child twice."""
    child, parent = [], []
    seen = ~near.any(1)
    for r in np.flatnonzero(~seen).tolist():
        if seen[r]:
            continue
        seen[r], front = True, np.array([r])
        while len(front):
            fresh = near[front] & ~seen
            new = np.flatnonzero(fresh.any(0))
            child.append(new)
            parent.append(front[fresh[:, new].argmax(0)])
            seen[new], front = True, new
    none = np.empty(0, np.int64)
    return np.concatenate([none, *child]), np.concatenate([none, *parent])


class _Found:
    """Edges of comparisons: u, v, sim, joins; given away batch by batch."""

    def __init__(self):
        self.parts, self.rows = [], 0

    def compare(self, vecs: list[bytes], ids: list[int], stored: str) -> None:
        if len(ids) < 2:
            return
        at, x = np.array(ids), _unit(vecs, stored)
        sims, near = _cosines(x, x)
        np.fill_diagonal(near, False)
        np.fill_diagonal(sims, -2)
        a, b = _spanning(near)
        self._add(at[a], at[b], sims[a, b], True)
        k = min(GAIN, len(at) - 1)
        best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        rows = np.repeat(np.arange(len(at)), k)
        self._add(at[rows], at[best.ravel()], sims[rows, best.ravel()], False)

    def _add(self, u: np.ndarray, v: np.ndarray, sim: np.ndarray, joins: bool) -> None:
        self.parts.append((u, v, np.round(sim, 4), np.full(len(u), joins)))
        self.rows += len(u)

    def batches(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.rows > least:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*self.parts), (pa.int64(), pa.int64(), pa.float32(), pa.bool_()))], ["u", "v", "sim", "joins"])
            self.parts, self.rows = [], 0


_FOUND = "u long, v long, sim float, joins boolean"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(vec_id, dim, vec (bytes), digest; nulls where a vector can't link), and how numbers are stored in vec."""
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    stored = "<f4" if single else "<f8"
    thin = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, vecs, digests = [], [], []
            for v in b.column(1):
                v = v.values
                x = None if v is None or v.null_count or not len(v) else v.to_numpy(zero_copy_only=False).astype(np.float64)
                if x is None or not np.isfinite(x).all() or not (x * x).sum() > 0 or not np.isfinite((x * x).sum()):
                    dims.append(None), vecs.append(None), digests.append(None)
                    continue
                raw = (x + 0.0).astype(stored).tobytes()  # one zero
                dims.append(len(x)), vecs.append(raw), digests.append(hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary()), pa.array(digests, pa.binary())], ["vec_id", "dim", "vec", "digest"])

    return thin.mapInArrow(go, "vec_id long, dim int, vec binary, digest binary"), stored


def _bits(n: int) -> int:
    return max(2, math.ceil(math.log2(max(n, 2) / (BLOCK / 2))))


def _tables(n: int) -> int:
    """So many orders that a pair at the threshold, alone, shares a bucket in one of them but with probability APART."""
    share = (1 - math.acos(THRESHOLD) / math.pi) ** _bits(n)
    return max(TABLES, math.ceil(math.log(APART) / math.log1p(-share)))


def _seeded(reps: DataFrame, stored: str, n: int, tables: int) -> DataFrame:
    """(u, v, sim, joins): best neighbours and joins within blocks of the random-hyperplane orders."""
    bits = _bits(n)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            dims = np.array(b.column(1).to_pylist())
            for d in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == d))
                x = _unit(part.column(2).to_pylist(), stored)
                if d not in planes:
                    planes[d] = np.stack([np.random.default_rng([d, t]).standard_normal((d, bits + 1)) for t in range(tables)])
                for t in range(tables):
                    p = x @ planes[d][t]
                    key = (p[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), part.column(1), pa.array(key), pa.array(p[:, bits]), part.column(0), part.column(2)], ["t", "dim", "key", "p", "node", "vec"])

    placed = reps.select("node", "dim", "vec").mapInArrow(dealt, "t int, dim int, key long, p double, node long, vec binary")
    sorted_ = placed.repartitionByRange("t", "dim", "key", "p", "node").sortWithinPartitions("t", "dim", "key", "p", "node")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vecs, found = None, [], [], _Found()
        for b in batches:
            for t, d, node, vec in zip(*(b.column(k).to_pylist() for k in (0, 1, 4, 5))):
                if at != (t, d):
                    found.compare(vecs, ids, stored)
                    at, ids, vecs = (t, d), [], []
                ids.append(node), vecs.append(vec)
                if len(ids) == BLOCK:
                    found.compare(vecs, ids, stored)
                    ids, vecs = ids[BLOCK // 2 :], vecs[BLOCK // 2 :]
            yield from found.batches(50_000)
        found.compare(vecs, ids, stored)
        yield from found.batches()

    return sorted_.mapInArrow(blocks, _FOUND)


def _lists(found: DataFrame, graph: DataFrame | None) -> DataFrame:
    """The next graph: u, l (its best neighbours, with sims), k (its length at most), active (new here), grew.

    found: u, v, sim. The best of each hash slot compete, so what a vector gathers is bounded, whatever lists it.
    """
    edges = found.select("u", "v", "sim", F.lit(K).alias("k"))
    if graph is not None:
        held = graph.select("u", "k", F.explode("l").alias("x")).select("u", F.col("x.v").alias("v"), F.col("x.sim").alias("sim"), "k")
        edges = edges.unionByName(held).unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim", F.lit(K).alias("k")))
    best = edges.groupBy("u", F.pmod(F.xxhash64("v"), F.lit(SLOTS)).alias("slot")).agg(F.max("sim").alias("sim"), F.max_by("v", "sim").alias("v"), F.max("k").alias("k"))
    lists = best.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("sim", "v")), asc=False).alias("l"), F.max("k").alias("k"))
    lists = lists.select("u", F.slice("l", 1, F.col("k")).alias("l"), "k")
    full = F.size(F.filter("l", lambda x: x["sim"] >= F.lit(THRESHOLD).cast("float"))) >= F.col("k")
    lists = lists.withColumn("longer", F.when(full, F.least(2 * F.col("k"), F.lit(MOST_K))).otherwise(F.col("k")))
    if graph is None:
        return lists.select("u", "l", F.col("longer").alias("k"), F.lit(True).alias("active"), F.size("l").alias("grew"))
    both = lists.join(graph.select("u", F.col("l.v").alias("was")), "u", "left")
    grew = F.size(F.array_except("l.v", F.coalesce("was", F.array().cast("array<long>"))))
    return both.select("u", "l", F.col("longer").alias("k"), ((grew > 0) | (F.col("longer") > F.col("k"))).alias("active"), grew.alias("grew"))


def _descend(graph: DataFrame, vectors: DataFrame, stored: str) -> DataFrame:
    """(u, v, sim, joins) of one round: at each active vector its neighbours, and a bounded share of those that list it, are compared."""
    listed = graph.select("u", "active", F.explode("l.v").alias("v"))
    back = listed.select(F.col("v").alias("u"), F.col("u").alias("v"), F.xxhash64("u", "v").alias("h"))
    # a bounded share of the reverse lists, one per hash slot, combined before the shuffle
    share = back.groupBy("u", F.pmod("h", F.lit(REVERSE)).alias("slot")).agg(F.min_by("v", "h").alias("v")).select("u", "v")
    share = share.join(graph.where("active").select("u"), "u", "left_semi")
    near = listed.where("active").select("u", "v").unionByName(share).distinct()
    sent = near.join(vectors.select(F.col("node").alias("v"), "vec"), "v").select("u", "v", "vec")
    sent = sent.repartition("u").sortWithinPartitions("u", "v")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vecs, found = None, [], [], _Found()
        for b in batches:
            for u, v, vec in zip(*(b.column(k).to_pylist() for k in range(3))):
                if u != at:
                    found.compare(vecs, ids, stored)
                    at, ids, vecs = u, [], []
                ids.append(v), vecs.append(vec)
            yield from found.batches(50_000)
        found.compare(vecs, ids, stored)
        yield from found.batches()

    return sent.mapInArrow(go, _FOUND)


def _counts(members: DataFrame, stored: str) -> DataFrame:
    """members: node, m, root, size, vec. (node, n): copies-weighted links within the component, the vector itself among them."""
    size = F.col("size")
    tiles = F.greatest(F.ceil(size / TILE), F.least(F.lit(4), F.ceil(size / LEAST_TILE))).cast("int")
    placed = members.withColumn("own", F.pmod(F.xxhash64("node"), tiles).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), tiles - 1)))
    placed = placed.select("root", F.least("own", "t").alias("i"), F.greatest("own", "t").alias("j"), "own", "node", "m", "vec")
    dealt = placed.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile = None, []  # a tile is all that is held

        def counted() -> Iterator[pa.RecordBatch]:
            if not tile:
                return
            own, node, m, vec = (list(c) for c in zip(*tile))
            x, m, own = _unit(vec, stored), np.array(m), np.array(own)
            a, b = np.flatnonzero(own == at[1]), np.flatnonzero(own == at[2])
            _, near = _cosines(x[a], x[b])
            n = np.zeros(len(node), np.int64)
            n[a] += near @ m[b]
            if at[1] != at[2]:
                n[b] += near.T @ m[a]
            tile.clear()
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n)], ["node", "n"])

        for batch in batches:
            for root, i, j, *row in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if at != (root, i, j):
                    yield from counted()
                    at = (root, i, j)
                tile.append(row)
        yield from counted()

    return dealt.mapInArrow(go, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def _by_dim(rows: list[tuple[int, int, bytes, int]], stored: str) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(node, dim, vec, root) rows by dim: ids, unit vectors, roots."""
    of: dict[int, list] = {}
    for r in rows:
        of.setdefault(r[1], []).append(r)
    return {d: (np.array([r[0] for r in part]), _unit([r[2] for r in part], stored), np.array([r[3] for r in part])) for d, part in of.items()}


def _tiles(b: pa.RecordBatch, held: dict, stored: str) -> Iterator[tuple]:
    """Tiles of a batch (node, dim, vec, root) against held vectors of the same dim: near, own ids and roots, held ids and roots."""
    dims = np.array(b.column(1).to_pylist())
    for d, (ids, y, roots) in held.items():
        part = b.filter(pa.array(dims == d))
        for s in range(0, part.num_rows, 1024):
            t = part.slice(s, 1024)
            x, mine, own = _unit(t.column(2).to_pylist(), stored), *(np.array(t.column(k).to_pylist()) for k in (0, 3))
            for k in range(0, len(ids), 4096):
                c = slice(k, k + 4096)
                yield _cosines(x, y[c])[1], mine, own, ids[c], roots[c]


def _between(scratch: Scratch, labelled: DataFrame, stored: str) -> DataFrame:
    """labelled: node, dim, vec, root. (a, b): roots of different components with a link, from all pairs; each task gives only joining ones."""
    size = labelled.agg(F.sum(F.octet_length("vec"))).first()[0] or 0
    n = 1 + size // PASS_BYTES
    block, out = F.pmod(F.xxhash64("node"), F.lit(n)), None
    for k in range(n):
        shared = labelled.sparkSession.sparkContext.broadcast([(r[0], r[1], bytes(r[2]), r[3]) for r in labelled.where(block == k).collect()])

        def go(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held, up = _by_dim(shared.value, stored), {}

            def top(r: int) -> int:
                while up.get(r, r) != r:
                    r = up[r]
                return r

            for b in batches:
                out = []
                for near, _, own, _, roots in _tiles(b, held, stored):
                    near &= own[:, None] != roots[None]
                    r, c = np.nonzero(near)
                    for p, q in np.unique(np.stack([own[r], roots[c]], 1), axis=0).tolist():
                        x, y = top(p), top(q)
                        if x != y:
                            up[max(x, y)] = min(x, y)
                            out.append((p, q))
                yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        found = scratch.cut(labelled.where(block >= k).mapInArrow(go, "a long, b long"))
        shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    every, stored = usable(vectors, id_col, vector_col)
    every = scratch.cut(every)
    good = every.where("vec is not null and vec_id is not null")
    # each vector once, with the smallest id that has it
    copies = good.groupBy("digest").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("m"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    reps = numbered(scratch, scratch.cut(copies.withColumn("row", F.xxhash64("digest"))), "vec_id")
    n = reps.count()
    found = scratch.cut(_seeded(reps, stored, n, _tables(n)))
    graph, links = scratch.cut(_lists(found.where("not joins"), None)), None
    for _ in range(MOST_ROUNDS):
        joins = found.where("joins").select(F.col("u").alias("a"), F.col("v").alias("b"))
        links = joins if links is None else links.unionByName(joins)
        found = scratch.cut(_descend(graph, reps, stored))
        graph, (grew, longer) = scratch.watched(_lists(found.where("not joins"), graph), F.coalesce(F.sum("grew"), F.lit(0)), F.count(F.when(F.col("active") & (F.col("grew") == 0), 1)))
        if grew <= SETTLED * n * K and longer <= SETTLED * n:
            break
    links = links.unionByName(found.where("joins").select(F.col("u").alias("a"), F.col("v").alias("b")))
    roots = scratch.cut(components(scratch, links))
    named = reps.join(roots.withColumnRenamed("id", "node"), "node", "left").select("node", "dim", "vec", F.coalesce("root", "node").alias("root"))
    labelled = scratch.cut(named.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "node"))
    missed = _between(scratch, labelled, stored)
    if not missed.isEmpty():
        stars = roots.select(F.col("id").alias("a"), F.col("root").alias("b"))
        roots = scratch.cut(components(scratch, stars.unionByName(missed)))
    joined = roots.select(F.col("id").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    sizes = joined.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = reps.join(joined, "node").join(sizes, "root").select("node", "m", "root", "size", "vec")
    heads = reps.select(F.col("node").alias("root"), F.col("vec_id").alias("head"))
    placed = reps.select("digest", "m", "node", F.col("vec_id").alias("own")).join(_counts(members, stored), "node", "left").join(joined, "node", "left").join(heads, "root", "left")
    out = every.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(placed.select("digest", "m", "n", F.coalesce("head", "own").alias("smallest")), "digest", "left")
    component = F.coalesce("smallest", "vec_id")
    # n counts a vector's own copies, itself among them
    links_ = F.coalesce(F.col("n") - 1, F.col("m") - 1, F.lit(0)).cast("long")
    return out.select("vec_id", links_.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
