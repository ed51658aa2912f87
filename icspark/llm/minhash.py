"""Near-duplicates of documents by SuperMinHash, banding, verification and union-find grouping.

SuperMinHash gives each shingle a random permutation of the slots; its value in the slot it
meets at step j is j plus a uniform fraction, so the slots of one signature are negatively
correlated and estimates vary less than with independent hashes. A document stops early, at the first
step that no slot can still gain from. The bands follow the threshold: a pair at it
is missed with probability below 1e-6 (26 bands of 5 slots at 0.85, 38 of 5 at 0.8).

1. One pass over the texts writes set size, sequence digest, bands and a one-byte-a-slot signature.
2. Equal word sequences collapse to the row of their smallest id, a node. Rows are told apart by id and text.
3. In every bucket of equal bands, members are paired with the smallest member only. Buckets
   whose members then still lie in several components are compared in full, in tiles of bounded size,
   by signature; the texts of only those members are fetched that look similar to one of another component.
4. Every pair so found is confirmed on the full shingle sets before it links. Only texts of such pairs travel.
5. Links become components by one task's union-find while they are few (FOREST_EDGES), by alternating star rounds beyond.

Defined cases: null and empty texts have no shingles and link with nothing; fewer words than
a shingle are one shingle; repeated rows of an id are answered each with the same result, and several texts of an id each by
itself; a row without an id links with nothing, has no component and is kept; of a component all rows of its smallest
id are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icspark.llm.common import FOREST_EDGES, Scratch, components, light, mixed, numbered, small_batches, text_bytes, window_hashes, word_hashes

SHINGLE, PERCENT = 5, 85
ROWS, MISSED, MOST_SLOTS = 5, 3e-7, 255


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): as many rows as ROWS and MOST_SLOTS allow, so many bands that a pair at `percent` is missed with probability MISSED at most."""
    for rows in range(ROWS, 0, -1):
        share = (percent / 100) ** rows
        bands = 1 if share >= 1 else math.ceil(math.log(MISSED) / math.log1p(-share))
        if bands * rows <= MOST_SLOTS:
            return bands, rows
    raise ValueError(f"no banding within {MOST_SLOTS} slots finds pairs at {percent} percent")


def least_agree(percent: int) -> float:
    """Share of agreeing slots below which a pair at `percent` is more than 5.4 standard deviations off."""
    p, (bands, rows) = percent / 100, banding(percent)
    return p - 5.43 * math.sqrt(p * (1 - p) / (bands * rows))


BANDS = banding(PERCENT)[0]
SLOTS = BANDS * ROWS
#: Members of a set that one tile holds, on either side; shingles that one vector step holds.
TILE, STEP_SHINGLES = 128, 150_000
#: A bucket with more members is hot. Rows of three numbers that may be broadcast.
HOT_BUCKET, MOST_BROADCAST = 64, 500_000


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0d part words


def shingles(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all k-word shingles; of the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(k, len(words))))


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each set: documents by slots, step in the high byte and a fraction below it."""
    out = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    flat = out.ravel()
    todo = [k for k, s in enumerate(sets) if len(s)]
    while todo:
        part, size = [], 0
        while todo and (not part or size + len(sets[todo[-1]]) <= STEP_SHINGLES):
            part.append(todo.pop())
            size += len(sets[part[-1]])
        elem = np.concatenate([sets[k] for k in part])
        doc = np.repeat(np.array(part, np.int64), [len(sets[k]) for k in part])
        perm = np.tile(np.arange(slots, dtype=np.uint8), (len(elem), 1))
        for j in range(slots):
            row = np.arange(len(elem))
            r = mixed(elem + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            other = (j + ((r * np.uint64(0xD1342543DE82EF95)) >> np.uint64(40)) % np.uint64(slots - j)).astype(np.int64)
            slot = perm[row, other]
            perm[row, other] = perm[:, j]
            perm[:, j] = slot
            np.minimum.at(flat, doc * slots + slot, np.uint64(j << 56) | (r >> np.uint64(8)))
            open_ = out[part].max(1) >= np.uint64(min((j + 1) << 56, (1 << 64) - 1))
            if not open_.any():
                break
            if not open_.all():
                alive = np.zeros(len(sets), bool)
                alive[np.array(part)[open_]] = True
                keep = alive[doc]
                elem, doc, perm = elem[keep], doc[keep], perm[keep]
                part = [k for k, o in zip(part, open_) if o]
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band, with the band's number mixed in."""
    parts = mixed(signature).reshape(len(signature), bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k])
    return key


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * |a and b| >= percent * |a or b| on sorted distinct hashes."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketch(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs: doc_id, row, text. Gives doc_id, row, n_shingles, seq, bands, sig."""
    bands, rows = banding(percent)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t) for t in text_bytes(b.column(2))]
            sets = [shingles(w) for w in words]
            sig = signatures(sets, bands * rows)
            keys = band_keys(sig, bands, rows).view(np.int64)
            low = (mixed(sig) & np.uint64(255)).astype(np.uint8)
            some = [bool(len(s)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(b" ".join(w), digest_size=16).digest() if ok else None for w, ok in zip(words, some)], pa.binary()),
                    pa.array([k.tolist() if ok else None for k, ok in zip(keys, some)], pa.list_(pa.int64())),
                    pa.array([x.tobytes() if ok else None for x, ok in zip(low, some)], pa.binary()),
                ],
                ["doc_id", "row", "n_shingles", "seq", "bands", "sig"],
            )

    return docs.mapInArrow(go, "doc_id long, row long, n_shingles long, seq binary, bands array<long>, sig binary")


def _agreeing(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree often enough."""
    least = least_agree(percent)
    x = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    both = x.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b").select("a", "b", "sig_a", "sig_b")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(t.column(k).to_pylist()), np.uint8).reshape(t.num_rows, -1) for k in (2, 3))
            yield t.select(["a", "b"]).filter(pa.array((left == right).mean(1) >= least))

    return both.mapInArrow(go, "a long, b long")


def texts_of(scratch: Scratch, wanted: DataFrame, chosen: DataFrame, thin: DataFrame) -> DataFrame:
    """wanted: node. (node, text), written: each node's text once, and no others. Only what is wanted is shuffled, while its ids are few enough to broadcast."""
    rows = scratch.cut(chosen.select("node", "doc_id", "row").join(wanted.distinct(), "node"))
    few = rows.count() <= MOST_BROADCAST
    return scratch.cut(thin.join(F.broadcast(rows) if few else rows, ["doc_id", "row"]).dropDuplicates(["node"]).select("node", "text"))


def confirm(scratch: Scratch, pairs: DataFrame, chosen: DataFrame, thin: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar, written. Texts meet by node; b may be hot, its joins split."""
    pairs = scratch.cut(pairs)
    texts = texts_of(scratch, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), chosen, thin)
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for t in batches:
            keep = []
            for x, y in zip(text_bytes(t.column(2)), text_bytes(t.column(3))):
                if y != held:
                    held, last = y, shingles(words_of(y))
                keep.append(similar(shingles(words_of(x)), last, percent))
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return scratch.cut(both.mapInArrow(go, "a long, b long"))


def _unmet(open_rows: DataFrame, percent: int) -> DataFrame:
    """open_rows: k, hub, node, root, sig of small buckets with several components. Pairs that agree across components."""
    least = least_agree(percent)

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(pdf.sig), np.uint8).reshape(len(pdf), -1)
        ids, root, hub = (pdf[c].to_numpy() for c in ("node", "root", "hub"))
        out = []
        for x in np.flatnonzero(ids != hub).tolist():  # pairs with the hub were tried
            y = np.flatnonzero((ids > ids[x]) & (root != root[x]))
            out += [(ids[k], ids[x]) for k in y[(sig[y] == sig[x]).mean(1) >= least]]
        return pd.DataFrame(out, columns=["a", "b"])

    return open_rows.groupBy("k").applyInPandas(go, "a long, b long").distinct()


_TILED = "g long, i int, j int, own int, node long, root long, n_shingles long, sig binary"


def _alike(pdf: pd.DataFrame, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Members of a tile, by place, with those on its other side whose size and signature look similar, in other components."""
    sig, least = np.frombuffer(b"".join(pdf.sig), np.uint8).reshape(len(pdf), -1), least_agree(percent)
    root, own, size = (pdf[c].to_numpy() for c in ("root", "own", "n_shingles"))
    first, second = np.flatnonzero(own == pdf.i.iloc[0]), np.flatnonzero(own == pdf.j.iloc[0])
    for x in first.tolist():
        y = second[(root[second] != root[x]) & (100 * np.minimum(size[second], size[x]) >= percent * np.maximum(size[second], size[x]))]
        y = y[(sig[y] == sig[x]).mean(1) >= least]
        if len(y):
            yield x, y


def _open_in_tiles(members: DataFrame, percent: int) -> DataFrame:
    """members: node, root, g, size, n_shingles, sig of large sets that may be similar. The members of each tile that look similar to one of another component.

    Every pair of a set meets in one tile; only signatures travel to it.
    """
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    placed = members.withColumn("own", F.pmod(F.xxhash64("node"), tiles).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), tiles - 1)))
    placed = placed.withColumn("i", F.least("own", "t")).withColumn("j", F.greatest("own", "t"))

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        met = {k for x, y in _alike(pdf, percent) for k in (x, *y.tolist())}
        return pdf.iloc[sorted(met)]

    return placed.select(*[x.split()[0] for x in _TILED.split(", ")]).groupBy("g", "i", "j").applyInPandas(go, _TILED)


def _joined_in_tiles(members: DataFrame, percent: int) -> DataFrame:
    """members: as `_open_in_tiles` gives them, with text. A union-find over components skips what is already joined, full shingle sets decide, and only joining links leave."""

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        ids, root = pdf.node.to_numpy(), pdf.root.to_numpy()
        sets = [shingles(words_of(t.encode())) for t in pdf.text]
        up: dict[int, int] = {}

        def top(r: int) -> int:
            while up.get(r, r) != r:
                r = up[r]
            return r

        out = []
        for x, y in _alike(pdf, percent):
            for k in y.tolist():
                a, b = top(root[x]), top(root[k])
                if a != b and similar(sets[x], sets[k], percent):
                    up[max(a, b)] = min(a, b)
                    out.append((max(ids[x], ids[k]), min(ids[x], ids[k])))
        return pd.DataFrame(out, columns=["a", "b"])

    return members.groupBy("g", "i", "j").applyInPandas(go, "a long, b long").distinct()


def groups(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; with_row adds `row`, the hash of its text."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    every = scratch.cut(sketch(thin, percent))
    able = every.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # each word sequence once, as the row of its smallest id
    least = able.groupBy("seq").agg(F.min(F.struct("doc_id", "row")).alias("s"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sig")])
    chosen = numbered(scratch, scratch.cut(least.select("seq", "s.doc_id", "s.row", "n_shingles", "bands", "sig")))
    sigs = chosen.select("node", "sig")
    keyed = chosen.select("node", F.explode("bands").alias("k"))
    hubs = scratch.cut(keyed.groupBy("k").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = scratch.cut(keyed.join(hubs, "k"))  # members of buckets of two or more
    pairs = scratch.cut(met.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    links = confirm(scratch, _agreeing(pairs, sigs, percent), chosen, thin, percent)
    roots = scratch.cut(components(scratch, links, together=FOREST_EDGES)).withColumnRenamed("id", "node")
    # buckets of three or more that the stars left in pieces
    labelled = scratch.cut(met.where("n > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    broken = scratch.cut(labelled.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("k"))
    open_rows = scratch.cut(labelled.join(broken, "k"))
    small = open_rows.where(F.col("n") <= HOT_BUCKET).join(sigs, "node").select("k", "hub", "node", "root", "sig")
    more = confirm(scratch, _unmet(small, percent), chosen, thin, percent)
    # hot buckets that share members form sets; each set is compared once, whatever its buckets
    hot = scratch.cut(open_rows.where(F.col("n") > HOT_BUCKET).select("node", "hub", "root").distinct())
    if not hot.isEmpty():
        sets = scratch.cut(components(scratch, hot.select(F.col("node").alias("a"), F.col("hub").alias("b")), together=FOREST_EDGES)).select(F.col("id").alias("node"), F.col("root").alias("set"))
        within = scratch.cut(hot.select("node", "root").distinct().join(sets, "node", "left").select("node", "root", F.coalesce("set", "node").alias("g")))
        size = scratch.cut(within.groupBy("g").agg(F.count(F.lit(1)).alias("size")))
        members = within.join(F.broadcast(size) if size.count() <= MOST_BROADCAST else size, "g").join(chosen.select("node", "n_shingles", "sig"), "node")
        still = scratch.cut(_open_in_tiles(members, percent))
        more = more.unionByName(scratch.cut(_joined_in_tiles(still.join(texts_of(scratch, still.select("node"), chosen, thin), "node"), percent)))
    if not more.isEmpty():
        roots = scratch.cut(components(scratch, links.unionByName(more), together=FOREST_EDGES)).withColumnRenamed("id", "node")
    heads = chosen.select(F.col("node").alias("root"), F.col("doc_id").alias("head"))
    placed = chosen.select("seq", "node", F.col("doc_id").alias("own")).join(roots, "node", "left").join(heads, "root", "left")
    named = every.join(placed.select("seq", F.coalesce("head", "own").alias("smallest")), "seq", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    return named.select("doc_id", *["row"] * with_row, "n_shingles", component.alias("component_id"), kept)


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group, that of the smallest id, and the rows without an id; every row is decided by itself."""
    spark = docs.sparkSession
    gone = Scratch(spark).cut(groups(docs, percent, with_row=True).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row")).distinct())
    return docs.join(light(gone), (docs["doc_id"].cast("long") == F.col("gone_id")) & (F.xxhash64(docs["text"]) == F.col("gone_row")), "left_anti")
