"""Shared plumbing: table access, written cut points, distributed components, word hashing."""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icspark.sources.staging import ranked, shared_folder

#: Rows per Arrow batch for text; keeps a Python worker's memory small when texts are long.
TEXT_BATCH_ROWS = 500
#: Distinct words that a Python worker remembers before it starts afresh.
CACHE_WORDS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table `name` of the folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Text operators hand rows to Python in small Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


class Scratch:
    """Written tables that cut lineage. A lost executor costs only the stage that was running."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_folder(spark)}/icspark-{uuid.uuid4().hex}"
        self.made: dict[int, str] = {}
        self.count = 0
        atexit.register(self.clear)

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.count}"
        self.count += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made[id(out)] = path
        out._icspark_path = path  # keeps the pairing when ids are reused
        return out

    def watched(self, df: DataFrame, *sums) -> tuple[DataFrame, tuple]:
        """df written, and aggregates of what was written."""
        out = self.cut(df)
        return out, tuple(out.agg(*sums).first())

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for df in frames:
            if path := getattr(df, "_icspark_path", None):
                self._delete(path)

    def clear(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


#: Edges that one union-find inside a task holds.
FOREST_EDGES = 500_000


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) as stars (u, v) of the same components, by union-find over FOREST_EDGES at a time."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while x != root:
            up[x], x = root, up[x]
        return root

    def stars() -> pa.RecordBatch:
        rows = [(x, top(x)) for x in up]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["u", "v"])

    for t in batches:
        for a, b in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
            x, y = top(a), top(b)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > FOREST_EDGES:
            yield stars()
    if up:
        yield stars()


#: Bytes of a table that may be broadcast, counted as ROW_BYTES a row and ITEM_BYTES an entry of its lists.
BROADCAST_BYTES, ROW_BYTES, ITEM_BYTES = 32 << 20, 48, 16


def light(df: DataFrame, lists: str | None = None) -> DataFrame:
    """df, written before, marked for a broadcast if its counted size allows it: rows of some numbers, and a column of short lists."""
    rows, items = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(lists)), F.lit(0)) if lists else F.lit(0)).first()
    return F.broadcast(df) if rows * ROW_BYTES + items * ITEM_BYTES <= BROADCAST_BYTES else df


def components(scratch: Scratch, edges: DataFrame, most_rounds: int = 40, together: int = 0) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: columns a, b (long). Returns (id, root) for every node that is not its own root;
    root is the smallest id reachable. Edges become stars inside each task first. Each round is two grouped minima and two joins, all
    shuffled by key; joins are left to adaptive skew splitting, minima combine before the
    shuffle. Nothing is gathered on the driver but two sums a round that show a fixed point.
    together: edges, written before, that are counted to be no more are joined in one task without rounds, which take seconds each whatever the edges.
    """
    if together and edges.count() <= min(together, FOREST_EDGES):
        stars = edges.select("a", "b").where("a <> b").coalesce(1).mapInArrow(_forests, "u long, v long")
        return stars.select(F.col("u").alias("id"), F.col("v").alias("root"))
    mark = F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    now, seen = scratch.watched(edges.select("a", "b").where("a <> b").mapInArrow(_forests, "u long, v long").distinct(), *mark)
    rounds = 0
    while seen[0]:
        if rounds == most_rounds:  # they grow with the logarithm of the nodes
            raise RuntimeError(f"no fixed point of the components after {most_rounds} rounds")
        rounds += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        then, after = scratch.watched(moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), *mark)
        scratch.drop(now, large)
        now, seen, before = then, after, seen
        if seen == before:
            break
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")


def numbered(scratch: Scratch, rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows (id_col, row, ...) with a distinct long `node` that stands in the order of (id, row): the id itself unless an id has several rows."""
    if rows.groupBy(id_col).count().where("count > 1").isEmpty():
        return rows.withColumn("node", F.col(id_col))
    return scratch.cut(ranked(rows, [id_col, "row"], "node")[0])


class WordHash(dict):
    """Word (bytes) to a 64-bit hash, computed once per worker and word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(Held.get("word hashes", WordHash).__getitem__, words), np.uint64, len(words))


_B = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(_B), k, 1 << 64))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values, by doubling: log2(k) vector steps."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    span, block, done, out = 1, h, 0, None
    rest = k
    while True:
        if rest & 1:
            part = block[done : done + n]
            out = part.copy() if out is None else out * _power(span) + part
            done += span
        rest >>= 1
        if not rest:
            return mixed(out)
        block = block[: len(block) - span] * _power(span) + block[span:]
        span *= 2


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def text_bytes(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; null gives b''."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Held:
    """One cache a worker: making one for another purpose frees the last, so an executor's memory stays bounded."""

    key, value = None, None

    @classmethod
    def get(cls, key, make):
        if cls.key != key:
            cls.free()
            cls.key, cls.value = key, make()
        return cls.value

    @classmethod
    def free(cls) -> None:
        """Drop the cache, for operators that hold none of their own."""
        if cls.key is not None:
            cls.key, cls.value = None, None
            give_back()


def give_back() -> None:
    """Return freed memory to the system, where the allocators can."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it while df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
