"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Documents stream past the set once, with no shuffle. A hash hit is verified on the words
themselves. A benchmark beyond `BLOCK_BYTES` is split into blocks of bounded size by a hash
of the item id; each block is broadcast in turn, scans the original text of every row, and adds its hits to the row's.

Defined cases: a null or empty text has no words and no hits; an item of fewer words than
the window is one window, one of none is ignored; repeated items all count; repeated rows of a document
and rows without an id are judged each by itself; an item without an id hits, but isn't counted or named; an empty benchmark hits nothing; an
empty table gives no rows; columns beyond id and text are carried by `remove` only.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icspark.llm.common import Scratch, free_name, sha256_hex, small_batches, text_bytes, window_hashes, word_hashes

WINDOW = 10
#: Bytes of benchmark text that one broadcast may hold.
BLOCK_BYTES = 32 << 20
_KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(_KEEP).split()


class NgramSet:
    """Windows of benchmark items by length and hash, with their words for verification."""

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        self.by_length: dict[int, dict[int, list[tuple[tuple[bytes, ...], set[int]]]]] = {}
        for item, text in items:
            words, named = words_of(text), () if item is None else (item,)
            n = min(window, len(words))
            if not n:
                continue
            at = self.by_length.setdefault(n, {})
            for k, value in enumerate(window_hashes(word_hashes(words), n).tolist()):
                gram = tuple(words[k : k + n])
                for held, ids in at.setdefault(value, []):
                    if held == gram:
                        ids.update(named)
                        break
                else:
                    at[value].append((gram, set(named)))
        self.sorted = {n: np.sort(np.fromiter(at, np.uint64, len(at))) for n, at in self.by_length.items()}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Verified spans of hit words and the items that they come from."""
        spans, items = [], set()
        h = word_hashes(words)
        for n, keys in self.sorted.items():
            values = window_hashes(h, n)
            if not len(values):
                continue
            place = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
            for k in np.flatnonzero(keys[place] == values).tolist():
                gram = tuple(words[k : k + n])
                for held, ids in self.by_length[n][int(values[k])]:
                    if held == gram:
                        items |= ids
                        spans.append((k, k + n))
        return spans, items


def hit_mask(n: int, spans) -> np.ndarray:
    """True for each of n words that a span covers."""
    edge = np.zeros(n + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    return np.cumsum(edge[:-1]) > 0


def _blocks(benchmark: DataFrame, item_id: str, item_text: str) -> list[DataFrame]:
    size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    n = 1 + size // BLOCK_BYTES
    return [benchmark] if n == 1 else [benchmark.where(F.pmod(F.xxhash64(item_id), F.lit(n)) == k) for k in range(n)]


def _set_of(block: DataFrame, item_id: str, item_text: str, window: int):
    # bounded: a block holds about BLOCK_BYTES of text
    rows = block.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long"), F.col(item_text)).collect()
    return block.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r[0], r[1].encode()) for r in rows]))


_built: dict[tuple, NgramSet] = {}


def _ngrams(shared, window: int) -> NgramSet:
    """The broadcast's set, built once a worker."""
    name, items = shared.value
    if (name, window) not in _built:
        _built.clear()
        _built[name, window] = NgramSet(items, window)
    return _built[name, window]


def _scanned(docs: DataFrame, at: int, blocks: list[DataFrame], item_id: str, item_text: str, window: int, finish: Callable, schema) -> DataFrame:
    """finish(columns of docs, n_words, spans, items, scan) on every batch, with each row's hits of all blocks on the text in column `at`; scan finds those of the last block.

    Rows carry their hits from block to block; between blocks they are written, so a task holds one block's set at a time.
    """
    spark, width = docs.sparkSession, len(docs.columns)
    scratch, out = Scratch(spark), docs
    carried = T.StructType(docs.schema.fields + [T.StructField(free_name(docs, n), T.ArrayType(t)) for n, t in (("spans", T.IntegerType()), ("items", T.LongType()))])
    for turn, block in enumerate(blocks):
        shared, last = _set_of(block, item_id, item_text, window), turn == len(blocks) - 1

        def go(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn, last=last) -> Iterator[pa.RecordBatch]:
            grams = _ngrams(shared, window)
            for b in batches:
                n_words, spans, items = [], [], []
                before = zip(b.column(width).to_pylist(), b.column(width + 1).to_pylist()) if turn else iter([([], [])] * b.num_rows)
                for text, (s0, i0) in zip(text_bytes(b.column(at)), before):
                    words = words_of(text)
                    s, i = grams.scan(words)
                    n_words.append(len(words))
                    spans.append(s0 + [x for p in s for x in p])
                    items.append(sorted(i.union(i0)))
                if last:
                    yield finish(b.columns[:width], n_words, spans, items, grams.scan)
                else:
                    yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))], names=carried.names)

        if last:
            return out.mapInArrow(go, schema)
        old, out = out, scratch.cut(out.mapInArrow(go, carried))
        shared.unpersist()
        if turn:
            scratch.drop(old)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of docs: id, n_words, spans (flat array of start, end word), items (array of item ids)."""
    small_batches(docs.sparkSession)
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def finish(columns, n_words, spans, items, scan) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[0], pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))], ["doc_id", "n_words", "spans", "items"])

    return _scanned(thin, 1, _blocks(benchmark, item_id, item_text), item_id, item_text, window, finish, "doc_id long, n_words long, spans array<int>, items array<long>")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Digest of the hits per document: counts, hit items and whether any word was hit."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, spans, items = (b.column(k).to_pylist() for k in (1, 2, 3))
            n_hit = [int(hit_mask(n, zip(s[::2], s[1::2])).sum()) if s else 0 for n, s in zip(n_words, spans)]
            named = [sorted(map(str, i)) for i in items]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in named], pa.int64()), pa.array([sha256_hex(",".join(i).encode()) for i in named]), pa.array([n > 0 for n in n_hit])], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return hits(docs, benchmark, window).mapInArrow(go, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def without_spans(text: str, spans: list[int]) -> str:
    """The text with the hit words cut out; what stands between kept words stays, cut places become one space."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw)]
    hit = hit_mask(len(places), zip(spans[::2], spans[1::2]))
    out, at, k = [], 0, 0
    while k < len(places):
        if not hit[k]:
            k += 1
            continue
        j = k
        while j + 1 < len(places) and hit[j + 1]:
            j += 1
        out.append(raw[at : places[k][0]].rstrip())
        at, k = places[j][1], j + 1
    return b" ".join(x for x in [*out, raw[at:].lstrip() if out else raw] if x).decode()


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, document_share: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without benchmark passages: hit spans are cut; a document goes if hits make up `document_share` of its words.

    Columns of docs are kept as they are. The share is that of all blocks together on the original text. Where a cut joins words to
    a new hit, it is cut as well, until none is left: inside the task with one block, by further passes with several.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = docs.columns
    at = names.index(text_col)
    blocks = _blocks(benchmark, "item_id", "text")
    alone = len(blocks) == 1

    def cutting(share: float):
        def finish(columns, n_words, spans, items, scan) -> pa.RecordBatch:
            texts, keep = [], []
            for text, n, flat in zip(columns[at].to_pylist(), n_words, spans):
                keep.append(not flat or hit_mask(n, zip(flat[::2], flat[1::2])).mean() < share)
                while flat and keep[-1]:
                    text = without_spans(text, flat)
                    flat = [x for p in scan(words_of(text.encode()))[0] for x in p] if alone else []
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(columns)]
            return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

        return finish

    out = _scanned(docs, at, blocks, "item_id", "text", window, cutting(document_share), docs.schema)
    if alone:
        return out
    scratch = Scratch(spark)
    while True:
        out = scratch.cut(out)
        if hits(out, benchmark, window, id_col, text_col).where(F.size("spans") > 0).isEmpty():
            return out
        out = _scanned(out, at, blocks, "item_id", "text", window, cutting(2.0), docs.schema)  # no document goes for what is left of it
