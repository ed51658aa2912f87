"""Substring deduplication with repeated-phrase automata.

A window is SPAN consecutive words. Every window owns the anchor that is the smallest hash among
its word ANCHOR-grams, so equal windows have equal anchors, and only a few per cent of the
positions are anchors.

1. Anchors seen in two different texts are recurring; only the windows around them can recur.
2. Hashes of those windows are grouped: a window whose smallest document is smaller than its own
   is a confirmed recurring phrase, and the smallest document is its source. Runs of such windows are
   passages of the source.
3. Documents are dealt to shards by a hash of their id. Each shard gets, once, the passages its documents may hold,
   and compiles them: passages are cut into blocks of half a window, the blocks become an
   Aho-Corasick automaton over words, and all documents of the shard stream through it. A block
   found is extended to both sides word by word, so every match is decided by the words
   themselves; matches of SPAN words or more from a smaller document are removed.

Any window match holds one whole block, so none is lost. Texts of equal words collapse first: of them
only the row of the smallest id is scanned. Rows are told apart by id and text.

Defined cases: null and empty texts have no words; fewer words than SPAN: nothing goes; repeats
within one document, and between rows of one id, stay; repeated rows of an id are answered each, one row for one row, and
several texts of an id each by itself; a row without an id loses nothing and takes nothing from others; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icspark.llm.common import Scratch, mixed, sha256_hex, small_batches, text_bytes, window_hashes, word_hashes

SPAN, ANCHOR = 50, 20
BLOCK = SPAN // 2
#: Bytes of compressed text that a shard of the last step holds, about; its passages are no longer than its texts, but for a window's rest each.
SHARD_BYTES = 1 << 19
#: Another order of a word's hash, so that a window has 96 bits.
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def anchors_of(h: np.ndarray, span: int = SPAN, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(place of the anchor of each window, hashes of all k-grams). The last of equal smallest ones."""
    grams = window_hashes(h, k)
    w = span - k + 1
    n = len(h) - span + 1
    if n <= 0:
        return np.empty(0, np.int64), grams
    view = np.lib.stride_tricks.sliding_window_view(grams, w)[:, ::-1]
    return np.arange(n) + (w - 1 - view.argmin(1)), grams


def runs(sorted_places: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of each stretch of consecutive places."""
    if not len(sorted_places):
        return []
    cut = np.flatnonzero(np.diff(sorted_places) > 1)
    return list(zip(sorted_places[np.r_[0, cut + 1]].tolist(), sorted_places[np.r_[cut, len(sorted_places) - 1]].tolist()))


class Automaton:
    """Passages of a shard, compiled. Words of the passages become single characters."""

    def __init__(self, passages: list[tuple[int, list[bytes]]]):
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        self.passages: list[tuple[int, str]] = []
        blocks: dict[str, list[tuple[int, int]]] = {}
        for doc, words in passages:
            text = "".join(self._letter(w) for w in words)
            at = len(self.passages)
            self.passages.append((doc, text))
            for s in range(0, len(text) - BLOCK + 1, BLOCK):
                blocks.setdefault(text[s : s + BLOCK], []).append((at, s))
        self.machine = ahocorasick.Automaton()
        for block, where in blocks.items():
            self.machine.add_word(block, where)
        if blocks:
            self.machine.make_automaton()
        self.empty = not blocks

    def _letter(self, word: bytes) -> str:
        found = self.letters.get(word)
        if found is None:
            k = len(self.letters) + 1
            found = self.letters[word] = chr(k if k < 0xD800 else k + 0x800)  # no surrogates; 0 is every other word
        return found

    def covered(self, doc: int, words: list[bytes]) -> np.ndarray:
        """True for each word inside a match of SPAN words or more with a passage of a smaller document."""
        edge = np.zeros(len(words) + 1, np.int64)
        if not self.empty:
            text = "".join([self.letters.get(w, "\0") for w in words])
            done: dict[tuple[int, int], int] = {}  # passage and offset: end of the match that was last extended there
            for end, where in self.machine.iter(text):
                for p, s in where:
                    source, held = self.passages[p]
                    if source >= doc:
                        continue
                    a = end - BLOCK + 1
                    if done.get((p, a - s), -1) > a:
                        continue
                    lo, hi = _extend(text, held, a, s)
                    done[p, a - s] = hi
                    if hi - lo >= SPAN:
                        edge[lo] += 1
                        edge[hi] -= 1
        return np.cumsum(edge[:-1]) > 0


def _extend(text: str, held: str, a: int, s: int) -> tuple[int, int]:
    """The maximal equal stretch of text around a where held stands at s; words of no passage are unequal."""
    lo, x = a, s
    while lo and x and text[lo - 1] == held[x - 1]:
        lo, x = lo - 1, x - 1
    hi, y = a + BLOCK, s + BLOCK
    while hi < len(text) and y < len(held) and text[hi] == held[y]:
        hi, y = hi + 1, y + 1
    return lo, hi


def _squeezed(text: bytes) -> bytes:
    return zstandard.compress(text, 1)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; with_text adds the kept words."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [text.split() for text in text_bytes(b.column(2))]
            sha = [hashlib.sha256(b" ".join(words)).digest() for words in split]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(len, split), pa.int64()), pa.array(sha, pa.binary())], ["doc_id", "row", "n_words", "sha"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows, sha, anchors = [], [], [], []
            for doc, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2))):
                words = text.split()
                at, grams = anchors_of(word_hashes(words))
                if len(at):
                    ids.append(doc), rows.append(row), sha.append(hashlib.sha256(b" ".join(words)).digest())
                    anchors.append(np.unique(grams[np.unique(at)]).view(np.int64))
            lists = [pa.array(x, t) for x, t in ((ids, pa.int64()), (rows, pa.int64()), (sha, pa.binary()), (anchors, pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(lists, ["doc_id", "row", "sha", "anchors"])

    # written are tables that several plans read, those that a join by a frequent key meets (it can split only plain shuffles), and what the scan finds; the answer splits the words again
    long_ = thin.where("doc_id is not null").mapInArrow(listed, "doc_id long, row long, sha binary, anchors array<long>")
    # texts of different words, each with the row of its smallest id
    firsts = scratch.cut(long_.groupBy("sha").agg(F.min(F.struct("doc_id", "row")).alias("s"), F.first("anchors").alias("anchors")).select("sha", "s.doc_id", "s.row", "anchors"))
    apart = firsts.select("doc_id", "row", F.explode("anchors").alias("anchor"))
    recurring = scratch.cut(apart.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    wanted = apart.join(recurring, "anchor").groupBy("doc_id", "row").agg(F.collect_set("anchor").alias("wanted"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, hashes, seconds, squeezed = [], [], [], []
            for text, want in zip(text_bytes(b.column(2)), b.column(3).to_pylist()):
                words = text.split()
                h = word_hashes(words)
                at, grams = anchors_of(h)
                ok = np.flatnonzero(np.isin(grams[at], np.array(want, np.int64).view(np.uint64)))
                places.append(ok.astype(np.int32))
                hashes.append(window_hashes(h, SPAN)[ok].view(np.int64))
                seconds.append((window_hashes(mixed(h ^ _SECOND), SPAN)[ok] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                squeezed.append(_squeezed(text))
            lists = [pa.array(x, pa.list_(t)) for x, t in ((places, pa.int32()), (hashes, pa.int64()), (seconds, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(squeezed, pa.binary()), pa.array(map(len, squeezed), pa.int64()), *lists], ["doc_id", "row", "z", "z_bytes", "places", "hashes", "seconds"])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(_squeezed, text_bytes(b.column(2))), pa.binary())], ["doc_id", "row", "z"])

    def loosen(go):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return go(pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([zstandard.decompress(z) if z else b"" for z in b.column(2).to_pylist()], pa.binary()), *b.columns[3:]], b.schema.names) for b in batches)

        return run

    # one compressed shuffle of the texts; equal rows leave one
    involved = thin.mapInArrow(squeeze, "doc_id long, row long, z binary").join(wanted, ["doc_id", "row"]).dropDuplicates(["doc_id", "row"]).select("doc_id", "row", "z", "wanted")
    involved = scratch.cut(involved.mapInArrow(loosen(windows), "doc_id long, row long, z binary, z_bytes long, places array<int>, hashes array<long>, seconds array<int>"))
    # where no id stands first for several texts, ids alone tell texts apart from here on: a constant takes no room
    alone = firsts.groupBy("doc_id").count().where("count > 1").isEmpty()
    if alone:
        involved, firsts = (df.withColumn("row", F.lit(0).cast("long")) for df in (involved, firsts))
    texts = involved.select("doc_id", "row", "z")
    rows = involved.select("doc_id", "row", F.explode(F.arrays_zip("hashes", "seconds", "places")).alias("x")).select(F.col("x.hashes").alias("w"), F.col("x.seconds").alias("w2"), "doc_id", "row", F.col("x.places").alias("place"))
    sources = rows.groupBy("w", "w2").agg(F.min(F.struct("doc_id", "row", "place")).alias("s"), F.max("doc_id").alias("most")).where("s.doc_id < most")
    sources = scratch.cut(sources.select("w", "w2", F.col("s.doc_id").alias("source"), F.col("s.row").alias("source_row"), F.col("s.place").alias("at")))
    matched = scratch.cut(rows.select("w", "w2", "doc_id", "row").join(sources, ["w", "w2"]).where("source < doc_id").select("doc_id", "row", "source", "source_row", "at"))
    receivers = matched.select("doc_id", "row").distinct()
    scanned = texts.join(receivers, ["doc_id", "row"], "left_semi")
    size = involved.select("doc_id", "row", "z_bytes").join(receivers, ["doc_id", "row"], "left_semi").agg(F.sum("z_bytes")).first()[0] or 0
    shard = F.pmod(F.xxhash64("doc_id", "row"), F.lit(1 + size // SHARD_BYTES)).cast("int").alias("shard")
    # each shard and source once, with the places of the source's windows: combined before the shuffle
    sent = matched.select(shard, "source", "source_row", "at").distinct().groupBy("shard", "source", "source_row").agg(F.collect_set("at").alias("ats"))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard_, source, body = [], [], []
            for doc, text, s, ats in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4))):
                words = text.split()
                for lo, hi in runs(np.sort(np.array(ats))):
                    shard_.append(s), source.append(doc), body.append(_squeezed(b" ".join(words[lo : hi + SPAN])))
            yield pa.RecordBatch.from_arrays([pa.array(shard_, pa.int32()), pa.array(source, pa.int64()), pa.array(body, pa.binary())], ["shard", "source", "z"])

    known = sent.withColumnsRenamed({"source": "doc_id", "source_row": "row"}).join(texts, ["doc_id", "row"]).select("doc_id", "row", "z", "shard", "ats")
    phrases = known.mapInArrow(loosen(passages), "shard int, source long, z binary")
    schema = "found_id long, found_row long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        machine = Automaton([(s, zstandard.decompress(z).split()) for s, z in zip(right.source, right.z)])
        out = []
        for doc, row, z in zip(left.doc_id, left.row, left.z):
            words = zstandard.decompress(z).split()
            gone = machine.covered(doc, words)
            kept = b" ".join([w for w, g in zip(words, gone) if not g])
            out.append((doc, row, int(gone.sum()), sha256_hex(kept), *([kept.decode()] if with_text else [])))
        return pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    found = scratch.cut(scanned.select(shard, "doc_id", "row", "z").groupBy("shard").cogroup(phrases.groupBy("shard")).applyInPandas(scan, schema))
    named = thin.mapInArrow(counted, "doc_id long, row long, n_words long, sha binary").join(firsts.select("sha", F.col("doc_id").alias("first"), F.col("row").alias("first_row")), "sha", "left")
    # a row of the first id answers as its first row does, whose words are the same
    out = named.join(found, (F.col("doc_id") == F.col("found_id")) & (F.col("first_row") == F.col("found_row")) & (F.col("doc_id") == F.col("first")), "left")
    copy = F.col("doc_id") > F.col("first")  # null for short texts and rows without an id
    nothing, whole = F.sha2(F.lit(""), 256), F.lower(F.hex("sha"))
    columns = ["doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", whole)).alias("kept_sha256")]
    if not with_text:
        return out.select(*columns)
    plain = F.array_join(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
    own = thin.select(F.col("doc_id").alias("own_id"), F.col("row").alias("own_row"), F.coalesce(plain, F.lit("")).alias("own")).dropDuplicates(["own_id", "own_row"])
    return out.join(own, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("row") == F.col("own_row"))).select(*columns, F.when(copy, F.lit("")).otherwise(F.coalesce("kept", "own")).alias("kept"))
