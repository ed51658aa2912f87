"""Packing by vector bin packing: pieces are placed under simultaneous limits.

Each example is a vector (tokens, one segment, loss-bearing tokens) and each open sequence
has a rest of the same three limits. The dot-product heuristic puts the piece whose vector
has the largest inner product with the weighted rest into the sequence being filled.
Documents longer than a sequence are cut into full ones first; what no piece fills is
filled by cutting the next piece, and the last sequence of a task is cut into sequences
whose lengths are powers of two, which need no padding.

Packing is local to a task: no shuffle, and at most `POOL` pieces are open at a time. The
sequence id holds the task's partition in its high bits, so a rerun task gives the same ids.

Ids are those of the tokenizer file as it is: special tokens written out in a text are that token's id.

Defined cases: null text is empty and gives only the end id; repeated rows, rows of one id and rows without an id are packed
each; ties go to the earlier piece; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icspark.llm.common import Held, small_batches

MAX_TOKENS, MAX_SEGMENTS, END_ID = 2048, 256, 1
#: Pieces that a task keeps open for the heuristic.
POOL = 256
#: Words that a worker knows the ids of, in each of two generations.
KNOWN_WORDS = 400_000
_CONTROLS = "\x1c\x1d\x1e\x1f"
_PARTS = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class Recent(dict):
    """Values made on demand, in two generations of bounded size: what was used lately outlives the rest."""

    def __init__(self, make, most: int = KNOWN_WORDS):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


def packed(ids: list[int]) -> bytes:
    """Unsigned little-endian 32-bit ids."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordTokens:
    """Token ids (little-endian unsigned 32-bit, as bytes) of white-space separated words.

    The vocabulary drops white space, so words never join, and it parts a word into letters, single
    digits and other characters before it merges. Words of Latin letters take that way directly, each
    part once; all others go through the whole coder, as do texts that hold a special token's string.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.coder = Tokenizer.from_file(path)
        self.special = [t.content for t in self.coder.get_added_tokens_decoder().values()]
        self.merge = self.coder.model.tokenize
        # the byte alphabet, asked of the library: ASCII and two-byte characters show every byte that Latin text has
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {}
        for c in map(chr, [*range(128), *range(0xA1, 0x250)]):
            for raw, shown in zip(c.encode(), level.pre_tokenize_str(c)[0][0]):
                self.letters[raw] = shown
        self.words, self.parts = Recent(self.word), Recent(self.part)

    def whole(self, text: str) -> list[int]:
        return self.coder.encode(text, add_special_tokens=False).ids

    def part(self, part: str) -> bytes:
        shown = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
        return packed([t.id for t in self.merge(shown)])

    def word(self, word: str) -> bytes:
        if not word.isascii() and (max(word) > "\u024f" or not unicodedata.is_normalized("NFC", word)) or "'" in word:
            return packed(self.whole(word))
        low = word.lower()
        if low.isalpha():
            return self.parts[low]
        if not low.isascii() and max(low) > "\u024f":
            return packed(self.whole(word))
        if low[:-1].isalpha() and not low[-1].isalnum():  # most often a word and a sign
            return self.parts[low[:-1]] + self.parts[low[-1]]
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(low)))

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out = []
        for k, t in enumerate(texts):
            if not k % 100:
                self.words.turn()
                self.parts.turn()
            # Python's split takes the controls for white space, the vocabulary doesn't
            if any(c in t for c in _CONTROLS) or any(x in t for x in self.special):
                out.append(np.array(self.whole(t), "<u4"))
            else:
                out.append(np.frombuffer(b"".join(map(self.words.__getitem__, t.split())), "<u4"))
        return out


def coder_of(path: str | None) -> WordTokens:
    """One coder a worker and vocabulary; its words stay known from task to task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Held.get(("packing", path), lambda: WordTokens(path))


@dataclass
class Piece:
    doc: int
    start: int
    ids: np.ndarray
    total: int
    loss: int  # loss-bearing tokens among ids


@dataclass(frozen=True)
class Limits:
    tokens: int = MAX_TOKENS
    segments: int = MAX_SEGMENTS
    loss: int = MAX_TOKENS


class Packer:
    """Fills one sequence at a time from a bounded pool of pieces."""

    def __init__(self, limits: Limits, first_id: int, pool: int = POOL):
        self.limits, self.next_id, self.pool = limits, first_id, pool
        self.open: list[Piece] = []
    def add(self, piece: Piece) -> Iterator[tuple[Piece, int, int]]:
        full = min(self.limits.tokens, self.limits.loss)
        while len(piece.ids) >= full:  # whole sequences need no search
            head, piece = self.cut(piece, full)
            yield head, self.next_id, 0
            self.next_id += 1
            if not len(piece.ids):
                return
        self.open.append(piece)
        if len(self.open) >= self.pool:
            yield from self.fill(self.pool // 2)

    def cut(self, piece: Piece, n: int) -> tuple[Piece, Piece]:
        loss = min(piece.loss, n)
        return Piece(piece.doc, piece.start, piece.ids[:n], piece.total, loss), Piece(piece.doc, piece.start + n, piece.ids[n:], piece.total, piece.loss - loss)

    def fill(self, until: int) -> Iterator[tuple[Piece, int, int]]:
        """Complete sequences until only `until` pieces stay open; the last may be short when until is 0."""
        cap = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        while len(self.open) > until:
            vec = np.array([(len(p.ids), 1, p.loss) for p in self.open], float) / cap
            # demand weights: a scarce resource counts for more
            weight = vec.sum(0) / max(vec.sum(), 1e-12)
            rest, alive, taken = np.ones(3), np.ones(len(self.open), bool), []
            while True:
                fits = alive & (vec <= rest + 1e-12).all(1)
                if not fits.any():
                    break
                k = int(np.where(fits, vec @ (weight * rest), -1).argmax())
                taken.append(k)
                alive[k] = False
                rest = rest - vec[k]
            placed = [self.open[k] for k in taken]
            self.open = [p for p, a in zip(self.open, alive) if a]
            gap = min(self.limits.tokens - sum(len(p.ids) for p in placed), self.limits.loss - sum(p.loss for p in placed))
            if gap > 0 and self.open and len(placed) < self.limits.segments:
                k = max(range(len(self.open)), key=lambda j: len(self.open[j].ids))
                head, tail = self.cut(self.open[k], gap)
                placed.append(head)
                self.open[k] = tail
            yield from self.close(placed, last=not self.open)

    def close(self, placed: list[Piece], last: bool) -> Iterator[tuple[Piece, int, int]]:
        total = sum(len(p.ids) for p in placed)
        room = self.limits.tokens
        if last and total < room:  # powers of two need no padding
            room = 1 << (total.bit_length() - 1)
        at, queue = 0, placed[::-1]
        while queue:
            p = queue.pop()
            if at + len(p.ids) > room:
                head, tail = self.cut(p, room - at)
                queue.append(tail)
                p = head
            if len(p.ids):
                yield p, self.next_id, at
                at += len(p.ids)
            if at == room and queue:
                self.next_id += 1
                left, at = sum(len(x.ids) for x in queue), 0
                room = min(room, 1 << (left.bit_length() - 1)) if left else room
        self.next_id += 1


def pack(docs: DataFrame, tokenizer_path: str | None = None, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, no_loss_prefix: str | None = None) -> DataFrame:
    """Sequences of at most limits.tokens ids. One row per piece; with_ids adds the ids themselves.

    no_loss_prefix: a column with the number of leading tokens that bear no loss; without it all do.
    """
    small_batches(docs.sparkSession)
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.coalesce(F.col(no_loss_prefix).cast("long"), F.lit(0)) if no_loss_prefix else F.lit(0).cast("long")).alias("skip"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(tokenizer_path)
        packer = Packer(limits, TaskContext.get().partitionId() << 36)
        end = np.array([END_ID], "<u4")

        def rows(found) -> pa.RecordBatch:
            columns = [[p.doc for p, _, _ in found], [p.start for p, _, _ in found], [len(p.ids) for p, _, _ in found], [zlib.crc32(p.ids.tobytes()) for p, _, _ in found], [p.total for p, _, _ in found], [s for _, s, _ in found], [o for _, _, o in found]]
            arrays = [pa.array(c, pa.int64()) for c in columns]
            if with_ids:
                arrays.append(pa.array([p.ids.tolist() for p, _, _ in found], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            found = []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc, ids, skip in zip(b.column(0).to_pylist(), coder.batch(texts), b.column(2).to_pylist()):
                ids = np.concatenate([ids, end])
                found += packer.add(Piece(doc, 0, ids, len(ids), max(0, len(ids) - skip)))
            if found:
                yield rows(found)
        if found := list(packer.fill(0)):
            yield rows(found)

    return thin.mapInArrow(go, schema)
