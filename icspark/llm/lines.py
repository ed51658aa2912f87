"""Line deduplication by content-defined line chunks.

A rolling hash over the hashes of the last `REACH` lines ends a chunk where it is 0 modulo
`MEAN_LINES`, so boundaries follow the content and survive shifts. A chunk of several lines
that stands elsewhere, in any document, is kept once, where (id, row, place) is smallest. Hashes of all
chunks propose, the chunks' bytes decide. Texts meet what was found about them by a broadcast while that is small by count, else by a shuffle.

Defined cases: null text stays null and has no lines; an empty text is one empty line; lines
are parted by \\n and compared byte for byte; single-line chunks stay; a text whose lines all
go becomes ''; repeated rows count as documents of their own, the first keeps its chunks; rows are told apart by
id and text, so equal rows share one decision; other columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icspark.llm.common import Held, Scratch, free_name, light, sha256_hex, small_batches

REACH, MEAN_LINES = 3, 4
_FACTORS = (1, 31, 961)


def line_hash(line: bytes) -> int:
    """The first 28 bits of the line's MD5."""
    return int(hashlib.md5(line).hexdigest()[:7], 16)


def chunk_ends(lines: list[bytes]) -> list[int]:
    """The line after the last of each chunk."""
    last: list[int] = []
    ends = []
    for k, line in enumerate(lines):
        last = [line_hash(line), *last[: REACH - 1]]
        if sum(f * h for f, h in zip(_FACTORS, last)) % MEAN_LINES == 0 or k == len(lines) - 1:
            ends.append(k + 1)
    return ends


def chunks_of(text: bytes) -> list[tuple[int, int, bytes]]:
    """(first line, lines, bytes) of each chunk of several lines."""
    lines = text.split(b"\n")
    out, at = [], 0
    for end in chunk_ends(lines):
        if end - at > 1:
            out.append((at, end - at, b"\n".join(lines[at:end])))
        at = end
    return out


def _hash64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, row, first_line, n_lines, h of every chunk of (doc_id, row, text)."""
    Held.free()
    for b in batches:
        ids, rows, at, n, h = [], [], [], [], []
        for doc, row, text in zip(*(b.column(k).to_pylist() for k in (0, 1)), b.column(2).cast(pa.binary()).to_pylist()):
            for first, lines, data in chunks_of(text):
                ids.append(doc), rows.append(row), at.append(first), n.append(lines), h.append(_hash64(data))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(h, pa.int64())], ["doc_id", "row", "first_line", "n_lines", "h"])


def repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, first_line, n_lines) of every chunk that goes; row is the hash of the row's text."""
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")

    every = scratch.cut(thin.mapInArrow(_listed, "doc_id long, row long, first_line int, n_lines int, h long"))
    twice = scratch.cut(every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    wanted = scratch.cut(every.join(twice, "h").groupBy("doc_id", "row").agg(F.collect_set("first_line").alias("wanted")))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Held.free()
        for b in batches:
            ids, rows, at, n, body = [], [], [], [], []
            for doc, row, text, want in zip(*(b.column(k).to_pylist() for k in (0, 1)), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist()):
                want = set(want)
                for first, lines, data in chunks_of(text):
                    if first in want:
                        ids.append(doc), rows.append(row), at.append(first), n.append(lines), body.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(body, pa.binary())], ["doc_id", "row", "first_line", "n_lines", "body"])

    # the chunks that may repeat, with their bytes
    full = scratch.cut(thin.join(light(wanted, "wanted"), ["doc_id", "row"]).select("doc_id", "row", "text", "wanted").mapInArrow(bodies, "doc_id long, row long, first_line int, n_lines int, body binary"))
    first = scratch.cut(full.groupBy("body").agg(F.min(F.struct("doc_id", "row", "first_line")).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("body", "keep"))
    return full.join(first, "body").where(F.struct("doc_id", "row", "first_line") > F.col("keep")).select("doc_id", "row", "first_line", "n_lines")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """docs with repeated chunks cut from the text; with counts, also the columns n_lines and n_removed at the end."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    gone = repeats(docs, scratch, id_col, text_col)
    cut, key, row = (free_name(docs, n) for n in ("cut_lines", "cut_id", "cut_row"))
    by_doc = scratch.cut(gone.groupBy("doc_id", "row").agg(F.collect_set(F.struct("first_line", "n_lines")).alias(cut)).withColumnsRenamed({"doc_id": key, "row": row}))
    joined = docs.join(light(by_doc, cut), (F.col(id_col).cast("long") == F.col(key)) & (F.xxhash64(text_col) == F.col(row)), "left").select(*[docs[c] for c in docs.columns], cut)
    names, at = docs.columns, docs.columns.index(text_col)
    from pyspark.sql import types as T

    schema = T.StructType(docs.schema.fields + ([T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())] if counts else []))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Held.free()
        for b in batches:
            texts, n_lines, n_gone = [], [], []
            for text, spans in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist()):
                lines = text.split("\n") if text is not None else []
                drop = {k for s in spans or () for k in range(s["first_line"], s["first_line"] + s["n_lines"])}
                texts.append("\n".join(x for k, x in enumerate(lines) if k not in drop) if drop else text)
                n_lines.append(len(lines))
                n_gone.append(len(drop))
            columns = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(names))]
            if counts:
                columns += [pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return joined.mapInArrow(go, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of what is left of each text."""
    out = dedup(docs.select("doc_id", "text"), counts=True)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest = [None if x is None else sha256_hex(x) for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(digest, pa.string())], ["doc_id", "n_lines", "n_removed", "kept_sha256"])

    return out.mapInArrow(go, "doc_id long, n_lines long, n_removed long, kept_sha256 string")
