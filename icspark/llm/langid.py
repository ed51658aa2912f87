"""Language of web pages by Bayesian evidence fusion.

Evidence of a page: the likelihood of its text under character-trigram models trained on
documents of known language, the language its markup declares, the suffix of its address,
and a prior of its host. Priors come from grouped aggregation of the text posteriors: a
host leans on its suffix and a suffix on the whole, each with `STRENGTH` pseudo-pages, and a page's own
text is left out of its host's prior. The declared language counts by how often that declaration
agrees with the texts. All parts add up in log space.

Training counts the trigrams of at most `TRAIN_ROWS` texts a language, of every language, where the texts are; counts alone reach the
driver, MOST_COUNTS at most, as the hashed space narrows when there are many languages. Counting and scoring cover all pages.

Defined cases: null or empty html has no text evidence and leans on the rest; a null or
malformed address has host '' and suffix ''; unknown declarations count as 'other'; repeated
rows, rows of one id and rows without an id count and are answered each; ties go to the alphabetically first language; an empty table
gives no rows; with no training rows lang is null; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from icspark.llm.common import Scratch, small_batches

#: Bound of the training sample: rows a language. Dimensions of the hashed trigram space at most, and times languages.
TRAIN_ROWS, DIMENSIONS, MOST_COUNTS = 400, 1 << 16, 1 << 22
#: Chosen rows that may be broadcast, by their ids.
MOST_CHOSEN = 100_000
STRENGTH, TEXT_WEIGHT, MOST_TRIGRAMS_COUNTED = 5.0, 1.0, 200
_NOT_TEXT = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z]+)", re.I)


def trigrams(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Hashed character trigrams of the lower-cased text, words parted by one space."""
    code = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(code) < 3:
        return np.empty(0, np.int64)
    value = code[:-2] * np.uint64(0x9E3779B1) + code[1:-1] * np.uint64(0x85EBCA77) + code[2:] * np.uint64(0xC2B2AE3D)
    return ((value ^ (value >> np.uint64(17))) % np.uint64(dimensions)).astype(np.int64)


def dimensions_for(languages: int) -> int:
    """DIMENSIONS, or the largest power of two that keeps a model of so many languages within MOST_COUNTS."""
    return min(DIMENSIONS, 1 << max((MOST_COUNTS // max(languages, 1)).bit_length() - 1, 6))


class TextModel:
    """Log probability of each hashed trigram in each language. counts: dimensions by languages."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.dimensions = languages, len(counts)
        counts = counts + 0.05
        self.logs = np.log(counts / counts.sum(0)).astype(np.float32)

    def loglik(self, text: str) -> np.ndarray:
        """Over the whole text; beyond MOST_TRIGRAMS_COUNTED trigrams the mean counts as so many, as neighbours aren't independent."""
        grams = trigrams(text, self.dimensions)
        if not len(grams) or not self.languages:
            return np.zeros(len(self.languages))
        total = self.logs[grams].sum(0, dtype=np.float64)
        return total * min(1.0, MOST_TRIGRAMS_COUNTED / len(grams))


def train(docs: DataFrame, rows_each: int = TRAIN_ROWS) -> TextModel:
    """Count the trigrams of the rows of each language with the smallest hash of their id."""
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.where("lang is not null and text is not null and text <> ''").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    languages = sorted(sizes)
    dimensions = dimensions_for(len(languages))
    if not languages:
        return TextModel([], np.zeros((dimensions, 0)))
    # twice as many as wanted compete, so no task ranks a whole language
    share = spark.createDataFrame([(x, min(1.0, 2.0 * rows_each / n) if n > 8 * rows_each else 1.0) for x, n in sizes.items()], "lang string, share double")
    ids = known.select("doc_id", "lang").distinct().withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52))).join(F.broadcast(share), "lang").where(F.col("h") < F.col("share") * (1 << 52))
    chosen = ids.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("place") <= rows_each)
    few = len(languages) * rows_each <= MOST_CHOSEN
    chosen = chosen.select(F.col("doc_id").alias("chosen_id"), F.col("lang").alias("chosen_lang"))
    rows = known.join(F.broadcast(chosen) if few else chosen, F.col("doc_id").eqNullSafe(F.col("chosen_id")) & (F.col("lang") == F.col("chosen_lang"))).select("lang", "text")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}  # no more than a model
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if lang not in held:
                    held[lang] = np.zeros(dimensions, np.int64)
                held[lang] += np.bincount(trigrams(text, dimensions), minlength=dimensions)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "at", "n"])

    sums = rows.mapInArrow(go, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((dimensions, len(languages)))
    place = {x: k for k, x in enumerate(languages)}
    counts[sums.column("at").to_numpy(), np.array([place[x] for x in sums.column("lang").to_pylist()], np.int64)] = sums.column("n").to_numpy()
    return TextModel(languages, counts)


def page_text(html: str) -> str:
    return unescape(_NOT_TEXT.sub(" ", html))


def _logged(p):
    return F.transform(p, lambda x: F.log(F.greatest(x, F.lit(1e-12))))


def _softmax(x):
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def _added(*arrays):
    out = arrays[0]
    for a in arrays[1:]:
        out = F.zip_with(out, a, lambda x, y: x + y)
    return out


def identify(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, host, suffix, declared, text_lang, lang, probability of every page."""
    spark = pages.sparkSession
    small_batches(spark)
    n = len(model.languages)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    thin = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    if not n:
        return thin.select("page_id", "url", "host", F.regexp_extract("host", r"\.([^.]+)$", 1).alias("suffix"), F.lit("other").alias("declared"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    shared = spark.sparkContext.broadcast(model)  # bounded: MOST_COUNTS numbers

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = set(model.languages)
        for b in batches:
            declared, logs = [], []
            for html in b.column(3).to_pylist():
                html = html or ""
                m = _DECLARED.search(html)
                tag = m[1].lower() if m else "none"
                declared.append(tag if tag in known or tag == "none" else "other")
                logs.append(model.loglik(page_text(html)).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(declared), pa.array(logs, pa.list_(pa.float64()))], ["page_id", "url", "host", "declared", "loglik"])

    seen = thin.mapInArrow(go, "page_id long, url string, host string, declared string, loglik array<double>")
    seen = seen.withColumn("suffix", F.regexp_extract("host", r"\.([^.]+)$", 1)).withColumn("own", F.when(F.array_max("loglik") == F.array_min("loglik"), F.array_repeat(F.lit(0.0), n)).otherwise(_softmax(F.col("loglik"))))
    seen = Scratch(spark).cut(seen)
    sums = [F.sum(F.col("own")[k]).alias(f"s{k}") for k in range(n)]
    packed = F.array(*[F.col(f"s{k}") for k in range(n)])
    # one row a language and two more
    said = {r["declared"]: np.array(r["s"]) for r in seen.groupBy("declared").agg(*sums).select("declared", packed.alias("s")).collect()}
    whole = sum(said.values(), np.zeros(n)) + 1
    world = whole / whole.sum()
    says = spark.createDataFrame([(tag, [float(v) for v in np.log((s + 1 / len(said)) / whole)]) for tag, s in sorted(said.items())], "declared string, says array<double>")
    base = F.array(*[F.lit(float(v)) for v in world])

    def smoothed(sums_, prior):
        total = F.aggregate(sums_, F.lit(0.0), lambda a, v: a + v)
        return F.transform(F.zip_with(sums_, prior, lambda s, p: s + STRENGTH * p), lambda v: v / (total + STRENGTH))

    hosts = seen.groupBy("suffix", "host").agg(*sums).select("suffix", "host", packed.alias("host_sum"))
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(F.col("host_sum")[k]).alias(f"s{k}") for k in range(n)]).select("suffix", smoothed(packed, base).alias("suffix_p"))
    priors = Scratch(spark).cut(hosts.join(suffixes, "suffix").select("host", "host_sum", "suffix_p"))
    fused = seen.join(F.broadcast(says), "declared", "left").join(priors, "host", "left").withColumn("rest", F.zip_with("host_sum", "own", lambda s, o: F.greatest(s - o, F.lit(0.0))))
    even = F.array_repeat(F.lit(0.0), n)
    log_post = _added(F.transform("loglik", lambda v: v * TEXT_WEIGHT), _logged(smoothed(F.col("rest"), F.col("suffix_p"))), F.coalesce("says", even))
    names = F.array(*[F.lit(x) for x in model.languages])
    best = lambda x: names[(F.array_position(x, F.array_max(x)) - 1).cast("int")]
    out = fused.withColumn("post", _softmax(log_post))
    return out.select("page_id", "url", "host", "suffix", "declared", best(F.col("own")).alias("text_lang"), best(F.col("post")).alias("lang"), F.round(F.array_max("post"), 9).alias("probability"))
