"""Named, versioned tables and the files that queries come from."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The strings that CSV readers of data-science tools take for missing.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: What a cell of each type looks like; the first type that all cells of a column fit is the column's.
_LOOKS = {"boolean": r"(?i)^(true|false)$", "bigint": r"^[+-]?[0-9]{1,18}$", "double": r"(?i)^[+-]?([0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|inf|infinity)$"}


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A CSV file or folder with a header. Missing-value strings are null; a column is boolean, whole, decimal or text, whichever fits all its other cells.

    Types come from one pass over the whole text. Dates stay text, and compare as such. Quotes inside quotes are doubled;
    quoted line breaks need multi_line, which reads a file in one task.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multi_line)
    cells = {c: F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`")) for c in raw.columns}
    names = list(cells)
    tests = [F.coalesce(F.every(F.trim(cells[c]).rlike(look)), F.lit(t == "double")).alias(f"t{k}_{t}") for k, c in enumerate(names) for t, look in _LOOKS.items()]
    fits = raw.agg(*tests).first() if names else {}
    out = []
    for k, c in enumerate(names):
        kind = next((t for t in _LOOKS if fits[f"t{k}_{t}"]), "string")
        # any spelling of infinity
        value = F.regexp_replace(F.trim(cells[c]), r"(?i)inf(inity)?$", "Infinity") if kind == "double" else cells[c] if kind == "string" else F.trim(cells[c])
        out.append(value.cast(kind).alias(c))
    return raw.select(*out)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet or CSV table by its suffix."""
    return read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """CSV (with header, as `read_csv` reads it) or Parquet by the suffix; list columns reach CSV as JSON text."""
    if path.endswith(".csv"):
        flat = [F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f"`{f.name}`") for f in df.schema.fields]
        df.select(*flat).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
    else:
        df.write.mode("overwrite").parquet(path)


@dataclass
class Catalog:
    """name to path; a version is a sibling: `adult.csv` has `adult.train.csv`. Frames may be registered directly.

    keys names the columns that tell a table's rows apart: results that list rows of groups carry them.
    """

    spark: SparkSession
    paths: dict[str, str] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)
    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str, names: list[str], suffix: str = ".parquet") -> "Catalog":
        return cls(spark, {n: f"{folder}/{n}{suffix}" for n in names})

    def path(self, name: str, version: str | None = None) -> str | None:
        """The table's path, or None if the name is unknown."""
        if name not in self.paths:
            return None
        stem, dot, suffix = self.paths[name].rpartition(".")
        return f"{stem}.{version}{dot}{suffix}" if version else self.paths[name]

    def load(self, name: str, version: str | None = None) -> DataFrame:
        key = f"{name}.{version}" if version else name
        if key in self.frames:
            return self.frames[key]
        if (path := self.path(name, version)) is None:
            raise ValueError(f"unknown dataset {name!r}")
        try:
            return read_table(self.spark, path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise ValueError(f"dataset {key!r} has no file {path}") from e
            raise

    def split(self, name: str, part: str = "all"):
        """The train or test version; (train, test) for all."""
        if part == "all":
            return self.load(name, "train"), self.load(name, "test")
        if part not in ("train", "test"):
            raise ValueError(f"unknown split {part!r}")
        return self.load(name, part)


def query_texts(path: str, noise: str | None = None) -> dict[str, str]:
    """Query text by file name: one .sql file or a sorted folder of them. `noisy` becomes `noisy_level_<noise>`, or `gt`."""
    at = Path(path)
    files = sorted(at.glob("*.sql")) if at.is_dir() else [at]
    texts = {f.name: f.read_text() for f in files}
    if noise:
        texts = {k: t.replace("noisy", "gt" if noise == "gt" else f"noisy_level_{noise}") for k, t in texts.items()}
    return texts


def markdown(df: DataFrame, rows: int = 100) -> str:
    """The first rows as a Markdown table."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    line = lambda cells: "| " + " | ".join(map(cell, cells)) + " |"
    return "\n".join([line(df.columns), "|" + "---|" * len(df.columns), *[line(r) for r in df.limit(rows).collect()]])
