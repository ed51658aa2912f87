"""Splits and noise, deterministic by hashes of a row key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icspark.operators.models import MOST_BROADCAST, Model
from icspark.operators.program import Program, with_expected
from icspark.sources.staging import ranked


def draw(key: list[str], seed: int):
    """A number from 0 to 2^52 - 1 from the MD5 of the key's values and the seed, parted by `|`: the same in any engine."""
    text = F.concat_ws("|", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in key], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _uniform(key: list[str], seed: int):
    return draw(key, seed) / (1 << 52)


def split(df: DataFrame, key: list[str], test: float = 0.15, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key: the same rows at any partitioning."""
    u = _uniform(key, seed)
    return df.where(u >= test), df.where(u < test)


def controllable(df: DataFrame, program: Program, name: str = "controllable") -> DataFrame:
    """df with the dependents whose statement fires on the row."""
    wide, names = with_expected(df, program)
    cells = [F.when(F.col(e).isNotNull(), F.lit(s.dependent)) for s, e in zip(program.statements, names)]
    return wide.withColumn(name, F.array_distinct(F.array_compact(F.array(*cells).cast("array<string>")))).drop(*names)


def inject(df: DataFrame, program: Program, key: list[str], level: float, label: str | None = None, seed: int = 42) -> DataFrame:
    """One controllable cell of about `level` of the rows is replaced by another value of its column, or by null or 0.

    Adds `controllable` and `injected`. The label is never injected. Rows drawn without a controllable cell stay as
    they are, so the realised rate may be below the level.
    """
    marked = controllable(df, program)
    n = F.size("controllable")
    pick = F.when((_uniform(key, seed) < level) & (n > 0), F.element_at("controllable", (1 + draw(key, seed + 1) % F.greatest(n, F.lit(1))).cast("int")))
    marked = marked.withColumn("_cell", pick)
    targets = sorted({s.dependent for s in program.statements} - {label})
    for c in targets:
        kind, col = df.schema[c].dataType, F.col(f"`{c}`")
        values, count = ranked(df.where(col.isNotNull()).select(c).distinct(), [c])
        due = F.col("_cell") == c
        if count > 1:
            # slot k holds value k and the next one, which is taken where value k is the cell's own
            side = values.select("_i", F.col(f"`{c}`").alias("_one"))
            after = values.select(F.pmod(F.col("_i") - 1, F.lit(count)).alias("_i"), F.col(f"`{c}`").alias("_two"))
            side = side.join(after, "_i")
            side = F.broadcast(side) if count <= MOST_BROADCAST else side
            slot = F.when(due, draw(key, seed + 2) % count)
            marked = marked.withColumn("_i", slot).join(side, "_i", "left")
            other = F.when(F.col("_one").eqNullSafe(col), F.col("_two")).otherwise(F.col("_one"))
        else:
            other = (F.lit(None) if kind.simpleString() == "string" else F.lit(0)).cast(kind)
        marked = marked.withColumn(c, F.when(due, other).otherwise(col)).drop("_i", "_one", "_two")
    return marked.withColumn("injected", F.coalesce(F.col("_cell").isin(*targets), F.lit(False))).drop("_cell")


def correct_rows(df: DataFrame, model: Model, label: str) -> DataFrame:
    """Rows whose prediction equals the label; null equals nothing."""
    return model.apply(df, "_predicted").where(F.col("_predicted") == F.col(f"`{label}`")).drop("_predicted")


def ground_truth(df: DataFrame, program: Program, model: Model, label: str) -> DataFrame:
    """Correctly predicted rows with their controllable columns, unharmed: the clean side of an injected table."""
    return controllable(correct_rows(df, model, label), program)
