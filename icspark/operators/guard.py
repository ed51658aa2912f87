"""Guarded prediction: a program checks rows before and after a model, by policy."""

from __future__ import annotations

import os
import warnings
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icspark.operators.models import Model
from icspark.operators.program import Program, alerts, rectified

MODES = ("ignore", "raise", "coerce", "rectify")


@dataclass(frozen=True)
class Guard:
    """Policy and program. disabled switches checks off, but rectify still mends the features.

    watch counts alerts under ignore and coerce, in a job of its own when the query is planned, and warns of them.
    """

    mode: str = "ignore"
    program: Program | None = None
    disabled: bool = False
    watch: bool = False

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.mode != "ignore" and self.program is None and not (self.disabled and self.mode != "rectify"):
            raise ValueError(f"mode {self.mode!r} needs a program")


@dataclass(frozen=True)
class Settings:
    """How a session guards and analyses, as given or from environment variables ICSPARK_*."""

    mode: str = "ignore"
    disabled: bool = False
    relevance: bool = True
    comparative: bool = False
    records: str | None = None

    @classmethod
    def of_environment(cls, given: Mapping[str, str] | None = None) -> "Settings":
        """ICSPARK_MODE, ICSPARK_DISABLED, ICSPARK_RELEVANCE, ICSPARK_COMPARATIVE (true or false) and ICSPARK_RECORDS (a file)."""
        given = os.environ if given is None else given
        flag = lambda name, default: given.get(f"ICSPARK_{name}", str(default)).strip().lower() in ("1", "true", "yes", "on")
        return cls(given.get("ICSPARK_MODE", cls.mode).strip().lower(), flag("DISABLED", cls.disabled), flag("RELEVANCE", cls.relevance), flag("COMPARATIVE", cls.comparative), given.get("ICSPARK_RECORDS") or None)

    def guard(self, program: Program | None, watch: bool = False) -> Guard:
        return Guard(self.mode, program, self.disabled, watch)


def count_alerts(df: DataFrame, program: Program) -> int:
    """Rows that violate the program; warns if there are any."""
    rows, bad = alerts(df, program, "_alert").agg(F.count(F.lit(1)), F.count(F.when(F.col("_alert"), 1))).first()
    if bad:
        warnings.warn(f"{bad} of {rows} rows violate the program", stacklevel=3)
    return bad


def guarded(df: DataFrame, model: Model, guard: Guard, out: str) -> DataFrame:
    """df with the prediction column `out`. Programs of any size: beyond a bound of branches rows meet them by a join."""
    missing = [f for f in model.features if f not in df.columns]
    if missing:
        raise ValueError(f"the model needs columns {missing}")
    if guard.mode == "rectify":
        kept = df.columns
        # originals travel in one struct; the model sees mended features only
        names = [c for c in kept if c in model.features]
        held = rectified(df.withColumn("_held", F.struct(*[F.col(f"`{c}`").alias(c) for c in names])), guard.program, only=names)
        made = model.apply(held, out)
        return made.select(*[F.col(f"_held.`{c}`").alias(c) if c in names else F.col(f"`{c}`") for c in kept], F.col(f"`{out}`"))
    if guard.disabled or guard.program is None:
        return model.apply(df, out)
    if guard.mode == "raise":
        if not alerts(df, guard.program, "_alert").where("_alert").isEmpty():
            raise ValueError("rows violate the program")
        return model.apply(df, out)
    if guard.watch:
        count_alerts(df, guard.program)
    if guard.mode == "ignore":
        return model.apply(df, out)
    made = alerts(model.apply(df, out), guard.program, "_alert")
    return made.withColumn(out, F.when(~F.col("_alert"), F.col(f"`{out}`"))).drop("_alert")
