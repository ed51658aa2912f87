"""Models behind M1, M2, ...: each adds a prediction column to a frame."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icspark.operators.program import Program

#: Rows of a lookup model that may be broadcast.
MOST_BROADCAST = 100_000


class Model(Protocol):
    label: str
    features: tuple[str, ...]

    def apply(self, df: DataFrame, out: str) -> DataFrame: ...


@dataclass(frozen=True)
class RuleModel:
    """A native expression over the features: stays in generated code."""

    label: str
    features: tuple[str, ...]
    expression: str  # SQL

    def apply(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, F.expr(self.expression))


@dataclass(frozen=True)
class LinearModel:
    """bias + sum of weight * feature; with a cut, the label of the side."""

    label: str
    weights: dict[str, float]
    bias: float = 0.0
    cut: tuple[float, str, str] | None = None

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(self.weights)

    def apply(self, df: DataFrame, out: str) -> DataFrame:
        total = F.lit(float(self.bias))
        for name, w in self.weights.items():
            total = total + F.col(f"`{name}`") * F.lit(float(w))
        if self.cut:
            at, high, low = self.cut
            total = F.when(total > at, F.lit(high)).when(total <= at, F.lit(low))
        return df.withColumn(out, total)


@dataclass(frozen=True)
class LookupModel:
    """Prediction by equality of the features with a table's rows; broadcast only when its size is checked."""

    label: str
    features: tuple[str, ...]
    table: DataFrame
    value: str

    def apply(self, df: DataFrame, out: str) -> DataFrame:
        side = self.table.select(*[F.col(f).alias(f"_lookup_{f}") for f in self.features], F.col(self.value).alias(out)).dropDuplicates([f"_lookup_{f}" for f in self.features])
        if side.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
            side = F.broadcast(side)
        on = [F.col(f"`{f}`") == F.col(f"_lookup_{f}") for f in self.features]
        return df.join(side, on, "left").drop(*[f"_lookup_{f}" for f in self.features])


@dataclass(frozen=True)
class ArrowModel:
    """Any predictor over pandas batches. Marked nondeterministic, so the optimizer evaluates it once."""

    label: str
    features: tuple[str, ...]
    predict: object  # Callable[[pd.DataFrame], pd.Series]
    returns: str = "double"

    def apply(self, df: DataFrame, out: str) -> DataFrame:
        predict, names = self.predict, list(self.features)

        @F.pandas_udf(self.returns)
        def call(rows: pd.DataFrame) -> pd.Series:
            return predict(rows[names])

        return df.withColumn(out, call.asNondeterministic()(F.struct(*[F.col(f"`{f}`").alias(f) for f in names])))


@dataclass(frozen=True)
class PipelineModelAdapter:
    """A fitted pyspark.ml pipeline whose prediction index maps back to labels."""

    label: str
    features: tuple[str, ...]
    pipeline: object
    labels: tuple[str, ...] = ()

    def apply(self, df: DataFrame, out: str) -> DataFrame:
        made = self.pipeline.transform(df)
        value: Column = F.col("prediction")
        if self.labels:
            value = F.element_at(F.array(*[F.lit(x) for x in self.labels]), (value + 1).cast("int"))
        return made.select(*[F.col(f"`{c}`") for c in df.columns], value.alias(out))


def train(df: DataFrame, label: str, features: list[str] | None = None, balanced: bool = False) -> PipelineModelAdapter:
    """Fit a logistic-regression pipeline on rows with a label; balanced weighs classes equally."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    features = features or [c for c in df.columns if c != label]
    rows = df.where(F.col(f"`{label}`").isNotNull()).withColumn("_label_text", F.col(f"`{label}`").cast("string"))
    text = [c for c in features if isinstance(df.schema[c].dataType, T.StringType)]
    number = [c for c in features if c not in text]
    steps = [StringIndexer(inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep") for c in text] + [OneHotEncoder(inputCol=f"_i_{c}", outputCol=f"_v_{c}", handleInvalid="keep") for c in text]
    steps.append(VectorAssembler(inputCols=[f"_v_{c}" for c in text] + number, outputCol="_features", handleInvalid="keep"))
    index = StringIndexer(inputCol="_label_text", outputCol="_y", stringOrderType="alphabetAsc").fit(rows)
    rows = index.transform(rows)
    if balanced:
        n = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
        weight = F.create_map(*[x for y, c in n.items() for x in (F.lit(y), F.lit(sum(n.values()) / (len(n) * c)))])
        rows = rows.withColumn("_w", weight[F.col("_y")])
    fitted = Pipeline(stages=[*steps, LogisticRegression(featuresCol="_features", labelCol="_y", maxIter=20, **({"weightCol": "_w"} if balanced else {}))]).fit(rows)
    return PipelineModelAdapter(label, tuple(features), fitted, tuple(index.labels))


def save(spark: SparkSession, model: PipelineModelAdapter, path: str, program: Program | None = None) -> None:
    """The pipeline, and what is known about it with the program that guards it, under one folder of any file system."""
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    about = json.dumps({"label": model.label, "features": model.features, "labels": model.labels, "program": program.to_json() if program else None})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(spark: SparkSession, path: str) -> tuple[PipelineModelAdapter, Program | None]:
    """A saved model and its program."""
    from pyspark.ml import PipelineModel

    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    model = PipelineModelAdapter(about["label"], tuple(about["features"]), PipelineModel.load(f"{path}/pipeline"), tuple(about["labels"]))
    return model, Program.from_json(about["program"]) if about["program"] else None


@dataclass
class Registry:
    """Models and their programs by path, or by `kind:path` where kinds share a path.

    With a session, an unknown path is looked for under `models/`, then as it is, and read by the loader of its kind.
    """

    models: dict[str, Model] = field(default_factory=dict)
    programs: dict[str, Program] = field(default_factory=dict)
    spark: SparkSession | None = None
    roots: tuple[str, ...] = ("models/", "")
    loaders: dict[str, Callable[[SparkSession, str], tuple[Model, Program | None]]] = field(default_factory=lambda: {"": load, "mllib": load})

    def get(self, path: str, kind: str = "") -> Model:
        for name in (f"{kind}:{path}", path):
            if name in self.models:
                return self.models[name]
        if self.spark is not None:
            if kind not in self.loaders:
                raise ValueError(f"no loader for models of kind {kind!r}; there are {sorted(k for k in self.loaders if k)}")
            for root in self.roots:
                try:
                    self.models[f"{kind}:{path}"], program = self.loaders[kind](self.spark, root + path)
                except AnalysisException as e:
                    if e.getCondition() != "PATH_NOT_FOUND":
                        raise
                    continue
                if program:
                    self.programs[path] = program
                return self.models[f"{kind}:{path}"]
        raise KeyError(f"no model {path!r} of kind {kind!r} is registered")
