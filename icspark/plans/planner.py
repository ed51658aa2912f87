"""QuerySpec to a lazy DataFrame: scan, column filters, model filters, group, project.

Each model is applied once, on the rows that earlier filters left, and its prediction
column is reused by later clauses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icspark.functions.predicates import aggregate, compare
from icspark.operators.analysis import Analyst
from icspark.operators.guard import Guard, guarded
from icspark.operators.models import Registry
from icspark.plans.grammar import Case, Condition, Operand, QueryError, QuerySpec, parse
from icspark.sources.catalog import Catalog


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


class Plan:
    """One query being planned: the frame so far and the prediction columns it holds."""

    def __init__(self, spec: QuerySpec, catalog: Catalog, models: Registry, guards: dict[str, Guard] | None, analyst: Analyst | None = None):
        self.spec, self.models, self.guards, self.analyst = spec, models, guards or {}, analyst
        self.df = catalog.load(spec.dataset, spec.version)
        self.base, self.row = list(self.df.columns), catalog.keys.get(spec.dataset, ())
        self.predicted: dict[int, str] = {}

    def predict(self, number: int) -> str:
        """The prediction column of a model, made on first use."""
        if number not in self.predicted:
            ref = self.spec.models[number]
            model = self.models.get(ref.path, ref.kind)
            name = f"{model.label} [predicted]"
            while name in self.df.columns:
                name += "'"
            guard = self.guards.get(ref.path, Guard())
            if self.analyst:
                self.analyst.see(self.df, model, ref.path, guard)
            self.df = guarded(self.df, model, guard, name)
            self.predicted[number] = name
        return self.predicted[number]

    def value(self, o: Operand) -> str:
        if o.model is not None:
            return self.predict(o.model)
        if o.column not in self.base:
            raise QueryError(f"no column {o.column!r} in {self.spec.dataset}")
        return o.column

    def kind(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def test(self, c: Condition) -> tuple[Column, str]:
        name = self.value(c.operand)
        return compare(_col(name), self.kind(name), c.op, c.value), c.text(name)

    def case(self, case: Case) -> tuple[Column, str, T.DataType]:
        test, text = self.test(case.condition)
        whole = isinstance(case.then, int) and isinstance(case.otherwise, int)
        return F.when(test, F.lit(case.then)).otherwise(F.lit(case.otherwise)), f"CASE WHEN {text} THEN {case.then} ELSE {case.otherwise} END", T.IntegerType() if whole else T.DoubleType()

    def key(self) -> str:
        """The group key's column; null keys go, a threshold names its two sides and keeps nulls as NaN."""
        g = self.spec.group
        name = self.value(g.operand)
        if g.threshold is not None and g.operand.model is not None:
            side = F.when(_col(name) > g.threshold, F.lit(f"> {g.threshold:g}")).when(_col(name) <= g.threshold, F.lit(f"<= {g.threshold:g}")).otherwise(F.lit("NaN"))
            self.df = self.df.withColumn(name + " side", side)
            return name + " side"
        self.df = self.df.where(_col(name).isNotNull())
        return name

    def run(self) -> DataFrame:
        spec, p = self.spec, self.spec.projection
        for c in spec.where:
            if c.operand.model is None:
                self.df = self.df.where(self.test(c)[0])
        for c in spec.where:
            if c.operand.model is not None:
                test, _ = self.test(c)
                self.df = self.df.where(test)
        return self.grouped() if spec.group else self.flat()

    def flat(self) -> DataFrame:
        p = self.spec.projection
        if p.case:
            value, text, kind = self.case(p.case)
            if p.agg:
                return self.df.agg(aggregate(p.agg, value, kind).alias(f"{p.agg}({text})"))
            return self.df.select(value.alias(text), *map(_col, self.base))
        o = p.operand
        if o.column == "*":
            return self.df.agg(F.count(F.lit(1)).alias("count(*)")) if p.agg else self.df.select(*map(_col, self.base))
        name = self.value(o)
        if p.agg:
            return self.df.agg(aggregate(p.agg, _col(name), self.kind(name), rows=o.model is None).alias(f"{p.agg}({name})"))
        if o.model is not None:
            return self.df.select(_col(name), *map(_col, self.base))
        return self.df.select(_col(name))

    def grouped(self) -> DataFrame:
        p = self.spec.projection
        if p.case:
            value, text, kind = self.case(p.case)
            if p.agg:
                k = self.key()
                return self.df.groupBy(_col(k)).agg(aggregate(p.agg, value, kind).alias(f"{p.agg}({text})"))
            if p.case.condition.operand.model is not None:
                raise QueryError("a grouped CASE over a model needs an aggregate")
            k = self.key()
            return self.df.select(_col(k), *[_col(c) for c in self.row if c != k], value.alias(text))
        o = p.operand
        if not p.agg:
            raise QueryError("a grouped query needs an aggregate")
        if p.agg == "count" and o.model is None:
            k = self.key()
            return self.df.groupBy(_col(k)).agg(F.count(F.lit(1)).alias("count(*)"))
        name = self.value(o)
        kind = self.kind(name)
        k = self.key()
        return self.df.groupBy(_col(k)).agg(aggregate(p.agg, _col(name), kind).alias(f"{p.agg}({name})"))


def run_query(text: str, catalog: Catalog, models: Registry | None = None, guards: dict[str, Guard] | None = None, compat: bool = False, analyst: Analyst | None = None) -> DataFrame:
    """The result of a query text, lazily. An analyst looks at each prediction while the query is planned, with actions of its own."""
    spec = parse(text, compat)
    if analyst:
        dataset = spec.dataset + (f".{spec.version}" if spec.version else "")
        analyst.begin(text.strip().splitlines()[0], dataset, {m.path: m.kind for m in spec.models.values()})
    return Plan(spec, catalog, models or Registry(), guards, analyst).run()
