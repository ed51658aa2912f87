"""Relevance and comparison of alerts with model errors, as single aggregations, and their records."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icspark.operators.guard import Guard, Settings, guarded
from icspark.operators.models import Model
from icspark.operators.program import alerts


def relevance(df: DataFrame, prediction: str, label: str, alert: str = "alert", noise: str | None = None) -> DataFrame:
    """Counts of alerts and errors, precision, recall and their correlation, in one row.

    With the flag column of injected noise also: noisy rows, those alerted, falsely alerted and mispredicted, and both correlations with it.
    """
    wrong, bad = ~F.col(f"`{prediction}`").eqNullSafe(F.col(f"`{label}`")), F.col(f"`{alert}`")
    n = lambda c: F.count(F.when(c, 1))

    def corr(a, b):
        """Pearson's correlation; null where a side never changes."""
        a, b = a.cast("double"), b.cast("double")
        return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))

    made = [F.count(F.lit(1)).alias("rows"), n(bad).alias("alerts"), n(wrong).alias("errors"), n(bad & wrong).alias("both"), corr(bad, wrong).alias("correlation")]
    if noise:
        hit = F.coalesce(F.col(f"`{noise}`"), F.lit(False))
        made += [n(hit).alias("noisy"), n(hit & bad).alias("noisy_alerts"), n(~hit & bad).alias("false_alerts"), n(hit & wrong).alias("noisy_errors"), corr(wrong, hit).alias("correlation_error_noise"), corr(bad, hit).alias("correlation_alert_noise")]
    return df.agg(*made).select("*", F.try_divide("both", "alerts").alias("precision"), F.try_divide("both", "errors").alias("recall"))


def comparison(df: DataFrame, before: str, after: str, label: str, noise: str | None = None) -> DataFrame:
    """Errors before and after rectification, and rows whose prediction changed (null-safe); with a noise flag also noisy rows, and those changed."""
    b, a, y = (F.col(f"`{c}`") for c in (before, after, label))
    n = lambda c: F.count(F.when(c, 1))
    made = [n(~b.eqNullSafe(y)).alias("errors_before"), n(~a.eqNullSafe(y)).alias("errors_after"), n(~b.eqNullSafe(a)).alias("changed")]
    if noise:
        hit = F.coalesce(F.col(f"`{noise}`"), F.lit(False))
        made += [n(hit).alias("noisy"), n(hit & ~b.eqNullSafe(a)).alias("noisy_changed")]
    return df.agg(F.count(F.lit(1)).alias("rows"), *made)


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(value, n): how often each value occurs, null as one."""
    return df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Context:
    """What a record says about where it comes from. `call` counts the analyses of a model within a query."""

    query: str
    model: str
    kind: str
    dataset: str
    call: int = 0


@dataclass
class Analyst:
    """Analyses every guarded prediction of a query as the settings ask, and keeps the records.

    noise names the flag column of injected errors. Relevance needs the label among the columns and isn't taken under rectify, whose features
    are mended; comparison needs it as well, and sets the plain prediction against the mended one.
    """

    settings: Settings = field(default_factory=Settings)
    noise: str = "injected"
    contexts: dict[str, Context] = field(default_factory=dict)
    records: list[dict] = field(default_factory=list)

    def begin(self, query: str, dataset: str, models: dict[str, str]) -> None:
        """A new query: one context for each model path."""
        self.contexts = {path: Context(query, path, kind, dataset) for path, kind in models.items()}

    def see(self, df: DataFrame, model: Model, path: str, guard: Guard) -> None:
        """Analyse a prediction on df, before later clauses drop rows."""
        log = logging.getLogger(__name__)
        if guard.program is None:
            return
        if model.label not in df.columns:
            log.warning("no column %r, so %s is not analysed", model.label, path)
            return
        noise = self.noise if self.noise in df.columns else None
        if self.settings.relevance and guard.mode != "rectify":
            marked = alerts(model.apply(df, "_prediction"), guard.program, "_alert")
            self._keep("relevance", relevance(marked, "_prediction", model.label, "_alert", noise), path)
        if self.settings.comparative:
            both = guarded(guarded(df, model, Guard(), "_before"), model, Guard("rectify", guard.program), "_after")
            self._keep("comparative", comparison(both, "_before", "_after", model.label, noise), path)

    def _keep(self, what: str, metrics: DataFrame, path: str) -> None:
        context = self.contexts.get(path)
        more = {"analysis": what} | (asdict(context) if context else {})
        if self.settings.records:
            record = append_record(metrics, self.settings.records, **more)
        else:
            record = metrics.first().asDict() | more
        self.records.append(record)
        if context:
            context.call += 1


def append_record(metrics: DataFrame, path: str, **more) -> dict:
    """Append a one-row frame to a JSON-lines file on the driver."""
    record = metrics.first().asDict() | more
    with open(path, "a") as f:
        f.write(json.dumps(record, default=str) + "\n")
    return record


def relative_error(result: DataFrame, truth: DataFrame, key: str, value: str) -> DataFrame:
    """L1 distance from the truth relative to its norm; groups missing from the result, and nulls, are 0."""
    both = truth.select(key, F.col(value).alias("_gt")).join(result.select(key, F.col(value).alias("_x")), key, "left")
    gt, x = F.coalesce("_gt", F.lit(0.0)), F.coalesce("_x", F.lit(0.0))
    return both.agg(F.try_divide(F.sum(F.abs(gt - x)), F.sum(F.abs(gt))).alias("relative_l1"))


def error_reduction(errors: DataFrame, before: str, after: str) -> DataFrame:
    """Mean and population deviation of before - after over all queries; a missing error is 0."""
    d = F.coalesce(F.col(f"`{before}`"), F.lit(0.0)) - F.coalesce(F.col(f"`{after}`"), F.lit(0.0))
    return errors.agg(F.avg(d).alias("mean_reduction"), F.stddev_pop(d).alias("std_reduction"))


def min_max(values: list[float]) -> list[float]:
    """Values moved to 0..1; all 0 if they are alike."""
    low, high = min(values, default=0), max(values, default=0)
    return [(v - low) / (high - low) if high > low else 0.0 for v in values]
