"""Program synthesis: learn a class of DAGs, fit each distinct statement once, keep the best program."""

from __future__ import annotations

import json
import logging
import os
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icspark.operators.program import Program, Statement, fit
from icspark.operators.structure import Graph, bounded, encode, member_dags, order_search, pc, score_search, shifted_pairs, some_true

LEARNERS: dict[str, Callable[[DataFrame, list[str]], Graph]] = {"pc": pc, "score": score_search, "order": order_search}
SAMPLERS = ("shift", "identity")


@dataclass
class Search:
    """epsilon and min_support are strict bounds of a branch.

    keep_false learns on all sampled pairs; by default pairs that differ in every column are dropped first,
    which hides dependencies of columns that hardly ever differ. sampler "identity" learns on the encoded rows instead
    of pairs; columns that encoding drops as too wide take no part. Samples of more than most_rows are cut down.
    graph_path keeps the learned class: a search that finds the file reads it and doesn't learn. All DAGs of the class are tried, or the first most_dags.
    """

    epsilon: float = 0.01
    min_support: int = 10
    learner: str = "score"
    keep_false: bool = False
    sampler: str = "shift"
    graph_path: str | None = None
    most_rows: int | None = None
    most_dags: int | None = None
    #: Seconds that learning took, once it ran.
    seconds: float | None = None

    def __post_init__(self):
        if self.sampler not in SAMPLERS:
            raise ValueError(f"unknown sampler {self.sampler!r}")

    def graph(self, df: DataFrame, key: list[str], columns: list[str]) -> Graph:
        """The class of DAGs, learned or as kept in graph_path."""
        if self.graph_path and os.path.exists(self.graph_path):
            return load_graph(self.graph_path)
        sample = self.sample(df, key, columns).persist()
        try:
            sample.count()
            began = time.monotonic()
            found = LEARNERS[self.learner](sample, sample.columns)
            self.seconds = time.monotonic() - began
        finally:
            sample.unpersist()
        logging.getLogger(__name__).info("%s learned in %.3f s", self.learner, self.seconds)
        if self.graph_path:
            save_graph(found, self.graph_path)
        return found

    def sample(self, df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
        """What the learner sees."""
        if self.sampler == "identity":
            return bounded(encode(df.select(*[F.col(f"`{c}`") for c in columns])), self.most_rows)
        shuffled = df.withColumn("_order", F.xxhash64(*key))  # equal values stand in an order that says nothing about the rest
        every = shifted_pairs(shuffled, ["_order", *key], columns)
        pairs = every if self.keep_false else some_true(every, columns)
        return bounded(pairs.select(*[F.col(f"`{c}`") for c in columns]), self.most_rows)

    def run(self, df: DataFrame, key: list[str], columns: list[str] | None = None) -> Program:
        columns = columns or [c for c in df.columns if c not in key]
        return self.best(df, self.graph(df, key, columns))

    def best(self, df: DataFrame, graph: Graph) -> Program:
        """The program of highest coverage over the DAGs of the class; ties go to the alphabetically first."""
        parents = lambda g: [(tuple(g.parents(n)), n) for n in sorted(g.nodes) if g.parents(n)]
        wanted = {w for g in member_dags(graph, self.most_dags) for w in parents(g)}
        rows = df.persist()
        fitted: dict[tuple, Statement | None] = {w: fit(rows, *w, self.epsilon, self.min_support) for w in sorted(wanted)}
        rows.unpersist()
        best = None
        for g in member_dags(graph, self.most_dags):
            p = Program([s for w in parents(g) if (s := fitted[w])])
            rank = (-p.coverage, [(s.determinants, s.dependent) for s in p.statements])
            if best is None or rank < best[0]:
                best = (rank, p)
        if best is None:
            raise ValueError("no DAG to make a program from")
        return best[1]


def sampler_ablation(df: DataFrame, key: list[str], columns: list[str] | None = None, **settings) -> dict[str, float]:
    """Share of rows that the program found with each sampler covers, by the larger number of statements."""
    found = {s: Search(sampler=s, **settings).run(df, key, columns) for s in SAMPLERS}
    most, rows = max(len(p.statements) for p in found.values()), df.count()
    return {s: p.coverage / rows / most if most and rows else 0.0 for s, p in found.items()}


def save_graph(g: Graph, path: str) -> None:
    with open(path, "w") as f:
        json.dump({"nodes": g.nodes, "edges": sorted(map(sorted, g.edges)), "arcs": sorted(g.arcs)}, f)


def load_graph(path: str) -> Graph:
    with open(path) as f:
        x = json.load(f)
    return Graph(x["nodes"], {frozenset(e) for e in x["edges"]}, {tuple(a) for a in x["arcs"]})
