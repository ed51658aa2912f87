"""Structure learning: encode, sample pairwise equality, test or score, orient, enumerate.

Counting is distributed; graphs of at most some tens of nodes live on the driver.
"""

from __future__ import annotations

import itertools
import math
import warnings
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

import pyarrow as pa
import pyarrow.compute as pc_
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from icspark.sources.staging import ranked, staged

#: Rows from which sampled data are cut down, the most joint cells that the driver holds, and the most values that are broadcast.
MOST_ROWS, MOST_CELLS, MOST_BROADCAST = 200_000_000, 100_000, 100_000


def value_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """(rows, distinct values of each column, null as one)."""
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[(F.countDistinct(f"`{c}`") + F.coalesce(F.max(F.col(f"`{c}`").isNull().cast("int")), F.lit(0))).alias(c) for c in df.columns]).first()
    return row["_rows"], {c: row[c] for c in df.columns}


def wide_columns(rows: int, counts: dict[str, int]) -> list[str]:
    """Columns with too many values to learn on: more than max(15, rows // 1000), in tables of over 5 columns and 400 rows."""
    if len(counts) <= 5 or rows <= 400:
        return []
    return [c for c, n in counts.items() if n > max(15, rows // 1000)]


def encode(df: DataFrame) -> DataFrame:
    """Complete rows of narrow columns, as codes 0, 1, ... of the sorted values. Codes come from the table of values, broadcast while it is small."""
    rows, counts = value_counts(df)
    kept = df.drop(*wide_columns(rows, counts)).na.drop()
    out = kept
    for c in kept.columns:
        values = kept.select(c).distinct()
        if counts[c] <= MOST_BROADCAST:  # a checked size, so one task may number it
            codes = F.broadcast(values.select(F.col(f"`{c}`").alias("_v"), (F.row_number().over(Window.orderBy(F.col(f"`{c}`"))) - 1).alias("_k")))
        else:
            codes = ranked(values, [c], "_k")[0].select(F.col(f"`{c}`").alias("_v"), F.col("_k").cast("int").alias("_k"))
        out = out.join(codes, F.col(f"`{c}`") == F.col("_v")).drop("_v", c).withColumnRenamed("_k", c)
    return out.select(*kept.columns)


def _same(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cell by cell: equal, with nulls and with NaNs alike."""
    equal = pc_.fill_null(pc_.equal(a, b), False)
    if pa.types.is_floating(a.type):
        equal = pc_.or_(equal, pc_.fill_null(pc_.and_(pc_.is_nan(a), pc_.is_nan(b)), False))
    return pc_.or_(equal, pc_.and_(pc_.is_null(a), pc_.is_null(b)))


def _neighbours(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows in the order of `by`, each compared with the next and the last with the first: booleans by column.

    Rows are range-partitioned and sorted once. A task compares neighbours as they stream by and gives its first and last row
    besides; those two rows a partition are all that reaches the driver.
    """
    keys = [F.col(f"`{c}`") for c in by]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*[F.col(f"`{c}`") for c in columns])
    flags = T.StructType([T.StructField(c, T.BooleanType()) for c in columns])
    ends = T.StructType([T.StructField(c, df.schema[c].dataType) for c in columns])
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("same", flags), T.StructField("end", ends)])
    kinds = to_arrow_schema(schema)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None

        def made(place: int | None, same, end) -> pa.RecordBatch:
            n = len(same if same is not None else end)
            nothing = lambda k: pa.nulls(n, kinds.field(k).type)
            rows = [pa.array([part] * n, pa.int32()), pa.array([place] * n, pa.int32()), nothing(2) if same is None else same, nothing(3) if end is None else end.cast(kinds.field(3).type)]
            return pa.RecordBatch.from_arrays(rows, schema=kinds)

        cells = lambda t: pa.StructArray.from_arrays(t.columns, names=columns)
        for b in batches:
            if not b.num_rows:
                continue
            if last is None:
                yield made(0, None, cells(b.slice(0, 1)))
            t = pa.Table.from_batches([b] if last is None else [last, b]).combine_chunks().to_batches()[0]
            if t.num_rows > 1:
                yield made(None, pa.StructArray.from_arrays([_same(t.column(k).slice(0, t.num_rows - 1), t.column(k).slice(1)) for k in range(len(columns))], names=columns), None)
            last = b.slice(b.num_rows - 1, 1)
        if last is not None:
            yield made(1, None, cells(last))

    held = staged(dealt.mapInArrow(go, schema))
    inner = held.where("place is null").select(*[F.col(f"same.`{c}`").alias(c) for c in columns])
    border = held.where("place is not null").select("part", "place", "end").orderBy("part", "place").collect()  # two rows a partition
    first, last = [[r["end"] for r in border if r["place"] == place] for place in (0, 1)]
    alike = lambda a, b: a == b or isinstance(a, float) and isinstance(b, float) and a != a and b != b
    across = [tuple(bool(alike(x, y)) for x, y in zip(last[k], first[(k + 1) % len(first)])) for k in range(len(last))]
    return inner.unionByName(df.sparkSession.createDataFrame(across, flags)) if across else inner


def shifted_pairs(df: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """Circular-shift sample: for each column, rows ordered by it (then key) are compared with the next, the last with the first.

    Gives len(columns) * rows rows of booleans and `block`, the ordering column. A block costs one range shuffle; no task holds the table.
    """
    columns = columns or [c for c in df.columns if c not in key]
    thin = df.select(*[F.col(f"`{x}`") for x in dict.fromkeys([*key, *columns])])
    out = None
    for c in columns:
        block = _neighbours(thin, list(dict.fromkeys([c, *key])), columns).withColumn("block", F.lit(c))
        out = block if out is None else out.unionByName(block)
    return out


def some_true(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a true cell."""
    return df.where(reduce(or_, [F.col(f"`{c}`") for c in columns]))


def bounded(df: DataFrame, most: int | None = None, seed: int = 42) -> DataFrame:
    """df, or a seeded sample of about `most` (MOST_ROWS) rows if it has more."""
    most = MOST_ROWS if most is None else most
    rows = df.count()
    if rows <= most:
        return df
    warnings.warn(f"{rows} rows are cut down to about {most}", stacklevel=2)
    return df.sample(fraction=most / rows, seed=seed)


@dataclass
class Graph:
    """A partially directed graph: undirected edges and arcs."""

    nodes: list[str]
    edges: set[frozenset[str]] = field(default_factory=set)
    arcs: set[tuple[str, str]] = field(default_factory=set)

    def adjacent(self, a: str, b: str) -> bool:
        return frozenset((a, b)) in self.edges or (a, b) in self.arcs or (b, a) in self.arcs

    def neighbours(self, a: str) -> list[str]:
        return [b for b in self.nodes if b != a and self.adjacent(a, b)]

    def orient(self, a: str, b: str) -> None:
        self.edges.discard(frozenset((a, b)))
        self.arcs.add((a, b))

    def add_arc(self, a: str, b: str) -> None:
        """a -> b, new or in place of an edge; an arc that closes a cycle is refused."""
        new = self.copy()
        new.orient(a, b)
        if a == b or not new.acyclic():
            raise ValueError(f"{a} -> {b} closes a cycle")
        self.orient(a, b)

    def lines(self) -> list[str]:
        """`a -> b` and `a -- b`, as other graph tools list them, and nodes alone."""
        held = {x for p in (*self.edges, *self.arcs) for x in p}
        return sorted([f"{a} -> {b}" for a, b in self.arcs] + [" -- ".join(sorted(e)) for e in self.edges] + [n for n in self.nodes if n not in held])

    @classmethod
    def of_lines(cls, lines: Iterable[str]) -> "Graph":
        """The graph that `lines` gives; an edge with two heads stands for no class of DAGs and is refused."""
        g = cls([])
        for line in lines:
            a, mark, b = (line.split() + ["", ""])[:3]
            if mark not in ("", "--", "->"):
                raise ValueError(f"no edge of a class of DAGs: {line!r}")
            g.nodes = sorted({*g.nodes, a, b} - {""})
            if mark == "--":
                g.edges.add(frozenset((a, b)))
            elif mark:
                g.add_arc(a, b)
        return g

    def of_edges(self, arcs: Iterable[tuple[str, str]]) -> "Graph":
        """This class with its edges turned as the arcs say: one of its DAGs, if every edge is named and no collider is new."""
        new = self.copy()
        for a, b in arcs:
            if not new.adjacent(a, b) or (b, a) in new.arcs:
                raise ValueError(f"{a} -> {b} is no edge of the class")
            new.add_arc(a, b)
        return new

    def parents(self, a: str) -> list[str]:
        return sorted(p for p, c in self.arcs if c == a)

    def copy(self) -> "Graph":
        return Graph(list(self.nodes), set(self.edges), set(self.arcs))

    def acyclic(self) -> bool:
        """Kahn's algorithm on the arcs."""
        degree = {n: 0 for n in self.nodes}
        for _, b in self.arcs:
            degree[b] += 1
        ready, seen = [n for n in self.nodes if not degree[n]], 0
        while ready:
            n = ready.pop()
            seen += 1
            for a, b in self.arcs:
                if a == n:
                    degree[b] -= 1
                    if not degree[b]:
                        ready.append(b)
        return seen == len(self.nodes)

    def close(self) -> None:
        """Orientation rules until nothing changes."""
        moved = True
        while moved:
            moved = False
            for e in sorted(self.edges, key=sorted):
                for a, b in itertools.permutations(sorted(e)):
                    others = [c for c in self.nodes if c not in (a, b)]
                    if any((c, a) in self.arcs and not self.adjacent(c, b) for c in others) or any((a, c) in self.arcs and (c, b) in self.arcs for c in others) or any(frozenset((a, c)) in self.edges and frozenset((a, d)) in self.edges and (c, b) in self.arcs and (d, b) in self.arcs and not self.adjacent(c, d) for c, d in itertools.combinations(others, 2)):
                        self.orient(a, b)
                        moved = True
                        break
                if moved:
                    break


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution, by series or continued fraction of the incomplete gamma function."""
    if x <= 0 or df <= 0:
        return 1.0
    a, z = df / 2, x / 2
    lead = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-15 * abs(total):
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - lead * total)
    b, c = z + 1 - a, 1e300
    d = h = 1 / b
    for k in range(1, 10_000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


class Counts:
    """Cell counts by set of columns, and what tests and scores need of them.

    While the table has at most MOST_CELLS distinct rows, they are fetched once and every set is summed from them;
    beyond that each set is counted by itself and only sums, or a histogram of the counts, reach the driver.
    """

    def __init__(self, df: DataFrame, columns: list[str]):
        self.df, self.columns, self.held = df, list(columns), {}
        joint = self.cells(tuple(columns)).limit(MOST_CELLS + 1).collect()
        self.joint = [(tuple(r[:-1]), r[-1]) for r in joint] if len(joint) <= MOST_CELLS else None

    def cells(self, columns: tuple[str, ...]) -> DataFrame:
        return self.df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("_n"))

    def of(self, columns: tuple[str, ...]) -> dict[tuple, int]:
        """Counts by cell, where the joint table is held."""
        if columns not in self.held:
            at, cells = [self.columns.index(c) for c in columns], {}
            for row, n in self.joint:
                cell = tuple(row[k] for k in at)
                cells[cell] = cells.get(cell, 0) + n
            self.held[columns] = cells
        return self.held[columns]

    def chi2(self, a: str, b: str, given: tuple[str, ...]) -> tuple[float, int]:
        """(statistic, degrees of freedom) of a and b within the strata of `given`."""
        if self.joint is None:
            return self._chi2_far(a, b, given)
        strata: dict[tuple, dict[tuple, int]] = {}
        for cell, n in self.of((a, b, *given)).items():
            strata.setdefault(cell[2:], {})[cell[:2]] = n
        stat, df = 0.0, 0
        for table in strata.values():
            rows, cols, n = {}, {}, sum(table.values())
            for (x, y), c in table.items():
                rows[x] = rows.get(x, 0) + c
                cols[y] = cols.get(y, 0) + c
            df += (len(rows) - 1) * (len(cols) - 1)
            # cells that don't occur add their expectation, so the sum over those that do is enough
            stat += sum(c * c * n / (rows[x] * cols[y]) for (x, y), c in table.items()) - n
        return stat, df

    def _chi2_far(self, a: str, b: str, given: tuple[str, ...]) -> tuple[float, int]:
        strata = [f"_g{k}" for k in range(len(given))]
        cells = self.cells((a, b, *given)).toDF("_a", "_b", *strata, "_n")
        r = cells.groupBy(*strata, "_a").agg(F.sum("_n").alias("_r"))
        c = cells.groupBy(*strata, "_b").agg(F.sum("_n").alias("_c"))
        s = r.groupBy(*strata).agg(F.sum("_r").alias("_s"), F.count(F.lit(1)).alias("_x"))
        k = c.groupBy(*strata).agg(F.count(F.lit(1)).alias("_y"))

        def met(x: DataFrame, y: DataFrame, by: list[str]) -> DataFrame:
            """x with y's sums of the same values, nulls alike."""
            side = y.withColumnsRenamed({v: f"{v}_" for v in by})
            return x.join(side, reduce(and_, [F.col(v).eqNullSafe(F.col(f"{v}_")) for v in by], F.lit(True))).drop(*[f"{v}_" for v in by])

        both = met(met(met(cells, r, [*strata, "_a"]), c, [*strata, "_b"]), s, strata)
        n, r, c, s_ = (F.col(x).cast("double") for x in ("_n", "_r", "_c", "_s"))  # their products are beyond a long
        stat = both.agg(F.sum(n * n * s_ / (r * c))).first()[0] or 0.0
        n, df = met(s, k, strata).agg(F.sum("_s"), F.sum((F.col("_x") - 1) * (F.col("_y") - 1))).first()
        return stat - (n or 0), df or 0

    def values(self, column: str) -> int:
        return self.cells((column,)).count() if self.joint is None else len(self.of((column,)))

    def histogram(self, columns: tuple[str, ...]) -> dict[int, int]:
        """How many cells have each count: no more entries than about the root of twice the rows."""
        if self.joint is None:
            return dict(map(tuple, self.cells(columns).groupBy("_n").count().collect()))
        return dict(Counter(self.of(columns).values()))


def independent(counts: Counts, a: str, b: str, given: tuple[str, ...], alpha: float = 0.05) -> bool:
    """Chi-square test of a and b within the strata of `given`."""
    return chi2_sf(*counts.chi2(a, b, given)) > alpha


def pc(df: DataFrame, columns: list[str], alpha: float = 0.05, deepest: int = 3) -> Graph:
    """Skeleton by conditional independence, colliders from separating sets, then the orientation rules."""
    nodes = sorted(columns)
    counts = Counts(df, nodes)
    g = Graph(nodes, {frozenset(p) for p in itertools.combinations(nodes, 2)})
    apart: dict[frozenset[str], tuple[str, ...]] = {}
    for size in range(deepest + 1):
        near = {n: g.neighbours(n) for n in nodes}
        for a, b in itertools.permutations(nodes, 2):
            e = frozenset((a, b))
            if e not in g.edges:
                continue
            for given in itertools.combinations([x for x in near[a] if x != b], size):
                if independent(counts, min(a, b), max(a, b), given, alpha):
                    g.edges.discard(e)
                    apart[e] = given
                    break
    for c in nodes:
        for a, b in itertools.combinations(g.neighbours(c), 2):
            if not g.adjacent(a, b) and c not in apart.get(frozenset((a, b)), ()):
                for x in (a, b):
                    if (c, x) not in g.arcs:
                        g.orient(x, c)
    g.close()
    return g


def bdeu(counts: Counts, node: str, parents: tuple[str, ...], sample: float = 1.0) -> float:
    """BDeu score of a node given its parents; values are taken from the data."""
    q = math.prod(counts.values(p) for p in parents)
    a_j, a_jk = sample / q, sample / (q * counts.values(node))
    score = sum(m * (math.lgamma(a_jk + n) - math.lgamma(a_jk)) for n, m in counts.histogram((node, *parents)).items())
    return score + sum(m * (math.lgamma(a_j) - math.lgamma(a_j + n)) for n, m in counts.histogram(parents).items())


def score_search(df: DataFrame, columns: list[str], most_parents: int = 3, sample: float = 1.0) -> Graph:
    """Greedy hill climbing over DAGs by BDeu (add, drop, turn), returned as its equivalence class."""
    nodes = sorted(columns)
    counts = Counts(df, nodes)
    parents: dict[str, frozenset[str]] = {n: frozenset() for n in nodes}
    cache: dict[tuple[str, frozenset[str]], float] = {}

    def score(n: str, ps: frozenset[str]) -> float:
        if (n, ps) not in cache:
            cache[n, ps] = bdeu(counts, n, tuple(sorted(ps)), sample)
        return cache[n, ps]

    def legal(change: dict[str, frozenset[str]]) -> bool:
        now = parents | change
        return all(len(p) <= most_parents for p in change.values()) and Graph(nodes, set(), {(p, n) for n in nodes for p in now[n]}).acyclic()

    while True:
        moves = []
        for a, b in itertools.permutations(nodes, 2):
            if a in parents[b]:
                moves.append({b: parents[b] - {a}})
                moves.append({b: parents[b] - {a}, a: parents[a] | {b}})
            elif b not in parents[a]:
                moves.append({b: parents[b] | {a}})
        best, gain = None, 1e-9
        for m in moves:
            d = sum(score(n, p) - score(n, parents[n]) for n, p in m.items())
            if d > gain and legal(m):
                best, gain = m, d
        if best is None:
            return equivalence_class(Graph(nodes, set(), {(p, n) for n in nodes for p in parents[n]}))
        parents |= best


def order_search(df: DataFrame, columns: list[str], most_parents: int = 3, sample: float = 1.0) -> Graph:
    """Search over orders of the nodes: each takes its best parent set among those before it; one node at a time moves to where the total gains most."""
    nodes = sorted(columns)
    counts = Counts(df, nodes)
    scored = {}
    for n in nodes:
        others = [o for o in nodes if o != n]
        sets = [ps for k in range(min(most_parents, len(others)) + 1) for ps in itertools.combinations(others, k)]
        scored[n] = sorted(((bdeu(counts, n, ps, sample), ps) for ps in sets), key=lambda x: (-x[0], len(x[1]), x[1]))

    def choose(order: list[str]) -> list[tuple[float, tuple[str, ...]]]:
        return [next(x for x in scored[n] if set(order[:k]).issuperset(x[1])) for k, n in enumerate(order)]

    order = nodes
    value = sum(s for s, _ in choose(order))
    while True:
        tried = []
        for n in nodes:
            rest = [o for o in order if o != n]
            tried += [[*rest[:k], n, *rest[k:]] for k in range(len(nodes))]
        best = max(tried, key=lambda o: sum(s for s, _ in choose(o)), default=order)
        gained = sum(s for s, _ in choose(best))
        if gained <= value + 1e-9:
            return equivalence_class(Graph(nodes, set(), {(p, n) for n, (_, ps) in zip(order, choose(order)) for p in ps}))
        order, value = best, gained


def equivalence_class(dag: Graph) -> Graph:
    """The DAG's skeleton with its colliders, closed under the orientation rules."""
    g = Graph(list(dag.nodes), {frozenset(a) for a in dag.arcs})
    for c in dag.nodes:
        for a, b in itertools.combinations(dag.parents(c), 2):
            if not dag.adjacent(a, b):
                g.orient(a, c), g.orient(b, c)
    g.close()
    return g


def member_dags(g: Graph, most: int | None = None) -> Iterator[Graph]:
    """The DAGs of the class one by one, in a fixed order. All of them, or with `most` only the first so many and a warning if there are more."""
    colliders = lambda x: {(frozenset((a, b)), c) for c in x.nodes for a, b in itertools.combinations(x.parents(c), 2) if not x.adjacent(a, b)}
    want, given, stack = colliders(g), 0, [g]
    while stack:
        now = stack.pop()
        if not now.edges:
            if now.acyclic() and colliders(now) == want:
                if given == most:
                    warnings.warn(f"the class holds more than {most} DAGs; only the first {most} are tried, the best may lie beyond", stacklevel=2)
                    return
                given += 1
                yield now
            continue
        a, b = sorted(min(now.edges, key=sorted))
        for x, y in ((b, a), (a, b)):
            new = now.copy()
            new.orient(x, y)
            new.close()
            if new.acyclic():
                stack.append(new)
