"""Other constraint miners: functional dependencies by lattice, conditional dependencies, graphical lasso, bounded search."""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icspark.functions.predicates import in_cell
from icspark.operators.program import Branch, Program, Statement, branch_counts, force_fit
from icspark.operators.structure import shifted_pairs


def _c(name: str):
    return F.col(f"`{name}`")


def group_counts(df: DataFrame, sets: list[tuple[str, ...]]) -> dict[tuple[str, ...], tuple[int, int]]:
    """(rows, distinct combinations, null as a value) of column sets: each set is grouped by itself, combined before its shuffle, all in one job."""
    if not sets:
        return {}
    parts = [df.groupBy(*map(_c, s)).agg(F.count(F.lit(1)).alias("n")).agg(F.lit(k).alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("d")) for k, s in enumerate(sets)]
    found = reduce(DataFrame.unionByName, parts).collect()
    return {sets[r["k"]]: (r["n"], r["d"]) for r in found}


def partition_classes(df: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """The stripped partition of a column set, row by row: (class values, size, key) of classes of two rows or more, null as a value.

    The product of two partitions is that of the union of their columns. A class is never gathered; its size comes from a grouped count.
    """
    on = [_c(c) for c in columns]
    sizes = df.groupBy(*on).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = sizes.select(*[_c(c).alias(f"_k{k}") for k, c in enumerate(columns)], "size")
    same = reduce(and_, [_c(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate(columns)])
    return df.join(sizes, same).select(*on, "size", *map(_c, key))


def fd_error(df: DataFrame, left: list[str], right: str) -> DataFrame:
    """g3 error of left -> right: the share of rows to drop until it holds."""
    pairs = df.groupBy(*map(_c, left), _c(right)).agg(F.count(F.lit(1)).alias("_n"))
    best = pairs.groupBy(*map(_c, left)).agg(F.max("_n").alias("_m"), F.sum("_n").alias("_s"))
    return best.agg((F.lit(1.0) - F.sum("_m") / F.sum("_s")).alias("error"))


def functional_dependencies(df: DataFrame, columns: list[str] | None = None, most_left: int = 3) -> list[tuple[tuple[str, ...], str]]:
    """Minimal dependencies by levelwise search with candidate right-hand sides; partitions are compared by their counts."""
    columns = sorted(columns or df.columns)
    rows = df.select(*map(_c, columns)).persist()  # each level counts it anew
    try:
        return _lattice(rows, columns, most_left)
    finally:
        rows.unpersist()


def _lattice(df: DataFrame, columns: list[str], most_left: int) -> list[tuple[tuple[str, ...], str]]:
    full, out = frozenset(columns), []
    held: dict[tuple[str, ...], int] = {(): 1}
    rows = 0
    candidates: dict[frozenset[str], frozenset[str]] = {frozenset(): full}
    level = [(c,) for c in columns]
    while level and len(level[0]) <= most_left + 1:
        for s, (rows, d) in group_counts(df, level).items():
            held[s] = d
        for x in level:
            xs = frozenset(x)
            cand = reduce(and_, [candidates.get(xs - {a}, frozenset()) for a in x])
            for a in sorted(xs & cand):
                left = tuple(c for c in x if c != a)
                if left in held and held[left] == held[x] and (left or held[x] <= 1):
                    out.append((left, a))
                    cand = cand - {a} - (full - xs)
            candidates[xs] = cand
        keep = [x for x in level if candidates[frozenset(x)] and held[x] < rows]
        for x in level:  # keys determine the rest, minimally
            if held[x] == rows and len(x) <= most_left:
                for a in sorted(candidates[frozenset(x)] - set(x)):
                    subs = [frozenset(x) - {b} for b in x]
                    if all(not any(l_ and set(l_) <= set(s) and r == a for l_, r in out) for s in subs):
                        out.append((x, a))
        blocks: dict[tuple[str, ...], list[str]] = {}
        for x in keep:
            blocks.setdefault(x[:-1], []).append(x[-1])
        ok = set(keep)
        level = [p + (a, b) for p, tails in blocks.items() for a, b in itertools.combinations(sorted(tails), 2) if all(tuple(c for c in p + (a, b) if c != d) in ok for d in p + (a, b))]
    return sorted(set(out), key=lambda f: (len(f[0]), f))


def fd_program(df: DataFrame, columns: list[str] | None = None) -> Program:
    """For each dependent the dependency of lowest loss, force-fitted."""
    best: dict[str, Statement] = {}
    for left, right in functional_dependencies(df, columns):
        if left and (s := force_fit(df, left, right)) and (right not in best or s.loss < best[right].loss):
            best[right] = s
    return Program([best[k] for k in sorted(best)])


def candidate_count(columns: int) -> int:
    """How many dependencies a table of n columns could have: n * (2^(n-1) - 1)."""
    return columns * (2 ** (columns - 1) - 1)


@dataclass(frozen=True)
class Cfd:
    """Conditional dependency: cells on the left imply a cell on the right."""

    left: tuple[tuple[str, str], ...]
    right: tuple[str, str]


def parse_cfd(line: str) -> Cfd:
    """`(A=v, B=w) => C=z`; cells on the left without `=` are passed over."""
    left, arrow, right = (x.strip() for x in line.partition("=>"))
    if not arrow or not left.startswith("(") or not left.endswith(")") or "=" not in right:
        raise ValueError(f"no conditional dependency: {line!r}")
    cell = lambda x: tuple(y.strip() for y in x.split("=", 1))
    return Cfd(tuple(cell(x) for x in left[1:-1].split(",") if "=" in x), cell(right))


def parse_cfds(lines: Iterable[str]) -> dict[int, Cfd]:
    """Dependencies by the number of their line, from 1. Lines that are none are passed over with a warning, blank ones without."""
    found = {}
    for k, line in enumerate(lines, 1):
        try:
            found[k] = parse_cfd(line)
        except ValueError as e:
            if line.strip():
                warnings.warn(f"line {k}: {e}", stacklevel=2)
    return found


def read_cfds(path: str) -> dict[int, Cfd]:
    """Dependencies of a text file, one a line."""
    with open(path) as f:
        return parse_cfds(f)


def apply_cfds(df: DataFrame, cfds: Mapping[int, Cfd] | Sequence[Cfd], name: str = "cfd_error") -> DataFrame:
    """df with the comma-joined names CFD_<number> of the violated ones; a sequence is numbered from 1.

    Unknown columns on the left never match, on the right are skipped.
    """
    marks = []
    cell = lambda a, v: in_cell(_c(a), df.schema[a].dataType, v) if a in df.columns else F.lit(False)
    for k, d in sorted(cfds.items()) if isinstance(cfds, Mapping) else enumerate(cfds, 1):
        if d.right[0] in df.columns:
            marks.append(F.when(reduce(and_, [cell(a, v) for a, v in d.left], F.lit(True)) & ~cell(*d.right), F.lit(f"CFD_{k}")))
    return df.withColumn(name, F.concat_ws(", ", *marks) if marks else F.lit(""))


def covariance(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sample covariance of numeric or boolean columns in one pass."""
    x = {c: _c(c).cast("double") for c in columns}
    pairs = list(itertools.combinations_with_replacement(columns, 2))
    row = df.agg(*[F.covar_samp(x[a], x[b]).alias(f"p{k}") for k, (a, b) in enumerate(pairs)]).first()
    out = np.zeros((len(columns), len(columns)))
    for k, (a, b) in enumerate(pairs):
        i, j = columns.index(a), columns.index(b)
        out[i, j] = out[j, i] = row[k] or 0.0
    return out


def graphical_lasso(s: np.ndarray, penalty: float = 0.01, rounds: int = 100, tol: float = 1e-6) -> np.ndarray:
    """Sparse inverse covariance by block coordinate descent."""
    p = len(s)
    w, beta = s + penalty * np.eye(p), np.zeros((p, p))
    for _ in range(rounds):
        before = w.copy()
        for j in range(p):
            rest = [k for k in range(p) if k != j]
            v, b = w[np.ix_(rest, rest)], beta[rest, j].copy()
            for _ in range(200):
                old = b.copy()
                for k in range(p - 1):
                    r = s[rest[k], j] - v[k] @ b + v[k, k] * b[k]
                    b[k] = np.sign(r) * max(abs(r) - penalty, 0) / v[k, k]
                if np.abs(b - old).max(initial=0) < tol:
                    break
            beta[rest, j] = b
            w[rest, j] = w[j, rest] = v @ b
        if np.abs(w - before).max() < tol:
            break
    theta = np.zeros((p, p))
    for j in range(p):
        rest = [k for k in range(p) if k != j]
        theta[j, j] = 1 / (w[j, j] - w[rest, j] @ beta[rest, j])
        theta[rest, j] = -beta[rest, j] * theta[j, j]
    return (theta + theta.T) / 2


def lasso_dependencies(pairs: DataFrame, columns: list[str], penalty: float = 0.01, least: float = 0.1) -> list[tuple[tuple[str, ...], str]]:
    """Dependencies from the autoregression matrix: the columns before a column, in order, whose weight is `least` or more."""
    theta = graphical_lasso(covariance(pairs, columns), penalty)
    low = np.linalg.cholesky(theta[::-1, ::-1])[::-1, ::-1]  # upper factor in the given order
    weights = -(low / np.diag(low)[None, :])
    out = []
    for j, c in enumerate(columns):
        left = tuple(columns[i] for i in range(len(columns)) if i != j and i > j and abs(weights[i, j]) >= least) or tuple(columns[i] for i in range(j) if abs(weights[i, j]) >= least)
        if left:
            out.append((left, c))
    return out


def lasso_program(df: DataFrame, key: list[str], columns: list[str] | None = None, penalty: float = 0.01, least: float = 0.1) -> Program:
    """Dependencies of the shifted pairs by graphical lasso, force-fitted on the rows."""
    columns = columns or [c for c in df.columns if c not in key]
    pairs = shifted_pairs(df, key, columns)
    return Program([s for left, right in lasso_dependencies(pairs, columns, penalty, least) if (s := force_fit(df, left, right))])


def violation_ratio(pairs: DataFrame, left: list[str], right: str) -> DataFrame:
    """On pairwise-equality data: among rows equal on the left, the share that differ on the right."""
    equal = reduce(and_, [_c(c) for c in left])
    return pairs.agg(F.try_divide(F.count(F.when(equal & ~_c(right), 1)), F.count(F.when(equal, 1))).alias("ratio"))


def fit_error(df: DataFrame, weights: dict[str, float], target: str) -> DataFrame:
    """Mean squared error and bias of a linear prediction, as aggregate moments."""
    r = _c(target).cast("double") - reduce(lambda a, b: a + b, [F.lit(w) * _c(c).cast("double") for c, w in weights.items()])
    return df.agg(F.avg(r * r).alias("mse"), F.avg(r).alias("bias"))


#: Candidate branches of a dependent that the driver may hold.
MOST_CANDIDATES = 100_000


def _candidates(df: DataFrame, dep: str, dets: tuple[str, ...], most_branches: int, most_lost: int) -> list[tuple[int, int, dict, object]]:
    """(support, loss, condition, value) of the branches that an optimum may hold: none that most_branches others without loss outdo."""
    counts = branch_counts(df, dets, dep).where("value is not null").withColumn("lost", F.col("support") - F.col("mode_n"))
    order = [F.desc("support"), *map(_c, dets)]
    rows = counts.where("lost = 0").orderBy(*order).limit(most_branches).collect()
    floor = rows[-1]["support"] if len(rows) == most_branches else 0
    rows += counts.where((F.col("lost") > 0) & (F.col("lost") <= most_lost) & (F.col("support") > floor)).orderBy(*order).limit(MOST_CANDIDATES + 1).collect()
    if len(rows) > MOST_CANDIDATES:
        raise ValueError(f"more than {MOST_CANDIDATES} candidate branches for {dets} -> {dep}; lower most_loss")
    return [(r["support"], r["lost"], {d: r[d] for d in dets}, r["value"]) for r in rows]


def _optimum(found: list[tuple[int, int, dict, object]], most_branches: int, most_lost: int) -> list[tuple[int, int, dict, object]]:
    """Up to most_branches candidates of the largest total support with a total loss of most_lost at most, by branch and bound."""
    best: tuple[int, int, list[int]] = (0, 0, [])
    stack: list[tuple[int, int, int, list[int]]] = [(0, 0, 0, [])]
    while stack:
        at, total, lost, chosen = stack.pop()
        if (-total, lost) < (-best[0], best[1]):
            best = (total, lost, chosen)
        room = most_branches - len(chosen)
        if not room or at == len(found) or total + sum(c[0] for c in found[at : at + room]) <= best[0]:
            continue
        stack.append((at + 1, total, lost, chosen))
        if lost + found[at][1] <= most_lost:
            stack.append((at + 1, total + found[at][0], lost + found[at][1], [*chosen, at]))
    return [found[k] for k in best[2]]


def bounded_search(df: DataFrame, columns: list[str], most_branches: int = 4, most_filters: int = 2, most_loss: float = 0.01, best_only: bool = False) -> Program:
    """Per dependent the up to most_branches different conditions, all of one number of filters up to most_filters, that cover most rows
    at a loss of most_loss of the rows in all: an optimum, from grouped counts.

    A row counts for each condition that it meets; the first that it meets gives its value. Mean coverage is largest for the best
    statement alone, which best_only keeps.
    """
    rows = df.persist()
    try:
        most_lost, statements = int(most_loss * rows.count()), []
        for dep in columns:
            others, best = [c for c in columns if c != dep], []
            for size in range(1, most_filters + 1):
                found = [c for dets in itertools.combinations(others, size) for c in _candidates(rows, dep, dets, most_branches, most_lost)]
                found.sort(key=lambda c: (-c[0], c[1], str(c[2])))
                chosen = _optimum(found, most_branches, most_lost)
                if sum(c[0] for c in chosen) > sum(c[0] for c in best):
                    best = chosen
            if best:
                dets = tuple(sorted({k for c in best for k in c[2]}))
                statements.append(Statement(dets, dep, tuple(Branch(c[2], c[3]) for c in best), sum(c[0] for c in best), sum(c[1] for c in best)))
    finally:
        rows.unpersist()
    if best_only and statements:
        statements = [max(statements, key=lambda x: (x.coverage, -x.loss))]
    return Program(statements)
