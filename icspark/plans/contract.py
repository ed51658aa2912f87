"""Registered queries of the engine's own operators, each over whole tables, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icspark.operators import analysis, miners, noise, structure
from icspark.operators.guard import Guard, guarded
from icspark.operators.models import LinearModel, LookupModel, Registry, RuleModel
from icspark.operators.program import Program, Statement, alerts, branch_counts, detection, fit, force_fit, heat_table, loss, rectified, row_errors, violated
from icspark.plans.planner import run_query
from icspark.sources.catalog import Catalog

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# ---- fixtures -------------------------------------------------------------------------------

_GEO = """WITH geo AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag, n_name, r_name AS true_region, (l_orderkey * 7 + l_linenumber) % {m} = 0 AS flag,
    CASE WHEN (l_orderkey * 7 + l_linenumber) % {m} <> 0 THEN r_name WHEN r_name = 'ASIA' THEN 'EUROPE' ELSE 'ASIA' END AS r_name
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), counts AS (SELECT n_name, r_name, count(*) AS n FROM geo WHERE n_name IS NOT NULL GROUP BY n_name, r_name
), ranked AS (SELECT *, sum(n) OVER (PARTITION BY n_name) AS support, row_number() OVER (PARTITION BY n_name ORDER BY r_name IS NULL, n DESC, r_name) AS k FROM counts
), branches AS (SELECT n_name, r_name AS expected, n AS mode_n, support FROM ranked WHERE k = 1 AND n / support > 1 - {eps} AND support > 10
), checked AS (SELECT g.*, b.expected, b.expected IS NOT NULL AND b.expected IS DISTINCT FROM g.r_name AS alert FROM geo g LEFT JOIN branches b USING (n_name))
"""


def _geo_sql(m: int = 197, eps: float = 0.01) -> str:
    return _GEO.format(m=m, eps=eps)


def tables(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog.of_folder(spark, sf_dir, TABLES)


def geo(spark: SparkSession, sf_dir: str, m: int = 197) -> DataFrame:
    """lineitem with its supplier's nation and region; every m-th region is wrong."""
    t = tables(spark, sf_dir)
    place = t.load("supplier").join(t.load("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t.load("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    df = t.load("lineitem").join(place, F.col("l_suppkey") == F.col("s_suppkey"))
    flag = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % m == 0
    noisy = F.when(~flag, F.col("r_name")).when(F.col("r_name") == "ASIA", "EUROPE").otherwise("ASIA")
    return df.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "n_name", F.col("r_name").alias("true_region"), flag.alias("flag"), noisy.alias("r_name"))


def geo_program(df: DataFrame, eps: float = 0.01) -> Program:
    return Program([fit(df, ["n_name"], "r_name", eps, 10)])


RULE = "CASE WHEN c_acctbal > 5000 THEN 'rich' WHEN c_acctbal > 0 THEN 'middle' ELSE 'debt' END"
LINE = "(l_quantity * 0.5 + l_discount * 10.0)"
REGION_MODEL = "CASE WHEN r_name = 'ASIA' THEN 1.5 WHEN r_name = 'EUROPE' THEN 2.5 ELSE 0.5 END"


def _models(catalog: Catalog) -> Registry:
    nations = catalog.load("nation").join(catalog.load("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    return Registry(
        {
            "wealth": RuleModel("wealth", ("c_acctbal",), RULE),
            "line": LinearModel("line", {"l_quantity": 0.5, "l_discount": 10.0}),
            "place": LookupModel("place", ("c_nationkey",), nations, "r_name"),
            "region": RuleModel("region", ("r_name",), f"CAST({REGION_MODEL} AS DOUBLE)"),
        }
    )


_DECLARED = "\nM1: wealth, rule\nM2: line, linear # score\nM3: place, lookup\nM4: region, rule"


def _query(name: str, text: str, columns: str, sql: str, digits: int | None = None) -> None:
    """Register a dialect query: its result columns take the given names, doubles are rounded in both engines."""
    names = columns.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = tables(spark, sf_dir)
        catalog.frames["nulls"] = catalog.load("customer").selectExpr("c_custkey", "nullif(c_mktsegment, 'BUILDING') AS segment", "c_acctbal")
        out = run_query(text + _DECLARED, catalog, _models(catalog)).toDF(*names)
        return out.select(*[F.round(c, digits).alias(c) if digits is not None and t == "double" else F.col(c) for c, t in out.dtypes])

    QUERIES[name], ORACLE_SQL[name] = run, sql


CUSTOMER = "c_custkey c_name c_nationkey c_acctbal c_mktsegment"
_query("proj_star", "SELECT customer.* FROM customer", CUSTOMER, "SELECT * FROM customer")
_query("proj_col", "SELECT customer.c_mktsegment FROM customer", "c_mktsegment", "SELECT c_mktsegment FROM customer")
for _n, _f in {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "std": "stddev_samp", "var": "var_samp", "median": "median"}.items():
    _query(f"agg_{_n}", f"SELECT {_n}(orders.o_totalprice) FROM orders", "v", f"SELECT round({_f}(o_totalprice), 2) AS v FROM orders", 2)
_query("agg_count", "SELECT count(nulls.segment) FROM nulls", "v", "SELECT count(*) AS v FROM customer")
_query("count_star", "SELECT COUNT(*) FROM orders WHERE orders.o_orderstatus == 'F'", "v", "SELECT count(*) AS v FROM orders WHERE o_orderstatus = 'F'")
_query("case_col_agg", "SELECT sum(CASE WHEN customer.c_mktsegment == 'BUILDING' THEN 1 ELSE 0 END) FROM customer", "v", "SELECT count(*) AS v FROM customer WHERE c_mktsegment = 'BUILDING'")
_query("case_col_rows", "SELECT CASE WHEN customer.c_acctbal > 0 THEN 1 ELSE 0 END FROM customer", "positive " + CUSTOMER, "SELECT CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS positive, * FROM customer")
_query("model_agg", "SELECT avg(M2) FROM lineitem", "v", f"SELECT round(avg({LINE}), 6) AS v FROM lineitem", 6)
_query("model_rows", "SELECT M1 FROM customer", "wealth " + CUSTOMER, f"SELECT {RULE} AS wealth, * FROM customer")
_query("case_model_agg", "SELECT mean(CASE WHEN M1 == 'rich' THEN 1 ELSE 0 END) FROM customer", "v", f"SELECT round(avg(CASE WHEN {RULE} = 'rich' THEN 1 ELSE 0 END), 9) AS v FROM customer", 9)
_query("case_model_rows", "SELECT CASE WHEN M1 != 'debt' THEN 1 ELSE 0 END FROM customer", "solvent " + CUSTOMER, f"SELECT CASE WHEN {RULE} <> 'debt' THEN 1 ELSE 0 END AS solvent, * FROM customer")
_query("group_col_agg", "SELECT avg(customer.c_acctbal) FROM customer GROUP BY customer.c_mktsegment", "k v", "SELECT c_mktsegment AS k, round(avg(c_acctbal), 4) AS v FROM customer GROUP BY 1", 4)
_query("group_col_count", "SELECT count(*) FROM nulls GROUP BY nulls.segment", "k v", "SELECT c_mktsegment AS k, count(*) AS v FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1")
_query("group_case_col_agg", "SELECT sum(CASE WHEN customer.c_acctbal >= 1000 THEN 1 ELSE 0 END) FROM customer GROUP BY customer.c_nationkey", "k v", "SELECT c_nationkey AS k, sum(CASE WHEN c_acctbal >= 1000 THEN 1 ELSE 0 END)::BIGINT AS v FROM customer GROUP BY 1")
_query("group_case_col_rows", "SELECT CASE WHEN customer.c_acctbal < 0 THEN 1 ELSE 0 END FROM customer GROUP BY customer.c_mktsegment", "k v", "SELECT c_mktsegment AS k, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS v FROM customer")
_query("group_model_proj", "SELECT mean(M2) FROM lineitem WHERE lineitem.l_quantity > 10 GROUP BY lineitem.l_returnflag", "k v", f"SELECT l_returnflag AS k, round(avg({LINE}), 6) AS v FROM lineitem WHERE l_quantity > 10 GROUP BY 1", 6)
_query("group_case_model_agg", "SELECT sum(CASE WHEN M2 > 12.25 THEN 1 ELSE 0 END) FROM lineitem GROUP BY lineitem.l_linestatus", "k v", f"SELECT l_linestatus AS k, sum(CASE WHEN {LINE} > 12.25 THEN 1 ELSE 0 END)::BIGINT AS v FROM lineitem GROUP BY 1")
_query("group_by_model", "SELECT count(*) FROM customer GROUP BY M3", "k v", "SELECT r_name AS k, count(*) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_query("group_by_threshold", "SELECT count(*) FROM lineitem GROUP BY M2 ! 10", "k v", f"SELECT CASE WHEN {LINE} > 10 THEN '> 10' ELSE '<= 10' END AS k, count(*) AS v FROM lineitem GROUP BY 1")
for _n, _op in {"eq": "==", "ne": "!=", "gt": ">", "lt": "<", "ge": ">=", "le": "<="}.items():
    _query(f"filter_ops_{_n}", f"SELECT count(*) FROM lineitem WHERE lineitem.l_quantity {_op} 25", "v", f"SELECT count(*) AS v FROM lineitem WHERE l_quantity {_op.replace('==', '=')} 25")
_query("filter_null_ne", "SELECT nulls.c_custkey FROM nulls WHERE nulls.segment != 'MACHINERY'", "c_custkey", "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY'")
_query("filter_type_mismatch", "SELECT count(*) FROM customer WHERE customer.c_nationkey == '1'", "v", "SELECT count(*) AS v FROM customer WHERE false")
_query("filter_model_chain", "SELECT customer.c_custkey FROM customer WHERE customer.c_acctbal > -500 AND M1 != 'middle' AND M3 == 'ASIA'", "c_custkey", f"SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > -500 AND {RULE} <> 'middle' AND r_name = 'ASIA'")


def _own(name: str, sql: str | None = None):
    """Register a function as a query."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


# ---- programs -------------------------------------------------------------------------------


def _branches(spark, s: Statement | None):
    """The branches of a statement on n_name, with its coverage and loss; no row where nothing was fitted."""
    return spark.createDataFrame([(b.when["n_name"], b.value, s.coverage, s.loss) for b in (s.branches if s else ())], "n_name string, expected string, coverage long, loss long")


@_own("fit_branches", _geo_sql(97) + "SELECT n_name, expected, sum(support) OVER ()::BIGINT AS coverage, sum(support - mode_n) OVER ()::BIGINT AS loss FROM branches")
def _(spark, sf_dir):
    return _branches(spark, fit(geo(spark, sf_dir, 97), ["n_name"], "r_name"))


@_own("force_fit", _geo_sql(97) + "SELECT n_name, r_name AS expected, sum(support) OVER ()::BIGINT AS coverage, sum(support - n) OVER ()::BIGINT AS loss FROM ranked WHERE k = 1")
def _(spark, sf_dir):
    return _branches(spark, force_fit(geo(spark, sf_dir, 97), ["n_name"], "r_name"))


@_own("branch_counts", _geo_sql(97) + "SELECT n_name, r_name AS value, n AS mode_n, support::BIGINT AS support FROM ranked WHERE k = 1")
def _(spark, sf_dir):
    return branch_counts(geo(spark, sf_dir, 97), ["n_name"], "r_name")


@_own("stmt_loss", _geo_sql() + "SELECT count(*) FILTER (alert) AS loss FROM checked")
def _(spark, sf_dir):
    df = geo(spark, sf_dir)
    return spark.createDataFrame([(loss(df, fit(df, ["n_name"], "r_name")),)], "loss long")


@_own("prog_coverage", _geo_sql() + "SELECT sum(support)::DOUBLE AS coverage, count(*) AS branches FROM branches")
def _(spark, sf_dir):
    p = geo_program(geo(spark, sf_dir))
    return spark.createDataFrame([(float(p.coverage), p.statements[0].cardinality)], "coverage double, branches long")


@_own("alerts", _geo_sql() + "SELECT l_orderkey, l_linenumber FROM checked WHERE alert")
def _(spark, sf_dir):
    df = geo(spark, sf_dir)
    return alerts(df, geo_program(df)).where("alert").select("l_orderkey", "l_linenumber")


@_own("rectified", _geo_sql() + "SELECT l_orderkey, l_linenumber, n_name, coalesce(expected, r_name) AS r_name FROM checked")
def _(spark, sf_dir):
    df = geo(spark, sf_dir)
    return rectified(df, geo_program(df)).select("l_orderkey", "l_linenumber", "n_name", "r_name")


@_own("row_errors", _geo_sql() + "SELECT l_orderkey, l_linenumber, 'r_name' AS cell, r_name AS original, expected FROM checked WHERE alert")
def _(spark, sf_dir):
    df = geo(spark, sf_dir)
    return row_errors(df, geo_program(df)).select("l_orderkey", "l_linenumber", F.explode("errors").alias("e")).select("l_orderkey", "l_linenumber", F.col("e.column").alias("cell"), "e.original", "e.expected")


@_own("violated_stmts", _geo_sql() + "SELECT l_orderkey, l_linenumber, CASE WHEN alert THEN '0' ELSE '' END AS violated FROM checked")
def _(spark, sf_dir):
    df = geo(spark, sf_dir)
    return violated(df, geo_program(df)).select("l_orderkey", "l_linenumber", F.array_join(F.transform("violated", lambda x: x.cast("string")), ",").alias("violated"))


_METRICS = "count(*) FILTER (flag AND alert) AS tp, count(*) FILTER (NOT flag AND alert) AS fp, count(*) FILTER (flag AND NOT alert) AS fn, count(*) FILTER (NOT flag AND NOT alert) AS tn"


@_own("detect_metrics", _geo_sql(97) + f"SELECT tp, fp, fn, tn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy FROM (SELECT {_METRICS} FROM checked)")
def _(spark, sf_dir):
    df = geo(spark, sf_dir, 97)
    out = detection(alerts(df, geo_program(df)), "flag")
    # 0 / 0 is NaN in the SQL
    return out.select("tp", "fp", "fn", "tn", *[F.coalesce(F.round(c, 9), F.lit(float("nan"))).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@_own("heat_table", _geo_sql() + "SELECT 'n_name' AS determinant, 'r_name' AS dependent, round(greatest(0.001, 100.0 * count(*) FILTER (alert) / count(*)), 6) AS loss_pct FROM checked")
def _(spark, sf_dir):
    df = geo(spark, sf_dir)
    rows = heat_table(geo_program(df), df.count())
    return spark.createDataFrame(rows, "determinant string, dependent string, loss_pct double").withColumn("loss_pct", F.round("loss_pct", 6))


# ---- guards and analysis --------------------------------------------------------------------


def _guarded_agg(mode: str):
    def run(spark, sf_dir):
        df = geo(spark, sf_dir)
        catalog = tables(spark, sf_dir)
        catalog.frames["geo"] = df
        out = run_query("SELECT sum(M4) FROM geo GROUP BY geo.n_name" + _DECLARED, catalog, _models(catalog), {"region": Guard(mode, geo_program(df))})
        return out.toDF("n_name", "v").withColumn("v", F.round("v", 3))

    return run


for _mode, _value in {"ignore": "r_name", "coerce": "CASE WHEN NOT alert THEN r_name END", "rectify": "coalesce(expected, r_name)"}.items():
    _inner = REGION_MODEL.replace("r_name", "x")
    _value_sql = f"CASE WHEN x IS NOT NULL THEN {_inner} END"
    _own(f"guard_{_mode}_agg", _geo_sql() + f"SELECT n_name, round(coalesce(sum({_value_sql}), 0), 3)::DOUBLE AS v FROM (SELECT n_name, {_value} AS x FROM checked) GROUP BY n_name")(_guarded_agg(_mode))


@_own("guard_raise_count", _geo_sql() + "SELECT CASE WHEN count(*) FILTER (alert) > 0 THEN 1 ELSE 0 END AS raised FROM checked")
def _(spark, sf_dir):
    df = geo(spark, sf_dir)
    try:
        guarded(df, RuleModel("region", ("r_name",), REGION_MODEL), Guard("raise", geo_program(df)), "p")
        raised = 0
    except ValueError:
        raised = 1
    return spark.createDataFrame([(raised,)], "raised int")


@_own("relevance_metrics", _geo_sql() + """SELECT count(*) AS rows, count(*) FILTER (alert) AS alerts, count(*) FILTER (r_name IS DISTINCT FROM true_region) AS errors, count(*) FILTER (alert AND r_name IS DISTINCT FROM true_region) AS both,
round(corr(alert::INT, (r_name IS DISTINCT FROM true_region)::INT), 6) AS correlation FROM checked""")
def _(spark, sf_dir):
    df = geo(spark, sf_dir)
    out = analysis.relevance(alerts(df, geo_program(df)), "r_name", "true_region")
    return out.select("rows", "alerts", "errors", "both", F.round("correlation", 6).alias("correlation"))


@_own("comparative_metrics", _geo_sql() + "SELECT count(*) AS rows, count(*) FILTER (r_name <> true_region) AS errors_before, count(*) FILTER (coalesce(expected, r_name) <> true_region) AS errors_after, count(*) FILTER (coalesce(expected, r_name) <> r_name) AS changed FROM checked")
def _(spark, sf_dir):
    df = geo(spark, sf_dir)
    model, program = RuleModel("region", ("r_name",), "r_name"), geo_program(df)
    both = guarded(guarded(df, model, Guard(), "before"), model, Guard("rectify", program), "after")
    return analysis.comparison(both, "before", "after", "true_region")


# ---- structure ------------------------------------------------------------------------------


@_own("encode_codes", "SELECT (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS c_mktsegment, (dense_rank() OVER (ORDER BY c_nationkey) - 1)::INT AS c_nationkey FROM customer")
def _(spark, sf_dir):
    return structure.encode(tables(spark, sf_dir).load("customer").select("c_mktsegment", "c_nationkey"))


_PAIRS = """WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders), p AS (
  SELECT 'o_orderstatus' AS block, o_orderstatus = coalesce(lead(o_orderstatus) OVER w, first_value(o_orderstatus) OVER w) AS o_orderstatus, o_orderpriority = coalesce(lead(o_orderpriority) OVER w, first_value(o_orderpriority) OVER w) AS o_orderpriority FROM o WINDOW w AS (ORDER BY o_orderstatus, o_orderkey)
  UNION ALL SELECT 'o_orderpriority', o_orderstatus = coalesce(lead(o_orderstatus) OVER w, first_value(o_orderstatus) OVER w), o_orderpriority = coalesce(lead(o_orderpriority) OVER w, first_value(o_orderpriority) OVER w) FROM o WINDOW w AS (ORDER BY o_orderpriority, o_orderkey))
"""
_BOTH = ["o_orderstatus", "o_orderpriority"]


def _pairs(spark, sf_dir):
    return structure.shifted_pairs(tables(spark, sf_dir).load("orders").select("o_orderkey", *_BOTH), ["o_orderkey"], _BOTH)


@_own("circ_shift_pairs", _PAIRS + "SELECT block, o_orderstatus, o_orderpriority, count(*) AS n FROM p GROUP BY ALL")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("block", *_BOTH).agg(F.count(F.lit(1)).alias("n"))


@_own("nonzero_pairs", _PAIRS + "SELECT block, count(*) AS n FROM p WHERE o_orderstatus OR o_orderpriority GROUP BY block")
def _(spark, sf_dir):
    return structure.some_true(_pairs(spark, sf_dir), _BOTH).groupBy("block").agg(F.count(F.lit(1)).alias("n"))


# ---- noise ----------------------------------------------------------------------------------


@_own("controllable_cells", _geo_sql() + "SELECT l_orderkey, l_linenumber, CASE WHEN expected IS NOT NULL THEN 'r_name' ELSE '' END AS controllable FROM checked")
def _(spark, sf_dir):
    df = geo(spark, sf_dir)
    return noise.controllable(df, geo_program(df)).select("l_orderkey", "l_linenumber", F.array_join("controllable", ",").alias("controllable"))


# ---- miners and evaluation ------------------------------------------------------------------

_FD_COLUMNS = ["n_name", "true_region", "l_returnflag"]


@_own("fd_check_pairs", _geo_sql() + " UNION ALL ".join(f"SELECT '{a}' AS lhs, '{b}' AS rhs, count(DISTINCT {a}) = count(DISTINCT ({a}, {b})) AS holds FROM geo" for a in _FD_COLUMNS for b in _FD_COLUMNS if a != b))
def _(spark, sf_dir):
    df = geo(spark, sf_dir)
    pairs = [(a, b) for a in _FD_COLUMNS for b in _FD_COLUMNS if a != b]
    n = miners.group_counts(df, [(a,) for a in _FD_COLUMNS] + pairs)
    return spark.createDataFrame([(a, b, n[(a,)][1] == n[(a, b)][1]) for a, b in pairs], "lhs string, rhs string, holds boolean")


@_own("fd_error", _geo_sql() + "SELECT round(1 - sum(m) / sum(s), 9) AS error FROM (SELECT max(n) AS m, sum(n) AS s FROM counts GROUP BY n_name)")
def _(spark, sf_dir):
    return miners.fd_error(geo(spark, sf_dir), ["n_name"], "r_name").select(F.round("error", 9).alias("error"))


@_own("superkey", "SELECT count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AS superkey FROM lineitem")
def _(spark, sf_dir):
    key = ("l_orderkey", "l_linenumber")
    n, d = miners.group_counts(tables(spark, sf_dir).load("lineitem"), [key])[key]
    return spark.createDataFrame([(n == d,)], "superkey boolean")


@_own("fd_violation_ratio", _PAIRS + "SELECT round(count(*) FILTER (o_orderstatus AND NOT o_orderpriority) / count(*) FILTER (o_orderstatus), 9) AS ratio FROM p")
def _(spark, sf_dir):
    return miners.violation_ratio(_pairs(spark, sf_dir), ["o_orderstatus"], "o_orderpriority").select(F.round("ratio", 9).alias("ratio"))


@_own("fit_error", "SELECT round(avg((l_extendedprice - 1000 * l_quantity) ** 2), 0) AS mse, round(avg(l_extendedprice - 1000 * l_quantity), 3) AS bias FROM lineitem")
def _(spark, sf_dir):
    return miners.fit_error(tables(spark, sf_dir).load("lineitem"), {"l_quantity": 1000.0}, "l_extendedprice").select(F.round("mse", 0).alias("mse"), F.round("bias", 3).alias("bias"))


@_own("result_l1", _geo_sql() + "SELECT round(sum(abs(gt - coalesce(x, 0))) / sum(abs(gt)), 9) AS relative_l1 FROM (SELECT true_region AS k, sum(l_quantity) AS gt FROM geo GROUP BY 1) LEFT JOIN (SELECT r_name AS k, sum(l_quantity) AS x FROM geo GROUP BY 1) USING (k)")
def _(spark, sf_dir):
    df = geo(spark, sf_dir)
    total = lambda c: df.groupBy(F.col(c).alias("k")).agg(F.sum("l_quantity").alias("v"))
    return analysis.relative_error(total("r_name"), total("true_region"), "k", "v").select(F.round("relative_l1", 9).alias("relative_l1"))


@_own("epsilon_sweep", _geo_sql(97) + "SELECT e.eps, count(k) AS branches, coalesce(sum(support), 0)::BIGINT AS coverage, coalesce(sum(support - n), 0)::BIGINT AS loss FROM (SELECT unnest([0.01, 0.05, 0.1, 0.15, 0.2, 0.25])::DOUBLE AS eps) e LEFT JOIN ranked r ON r.k = 1 AND r.n / r.support > 1 - e.eps AND r.support > 10 GROUP BY e.eps")
def _(spark, sf_dir):
    counts = branch_counts(geo(spark, sf_dir, 97), ["n_name"], "r_name")  # one table for all
    grid = spark.createDataFrame([(e,) for e in (0.01, 0.05, 0.1, 0.15, 0.2, 0.25)], "eps double")
    ok = (F.col("mode_n") / F.col("support") > 1 - F.col("eps")) & (F.col("support") > 10)
    out = counts.withColumn("eps", F.explode(F.array(*[F.lit(e) for e in (0.01, 0.05, 0.1, 0.15, 0.2, 0.25)]))).where(ok).groupBy("eps").agg(F.count(F.lit(1)).alias("branches"), F.sum("support").alias("coverage"), F.sum(F.col("support") - F.col("mode_n")).alias("loss"))
    return grid.join(out, "eps", "left").na.fill(0)


from icspark.plans import checks as _checks  # noqa: E402,F401  registers the rest
