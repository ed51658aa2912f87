"""Registered queries of sources, names, large and several statements, learners, noise, miners and evaluation, with their SQL."""

from __future__ import annotations

import contextlib
import io
import itertools
import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icspark.cli import run_queries
from icspark.operators import analysis, miners, noise, structure
from icspark.operators.guard import Guard, Settings, guarded
from icspark.operators.models import LinearModel, Registry, RuleModel, load, save, train
from icspark.operators.program import Program, alerts, error_text, fit, rectified, row_errors, violated
from icspark.operators.search import Search, sampler_ablation
from icspark.plans.contract import _BOTH, _DECLARED, _FD_COLUMNS, _PAIRS, LINE, ORACLE_SQL, QUERIES, REGION_MODEL, RULE, _geo_sql, _models, _own, _pairs, geo, geo_program, tables
from icspark.plans.planner import run_query
from icspark.sources.catalog import Catalog, read_table, write_table
from icspark.sources.staging import shared_folder


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/icspark-{uuid.uuid4().hex}"


def _draw_sql(seed: int, *key: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(key)}, {seed})), 1, 13))::BIGINT"


# ---- sources --------------------------------------------------------------------------------

_CSV = ["c_custkey", "CASE WHEN c_custkey % 7 = 0 THEN 'NA' ELSE cast(c_acctbal AS string) END AS bal", "CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE concat(c_mktsegment, ', \"x\"') END AS segment", "c_acctbal > 0 AS pos", "cast(date_add(DATE '2020-01-01', cast(c_custkey % 30 AS int)) AS string) AS day"]
_CSV_SQL = """SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS bal, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment || ', "x"' END AS segment, c_acctbal > 0 AS pos,
  strftime(DATE '2020-01-01' + (c_custkey % 30)::INT, '%Y-%m-%d') AS day FROM customer"""


def _written_csv(spark: SparkSession, sf_dir: str) -> Catalog:
    """A catalog of one CSV table with missing cells, quotes, booleans and dates."""
    path = f"{_folder(spark)}/shop.csv"
    write_table(tables(spark, sf_dir).load("customer").selectExpr(*_CSV), path)
    return Catalog(spark, {"shop": path})


@_own("csv_scan", _CSV_SQL)
def _(spark, sf_dir):
    return _written_csv(spark, sf_dir).load("shop")


@_own("csv_filters", f"SELECT c_custkey FROM ({_CSV_SQL}) WHERE day = '2020-01-05' AND bal > 100 AND pos")
def _(spark, sf_dir):
    return run_query("SELECT shop.c_custkey FROM shop WHERE shop.day == '2020-01-05' AND shop.bal > 100 AND shop.pos == 'True'", _written_csv(spark, sf_dir))


_IN_TEST = f"{_draw_sql(42, 'c_custkey')} / 4503599627370496.0 < 0.15"


def _split_tables(spark: SparkSession, sf_dir: str) -> Catalog:
    """customer with its train and test versions, written beside each other."""
    at, customer = _folder(spark), tables(spark, sf_dir).load("customer")
    for name, part in zip(("customer", "customer.train", "customer.test"), (customer, *noise.split(customer, ["c_custkey"]))):
        write_table(part, f"{at}/{name}.parquet")
    return Catalog(spark, {"customer": f"{at}/customer.parquet"})


@_own("split_versions", f"SELECT 'train' AS part, 'customer.train.parquet' AS file, c_custkey FROM customer WHERE NOT ({_IN_TEST}) UNION ALL SELECT 'test', 'customer.test.parquet', c_custkey FROM customer WHERE {_IN_TEST}")
def _(spark, sf_dir):
    c = _split_tables(spark, sf_dir)
    parts = dict(zip(("train", "test"), c.split("customer"))) | {"test": c.split("customer", "test")}
    named = [df.select(F.lit(v).alias("part"), F.lit(c.path("customer", v).rpartition("/")[2]).alias("file"), "c_custkey") for v, df in parts.items()]
    return named[0].unionByName(named[1])


@_own("version_query", f"SELECT count(*) AS v FROM customer WHERE c_acctbal > 0 AND NOT ({_IN_TEST})")
def _(spark, sf_dir):
    return run_query("SELECT count(*) FROM customer.train WHERE customer.c_acctbal > 0", _split_tables(spark, sf_dir)).toDF("v")


_DAYS = """SELECT day, status, CASE WHEN n / support > 0.5 AND support > 3 THEN 1 ELSE 0 END AS ok FROM (
  SELECT *, sum(n) OVER (PARTITION BY day) AS support, row_number() OVER (PARTITION BY day ORDER BY n DESC, status) AS k FROM (SELECT o_orderdate::DATE AS day, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL)) WHERE k = 1"""


@_own("program_file", f"SELECT strftime(day, '%Y-%m-%d') AS day, status FROM ({_DAYS}) WHERE ok = 1")
def _(spark, sf_dir):
    """A program with dates as conditions, written and read again."""
    days = tables(spark, sf_dir).load("orders").selectExpr("cast(o_orderdate AS date) AS day", "o_orderstatus AS status")
    path, s = _folder(spark), fit(days, ["day"], "status", 0.5, 3)
    spark.createDataFrame([(Program([s]).to_json(),)], "value string").coalesce(1).write.text(path)
    again = Program.from_json(spark.read.text(path, wholetext=True).first()[0].strip())
    return spark.createDataFrame([(b.when["day"].isoformat(), b.value) for s in again.statements for b in s.branches], "day string, status string")


_TRUTH = RuleModel("true_region", ("r_name",), "r_name")
_RECORDS = """SELECT 'relevance' AS analysis, 'region' AS model, 'geo' AS dataset, 0 AS call, count(*) AS rows, count(*) FILTER (r_name <> true_region) AS errors, count(*) FILTER (alert) AS found, count(*) FILTER (flag) AS noisy FROM checked
UNION ALL SELECT 'comparative', 'region', 'geo', 1, count(*), count(*) FILTER (r_name <> true_region), count(*) FILTER (coalesce(expected, r_name) <> r_name), count(*) FILTER (flag) FROM checked"""


@_own("analysis_records", _geo_sql() + _RECORDS)
def _(spark, sf_dir):
    df = geo(spark, sf_dir)
    with tempfile.TemporaryDirectory() as at:
        analyst = analysis.Analyst(Settings(comparative=True, records=f"{at}/records.jsonl"), noise="flag")
        run_query("SELECT count(M1) FROM geo\nM1: region, rule", Catalog(spark, frames={"geo": df}), Registry({"region": _TRUTH}), {"region": Guard("coerce", geo_program(df))}, analyst=analyst)
        lines = [json.loads(x) for x in Path(at, "records.jsonl").read_text().splitlines()]
    rows = [(x["analysis"], x["model"], x["dataset"], x["call"], x["rows"], x.get("errors", x.get("errors_before")), x.get("alerts", x.get("changed")), x["noisy"]) for x in lines]
    return spark.createDataFrame(rows, "analysis string, model string, dataset string, call int, rows long, errors long, found long, noisy long")


_GEO_TEXT = "SELECT count(*) FROM geo.noisy WHERE M1 == 'ASIA'\nM1: region, rule\n"


@_own("query_files", _geo_sql() + " UNION ALL ".join(f"SELECT 'q{k}.sql,{mode}' AS query, count(*) AS v FROM checked WHERE {value} = 'ASIA'{more}" for k, more in ((1, ""), (2, " AND l_quantity > 25")) for mode, value in (("ignore", "r_name"), ("coerce", "CASE WHEN NOT alert THEN r_name END"), ("rectify", "coalesce(expected, r_name)"), ("gt", "true_region"))))
def _(spark, sf_dir):
    df = geo(spark, sf_dir)
    clean = df.withColumn("r_name", F.col("true_region"))
    registry = Registry({"region": _TRUTH}, {"region": geo_program(df)})
    with tempfile.TemporaryDirectory() as at, contextlib.redirect_stdout(io.StringIO()):
        Path(at, "q1.sql").write_text(_GEO_TEXT)
        Path(at, "q2.sql").write_text(_GEO_TEXT.replace("WHERE", "WHERE geo.l_quantity > 25 AND"))
        run_queries(spark, at, Catalog(spark, frames={"geo.noisy_level_05": df, "geo.gt": clean}), ["ignore", "coerce", "rectify", "gt"], "05", registry=registry, out=f"{at}/out.json")
        found = json.loads(Path(at, "out.json").read_text())
    return spark.createDataFrame([(k, next(iter(rows[0].values()))) for k, rows in found.items()], "query string, v long")


# ---- dialect --------------------------------------------------------------------------------


def _named(name: str, text: str, sql: str, digits: int | None = None) -> None:
    """Register a query whose columns keep the names that the planner gives them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = tables(spark, sf_dir)
        catalog.frames["nulls"] = catalog.load("customer").selectExpr("c_custkey", "nullif(c_mktsegment, 'BUILDING') AS segment", "c_acctbal > 0 AS pos")
        out = run_query(text + _DECLARED, catalog, _models(catalog))
        return out.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if digits is not None and t == "double" else F.col(f"`{c}`") for c, t in out.dtypes])

    QUERIES[name], ORACLE_SQL[name] = run, sql


_named("name_agg", "SELECT avg(orders.o_totalprice) FROM orders", 'SELECT round(avg(o_totalprice), 2) AS "mean(o_totalprice)" FROM orders', 2)
_named("name_count", "SELECT count(*) FROM orders", 'SELECT count(*) AS "count(*)" FROM orders')
_named("name_model", "SELECT sum(M2) FROM lineitem", f'SELECT round(sum({LINE}), 2) AS "sum(line [predicted])" FROM lineitem', 2)
_named("name_model_rows", "SELECT M1 FROM customer", f'SELECT {RULE} AS "wealth [predicted]", * FROM customer')
_named("name_case", "SELECT sum(CASE WHEN M1 == 'rich' THEN 1 ELSE 0 END) FROM customer", f"""SELECT count(*) FILTER ({RULE} = 'rich') AS "sum(CASE WHEN wealth [predicted] == 'rich' THEN 1 ELSE 0 END)" FROM customer""")
_named("name_group", "SELECT count(*) FROM customer GROUP BY M1", f'SELECT {RULE} AS "wealth [predicted]", count(*) AS "count(*)" FROM customer GROUP BY 1')
_named("name_group_agg", "SELECT max(customer.c_acctbal) FROM customer GROUP BY customer.c_mktsegment", 'SELECT c_mktsegment, round(max(c_acctbal), 4) AS "max(c_acctbal)" FROM customer GROUP BY 1', 4)
_named("filter_bool_literal", "SELECT count(*) FROM nulls WHERE nulls.pos == 'False'", 'SELECT count(*) AS "count(*)" FROM customer WHERE NOT c_acctbal > 0')
_named("filter_null_order", "SELECT nulls.c_custkey FROM nulls WHERE nulls.segment >= 'HOUSEHOLD'", "SELECT c_custkey FROM customer WHERE c_mktsegment >= 'HOUSEHOLD'")
_named("filter_date", "SELECT orders.o_orderkey FROM orders WHERE orders.o_orderdate >= '1995-06-01' AND orders.o_orderdate < '1996-01-01 00:00:00'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
_named("filter_date_eq", "SELECT count(*) FROM orders WHERE orders.o_orderdate != '1995-06-01'", "SELECT count(*) AS \"count(*)\" FROM orders WHERE o_orderdate <> TIMESTAMP '1995-06-01'")

@_own("group_case_rows_by_key", "SELECT c_mktsegment, c_custkey, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS \"CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END\" FROM customer")
def _(spark, sf_dir):
    """Rows of groups carry the key that the catalog names."""
    catalog = Catalog(spark, tables(spark, sf_dir).paths, keys={"customer": ("c_custkey",)})
    return run_query("SELECT CASE WHEN customer.c_acctbal < 0 THEN 1 ELSE 0 END FROM customer GROUP BY customer.c_mktsegment", catalog)


_REFUSED = ["SELECT t.* FROM t GROUP BY t.k", "SELECT t.v FROM t GROUP BY t.k", "SELECT M1 FROM t", "SELECT CASE WHEN M1 == 1 THEN 1 ELSE 0 END FROM t GROUP BY t.k\nM1: a, rule", "SELECT t.v FROM t WHERE t.v == 1 OR t.k == 1", "SELECT mean(t.*) FROM t", "SELECT sum(M1) FROM t\nM1: b, rule"]


@_own("refused_queries", "SELECT unnest(range(7)) AS query, true AS refused")
def _(spark, sf_dir):
    t = Catalog(spark, frames={"t": spark.range(3).selectExpr("id AS k", "id AS v")})
    models, out = Registry({"a": RuleModel("y", ("k",), "k"), "b": RuleModel("y", ("absent",), "absent")}), []
    for k, text in enumerate(_REFUSED):
        try:
            run_query(text, t, models)
            out.append((k, False))
        except ValueError:
            out.append((k, True))
    return spark.createDataFrame(out, "query long, refused boolean")


# ---- programs and guards --------------------------------------------------------------------

#: lineitem with the priority of its order, wrong in places: a program of one branch an order.
_BIG = """WITH big AS (
  SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN (l_orderkey * 7 + l_linenumber) % 197 = 0 THEN 'none' ELSE o_orderpriority END AS priority FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), counts AS (SELECT l_orderkey, priority, count(*) AS n FROM big GROUP BY ALL
), ranked AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey) AS support, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, priority) AS k FROM counts
), checked AS (SELECT b.*, r.priority AS expected, r.priority IS NOT NULL AND r.priority <> b.priority AS alert FROM big b LEFT JOIN (SELECT * FROM ranked WHERE k = 1 AND n / support > 0.5 AND support > 1) r USING (l_orderkey)
)
"""


def _big(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Program]:
    t = tables(spark, sf_dir)
    wrong = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 197 == 0
    # by a shuffle: orders grow with lineitem, and the size of their compressed file says little of a broadcast's memory
    df = t.load("lineitem").join(t.load("orders").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_quantity", F.when(wrong, "none").otherwise(F.col("o_orderpriority")).alias("priority"))
    return df, Program([fit(df, ["l_orderkey"], "priority", 0.5, 1)])


_LENGTHS = {"ignore": "length(priority)", "coerce": "CASE WHEN NOT alert THEN length(priority) END", "rectify": "length(coalesce(expected, priority))"}


@_own("guard_large_program", _BIG + " UNION ALL ".join(f"SELECT '{m}' AS mode, sum({v})::BIGINT AS v, count({v}) AS n, count(*) FILTER (alert) > 0 AS refused FROM checked" for m, v in _LENGTHS.items()))
def _(spark, sf_dir):
    """Guards with a program of thousands of branches."""
    df, program = _big(spark, sf_dir)
    model = RuleModel("y", ("priority",), "length(priority)")
    try:
        guarded(df, model, Guard("raise", program), "y")
        refused = False
    except ValueError:
        refused = True
    parts = [guarded(df, model, Guard(m, program), "y").agg(F.lit(m).alias("mode"), F.sum("y").cast("long").alias("v"), F.count("y").alias("n"), F.lit(refused).alias("refused")) for m in _LENGTHS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_own("alerts_large_program", _BIG + "SELECT l_orderkey, l_linenumber, priority, expected FROM checked WHERE alert")
def _(spark, sf_dir):
    df, program = _big(spark, sf_dir)
    return row_errors(df, program).select("l_orderkey", "l_linenumber", "priority", F.col("errors")[0]["expected"].alias("expected"))


#: Two statements on one dependent: by nation, and by region, which fires where the flagged rows are few enough.
_TWO = _geo_sql() + """, counts2 AS (SELECT true_region, r_name, count(*) AS n FROM geo GROUP BY ALL
), ranked2 AS (SELECT *, sum(n) OVER (PARTITION BY true_region) AS support, row_number() OVER (PARTITION BY true_region ORDER BY n DESC, r_name) AS k FROM counts2
), branches2 AS (SELECT true_region, r_name AS expected2, n AS mode_n2, support AS support2 FROM ranked2 WHERE k = 1 AND n / support > 0.9948 AND support > 10
), both2 AS (SELECT c.*, b.expected2, coalesce(b.expected2, c.expected) AS final FROM checked c LEFT JOIN branches2 b USING (true_region))
"""


def _two(df: DataFrame) -> Program:
    p = Program()
    for s in (fit(df, ["n_name"], "r_name"), fit(df, ["true_region"], "r_name", 0.0052)):
        if s:
            p.add(s)
    return p


@_own("several_statements", _TWO + "SELECT l_orderkey, l_linenumber, final IS NOT NULL AND final <> r_name AS alert, concat_ws(',', CASE WHEN expected <> r_name THEN '0' END, CASE WHEN expected2 <> r_name THEN '1' END) AS violated, coalesce(final, r_name) AS mended FROM both2")
def _(spark, sf_dir):
    df = geo(spark, sf_dir)
    p = _two(df)
    marked = violated(alerts(df.withColumn("_own", F.col("r_name")), p), p)
    return rectified(marked, p).select("l_orderkey", "l_linenumber", "alert", F.concat_ws(",", F.transform("violated", lambda x: x.cast("string"))).alias("violated"), F.col("r_name").alias("mended"))


_TEXT = "string_agg('IF n_name = ''' || n_name || ''' THEN ''' || expected || '''', '; ' ORDER BY n_name)"


@_own("program_text", _geo_sql(97, 0.05) + f"""SELECT 'GIVEN n_name ON r_name HAVING ' || (SELECT {_TEXT} FROM (SELECT * FROM branches ORDER BY n_name LIMIT 20)) || CASE WHEN count(*) > 20 THEN '; ...' ELSE '' END AS shown,
'1 statements, ' || count(*) || ' branches, coverage ' || printf('%.1f', sum(support)::DOUBLE) || ', loss ' || sum(support - mode_n)::BIGINT AS statistics, count(*) AS cardinality, 1 AS dimensions FROM branches""")
def _(spark, sf_dir):
    p = geo_program(geo(spark, sf_dir, 97), 0.05)
    s = p.statements[0]
    return spark.createDataFrame([(str(p), p.statistics, s.cardinality, s.dimensions)], "shown string, statistics string, cardinality long, dimensions int")


@_own("coverage_of_several", _TWO + "SELECT (SELECT sum(support) FROM branches)::DOUBLE AS first, coalesce((SELECT sum(support2) FROM branches2), 0)::DOUBLE AS second, round(((SELECT sum(support) FROM branches) + coalesce((SELECT sum(support2) FROM branches2), 0)) / CASE WHEN (SELECT count(*) FROM branches2) > 0 THEN 2 ELSE 1 END, 6) AS mean")
def _(spark, sf_dir):
    p = _two(geo(spark, sf_dir))
    covered = [float(s.coverage) for s in p.statements] + [0.0]
    return spark.createDataFrame([(covered[0], covered[1], round(p.coverage, 6))], "first double, second double, mean double")


@_own("error_text", _geo_sql() + "SELECT l_orderkey, l_linenumber, 'r_name: ' || r_name || ' -> ' || expected AS shown FROM checked WHERE alert")
def _(spark, sf_dir):
    df = geo(spark, sf_dir)
    return row_errors(df, geo_program(df)).select("l_orderkey", "l_linenumber", error_text().alias("shown"))


@_own("prediction_histogram", _geo_sql() + "SELECT CASE WHEN NOT alert THEN r_name END AS value, count(*) AS n FROM checked GROUP BY 1")
def _(spark, sf_dir):
    df = geo(spark, sf_dir)
    return analysis.histogram(guarded(df, _TRUTH, Guard("coerce", geo_program(df)), "p"), "p")


@_own("relevance_noise", _geo_sql() + """SELECT count(*) FILTER (flag) AS noisy, count(*) FILTER (flag AND alert) AS noisy_alerts, count(*) FILTER (NOT flag AND alert) AS false_alerts, count(*) FILTER (flag AND r_name <> true_region) AS noisy_errors,
round(corr((r_name <> true_region)::INT, flag::INT), 6) AS error_noise, round(corr(alert::INT, flag::INT), 6) AS alert_noise, round(count(*) FILTER (alert AND r_name <> true_region) / count(*) FILTER (alert), 6) AS precision FROM checked""")
def _(spark, sf_dir):
    df = geo(spark, sf_dir)
    out = analysis.relevance(alerts(df, geo_program(df)), "r_name", "true_region", noise="flag")
    return out.select("noisy", "noisy_alerts", "false_alerts", "noisy_errors", F.round("correlation_error_noise", 6).alias("error_noise"), F.round("correlation_alert_noise", 6).alias("alert_noise"), F.round("precision", 6).alias("precision"))


_REGIONS = REGION_MODEL.replace("r_name", "coalesce(expected, r_name)")


@_own("guard_by_settings", _geo_sql() + f"SELECT n_name, round(sum({_REGIONS}), 3)::DOUBLE AS v FROM checked GROUP BY n_name")
def _(spark, sf_dir):
    """The policy comes from settings as an environment gives them."""
    df = geo(spark, sf_dir)
    settings = Settings.of_environment({"ICSPARK_MODE": "rectify", "ICSPARK_RELEVANCE": "false"})
    catalog = Catalog(spark, tables(spark, sf_dir).paths, {"geo": df})
    return run_query("SELECT sum(M4) FROM geo GROUP BY geo.n_name" + _DECLARED, catalog, _models(catalog), {"region": settings.guard(geo_program(df))}).toDF("n_name", "v").withColumn("v", F.round("v", 3))


@_own("models_by_kind", "SELECT round(sum(l_quantity * 2.0), 2) AS v FROM lineitem WHERE l_returnflag || l_linestatus = 'AF'")
def _(spark, sf_dir):
    """Two models of one path, told apart by their kind."""
    models = Registry({"linear:m": LinearModel("twice", {"l_quantity": 2.0}), "rule:m": RuleModel("flags", ("l_returnflag", "l_linestatus"), "concat(l_returnflag, l_linestatus)")})
    return run_query("SELECT sum(M1) FROM lineitem WHERE M2 == 'AF'\nM1: m, linear\nM2: m, rule", tables(spark, sf_dir), models).toDF("v").withColumn("v", F.round("v", 2))


@_own("trained_model", "SELECT r_name AS predicted, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(spark, sf_dir):
    """A classifier trained with balanced classes on a rule without exceptions, saved and found again by its path."""
    t = tables(spark, sf_dir)
    places = t.load("nation").join(t.load("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    at = _folder(spark)
    save(spark, train(places.select("n_name", "r_name"), "r_name", balanced=True), at, Program([fit(places, ["n_name"], "r_name", 0.01, 0)]))
    model, program = load(spark, at)
    rows = t.load("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    out = run_query(f"SELECT count(*) FROM shops GROUP BY M1\nM1: {at}, mllib", Catalog(spark, frames={"shops": rows}), Registry(spark=spark, programs={at: program}), {at: Guard("coerce", program)})
    return out.toDF("predicted", "n")


# ---- structure ------------------------------------------------------------------------------

_THREE = ("l_returnflag", "l_linestatus", "l_linenumber")


def _chi2_sql(a: str, b: str, given: str = "") -> str:
    g, by = (f", {given}", f"PARTITION BY {given}") if given else ("", "")
    also = f"{by}, " if by else "PARTITION BY "
    per = f"GROUP BY {given}" if given else ""
    return f"""SELECT '{a}' AS a, '{b}' AS b, '{given}' AS given, round(sum(stat), 4) AS stat, sum(df)::BIGINT AS df FROM (
  SELECT sum(n * n * total / (r * c)) - any_value(total) AS stat, (count(DISTINCT {a}) - 1) * (count(DISTINCT {b}) - 1) AS df FROM (
    SELECT *, sum(n) OVER ({by})::DOUBLE AS total, sum(n) OVER ({also}{a}) AS r, sum(n) OVER ({also}{b}) AS c FROM (SELECT {a}, {b}{g}, count(*) AS n FROM lineitem GROUP BY ALL)) {per})"""


_TESTS = [("l_linenumber", "l_linestatus", ()), ("l_linestatus", "l_returnflag", ()), ("l_linenumber", "l_linestatus", ("l_returnflag",))]
_CHI2 = " UNION ALL ".join(_chi2_sql(a, b, ",".join(g)) for a, b, g in _TESTS)


@_own("ci_chi2", _CHI2)
def _(spark, sf_dir):
    counts = structure.Counts(tables(spark, sf_dir).load("lineitem"), list(_THREE))
    rows = [(a, b, ",".join(g), *counts.chi2(a, b, g)) for a, b, g in _TESTS]
    return spark.createDataFrame([(*r[:3], round(r[3], 4), r[4]) for r in rows], "a string, b string, given string, stat double, df long")


@_own("ci_chi2_distributed", _CHI2)
def _(spark, sf_dir):
    """The same tests as beyond the bound of joint cells: sums alone reach the driver."""
    counts = structure.Counts(tables(spark, sf_dir).load("lineitem"), list(_THREE))
    counts.joint = None
    rows = [(a, b, ",".join(g), *counts.chi2(a, b, g)) for a, b, g in _TESTS]
    return spark.createDataFrame([(*r[:3], round(r[3], 4), int(r[4])) for r in rows], "a string, b string, given string, stat double, df long")


#: A pair is dependent where its statistic is beyond the 95th percentile, by the cube-root approximation.
_DEPENDENT = "(pow(stat / df, 1.0 / 3) - (1 - 2.0 / (9 * df))) / sqrt(2.0 / (9 * df)) > 1.6448536"
_PAIRED = [("l_linenumber", "l_linestatus"), ("l_linestatus", "l_returnflag"), ("l_linenumber", "l_returnflag")]


@_own("pc_edges", f"SELECT a, b, {_DEPENDENT} AS edge FROM (" + " UNION ALL ".join(_chi2_sql(a, b) for a, b in _PAIRED) + ")")
def _(spark, sf_dir):
    df = tables(spark, sf_dir).load("lineitem")
    return spark.createDataFrame([(a, b, bool(structure.pc(df.select(a, b), [a, b]).edges)) for a, b in _PAIRED], "a string, b string, edge boolean")


def _bdeu_sql(node: str, parent: str = "") -> str:
    """The score of node given parent, from counts."""
    states = f"(SELECT count(DISTINCT {node}) FROM lineitem)"
    q = f"(SELECT count(DISTINCT {parent}) FROM lineitem)" if parent else "1"
    cells, configurations = (f"SELECT count(*) AS n FROM lineitem{' GROUP BY ' + x if x else ''}" for x in (f"{node}, {parent}" if parent else node, parent))
    return f"""((SELECT sum(lgamma(1.0 / ({q} * {states}) + n) - lgamma(1.0 / ({q} * {states}))) FROM ({cells}))
 + (SELECT sum(lgamma(1.0 / {q}) - lgamma(1.0 / {q} + n)) FROM ({configurations})))"""


_SCORES = [("l_returnflag", ()), ("l_returnflag", ("l_linestatus",)), ("l_linenumber", ("l_linestatus",))]


@_own("bdeu_score", " UNION ALL ".join(f"SELECT '{n}' AS node, '{','.join(p)}' AS parents, round({_bdeu_sql(n, *p)}, 4) AS score" for n, p in _SCORES))
def _(spark, sf_dir):
    counts = structure.Counts(tables(spark, sf_dir).load("lineitem"), list(_THREE))
    return spark.createDataFrame([(n, ",".join(p), round(structure.bdeu(counts, n, p), 4)) for n, p in _SCORES], "node string, parents string, score double")


@_own("bdeu_score_distributed", ORACLE_SQL["bdeu_score"])
def _(spark, sf_dir):
    """The same scores from histograms of counts."""
    counts = structure.Counts(tables(spark, sf_dir).load("lineitem"), list(_THREE))
    counts.joint = None
    return spark.createDataFrame([(n, ",".join(p), round(structure.bdeu(counts, n, p), 4)) for n, p in _SCORES], "node string, parents string, score double")


_BEST_EDGE = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_bdeu_sql(b, a)} > {_bdeu_sql(b)} + 1e-9 AS edge" for a, b in _PAIRED)


def _learned_edges(learn):
    def run(spark, sf_dir):
        df = tables(spark, sf_dir).load("lineitem")
        return spark.createDataFrame([(a, b, bool(learn(df.select(a, b), [a, b]).edges)) for a, b in _PAIRED], "a string, b string, edge boolean")

    return run


_own("score_edges", _BEST_EDGE)(_learned_edges(structure.score_search))
_own("order_edges", _BEST_EDGE)(_learned_edges(structure.order_search))


@_own("member_dags", "SELECT n, factorial(n::INT)::BIGINT AS of_complete, n AS of_path, 0::BIGINT AS cyclic FROM (SELECT unnest(range(2, 6)) AS n)")
def _(spark, sf_dir):
    """How many DAGs are equivalent to a complete one, an order each, and to a path without collider, a root each."""
    out = []
    for n in range(2, 6):
        nodes = [f"x{k}" for k in range(n)]
        whole = structure.Graph(nodes, {frozenset(p) for p in itertools.combinations(nodes, 2)})
        path = structure.equivalence_class(structure.Graph(nodes, set(), set(itertools.pairwise(nodes))))
        found = list(structure.member_dags(whole))
        out.append((n, len({frozenset(g.arcs) for g in found}), len(list(structure.member_dags(path))), sum(not g.acyclic() for g in found)))
    return spark.createDataFrame(out, "n long, of_complete long, of_path long, cyclic long")


_LINES = ["a -> c", "b -> c", "c -- d", "e"]


@_own("graph_exchange", "SELECT unnest(['a -> c', 'b -> c', 'c -> d', 'e', 'refused a <-> b', 'refused d -> a']) AS line")
def _(spark, sf_dir):
    """A class read from text, turned into a DAG, written as text; what is no DAG is refused."""
    g = structure.Graph.of_lines(_LINES).of_edges([("c", "d")])
    out = g.lines()
    for line in ("a <-> b", "d -> a"):
        try:
            structure.Graph.of_lines([*g.lines(), line])
            out.append(line)
        except ValueError:
            out.append(f"refused {line}")
    return spark.createDataFrame([(x,) for x in out], "line string")


_WIDE = ["c_custkey", "c_name", "c_acctbal", "nullif(c_mktsegment, 'BUILDING') AS segment", "c_nationkey % 10 AS nation", "c_custkey % 3 AS third"]


@_own("encode_wide", "SELECT (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS segment, (dense_rank() OVER (ORDER BY c_nationkey % 10) - 1)::INT AS nation, (dense_rank() OVER (ORDER BY c_custkey % 3) - 1)::INT AS third FROM customer WHERE c_mktsegment <> 'BUILDING' AND (SELECT count(*) FROM customer) > 400")
def _(spark, sf_dir):
    """Wide columns go, then rows with a null; tables of 400 rows or fewer keep wide columns and aren't compared."""
    out = structure.encode(tables(spark, sf_dir).load("customer").selectExpr(*_WIDE))
    return out if len(out.columns) == 3 else out.select("segment", "nation", "third").limit(0)


_COVERED = _geo_sql() + "SELECT {} FROM (SELECT n_name, count(*) AS n FROM geo GROUP BY n_name HAVING count(*) > 10)"


@_own("search_program", _COVERED.format("'n_name' AS determinants, 'true_region' AS dependent, sum(n)::BIGINT AS coverage, 0::BIGINT AS loss, count(*) AS branches, true AS kept_graph"))
def _(spark, sf_dir):
    """Learn, keep the graph, search once more from the kept graph."""
    df = geo(spark, sf_dir).select("l_orderkey", "l_linenumber", "n_name", "true_region")
    with tempfile.TemporaryDirectory() as at:
        first, again = (Search(keep_false=True, graph_path=f"{at}/graph.json") for _ in range(2))
        one, two = (s.run(df, ["l_orderkey", "l_linenumber"]) for s in (first, again))
    kept = one == two and first.seconds is not None and again.seconds is None
    return spark.createDataFrame([(",".join(s.determinants), s.dependent, s.coverage, s.loss, s.cardinality, kept) for s in two.statements], "determinants string, dependent string, coverage long, loss long, branches long, kept_graph boolean")


@_own("sampler_ablation", _geo_sql() + "SELECT unnest(['identity', 'shift']) AS sampler, (SELECT round(sum(n) FILTER (n > 10) / sum(n), 6) FROM (SELECT n_name, count(*) AS n FROM geo GROUP BY n_name)) AS share")
def _(spark, sf_dir):
    df = geo(spark, sf_dir).select("l_orderkey", "l_linenumber", "n_name", "true_region")
    return spark.createDataFrame([(k, round(v, 6)) for k, v in sampler_ablation(df, ["l_orderkey", "l_linenumber"], keep_false=True).items()], "sampler string, share double")


@_own("bounded_sample", "SELECT count(*) AS whole, true AS cut FROM orders")
def _(spark, sf_dir):
    """A table below the bound is whole; beyond it about as many rows stay as the bound says."""
    import warnings

    df = tables(spark, sf_dir).load("orders")
    rows = df.count()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        few = structure.bounded(df, rows // 2).count()
    return spark.createDataFrame([(structure.bounded(df).count(), 0.4 * rows < few < 0.6 * rows)], "whole long, cut boolean")


# ---- noise ----------------------------------------------------------------------------------

_KEY = ("l_orderkey", "l_linenumber")
_INJECTED = _geo_sql() + f""", domain AS (SELECT r_name AS value, row_number() OVER (ORDER BY r_name) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT r_name FROM geo)
), drawn AS (SELECT *, expected IS NOT NULL AND {_draw_sql(42, *_KEY)} / 4503599627370496.0 < 0.05 AS injected, {_draw_sql(44, *_KEY)} % (SELECT count(*) FROM domain) AS slot FROM checked
), harmed AS (SELECT d.l_orderkey, d.l_linenumber, d.r_name AS was, injected, CASE WHEN NOT injected THEN d.r_name WHEN a.value <> d.r_name THEN a.value ELSE b.value END AS r_name
  FROM drawn d JOIN domain a ON a.i = d.slot JOIN domain b ON b.i = (d.slot + 1) % b.n)
"""


def _injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = geo(spark, sf_dir).withColumn("was", F.col("r_name"))
    return noise.inject(df, geo_program(df), list(_KEY), 0.05)


@_own("noise_inject", _INJECTED + "SELECT l_orderkey, l_linenumber, r_name, injected FROM harmed")
def _(spark, sf_dir):
    return _injected(spark, sf_dir).select(*_KEY, "r_name", "injected")


@_own("noise_flags", _INJECTED + "SELECT injected, count(*) AS n, count(*) FILTER (r_name <> was) AS changed FROM harmed GROUP BY injected")
def _(spark, sf_dir):
    return _injected(spark, sf_dir).groupBy("injected").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("r_name") != F.col("was"), 1)).alias("changed"))


@_own("correct_rows", _geo_sql() + "SELECT l_orderkey, l_linenumber FROM geo WHERE r_name = true_region")
def _(spark, sf_dir):
    return noise.correct_rows(geo(spark, sf_dir), _TRUTH, "true_region").select(*_KEY)


@_own("ground_truth", _geo_sql() + "SELECT l_orderkey, l_linenumber, r_name, CASE WHEN expected IS NOT NULL THEN 'r_name' ELSE '' END AS controllable FROM checked WHERE r_name = true_region")
def _(spark, sf_dir):
    df = geo(spark, sf_dir)
    return noise.ground_truth(df, geo_program(df), _TRUTH, "true_region").select(*_KEY, "r_name", F.array_join("controllable", ",").alias("controllable"))


# ---- miners and evaluation ------------------------------------------------------------------

_FOUR = sorted([*_FD_COLUMNS, "r_name"])


def _fds_sql() -> str:
    """Every minimal dependency of the four columns, from distinct counts."""
    sets = [s for n in range(1, 5) for s in itertools.combinations(_FOUR, n)]
    counts = ", ".join(f"count(DISTINCT ({', '.join(s)})) AS d{k}" for k, s in enumerate(sets))
    d = {s: f"d{k}" for k, s in enumerate(sets)}
    holds = lambda left, right: f"{d[left]} = {d[tuple(sorted((*left, right)))]}"
    rows = []
    for n in (1, 2, 3):
        for left in itertools.combinations(_FOUR, n):
            for right in sorted(set(_FOUR) - set(left)):
                smaller = [holds(s, right) for m in range(1, n) for s in itertools.combinations(left, m)]
                rows.append(f"SELECT '{','.join(left)}' AS lhs, '{right}' AS rhs FROM d WHERE {holds(left, right)}" + "".join(f" AND NOT ({x})" for x in smaller))
    return _geo_sql() + f", d AS (SELECT {counts} FROM geo) " + " UNION ALL ".join(rows)


@_own("fd_lattice", _fds_sql())
def _(spark, sf_dir):
    found = miners.functional_dependencies(geo(spark, sf_dir), _FOUR)
    return spark.createDataFrame([(",".join(l_), r) for l_, r in found], "lhs string, rhs string")


@_own("fd_program", _geo_sql() + "SELECT n_name, true_region AS expected, sum(count(*)) OVER ()::BIGINT AS coverage, 0::BIGINT AS loss FROM geo GROUP BY n_name, true_region")
def _(spark, sf_dir):
    (s,) = miners.fd_program(geo(spark, sf_dir), _FD_COLUMNS).statements
    return spark.createDataFrame([(b.when["n_name"], b.value, s.coverage, s.loss) for b in s.branches], "n_name string, expected string, coverage long, loss long")


@_own("fd_candidates", "SELECT n, (n * (pow(2, n - 1) - 1))::BIGINT AS candidates FROM (SELECT unnest(range(1, 20)) AS n)")
def _(spark, sf_dir):
    return spark.createDataFrame([(n, miners.candidate_count(n)) for n in range(1, 20)], "n long, candidates long")


@_own("partition_classes", "SELECT c_mktsegment, c_nationkey, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) AS size, c_custkey FROM customer QUALIFY count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) > 1")
def _(spark, sf_dir):
    return miners.partition_classes(tables(spark, sf_dir).load("customer"), ["c_mktsegment", "c_nationkey"], ["c_custkey"])


_CFDS = ["(l_linestatus=F) => l_returnflag=A", "no rule", "(l_quantity=10-20,l_returnflag=R) => l_linestatus=F", "(absent=1) => l_returnflag=A", "(l_returnflag=A) => absent=1"]


@_own("cfd_apply", "SELECT cfd_error, count(*) AS n FROM (SELECT concat_ws(', ', CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'A' THEN 'CFD_1' END, CASE WHEN l_quantity BETWEEN 10 AND 20 AND l_returnflag = 'R' AND l_linestatus <> 'F' THEN 'CFD_3' END) AS cfd_error FROM lineitem) GROUP BY 1")
def _(spark, sf_dir):
    """Rules of a file, numbered by line; a line that is no rule is passed over."""
    import warnings

    with tempfile.TemporaryDirectory() as at, warnings.catch_warnings():
        warnings.simplefilter("ignore")
        Path(at, "rules.txt").write_text("\n".join(_CFDS))
        rules = miners.read_cfds(f"{at}/rules.txt")
    return miners.apply_cfds(tables(spark, sf_dir).load("lineitem"), rules).groupBy("cfd_error").agg(F.count(F.lit(1)).alias("n"))


#: Covariances of two boolean columns, their soft-thresholded matrix and its inverse.
_THETA = """, s AS (SELECT var_samp(a::INT) AS s11, covar_samp(a::INT, b::INT) AS s12, var_samp(b::INT) AS s22 FROM ab
), w AS (SELECT *, s11 + 0.001 AS w11, s22 + 0.001 AS w22, sign(s12) * greatest(abs(s12) - 0.001, 0) AS w12 FROM s
), theta AS (SELECT *, w22 / (w11 * w22 - w12 * w12) AS t11, -w12 / (w11 * w22 - w12 * w12) AS t12, w11 / (w11 * w22 - w12 * w12) AS t22 FROM w)
"""


@_own("graphical_lasso", _PAIRS.rstrip() + ", ab AS (SELECT o_orderstatus AS a, o_orderpriority AS b FROM p)" + _THETA + "SELECT round(s11, 6) AS s11, round(s12, 6) AS s12, round(s22, 6) AS s22, round(t11, 4) AS t11, round(t12, 4) + 0.0 AS t12, round(t22, 4) AS t22 FROM theta")
def _(spark, sf_dir):
    s = miners.covariance(_pairs(spark, sf_dir), _BOTH)
    t = miners.graphical_lasso(s, 0.001)
    cells = [round(float(x), n) + 0.0 for m, n in ((s, 6), (t, 4)) for x in (m[0, 0], m[0, 1], m[1, 1])]
    return spark.createDataFrame([tuple(cells)], "s11 double, s12 double, s22 double, t11 double, t12 double, t22 double")


_NEXT = "{c} = coalesce(lead({c}) OVER w, first_value({c}) OVER w)"
_GEO_PAIRS = _geo_sql() + ", ab AS (" + " UNION ALL ".join(f"SELECT {_NEXT.format(c='n_name')} AS a, {_NEXT.format(c='true_region')} AS b FROM geo WINDOW w AS (ORDER BY {c}, l_orderkey, l_linenumber)" for c in ("n_name", "true_region")) + ")"


@_own("lasso_program", _GEO_PAIRS + _THETA + "SELECT 'n_name' AS determinants, 'true_region' AS dependent, (SELECT count(*) FROM geo) AS coverage, 0::BIGINT AS loss FROM theta WHERE abs(t12 / t22) >= 0.02")
def _(spark, sf_dir):
    p = miners.lasso_program(geo(spark, sf_dir), list(_KEY), ["n_name", "true_region"], penalty=0.001, least=0.02)
    return spark.createDataFrame([(",".join(s.determinants), s.dependent, s.coverage, s.loss) for s in p.statements], "determinants string, dependent string, coverage long, loss long")


_CHOSEN = """, found AS (SELECT n_name, support, support - n AS lost, row_number() OVER (ORDER BY n_name) AS i FROM ranked WHERE k = 1 AND r_name IS NOT NULL AND support - n <= (SELECT 0.01 * count(*) FROM geo)
), sets AS (SELECT a.support + b.support + c.support + d.support AS coverage, a.lost + b.lost + c.lost + d.lost AS loss FROM found a JOIN found b ON a.i < b.i JOIN found c ON b.i < c.i JOIN found d ON c.i < d.i)
"""


@_own("bounded_search", _geo_sql(97) + _CHOSEN + "SELECT 'r_name' AS dependent, coverage::BIGINT AS coverage, loss::BIGINT AS loss FROM sets WHERE loss <= floor((SELECT 0.01 * count(*) FROM geo)) ORDER BY coverage DESC, loss LIMIT 1")
def _(spark, sf_dir):
    """The best four branches at a bounded loss, against every choice of four."""
    p = miners.bounded_search(geo(spark, sf_dir, 97), ["n_name", "r_name"], best_only=True)
    return spark.createDataFrame([(s.dependent, s.coverage, s.loss) for s in p.statements], "dependent string, coverage long, loss long")


@_own("error_reduction", "SELECT round(avg(d), 6) AS mean_reduction, round(stddev_pop(d), 6) AS std_reduction FROM (SELECT coalesce(CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END, 0) - s_acctbal / 2 AS d FROM supplier)")
def _(spark, sf_dir):
    errors = tables(spark, sf_dir).load("supplier").selectExpr("CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS plain", "s_acctbal / 2 AS mended")
    return analysis.error_reduction(errors, "plain", "mended").select(*[F.round(c, 6).alias(c) for c in ("mean_reduction", "std_reduction")])


@_own("min_max", ORACLE_SQL["epsilon_sweep"].replace("SELECT e.eps, count(k)", ", swept AS (SELECT e.eps, count(k)") + ") SELECT eps, round(CASE WHEN max(coverage) OVER () > min(coverage) OVER () THEN (coverage - min(coverage) OVER ()) / (max(coverage) OVER () - min(coverage) OVER ()) ELSE 0 END, 9)::DOUBLE AS scaled FROM swept")
def _(spark, sf_dir):
    rows = sorted((r["eps"], r["coverage"]) for r in QUERIES["epsilon_sweep"](spark, sf_dir).collect())
    return spark.createDataFrame([(e, round(v, 9)) for (e, _), v in zip(rows, analysis.min_max([c for _, c in rows]))], "eps double, scaled double")


@_own("read_any", "SELECT 'csv' AS kind, count(*) AS n FROM region UNION ALL SELECT 'parquet', count(*) FROM nation")
def _(spark, sf_dir):
    path = f"{_folder(spark)}/region.csv"
    write_table(tables(spark, sf_dir).load("region"), path)
    parts = [read_table(spark, x).agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n")) for k, x in (("csv", path), ("parquet", f"{sf_dir}/nation.parquet"))]
    return parts[0].unionByName(parts[1])
