import datetime
import decimal
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from icspark import cli
from icspark.operators import analysis, miners, noise, structure
from icspark.operators.guard import Guard, Settings, guarded
from icspark.operators.models import ArrowModel, LinearModel, Registry, RuleModel, load, save, train
from icspark.operators.program import Branch, Program, Statement, alerts, detection, error_text, fit, loss, rectified, row_errors, violated
from icspark.operators.search import Search
from icspark.plans.grammar import QueryError
from icspark.plans.planner import run_query
from icspark.sources.catalog import Catalog, markdown, read_csv, write_table
from icspark.sources.staging import ranked

SF = "/root/testdata/sf0.001"
#: The row of the table `places` that breaks its rule.
WRONG = 25 * 40


@pytest.fixture(scope="module")
def places(spark):
    """Each nation with its region 40 times, and once with a wrong one."""
    nation, region = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("nation", "region"))
    pairs = sorted((r.n_name, r.r_name) for r in nation.join(region, nation.n_regionkey == region.r_regionkey).collect())
    name, home = pairs[0]
    rows = pairs * 40 + [(name, next(r for _, r in pairs if r != home))]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, n_name string, r_name string").cache()


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "a", 1.0, True), (2, None, 2.0, False), (3, "b", None, None), (4, "a", 4.0, True)], "id long, s string, x double, f boolean")


def catalog(spark, df):
    return Catalog(spark, frames={"t": df})


def ids(df):
    return sorted(r.id for r in df.collect())


def test_null_matrix(spark, rows):
    c = catalog(spark, rows)
    ask = lambda w: ids(run_query(f"SELECT t.* FROM t WHERE {w}", c))
    assert ask("t.s == 'a'") == [1, 4]
    assert ask("t.s != 'a'") == [2, 3]
    assert ask("t.x > 1") == [2, 4]
    assert ask("t.id == '1'") == [] and ask("t.id != '1'") == [1, 2, 3, 4]
    assert ask("t.f == 'False'") == [2] and ask("t.f == true") == [1, 4]
    with pytest.raises(TypeError):
        ask("t.id > '1'")


def test_aggregates_and_groups(spark, rows):
    c = catalog(spark, rows)
    assert run_query("SELECT count(t.s) FROM t", c).first()[0] == 4
    assert run_query("SELECT sum(t.x) FROM t WHERE t.id > 9", c).first()[0] == 0
    assert dict(map(tuple, run_query("SELECT count(*) FROM t GROUP BY t.s", c).collect())) == {"a": 2, "b": 1}
    out = run_query("SELECT mean(M1) FROM t GROUP BY M1 ! 1\nM1: m, linear", c, Registry({"m": LinearModel("y", {"x": 1.0})}))
    assert dict(map(tuple, out.collect())) == {"> 1": 3.0, "<= 1": 1.0, "NaN": None}
    for bad in ("SELECT t.* FROM t GROUP BY t.s", "SELECT t.nope FROM t"):
        with pytest.raises(QueryError):
            run_query(bad, c)


def test_empty_after_filter_keeps_columns(spark, rows):
    out = run_query("SELECT t.* FROM t WHERE t.id > 99 AND t.id > 100", catalog(spark, rows))
    assert out.columns == rows.columns and out.count() == 0


def test_opaque_model_runs_once(spark, rows):
    model = ArrowModel("y", ("id",), lambda p: p["id"] * 2.0)
    out = run_query("SELECT mean(M1) FROM t WHERE t.id > 1 AND M1 > 4 GROUP BY M1\nM1: m, udf", catalog(spark, rows), Registry({"m": model}))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert sorted(r[1] for r in out.collect()) == [6.0, 8.0]


def test_fit_detect_and_mend(places):
    s = fit(places, ["n_name"], "r_name", 0.05, 10)
    assert (s.cardinality, s.coverage, s.loss) == (25, 1001, 1)
    assert fit(places, ["n_name"], "r_name", 0.01, 10).cardinality == 24  # one row of 41 is too much
    assert fit(places, ["r_name"], "n_name", 0.1, 10) is None
    p = Program([s])
    (error,) = row_errors(places, p).withColumn("shown", error_text()).collect()
    assert error.id == WRONG and error.shown == f"r_name: {error.r_name} -> {error.errors[0].expected}"
    assert Program.from_json(p.to_json()) == p
    mended = rectified(places, p)
    assert mended.groupBy("n_name").agg(F.countDistinct("r_name").alias("n")).where("n > 1").isEmpty()
    assert alerts(mended, p).where("alert").count() == 0  # repair settles
    assert violated(places, p).where(F.size("violated") > 0).count() == 1


def test_typed_json():
    cells = [datetime.date(2020, 1, 2), datetime.datetime(2020, 1, 2, 3, 4, 5), decimal.Decimal("1.50"), b"\x00\xff", None, True, 3, 2.5, "2020-01-02"]
    p = Program([Statement(("a",), "b", tuple(Branch({"a": v}, v) for v in cells), 9, 0)])
    again = Program.from_json(p.to_json())
    assert again == p and [type(b.value) for b in again.statements[0].branches] == [type(v) for v in cells]


def test_search_finds_one_statement(places):
    p = Search(0.1, 10, "pc", keep_false=True).run(places, ["id"])
    assert [(s.determinants, s.dependent) for s in p.statements] == [(("n_name",), "r_name")]


def test_chain_equals_lookup(spark):
    df = spark.createDataFrame([(k % 150 if k % 7 else None, str(k % 150 + (k == 33)), k) for k in range(600)], "a int, b string, id long")
    big = fit(df, ["a"], "b", 0.5, 0)
    assert big.cardinality > 100
    halves = Program([Statement(big.determinants, "b", big.branches[:80]), Statement(big.determinants, "b", big.branches[80:])])
    assert ids(alerts(df, Program([big])).where("alert")) == ids(alerts(df, halves).where("alert")) == [33]


def test_more_branches_than_the_driver_holds(spark, monkeypatch):
    """A statement of a table says what one of branches says, whatever is asked of it."""
    df = spark.createDataFrame([(k % 150 if k % 7 else None, k % 3, str(k % 150 + (k == 33)) if k % 11 else None, k) for k in range(900)], "a int, g int, b string, id long")
    held = fit(df, ["a", "g"], "b", 0.5, 0)
    monkeypatch.setattr("icspark.operators.program.MOST_BRANCHES", 20)
    far = fit(df, ["a", "g"], "b", 0.5, 0)
    p, q, model = Program([held]), Program([far]), RuleModel("y", ("b",), "length(b)")
    assert held.cardinality > 100 and far.branches == () and tuple(far.listed()) == held.branches
    assert (far.cardinality, far.coverage, far.loss, far.dimensions, str(far), q.statistics) == (held.cardinality, held.coverage, held.loss, 2, str(held), p.statistics)
    assert Program.from_json(q.to_json()) == p and loss(df, far) == loss(df, held)
    for f in (alerts, rectified, row_errors, violated, noise.controllable):
        same = lambda program: sorted(map(str, f(df, program).collect()))  # noqa: B023, E731
        assert same(q) == same(p) == same(Program.from_json(q.to_json()))
    for mode in ("ignore", "coerce", "rectify"):
        assert sorted(map(str, guarded(df, model, Guard(mode, q), "y").collect())) == sorted(map(str, guarded(df, model, Guard(mode, p), "y").collect()))
    with pytest.raises(ValueError, match="violate"):
        guarded(df, model, Guard("raise", q), "y")


def test_a_table_of_branches_is_not_broadcast(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("icspark.operators.program.MOST_BRANCHES", 20)
    spark.range(200).selectExpr("id % 50 AS a", "id % 50 AS b").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    made = alerts(df, Program([fit(df, ["a"], "b", 0.5, 0)]))
    assert made.where("alert").isEmpty() and "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_later_statement_wins_and_nulls(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, "q")], "id long, a string, b string")
    p = Program([Statement(("a",), "b", (Branch({"a": "x"}, "one"),)), Statement(("a",), "b", (Branch({"a": "x"}, "two"),))])
    assert [r.b for r in rectified(df, p).orderBy("id").collect()] == ["two", "q"]
    assert ids(alerts(df, p).where("alert")) == [1]


def test_guards(spark, places):
    p = Program([fit(places, ["n_name"], "r_name", 0.05)])
    m = RuleModel("y", ("r_name",), "lower(r_name)")
    at = lambda df: df.where(f"id = {WRONG}").first()
    value = lambda g: at(guarded(places, m, g, "y"))
    wrong, right = at(places).r_name.lower(), at(rectified(places, p)).r_name.lower()
    assert value(Guard()).y == wrong
    assert value(Guard("coerce", p)).y is None
    assert value(Guard("rectify", p)).y == right and value(Guard("rectify", p)).r_name.lower() == wrong  # the row itself is unchanged
    assert value(Guard("coerce", p, disabled=True)).y == wrong
    with pytest.raises(ValueError):
        value(Guard("raise", p))
    with pytest.raises(ValueError):
        Guard("coerce")
    with pytest.warns(UserWarning, match="1 of 1001 rows"):
        assert value(Guard("ignore", p, watch=True)).y == wrong


def test_settings():
    assert Settings.of_environment({}) == Settings()
    assert Settings.of_environment({"ICSPARK_MODE": "Coerce", "ICSPARK_DISABLED": "true", "ICSPARK_RELEVANCE": "0", "ICSPARK_COMPARATIVE": "1", "ICSPARK_RECORDS": "x"}) == Settings("coerce", True, False, True, "x")


def test_noise(places):
    p = Program([fit(places, ["n_name"], "r_name", 0.05)])
    out = noise.inject(places, p, ["id"], 0.2).cache()
    n = out.where("injected").count()
    assert 130 < n < 270
    t = detection(alerts(out, p), "injected").first()
    assert t.tp >= n - 1 and t.fn <= 1 and t.fp <= 1  # the wrong row may be set right
    a, b = noise.split(places, ["id"])
    assert a.count() + b.count() == places.count() and a.join(b, "id").count() == 0


def test_shifted_pairs(spark):
    df = spark.createDataFrame([(0, 1, 2), (1, 1, 4), (2, 3, 4), (3, 3, 2)], "id int, c0 int, c1 int")
    out = structure.shifted_pairs(df, ["id"])
    assert out.count() == 8
    for c in ("c0", "c1"):
        assert out.where((F.col("block") == c) & F.col(c)).count() == 2
    assert structure.shifted_pairs(df.limit(0), ["id"]).count() == 0


def test_graphs():
    collider = structure.Graph(["a", "b", "c"], set(), {("a", "c"), ("b", "c")})
    assert structure.equivalence_class(collider).arcs == collider.arcs
    chain = structure.equivalence_class(structure.Graph(["a", "b", "c"], set(), {("a", "b"), ("b", "c")}))
    assert len(chain.edges) == 2 and len(list(structure.member_dags(chain))) == 3
    assert not structure.Graph(["a", "b"], set(), {("a", "b"), ("b", "a")}).acyclic()
    full = structure.equivalence_class(structure.Graph(list("abcd"), set(), {(x, y) for x, y in itertools.combinations("abcd", 2)}))
    assert len(list(structure.member_dags(full))) == 24


def test_chi2():
    assert abs(structure.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(structure.chi2_sf(18.307038053275146, 10) - 0.05) < 1e-9


def test_learners_find_a_collider(spark):
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2, 3000), r.integers(0, 2, 3000)
    df = spark.createDataFrame(pd.DataFrame({"a": a == 1, "b": b == 1, "c": ((a | b) == 1) ^ (r.random(3000) < 0.05)})).cache()
    for learn in (structure.pc, structure.score_search, structure.order_search):
        assert learn(df, ["a", "b", "c"]).arcs == {("a", "c"), ("b", "c")}


def test_miners(spark):
    df = spark.createDataFrame([(k, k // 4, k // 8, k % 3) for k in range(48)], "k int, a int, b int, c int").cache()
    found = miners.functional_dependencies(df)
    want = []
    cols, pdf = ["a", "b", "c", "k"], df.toPandas()
    for size in (1, 2, 3):
        for left in itertools.combinations(cols, size):
            for r in sorted(set(cols) - set(left)):
                if not any(set(l_) <= set(left) and q == r for l_, q in want) and pdf.groupby(list(left))[r].nunique().max() == 1:
                    want.append((left, r))
    assert sorted(found) == sorted(want)
    assert miners.candidate_count(4) == 28
    cfd = miners.parse_cfd("(Age=18-21, Sex=F) => Income=Low")
    people = spark.createDataFrame([(1, 20, "F", "High"), (2, 20, "F", "Low"), (3, 40, "F", "High")], "id long, Age int, Sex string, Income string")
    assert [r.cfd_error for r in miners.apply_cfds(people, [cfd]).orderBy("id").collect()] == ["CFD_1", "", ""]


def test_lasso_and_bounded(spark, places):
    s = np.array([[1.0, 0.8, 0.0], [0.8, 1.0, 0.0], [0.0, 0.0, 1.0]])
    theta = miners.graphical_lasso(s, 1e-6)
    assert np.allclose(theta, np.linalg.inv(s), atol=1e-3)
    p = miners.bounded_search(places.select("r_name", "n_name"), ["r_name", "n_name"])
    assert max(p.statements, key=lambda x: x.coverage).dependent == "r_name" and all(x.cardinality <= 4 for x in p.statements)


def test_mllib_backend(spark):
    df = spark.createDataFrame([(float(k), "p" if k % 2 else "q", "hi" if k > 50 else "lo") for k in range(100)], "x double, g string, y string")
    m = train(df, "y", balanced=True)
    out = m.apply(df, "y [predicted]")
    assert out.where("`y [predicted]` = y").count() > 95 and out.columns == [*df.columns, "y [predicted]"]


def test_stream(spark, places, tmp_path):
    from icspark.streaming.guarded import start

    places.write.parquet(str(tmp_path / "in"))
    p = Program([fit(places, ["n_name"], "r_name", 0.05)])
    start(spark.readStream.schema(places.schema).parquet(str(tmp_path / "in")), p, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("alert").count() == 1


def test_ranked(spark):
    df = spark.createDataFrame([(k * 7 % 20, "x") for k in range(20)], "a int, b string").repartition(6)
    out, total = ranked(df, ["a"])
    assert total == 20 and all(r.a == r._i for r in out.collect())
    assert ranked(df.limit(0), ["a"])[1] == 0


def test_encode(spark):
    df = spark.createDataFrame([("b", 5), ("a", 7), (None, 7), ("c", 5)], "s string, n int")
    assert sorted(map(tuple, structure.encode(df).collect())) == [(0, 1), (1, 0), (2, 0)]


def test_counts_agree_beyond_the_joint_bound(spark, places, monkeypatch):
    near = structure.Counts(places, ["r_name", "n_name"])
    monkeypatch.setattr(structure, "MOST_CELLS", 3)
    far = structure.Counts(places, ["r_name", "n_name"])
    assert far.joint is None and near.values("n_name") == far.values("n_name") == 25 and near.histogram(("n_name", "r_name")) == far.histogram(("n_name", "r_name"))
    assert near.chi2("n_name", "r_name", ()) == pytest.approx(far.chi2("n_name", "r_name", ()))
    assert structure.bdeu(near, "r_name", ("n_name",)) == pytest.approx(structure.bdeu(far, "r_name", ("n_name",)))


def test_chi2_of_counts_whose_products_are_beyond_a_long(spark, monkeypatch):
    counts = structure.Counts(spark.createDataFrame([(0, 0)], "a int, b int"), ["a", "b"])
    cells = {(0, 0): 3_000_000_000, (0, 1): 1_000_000_000, (1, 0): 1_000_000_000, (1, 1): 3_000_000_000}
    counts.joint = list(cells.items())
    near = counts.chi2("a", "b", ())
    assert near == (pytest.approx(2e9), 1)
    counts.joint = None
    monkeypatch.setattr(counts, "cells", lambda columns: spark.createDataFrame([(*k, n) for k, n in cells.items()], "a int, b int, _n long"))
    assert counts.chi2("a", "b", ()) == (pytest.approx(near[0]), 1)


def test_identity_sampler(places):
    assert any(s.dependent in ("r_name", "n_name") for s in Search(0.1, 10, "order", sampler="identity").run(places, ["id"]).statements)
    with pytest.raises(ValueError):
        Search(sampler="none")


def test_noise_takes_another_value_of_the_column(spark, places):
    p = Program([fit(places, ["n_name"], "r_name", 0.05)])
    out = noise.inject(places, p, ["id"], 0.3).join(places.withColumnRenamed("r_name", "was"), ["id", "n_name"])
    hit = out.where("injected")
    assert hit.where("r_name = was").count() == 0 and out.where("not injected and r_name <> was").isEmpty()
    assert {r[0] for r in hit.select("r_name").distinct().collect()} <= {r[0] for r in places.select("r_name").distinct().collect()}
    one = spark.createDataFrame([(k, "a", "b") for k in range(50)], "id long, g string, h string")
    assert noise.inject(one, Program([fit(one, ["g"], "h")]), ["id"], 0.5).where("injected and h is not null").isEmpty()


def test_ground_truth(spark):
    df = spark.createDataFrame([(1, "a", "p"), (2, "a", None), (3, "b", "p")], "id long, g string, y string")
    out = noise.ground_truth(df, Program([Statement(("g",), "y", (Branch({"g": "a"}, "p"),))]), RuleModel("y", ("g",), "'p'"), "y")
    assert {r.id: r.controllable for r in out.collect()} == {1: ["y"], 3: []}


def test_lasso_program(spark, places):
    p = miners.lasso_program(places, ["id"])
    assert all(s.cardinality > 0 and s.dependent in ("r_name", "n_name") for s in p.statements)


def test_analysis(spark):
    df = spark.createDataFrame([("x", "x", True, True), ("y", "x", True, True), ("x", "x", False, None), ("y", "x", False, True)], "p string, y string, alert boolean, noisy boolean")
    r = analysis.relevance(df, "p", "y", noise="noisy").first()
    assert (r.rows, r.alerts, r.errors, r.both, r.noisy, r.noisy_alerts, r.false_alerts, r.noisy_errors) == (4, 2, 2, 1, 3, 2, 0, 2)
    e = analysis.error_reduction(spark.createDataFrame([(0.5, 0.1), (None, 0.2)], "a double, b double"), "a", "b").first()
    assert abs(e.mean_reduction - 0.1) < 1e-12 and abs(e.std_reduction - 0.3) < 1e-12
    assert analysis.min_max([2, 4, 3]) == [0, 1, 0.5] and analysis.min_max([1, 1]) == [0, 0] and analysis.min_max([]) == []


def test_saved_models_and_query_modes(spark, tmp_path, capsys):
    rows = [(k, "abc"[k % 3], "hi" if k % 3 else "lo") for k in range(150)]
    clean = spark.createDataFrame(rows, "id long, g string, y string").withColumn("h", F.col("g"))
    program = Program([fit(clean, ["h"], "g")])
    save(spark, train(clean.drop("id", "h"), "y"), str(tmp_path / "m"), program)
    model, same = load(spark, str(tmp_path / "m"))
    assert same == program and model.features == ("g",)
    noisy = clean.withColumn("g", F.when(F.col("id") % 10 == 0, "a").otherwise(F.col("g")))
    (tmp_path / "q1.sql").write_text(f"SELECT count(M1) FROM t.noisy WHERE M1 == 'hi'\nM1: {tmp_path}/m, mllib\n")
    shop = Catalog(spark, frames={"t.noisy_level_05": noisy, "t.gt": clean})
    found = cli.run_queries(spark, str(tmp_path), shop, ["ignore", "coerce", "rectify", "gt"], "05", out=str(tmp_path / "out.json"))
    count = {k.split(",")[1]: list(v[0].values())[0] for k, v in found.items()}
    assert count == {"ignore": 90, "coerce": 90, "rectify": 100, "gt": 100}
    assert (tmp_path / "out.json").exists() and "| 90 |" in capsys.readouterr().out
    with pytest.raises(KeyError):
        Registry(spark=spark).get(str(tmp_path / "none"))


def test_markdown(spark):
    assert markdown(spark.createDataFrame([("a|b", None)], "x string, y int")) == "| x | y |\n|---|---|\n| a\\|b |  |"


def test_cut_class_warns():
    full = structure.Graph(list("abcd"), {frozenset(x) for x in itertools.combinations("abcd", 2)})
    with pytest.warns(UserWarning, match="more than 23"):
        assert len(list(structure.member_dags(full, 23))) == 23


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,x,flag,day,name,whole,gone\n1,NA,True,2020-01-01,"a, ""b""",3,\n2,1.5,false,2020-01-02,null,NA,NA\n3,-inf,TRUE,,007x,-4,\n')
    df = read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "x": "double", "flag": "boolean", "day": "string", "name": "string", "whole": "bigint", "gone": "double"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, None, True, "2020-01-01", 'a, "b"', 3, None), (2, 1.5, False, "2020-01-02", None, None, None), (3, float("-inf"), True, None, "007x", -4, None)]
    write_table(df, str(tmp_path / "u.csv"))
    again = read_csv(spark, str(tmp_path / "u.csv"))
    assert again.dtypes == df.dtypes and sorted(map(str, again.collect())) == sorted(map(str, df.collect()))
    shop = Catalog(spark, {"t": str(tmp_path / "t.csv")})
    assert ids(run_query("SELECT t.* FROM t WHERE t.x > 0 AND t.day == '2020-01-02'", shop)) == [2]
    assert ids(run_query("SELECT t.* FROM t WHERE t.whole < 5", shop)) == [1, 3]


def test_dates(spark):
    df = spark.sql("SELECT * FROM VALUES (1, DATE'2020-01-01', TIMESTAMP'2020-01-01 10:00:00'), (2, DATE'2020-02-01', null) AS t(id, d, s)")
    ask = lambda w: ids(run_query(f"SELECT t.* FROM t WHERE {w}", catalog(spark, df)))
    assert ask("t.d == '2020-01-01'") == [1] and ask("t.d != '2020-01-01'") == [2] and ask("t.d > '2020-01-15'") == [2]
    assert ask("t.s >= '2020-01-01 10:00:00'") == [1] and ask("t.s != '2020-01-01'") == [1, 2] and ask("t.d == 'soon'") == []


def test_large_programs_guard_by_a_join(spark):
    df = spark.range(30_000).selectExpr("id", "id % 6000 AS k", "CASE WHEN id = 77 THEN 'x' ELSE cast(id % 6000 AS string) END AS v")
    p = Program([fit(df, ["k"], "v", 0.5, 1)])
    assert p.statements[0].cardinality == 6000
    m = RuleModel("y", ("v",), "v")
    assert guarded(df, m, Guard("coerce", p), "y").where("y is null").count() == 1
    assert guarded(df, m, Guard("rectify", p), "y").where("id = 77").first().y == "77"
    with pytest.raises(ValueError):
        guarded(df, m, Guard("raise", p), "y")


def test_shifted_pairs_against_pandas(spark):
    r = np.random.default_rng(3)
    cells = [(k, int(a), [None, "x", "y"][b], [1.5, float("nan"), 2.5][c]) for k, (a, b, c) in enumerate(zip(r.integers(0, 9, 500), r.integers(0, 3, 500), r.integers(0, 3, 500)))]
    df = spark.createDataFrame(cells, "id long, a long, b string, c double").repartition(7)
    got = structure.shifted_pairs(df, ["id"]).groupBy("block", "a", "b", "c").count().collect()
    want: dict[tuple, int] = {}
    rows = df.collect()
    order = {"a": lambda x: (x.a, x.id), "b": lambda x: (x.b is not None, x.b or "", x.id), "c": lambda x: (x.c != x.c, x.c if x.c == x.c else 0, x.id)}
    same = lambda x, y: x == y or (x != x and y != y)
    for c, by in order.items():
        s = sorted(rows, key=by)
        for x, y in zip(s, s[1:] + s[:1]):
            k = (c, *(bool(same(x[n], y[n])) for n in "abc"))
            want[k] = want.get(k, 0) + 1
    assert {(g.block, g.a, g.b, g.c): g["count"] for g in got} == want


def test_bounded_search_is_the_best(spark):
    r = np.random.default_rng(5)
    rows = [(int(a), int(b), int(a) if r.random() > 0.02 else 9) for a, b in zip(r.integers(0, 6, 800), r.integers(0, 3, 800))]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    found = {s.dependent: s for s in miners.bounded_search(df, ["a", "b", "c"], most_loss=0.02).statements}
    best = (0, 0)
    for dets in (("a",), ("b",), ("a", "b")):
        groups: dict[tuple, list[int]] = {}
        for x in rows:
            groups.setdefault(tuple(x["abc".index(d)] for d in dets), []).append(x[2])
        options = [(len(v), len(v) - max(map(v.count, v))) for v in groups.values()]
        for n in range(1, 5):
            for pick in itertools.combinations(options, n):
                if sum(x[1] for x in pick) <= 16:
                    best = min(best, (-sum(x[0] for x in pick), sum(x[1] for x in pick)))
    assert (-found["c"].coverage, found["c"].loss) == best


def test_analyst_and_histogram(spark, places):
    p = Program([fit(places, ["n_name"], "r_name", 0.05)])
    a = analysis.Analyst(Settings(comparative=True))
    run_query("SELECT count(M1) FROM t\nM1: m, rule", catalog(spark, places), Registry({"m": RuleModel("r_name", ("n_name", "r_name"), "upper(r_name)")}), {"m": Guard("ignore", p)}, analyst=a)
    assert [(x["analysis"], x["call"], x["rows"], x["dataset"]) for x in a.records] == [("relevance", 0, 1001, "t"), ("comparative", 1, 1001, "t")]
    assert a.records[0]["alerts"] == 1 and a.records[1]["errors_after"] == 1
    h = analysis.histogram(spark.createDataFrame([("a",), (None,), (None,)], "v string"), "v")
    assert {r.value: r.n for r in h.collect()} == {"a": 1, None: 2}


def test_model_kinds(spark):
    r = Registry({"rule:m": RuleModel("a", (), "1"), "m": RuleModel("b", (), "2")}, spark=spark)
    assert r.get("m", "rule").label == "a" and r.get("m", "linear").label == "b"
    with pytest.raises(ValueError, match="no loader"):
        r.get("other", "forest")


def test_cfd_lines():
    with pytest.warns(UserWarning, match="line 2"):
        found = miners.parse_cfds(["(a=1, odd) => b=2", "nothing", "", "() => b=x=y"])
    assert found == {1: miners.Cfd((("a", "1"),), ("b", "2")), 4: miners.Cfd((), ("b", "x=y"))}


def test_search_keeps_its_graph(spark, places, tmp_path):
    path = str(tmp_path / "g.json")
    first = Search(0.1, 10, keep_false=True, graph_path=path)
    p = first.run(places, ["id"])
    again = Search(0.1, 10, keep_false=True, graph_path=path)
    assert again.run(places, ["id"]) == p and first.seconds is not None and again.seconds is None


def test_a_program_without_a_statement_finds_nothing(spark, places):
    p = Program([fit(places, ["r_name"], "n_name", 0.1, 10)])
    p.add(None)
    assert p == Program() and Program.from_json(p.to_json()) == p and loss(places, None) == 0
    assert alerts(places, p).where("alert").isEmpty() and row_errors(places, p).select(error_text()).isEmpty()
    assert rectified(places, p).collect() == places.collect()
    assert violated(places, p).where("size(violated) > 0").isEmpty() and noise.controllable(places, p).where("array_join(controllable, ',') <> ''").isEmpty()
