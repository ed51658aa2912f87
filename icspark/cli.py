"""Command line: run query files, train a model with its program, synthesise, show and apply programs, split, inject noise."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from icspark.operators.analysis import Analyst
from icspark.operators.guard import MODES, Guard, Settings
from icspark.operators.models import Registry, save, train
from icspark.operators.noise import inject, split
from icspark.operators.program import Program, error_text, row_errors
from icspark.operators.search import LEARNERS, SAMPLERS, Search
from icspark.plans.grammar import parse
from icspark.plans.planner import run_query
from icspark.sources.catalog import Catalog, markdown, query_texts, read_table, write_table


#: Rows of a result that are kept and printed.
SHOWN = 100


def run_queries(spark: SparkSession, path: str, catalog: Catalog, modes: list[str], noise: str | None = None, compat: bool = False, registry: Registry | None = None, out: str | None = None, settings: Settings | None = None) -> dict[str, list[dict]]:
    """Rows by "file,mode" of every query file under every mode; also printed as Markdown, and written as JSON to `out`.

    Mode gt reads the clean version of the data, unguarded. Results are meant to be aggregates: the first SHOWN rows are kept, and
    the result of a longer one ends with a row `{"more": true}`. With settings, guarded predictions are analysed as they ask.
    """
    registry, found = registry or Registry(spark=spark), {}
    for mode in modes:
        for name, text in query_texts(path, "gt" if mode == "gt" else noise).items():
            guards = {}
            for ref in parse(text, compat).models.values():
                registry.get(ref.path, ref.kind)
                if mode != "gt" and (mode != "ignore" or settings):
                    guards[ref.path] = Guard(mode, registry.programs.get(ref.path), bool(settings and settings.disabled))
            analyst = Analyst(settings) if settings and mode != "gt" else None
            result = run_query(text, catalog, registry, guards, compat, analyst).limit(SHOWN + 1).persist()
            rows = [r.asDict() for r in result.collect()]
            found[f"{name},{mode}"] = rows[:SHOWN] + [{"more": True}] * (len(rows) > SHOWN)
            print(f"{name}, {mode}\n{markdown(result, SHOWN)}\n")
            result.unpersist()
    if out:
        with open(out, "w") as f:
            json.dump(found, f, default=str, indent=1)
    return found


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="icspark", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    q = sub.add_parser("query", help="run .sql files over named tables")
    q.add_argument("path"), q.add_argument("--table", action="append", default=[], help="name=path"), q.add_argument("--noise"), q.add_argument("--compat", action="store_true")
    q.add_argument("--mode", action="append", choices=[*MODES, "gt"], help="ignore by default; may be repeated"), q.add_argument("--out", help="JSON file for the results")
    q.add_argument("--analyse", action="store_true", help="record analyses of guarded predictions as ICSPARK_RELEVANCE, ICSPARK_COMPARATIVE, ICSPARK_DISABLED and ICSPARK_RECORDS say; ICSPARK_MODE is the default mode")
    t = sub.add_parser("train", help="train a model and learn the program that guards it")
    t.add_argument("table"), t.add_argument("label"), t.add_argument("out"), t.add_argument("--balanced", action="store_true")
    s = sub.add_parser("synthesize", help="learn a program from a table")
    s.add_argument("table"), s.add_argument("out")
    for x in (t, s):
        x.add_argument("--key", required=True), x.add_argument("--epsilon", type=float, default=0.01), x.add_argument("--min-support", type=int, default=10)
        x.add_argument("--learner", default="score", choices=list(LEARNERS)), x.add_argument("--sampler", default="shift", choices=SAMPLERS), x.add_argument("--graph", help="file that keeps the learned class of graphs"), x.add_argument("--most-dags", type=int)
    s.add_argument("--used-time", help="JSON file for the seconds that learning took")
    d = sub.add_parser("detect", help="show rows that violate a program")
    d.add_argument("table"), d.add_argument("program"), d.add_argument("--rows", type=int, default=20)
    w = sub.add_parser("show", help="print a program")
    w.add_argument("program")
    c = sub.add_parser("split", help="write train and test versions of a table")
    c.add_argument("table"), c.add_argument("--key", required=True), c.add_argument("--test", type=float, default=0.15), c.add_argument("--seed", type=int, default=42)
    n = sub.add_parser("noise", help="write a version of a table with injected errors")
    n.add_argument("table"), n.add_argument("program"), n.add_argument("out"), n.add_argument("--key", required=True), n.add_argument("--level", type=float, default=0.05), n.add_argument("--label"), n.add_argument("--seed", type=int, default=42)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("icspark").getOrCreate()
    if a.what == "query":
        settings = Settings.of_environment()
        run_queries(spark, a.path, Catalog(spark, dict(x.split("=", 1) for x in a.table)), a.mode or [settings.mode], a.noise, a.compat, out=a.out, settings=settings if a.analyse else None)
    elif a.what in ("train", "synthesize"):
        df, key = read_table(spark, a.table), a.key.split(",")
        search = Search(a.epsilon, a.min_support, a.learner, sampler=a.sampler, graph_path=a.graph, most_dags=a.most_dags)
        program = search.run(df, key)
        if a.what == "train":
            save(spark, train(df.drop(*key), a.label, balanced=a.balanced), a.out, program)
        else:
            with open(a.out, "w") as f:
                f.write(program.to_json())
            if a.used_time:
                with open(a.used_time, "w") as f:
                    json.dump({"used_time": search.seconds}, f)
        print(program.statistics)
    elif a.what == "split":
        stem, dot, suffix = a.table.rpartition(".")
        for version, part in zip(("train", "test"), split(read_table(spark, a.table), a.key.split(","), a.test, a.seed)):
            write_table(part, f"{stem}.{version}{dot}{suffix}")
    else:
        with open(a.program) as f:
            program = Program.from_json(f.read())
        if a.what == "show":
            print(program, program.statistics, sep="\n")
        elif a.what == "detect":
            row_errors(read_table(spark, a.table), program).withColumn("errors", error_text()).show(a.rows, truncate=False)
        else:
            write_table(inject(read_table(spark, a.table), program, a.key.split(","), a.level, a.label, a.seed), a.out)


if __name__ == "__main__":
    main()
