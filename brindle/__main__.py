"""python -m brindle COMMAND ...

list                                names of the queries
run|explain|csv QUERY FOLDER        show a result, its plan, or the result as CSV
chunked QUERY FOLDER [--files N]    a report whose lines are read so many files a chunk
check QUERY FOLDER GOLDEN           compare a result with GOLDEN/<query>_<scale>.csv
save QUERY FOLDER GOLDEN            write that file
time QUERY FOLDER                   seconds of loading, planning and execution as CSV
ingest TABLE FILE OUT               a .tbl file as Parquet; `ingest FOLDER OUT` all tables of a folder, derived ones too

QUERY is a name, `all` (q01 to q22) or `mball` (mb1 to mb7).  Options: name=value
for a report's parameters, --scale SF1, --absolute 0.01, --relative 0.0001,
--warmup 1, --repeat 5.  A folder's tables are Parquet, else .tbl files.
"""

from __future__ import annotations

import argparse
import statistics
import sys

from pyspark.sql import SparkSession

from brindle import timing
from brindle.check import ABSOLUTE, RELATIVE, check_golden, golden_name, to_csv
from brindle.plans.reports import REPORTS
from brindle.plans.single import SINGLES
from brindle.sources import catalog
from brindle.streaming import chunked

QUERIES = REPORTS | SINGLES


def names_of(name: str) -> list[str]:
    """The queries that a name stands for."""
    groups = {"all": [n for n in REPORTS if n[0] == "q"], "mball": [n for n in REPORTS if n[0] == "m"]}
    found = groups.get(name, [name])
    if missing := [n for n in found if n not in QUERIES]:
        raise SystemExit(f"no query {missing[0]}; `list` names them")
    return found


def save(text: str, spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="python -m brindle", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=("list", "run", "explain", "csv", "chunked", "check", "save", "time", "ingest"))
    p.add_argument("words", nargs="*")
    p.add_argument("--scale", default="SF1")
    p.add_argument("--absolute", type=float, default=ABSOLUTE)
    p.add_argument("--relative", type=float, default=RELATIVE)
    p.add_argument("--files", type=int, default=1)
    p.add_argument("--warmup", type=int, default=1)
    p.add_argument("--repeat", type=int, default=5)
    told = p.parse_intermixed_args(args)
    values = dict(w.split("=", 1) for w in told.words if "=" in w)
    words = [w for w in told.words if "=" not in w]
    if told.command == "list":
        print(*sorted(QUERIES), sep="\n")
        return 0
    if len(words) < (3 if told.command in ("check", "save") else 2):
        p.error("words are missing")
    spark = SparkSession.builder.appName("brindle").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if told.command == "ingest":
        if len(words) == 3:
            catalog.ingest(spark, words[1], words[0], words[2])
        else:
            print(*catalog.ingest_all(spark, words[0], words[1]), sep="\n")
        return 0
    failed = 0
    if told.command == "time":
        print("query", "runs", *timing.PHASES, "total", "least", "greatest", sep=",")
    for name in names_of(words[0]):
        if told.command == "time":
            runs = timing.measure(lambda n=name: QUERIES[n].run(spark, words[1], **values), told.warmup, told.repeat)
            total = [r["total"] for r in runs]
            print(name, len(runs), *(f"{statistics.median(r[k] for r in runs):.4f}" for k in (*timing.PHASES, "total")), f"{min(total):.4f}", f"{max(total):.4f}", sep=",")
            continue
        df = chunked.report(spark, name, words[1], told.files, **values) if told.command == "chunked" else QUERIES[name].run(spark, words[1], **values)
        if told.command in ("run", "chunked"):
            df.show(1000, truncate=False)
        elif told.command == "csv":
            print(to_csv(df), end="")
        elif told.command == "explain":
            df.explain("formatted")
        elif told.command == "save":
            save(to_csv(df), spark, f"{words[2]}/{golden_name(name, told.scale)}")
        else:
            path = f"{words[2]}/{golden_name(name, told.scale)}"
            wrong = check_golden(df, path, told.absolute, told.relative) if catalog.exists(spark, path) else [f"{path} is missing"]
            failed += bool(wrong)
            print(name, "differs" if wrong else "equal", *wrong[:5], sep="\n  " if wrong else " ")
    return 2 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
