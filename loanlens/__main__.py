"""Command line: list analyses, run one, export its result with a Spark sink.

  python -m loanlens list
  python -m loanlens run s31_geo_risk --sf-dir /root/testdata/sf0.01 --show 20
  python -m loanlens run s31_geo_risk --sf-dir DIR --out PATH --format csv
  python -m loanlens run-all --sf-dir DIR --out DIR --materialize
"""

from __future__ import annotations

import argparse
import os
import sys


def _write(df, path: str, fmt: str) -> None:
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", "true").csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loanlens")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    for name in ("run", "run-all"):
        r = sub.add_parser(name)
        if name == "run":
            r.add_argument("analysis")
        r.add_argument("--sf-dir", required=True)
        r.add_argument("--out")
        r.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
        r.add_argument("--show", type=int, default=0)
        r.add_argument("--materialize", action="store_true",
                       help="store the loan table once (in spark.checkpoint.dir) first")
        r.add_argument("--master")
    a = p.parse_args(argv)

    from loanlens.plans import registry
    if a.cmd == "list":
        qs, sql = registry.queries(), registry.oracle_sql()
        for k in qs:
            print(k, "" if k in sql else "(no oracle)")
        return 0

    from loanlens.session import get_session
    from loanlens.sources.loans import materialize_loans
    spark = get_session(a.master)
    if a.materialize:
        materialize_loans(spark, a.sf_dir)
    qs = registry.queries()
    names = [a.analysis] if a.cmd == "run" else list(qs)
    for name in names:
        df = qs[name](spark, a.sf_dir)
        if a.out:
            _write(df, a.out if a.cmd == "run" else os.path.join(a.out, name), a.format)
        if a.show:
            df.show(a.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
