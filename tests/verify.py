"""Side-by-side check of a Spark analysis against its DuckDB oracle.

Compares row count, column names and types, and the multiset of rows with
exact values (decimals by their digits, doubles bit for bit). Used by the
tests and by ``python -m verify <sf_dir> [name ...]``.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections import Counter
from decimal import Decimal

from pyspark.sql import types as T

from loanlens.sources.tables import TABLES, table_path

_SPARK_TO_DUCK = {
    T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE",
    T.StringType: "VARCHAR", T.DateType: "DATE", T.BooleanType: "BOOLEAN",
    T.TimestampType: "TIMESTAMP WITH TIME ZONE", T.TimestampNTZType: "TIMESTAMP",
    T.ShortType: "SMALLINT", T.FloatType: "FLOAT",
}


def spark_type_as_duck(t: T.DataType) -> str:
    if isinstance(t, T.DecimalType):
        return f"DECIMAL({t.precision},{t.scale})"
    return _SPARK_TO_DUCK.get(type(t), t.simpleString().upper())


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return ("f", v.hex())
    if isinstance(v, Decimal):
        return ("d", str(v))
    if isinstance(v, (dt.date, dt.datetime)):
        return ("t", v.isoformat())
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    return ("s", str(v))


def duck_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def compare(df, sql: str, con) -> dict:
    """Return a report dict; ``report['ok']`` is the verdict."""
    spark_cols = [f.name for f in df.schema.fields]
    spark_types = {f.name: spark_type_as_duck(f.dataType) for f in df.schema.fields}
    rows = df.collect()
    rel = con.sql(sql)
    duck_cols = list(rel.columns)
    duck_types = dict(zip(duck_cols, [str(t) for t in rel.types]))
    drows = rel.fetchall()
    rep = {"spark_rows": len(rows), "oracle_rows": len(drows)}
    rep["columns_ok"] = sorted(spark_cols) == sorted(duck_cols)
    type_diff = {c: (spark_types[c], duck_types.get(c)) for c in spark_cols
                 if c in duck_types and spark_types[c] != duck_types[c]}
    rep["type_diff"] = type_diff
    if rep["columns_ok"]:
        order = sorted(spark_cols)
        s_idx = [spark_cols.index(c) for c in order]
        d_idx = [duck_cols.index(c) for c in order]
        sc = Counter(tuple(_norm(r[i]) for i in s_idx) for r in rows)
        dc = Counter(tuple(_norm(r[i]) for i in d_idx) for r in drows)
        rep["values_ok"] = sc == dc
        if not rep["values_ok"]:
            only_s = list((sc - dc).elements())[:3]
            only_d = list((dc - sc).elements())[:3]
            rep["sample_diff"] = {"cols": order, "spark_only": only_s, "oracle_only": only_d}
    else:
        rep["values_ok"] = False
        rep["cols"] = (spark_cols, duck_cols)
    rep["ok"] = (rep["values_ok"] and not type_diff and len(rows) == len(drows))
    return rep


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    from loanlens.session import get_session
    import __spark_entry__ as E

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = get_session("local[8]", 8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck_connection(sf_dir)
    bad = 0
    for name in (names or list(qs)):
        if name not in sqls:
            n = qs[name](spark, sf_dir).count()
            print(f"{name:40s} rows-only {n}")
            continue
        try:
            rep = compare(qs[name](spark, sf_dir), sqls[name], con)
        except Exception as e:  # report and continue with the next analysis
            rep = {"ok": False, "error": repr(e)[:500]}
        bad += not rep["ok"]
        status = "OK " if rep["ok"] else "BAD"
        print(f"{name:40s} {status} {rep.get('spark_rows')}/{rep.get('oracle_rows')}"
              + ("" if rep["ok"] else f" {rep}"))
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
