"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from decimal import Decimal
from glob import glob

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for path in glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, Decimal):
        v = int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9) + 0.0)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return str(v)


def kind(v) -> str:
    return "float" if isinstance(v, float) else "bool" if isinstance(v, bool) else type(v).__name__


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    kinds = {}
    for row in rows:
        for i in order:
            if row[i] is not None:
                kinds.setdefault(names[i], kind(row[i]))
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows), kinds


def compare(spark, con, query, folder) -> tuple[str, str]:
    df = query(spark, folder)
    names, got, kinds = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if query.oracle is None:
        return ("rows", f"{len(got)} rows")
    cur = con.execute(query.oracle)
    want_names, want, want_kinds = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return ("FAIL", f"columns {names} != {want_names}")
    if len(got) != len(want):
        return ("FAIL", f"rows {len(got)} != {len(want)}")
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        show = [(n, a[:60], b[:60]) for n, a, b in zip(names, *bad[0]) if a != b]
        return ("FAIL", f"{len(bad)} rows differ, e.g. {show}")
    off = {c: (kinds[c], want_kinds.get(c)) for c in kinds if kinds[c] != want_kinds.get(c)}
    if off:
        return ("KIND", str(off))
    return ("ok", f"{len(got)} rows")


def main(argv):
    from sentiloom.plans import catalog  # noqa: F401
    from sentiloom.plans.registry import CATALOG
    from sentiloom.session import build_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    con = duck(folder)
    bad = 0
    for name, query in CATALOG.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            state, note = compare(spark, con, query, folder)
        except Exception as e:  # report and go on with the next query
            state, note = "ERROR", f"{type(e).__name__}: {' '.join(str(e).split())[:600]}"
        bad += state in ("FAIL", "ERROR")
        print(f"{state:5s} {name:32s} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
