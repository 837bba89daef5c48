"""Run queries against their SQL oracle: python tests/check_oracle.py SF_DIR [name …]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.append("/opt/oracle")


def normal(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.12g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, normal(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, normal(x)) for k, x in v.items()))
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


FAMILY = {"byte": "int", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "integer": "int",
          "utinyint": "int", "uinteger": "int", "ubigint": "int", "hugeint": "hugeint",
          "double": "float", "float": "float", "string": "str", "varchar": "str",
          "timestamp": "ts", "timestamp_ntz": "ts", "date": "date", "boolean": "bool"}


def family(t):
    t = str(t).lower()
    return FAMILY.get(t, t.split("(")[0].split("<")[0] if "[" not in t else "array")


def compare(df, con, sql):
    """None when equal, else a description of the difference."""
    cols = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} vs {sorted(rel.columns)}"
    kinds = dict(zip(rel.columns, rel.types))
    off = [
        f"{f.name}: {f.dataType.simpleString()} vs {kinds[f.name]}"
        for f in df.schema
        if family(f.dataType.simpleString()) != family(kinds[f.name])
    ]
    if off:
        return "types " + "; ".join(off)
    got = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)
    order = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(normal(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first: {dict(zip(cols, bad[0][0]))} vs {dict(zip(cols, bad[0][1]))}"
    return None


def main():
    from cellclock.plans.registry import load
    from cellclock.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    queries, oracles = load()
    spark = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    failed = []
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                con = connect(sf_dir)
                diff = compare(df, con, oracles[name])
                con.close()
                n = ""
            else:
                n, diff = f"rows-only {df.count()}", None
        except Exception as exc:  # report and go on with the next query
            diff, n = f"{type(exc).__name__}: {str(exc)[:1500]}", ""
        print(f"{'FAIL' if diff else 'ok  '} {name} {time.time() - start:.1f}s {n} {diff or ''}", flush=True)
        if diff:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
