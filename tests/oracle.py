"""Runs registered queries against DuckDB on the same tables.

Usage: python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


KINDS = {"bigint": "int", "int": "int", "integer": "int", "double": "float", "string": "text",
         "varchar": "text", "boolean": "bool", "hugeint": "HUGEINT", "decimal": "DECIMAL"}


def _kind(name: str) -> str:
    return KINDS.get(name.lower().split("(")[0], name.lower())


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, float):
        return repr(v + 0.0)
    return repr(v)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    names = sorted(df.columns)
    cur = con.execute(sql)
    theirs_cols = [d[0] for d in cur.description]
    if sorted(theirs_cols) != names:
        return f"columns {names} vs {sorted(theirs_cols)}"
    types = {r[0]: _kind(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    mine = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    odd = {n: (mine[n], types[n]) for n in names if mine[n] != types[n]}
    if odd:
        return f"types {odd}"
    where = [theirs_cols.index(n) for n in names]
    theirs = sorted(tuple(_plain(r[i]) for i in where) for r in con.execute(sql).fetchall())
    ours = sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        a, b = bad[0]
        cols = [(n, x, y) for n, x, y in zip(names, a, b) if x != y]
        return f"{len(bad)} of {len(ours)} rows differ, e.g. {cols[:6]}"
    if bad:
        return f"{len(bad)} of {len(ours)} rows differ, columns {names}, e.g. {bad[0]}"
    return None if ours else "EMPTY"


def main(argv):
    from rankweave.catalog import ORACLES, QUERIES
    from rankweave.session import build_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:] or list(QUERIES)
    spark = build_session("local[8]", conf={
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf)
            if name in ORACLES:
                found = compare(df, con, ORACLES[name])
                state = "ok" if found is None else f"DIFF {found}"
            else:
                state = f"rows {len(df.collect())}"
        except Exception as exc:
            state = f"FAIL {type(exc).__name__}: {str(exc)[:700]}"
        bad += state.startswith(("DIFF", "FAIL"))
        print(f"{name:34s} {time.time() - start:6.2f}s {state}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
