"""Run registered queries against their SQL twins."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(v):
    if v is None:
        return "\\N"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else repr(round(f, 9) + 0.0)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canonical(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canonical(x)}" for k, x in v.items()) + "}"
    if hasattr(v, "asDict"):
        return canonical(v.asDict())
    return str(v)


def kind(v):
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, (float, decimal.Decimal)):
        return "float"
    return type(v).__name__ if v is not None else None


def close(got: list[tuple], want: list[tuple], step: float = 1.1e-6) -> bool:
    """Equal up to one step of the sixth decimal: an exact half may round either way."""

    def split(row):
        return tuple(canonical(v) for v in row if not isinstance(v, float)), [v for v in row if isinstance(v, float)]

    a, b = sorted(map(split, got)), sorted(map(split, want))
    return all(x[0] == y[0] and all(abs(u - v) <= step for u, v in zip(x[1], y[1])) for x, y in zip(a, b))


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> str | None:
    """None if equal, else what differs."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got_rows = [tuple(r[c] for c in cols) for r in df.collect()]
    if sql is None:
        return None if got_rows else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    want_rows = [tuple(r[i] for i in order) for r in cur.fetchall()]
    if not got_rows:
        return "no rows"
    for i, c in enumerate(cols):
        a = {kind(r[i]) for r in got_rows} - {None}
        b = {kind(r[i]) for r in want_rows} - {None}
        if a != b:
            return f"column {c}: {a} vs {b}"
    got = sorted(tuple(canonical(v) for v in r) for r in got_rows)
    want = sorted(tuple(canonical(v) for v in r) for r in want_rows)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    if got != want and not close(got_rows, want_rows):
        a, b = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        return f"{len(a)} of {len(got)} rows differ, cols {cols}, got {a[:1]} want {b[:1]}"
    return None


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from tallymill.session import build_session

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session(
        "oracle", "local[8]", spark__checkpoint__dir="/tmp/tallymill-oracle", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        took = time.time() - start
        if problem:
            bad += 1
            print(f"BAD  {name} ({took:.1f}s): {problem}", flush=True)
        elif only or took > 5:
            print(f"ok   {name} ({took:.1f}s)", flush=True)
    print("failed:", bad, "of", len(entry.queries()), "without sql:", sorted(set(entry.queries()) - set(oracles)))
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
