"""Compare registered queries with their SQL in DuckDB: ``python -m tests.oracle_check [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canon(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """Return (ok, message) for a Spark result and its SQL."""
    got_cols, got = table(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    types = [str(d[1]) for d in res.description]
    want_cols, want = table([d[0] for d in res.description], res.fetchall())
    if any(t in ("HUGEINT",) or t.startswith("DECIMAL") for t in types):
        return False, f"oracle types {types}"
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        got_set, want_set = set(got), set(want)
        extra = [r for r in got if r not in want_set][:2]
        missing = [r for r in want if r not in got_set][:2]
        return False, f"rows {len(got)} != {len(want)}; extra {extra}; missing {missing}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} rows differ, e.g. {str(bad[0][0])[:400]} != {str(bad[0][1])[:400]}"
    return True, f"{len(got)} rows"


def main(argv):
    from clausework.plans import REGISTRY
    from clausework.session import build_session

    sf = "0.01"
    names = []
    for a in argv:
        if a.startswith("sf="):
            sf = a[3:]
        else:
            names.append(a)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("oracle_check", "local[8]")
    con = duck(sf_dir)
    if names:
        chosen = [n for n in REGISTRY if any(n == a or (a.endswith("*") and n.startswith(a[:-1])) or REGISTRY[n].run.__closure__ and a == "@" + _module(REGISTRY[n]) for a in names)]
    else:
        chosen = list(REGISTRY)
    failed = []
    for name in chosen:
        spec = REGISTRY[name]
        start = time.time()
        try:
            df = spec.run(spark, sf_dir)
            if spec.sql is None:
                ok, msg = True, f"rows only: {len(df.collect())}"
            else:
                ok, msg = compare(df, con, spec.sql)
        except Exception as exc:  # noqa: BLE001 - report every failing query
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {msg}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(chosen) - len(failed)}/{len(chosen)} ok; failed: {failed}")
    return 1 if failed else 0


def _module(spec):
    fns = [c.cell_contents for c in spec.run.__closure__ if callable(c.cell_contents)]
    return next((f.__module__.rsplit(".", 1)[-1] for f in fns if f.__module__.startswith("clausework.plans.")), "")


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
