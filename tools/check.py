"""Run catalogue queries on Spark and their SQL twins on DuckDB and compare the results.

    python tools/check.py [-d DATA_DIR] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from lotlens.catalog import QUERIES, Tables, oracle_text  # noqa: E402
from lotlens.catalog.core import TABLES  # noqa: E402
from lotlens.plans.session import local_session  # noqa: E402


def kind(s: pd.Series) -> str:
    vals = s.dropna()
    kinds = {("bool" if isinstance(v, bool) or type(v).__name__ == "bool_" else "int" if isinstance(v, int) or "int" in type(v).__name__
              else "float" if "float" in type(v).__name__ else type(v).__name__) for v in vals.head(50)}
    return "/".join(sorted(kinds)) or "empty"


def text(v) -> str:
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, float) or "float" in type(v).__name__:
        return repr(float(v) + 0.0)
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted(tuple(text(v) for v in r) for r in df[cols].itertuples(index=False, name=None))


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = local_session("check")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{a.d}/{t}.parquet'")
    bad = 0
    for name, q in QUERIES.items():
        if a.names and not any(name.startswith(n) for n in a.names):
            continue
        try:
            t0 = time.time()
            out = q.run(Tables(spark, a.d))
            got = [tuple(r) for r in out.collect()]
            got = pd.DataFrame({c: pd.Series([r[i] for r in got], dtype=object) for i, c in enumerate(out.columns)})
            t1 = time.time()
            if q.sql is None:
                print(f"rows {name} {len(got)} {t1 - t0:.1f}s", flush=True)
                continue
            cur = con.execute(oracle_text(q.sql))
            want = cur.fetchall()
            names = [d[0] for d in cur.description]
            want = pd.DataFrame({c: pd.Series([r[i] for r in want], dtype=object) for i, c in enumerate(names)})
            t2 = time.time()
            problems = []
            if sorted(got.columns) != sorted(want.columns):
                problems.append(f"columns {sorted(set(got.columns) ^ set(want.columns))}")
            else:
                for c in got.columns:
                    if kind(got[c]) != kind(want[c]):
                        problems.append(f"type {c}: {kind(got[c])} vs {kind(want[c])}")
                g, w = rows(got), rows(want)
                if len(g) != len(w):
                    problems.append(f"rows {len(g)} vs {len(w)}")
                if g != w:
                    gs, ws = set(g), set(w)
                    problems.append(f"values differ: {len(gs - ws)} only spark, {len(ws - gs)} only sql; cols {sorted(got.columns)} e.g.\n   {sorted(gs - ws)[:2]}\n   {sorted(ws - gs)[:2]}")
            if len(got) == 0:
                problems.append("empty")
            print(f"{'FAIL' if problems else 'ok'} {name} {len(got)} rows spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s " + "; ".join(problems), flush=True)
            bad += bool(problems)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {type(e).__name__} {str(e)[:700]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 100))
