"""Queries against their SQL twins on the smallest data set. ``tools/check.py`` compares all of them."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

from lotlens.catalog import QUERIES, Tables, oracle_text
from lotlens.catalog.core import TABLES

DIR = "/root/testdata/sf0.001"
NAMES = ["R02_adjudicate", "R03_apply_overrides", "A03_lot_shares", "A10_lot_decision", "A15_pool_looks", "A21_compare_gradings", "E10_subgroup_metrics",
         "D03_even_spread", "T01_audit_chain", "T09_head_roots", "X01_what_if_bulbs", "M03_guard_telemetry", "J13_candidate_matches"]

_spec = importlib.util.spec_from_file_location("check", Path(__file__).resolve().parents[1] / "tools" / "check.py")
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    import pandas as pd
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    q = QUERIES[name]
    df = q.run(Tables(spark, DIR))
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    cur = con.execute(oracle_text(q.sql))
    want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    assert check.rows(got) == check.rows(want)


def test_every_query_name_is_unique_and_bound():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 190
