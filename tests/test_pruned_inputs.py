"""Queries that read a few columns of receipts or ledger rows do not order all rows of a device or centre for the others."""

import pytest

from lotlens.catalog import QUERIES, Tables


@pytest.fixture(scope="module")
def tables(spark):
    t = Tables(spark, "/nowhere")
    rows = {
        "orders": "SELECT id AS o_orderkey, id % 5 AS o_custkey, DATE '1996-01-01' + CAST(id AS INT) AS o_orderdate, 100.0D + id AS o_totalprice, 'F' AS o_orderstatus FROM range(40)",
        "lineitem": "SELECT id % 40 AS l_orderkey, id % 7 AS l_partkey, id % 5 AS l_suppkey, CAST(id % 3 AS INT) AS l_linenumber, 5.0D AS l_quantity, 90.0D + id AS l_extendedprice, 0.05D AS l_discount, 0.02D AS l_tax, DATE '1996-01-02' AS l_shipdate FROM range(60)",
        "supplier": "SELECT id AS s_suppkey, 0L AS s_nationkey FROM range(5)",
        "customer": "SELECT id AS c_custkey, 1.0D AS c_acctbal FROM range(5)",
        "nation": "SELECT 0L AS n_nationkey, 'N' AS n_name, 0L AS n_regionkey",
    }
    t._seen.update({name: spark.sql(sql) for name, sql in rows.items()})
    return t


@pytest.mark.parametrize("name", ["J01_latest_revision", "J02_truth_with_receipt", "J06_lots_with_latest_receipt", "P19_search_lots", "P19_search_referred", "R07_stale_receipts",
                                  "A27_fleet_dashboard", "A27_fleet_size_series", "A28_home_kpis", "A30_repeatability"])
def test_latest_receipts_leave_the_devices_alone(tables, name):
    assert "lag(" not in QUERIES[name].run(tables)._jdf.queryExecution().optimizedPlan().toString()


def test_latest_receipts_are_the_last_revisions(tables):
    r = [x.asDict() for x in tables("receipts").collect()]
    want = {}
    for x in sorted(r, key=lambda x: (x["rev"], -x["receipt_no"])):
        want[x["lot_id"]] = (x["receipt_no"], x["rev"], x["hash"], x["grade_a"])
    assert {x.lot_id: (x.receipt_no, x.rev, x.hash, x.grade_a) for x in QUERIES["J01_latest_revision"].run(tables).collect()} == want


def test_identity_keys_need_no_chain(tables):
    found = QUERIES["T04_dedupe_full_key"].run(tables)
    plan = found._jdf.queryExecution()
    assert "lag(" not in plan.optimizedPlan().toString() and "SortAggregate" not in plan.executedPlan().toString()
    assert found.agg({"n_copies": "sum"}).first()[0] == 40
