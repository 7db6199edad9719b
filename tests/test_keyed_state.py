"""Keyed state: many keys share a state row, each still folded alone and in order of time."""

from lotlens.streaming import sinks
from lotlens.streaming.keyed import in_order

BIG = 2**53


def test_keys_share_a_state_row_and_keep_their_own_order(spark, tmp_path):
    def step(state, row):
        n, total = state[0] + 1, state[1] + (row[2] or 0)
        return (n, total), [(row[1], n, total)]
    # 60 keys of five rows a minute apart; every seventh value is missing and the others are beyond a double's whole numbers.
    rows = [(BIG + k, 600 + 60 * i + k % 7, BIG + 10 * k + i, None if (k + i) % 7 == 0 else BIG + k + i) for k in range(60) for i in range(5)]
    src = str(tmp_path / "in")
    late = lambda r: (r[0] + r[1]) % 3  # noqa: E731  # each file holds rows of all times
    schema = "key long, s long, id long, v long"
    for part in ([r for r in rows if late(r) == 0], [r for r in rows if late(r)], [(None, 10_000_000, None, None)]):
        spark.createDataFrame(part, schema).selectExpr("key", "timestamp_seconds(s) AS at", "id", "v").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("key long, at timestamp, id long, v long").option("maxFilesPerTrigger", 1).parquet(src)
    found = in_order(stream, "key", "at", "id", {"v": "long"}, step, (0, 0), "n long, total long", "id long, n long, total long", "20 minutes", "30 days", buckets=4)
    assert found.schema["key"].dataType.simpleString() == "bigint"
    query = sinks.tail(found, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    want = set()
    for k in range(60):
        n = total = 0
        for key, _, number, v in sorted((r for r in rows if r[0] == BIG + k), key=lambda r: r[1:3]):
            n, total = n + 1, total + (v or 0)
            want.add((key, number, n, total))
    got = [tuple(r) for r in sinks.committed(spark, str(tmp_path / "out"), found.schema).collect()]
    assert len(got) == len(rows) and set(got) == want
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(held) <= 4 and held[-1] == 0
