"""Keyed state in event-time order.

Rows wait in the state of their key until the watermark has passed them and are then handled in order of time, whatever
micro-batch brought them; rows later than the watermark are dropped by Spark. A key that stays silent for longer than
``idle`` starts afresh, and a timeout then removes its state. One timeout is set, at the first waiting row or at
the end of the idle time, the earliest of a bucket's keys. What waits for a key is bounded by its rows within the watermark's delay.

The state of many keys is one row, that of the bucket a hash deals them to: a call costs milliseconds, whatever its rows,
so one per key and micro-batch would be all the time there is. Buckets hold what their keys would hold apart. State lives
in RocksDB: start such queries through ``sinks.drain`` or set the provider as ``STATE_STORE`` says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: (state, row) -> (new state, output rows without the key); a row is (us, tie, *values).
Step = Callable[[tuple, tuple], tuple[tuple, list[tuple]]]


class InOrder:
    """Folds each key's rows in order of (us, tie) with ``step``, starting from ``fresh``, for the keys of a bucket at once."""

    def __init__(self, step: Step, fresh: tuple, waiting: dict[str, str], state: str, out: list[str], idle_us: int | None):
        self.step, self.fresh, self.columns, self.out, self.idle_us = step, fresh, ["key", *waiting], out, idle_us
        self.casts = [{"long": int, "int": int, "boolean": bool, "double": float}.get(t, str) for t in ("string", *waiting.values())]
        fields = ", ".join(f"{c}: {t}" for c, t in waiting.items())
        held = ", ".join(f"{n}: {t}" for n, t in (c.split() for c in f"{state}, last_us long".split(", ")))
        self.schema = f"waiting array<struct<key: string, {fields}>>, held array<struct<key: string, {held}>>"

    def _rows(self, part: pd.DataFrame) -> Iterator[tuple]:
        part = part[part["given"]]  # rows without a number only move the watermark
        columns = [[None if gone else cast(v) for v, gone in zip(part[c].tolist(), part[c].isna().tolist(), strict=True)] for c, cast in zip(self.columns, self.casts, strict=True)]
        return zip(*columns, strict=True)

    def __call__(self, bucket: Any, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        waiting, held = (list(map(tuple, x)) for x in group.get) if group.exists else ([], [])
        for part in parts:
            if len(part):
                waiting.extend(self._rows(part))
        now_us = group.getCurrentWatermarkMs() * 1000
        states = {key: (tuple(state), last) for key, *state, last in held}
        found, later = [], []
        for key, *row in sorted(waiting, key=lambda r: r[1:3]):
            if row[0] > now_us:
                later.append((key, *row))
                continue
            state, last = states.get(key, (self.fresh, None))
            if last is not None and self.idle_us is not None and row[0] - last > self.idle_us:
                state = self.fresh
            state, out = self.step(state, tuple(row))
            states[key] = state, row[0]
            found.extend((key, *o) for o in out)
        self._keep(group, later, states, now_us)
        if found:
            yield pd.DataFrame(found, columns=self.out)

    def _keep(self, group: GroupState, waiting: list[tuple], states: dict, now_us: int) -> None:
        """Store what waits, earliest first, and the states not past their idle time; set the one timeout."""
        if self.idle_us is not None:
            states = {key: (state, last) for key, (state, last) in states.items() if now_us <= last + self.idle_us}
        if not waiting and not states:
            if group.exists:
                group.remove()
            return
        group.update((waiting, [(key, *state, last) for key, (state, last) in states.items()]))
        ends = [-(-waiting[0][1] // 1000)] if waiting else []
        if states and self.idle_us is not None:
            ends.append(-(-(min(last for _, last in states.values()) + self.idle_us) // 1000) + 1)
        if ends:
            group.setTimeoutTimestamp(min(ends))


def in_order(rows: DataFrame, key: str, time: str, tie: str, values: dict[str, str], step: Step, fresh: tuple, state: str, out: str,
             delay: str = "1 hour", idle: pd.Timedelta | str | None = None, buckets: int = 2048) -> DataFrame:
    """A stream's rows folded per key in order of (time, tie): columns key and ``out``.

    ``values`` are further columns with their types (long, int, double, boolean or string), handed to ``step`` after time (microseconds) and tie. Rows more than
    ``delay`` behind the latest time are dropped; rows with a null tie, key or time change no state. Equal (time, tie)
    are handled in any order. Output rows come when the watermark has passed them. ``buckets`` may not change while a
    checkpoint is in use.
    """
    kind = rows.schema[key].dataType.simpleString()
    # pandas turns whole numbers beside missing ones into floats, so those that may be missing travel as text.
    sent = [F.col(c).cast(t).cast("string" if t in ("long", "int") else t).alias(f"v{i}") for i, (c, t) in enumerate(values.items())]
    typed = rows.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("at"), F.col(tie).cast("long").alias("tie"), *sent).withWatermark("at", delay)
    typed = typed.withColumns({"us": F.coalesce(F.unix_micros("at"), F.lit(0)), "given": F.col("tie").isNotNull() & F.col("at").isNotNull(), "tie": F.coalesce("tie", F.lit(0)),
                               "bucket": F.pmod(F.xxhash64("key"), F.lit(buckets))})
    kept = {f"v{i}": t for i, t in enumerate(values.values())}
    names = [c.split()[0] for c in out.split(", ")]
    fold = InOrder(step, fresh, {"us": "long", "tie": "long"} | kept, state, ["key", *names],
                   None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1_000_000))
    found = typed.groupBy("bucket").applyInPandasWithState(fold.__call__, f"key string, {out}", fold.schema, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("key").cast(kind).alias("key"), *names)
