"""Steps that arrive in any order, as payloads in order of their time: keyed state, timers, and a sink keyed by batch.

Each key buffers its steps (a missing step number counts as zero) as a list that a batch adds to at once, and has one timer, at its earliest step. When the watermark
has passed a step's time no earlier step can come, and the key's steps up to there are put out in order of time and step, numbered on from those before. Steps behind the watermark when they arrive are
late: Spark leaves them out and counts them. A batch is written to a folder of its own name, which a repeated batch
overwrites, so that stopping anywhere and running again neither loses nor repeats a step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lapwise.functions.exprs import payload

OUT = "key string, n long, at timestamp, step long, value string"
PUT_OUT = "key string, n long, us long, step long, value string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A step of this key only moves the watermark on.
CLOSING = "\u0000end"


class InOrder(StatefulProcessor):
    """Buffers the steps of a key and puts them out when the watermark has passed them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, step long, value string")
        self.due = handle.getValueState("due", "ms long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for part in rows:
            if key[0] != CLOSING and len(part):
                self.waiting.appendList(list(zip(part["us"].tolist(), part["step"].tolist(), part["value"].tolist(), strict=True)))
                least = int(part["us"].min()) // 1000
                first = least if first is None else min(first, least)
        due = self.due.get()[0] if first is not None and self.due.exists() else None
        if first is not None and (due is None or first < due):
            if due is not None:
                self.handle.deleteTimer(due)
            self._call_at(first)
        return iter([])

    def _call_at(self, ms: int) -> None:
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        held = {(us // 1000, step): (us, step, value) for us, step, value in self.waiting.get()}  # of a step that came again, the last
        ready = [held[place] for place in sorted(held) if place[0] <= passed]
        later = [step for place, step in held.items() if place[0] > passed]
        if later:
            self.waiting.put(later)
            self._call_at(min(us for us, _, _ in later) // 1000)
        else:
            self.waiting.clear()
            self.due.clear()
        if ready:
            n = self.count.get()[0] if self.count.exists() else 0
            self.count.update((n + len(ready),))
            us, step, value = zip(*ready, strict=True)
            yield pd.DataFrame({"key": key[0], "n": range(n + 1, n + len(ready) + 1), "us": us, "step": step, "value": value})

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: str, time: str, step: str, fields: Sequence[str], *, late: str = "10 minutes") -> DataFrame:
    """key, n (its place among the key's steps), at, step, value (a JSON object of fields) in order, behind the watermark."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(time).alias("at"), F.unix_micros(time).alias("us"), F.coalesce(F.col(step).cast("long"), F.lit(0)).alias("step"), payload(*fields).alias("value"))
    found = rows.withWatermark("at", late).groupBy("key").transformWithStateInPandas(InOrder(), PUT_OUT, "Append", "EventTime")
    return found.select("key", "n", F.timestamp_micros("us").alias("at"), "step", "value")


def closing_file(spark: SparkSession, path: str, schema: T.StructType, key: str, time: str) -> None:
    """Adds the file that ends a stream: one step of no key that counts, at a time behind which all others are put out."""
    row = [F.lit(CLOSING if f.name == key else None).cast(f.dataType).alias(f.name) if f.name != time else F.lit("2262-01-01").cast(f.dataType).alias(f.name) for f in schema]
    spark.range(1).select(*row).coalesce(1).write.mode("append").parquet(path)


def replay_in_order(stream: DataFrame, out: str, checkpoint: str, key: str, time: str, step: str, fields: Sequence[str], *, late: str = "10 minutes") -> int:
    """Runs over all files there are and stops; how many late steps were left out in this run.

    Needs the RocksDB state store, which it sets where the session has another one.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def sink(batch: DataFrame, number: int) -> None:
        batch.sortWithinPartitions("key", "n").write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = in_order(stream, key, time, step, fields, late=late).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
