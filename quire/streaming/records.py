"""The keyed operators over streams. State follows arrival, as in the batch forms: late rows are
rejected by their own time, not dropped by a watermark, unless a watermark is asked for."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.deliveries import identified


def latest_updates(stream: DataFrame, key: str, time: str, arrival: str, payload: str) -> DataFrame:
    """Accepted updates of each key, in a stream: an update is accepted if its time isn't before the
    current one's; at equal times the later arrival wins. Emits (key, time, arrival, payload)."""
    out = f"key string, {time} bigint, {arrival} bigint, {payload} string"

    def step(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else None
        for b in batches:
            b = b.sort_values(arrival, kind="stable")
            rows = []
            for t, a, p in zip(b[time], b[arrival], b[payload]):
                if at is None or t >= at:
                    at = int(t)
                    rows.append((k[0], int(t), int(a), p))
            if rows:
                yield pd.DataFrame(rows, columns=["key", time, arrival, payload])
        if at is not None:
            state.update((at,))

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(time).cast("bigint").alias(time), F.col(arrival).cast("bigint").alias(arrival), F.col(payload).cast("string").alias(payload))
    return rows.groupBy("key").applyInPandasWithState(step, out, "at bigint", "append", GroupStateTimeout.NoTimeout)


def refresh_store(batch: DataFrame, store: str, keys: list[str], order: list[str]) -> int:
    """For foreachBatch: appends to the store (a table of the shared folder) what it lacks, one row per
    key, and returns how many were new. Running a batch again adds nothing."""
    from quire.operators.deliveries import keep_first
    from pyspark.sql.utils import AnalysisException

    new = keep_first(batch, keys, order)
    try:
        known = batch.sparkSession.read.schema(batch.schema).parquet(store)
        new = new.join(known.select(*keys), keys, "left_anti").select(*batch.columns)
    except AnalysisException:
        pass
    new = new.persist()
    try:
        n = new.count()
        if n:
            new.write.mode("append").parquet(store)
        return n
    finally:
        new.unpersist()


def mark_entries(entries: DataFrame, marks: DataFrame, keys: list[str], column: str) -> DataFrame:
    """entries with ``column`` as marks (keys, column) say, of several for an entry the greatest; others
    keep theirs. A bulk update: one join, whatever the number of marks."""
    new = marks.groupBy(*keys).agg(F.max(column).alias("__new"))
    return entries.join(new, keys, "left").withColumn(column, F.coalesce("__new", column)).select(*entries.columns)


def unread_counts(entries: DataFrame, group: str) -> DataFrame:
    """Entries and unread ones (read is false or null) per group, over a batch or a stream."""
    return entries.groupBy(group).agg(F.count("*").alias("entries"), F.count_if(~F.coalesce(F.col("read"), F.lit(False))).alias("unread"))


def first_arrivals(stream: DataFrame, keys: list[str], event_time: str, watermark: str) -> DataFrame:
    """First arrival of each identifier, remembered as long as the watermark says."""
    return stream.filter(identified(stream, keys)).withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(keys)
