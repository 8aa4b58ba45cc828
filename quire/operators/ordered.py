"""Ranks and running totals over a whole table, without bringing it into one task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import ranges, shared_dir


def running(df: DataFrame, order: list[Column], value: Column | None = None) -> DataFrame:
    """df with row_no (from 1) and total (the value's running sum, this row's included) in a global order.

    Rows are range-partitioned by the order (by the size of df), sorted in each partition and stored by
    checkpoint(); what each partition starts with comes from the counts and sums of those before it: two
    numbers a partition, on the driver and in the tasks.
    order must be total for a defined result. Null values count 0. Columns named row_no or total in df
    are an error, as for any added column.
    """
    shared_dir(df.sparkSession)
    amount = F.coalesce(value.cast("bigint"), F.lit(0)) if value is not None else F.lit(0).cast("bigint")
    rows = df.withColumn("__amount", amount).repartitionByRange(ranges(df), *order).sortWithinPartitions(*order).checkpoint()
    rows = rows.withColumn("__part", F.spark_partition_id())
    start: dict[int, tuple[int, int]] = {}
    count = total = 0
    for r in sorted(rows.groupBy("__part").agg(F.count("*").alias("n"), F.sum("__amount").alias("s")).collect()):
        start[r["__part"]] = (count, total)
        count, total = count + r["n"], total + r["s"]

    names = [*df.columns, "row_no", "total"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            if not b.num_rows:
                continue
            if at is None:
                at = start[b.column(b.num_columns - 1)[0].as_py()]
            amounts = b.column(b.num_columns - 2).to_numpy(zero_copy_only=False)
            numbers = np.arange(at[0] + 1, at[0] + 1 + b.num_rows)
            sums = at[1] + np.cumsum(amounts)
            at = (int(numbers[-1]), int(sums[-1]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(numbers), pa.array(sums)], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return rows.mapInArrow(run, f"{schema}, row_no bigint, total bigint")


LEAST = np.iinfo(np.int64).min


def previous_max(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """df with before_max: the greatest value among the earlier rows of the same key, null for the first.

    Like running(): the order within a key is part of the range, so a key with any share of all rows is
    spread over partitions. The ends of partitions, digests of keys and maxima, are a small table; rows
    of a key that began in an earlier partition get its maximum from it. Null values don't count; null
    keys are a key. The least bigint counts as null.
    """
    shared_dir(df.sparkSession)
    key = F.sha2(F.to_json(F.struct(*(F.col(f"`{k}`") for k in keys)), {"ignoreNullFields": "false"}), 256)
    rows = df.withColumn("__key", key).withColumn("__value", F.coalesce(F.col(f"`{value}`").cast("bigint"), F.lit(int(LEAST))))
    places = [F.col("__key"), *order]
    rows = rows.repartitionByRange(ranges(df), *places).sortWithinPartitions(*places).checkpoint().withColumn("__part", F.spark_partition_id())

    def step(b: pa.RecordBatch, last: str | None, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: its run (0 goes on with the one before), the maximum before it and with it."""
        n = b.num_columns
        k, v = b.column(n - 3).to_pandas(), b.column(n - 2).to_numpy(zero_copy_only=False)
        run = (k != k.shift(fill_value=last if last is not None else "")).cumsum().to_numpy()
        v = np.append(most, v)  # what the run before has come to
        upto = pd.Series(v).groupby(np.append(0, run)).cummax().to_numpy()
        before = np.append(LEAST, upto[:-1])
        before[1:][np.diff(np.append(0, run)) > 0] = LEAST
        return run, before[1:], upto[1:]

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = part = None
        most = int(LEAST)
        for b in batches:
            if not b.num_rows:
                continue
            _, _, upto = step(b, last, most)
            if part is None:
                first, part = b.column(0)[0].as_py(), b.column(2)[0].as_py()
            last, most = b.column(0)[b.num_rows - 1].as_py(), int(upto[-1])
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first]), pa.array([last]), pa.array([most], pa.int64())], ["part", "first", "last", "most"])

    names = [*df.columns, "__before", "__head"]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, most, head = None, int(LEAST), True
        for b in batches:
            if not b.num_rows:
                continue
            run, before, upto = step(b, last, most)
            own = (run == (1 if last is None else 0)) & head  # the partition's first run, which may go on from another
            head = bool(own[-1])
            n = b.num_columns
            last, most = b.column(n - 3)[b.num_rows - 1].as_py(), int(upto[-1])
            part = pa.array(np.where(own, b.column(n - 1).to_numpy(zero_copy_only=False), -1), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[: n - 3], pa.array(before), part], names)

    at = Window.orderBy("part")  # one row a partition
    edge = rows.select("__key", "__value", "__part").mapInArrow(ends, "part int, first string, last string, most bigint")
    edge = edge.withColumn("goes_on", F.coalesce(F.col("first") == F.lag("last").over(at), F.lit(False)))
    edge = edge.withColumn("chain", F.sum(F.when(F.col("goes_on") & (F.col("first") == F.col("last")), 0).otherwise(1)).over(at))
    edge = edge.withColumn("upto", F.max("most").over(Window.partitionBy("chain").orderBy("part")))
    carried = edge.withColumn("__carried", F.lag("upto").over(at)).filter("goes_on").select(F.col("part").alias("__head"), "__carried")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    out = rows.mapInArrow(scan, f"{schema}, __before bigint, __head int")
    own = [F.col(f"`{c}`") for c in df.columns]
    result = lambda x: F.nullif(x, F.lit(int(LEAST))).alias("before_max")
    going_on = out.filter("__head >= 0").join(carried, "__head", "left").select(*own, result(F.greatest("__before", "__carried")))
    return out.filter("__head < 0").select(*own, result(F.col("__before"))).unionByName(going_on)
