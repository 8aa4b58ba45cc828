"""Duplicates hidden by formatting: canonical records, sorted over ranges, and runs of equal ones.

Records are range-partitioned by the hash of their canonical form and their id, sorted in each
partition (the engine's external sort) and scanned once: neighbours with equal full keys are a run. As
the id is part of the range, a run may go over several partitions, so no group has to fit one task. The
ends of the partitions, digests of keys and ids, are a small table; the rows of a run that began in an
earlier partition get their first id from it.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.rollup import sorted_object
from quire.session import ranges, shared_dir, stage

SEPARATOR = "\x1f"


def letters_and_digits(column: pa.Array) -> pa.Array:
    """Letters and digits in one letter case, compatibility and composed forms unified. (Arrow's own
    normalisation leaves marks apart from their letters.)"""
    nfkc = lambda s: s if s.isascii() else unicodedata.normalize("NFKC", s)
    folded = [None if s is None else nfkc(nfkc(s).casefold()) for s in column.to_pylist()]
    return pc.replace_substring_regex(pa.array(folded, pa.string()), r"[^\p{L}\p{N}]+", "")


def canonical(df: DataFrame, key: str, texts: list[str], needed: list[str], objects: list[str]) -> DataFrame:
    """key and __key, the canonical form; null where a text of needed is null or has no letter or digit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, keep = [], None
            for k, name in enumerate(texts):
                form = letters_and_digits(b.column(1 + k))
                if name in needed:
                    there = pc.fill_null(pc.not_equal(form, ""), False)
                    keep = there if keep is None else pc.and_(keep, there)
                parts.append(pc.fill_null(form, ""))
            for k in range(len(objects)):
                parts.append(pa.array([sorted_object(s) for s in b.column(1 + len(texts) + k).to_pylist()], pa.string()))
            form = pc.binary_join_element_wise(*parts, SEPARATOR)
            if keep is not None:
                form = pc.if_else(keep, form, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), form], [key, "__key"])

    columns = [key, *texts, *objects]
    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, __key string")


def first_of_runs(keys: pa.Array, ids: pa.Array, last: str | None, begin: object, started: bool) -> tuple[pa.Array, np.ndarray]:
    """The id that begins each row's run, and the rows that begin one; the run before is (last, begin)."""
    new = np.ones(len(keys), bool)
    new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    if started:
        new[0] = keys[0].as_py() != last
    at = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    own = ids.take(pa.array(at))
    if not new[0]:
        own = pa.concat_arrays([pa.array([begin], ids.type), own])
        run += 1
    return own.take(pa.array(run)), new


def digest(key: str) -> str:
    return blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def runs(keyed: DataFrame, key: str) -> DataFrame:
    """first_id and copy_id for every row of (key, __key) with a __key; first_id is the least id of equal
    keys.

    Equal (key, __key) rows are copies of each other like any. The sorted rows are stored once by
    checkpoint(), in ranges by the size of keyed, which should be a stored table. What leaves a task
    beside its rows is one row of digests and ids for its partition.
    """
    shared_dir(keyed.sparkSession)
    rows = keyed.filter("__key is not null").select(F.xxhash64("__key").alias("__hash"), F.col("__key"), F.col(f"`{key}`").alias("id"))
    rows = rows.repartitionByRange(ranges(keyed), "__hash", "__key", "id").sortWithinPartitions("__hash", "__key", "id").checkpoint()
    id_type = rows.schema["id"].dataType.simpleString()
    rows = rows.select("__key", "id", F.spark_partition_id().alias("part"))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = begin = None
        started, first_run = False, True
        for b in batches:
            if not b.num_rows:
                continue
            firsts, new = first_of_runs(b.column(0), b.column(1), last, begin, started)
            later = new.copy()
            if not started:
                later[0] = False
            head = first_run & (np.cumsum(later) == 0)  # rows of the partition's first run, which may go on from another
            first_run = bool(head[-1])
            started, last, begin = True, b.column(0)[b.num_rows - 1].as_py(), firsts[len(firsts) - 1].as_py()
            part = pc.if_else(pa.array(head), b.column(2), pa.scalar(None, pa.int32()))
            yield pa.RecordBatch.from_arrays([firsts, b.column(1), part], ["first_id", "copy_id", "part"])

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = begin = part = None
        for b in batches:
            if not b.num_rows:
                continue
            firsts, _ = first_of_runs(b.column(0), b.column(1), last, begin, part is not None)
            if part is None:
                first, part = b.column(0)[0].as_py(), b.column(2)[0].as_py()
            last, begin = b.column(0)[b.num_rows - 1].as_py(), firsts[len(firsts) - 1].as_py()
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([digest(first)]), pa.array([digest(last)]), pa.array([begin], b.column(1).type)], ["part", "first", "last", "begin"])

    # one row a partition: in order, a partition's last run begins in it unless all of it goes on
    order = Window.orderBy("part")
    edge = rows.mapInArrow(ends, f"part int, first string, last string, begin {id_type}")
    edge = edge.withColumn("goes_on", F.coalesce(F.col("first") == F.lag("last").over(order), F.lit(False)))
    edge = edge.withColumn("own", F.when(~(F.col("goes_on") & (F.col("first") == F.col("last"))), F.col("begin")))
    before = F.last("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    carried = edge.withColumn("carried", before).filter("goes_on").select("part", "carried")
    out = rows.mapInArrow(scan, f"first_id {id_type}, copy_id {id_type}, part int")
    head = out.filter("part is not null").join(carried, "part", "left")
    return out.filter("part is null").select("first_id", "copy_id").unionByName(head.select(F.coalesce("carried", "first_id").alias("first_id"), "copy_id"))


def hidden_duplicates(df: DataFrame, key: str, texts: list[str], needed: list[str], objects: list[str]) -> DataFrame:
    """first_id, copy_id of every record that equals one with a smaller id.

    texts are equal when their letters and digits are; objects (JSON) when keys and values are, in any
    order. A record with a null or blank text of needed equals none. Other nulls equal each other.
    """
    return runs(stage(canonical(df, key, texts, needed, objects), "canonical"), key).filter("copy_id <> first_id")


def collapse(df: DataFrame, key: str, texts: list[str], needed: list[str], objects: list[str]) -> DataFrame:
    """first_id and copies (exact count) of every distinct record; incomparable records stand alone."""
    keyed = stage(canonical(df, key, texts, needed, objects), "canonical")
    counted = runs(keyed, key).groupBy("first_id").agg(F.count("*").alias("copies"))
    return counted.unionByName(keyed.filter("__key is null").select(F.col(f"`{key}`").alias("first_id"), F.lit(1).cast("bigint").alias("copies")))
