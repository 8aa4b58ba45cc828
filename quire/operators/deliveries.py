"""Messages delivered more than once: exactly one delivery of each is kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import free_name
from quire.store import add_segment, read_segments, segments


def identified(df: DataFrame, keys: list[str]) -> Column:
    """Whether every part of the identifier is there; null and empty ones identify nothing."""
    there = [F.col(f"`{k}`").isNotNull() & (F.col(f"`{k}`") != "") if t == "string" else F.col(f"`{k}`").isNotNull() for k, t in ((k, dict(df.dtypes)[k]) for k in keys)]
    return reduce(lambda a, b: a & b, there)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first delivery of each identified message: rank by arrival, ties by the later order columns.

    The engine ranks within each map task first and sends one row per message on (a partial window
    group limit), so a message with a third of all deliveries adds one row per task to the shuffle.
    order must end in a unique column; nulls in it come last.
    """
    first = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*[F.asc_nulls_last(f"`{c}`") for c in order])
    rank = free_name(df, "__rank")
    return df.filter(identified(df, keys)).withColumn(rank, F.row_number().over(first)).filter(F.col(rank) == 1).drop(rank)


def repeats(df: DataFrame, keys: list[str], order: list[str], unique: str) -> DataFrame:
    """The unique ids of all identified deliveries but the kept ones."""
    narrow = df.select(*{c: None for c in [*keys, *order, unique]})
    kept = keep_first(narrow, keys, order).select(unique)
    return narrow.filter(identified(narrow, keys)).select(unique).join(kept, unique, "left_anti")


def deduplicate(df: DataFrame, keys: list[str], order: list[str], stored: DataFrame | None = None) -> DataFrame:
    """df with one delivery of each message, and all rows without an identifier.

    stored: identifiers of earlier batches (columns keys); messages among them are left out. Every
    column of df is kept, whatever its name. An empty df or store gives what one expects: nothing
    kept, or nothing left out.
    """
    first = keep_first(df, keys, order)
    if stored is not None:
        names = [F.col(f"`{k}`") for k in keys]
        first = first.join(stored.select(*names).distinct(), keys, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
    return first.unionByName(df.filter(~identified(df, keys)))


def admit(batch: DataFrame, name: str, store: str, keys: list[str], order: list[str]) -> DataFrame:
    """One delivery of each message of a batch that no earlier batch had; all rows without identifiers.

    The store (see quire.store) keeps one segment of identifiers per batch. Names sort in the order in
    which batches are admitted, one after another; a batch whose job broke off, or that comes again, is
    compared with the segments before its own, so it gives the same rows again.
    """
    spark = batch.sparkSession
    ids = batch.select(*[F.col(f"`{k}`") for k in keys])
    paths = [p for p in segments(spark, store) if p.rstrip("/").rsplit("/", 1)[-1] < name]
    known = read_segments(spark, paths, ids.schema)
    first = deduplicate(batch, keys, order, known)
    new = first.filter(identified(first, keys)).select(*[F.col(f"`{k}`") for k in keys])
    add_segment(new, store, name)
    return first


def keep_first_stream(stream: DataFrame, keys: list[str], event_time: str, watermark: str) -> DataFrame:
    """The same over a stream: the first arrival of each identifier within the watermark."""
    return stream.filter(identified(stream, keys)).withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(keys)
