"""Mixed timestamp formats and zones: a dictionary of distinct raw values, parsed once each and kept."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.instants import parse
from quire.session import stage
from quire.store import add_segment, read_segments, segments

KEY = ["field_name", "raw", "zone_name", "day_first"]
DICTIONARY = "field_name string, raw string, zone_name string, day_first boolean, epoch_ms bigint"
#: Goes up when parse() reads a value in another way: a kept dictionary holds for one reading.
READING = 2


def parse_distinct(values: DataFrame) -> DataFrame:
    """Parses each row of KEY exhaustively; epoch_ms is null if none is stated."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ms = [parse(*x) for x in zip(*(b.column(k).to_pylist() for k in range(1, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ms, pa.int64())], [*KEY, "epoch_ms"])

    return values.select(*KEY).mapInArrow(run, DICTIONARY)


def extend_dictionary(values: DataFrame, path: str | None) -> DataFrame:
    """Dictionary of all distinct values (no nulls among them). With a path, what was parsed in earlier
    runs is read, only what they lack is parsed, and is kept as a segment of its own; without one, a
    table of this run."""
    distinct = values.distinct()
    if path is None:
        return stage(parse_distinct(distinct), "instants")
    spark = values.sparkSession
    path = f"{path.rstrip('/')}/reading-{READING}"
    known = read_segments(spark, segments(spark, path), DICTIONARY)
    own = add_segment(parse_distinct(distinct if known is None else distinct.join(known, KEY, "left_anti")), path)
    added = spark.read.schema(DICTIONARY).parquet(own)
    if known is None:
        return added
    # two runs at once may each have added a value; the join by KEY needs this partitioning anyway
    return known.unionByName(added).groupBy(*KEY).agg(F.max("epoch_ms").alias("epoch_ms"))


def normalise_instants(rows: DataFrame, dictionary_path: str | None = None) -> DataFrame:
    """field_name, row_key, epoch_ms for rows of (field_name, row_key, raw, zone_name, day_first).

    Only rows whose raw value states an instant come out; null and blank ones never leave the scan. The
    dictionary's key is the source (field_name), the raw value, its zone and the order of its dates; it
    is made with a partial aggregate before its shuffle, so a value on a third of all rows travels once
    for each map task. The join back shuffles rows by the same key; a hot value's partition is split by
    the engine's skew join, as the dictionary side has one row per value. Repeated rows stay repeated.
    Zone null or unknown means UTC, day_first null means day first, field_name null is the source "".
    """
    rows = rows.select(F.coalesce("field_name", F.lit("")).alias("field_name"), "row_key", "raw", "zone_name", F.coalesce("day_first", F.lit(True)).alias("day_first"))
    rows = rows.withColumn("zone_name", F.coalesce("zone_name", F.lit("UTC"))).filter(F.length(F.trim("raw")) > 0)
    words = extend_dictionary(rows.select(*KEY), dictionary_path).filter("epoch_ms is not null")
    return rows.join(words, KEY).select("field_name", "row_key", "epoch_ms")
