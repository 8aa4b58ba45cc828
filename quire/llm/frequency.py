"""Frequency of every distinct term: a global integer dictionary and count arrays by identifier.

Each task folds its records into blocks: a local dictionary with, for each term, its occurrences and
the number of records that hold it. The distinct terms of all blocks make the global dictionary, whose
identifiers are dense within its partitions. Blocks are encoded with it and laid out as count arrays
over ranges of identifiers; arrays of the same range are summed in two steps, first within each of WAYS
shares of the tasks, so that no task holds more than a share of the arrays of one range.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import stage

BLOCK_TERMS = 100_000  # distinct terms after which a task hands on a block
SPAN = 1024  # identifiers in a range
WAYS = 256  # shares of the tasks in which arrays are summed first
ARRAYS = "range bigint, start int, occurrences array<bigint>, records array<bigint>"
PARTIAL = "field_name string, term string, occurrences bigint, records bigint"


@F.pandas_udf(T.StringType())
def one_width(text: pd.Series) -> pd.Series:
    """Lower case, compatibility forms unified."""
    nfkc = lambda s: s if s.isascii() else unicodedata.normalize("NFKC", s)
    return text.map(lambda s: nfkc(nfkc(s).lower()), na_action="ignore")


def blocks(terms: DataFrame) -> DataFrame:
    """Per task, the counts of (record, field_name, term) rows whose records aren't spread over tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[tuple[str, str], int] = {}
        n, held, last = [], [], []

        def out() -> pa.RecordBatch:
            names = list(place)
            return pa.RecordBatch.from_arrays([pa.array([f for f, _ in names], pa.string()), pa.array([t for _, t in names], pa.string()), pa.array(n, pa.int64()), pa.array(held, pa.int64())], ["field_name", "term", "occurrences", "records"])

        for b in batches:
            for record, field, term in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                k = place.setdefault((field, term), len(place))
                if k == len(n):
                    n.append(1)
                    held.append(1)
                    last.append(record)
                else:
                    n[k] += 1
                    if last[k] != record:  # a record's rows of a field follow each other
                        held[k] += 1
                        last[k] = record
            if len(place) >= BLOCK_TERMS:
                # The record that the batch broke off in may go on: its terms stay for the next block
                yield out()
                keep = [(key, last[k]) for key, k in place.items() if last[k] == record]
                place.clear()
                n, held, last = [], [], []
                for key, own in keep:
                    place[key] = len(n)
                    n.append(0)
                    held.append(0)
                    last.append(own)
        if place:
            yield out()

    return terms.mapInArrow(run, PARTIAL)


def total(table: pa.Table) -> np.ndarray:
    """Occurrences and records (rows) by identifier within a range (columns)."""
    out = np.zeros((2, SPAN), np.int64)
    for start, *arrays in zip(table.column("start").to_pylist(), table.column("occurrences"), table.column("records")):
        for k, a in enumerate(arrays):
            values = a.values.to_numpy(zero_copy_only=False)
            out[k, start : start + len(values)] += values
    return out


def sums(encoded: DataFrame) -> DataFrame:
    """Occurrences and records by identifier, from rows (way, range, start, occurrences[], records[])."""

    def share(table: pa.Table) -> pa.Table:
        own = total(table)
        at = np.flatnonzero(own[0])
        low, high = (int(at[0]), int(at[-1]) + 1) if len(at) else (0, 0)
        lists = [pa.array([own[k, low:high]], pa.list_(pa.int64())) for k in range(2)]
        return pa.table([table.column("range").slice(0, 1), pa.array([low], pa.int32()), *lists], ["range", "start", "occurrences", "records"])

    def add(table: pa.Table) -> pa.Table:
        own = total(table)
        at = np.flatnonzero(own[0])
        first = table.column("range")[0].as_py() * SPAN
        return pa.table({"id": pa.array(first + at, pa.int64()), "occurrences": pa.array(own[0, at]), "records": pa.array(own[1, at])})

    shares = encoded.groupBy("range", "way").applyInArrow(share, ARRAYS)
    return shares.groupBy("range").applyInArrow(add, "id bigint, occurrences bigint, records bigint")


def count_arrays(coded: DataFrame) -> DataFrame:
    """Lays a task's (id, occurrences, records) out as arrays over ranges of identifiers. An array runs
    from the first to the last identifier met in its range, so a lone one costs one number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, occ, rec = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(ids):
                continue
            order = np.argsort(ids, kind="stable")
            ids, occ, rec = ids[order], occ[order], rec[order]
            cut = np.flatnonzero(np.diff(ids // SPAN)) + 1
            ranges, starts, o, r = [], [], [], []
            for i, a, c in zip(np.split(ids, cut), np.split(occ, cut), np.split(rec, cut), strict=True):
                low = int(i[0])
                ranges.append(low // SPAN)
                starts.append(low % SPAN)
                o.append(np.bincount(i - low, a).astype(np.int64))
                r.append(np.bincount(i - low, c).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array(starts, pa.int32()), pa.array(o, pa.list_(pa.int64())), pa.array(r, pa.list_(pa.int64()))], ["range", "start", "occurrences", "records"])

    return coded.mapInArrow(run, ARRAYS).withColumn("way", F.pmod(F.spark_partition_id(), F.lit(WAYS)))


def term_frequencies(terms: DataFrame, records: int | None = None, min_records: int = 3, max_share: float = 0.2) -> DataFrame:
    """field_name, term, occurrences, records, mark of every distinct term of every field.

    terms: rows (record, field_name, term); the rows of one record must be in one task and those of one
    of its fields together, as a narrow operation on records leaves them. Null terms count nothing, the empty term is a term.
    records: how many records there are, counting those without a term. mark: ``rare`` in fewer than
    min_records records, ``common`` in more than max_share of them all, else null; rare wins. Repeats
    within a record count as occurrences. A term of a third of all rows reaches the shuffle once a
    block; an empty input gives no row.
    """
    partial = stage(blocks(terms.filter("term is not null")), "term-blocks")
    known = stage(partial.select("field_name", "term").distinct(), "term-names")
    known = stage(known.withColumn("id", F.monotonically_increasing_id()), "term-dictionary")
    coded = partial.join(known, ["field_name", "term"]).select("id", "occurrences", "records")
    total = sums(count_arrays(coded)).join(known, "id")
    mark = F.when(F.col("records") < min_records, "rare")
    if records is not None:
        mark = mark.when(F.col("records") > F.lit(max_share) * records, "common")
    return total.select("field_name", "term", "occurrences", "records", mark.alias("mark"))
