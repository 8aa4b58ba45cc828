"""Filling fixed-capacity containers: a plan over the histogram of sizes, joined to items by rank.

Best fit (larger sizes first) runs over counts of sizes, not over items: a group of containers with
the same free space is one entry, and takes as many items of a size as fit at once. Each step of the
plan is a run: ranks [rank_lo, rank_hi) of a size go into consecutive containers, ``each`` into one.
Items get their rank within their size, and with it their slot.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import stage

RUN = "kind int, size bigint, rank_lo bigint, rank_hi bigint, first_container bigint, each bigint, first_slot bigint, first_offset bigint"
BLOCK = 256  # ranks for which runs are looked up together
PER_BUCKET = 500_000  # items of one size that one task ranks


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, ...]], int]:
    """Runs, and the number of containers, for sizes from 1 to capacity. Zero sizes have no run."""
    runs: list[tuple[int, ...]] = []
    free: list[int] = []  # distinct free spaces, ascending
    groups: dict[int, list[tuple[int, int, int]]] = {}  # free space: (first container, containers, items in each)
    made = 0

    def put(space: int, group: tuple[int, int, int]) -> None:
        if space:
            if space not in groups:
                groups[space] = []
                insort(free, space)
            groups[space].append(group)

    for size in sorted((s for s in histogram if s > 0), reverse=True):
        if size > capacity:
            raise ValueError(f"an item of {size} is larger than {capacity}")
        left, rank = histogram[size], 0
        while left:
            at = bisect_left(free, size)
            if at == len(free):
                space, each = capacity, capacity // size
                first, n, items = made, -(-left // each), 0
                made += n
            else:
                space = free[at]
                first, n, items = groups[space].pop()
                if not groups[space]:
                    del groups[space], free[at]
                each = space // size
            full = min(n, left // each)
            if full:
                runs.append((size, rank, rank + full * each, first, each, items, capacity - space))
                put(space - each * size, (first, full, items + each))
                rank, left = rank + full * each, left - full * each
            if n > full and 0 < left < each:  # one container takes the rest
                runs.append((size, rank, rank + left, first + full, left, items, capacity - space))
                put(space - left * size, (first + full, 1, items + left))
                rank, left, full = rank + left, 0, full + 1
            if n > full:
                put(space, (first + full, n - full, items))
    return runs, made



def pieces(df: DataFrame, key: str, size: str, capacities: list[int]) -> DataFrame:
    """Items for each kind of container (its place in capacities), none larger than its capacity: a larger
    one becomes pieces, all but the last of them full."""
    n = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in enumerate(capacities)))).alias("k")
    out = df.select(F.col(f"`{key}`"), n.alias("__n"), kinds).select(F.col(f"`{key}`"), "__n", "k.kind", "k.capacity")
    last = F.greatest(F.ceil(F.col("__n") / F.col("capacity")) - 1, F.lit(0))
    out = out.select(F.col(f"`{key}`"), "__n", "kind", "capacity", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    start = F.col("piece") * F.col("capacity")
    return out.select(F.col(f"`{key}`"), "kind", F.col("piece").cast("int").alias("piece"), start.alias("token_from"), F.least("capacity", F.col("__n") - start).alias("size"))


def pack_kinds(df: DataFrame, key: str, size: str, capacities: list[int]) -> DataFrame:
    """Assigns every row of (key, size) to containers of each kind: key, kind (place in capacities), piece,
    token_from, size, container_id, slot, container_offset.

    Rows no larger than the capacity stay whole; larger ones are cut into full containers and a rest,
    which is packed like any item. Null and zero sizes take no space: they are spread over the
    containers in turn and have no slot (null). Equal keys and sizes are items of their own. An empty
    df gives no row. df is read twice, so it should be a stored table. The driver holds a histogram
    for each kind, at most capacity + 1 numbers, and its plan. All kinds are ranked and joined at
    once; a size on any share of all rows is ranked in buckets of about PER_BUCKET rows; ranks differ
    between runs only among equal (key, piece, size).
    """
    spark = df.sparkSession
    item = pieces(df, key, size, capacities)
    histogram: dict[int, dict[int, int]] = {k: {} for k in range(len(capacities))}
    for r in item.groupBy("kind", "size").agg(F.count("*").alias("n")).collect():
        histogram[r["kind"]][r["size"]] = r["n"]
    plans = [plan(histogram[k], c) for k, c in enumerate(capacities)]
    most = max((n for h in histogram.values() for n in h.values()), default=0)
    buckets = max(1, -(-most // PER_BUCKET))
    item = item.withColumn("bucket", F.pmod(F.xxhash64(F.col(f"`{key}`"), "piece"), F.lit(buckets)))
    own = Window.partitionBy("kind", "size", "bucket").orderBy(F.col(f"`{key}`"), "piece")
    item = item.withColumn("rank", F.row_number().over(own).cast("bigint") - 1)
    if buckets > 1:
        item = item.join(earlier_buckets(pieces(df, key, size, capacities), key, buckets), ["kind", "size", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before")
    made = F.element_at(F.array(*(F.lit(max(n, 1)).cast("bigint") for _, n in plans)), F.col("kind") + 1)
    zero = item.filter("size = 0").withColumns({"container_id": F.pmod(F.col("rank"), made), "slot": F.lit(None).cast("bigint"), "container_offset": F.lit(None).cast("bigint")})
    run = run_table(spark, [(k, *r) for k, (runs, _) in enumerate(plans) for r in runs]).withColumn("block", F.explode(F.expr(f"sequence(rank_lo div {BLOCK}, (rank_hi - 1) div {BLOCK})")))
    item = item.filter("size > 0").withColumn("block", F.expr(f"rank div {BLOCK}"))
    item = item.join(run, ["kind", "size", "block"]).filter("rank >= rank_lo and rank < rank_hi")
    item = item.withColumn("__at", F.col("rank") - F.col("rank_lo"))
    item = item.withColumns({
        "container_id": F.col("first_container") + F.expr("__at div each"),
        "slot": F.col("first_slot") + F.col("__at") % F.col("each"),
        "container_offset": F.col("first_offset") + F.col("__at") % F.col("each") * F.col("size"),
    })
    columns = [F.col(f"`{key}`"), "kind", "piece", "token_from", "size", "container_id", "slot", "container_offset"]
    return item.select(*columns).unionByName(zero.select(*columns))


def pack(df: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """pack_kinds() for one capacity, without kind."""
    return pack_kinds(df, key, size, [capacity]).drop("kind")


def earlier_buckets(item: DataFrame, key: str, buckets: int) -> DataFrame:
    """How many items of a size lie in earlier buckets; a group of the window has one row a bucket."""
    n = item.withColumn("bucket", F.pmod(F.xxhash64(F.col(f"`{key}`"), "piece"), F.lit(buckets))).groupBy("kind", "size", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("kind", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return n.select("kind", "size", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def run_table(spark: SparkSession, runs: list[tuple[int, ...]]) -> DataFrame:
    names = [c.split()[0] for c in RUN.split(", ")]
    columns = list(zip(*runs, strict=True)) if runs else [()] * len(names)
    types = [pa.int32() if n == "kind" else pa.int64() for n in names]
    return spark.createDataFrame(pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)}), RUN)


def pack_by_tokens(counts: DataFrame, containers: DataFrame, key: str, max_capacities: int = 64) -> DataFrame:
    """pack() for each row of containers (container_name, capacity_tokens), a table of settings."""
    counts = stage(counts, "token-counts")
    kinds = containers.select("container_name", "capacity_tokens").distinct().orderBy("container_name").limit(max_capacities + 1).collect()
    if len(kinds) > max_capacities:
        raise ValueError(f"more than {max_capacities} kinds of containers")
    usable = [(name, int(c)) for name, c in kinds if c and c > 0]
    if not usable:
        return pack(counts.limit(0), key, "n_tokens", 1).withColumn("container_name", F.lit(""))
    out = pack_kinds(counts, key, "n_tokens", [c for _, c in usable])
    return out.withColumn("container_name", F.element_at(F.array(*(F.lit(name) for name, _ in usable)), F.col("kind") + 1)).drop("kind")
