"""Keyed tables: listings, upserts, cache coverage and retention, progress, matching of chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import locator_key, switch_title, title_key, utrim
from quire.operators.ordered import previous_max, running
from quire.session import free_name

BOOK = ["source_id", "book_id"]
DAY = 86_400


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order: an upsert where the last one wins. Only the best row of a
    key leaves each map task."""
    n = free_name(df, "__n")
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(n) == 1).drop(n)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """current with the last change of each key in the place of its row."""
    new = latest(changes, keys, [F.desc(arrival)])
    return current.join(new.select(*keys), keys, "left_anti").select(*current.columns).unionByName(new.select(*current.columns))


def delete_by(current: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(gone.select(*keys).distinct(), keys, "left_anti").select(*current.columns)


# ---- shelf ------------------------------------------------------------------------------------


def shelf_order(by: str = "manual", descending: bool = False) -> list[Column]:
    """manual turns all its keys round; other orders keep ascending keys for ties."""
    if by == "manual":
        own = ["sort_index", "added_at", "source_id", "book_id"]
        way = [False, True, False, False]
        return [F.desc(c) if w != descending else F.asc(c) for c, w in zip(own, way)]
    first = F.desc_nulls_last(by) if descending else F.asc_nulls_first(by)
    return [first, F.asc("source_id"), F.asc("book_id")]


def shelf_query(shelf: DataFrame, source: str | None = None, group: str | None = None, keyword: str | None = None, by: str = "manual", descending: bool = False, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page of the shelf. A blank source or group is an error, a blank keyword no filter; the keyword
    is sought in title, author and book_id, ASCII letters in either case."""
    for name, wanted in (("source", source), ("group", group)):
        if wanted is not None and not wanted.strip():
            raise ValueError(f"blank {name}")
    out = shelf
    if source is not None:
        out = out.filter(F.col("source_id") == source)
    if group is not None:
        out = out.filter(F.col("group_name") == group)
    if keyword and keyword.strip():
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        word = keyword.strip().translate(str.maketrans(upper, lower))
        hit = F.lit(False)
        for c in ("title", "author", "book_id"):
            hit = hit | F.contains(F.translate(F.col(c), upper, lower), F.lit(word))
        out = out.filter(hit)
    out = out.orderBy(*shelf_order(by, descending))
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def with_rows_in(df: DataFrame, other: DataFrame, keys: list[str], there: bool = True) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_semi" if there else "left_anti")


# ---- chapter cache ----------------------------------------------------------------------------


def cache_stats(cache: DataFrame, by: list[str]) -> DataFrame:
    return cache.groupBy(*by).agg(F.count("*").alias("entries"), F.sum(F.octet_length("content")).cast("bigint").alias("bytes"), F.min("cached_at").alias("oldest"), F.max("cached_at").alias("newest"))


def cache_coverage(cache: DataFrame, books: DataFrame) -> DataFrame:
    """Per book (source_id, book_id, chapter_count): which of chapters 0..count-1 are cached and which
    aren't, with counts, bytes and times. A chapter number bounds the arrays, not the table."""
    n = cache.groupBy(*BOOK).agg(F.sort_array(F.collect_set("chapter_index")).alias("__own"), F.sum(F.octet_length("content")).cast("bigint").alias("bytes"), F.min("cached_at").alias("oldest"), F.max("cached_at").alias("newest"))
    all_of = F.when(F.col("chapter_count") > 0, F.sequence(F.lit(0), F.col("chapter_count") - 1)).otherwise(F.array().cast("array<int>"))
    out = books.join(n, BOOK, "left").withColumn("__all", all_of).withColumn("__own", F.coalesce("__own", F.array().cast("array<int>")))
    cached = F.array_sort(F.array_intersect("__all", "__own"))
    missing = F.array_sort(F.array_except("__all", "__own"))
    return out.select(*BOOK, "chapter_count", cached.alias("cached"), missing.alias("missing"), F.size(cached).alias("cached_count"), F.size(missing).alias("missing_count"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "oldest", "newest")


def prefetch(cache: DataFrame, anchors: DataFrame, before: int, after: int, most: int) -> DataFrame:
    """Chapters to fetch per anchor (source_id, book_id, chapter_count, anchor_index): those missing in
    [anchor - before, anchor + after], the first ``most`` of them."""
    low, high = F.greatest(F.lit(0), F.col("anchor_index") - before), F.least(F.col("chapter_count") - 1, F.col("anchor_index") + after)
    wanted = anchors.withColumn("chapter_index", F.explode(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))
    missing = wanted.join(cache.select(*BOOK, "chapter_index").distinct(), [*BOOK, "chapter_index"], "left_anti")
    rank = F.row_number().over(Window.partitionBy(*BOOK).orderBy("chapter_index"))
    return missing.withColumn("place", rank).filter(F.col("place") <= most).select(*BOOK, "chapter_index", "place")


def prune_cache(cache: DataFrame, oldest: int, most_entries: int, most_bytes: int) -> DataFrame:
    """What retention keeps: nothing cached before ``oldest``; of the rest the newest most_entries; of
    those the newest that fit most_bytes together. Ties go by source, book and chapter, higher first.

    A histogram by day, on the driver, says from which day on the limits may still hold; only rows since
    then are put in order."""
    order = [F.desc("cached_at"), F.desc("source_id"), F.desc("book_id"), F.desc("chapter_index")]
    rows = cache.filter(F.col("cached_at") >= oldest)
    days = rows.groupBy(F.floor(F.col("cached_at") / DAY).alias("day")).agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes")).collect()
    n = size = 0
    since = None
    for r in sorted(days, key=lambda r: -r["day"]):
        if n >= most_entries or size > most_bytes:
            break
        n, size, since = n + r["n"], size + (r["bytes"] or 0), r["day"] * DAY
    kept = running(rows.filter(F.col("cached_at") >= since) if since is not None else rows.limit(0), order, F.octet_length("content"))
    return kept.filter((F.col("row_no") <= most_entries) & (F.col("total") <= most_bytes)).select(*cache.columns)


def cached_share(cached: Column, total: Column) -> Column:
    """How much of a book is cached, 1 for a book without chapters."""
    return F.when(total == 0, 1.0).otherwise(cached / total)


def next_uncached(cached: Column, total: Column, most: int) -> Column:
    """array of the chapter numbers, counted from 1, that follow what is cached: at most ``most``, none
    beyond the total."""
    last = F.least(cached + most, total)
    return F.when(last > cached, F.sequence(cached + 1, last)).otherwise(F.array().cast("array<bigint>"))


def status_counts(rows: DataFrame, by: list[str], status: str, known: list[str]) -> DataFrame:
    """by, a count for each known status, other and total; a null status is other."""
    s = F.coalesce(F.col(status), F.lit(""))
    return rows.groupBy(*by).agg(*(F.count_if(s == k).alias(k) for k in known), F.count_if(~s.isin(known)).alias("other"), F.count("*").alias("total"))


# ---- progress ---------------------------------------------------------------------------------


def progress_latest(history: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The current row of each key: a late update is rejected, of equal times the later arrival wins."""
    return latest(history, keys, [F.desc("updated_at"), F.desc(arrival)])


def late_updates(history: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Rows of the history that never were current: something newer had arrived before them."""
    return previous_max(history, keys, [F.asc(arrival)], "updated_at").filter("updated_at < before_max").drop("before_max")


def neighbours(chapters: DataFrame, book: list[str], order: str, chapter: str) -> DataFrame:
    w = Window.partitionBy(*book).orderBy(order)
    return chapters.withColumns({"prev_id": F.lag(chapter).over(w), "next_id": F.lead(chapter).over(w)})


def prefetch_range(anchors: DataFrame, radius: int, most: int) -> DataFrame:
    """Ordinals around an anchor, whether or not the chapters exist."""
    start = F.greatest(F.lit(0), F.col("anchor") - radius)
    return anchors.withColumn("ordinal", F.explode(F.sequence(start, F.least(F.col("anchor") + radius, start + most - 1))))


# ---- chapters between versions and sources ------------------------------------------------------


def new_titles(new: DataFrame, old: DataFrame, book: list[str]) -> DataFrame:
    """Rows of new whose title isn't in the old list of the same book."""
    a = new.withColumn("__key", title_key(F.col("title")))
    b = old.select(*book, title_key(F.col("title")).alias("__key")).distinct()
    return a.join(b, [*book, "__key"], "left_anti").select(*new.columns)


def match_source(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """For each old chapter (group, chapter_index, title) the chapter of the new list where reading goes
    on: the first with the same title, else the one with the same index, else the first whose title is
    the same without numbering, else the first of all; none without a new list. Null titles are empty.

    The new list is reduced to one chapter a title before it is joined, so titles that repeat in both
    lists don't multiply.
    """
    title, fuzzy = F.coalesce("title", F.lit("")), switch_title(F.coalesce("title", F.lit("")))
    a = old.select(*group, F.col("chapter_index").alias("old_index"), title.alias("__title"), fuzzy.alias("__fuzzy"))
    b = new.select(*group, F.col("chapter_index").alias("new_index"), title.alias("__title"), fuzzy.alias("__fuzzy"))
    least = lambda by, name: b.groupBy(*group, *by).agg(F.min("new_index").alias(name))
    same_index = b.select(*group, F.col("new_index").alias("old_index"), F.col("new_index").alias("__index")).distinct()
    out = a.join(least(["__title"], "__exact"), [*group, "__title"], "left").join(same_index, [*group, "old_index"], "left")
    out = out.join(least(["__fuzzy"], "__near"), [*group, "__fuzzy"], "left").join(least([], "__first"), group, "left")
    steps = {"__exact": "exactTitle", "__index": "sameIndex", "__near": "fuzzyTitle", "__first": "first"}
    how = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(name)) for c, name in steps.items()), F.lit("none"))
    return out.select(*group, "old_index", F.coalesce(*steps).alias("new_index"), how.alias("matched_by"))


def migrate_progress(progress: DataFrame, matched: DataFrame, group: list[str], new_source: str, updated_at: int) -> DataFrame:
    """Progress (group, source_id, book_id, chapter_index, device_id) moved to the matched chapter of a
    new source, at its beginning; rows without a match are left out."""
    m = matched.filter("matched_by <> 'none'").select(*group, F.col("old_index").alias("chapter_index"), "new_index")
    at = progress.join(m, [*group, "chapter_index"])
    return at.select(*group, F.lit(new_source).alias("source_id"), "book_id", F.col("new_index").alias("chapter_index"), F.lit(0).cast("bigint").alias("chapter_offset"), F.lit(0.0).alias("chapter_progress"), F.lit(updated_at).cast("bigint").alias("updated_at"), "device_id")


def update_counts(new: DataFrame, old: DataFrame, group: list[str], locator: str) -> DataFrame:
    """group, entries and added: how many entries a list has, and how many the list before had not."""
    known = old.select(*group, locator).distinct().withColumn("__known", F.lit(True))
    return new.join(known, [*group, locator], "left").groupBy(*group).agg(F.count("*").alias("entries"), F.count_if(F.col("__known").isNull()).alias("added"))


def new_by_count(new: DataFrame, known: DataFrame, book: list[str]) -> DataFrame:
    """Rows of the new list (book, chapter_index) beyond the known number of chapters (book, chapter_count);
    all of a book that isn't known."""
    return new.join(known.select(*book, F.col("chapter_count").alias("__n")), book, "left").filter(F.col("chapter_index") >= F.coalesce("__n", F.lit(0))).drop("__n")


def resolve_progress(progress: DataFrame, chapters: DataFrame, group: list[str]) -> DataFrame:
    """Where reading goes on after the list of chapters changed: at the same chapter id, else at the first
    chapter that either of its locators names (the origin's, then the canonical one), else at the first
    with the same ordinal, else at the chapter whose place in the list is nearest to the ordinal; without
    chapters it is reset.

    progress: group, chapter_id, origin_locator, canonical_locator, ordinal; chapters the same. Locators
    are compared without fragments, their parameters in order. Lists are in order of (ordinal,
    chapter_id); a list is sorted by one task, on disk.
    """
    first = F.min(F.struct("ordinal", "chapter_id"))
    key = lambda c: F.when(F.length(utrim(F.col(c))) > 0, locator_key(utrim(F.col(c))))
    by_id = chapters.groupBy(*group, "chapter_id").agg(first.alias("__id"))
    named = chapters.select(*group, "ordinal", "chapter_id", F.explode(F.array_distinct(F.array(key("canonical_locator"), key("origin_locator")))).alias("__l")).filter("__l is not null")
    by_locator = named.groupBy(*group, "__l").agg(first.alias("x"))
    by_ordinal = chapters.groupBy(*group, "ordinal").agg(first.alias("__ordinal"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("ordinal", "chapter_id")) - 1
    listed = chapters.select(*group, place.alias("__place"), F.struct("ordinal", "chapter_id").alias("__near"))
    size = chapters.groupBy(*group).agg(F.count("*").alias("__n"))
    out = progress.withColumns({"__o": key("origin_locator"), "__c": key("canonical_locator")}).join(by_id, [*group, "chapter_id"], "left")
    for c, name in (("__o", "__origin"), ("__c", "__canonical")):
        out = out.join(by_locator.select(*group, F.col("__l").alias(c), F.col("x").alias(name)), [*group, c], "left")
    out = out.join(by_ordinal, [*group, "ordinal"], "left").join(size, group, "left")
    out = out.withColumn("__place", F.greatest(F.lit(0), F.least("ordinal", F.col("__n") - 1)).cast("int")).join(listed, [*group, "__place"], "left")
    steps = {"__id": "exact", "__origin": "locator", "__canonical": "locator", "__ordinal": "ordinal", "__near": "nearest"}
    how = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(name)) for c, name in steps.items()), F.lit("reset"))
    at = F.coalesce(*steps)
    return out.select(*group, "chapter_id", F.col("ordinal").alias("old_ordinal"), at["ordinal"].alias("new_ordinal"), at["chapter_id"].alias("new_chapter_id"), how.alias("resolved_by"))


def in_order(df: DataFrame, keys: list[str], **equal: object) -> DataFrame:
    """An ordered read: the rows where each column of ``equal`` has its value, in the order of keys; a key
    that begins with - goes down, +: nulls come first, else they come last going down."""
    for c, v in equal.items():
        df = df.filter(F.col(c) == F.lit(v))
    return df.orderBy(*(F.desc_nulls_last(k[1:]) if k.startswith("-") else F.asc_nulls_first(k.lstrip("+")) for k in keys))


#: Ordered reads by the table they list: what they are equal in is the caller's.
LISTINGS = {
    "cached_chapters": ["chapter_index"],
    "progress_of_source": ["-updated_at", "book_id"],
    "progress_history": ["updated_at", "+device_id", "entry_no"],
    "download_tasks": ["chapter_index"],
    "replace_rules": ["-enabled", "serial_number", "id"],
    "bookmarks": ["book_name", "book_author", "created_at"],
    "ordered_rules": ["sort_order", "id"],
    "read_records": ["device_id", "book_name"],
    "named": ["name"],
}


def listing(df: DataFrame, name: str, **equal: object) -> DataFrame:
    return in_order(df, LISTINGS[name], **equal)


def like_fields(df: DataFrame, word: str, fields: list[str]) -> DataFrame:
    """Rows that match the pattern %word% in any of the fields, ASCII letters in either case; % and _ in
    the word stand for any text and any character, as in a SQL store."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = "%" + word.translate(str.maketrans(upper, lower)).replace("\\", "\\\\") + "%"
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.translate(F.coalesce(F.col(f), F.lit("")), upper, lower).like(pattern)
    return df.filter(hit)


def search_fields(df: DataFrame, word: str, fields: list[str]) -> DataFrame:
    """Rows that hold the word in any of the fields, in any letter case; the word is no pattern."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(word.lower()))
    return df.filter(hit)


def snapshot(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """table_name, row_no, row (JSON) of all rows of all tables, each in the order of its keys, then of
    the rows themselves: the same content gives the same snapshot. row_no counts per table, from 1,
    over ranges, so no table has to fit one task."""
    out = None
    for name, (df, keys) in sorted(tables.items()):
        rows = df.select(*(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)), F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"}).alias("row"))
        rows = running(rows, [F.asc_nulls_first(f"__k{i}") for i in range(len(keys))] + [F.asc("row")])
        rows = rows.select(F.lit(name).alias("table_name"), "row_no", "row")
        out = rows if out is None else out.unionByName(rows)
    return out


def checked_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, where its keys are unique; a repeated key fails the job that reads it, naming the key."""
    n = duplicate_keys(df, keys).select(*keys, F.lit(True).alias("__twice"))
    out = df.join(n, keys, "left")
    fail = F.raise_error(F.concat(F.lit("duplicate key "), F.to_json(F.struct(*keys))))
    return out.withColumn("__ok", F.when(F.col("__twice"), fail.cast("boolean")).otherwise(F.lit(True))).filter("__ok").select(*df.columns)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
