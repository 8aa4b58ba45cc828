"""Latest-wins and conflict-aware merging, ordered diffs, retention and duplicate decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import identity, utrim
from quire.operators.ordered import running
from quire.operators.tables import latest
from quire.session import free_name

KEY = ["collection", "record_id"]
VALUES = ["updated_at", "deleted", "revision", "device_id", "payload"]
WINNER = [F.desc, F.desc, F.desc, F.desc, F.desc]


def winner_order() -> list[Column]:
    """Later update, then a tombstone, then revision, device and payload, higher first."""
    return [f(c) for f, c in zip(WINNER, VALUES)]


def winners(records: DataFrame) -> DataFrame:
    """One record per (collection, record_id). Aggregated as the maximum of a struct, so map tasks send
    one row per key and no key needs sorting. Nulls rank lowest."""
    best = records.groupBy(*KEY).agg(F.max(F.struct(*VALUES)).alias("w"))
    return best.select(*KEY, *(F.col(f"w.{c}").alias(c) for c in VALUES))


def live(records: DataFrame) -> DataFrame:
    return winners(records).filter(~F.col("deleted"))


def package_json(records: DataFrame, snapshot_id: str, device: str, created_at: int) -> DataFrame:
    """Lines of a package: a header, then one JSON object for each winner in order of its key; the same
    records give the same package. One column, line, with its number from 0."""
    rows = running(winners(records).select(*KEY, F.to_json(F.struct(*KEY, *VALUES), {"ignoreNullFields": "false"}).alias("line")), [F.asc(k) for k in KEY])
    head = F.to_json(F.struct(F.lit(snapshot_id).alias("snapshot_id"), F.lit(device).alias("device_id"), F.lit(created_at).alias("created_at")))
    first = records.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("line_no"), head.alias("line"))
    return first.unionByName(rows.select(F.col("row_no").alias("line_no"), "line"))


def changed_since(records: DataFrame, since: int) -> DataFrame:
    return records.filter(F.col("updated_at") > since).orderBy("updated_at", *KEY)


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select(*KEY, F.struct(*VALUES).alias(name))


def conflict_kind(a: Column, b: Column) -> Column:
    same = a["deleted"].eqNullSafe(b["deleted"]) & a["updated_at"].eqNullSafe(b["updated_at"]) & a["revision"].eqNullSafe(b["revision"]) & a["payload"].eqNullSafe(b["payload"])
    return (
        F.when(a.isNull() | b.isNull() | same, F.lit("none"))
        .when(~a["deleted"].eqNullSafe(b["deleted"]), "deleteVsUpdate")
        .when(a["updated_at"].eqNullSafe(b["updated_at"]), "tieBreak")
        .when(~a["payload"].eqNullSafe(b["payload"]), "concurrentUpdate")
        .otherwise("none")
    )


def merge(local: DataFrame, remote: DataFrame, policy: str = "latest", devices: list[str] | None = None) -> DataFrame:
    """Both sides' winners merged: key, the surviving values, side (local, remote) and conflict.

    policy: ``latest``; ``device``, where of two listed and different devices the earlier in the list
    wins, else the latest; ``manual``, where conflicts are an error of the caller's to resolve (side is
    null); ``keep_both``, where a live loser of a conflict is kept under another id.
    """
    j = _side(winners(local), "l").join(_side(winners(remote), "r"), KEY, "full_outer")
    a, b = F.col("l"), F.col("r")
    kind = conflict_kind(a, b)
    remote_wins = a.isNull() | (b.isNotNull() & (b > a))
    if policy == "device":
        listed = F.array(*(F.lit(d) for d in devices or [""]))
        pa, pb = F.array_position(listed, a["device_id"]), F.array_position(listed, b["device_id"])
        both = (pa > 0) & (pb > 0) & (pa != pb)
        remote_wins = F.when((kind != "none") & F.coalesce(both, F.lit(False)), pb < pa).otherwise(remote_wins)
    j = j.select(*KEY, "l", "r", kind.alias("conflict"), F.when(remote_wins, "remote").otherwise("local").alias("side"))
    w = F.when(F.col("side") == "remote", F.col("r")).otherwise(F.col("l"))
    out = j.select(*KEY, *(w[c].alias(c) for c in VALUES), F.when((F.lit(policy) == "manual") & (F.col("conflict") != "none"), F.lit(None)).otherwise(F.col("side")).alias("side"), "conflict")
    if policy == "keep_both":
        loser = F.when(F.col("side") == "remote", F.col("l")).otherwise(F.col("r"))
        copy = j.filter("conflict <> 'none'").select("collection", "record_id", loser.alias("x"), F.when(F.col("side") == "remote", "local").otherwise("remote").alias("side"), "conflict")
        copy = copy.filter(~F.col("x.deleted")).select("collection", F.concat("record_id", F.lit("#conflict:"), "x.device_id", F.lit(":"), F.col("x.revision").cast("string")).alias("record_id"), *(F.col(f"x.{c}").alias(c) for c in VALUES), "side", "conflict")
        out = out.unionByName(copy)
    return out


def newest_per_group(df: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    n = free_name(df, "__n")
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(n) <= most).drop(n)


def merge_progress(records: DataFrame, most_per_book: int) -> DataFrame:
    """The latest of each (book, chapter, device): time, version, fraction, title; then the newest per book."""
    one = latest(records, ["book_id", "chapter_index", "device_id"], [F.desc("updated_at"), F.desc("sync_version"), F.desc("progress_fraction"), F.desc("chapter_title")])
    return newest_per_group(one, ["book_id"], [F.desc("updated_at"), F.desc("sync_version"), F.desc("chapter_index"), F.desc("device_id")], most_per_book)


def journal(records: DataFrame, key: list[str], order: list[Column], unique: str) -> DataFrame:
    """Per key the kept row's id and how many others were discarded; their ids aren't gathered, as they
    have no bound. Null keys are keys."""
    kept = latest(records, key, order).select(*(F.col(k).alias(f"__{k}") for k in key), F.col(unique).alias("kept_id"))
    n = records.groupBy(*key).agg((F.count("*") - 1).alias("discarded"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return n.join(kept, same).select(*key, "kept_id", "discarded")


def push_progress(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Both sides' progress as it is pushed: of each (book, chapter, device) the latest time, then the
    least version (not the greatest, as in merge_progress()), then the greatest fraction and title."""
    order = [F.desc("updated_at"), F.asc("sync_version"), F.desc("progress_fraction"), F.desc("chapter_title")]
    return latest(local.unionByName(remote), ["book_id", "chapter_index", "device_id"], order)


def discarded(records: DataFrame, key: list[str], order: list[Column], unique: str) -> DataFrame:
    """The rows that journal() counts: all but the kept one of each key. Null keys are keys."""
    return records.join(latest(records, key, order).select(unique), unique, "left_anti")


# ---- a journal of changes -----------------------------------------------------------------------


def record_changes(log: DataFrame, device: str, arrival: str) -> DataFrame:
    """The journal of one device: the last change of each (collection, record_id), pending, with its
    sequence, which counts all changes in order of arrival from 1. A change of another device is an
    error of the job that reads it. log: KEY, VALUES and a unique arrival."""
    fail = F.raise_error(F.concat(F.lit("a change of another device: "), F.coalesce("device_id", F.lit("none")))).cast("boolean")
    own = log.withColumn("__ok", F.when(F.col("device_id").eqNullSafe(F.lit(device)), F.lit(True)).otherwise(fail)).filter("__ok").drop("__ok")
    numbered = running(own, [F.asc(arrival)]).withColumnRenamed("row_no", "sequence").drop("total")
    return latest(numbered, KEY, [F.desc("sequence")]).select(*KEY, *VALUES, "sequence", F.lit("pending").alias("status"))


def acknowledge(journal: DataFrame, package: DataFrame) -> DataFrame:
    """The journal with the pending entries acknowledged whose record is exactly that of the package; an
    entry that has changed since, or isn't in the package, stays as it is."""
    sent = winners(package).select(*KEY, F.struct(*VALUES).alias("__sent"))
    same = F.struct(*VALUES).eqNullSafe(F.col("__sent")) & (F.col("status") == "pending")
    status = F.when(F.coalesce(same, F.lit(False)), F.lit("acknowledged")).otherwise(F.col("status"))
    return journal.join(sent, KEY, "left").withColumn("status", status).drop("__sent")


def retention(items: DataFrame, group: list[str], order: list[Column], most: int, time: str, cutoff: int, unique: str, preserved: DataFrame | None = None) -> DataFrame:
    """What retention removes: beyond the newest ``most`` of a group, or older than the cutoff, never
    the preserved ids. The newest are found with a limit per map task; the rest is an anti-join, so a
    group of any size stays spread."""
    kept = newest_per_group(items, group, order, most).filter(F.col(time) >= cutoff).select(unique)
    gone = items.join(kept, unique, "left_anti")
    return gone if preserved is None else gone.join(preserved.select(unique), unique, "left_anti")


# ---- lists of chapters --------------------------------------------------------------------------


def _occurrences(toc: DataFrame, group: list[str], index: str) -> DataFrame:
    url, title = identity(F.col("url")), utrim(F.coalesce(F.col("title"), F.lit("")))
    key = F.coalesce(F.concat(F.lit("u:"), url), F.concat(F.lit("t:"), title))
    out = toc.select(*group, F.col(index).alias("at"), key.alias("key"), title.alias("name"))
    out = out.withColumn("nth", F.row_number().over(Window.partitionBy(*group, "key").orderBy("at")))
    # blank titles have no number: each is a partition of its own, however many there are
    alone = F.when(F.col("name") == "", F.col("at"))
    return out.withColumn("nth_name", F.row_number().over(Window.partitionBy(*group, "name", alone).orderBy("at")))


def remap_toc(old: DataFrame, new: DataFrame, group: list[str], index: str) -> DataFrame:
    """old_index, new_index, change (mapped, removed, inserted) between two lists (group, index, title,
    url). Entries are the same when their url is, with its number of occurrence; a title's occurrence
    stands in where the url has none. Two old entries may go to one new entry."""
    a, b = _occurrences(old, group, index), _occurrences(new, group, index)
    by_key = b.select(*group, "key", "nth", F.col("at").alias("__by_key"))
    by_name = b.filter("name <> ''").select(*group, "name", "nth_name", F.col("at").alias("__by_name"))
    m = a.join(by_key, [*group, "key", "nth"], "left").join(by_name, [*group, "name", "nth_name"], "left")
    m = m.select(*group, F.col("at").alias("old_index"), F.coalesce("__by_key", "__by_name").alias("new_index"))
    mapped = m.withColumn("change", F.when(F.col("new_index").isNull(), "removed").otherwise("mapped"))
    inserted = b.select(*group, F.col("at").alias("new_index")).join(m.select(*group, "new_index"), [*group, "new_index"], "left_anti")
    return mapped.unionByName(inserted.select(*group, F.lit(None).cast("int").alias("old_index"), "new_index", F.lit("inserted").alias("change")))


def clamp_to_survivor(mapping: DataFrame, group: list[str]) -> DataFrame:
    """For every old entry of remap_toc() the new one where reading goes on: its own, else that of the
    next surviving entry, else of the one before, else none."""
    old = mapping.filter("old_index is not null")
    w = Window.partitionBy(*group).orderBy("old_index")
    after = F.first("new_index", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    before = F.last("new_index", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    how = F.when(F.col("change") == "mapped", "same").when(F.col("__after").isNotNull(), "next").when(F.col("__before").isNotNull(), "previous").otherwise("empty")
    return old.withColumns({"__after": after, "__before": before}).select(*group, "old_index", F.coalesce("new_index", "__after", "__before").alias("target_index"), how.alias("clamped_to"))


def diff_index(old: DataFrame, new: DataFrame, group: list[str], locator: str, compare: dict[str, str]) -> DataFrame:
    """Typed differences between two indexes joined by locator: added, removed, and for each column of
    compare its kind where it differs; unchanged only where nothing else is said. One locator counts
    once a side: its least ordinal, then id."""
    pick = lambda df: latest(df, [*group, locator], [F.asc("ordinal"), F.asc("chapter_id")])
    a = pick(old).select(*group, locator, F.struct("chapter_id", *compare).alias("a"))
    b = pick(new).select(*group, locator, F.struct("chapter_id", *compare).alias("b"))
    j = a.join(b, [*group, locator], "full_outer")
    there = F.col("a").isNotNull() & F.col("b").isNotNull()
    kinds = [F.when(F.col("a").isNull(), "added"), F.when(F.col("b").isNull(), "removed")]
    kinds += [F.when(there & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), k) for c, k in compare.items()]
    found = F.filter(F.array(*kinds), lambda x: x.isNotNull())
    change = F.explode(F.when(F.size(found) == 0, F.array(F.lit("unchanged"))).otherwise(found))
    return j.select(*group, locator, F.col("a.chapter_id").alias("old_id"), F.col("b.chapter_id").alias("new_id"), change.alias("change"))


# ---- books --------------------------------------------------------------------------------------


def catalog_matches(books: DataFrame, key: str) -> DataFrame:
    """Per book how many share its checksum, or its title and author (null equals null), itself counted,
    and the least key of each class: representatives and membership instead of all pairs. A book
    without a checksum shares it with none: 0 and null."""
    by_sum = books.filter("checksum is not null").groupBy("checksum").agg(F.count("*").alias("same_checksum"), F.min(key).alias("first_by_checksum"))
    by_title = books.groupBy(F.col("title").alias("__t"), F.col("author").alias("__a")).agg(F.count("*").alias("same_title"), F.min(key).alias("first_by_title"))
    out = books.join(by_sum, "checksum", "left").join(by_title, F.col("title").eqNullSafe(F.col("__t")) & F.col("author").eqNullSafe(F.col("__a")))
    return out.select(key, F.coalesce("same_checksum", F.lit(0)).alias("same_checksum"), "first_by_checksum", "same_title", "first_by_title")


def duplicate_decision(books: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """What each new book (key, checksum, filename, title, author, chapters) is to the catalog (book_id and
    the same columns), by its first match in order of book_id: exact or sameBytes by checksum; by title
    and the rest sameBook, unrelated (another author) or edition (another number of chapters); likely
    if it matched otherwise; insufficient without a match. A match is an equal checksum, or equal title
    and author (null equals null)."""
    columns = ["checksum", "filename", "title", "author", "chapters"]
    entry = catalog.select("book_id", F.struct("book_id", *columns).alias("c"), *(F.col(c).alias(f"__{c}") for c in ("checksum", "title", "author")))
    by_sum = entry.filter("__checksum is not null").groupBy("__checksum").agg(F.min("c").alias("a"))
    by_title = entry.groupBy("__title", "__author").agg(F.min("c").alias("b"))
    out = books.join(by_sum, F.col("checksum") == F.col("__checksum"), "left").join(by_title, F.col("title").eqNullSafe(F.col("__title")) & F.col("author").eqNullSafe(F.col("__author")), "left")
    m = F.when(F.col("a").isNull() | (F.col("b")["book_id"] < F.col("a")["book_id"]), F.col("b")).otherwise(F.col("a"))
    out = out.withColumn("m", m)
    same = lambda c: F.col(c).eqNullSafe(F.col(f"m.{c}"))
    decision = (
        F.when(F.col("m").isNull(), "insufficient")
        .when(same("checksum") & F.col("checksum").isNotNull(), F.when(same("filename"), "exact").otherwise("sameBytes"))
        .when(same("title") & same("author") & same("chapters"), "sameBook")
        .when(same("title") & ~same("author"), "unrelated")
        .when(same("title") & ~same("chapters"), "edition")
        .otherwise("likely")
    )
    return out.select(key, decision.alias("decision"), F.col("m.book_id").alias("matched_id"))


#: What each policy compares; equal and unequal decisions.
VALIDATION = {
    "metadata": (["byte_count"], "metadataOnly", "contentChanged"),
    "fast": (["prefix_checksum", "suffix_checksum"], "unchanged", "uncertain"),
    "full": (["checksum"], "unchanged", "contentChanged"),
    "semantic": (["title", "author", "chapters"], "metadataOnly", "contentChanged"),
}


def change_decision(catalog: DataFrame, found: DataFrame, key: str, policy: str = "full") -> DataFrame:
    """What became of each book found again (key, format, parser and what the policy compares) against its
    catalog entry: removed if it has none, then formatChanged, parserChanged, then by the policy (see
    VALIDATION)."""
    columns, equal, unequal = VALIDATION[policy]
    old = catalog.select(key, F.struct("format", "parser", *columns).alias("__old"))
    same = lambda *names: reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__old.{c}")) for c in names))
    decision = F.when(F.col("__old").isNull(), "removed").when(~same("format"), "formatChanged").when(~same("parser"), "parserChanged").when(same(*columns), equal).otherwise(unequal)
    return found.join(old, key, "left").select(key, decision.alias("decision"))


def first_per_id(entries: DataFrame, feed: list[str], entry: str, order: list[str]) -> DataFrame:
    return latest(entries, [*feed, entry], [F.asc(c) for c in order])


def before_last_seen(entries: DataFrame, feed: list[str], position: str, seen: DataFrame) -> DataFrame:
    """Entries of a feed that come before the first one already seen (feed, id); all if none was."""
    known = entries.join(seen.select(*feed, "id").distinct(), [*feed, "id"], "left_semi")
    stop = known.groupBy(*feed).agg(F.min(position).alias("__stop"))
    return entries.join(stop, feed, "left").filter(F.col("__stop").isNull() | (F.col(position) < F.col("__stop"))).drop("__stop")
