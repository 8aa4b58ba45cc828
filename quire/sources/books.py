"""Sources: books, text chapters, feeds and request rules as tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.books import merge_short, number_chapter, parse_feed, parse_url_rule, read_book, read_text, split_by_marker, split_chapters
from quire.functions.text import ReplaceRule, replace_rules, utrim

BOOK = "path string, format string, title string, author string, chapter_index int, chapter_title string, content string, start_char bigint, end_char bigint, diagnostics array<string>"
ENTRY = "feed_title string, pos int, id string, title string, link string, summary string, author string, published_at string, error string"
CHAPTER = "chapter_index int, chapter_title string, content string"
REQUEST = "url string, method string, body string, headers string, charset string, script string"


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """One row per chapter of every file under path (text, EPUB, MOBI, PDF). A file without a chapter, or
    one that can't be read, has one row with null chapter columns and its diagnostics. A file is one
    task's work; files are spread by the engine."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                book = read_book(data, name)
                # of plain texts the characters a chapter comes from; packages have no one text to count in
                rows = [(k, *c, *((None, None) if len(c) == 2 else ())) for k, c in enumerate(book["chapters"])] or [(None,) * 5]
                n = len(rows)
                columns = [[name] * n, [book["format"]] * n, [book["title"]] * n, [book["author"]] * n, *map(list, zip(*rows)), [book["diagnostics"]] * n]
                types = [pa.string()] * 4 + [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names_of(BOOK))

    return files.mapInArrow(run, BOOK)


def chapters(df: DataFrame, key: str, text: str, pattern: str | None = None, marker: str | None = None, merge_under: int = 0, renumber: bool = False) -> DataFrame:
    """key, chapter_index, chapter_title, content: by a pattern for heading lines, by a literal marker,
    or by the usual headings. Null and empty texts give no row."""
    own = re.compile(pattern) if pattern else None
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, {CHAPTER}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, index, title, content = [], [], [], []
            for i, s in enumerate(b.column(1).to_pylist()):
                if not s:
                    continue
                found = split_by_marker(s, marker) if marker else split_chapters(s, own)
                for k, (t, c) in enumerate(merge_short(found, merge_under) if merge_under else found):
                    at.append(i)
                    index.append(k)
                    title.append(number_chapter(t) if renumber else t)
                    content.append(c)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(index, pa.int32()), pa.array(title, pa.string()), pa.array(content, pa.string())], [key, *names_of(CHAPTER)])

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def feed_entries(df: DataFrame, key: str, text: str, all_items: bool = False) -> DataFrame:
    """key, pos and the entries of feeds held in a column, RSS, Atom or JSON; the first of each id, or
    with all_items all of them. A text that is no feed, or has an entry that nothing identifies, gives
    one row with an error; null and blank texts give none."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, {ENTRY}"
    fields = names_of(ENTRY)[2:-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            out: dict[str, list] = {c: [] for c in names_of(ENTRY)}
            for i, s in enumerate(b.column(1).to_pylist()):
                if not s or not s.strip():
                    continue
                try:
                    feed = parse_feed(s)
                except ValueError as e:
                    at.append(i)
                    for c in out:
                        out[c].append(str(e)[:200] if c == "error" else None)
                    continue
                for k, e in enumerate(feed["items" if all_items else "entries"]):
                    at.append(i)
                    out["feed_title"].append(feed["title"])
                    out["pos"].append(k)
                    out["error"].append(None)
                    for c in fields:
                        out[c].append(None if e[c] is None else str(e[c]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *(pa.array(v, pa.int32() if c == "pos" else pa.string()) for c, v in out.items())], [key, *out])

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def feed_pages(df: DataFrame, key: str, text: str, url: str | None = None) -> DataFrame:
    """key, feed_title, entries (how many), next_url of feeds held in a column; a feed that goes on with
    itself (column url) has no next page. Texts that are no feed, null and blank ones give no row."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, feed_title string, entries int, next_url string, own string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, s in enumerate(b.column(1).to_pylist()):
                try:
                    feed = parse_feed(s) if s and s.strip() else None
                except ValueError:
                    feed = None
                if feed:
                    at.append(i)
                    out.append((feed["title"], len(feed["entries"]), feed["next"]))
            rows = pa.array(at, pa.int32())
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string()))), b.column(2).take(rows)], [key, "feed_title", "entries", "next_url", "own"])

    own = F.trim(F.col(f"`{url}`")) if url else F.lit(None).cast("string")
    pages = df.select(F.col(f"`{key}`"), F.col(f"`{text}`"), own.alias("own")).mapInArrow(run, schema)
    return pages.withColumn("next_url", F.when(~F.col("next_url").eqNullSafe(F.col("own")), F.col("next_url"))).drop("own")


def feed_items(df: DataFrame, key: str, text: str, rules: list[ReplaceRule] = (), most: int | None = None) -> DataFrame:
    """Items of feeds as feed_entries() gives them, with replace rules over title and summary, trimmed,
    blank fields null, and the first ``most`` of each feed (all if None)."""
    out = feed_entries(df, key, text).filter("error is null")
    put = lambda c: F.nullif(utrim(replace_rules(F.col(c), list(rules))), F.lit("")).alias(c)
    out = out.select(F.col(f"`{key}`"), "feed_title", "pos", "id", put("title"), put("summary"), *(F.nullif(utrim(F.col(c)), F.lit("")).alias(c) for c in ("link", "author", "published_at")))
    return out if most is None else out.filter(F.col("pos") < most)


def book_texts(df: DataFrame, key: str, text: str, with_title: bool = True, least: int = 0) -> DataFrame:
    """key, book_title, chapter_index, chapter_title, content of plain texts, with the wider sense of a
    heading; a text with a title alone has one row without a chapter. Null texts give no row."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, book_title string, {CHAPTER}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, s in enumerate(b.column(1).to_pylist()):
                if s is None:
                    continue
                title, found = read_text(s, with_title, least)
                for row in [(title, k, t, c) for k, (t, c) in enumerate(found)] or ([(title, None, None, None)] if title else []):
                    at.append(i)
                    rows.append(row)
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string())))], [key, "book_title", *names_of(CHAPTER)])

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def requests(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and the parts of request rules ``url,{options}``; null and blank rules give no row."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, {REQUEST}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [i for i, s in enumerate(b.column(1).to_pylist()) if s and s.strip()]
            found = [parse_url_rule(b.column(1)[i].as_py()) for i in keep]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int32())), *(pa.array([None if f[c] is None else str(f[c]) for f in found], pa.string()) for c in names_of(REQUEST))], [key, *names_of(REQUEST)])

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def expand_url(c: Column, variables: dict[str, str], page: int = 1) -> Column:
    """Static templates of a URL rule: {{key}} percent-encoded, {{keyword}} and other names as they are,
    {{page}} and its neighbours, and the first of the first list of pages, <1,2,3> or <1-3>."""
    from urllib.parse import quote

    word = variables.get("key", "")
    near = {"page": page, "page-1": page - 1, "page+1": page + 1, "pageMinus": page - 1, "pagePlus": page + 1}
    values = {"key": quote(word, safe="-_.!~*'()"), "keyword": word, **{k: str(v) for k, v in near.items()}, **{k: v for k, v in variables.items() if k != "key"}}
    c = F.regexp_replace(c, r"^((?:(?!<\s*[0-9]+\s*(?:-[^<>]*|,[^<>]*)?>)[\s\S])*)<\s*([0-9]+)\s*(?:-[^<>]*|,[^<>]*)?>", "$1$2")
    for k, v in values.items():
        c = F.replace(c, F.lit("{{" + k + "}}"), F.lit(v))
    return c
