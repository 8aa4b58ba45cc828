"""More queries over the general operators: listings, decisions, journals, paging, feeds, scripts, streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import extract as X
from quire.operators import merge as M
from quire.operators import rollup as R
from quire.operators import tables as E
from quire.reference_queries import _FNV, _SWITCH, _VERSION, RECORDS, SIDES, TRIM, _xml, deliveries, progress_records, renumbered, sides, versions
from quire.session import shared_dir, table
from quire.sources import books as B
from quire.streaming.records import latest_updates, mark_entries, refresh_store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- ordered reads: a page of each listing, which is their use ---------------------------------------

PAGE = 25


def _listing(name: str, columns: dict[str, str], source: str, kind: str, equal: dict[str, object], order: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, source).select(*(F.expr(sql).alias(c) for c, sql in columns.items()))
        return E.listing(rows, kind, **equal).limit(PAGE)

    run.__name__ = name
    run.__doc__ = f"The first {PAGE} rows of the listing {kind}."
    QUERIES[name] = run
    where = " AND ".join(f"{c} = {v!r}" if isinstance(v, str) else f"{c} = {v}" for c, v in equal.items()) or "TRUE"
    inner = ", ".join(f"{sql.replace('cast(', 'CAST(')} AS {c}" for c, sql in columns.items())
    SQL[name] = f"SELECT * FROM (SELECT {inner} FROM {source}) WHERE {where} ORDER BY {order} LIMIT {PAGE}"


_listing("list_cached_chapters", {"book_id": "l_suppkey", "chapter_index": "l_orderkey * 10 + l_linenumber", "title": "l_returnflag"}, "lineitem", "cached_chapters", {"book_id": 7}, "chapter_index")
_listing("list_progress", {"source_id": "o_orderstatus", "book_id": "o_orderkey", "updated_at": "o_custkey"}, "orders", "progress_of_source", {"source_id": "F"}, "updated_at DESC NULLS LAST, book_id")
_listing("list_progress_history", {"book_id": "user_id", "updated_at": "event_id % 50", "device_id": "CASE WHEN event_id % 3 <> 0 THEN event_type END", "entry_no": "event_id"}, "events", "progress_history", {"book_id": 3}, "updated_at, device_id NULLS FIRST, entry_no")
_listing("list_download_tasks", {"book_id": "l_partkey", "chapter_index": "l_orderkey * 10 + l_linenumber", "status": "l_linestatus"}, "lineitem", "download_tasks", {"book_id": 11}, "chapter_index")
_listing("list_replace_rules", {"id": "rec_id", "enabled": "enabled", "serial_number": "weight"}, "corpus_source", "replace_rules", {}, "enabled DESC, serial_number, id")
_listing("list_bookmarks", {"book_name": "title", "book_author": "author", "created_at": "delivery_id"}, "rss_subscription_item", "bookmarks", {}, "book_name NULLS FIRST, book_author NULLS FIRST, created_at")
_listing("list_ordered_rules", {"id": "rec_id", "sort_order": "customOrder"}, "corpus_source", "ordered_rules", {}, "sort_order, id")
_listing("list_read_records", {"device_id": "batch_id", "book_name": "concat(title, ' ', delivery_id)"}, "rss_entry", "read_records", {}, "device_id, book_name")
_listing("list_by_name", {"name": "c_name", "key": "c_custkey"}, "customer", "named", {}, "name")


# ---- tables -------------------------------------------------------------------------------------------


@query(r"""SELECT rec_id FROM corpus_source WHERE translate(bookSourceName, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%a_b%' OR translate(coalesce(bookSourceUrl, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%a_b%'""")
def bookmark_like(spark: SparkSession, d: str) -> DataFrame:
    """The search of a SQL store, whose _ and % are wild."""
    return E.like_fields(table(spark, d, "corpus_source"), "A_b", ["bookSourceName", "bookSourceUrl"]).select("rec_id")


@query("""SELECT 'nation' AS table_name, row_number() OVER (ORDER BY n_nationkey) AS row_no, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS row FROM nation
    UNION ALL SELECT 'region', row_number() OVER (ORDER BY r_name), '{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}' FROM region
    UNION ALL SELECT 'source', row_number() OVER (ORDER BY rec_id), '{"enabled":' || enabled || ',"rec_id":' || rec_id || '}' FROM corpus_source""")
def table_snapshot(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return E.snapshot({"region": (t("region"), ["r_name"]), "nation": (t("nation"), ["n_nationkey"]), "source": (t("corpus_source").select("rec_id", "enabled"), ["rec_id"])})


@query("SELECT rec_id, sourceId FROM corpus_source")
def table_unique(spark: SparkSession, d: str) -> DataFrame:
    """An import that would fail on a repeated key; these have none."""
    return E.checked_unique(table(spark, d, "corpus_source").select("rec_id", "sourceId"), ["sourceId"])


@query(r"""SELECT rec_id, sha256('{' || array_to_string(list_sort(list_transform(json_keys(ruleSearch), lambda k: '"' || k || '":' || json_extract(ruleSearch, '$."' || k || '"')::VARCHAR)), ',') || '}') AS digest FROM corpus_source""")
def table_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digests of JSON texts in their canonical form."""
    return R.json_digest(table(spark, d, "corpus_source"), "rec_id", "ruleSearch")


_RENUMBERED = """a AS (SELECT file_no, line_no, CASE WHEN line_no % 3 = 0 THEN '第' || line_no || '章 ' || title ELSE title END AS title FROM old),
  b AS (SELECT file_no, line_no, CASE WHEN line_no % 3 = 0 THEN '第' || (line_no + 1) || '章 ' || title ELSE title END AS title FROM neu WHERE line_no % 4 <> 1)"""


@query(f"""WITH {_VERSION}, {_RENUMBERED}, x AS (SELECT a.file_no, a.line_no, coalesce((SELECT min(line_no) FROM b WHERE b.file_no = a.file_no AND b.title = a.title), (SELECT min(line_no) FROM b WHERE b.file_no = a.file_no AND b.line_no = a.line_no),
    (SELECT min(line_no) FROM b WHERE b.file_no = a.file_no AND {_SWITCH('b.title')} = {_SWITCH('a.title')}), (SELECT min(line_no) FROM b WHERE b.file_no = a.file_no)) AS n FROM a)
  SELECT file_no, 'new' AS source_id, file_no || '/' || line_no AS book_id, n AS chapter_index, 0::BIGINT AS chapter_offset, 0.0::DOUBLE AS chapter_progress, 1700000000::BIGINT AS updated_at, 'd' || line_no % 2 AS device_id FROM x WHERE n IS NOT NULL""")
def progress_migrated(spark: SparkSession, d: str) -> DataFrame:
    """Progress in every chapter of a file's predecessor, moved to the matched chapter at its beginning."""
    old, new = renumbered(spark, d)
    n = F.col("chapter_index")
    progress = old.select("file_no", "chapter_index", F.concat_ws("/", F.col("file_no").cast("string"), n.cast("string")).alias("book_id"), F.concat(F.lit("d"), (n % 2).cast("string")).alias("device_id"))
    return E.migrate_progress(progress, E.match_source(old, new, ["file_no"]), ["file_no"], "new", 1_700_000_000)


@query(f"""WITH {_VERSION}, n AS (SELECT file_no, count(*) AS n FROM old GROUP BY 1) SELECT b.file_no, b.line_no AS chapter_index, b.export_id FROM neu b LEFT JOIN n USING (file_no) WHERE b.line_no >= coalesce(n.n, 0)""")
def toc_new_by_count(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a list beyond the number that was known."""
    old, new = versions(spark, d)
    known = old.groupBy("file_no").agg(F.count("*").alias("chapter_count"))
    return E.new_by_count(new.select("file_no", F.col("line_no").alias("chapter_index"), "export_id"), known, ["file_no"])


@query("""SELECT o_orderkey, unnest(range(o_custkey % 7 + 1, least(o_custkey % 7 + 3, o_orderkey % 9) + 1)) AS chapter_no FROM orders""")
def cache_next(spark: SparkSession, d: str) -> DataFrame:
    """The chapters to fetch after those that are cached."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.explode(E.next_uncached(F.col("o_custkey") % 7, F.col("o_orderkey") % 9, 3)).alias("chapter_no"))


@query("""SELECT o_orderpriority AS source_id, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS other, count(*) AS total FROM orders GROUP BY 1""")
def cache_status(spark: SparkSession, d: str) -> DataFrame:
    return E.status_counts(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "source_id"), ["source_id"], "o_orderstatus", ["F", "O"])


@query("""SELECT subscription_id, delivery_id, CASE WHEN batch_id = (SELECT max(batch_id) FROM rss_entry) THEN TRUE ELSE summary IS NOT NULL END AS read FROM rss_entry""")
def feed_marked(spark: SparkSession, d: str) -> DataFrame:
    """All entries of the last batch marked as read at once."""
    e = table(spark, d, "rss_entry").select("subscription_id", "delivery_id", "batch_id", F.col("summary").isNotNull().alias("read"))
    last = e.agg(F.max("batch_id")).first()[0]
    return mark_entries(e.drop("batch_id"), e.filter(F.col("batch_id") == last).select("delivery_id", F.lit(True).alias("read")), ["delivery_id"], "read")


@query(f"""WITH c AS (SELECT rec_id, unnest(['n', 'u']) AS p, unnest([bookSourceName, coalesce(bookSourceUrl, '')]) AS v FROM corpus_source), x AS (SELECT 'lower' AS candidate, rec_id, p, lower(v) AS v FROM c WHERE rec_id % 10 <> 0 UNION ALL SELECT 'same', rec_id, p, v FROM c),
    j AS (SELECT x.candidate, x.rec_id, count(*) FILTER (regexp_replace(trim(regexp_replace(x.v, '[ \\t]+', ' ', 'g')), '^(https?://.*?)/+$', '\\1') <> regexp_replace(trim(regexp_replace(c.v, '[ \\t]+', ' ', 'g')), '^(https?://.*?)/+$', '\\1')) AS n FROM x JOIN c ON c.rec_id = x.rec_id AND c.p = x.p GROUP BY 1, 2)
    SELECT candidate, (SELECT count(*) FROM corpus_source) AS documents, count(*) FILTER (n = 0) AS matching, count(*) FILTER (n > 0) AS mismatching, (SELECT count(*) FROM corpus_source) - count(*) AS absent, CAST(sum(n) AS BIGINT) AS differences FROM j GROUP BY 1""")
def run_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Two candidates' documents against the canonical ones: one in lower case with some missing, one equal."""
    s = table(spark, d, "corpus_source")
    doc = lambda f: R.flatten_json(s.select("rec_id", F.to_json(F.struct(f(F.col("bookSourceName")).alias("n"), f(F.coalesce("bookSourceUrl", F.lit(""))).alias("u"))).alias("j")), "rec_id", "j")
    candidates = doc(F.lower).filter("rec_id % 10 <> 0").withColumn("candidate", F.lit("lower")).unionByName(doc(lambda c: c).withColumn("candidate", F.lit("same")))
    return R.candidate_totals(doc(lambda c: c), candidates, "rec_id")


@query(f"""WITH w AS (SELECT *, row_number() OVER (PARTITION BY collection, record_id ORDER BY updated_at DESC, deleted DESC, revision DESC, device_id DESC, payload DESC) AS n FROM {RECORDS})
    SELECT 0::BIGINT AS line_no, '{{"snapshot_id":"s1","device_id":"d1","created_at":5}}' AS line UNION ALL
    SELECT row_number() OVER (ORDER BY collection, record_id), '{{"collection":' || to_json(collection) || ',"record_id":' || to_json(record_id) || ',"updated_at":' || updated_at || ',"deleted":' || deleted || ',"revision":' || revision || ',"device_id":' || to_json(device_id) || ',"payload":' || to_json(payload) || '}}' FROM w WHERE n = 1""")
def sync_package(spark: SparkSession, d: str) -> DataFrame:
    """A package of the winners as lines of JSON."""
    return M.package_json(deliveries(spark, d), "s1", "d1", 5)


# ---- decisions and journals -----------------------------------------------------------------------------

_CAT = """cat AS (SELECT 'b' || rec_id AS book_id, md5(ruleSearch) AS checksum, sourceId AS filename, bookSourceName AS title, bookSourceGroup AS author, weight AS chapters, 'f' || bookSourceType AS format, customOrder % 4 AS parser FROM corpus_source WHERE rec_id % 2 = 0),
  neu AS (SELECT rec_id, CASE WHEN rec_id % 5 <> 0 THEN md5(ruleSearch) END AS checksum, sourceId AS filename, bookSourceName AS title, bookSourceGroup AS author, weight AS chapters FROM corpus_source)"""


def _books(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "corpus_source")
    one = [F.col("sourceId").alias("filename"), F.col("bookSourceName").alias("title"), F.col("bookSourceGroup").alias("author"), F.col("weight").alias("chapters")]
    total = F.md5(F.encode("ruleSearch", "UTF-8"))
    catalog = s.filter("rec_id % 2 = 0").select(F.concat(F.lit("b"), F.col("rec_id").cast("string")).alias("book_id"), total.alias("checksum"), *one)
    return s.select("rec_id", F.when(F.col("rec_id") % 5 != 0, total).alias("checksum"), *one), catalog


@query(f"""WITH {_CAT}, m AS (SELECT n.*, (SELECT min(book_id) FROM cat c WHERE c.checksum = n.checksum OR (c.title IS NOT DISTINCT FROM n.title AND c.author IS NOT DISTINCT FROM n.author)) AS book_id FROM neu n)
  SELECT m.rec_id, CASE WHEN c.book_id IS NULL THEN 'insufficient' WHEN c.checksum = m.checksum THEN CASE WHEN c.filename IS NOT DISTINCT FROM m.filename THEN 'exact' ELSE 'sameBytes' END
    WHEN c.title IS DISTINCT FROM m.title THEN 'likely' WHEN c.author IS DISTINCT FROM m.author THEN 'unrelated' WHEN c.chapters IS DISTINCT FROM m.chapters THEN 'edition' ELSE 'sameBook' END AS decision, c.book_id AS matched_id FROM m LEFT JOIN cat c USING (book_id)""")
def catalog_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What every source is to a catalog of half of them."""
    return M.duplicate_decision(*_books(spark, d), "rec_id")


@query("""SELECT rec_id, CASE WHEN rec_id % 7 = 0 THEN 'removed' WHEN rec_id % 5 = 0 AND bookSourceType IS NOT NULL THEN 'formatChanged' WHEN rec_id % 3 = 0 THEN 'parserChanged' WHEN rec_id % 2 = 0 THEN 'contentChanged' ELSE 'unchanged' END AS decision FROM corpus_source""")
def catalog_changes(spark: SparkSession, d: str) -> DataFrame:
    """What became of every source against a catalog that lacks some and has others in another form."""
    s, n = table(spark, d, "corpus_source"), F.col("rec_id")
    found = s.select("rec_id", F.col("bookSourceType").alias("format"), F.lit(1).alias("parser"), F.concat("ruleSearch", F.when(n % 2 == 0, "x").otherwise("")).alias("checksum"))
    catalog = s.filter(n % 7 != 0).select("rec_id", (F.col("bookSourceType") + F.when(n % 5 == 0, 1).otherwise(0)).alias("format"), F.when(n % 3 == 0, 2).otherwise(1).alias("parser"), F.col("ruleSearch").alias("checksum"))
    return M.change_decision(catalog, found, "rec_id")


_PUSHED = "(SELECT CAST(user_id AS VARCHAR) AS book_id, CAST(round(value) AS INTEGER) % 5 AS chapter_index, event_type AS device_id, CAST(floor(CAST(epoch(ts) AS BIGINT) / 86400) AS BIGINT) AS updated_at, event_id % 3 AS sync_version, value AS progress_fraction, CAST(event_id AS VARCHAR) AS chapter_title FROM events)"


@query(f"""SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_index, device_id ORDER BY updated_at DESC, sync_version, progress_fraction DESC, chapter_title DESC) AS n FROM {_PUSHED}) WHERE n = 1""")
def progress_push(spark: SparkSession, d: str) -> DataFrame:
    """Both sides' progress as it is pushed, where the lower version wins a tie."""
    p = progress_records(spark, d)
    here = F.col("chapter_title").cast("bigint") % 2 == 0
    return M.push_progress(p.filter(here), p.filter(~here))


@query(f"""SELECT revision FROM (SELECT *, row_number() OVER (PARTITION BY collection, record_id ORDER BY updated_at DESC, revision) AS n FROM {RECORDS}) WHERE n > 1""")
def sync_discarded(spark: SparkSession, d: str) -> DataFrame:
    """The records that the journal discards, one row each."""
    return M.discarded(deliveries(spark, d), M.KEY, [F.desc("updated_at"), F.asc("revision")], "revision").select("revision")


_LOGGED = f"""{SIDES}, g AS (SELECT *, row_number() OVER (ORDER BY revision) AS sequence FROM e WHERE device_id = 'device-0'), q AS (SELECT *, row_number() OVER (PARTITION BY collection, record_id ORDER BY revision DESC) AS last FROM g)"""


@query(f"WITH {_LOGGED} SELECT collection, record_id, updated_at, deleted, revision, device_id, payload, sequence, 'pending' AS status FROM q WHERE last = 1")
def journal_pending(spark: SparkSession, d: str) -> DataFrame:
    """The journal of one device's changes, in order of arrival."""
    return M.record_changes(sides(spark, d)[0], "device-0", "revision")


@query(f"""WITH {_LOGGED}, s AS (SELECT *, row_number() OVER (PARTITION BY collection, record_id ORDER BY updated_at DESC, deleted DESC, revision DESC, payload DESC) AS best FROM g WHERE revision % 3 <> 0)
    SELECT q.collection, q.record_id, q.revision, q.sequence, CASE WHEN s.revision = q.revision THEN 'acknowledged' ELSE 'pending' END AS status FROM q LEFT JOIN s ON s.best = 1 AND s.collection = q.collection AND s.record_id = q.record_id WHERE q.last = 1""")
def journal_acknowledged(spark: SparkSession, d: str) -> DataFrame:
    """The journal after a package of some of the changes came back: only exact records count."""
    log = sides(spark, d)[0]
    done = M.acknowledge(M.record_changes(log, "device-0", "revision"), log.filter("revision % 3 <> 0"))
    return done.select("collection", "record_id", "revision", "sequence", "status")


# ---- paging -----------------------------------------------------------------------------------------------


def _walks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each series as a walk from its first file to the last, and what lies on each page."""
    export = table(spark, d, "source_export")
    f = export.groupBy("series_id", "file_no").agg(F.min("exported_at").alias("at"), F.min("file_name").alias("content"))
    w = Window.partitionBy("series_id").orderBy("at", "file_no")
    f = f.select(F.col("series_id").alias("key"), F.col("file_no").cast("string").alias("url"), F.lead("file_no").over(w).cast("string").alias("next_url"), "content", F.row_number().over(w).alias("n"))
    return f.filter("n = 1").select("key", "url"), f.select("url", "next_url", "content")


@query("""SELECT series_id AS key, count(*) AS pages, string_agg(file_name, '' ORDER BY first_at, file_no) AS content FROM (SELECT series_id, file_no, min(exported_at) AS first_at, min(file_name) AS file_name FROM source_export GROUP BY 1, 2) GROUP BY 1""")
def page_content(spark: SparkSession, d: str) -> DataFrame:
    """What the pages of each walk hold, joined without anything between."""
    return X.paged_content(*_walks(spark, d))


@query("""SELECT series_id AS key, CAST(row_number() OVER (PARTITION BY series_id ORDER BY first_at, file_no, line_no) - 1 AS INTEGER) AS pos, CAST(file_no AS VARCHAR) AS url, export_id FROM (SELECT *, min(exported_at) OVER (PARTITION BY series_id, file_no) AS first_at FROM source_export)""")
def page_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of all pages of each walk, page by page."""
    start, pages = _walks(spark, d)
    rows = table(spark, d, "source_export").select(F.col("file_no").cast("string").alias("url"), F.col("line_no").alias("row_index"), "export_id")
    return X.paged_rows(start, pages, rows)


# ---- rules ------------------------------------------------------------------------------------------------

_Q = "[o_custkey % 10, o_orderkey % 10, length(o_orderpriority) % 10]"


@query(f"""SELECT o_orderkey AS order_key, len(list_filter(q, lambda x: x IN (1, 3, 5))) AS within, len(list_filter(q, lambda x: x NOT IN (1, 3, 5))) AS without, CASE WHEN list_has_any(t, ['a', 'b']) THEN 1 ELSE 0 END AS some, CASE WHEN list_has_any(t, ['a', 'b']) THEN 0 ELSE 1 END AS none_of,
      CASE WHEN list_has_all(['a', 'b', 'O', 'F'], t) THEN 1 ELSE 0 END AS subset, CASE WHEN len(t) = 2 THEN 1 ELSE 0 END AS sized, CASE WHEN len(t) = 0 THEN 1 ELSE 0 END AS vacant, CASE WHEN regexp_matches(lower(p), '^[12]-') THEN 1 ELSE 0 END AS matching, len(list_filter(q, lambda x: x >= 5)) AS high
    FROM (SELECT o_orderkey, {_Q} AS q, o_orderpriority AS p, CASE o_orderkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['a', o_orderstatus] WHEN 2 THEN [o_orderstatus] ELSE ['b', 'c'] END AS t FROM orders)""")
def json_filters(spark: SparkSession, d: str) -> DataFrame:
    """Every operator of path filters, over values and lists of each order."""
    o, n = table(spark, d, "orders"), F.col("o_orderkey") % 4
    tags = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(F.lit("a"), F.col("o_orderstatus"))).when(n == 2, F.array("o_orderstatus")).otherwise(F.array(F.lit("b"), F.lit("c")))
    q = F.transform(F.array(F.col("o_custkey") % 10, F.col("o_orderkey") % 10, (F.length("o_orderpriority") % 10).cast("bigint")), lambda x: F.struct(x.alias("q")))
    doc = F.to_json(F.struct(q.alias("l"), F.array(F.struct(tags.alias("t"), F.col("o_orderpriority").alias("p"))).alias("m")))
    rules = {
        "within": "$.l[?(@.q in [1,3,5])].q", "without": "$.l[?(@.q nin [1,3,5])].q", "some": "$.m[?(@.t anyof ['a','b'])].p", "none_of": "$.m[?(@.t noneof ['a','b'])].p", "subset": "$.m[?(@.t subsetof ['a','b','O','F'])].p",
        "sized": "$.m[?(@.t size 2)].p", "vacant": "$.m[?(@.t empty true)].p", "matching": "$.m[?(@.p =~ /^[12]-.*/i)].p", "high": "$.l[?(@.q >= 5)].q",
    }
    found = X.extract(o.select(F.col("o_orderkey").alias("order_key"), doc.alias("j")), "order_key", "j", rules)
    return found.select("order_key", *(F.size(c).cast("bigint" if c in ("within", "without", "high") else "int").alias(c) for c in rules))


@query(r"""SELECT rec_id, bookSourceName || '/' || length(bookSourceName) AS sized, CASE WHEN regexp_matches(sourceId, '[0-9]$') THEN 'https://x.test/' || regexp_extract(sourceId, '([0-9]+)$', 1) || '?t=' || CASE WHEN contains(sourceId, '7') THEN 'seven' ELSE 'other' END ELSE '' END AS built, md5(sourceId) AS hashed, upper(json_extract_string(j, '$.a.b[0]')) AS path, '' AS refused
    FROM (SELECT rec_id, sourceId, bookSourceName, json_object('a', json_object('b', [sourceId])) AS j FROM corpus_source)""")
def rule_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Scripts over JSON texts of every source: properties, conditions, helpers, paths, and one refused."""
    s = table(spark, d, "corpus_source")
    doc = F.to_json(F.struct(F.col("bookSourceName").alias("n"), F.col("sourceId").alias("s"), F.struct(F.array("sourceId").alias("b")).alias("a")))
    rules = {
        "sized": "$.n<js>result + '/' + result.length</js>", "built": "$.s<js>var m = result.match(/(\\d+)$/); 'https://x.test/' + m[1] + '?t=' + (result.includes('7') ? 'seven' : 'other')</js>",
        "hashed": "$.s@js:java.md5Encode(result)", "path": "<js>JSON.parse(result).a.b[0].toUpperCase()</js>", "refused": "$.s@js:java.get('https://x.test')",
    }
    found = X.extract(s.select("rec_id", doc.alias("j")), "rec_id", "j", rules)
    return found.select("rec_id", *(F.array_join(c, "|").alias(c) for c in rules))


@query("""SELECT event_id, props AS inner_text FROM events""")
def text_unwrap_json(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    wrapped = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" <script class='t'> "), "props", F.lit("</script>"))).otherwise(F.col("props"))
    return e.select("event_id", T.unwrap_json(wrapped).alias("inner_text"))


_PART = "nullif(regexp_extract(final_url, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$', {k}), '')"


@query(f"""SELECT step_id, lower({_PART.format(k=1)}) AS scheme, lower({_PART.format(k=2)}) AS host, CAST({_PART.format(k=3)} AS INT) AS port, coalesce({_PART.format(k=4)}, CASE WHEN regexp_matches(final_url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN '/' END) AS path, {_PART.format(k=5)} AS query, {_PART.format(k=6)} AS fragment FROM recorded_step""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "recorded_step").select("step_id", T.url_parts(F.col("final_url")).alias("u")).select("step_id", "u.*")


@query(rf"""SELECT delivery_id, coalesce(nullif({TRIM('link')}, ''), 'generated:' || delivery_id || ':' || CASE WHEN regexp_matches(lower({TRIM('title')}), '[a-z0-9]') THEN regexp_replace(regexp_replace(lower({TRIM('title')}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') ELSE {_FNV.format(x=TRIM('title'))} END) AS item_id FROM rss_entry""")
def item_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of entries that have no page of their own."""
    return table(spark, d, "rss_entry").select("delivery_id", T.item_id(F.col("link"), F.col("delivery_id"), F.col("title")).alias("item_id"))


# ---- texts and feeds ------------------------------------------------------------------------------------------

_HEADS = ["第一部 起", "【第二篇】", "序章", "Prologue", "CHAPTER IV: x", "番外 一", "plain", "第 三 章"]


@query(f"""WITH h AS (SELECT doc_id, {_HEADS!r}[doc_id % 8 + 1] AS h, doc_id % 8 < 6 AS ok FROM documents)
    SELECT doc_id, 'Book ' || doc_id AS book_title, 0 AS chapter_index, CASE WHEN ok THEN h ELSE '正文' END AS chapter_title, CASE WHEN ok THEN 'a' || chr(10) || 'b' ELSE h || chr(10) || 'a' || chr(10) || 'b' END AS content FROM h""")
def book_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings in the wider sense, and lines that are none, in a text for every document."""
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("doc_id") % 8 + 1).cast("int"))
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit("Book "), F.col("doc_id").cast("string"), F.lit("\r\n\r\n"), head, F.lit("\r\na \r\nb\r\n\r\n")).alias("t"))
    return B.book_texts(t, "doc_id", "t")


def _feeds(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("delivery_id")
    goes_on = F.when(n % 3 == 0, F.concat(F.lit("<link rel='next' href='/p/"), (n + 1).cast("string"), F.lit("'/>"))).when(n % 3 == 1, F.concat(F.lit("<link rel='next' href='/p/"), n.cast("string"), F.lit("'/>"))).otherwise("")
    item = lambda k: F.concat(F.lit("<item><guid>"), k, F.lit("</guid><title> "), _xml("title"), F.lit(" </title><description>"), _xml("summary"), F.lit("</description></item>"))
    xml = F.concat(F.lit("<rss><channel><title>f</title>"), goes_on, item(F.lit("1")), item(F.lit("2")), item(F.lit("1")), item(F.lit("3")), F.lit("</channel></rss>"))
    return table(spark, d, "rss_entry").select("delivery_id", F.concat(F.lit("/p/"), n.cast("string")).alias("url"), xml.alias("x"))


@query("""SELECT delivery_id, 3 AS entries, CASE WHEN delivery_id % 3 = 0 THEN '/p/' || (delivery_id + 1) END AS next_url FROM rss_entry""")
def feed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Where feeds go on; one that names itself doesn't."""
    return B.feed_pages(_feeds(spark, d), "delivery_id", "x", "url").select("delivery_id", "entries", "next_url")


_SUMMED = TRIM(r"regexp_replace(coalesce(summary, ''), '(?i)<[^>]*>|\bNEW\b', '', 'g')")


@query(f"""SELECT delivery_id, CAST(p AS INTEGER) AS pos, CAST(p + 1 AS VARCHAR) AS id, nullif({TRIM(r"regexp_replace(coalesce(title, ''), '(?i)<[^>]*>|\bNEW\b', '', 'g')")}, '') AS title, md5(nullif({_SUMMED}, '')) AS summary FROM rss_entry, (SELECT unnest([0, 1]) AS p)""")
def feed_item_rules(spark: SparkSession, d: str) -> DataFrame:
    """Items of feeds with replace rules, trimmed, the first two of each."""
    rules = [T.ReplaceRule(r"<[^>]*>|\bnew\b", "", flags="i")]
    out = B.feed_items(_feeds(spark, d), "delivery_id", "x", rules, 2)
    return out.select("delivery_id", "pos", "id", "title", F.md5(F.encode("summary", "UTF-8")).alias("summary"))


# ---- streams ---------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files; one that is a single file is picked out of its folder."""
    path = f"{d}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile()
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d) if single else reader.parquet(path)


def _run(spark: SparkSession, stream: DataFrame, put: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs a stream over what there is, and ends."""
    place = f"{shared_dir(spark)}/quire/stream-{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()


@query("""SELECT subscription_id, id, delivery_id FROM (SELECT *, row_number() OVER (PARTITION BY subscription_id, id ORDER BY first_seen_at, delivery_id) AS n FROM rss_entry WHERE id <> '') WHERE n = 1""")
def stream_new_entries(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries as a stream into a store that takes each entry once; a batch that comes again adds none."""
    store = f"{shared_dir(spark)}/quire/entries-{uuid.uuid4().hex}"
    rows = _stream(spark, d, "rss_entry").select("subscription_id", "id", "delivery_id", "first_seen_at")
    _run(spark, rows, lambda b, _: refresh_store(b, store, ["subscription_id", "id"], ["first_seen_at", "delivery_id"]))
    return spark.read.parquet(store).select("subscription_id", "id", "delivery_id")


@query("""SELECT CAST(user_id AS VARCHAR) AS key, max(CAST(floor(epoch(ts) / 3600) AS BIGINT)) AS at FROM events GROUP BY 1""")
def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """Accepted updates of every key as a stream: the last of them is the latest."""
    store = f"{shared_dir(spark)}/quire/updates-{uuid.uuid4().hex}"
    e = _stream(spark, d, "events").select("user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("at"), "event_id", "props")
    _run(spark, latest_updates(e, "user_id", "at", "event_id", "props"), lambda b, k: b.write.mode("overwrite").parquet(f"{store}/batch={k}"))
    return spark.read.parquet(store).groupBy("key").agg(F.max("at").alias("at"))
