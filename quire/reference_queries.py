"""Queries over the general operators, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import extract as X
from quire.operators import merge as M
from quire.operators import normalise as N
from quire.operators import rollup as R
from quire.operators import tables as E
from quire.operators.slices import slices
from quire.session import stage, table
from quire.sources import books as B
from quire.streaming.records import unread_counts

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


# ---- views: whole tables in the shapes the operators take ----------------------------------------

#: documents as they come from badly behaved producers: other line ends, marks, blanks, by row.
DIRTY = """(SELECT doc_id, CASE doc_id % 4
    WHEN 0 THEN replace(text, chr(10), chr(13) || chr(10))
    WHEN 1 THEN replace(text, chr(10), chr(10) || chr(10) || chr(10) || chr(10))
    WHEN 2 THEN chr(65279) || replace(text, chr(10), chr(13))
    ELSE replace(text, chr(10), ' ' || chr(10) || chr(10)) END AS t FROM documents)"""
#: documents as fragments of pages.
PAGES = """(SELECT doc_id, '<div class="c"><!-- ' || coalesce(source, '') || ' --><p>' || replace(replace(text, '<', '&lt;'), chr(10), '</p>' || chr(10) || '<p id="x">&nbsp;') || '<img class="i" src="/i/' || doc_id || '.png">&#' || (39 + doc_id % 90) || ';&#x' || printf('%x', 19968 + doc_id % 500) || ';&rsquo;&amp;#39;&#xD800;</p></div>' AS t FROM documents)"""


def dirty(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id") % 4
    t = F.col("text")
    lf = lambda s: F.replace(t, F.lit("\n"), F.lit(s))
    return table(spark, d, "documents").select("doc_id", F.when(n == 0, lf("\r\n")).when(n == 1, lf("\n\n\n\n")).when(n == 2, F.concat(F.lit("﻿"), lf("\r"))).otherwise(lf(" \n\n")).alias("t"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    body = F.replace(F.replace("text", F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit('</p>\n<p id="x">&nbsp;'))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit('<div class="c"><!-- '), F.coalesce("source", F.lit("")), F.lit(" --><p>"), body, F.lit('<img class="i" src="/i/'), F.col("doc_id"), F.lit('.png">&#'), 39 + F.col("doc_id") % 90, F.lit(";&#x"), F.lower(F.hex(19968 + F.col("doc_id") % 500)), F.lit(";&rsquo;&amp;#39;&#xD800;</p></div>")).alias("t"))


def shelf(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("source_id"), F.col("o_orderkey").cast("string").alias("book_id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("author"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("added_at"), F.col("o_orderstatus").alias("group_name"), (F.col("o_custkey") % 10).alias("sort_index"),
    )


SHELF = """(SELECT o_orderpriority AS source_id, CAST(o_orderkey AS VARCHAR) AS book_id, 'Order ' || o_orderkey AS title, 'Customer ' || o_custkey AS author,
    CAST(epoch(o_orderdate) AS BIGINT) AS added_at, o_orderstatus AS group_name, o_custkey % 10 AS sort_index FROM orders)"""


def cache(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(
        F.lit("line").alias("source_id"), F.col("l_orderkey").cast("string").alias("book_id"), F.col("l_linenumber").alias("chapter_index"),
        F.concat(F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_returnflag")).alias("content"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("cached_at"),
    )
    return E.latest(rows, ["source_id", "book_id", "chapter_index"], [F.desc("cached_at"), F.desc("content")])


CACHE = """(SELECT source_id, book_id, chapter_index, content, cached_at FROM (
    SELECT *, row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY cached_at DESC, content DESC) AS rn FROM (
      SELECT 'line' AS source_id, CAST(l_orderkey AS VARCHAR) AS book_id, l_linenumber AS chapter_index, l_partkey || '-' || l_suppkey || '-' || l_returnflag AS content, CAST(epoch(l_shipdate) AS BIGINT) AS cached_at FROM lineitem)) WHERE rn = 1)"""


def deliveries(spark: SparkSession, d: str, name: str = "rss_entry") -> DataFrame:
    """Deliveries as versioned records."""
    key, one = ("subscription_id", "id") if name == "rss_entry" else ("source_id", "link")
    return table(spark, d, name).filter(F.col(one).isNotNull()).select(
        F.col(key).alias("collection"), F.col(one).alias("record_id"), F.col("first_seen_at").alias("updated_at"), F.col("published_at").isNull().alias("deleted"),
        F.col("delivery_id").alias("revision"), F.col("batch_id").alias("device_id"), F.col("title").alias("payload"),
    )


RECORDS = """(SELECT subscription_id AS collection, id AS record_id, first_seen_at AS updated_at, published_at IS NULL AS deleted, delivery_id AS revision, batch_id AS device_id, title AS payload FROM rss_entry WHERE id IS NOT NULL)"""


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events as records that two devices changed; days as times, so that times tie."""
    e = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("collection"), F.col("event_type").alias("record_id"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).alias("updated_at"), (F.col("value") < 5).alias("deleted"),
        F.col("event_id").alias("revision"), F.concat(F.lit("device-"), (F.col("event_id") % 2).cast("string")).alias("device_id"), F.col("props").alias("payload"),
    )
    return e.filter("device_id = 'device-0'"), e.filter("device_id = 'device-1'")


SIDES = """e AS (SELECT CAST(user_id AS VARCHAR) AS collection, event_type AS record_id, CAST(floor(CAST(epoch(ts) AS BIGINT) / 86400) AS BIGINT) AS updated_at, value < 5 AS deleted,
    event_id AS revision, 'device-' || (event_id % 2) AS device_id, props AS payload FROM events),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY collection, record_id, device_id ORDER BY updated_at DESC, deleted DESC, revision DESC, payload DESC) AS rn FROM e),
  l AS (SELECT * FROM ranked WHERE rn = 1 AND device_id = 'device-0'), r AS (SELECT * FROM ranked WHERE rn = 1 AND device_id = 'device-1'),
  j AS (SELECT coalesce(l.collection, r.collection) AS collection, coalesce(l.record_id, r.record_id) AS record_id, l.rn AS lrn, r.rn AS rrn,
    l.updated_at AS lu, l.deleted AS ld, l.revision AS lr, l.device_id AS lv, l.payload AS lp, r.updated_at AS ru, r.deleted AS rd, r.revision AS rr, r.device_id AS rv, r.payload AS rp,
    CASE WHEN l.rn IS NULL OR r.rn IS NULL THEN 'none' WHEN l.deleted <> r.deleted THEN 'deleteVsUpdate' WHEN l.updated_at = r.updated_at THEN 'tieBreak' WHEN l.payload <> r.payload THEN 'concurrentUpdate' ELSE 'none' END AS conflict,
    l.rn IS NULL OR (r.rn IS NOT NULL AND (r.updated_at > l.updated_at OR (r.updated_at = l.updated_at AND (r.deleted > l.deleted OR (r.deleted = l.deleted AND r.revision > l.revision))))) AS rw
    FROM l FULL JOIN r ON l.collection = r.collection AND l.record_id = r.record_id)"""
_PICK = "CASE WHEN {w} THEN ru ELSE lu END AS updated_at, CASE WHEN {w} THEN rd ELSE ld END AS deleted, CASE WHEN {w} THEN rr ELSE lr END AS revision, CASE WHEN {w} THEN rv ELSE lv END AS device_id, CASE WHEN {w} THEN rp ELSE lp END AS payload"


# ---- text ---------------------------------------------------------------------------------------


def _text(name: str, expr: Callable[[Column], Column], sql: str, view: tuple[Callable[[SparkSession, str], DataFrame], str] = (dirty, DIRTY)) -> None:
    """A query of one text function over all documents: its digest and length, so results stay small."""
    source, source_sql = view

    def run(spark: SparkSession, d: str) -> DataFrame:
        v = source(spark, d).select("doc_id", expr(F.col("t")).alias("v"))
        return v.select("doc_id", F.md5(F.encode("v", "UTF-8")).alias("digest"), F.length("v").cast("bigint").alias("length"))

    run.__name__ = name
    run.__doc__ = f"{expr.__name__} over all documents."
    QUERIES[name] = run
    SQL[name] = f"SELECT doc_id, md5(v) AS digest, CAST(length(v) AS BIGINT) AS length FROM (SELECT doc_id, {sql} AS v FROM {source_sql})"


S = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}]"
rr = lambda x, p, w: f"regexp_replace({x}, '{p}', '{w}', 'g')"
NL = "chr(10)"
LE = r"regexp_replace({x}, '\r\n?', chr(10), 'g')"
TRIM = lambda x: rr(x, rf"\A{S}+|{S}+\z", "")
CB = r"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"

_text("text_line_endings", T.line_endings, LE.format(x="t"))
_text("text_blank_collapse", T.collapse_blank_lines, CB.format(x="t"))
_text("text_strip_bom", T.strip_bom, r"regexp_replace(t, '\A\x{FEFF}', '')")
_text("text_normalize_content", T.normalize_content, rr(CB.format(x=LE.format(x="t")), r"\A\n+|\n+\z", ""))
_text("text_remove_invisible", T.remove_invisible, rr("t", r"[\x{2009}\x{200C}\x{200D}]", ""))
_text("text_whitespace_runs", T.collapse_whitespace, rr("t", f"{S}+", " "))
_text("text_squeeze", T.squeeze, TRIM(rr("t", f"{S}+", " ")))
_text("text_trim_lines", T.trim_lines, f"array_to_string(list_transform(string_split(t, chr(10)), lambda x: {TRIM('x')}), chr(10))")
_text("text_half_width", T.half_width, "translate(t, '" + T.WIDE.replace("'", "''") + "', '" + T.NARROW.replace("'", "''") + "')")
_text("text_redact", T.redact, rr(rr("t", r"(?i)\b(Bearer|Basic|Digest)\s+[A-Za-z0-9+/=._~-]+", r"\1 [REDACTED]"), r"(?i)\b(password|passwd|token|cookie|authorization|secret|api_key)(\s*[=:]\s*)[^\s&;,\"'']+", r"\1\2[REDACTED]"))
_text("text_strip_comments", T.strip_comments, rr("t", r"(?s)<!--.*?(?:-->|\z)", ""), (pages, PAGES))
_ENT = "t"
_ENT = rr("t", r"(?s)<!--.*?(?:-->|\z)", "")
_ENT = "regexp_replace(" + _ENT + r", '(?i)</?(?:article|br|dd|div|dl|h1|h2|h3|h4|h5|h6|hr|li|p)(?:\s[^<>]*)?/?>', chr(10), 'g')"
_ENT = rr(_ENT, "</?[A-Za-z][^<>]*>", "")
#: Entities by name and number, in one pass over what stands between & and ;.
_CODE = "(CASE WHEN p[3] IN ('x', 'X') THEN CAST('0x' || p[4:-2] AS BIGINT) ELSE CAST(p[3:-2] AS BIGINT) END)"
_ENTITY = rf"""CASE p WHEN '&nbsp;' THEN ' ' WHEN '&ensp;' THEN ' ' WHEN '&emsp;' THEN ' ' WHEN '&thinsp;' THEN '' WHEN '&zwnj;' THEN '' WHEN '&zwj;' THEN '' WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&quot;' THEN '"' WHEN '&apos;' THEN chr(39)
    WHEN '&lsquo;' THEN '‘' WHEN '&rsquo;' THEN '’' WHEN '&ldquo;' THEN '“' WHEN '&rdquo;' THEN '”' WHEN '&ndash;' THEN '–' WHEN '&mdash;' THEN '—' WHEN '&hellip;' THEN '…' WHEN '&middot;' THEN '·'
    ELSE CASE WHEN NOT regexp_full_match(p, '&#(?:[xX][0-9a-fA-F]{{1,8}}|[0-9]{{1,10}});') THEN p WHEN {_CODE} < 1114112 AND NOT {_CODE} BETWEEN 55296 AND 57343 THEN chr(CAST({_CODE} AS INT)) ELSE p END END"""


def _decode(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '(?s)&[^;]*;|&[^;]*\\z|[^&]+'), lambda p: {_ENTITY}), '')"


_NAME = r"lower(regexp_extract(g, '\A<\s*/?\s*([A-Za-z0-9]+)', 1))"
_FORMAT = rf"""array_to_string(list_transform(regexp_extract_all({rr("{x}", r"(?s)<!--.*?(?:-->|" + chr(92) + "z)", "")}, '(?s)<[^>]*>|<[^>]*\z|[^<]+'), lambda g: CASE
    WHEN NOT regexp_full_match(g, '(?s)<.*>') OR {_NAME} = '' THEN g
    WHEN {_NAME} IN ('article', 'br', 'dd', 'div', 'dl', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'hr', 'li', 'p') THEN chr(10)
    WHEN {_NAME} = 'img' AND regexp_matches(g, '\ssrc="[^"]+"') THEN '<img src="' || regexp_extract(g, '\ssrc="([^"]+)"', 1) || '">' ELSE '' END), '')"""
_INVISIBLE = r"[\x{2009}\x{200C}\x{200D}]"
_EDGES = chr(92) + "A" + chr(92) + "n+|" + chr(92) + "n+" + chr(92) + "z"


def _formatted(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split({rr(_decode(_FORMAT.replace('{x}', x)), _INVISIBLE, '')}, chr(10)), lambda y: {TRIM('y')}), lambda y: y <> ''), chr(10))"


_text("text_format_fragment", T.format_fragment, _formatted("t"), (pages, PAGES))
_BARE = "regexp_replace(t, '\\A\\x{FEFF}', '')"
_PLAIN = rr(CB.format(x=LE.format(x=rr(_decode(_BARE), _INVISIBLE, ""))), _EDGES, "")
_text("text_extracted_content", T.extracted_content, f"CASE WHEN regexp_matches({_BARE}, '</?\\s*[A-Za-z]') THEN {_formatted(_BARE)} ELSE {_PLAIN} END")
_text("text_strip_tags", T.strip_tags, f"array_to_string(list_filter(list_transform(string_split({_decode(_ENT)}, chr(10)), lambda x: {TRIM('x')}), lambda x: x <> ''), chr(10))", (pages, PAGES))
_text("text_html_summary", T.summary, f"nullif({TRIM(rr(_decode(rr(rr('t', '(?s)<!--.*?(?:-->|' + chr(92) + 'z)', ''), '<[^<>]*>', ' ')), S + '+', ' '))}, '')", (pages, PAGES))
_text("text_decode_entities", T.decode_entities, _decode("t"), (pages, PAGES))


@query(f"""SELECT doc_id, CAST(i AS INTEGER) AS pos, md5(p) AS digest FROM (SELECT doc_id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM (
    SELECT doc_id, list_filter(list_transform(string_split({LE.format(x='t')}, chr(10) || chr(10)), lambda x: {TRIM('x')}), lambda x: x <> '') AS ps FROM {DIRTY}))""")
def text_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    p = dirty(spark, d).select("doc_id", F.posexplode(T.paragraphs(T.line_endings(F.col("t")))).alias("pos", "p"))
    return p.select("doc_id", "pos", F.md5(F.encode("p", "UTF-8")).alias("digest"))


@query(f"""SELECT doc_id, CAST(i AS INTEGER) AS pos, md5(p) AS digest FROM (SELECT doc_id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM (
    SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '([^。！？.!?]*[。！？.!?]|[^。！？.!?]+\\z)', 1), lambda x: {TRIM('x')}), lambda x: x <> '') AS ps FROM documents))""")
def text_sentences(spark: SparkSession, d: str) -> DataFrame:
    p = slices(table(spark, d, "documents"), "doc_id", "text", "sentence")
    return p.select("doc_id", "pos", F.md5(F.encode("slice", "UTF-8")).alias("digest"))


@query(f"""WITH s AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
  o AS (SELECT doc_id, i, l, coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
  SELECT doc_id, CAST(before + length(l) - length(regexp_replace(l, '\\A{S}+', '')) AS INTEGER) AS line_start, CAST(before + length(l) - length(regexp_replace(l, '\\A{S}+', '')) + length({TRIM('l')}) AS INTEGER) AS line_end FROM o WHERE {TRIM('l')} <> ''""")
def text_line_offsets(spark: SparkSession, d: str) -> DataFrame:
    p = slices(table(spark, d, "documents"), "doc_id", "text", "line")
    return p.select("doc_id", F.col("start_char").alias("line_start"), F.col("end_char").alias("line_end"))


RULES = [
    T.ReplaceRule(r"\bfix(es|ed)?\b", "mend$1", order=2),
    T.ReplaceRule("TODO", "later", is_regex=False, order=1),
    T.ReplaceRule("(", "", order=0),  # no pattern: does nothing
    T.ReplaceRule(r"[0-9]+ ms", "some ms", order=3, scope="mailbox; gitlog", exclude="web"),
    T.ReplaceRule("diff --git", "DIFF", is_regex=False, order=4, enabled=False),
]


@query("""SELECT doc_id, md5(CASE WHEN (contains(lower(source), 'mailbox') OR contains(lower(source), 'gitlog')) AND NOT contains(lower(source), 'web') THEN regexp_replace(x, '[0-9]+ ms', 'some ms', 'g') ELSE x END) AS digest
    FROM (SELECT doc_id, coalesce(source, '') AS source, regexp_replace(replace(text, 'TODO', 'later'), '\\bfix(es|ed)?\\b', 'mend\\1', 'g') AS x FROM documents)""")
def text_replace_rules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode(T.replace_rules(F.col("text"), RULES, False, F.col("source")), "UTF-8")).alias("digest"))


@query(f"""SELECT rec_id, token FROM (SELECT rec_id, unnest(list_filter(list_transform(regexp_split_to_array(bookSourceGroup, '[,;|]'), lambda t: lower({TRIM('t')})), lambda t: t <> '')) AS token FROM corpus_source)""")
def text_scope_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_source").select("rec_id", F.explode(T.scope_tokens(F.col("bookSourceGroup"))).alias("token"))


_FNV = """printf('%016x', list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(regexp_extract_all(hex(encode({x})), '(..)', 1), lambda h: CAST('0x' || h AS UHUGEINT))),
    lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616)::UBIGINT)"""


@query(f"SELECT rec_id, {_FNV.format(x='bookSourceName')} AS name_fnv, 'fnv1a64:' || {_FNV.format(x="(coalesce(bookSourceName, '') || '|' || coalesce(bookSourceUrl, ''))")} AS checksum FROM corpus_source")
def text_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_source").select("rec_id", T.fnv1a64(F.col("bookSourceName")).alias("name_fnv"), T.checksum(F.col("bookSourceName"), F.col("bookSourceUrl")).alias("checksum"))


@query(r"""SELECT rec_id, translate(regexp_replace(bookSourceUrl, '#.*', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS id FROM (SELECT rec_id, """ + TRIM("bookSourceUrl") + r""" AS bookSourceUrl FROM corpus_source) WHERE nullif(regexp_replace(bookSourceUrl, '#.*', ''), '') IS NOT NULL""")
def text_identity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_source").select("rec_id", T.identity(F.col("bookSourceUrl")).alias("id")).filter("id is not null")


@query(r"""SELECT step_id, CASE WHEN q <> '' THEN regexp_extract(bare, '^([^?]*)', 1) || '?' || q ELSE regexp_extract(bare, '^([^?]*)', 1) END AS locator
    FROM (SELECT step_id, bare, array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '')), '&') AS q FROM (SELECT step_id, regexp_replace(url || CASE step_id % 3 WHEN 0 THEN '&&z=1&a=2#f' WHEN 1 THEN '?' ELSE '' END, '#.*', '') AS bare FROM recorded_step))""")
def text_locator(spark: SparkSession, d: str) -> DataFrame:
    more = F.when(F.col("step_id") % 3 == 0, "&&z=1&a=2#f").when(F.col("step_id") % 3 == 1, "?").otherwise("")
    return table(spark, d, "recorded_step").select("step_id", T.locator_key(F.concat("url", more)).alias("locator"))


_NUMBERED = "CASE delivery_id % 4 WHEN 0 THEN ' 第十二章 ' || title WHEN 1 THEN 'Chapter 7  ' || title WHEN 2 THEN delivery_id || '. - ' || title ELSE title END"
_SWITCH = lambda x: f"lower({TRIM(rr(rr(rr(rr(TRIM(x), '^第[^章]*章' + S + '*', ''), '(?i)^chapter' + S + '+[0-9]+' + S + '*', ''), '^[0-9]+(?:' + S + '|[.:-])+', ''), S + '+', ' '))})"


@query(f"SELECT delivery_id, {_SWITCH('t')} AS title FROM (SELECT delivery_id, {_NUMBERED} AS t FROM rss_entry)")
def text_switch_title(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("delivery_id") % 4
    t = F.when(n == 0, F.concat(F.lit(" 第十二章 "), "title")).when(n == 1, F.concat(F.lit("Chapter 7  "), "title")).when(n == 2, F.concat(F.col("delivery_id").cast("string"), F.lit(". - "), "title")).otherwise(F.col("title"))
    return table(spark, d, "rss_entry").select("delivery_id", T.switch_title(t).alias("title"))


@query("""SELECT doc_id, strftime(make_timestamp(doc_id * 86400123000 + 28800000000), '%Y-%m-%d %H:%M:%S') AS shanghai, strftime(make_timestamp(doc_id * 86400123000), '%Y/%m/%d') AS utc FROM documents""")
def time_format(spark: SparkSession, d: str) -> DataFrame:
    ms = F.col("doc_id") * 86400123
    return table(spark, d, "documents").select("doc_id", T.format_millis(ms, "yyyy-MM-dd HH:mm:ss", 28_800_000).alias("shanghai"), T.format_millis(ms, "yyyy/MM/dd").alias("utc"))


@query("""SELECT rec_id, md5(n) AS md5, substr(md5(n), 9, 16) AS md5_16, sha1(n) AS sha1, sha256(n) AS sha256, lower(hex(encode(n))) AS hexed, base64(encode(n)) AS based, n AS from_hex, n AS from_base64 FROM (SELECT rec_id, bookSourceName AS n FROM corpus_source)""")
def codec_digests(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("bookSourceName")
    return table(spark, d, "corpus_source").select("rec_id", T.digest(n, "MD5").alias("md5"), T.md5_16(n).alias("md5_16"), T.digest(n, "SHA-1").alias("sha1"), T.digest(n, "SHA-256").alias("sha256"), T.to_hex(n).alias("hexed"), T.to_base64(n).alias("based"), T.from_hex(T.to_hex(n)).alias("from_hex"), T.from_base64(T.to_base64(n)).alias("from_base64"))


@query("""SELECT rec_id, replace(replace(replace(replace(replace(url_encode(n), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS component FROM (SELECT rec_id, bookSourceName AS n FROM corpus_source)""")
def codec_percent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_source").select("rec_id", T.encode_component(F.col("bookSourceName")).alias("component"))


@query(r"""SELECT step_id, CASE WHEN v = '' THEN '' WHEN regexp_matches(v, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN v WHEN v LIKE '//%' THEN regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || v
    WHEN v LIKE '/%' THEN regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || v ELSE regexp_extract(regexp_replace(b, '[?#].*$', ''), '^(.*/)', 1) || v END AS resolved
    FROM (SELECT step_id, final_url AS b, CASE step_id % 4 WHEN 0 THEN url WHEN 1 THEN '/c/' || keyword WHEN 2 THEN '//h.test/' || step_id ELSE 'n/' || step_id END AS v FROM recorded_step)""")
def url_resolve(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("step_id") % 4
    v = F.when(n == 0, F.col("url")).when(n == 1, F.concat(F.lit("/c/"), "keyword")).when(n == 2, F.concat(F.lit("//h.test/"), F.col("step_id").cast("string"))).otherwise(F.concat(F.lit("n/"), F.col("step_id").cast("string")))
    return table(spark, d, "recorded_step").select("step_id", T.resolve_url(F.col("final_url"), F.col("final_url"), v).alias("resolved"))


# ---- tables -------------------------------------------------------------------------------------


@query(f"""SELECT * FROM {SHELF} WHERE group_name = 'O' AND (contains(lower(title), '77') OR contains(lower(author), '77') OR contains(lower(book_id), '77')) ORDER BY sort_index, added_at DESC, source_id, book_id LIMIT 50 OFFSET 10""")
def shelf_page(spark: SparkSession, d: str) -> DataFrame:
    return E.shelf_query(shelf(spark, d), group="O", keyword=" 77 ", offset=10, limit=50)


@query(f"""SELECT group_name, count(*) AS books, min(added_at) AS first_added, max(added_at) AS last_added FROM {SHELF} GROUP BY 1""")
def shelf_groups(spark: SparkSession, d: str) -> DataFrame:
    return shelf(spark, d).groupBy("group_name").agg(F.count("*").alias("books"), F.min("added_at").alias("first_added"), F.max("added_at").alias("last_added"))


@query(f"""SELECT * FROM {SHELF} s WHERE EXISTS (SELECT 1 FROM {CACHE} c WHERE c.book_id = s.book_id)""")
def shelf_with_cache(spark: SparkSession, d: str) -> DataFrame:
    return E.with_rows_in(shelf(spark, d), cache(spark, d), ["book_id"])


@query(f"""SELECT * FROM {SHELF} s WHERE NOT EXISTS (SELECT 1 FROM {CACHE} c WHERE c.book_id = s.book_id)""")
def shelf_without_cache(spark: SparkSession, d: str) -> DataFrame:
    return E.with_rows_in(shelf(spark, d), cache(spark, d), ["book_id"], there=False)


@query("""SELECT * EXCLUDE (rn) FROM (SELECT rec_id, sourceId, bookSourceName, bookSourceUrl, weight, enabled, row_number() OVER (PARTITION BY bookSourceUrl ORDER BY rec_id DESC) AS rn FROM corpus_source) WHERE rn = 1""")
def table_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "corpus_source").select("rec_id", "sourceId", "bookSourceName", "bookSourceUrl", "weight", "enabled")
    return E.upsert(rows.limit(0), rows, ["bookSourceUrl"], "rec_id")


@query(f"""SELECT c.* FROM {CACHE} c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderstatus = 'F' AND CAST(o.o_orderkey AS VARCHAR) = c.book_id)""")
def table_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("book_id"))
    return E.delete_by(cache(spark, d), gone, ["book_id"])


@query(f"""SELECT book_id, count(*) AS entries, CAST(sum(strlen(content)) AS BIGINT) AS bytes, min(cached_at) AS oldest, max(cached_at) AS newest FROM {CACHE} GROUP BY 1""")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return E.cache_stats(cache(spark, d), ["book_id"])


_BOOKS = "(SELECT 'line' AS source_id, CAST(o_orderkey AS VARCHAR) AS book_id, CAST(3 + o_custkey % 6 AS INTEGER) AS chapter_count, CAST(o_custkey % 5 AS INTEGER) AS anchor_index FROM orders)"


def books(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.lit("line").alias("source_id"), F.col("o_orderkey").cast("string").alias("book_id"), (3 + F.col("o_custkey") % 6).cast("int").alias("chapter_count"), (F.col("o_custkey") % 5).cast("int").alias("anchor_index"))


@query(f"""SELECT source_id, book_id, chapter_count, array_to_string(list_filter(list_sort(own), lambda x: x < chapter_count), ',') AS cached, array_to_string(list_filter(range(chapter_count), lambda x: NOT list_contains(own, x)), ',') AS missing, coalesce(bytes, 0) AS bytes, oldest, newest
    FROM (SELECT b.source_id, b.book_id, b.chapter_count, coalesce(c.own, []) AS own, c.bytes, c.oldest, c.newest FROM {_BOOKS} b LEFT JOIN (SELECT book_id, list(DISTINCT chapter_index) AS own, CAST(sum(strlen(content)) AS BIGINT) AS bytes, min(cached_at) AS oldest, max(cached_at) AS newest FROM {CACHE} GROUP BY 1) c USING (book_id))""")
def cache_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = E.cache_coverage(cache(spark, d), books(spark, d).drop("anchor_index"))
    return c.select("source_id", "book_id", "chapter_count", F.array_join(c["cached"].cast("array<string>"), ",").alias("cached"), F.array_join(c["missing"].cast("array<string>"), ",").alias("missing"), "bytes", "oldest", "newest")


@query(f"""SELECT source_id, book_id, CAST(chapter_index AS INTEGER) AS chapter_index, CAST(place AS INTEGER) AS place FROM (SELECT w.source_id, w.book_id, w.chapter_index, row_number() OVER (PARTITION BY w.book_id ORDER BY w.chapter_index) AS place
    FROM (SELECT source_id, book_id, unnest(range(greatest(0, anchor_index - 1), least(chapter_count - 1, anchor_index + 3) + 1)) AS chapter_index FROM {_BOOKS}) w
    WHERE NOT EXISTS (SELECT 1 FROM {CACHE} c WHERE c.book_id = w.book_id AND c.chapter_index = w.chapter_index)) WHERE place <= 2""")
def cache_prefetch(spark: SparkSession, d: str) -> DataFrame:
    return E.prefetch(cache(spark, d), books(spark, d), 1, 3, 2)


@query(f"""SELECT source_id, book_id, chapter_index, content, cached_at FROM (SELECT *, row_number() OVER w AS n, sum(strlen(content)) OVER w AS total FROM {CACHE} WHERE cached_at >= 850000000
    WINDOW w AS (ORDER BY cached_at DESC, source_id DESC, book_id DESC, chapter_index DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE n <= 400000 AND total <= 300000""")
def cache_prune(spark: SparkSession, d: str) -> DataFrame:
    return E.prune_cache(stage(cache(spark, d), "cache"), 850_000_000, 400_000, 300_000)


@query("""SELECT user_id, event_type, event_id, updated_at FROM (SELECT user_id, event_type, event_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS updated_at, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(floor(epoch(ts) / 3600) AS BIGINT) DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def progress_latest(spark: SparkSession, d: str) -> DataFrame:
    return E.progress_latest(_progress(spark, d), ["user_id", "event_type"], "event_id")


def _progress(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_type", "event_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("updated_at"))


@query("""SELECT subscription_id, delivery_id, updated_at FROM (SELECT subscription_id, delivery_id, first_seen_at AS updated_at, max(first_seen_at) OVER (PARTITION BY subscription_id, id ORDER BY delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM rss_entry WHERE id IS NOT NULL) WHERE updated_at < newest""")
def progress_late(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rss_entry").filter("id is not null").select("subscription_id", "id", "delivery_id", F.col("first_seen_at").alias("updated_at"))
    return E.late_updates(rows, ["subscription_id", "id"], "delivery_id").select("subscription_id", "delivery_id", "updated_at")


@query("""SELECT export_id, lag(export_id) OVER w AS prev_id, lead(export_id) OVER w AS next_id FROM source_export WINDOW w AS (PARTITION BY file_no ORDER BY line_no)""")
def chapter_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return E.neighbours(table(spark, d, "source_export"), ["file_no"], "line_no", "export_id").select("export_id", "prev_id", "next_id")


@query("""SELECT o_orderkey, CAST(o_custkey % 7 AS INTEGER) AS anchor, CAST(unnest(range(greatest(0, o_custkey % 7 - 2), least(o_custkey % 7 + 2, greatest(0, o_custkey % 7 - 2) + 3) + 1)) AS INTEGER) AS ordinal FROM orders""")
def chapter_prefetch_range(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 7).cast("int").alias("anchor"))
    return E.prefetch_range(a, 2, 4).select("o_orderkey", "anchor", F.col("ordinal").cast("int").alias("ordinal"))


WORD = "v2"


@query("""SELECT rec_id FROM corpus_source WHERE contains(lower(bookSourceName), 'v2') OR contains(lower(coalesce(bookSourceUrl, '')), 'v2') OR contains(lower(coalesce(bookSourceGroup, '')), 'v2') OR contains(lower(coalesce(bookSourceComment, '')), 'v2')""")
def bookmark_search(spark: SparkSession, d: str) -> DataFrame:
    return E.search_fields(table(spark, d, "corpus_source"), WORD, ["bookSourceName", "bookSourceUrl", "bookSourceGroup", "bookSourceComment"]).select("rec_id")


@query("""SELECT bookSourceUrl, count(*) AS n FROM corpus_source GROUP BY 1 HAVING count(*) > 1""")
def table_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return E.duplicate_keys(table(spark, d, "corpus_source"), ["bookSourceUrl"])


# Files of one series as versions of one table of contents: line_no is the place, the source its url
_VERSION = """v AS (SELECT f.series_id, f.file_no, lag(f.file_no) OVER (PARTITION BY f.series_id ORDER BY f.at, f.file_no) AS prev_no FROM (SELECT series_id, file_no, min(exported_at) AS at FROM source_export GROUP BY 1, 2) f),
  toc AS (SELECT series_id, file_no, line_no, export_id, json_extract_string(raw, '$.bookSourceName') AS title, json_extract_string(raw, '$.bookSourceUrl') AS url, json_extract_string(raw, '$.weight') AS weight FROM source_export),
  neu AS (SELECT t.* FROM toc t JOIN v USING (series_id, file_no) WHERE v.prev_no IS NOT NULL),
  old AS (SELECT t.series_id, v.file_no, t.line_no, t.export_id, t.title, t.url, t.weight FROM toc t JOIN v ON t.series_id = v.series_id AND t.file_no = v.prev_no)"""


def versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    export = table(spark, d, "source_export")
    f = export.groupBy("series_id", "file_no").agg(F.min("exported_at").alias("at"))
    v = f.withColumn("prev_no", F.lag("file_no").over(Window.partitionBy("series_id").orderBy("at", "file_no"))).drop("at").filter("prev_no is not null")
    toc = export.select("series_id", "file_no", "line_no", "export_id", F.get_json_object("raw", "$.bookSourceName").alias("title"), F.get_json_object("raw", "$.bookSourceUrl").alias("url"), F.get_json_object("raw", "$.weight").alias("weight"))
    new = toc.join(v.select("series_id", "file_no"), ["series_id", "file_no"])
    old = toc.withColumnRenamed("file_no", "prev_no").join(v, ["series_id", "prev_no"]).drop("prev_no")
    return old, new


@query(f"""WITH {_VERSION} SELECT n.file_no, n.export_id FROM neu n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.series_id = n.series_id AND o.file_no = n.file_no AND lower({TRIM('o.title')}) = lower({TRIM('n.title')}))""")
def toc_new_titles(spark: SparkSession, d: str) -> DataFrame:
    old, new = versions(spark, d)
    return E.new_titles(new, old, ["series_id", "file_no"]).select("file_no", "export_id")


_KEYED = """coalesce('u:' || nullif(translate(regexp_replace({u}, '#.*', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), 't:' || {t}) AS key, {t} AS name"""
_OCC = """{a} AS (SELECT *, row_number() OVER (PARTITION BY file_no, key ORDER BY line_no) AS nth, row_number() OVER (PARTITION BY file_no, name ORDER BY line_no) AS nth_name FROM (SELECT file_no, line_no, {k} FROM {b}))"""
_REMAP = _VERSION + ", " + _OCC.format(a="a", b="old", k=_KEYED.format(u=TRIM("url"), t=TRIM("coalesce(title, '')"))) + ", " + _OCC.format(a="b", b="neu", k=_KEYED.format(u=TRIM("url"), t=TRIM("coalesce(title, '')"))) + """,
  m AS (SELECT a.file_no, a.line_no AS old_index, coalesce(k.line_no, n.line_no) AS new_index FROM a LEFT JOIN b k ON a.file_no = k.file_no AND a.key = k.key AND a.nth = k.nth LEFT JOIN b n ON a.file_no = n.file_no AND a.name = n.name AND a.nth_name = n.nth_name AND n.name <> '')"""


@query(f"""WITH {_REMAP} SELECT file_no, old_index, new_index, CASE WHEN new_index IS NULL THEN 'removed' ELSE 'mapped' END AS change FROM m
    UNION ALL SELECT b.file_no, NULL, b.line_no, 'inserted' FROM b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.file_no = b.file_no AND m.new_index = b.line_no)""")
def toc_remap(spark: SparkSession, d: str) -> DataFrame:
    old, new = versions(spark, d)
    return M.remap_toc(old, new, ["file_no"], "line_no")


@query(f"""WITH {_REMAP} SELECT file_no, old_index, coalesce(new_index, aft, bef) AS target_index, CASE WHEN new_index IS NOT NULL THEN 'same' WHEN aft IS NOT NULL THEN 'next' WHEN bef IS NOT NULL THEN 'previous' ELSE 'empty' END AS clamped_to FROM (
    SELECT file_no, old_index, new_index, first_value(new_index IGNORE NULLS) OVER (PARTITION BY file_no ORDER BY old_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS aft, last_value(new_index IGNORE NULLS) OVER (PARTITION BY file_no ORDER BY old_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bef FROM m)""")
def toc_clamp(spark: SparkSession, d: str) -> DataFrame:
    old, new = versions(spark, d)
    return M.clamp_to_survivor(M.remap_toc(old, new, ["file_no"], "line_no"), ["file_no"])


@query(f"""WITH {_VERSION}, pick AS (SELECT 'a' AS side, * FROM old UNION ALL SELECT 'b', * FROM neu), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY side, file_no, url ORDER BY line_no, export_id) AS n FROM pick) WHERE n = 1),
  j AS (SELECT coalesce(x.file_no, y.file_no) AS file_no, coalesce(x.url, y.url) AS url, x.export_id AS old_id, y.export_id AS new_id, x.line_no AS xo, y.line_no AS yo, x.title AS xt, y.title AS yt, x.weight AS xw, y.weight AS yw FROM (SELECT * FROM one WHERE side = 'a') x FULL JOIN (SELECT * FROM one WHERE side = 'b') y ON x.file_no = y.file_no AND x.url = y.url),
  d AS (SELECT file_no, url, old_id, new_id, list_filter([CASE WHEN old_id IS NULL THEN 'added' END, CASE WHEN new_id IS NULL THEN 'removed' END, CASE WHEN old_id IS NOT NULL AND new_id IS NOT NULL AND xo IS DISTINCT FROM yo THEN 'reordered' END,
    CASE WHEN old_id IS NOT NULL AND new_id IS NOT NULL AND xt IS DISTINCT FROM yt THEN 'titleChanged' END, CASE WHEN old_id IS NOT NULL AND new_id IS NOT NULL AND xw IS DISTINCT FROM yw THEN 'checksumChanged' END], lambda k: k IS NOT NULL) AS ks FROM j)
  SELECT file_no, url, old_id, new_id, unnest(CASE WHEN len(ks) = 0 THEN ['unchanged'] ELSE ks END) AS change FROM d""")
def toc_index_diff(spark: SparkSession, d: str) -> DataFrame:
    old, new = (x.withColumnsRenamed({"line_no": "ordinal", "export_id": "chapter_id"}) for x in versions(spark, d))
    return M.diff_index(old, new, ["file_no"], "url", {"ordinal": "reordered", "title": "titleChanged", "weight": "checksumChanged"})


#: Titles of the two versions, numbered anew by the later one, so that every step of the matching is met.
_RENUMBERED = """a AS (SELECT file_no, line_no, CASE WHEN line_no % 3 = 0 THEN '第' || line_no || '章 ' || title ELSE title END AS title FROM old),
  b AS (SELECT file_no, line_no, CASE WHEN line_no % 3 = 0 THEN '第' || (line_no + 1) || '章 ' || title ELSE title END AS title FROM neu WHERE line_no % 4 <> 1)"""


@query(f"""WITH {_VERSION}, {_RENUMBERED}, x AS (SELECT file_no, line_no, title, {_SWITCH('title')} AS fuzzy FROM a), y AS (SELECT file_no, line_no, title, {_SWITCH('title')} AS fuzzy FROM b),
  m AS (SELECT x.file_no, x.line_no AS old_index, (SELECT min(line_no) FROM y WHERE y.file_no = x.file_no AND y.title = x.title) AS e, (SELECT min(line_no) FROM y WHERE y.file_no = x.file_no AND y.line_no = x.line_no) AS i,
    (SELECT min(line_no) FROM y WHERE y.file_no = x.file_no AND y.fuzzy = x.fuzzy) AS f, (SELECT min(line_no) FROM y WHERE y.file_no = x.file_no) AS z FROM x)
  SELECT file_no, old_index, coalesce(e, i, f, z) AS new_index, CASE WHEN e IS NOT NULL THEN 'exactTitle' WHEN i IS NOT NULL THEN 'sameIndex' WHEN f IS NOT NULL THEN 'fuzzyTitle' WHEN z IS NOT NULL THEN 'first' ELSE 'none' END AS matched_by FROM m""")
def source_switch_match(spark: SparkSession, d: str) -> DataFrame:
    return E.match_source(*renumbered(spark, d), ["file_no"])


def renumbered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old, new = versions(spark, d)
    number = lambda n: F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("第"), n.cast("string"), F.lit("章 "), "title")).otherwise(F.col("title"))
    a = old.select("file_no", F.col("line_no").alias("chapter_index"), number(F.col("line_no")).alias("title"))
    b = new.filter("line_no % 4 <> 1").select("file_no", F.col("line_no").alias("chapter_index"), number(F.col("line_no") + 1).alias("title"))
    return a, b


_KEYOF = lambda c: f"nullif(CASE WHEN {c} IS NULL THEN NULL ELSE regexp_extract(regexp_replace({c}, '#.*', ''), '^([^?]*)', 1) END, '')"


@query(f"""WITH {_VERSION}, c AS (SELECT file_no, title AS chapter_id, line_no * 2 AS ordinal, url AS canonical, 'o/' || url AS origin FROM neu),
  o AS (SELECT file_no, title || CASE WHEN line_no % 2 = 0 THEN '' ELSE '?' END AS chapter_id, line_no AS ordinal, CASE WHEN line_no % 3 = 0 THEN 'o/' || url || '#x' END AS origin, CASE WHEN line_no % 5 = 0 THEN url END AS canonical FROM old),
  l AS (SELECT file_no, k, min(struct_pack(o := ordinal, i := chapter_id)) AS x FROM (SELECT file_no, ordinal, chapter_id, {_KEYOF('canonical')} AS k FROM c UNION SELECT file_no, ordinal, chapter_id, {_KEYOF('origin')} FROM c) WHERE k IS NOT NULL GROUP BY 1, 2),
  p AS (SELECT *, row_number() OVER (PARTITION BY file_no ORDER BY ordinal, chapter_id) - 1 AS place, count(*) OVER (PARTITION BY file_no) AS n FROM c),
  i AS (SELECT file_no, chapter_id, min(ordinal) AS ordinal FROM c GROUP BY 1, 2), q AS (SELECT file_no, ordinal, min(chapter_id) AS chapter_id FROM c GROUP BY 1, 2), s AS (SELECT DISTINCT file_no, n FROM p)
  SELECT o.file_no, o.chapter_id, o.ordinal AS old_ordinal, coalesce(i.ordinal, lo.x.o, lc.x.o, q.ordinal, p.ordinal) AS new_ordinal, coalesce(i.chapter_id, lo.x.i, lc.x.i, q.chapter_id, p.chapter_id) AS new_chapter_id,
    CASE WHEN i.ordinal IS NOT NULL THEN 'exact' WHEN lo.x IS NOT NULL OR lc.x IS NOT NULL THEN 'locator' WHEN q.ordinal IS NOT NULL THEN 'ordinal' WHEN p.ordinal IS NOT NULL THEN 'nearest' ELSE 'reset' END AS resolved_by
  FROM o LEFT JOIN i ON i.file_no = o.file_no AND i.chapter_id = o.chapter_id LEFT JOIN l lo ON lo.file_no = o.file_no AND lo.k = {_KEYOF('o.origin')} LEFT JOIN l lc ON lc.file_no = o.file_no AND lc.k = {_KEYOF('o.canonical')}
  LEFT JOIN q ON q.file_no = o.file_no AND q.ordinal = o.ordinal LEFT JOIN s ON s.file_no = o.file_no LEFT JOIN p ON p.file_no = o.file_no AND p.place = greatest(0, least(o.ordinal, s.n - 1))""")
def progress_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Progress in the lists of one file against those of the next, whose ordinals leave gaps."""
    old, new = versions(spark, d)
    n = F.col("line_no")
    chapters = new.select("file_no", F.col("title").alias("chapter_id"), (n * 2).alias("ordinal"), F.col("url").alias("canonical_locator"), F.concat(F.lit("o/"), "url").alias("origin_locator"))
    progress = old.select("file_no", F.concat("title", F.when(n % 2 == 0, "").otherwise("?")).alias("chapter_id"), n.alias("ordinal"), F.when(n % 3 == 0, F.concat(F.lit("o/"), "url", F.lit("#x"))).alias("origin_locator"), F.when(n % 5 == 0, F.col("url")).alias("canonical_locator"))
    return E.resolve_progress(progress, chapters, ["file_no"])


# ---- merging ------------------------------------------------------------------------------------


@query(f"""SELECT collection, record_id, updated_at, deleted, revision, device_id, payload FROM (SELECT *, row_number() OVER (PARTITION BY collection, record_id ORDER BY updated_at DESC, deleted DESC, revision DESC, device_id DESC, payload DESC) AS n FROM {RECORDS}) WHERE n = 1""")
def sync_winners(spark: SparkSession, d: str) -> DataFrame:
    return M.winners(deliveries(spark, d))


@query(f"""SELECT collection, record_id, updated_at, deleted, revision, device_id, payload FROM (SELECT *, row_number() OVER (PARTITION BY collection, record_id ORDER BY updated_at DESC, deleted DESC, revision DESC, device_id DESC, payload DESC) AS n FROM {RECORDS}) WHERE n = 1 AND NOT deleted""")
def sync_live(spark: SparkSession, d: str) -> DataFrame:
    return M.live(deliveries(spark, d))


@query(f"""SELECT * FROM {RECORDS} WHERE updated_at > 1740000000""")
def sync_changed_since(spark: SparkSession, d: str) -> DataFrame:
    return M.changed_since(deliveries(spark, d), 1_740_000_000)


@query(f"""WITH {SIDES} SELECT collection, record_id, {_PICK.format(w='rw')}, CASE WHEN rw THEN 'remote' ELSE 'local' END AS side, conflict FROM j""")
def sync_merge(spark: SparkSession, d: str) -> DataFrame:
    return M.merge(*sides(spark, d))


@query(f"""WITH {SIDES}, k AS (SELECT *, CASE WHEN conflict <> 'none' THEN FALSE ELSE rw END AS w FROM j) SELECT collection, record_id, {_PICK.format(w='w')}, CASE WHEN w THEN 'remote' ELSE 'local' END AS side, conflict FROM k""")
def sync_merge_devices(spark: SparkSession, d: str) -> DataFrame:
    return M.merge(*sides(spark, d), "device", ["device-0", "device-1"])


@query(f"""WITH {SIDES} SELECT collection, record_id, {_PICK.format(w='rw')}, CASE WHEN conflict <> 'none' THEN NULL WHEN rw THEN 'remote' ELSE 'local' END AS side, conflict FROM j""")
def sync_merge_manual(spark: SparkSession, d: str) -> DataFrame:
    return M.merge(*sides(spark, d), "manual")


@query(f"""WITH {SIDES} SELECT collection, record_id, {_PICK.format(w='rw')}, CASE WHEN rw THEN 'remote' ELSE 'local' END AS side, conflict FROM j
    UNION ALL SELECT collection, record_id || '#conflict:' || device_id || ':' || revision, updated_at, deleted, revision, device_id, payload, side, conflict FROM (SELECT collection, record_id, {_PICK.format(w='NOT rw')}, CASE WHEN rw THEN 'local' ELSE 'remote' END AS side, conflict FROM j WHERE conflict <> 'none') WHERE NOT deleted""")
def sync_merge_keep_both(spark: SparkSession, d: str) -> DataFrame:
    return M.merge(*sides(spark, d), "keep_both")


_PROG = "(SELECT CAST(user_id AS VARCHAR) AS book_id, CAST(value AS INTEGER) % 5 AS chapter_index, event_type AS device_id, CAST(floor(CAST(epoch(ts) AS BIGINT) / 86400) AS BIGINT) AS updated_at, event_id % 3 AS sync_version, value AS progress_fraction, CAST(event_id AS VARCHAR) AS chapter_title FROM events)"


def progress_records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("book_id"), (F.round("value").cast("int") % 5).alias("chapter_index"), F.col("event_type").alias("device_id"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).alias("updated_at"), (F.col("event_id") % 3).alias("sync_version"), F.col("value").alias("progress_fraction"), F.col("event_id").cast("string").alias("chapter_title"))


_PROG = _PROG.replace("CAST(value AS INTEGER) % 5", "CAST(round(value) AS INTEGER) % 5")


@query(f"""SELECT * EXCLUDE (n, m) FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY updated_at DESC, sync_version DESC, chapter_index DESC, device_id DESC) AS m FROM (
    SELECT *, row_number() OVER (PARTITION BY book_id, chapter_index, device_id ORDER BY updated_at DESC, sync_version DESC, progress_fraction DESC, chapter_title DESC) AS n FROM {_PROG}) WHERE n = 1) WHERE m <= 3""")
def progress_merge(spark: SparkSession, d: str) -> DataFrame:
    return M.merge_progress(progress_records(spark, d), 3)


@query(f"""SELECT collection, record_id, max(CASE WHEN n = 1 THEN revision END) AS kept_id, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS discarded
    FROM (SELECT *, row_number() OVER (PARTITION BY collection, record_id ORDER BY updated_at DESC, revision) AS n FROM {RECORDS}) GROUP BY 1, 2""")
def sync_journal(spark: SparkSession, d: str) -> DataFrame:
    return M.journal(deliveries(spark, d), M.KEY, [F.desc("updated_at"), F.asc("revision")], "revision")


@query("""SELECT export_id FROM (SELECT export_id, exported_at, dense_rank() OVER (PARTITION BY series_id ORDER BY exported_at DESC, file_no DESC) AS n, row_number() OVER (PARTITION BY series_id ORDER BY exported_at DESC, export_id DESC) AS k FROM source_export) WHERE k > 20 OR epoch(exported_at) < 1750000000""")
def backup_retention(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "source_export").withColumn("at", F.unix_micros("exported_at") / 1_000_000)
    return M.retention(items, ["series_id"], [F.desc("exported_at"), F.desc("export_id")], 20, "at", 1_750_000_000, "export_id").select("export_id")


@query("""SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY subscription_id, id ORDER BY first_seen_at, delivery_id) AS n FROM rss_entry) WHERE n = 1""")
def feed_first_per_id(spark: SparkSession, d: str) -> DataFrame:
    return M.first_per_id(table(spark, d, "rss_entry"), ["subscription_id"], "id", ["first_seen_at", "delivery_id"]).select("delivery_id")


@query("""WITH s AS (SELECT e.subscription_id, min(e.delivery_id) AS stop FROM rss_entry e WHERE EXISTS (SELECT 1 FROM rss_entry k WHERE k.batch_id = (SELECT max(batch_id) FROM rss_entry) AND k.subscription_id = e.subscription_id AND k.id = e.id) GROUP BY 1)
    SELECT e.subscription_id, e.delivery_id FROM rss_entry e LEFT JOIN s USING (subscription_id) WHERE s.stop IS NULL OR e.delivery_id < s.stop""")
def feed_before_seen(spark: SparkSession, d: str) -> DataFrame:
    entry = table(spark, d, "rss_entry").select("subscription_id", "id", "delivery_id", "batch_id")
    seen = entry.join(entry.agg(F.max("batch_id").alias("batch_id")), "batch_id").select("subscription_id", "id")
    return M.before_last_seen(entry, ["subscription_id"], "delivery_id", seen).select("subscription_id", "delivery_id")


@query("""SELECT rec_id, CASE WHEN sum IS NULL THEN 0 ELSE count(*) OVER c END AS same_checksum, CASE WHEN sum IS NOT NULL THEN min(rec_id) OVER c END AS first_by_checksum, count(*) OVER t AS same_title, min(rec_id) OVER t AS first_by_title
    FROM (SELECT *, CASE WHEN rec_id % 5 <> 0 THEN ruleSearch END AS sum FROM corpus_source) WINDOW c AS (PARTITION BY sum), t AS (PARTITION BY bookSourceName, bookSourceGroup)""")
def catalog_match(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "corpus_source").select("rec_id", F.when(F.col("rec_id") % 5 != 0, F.md5(F.encode("ruleSearch", "UTF-8"))).alias("checksum"), F.col("bookSourceName").alias("title"), F.col("bookSourceGroup").alias("author"))
    return M.catalog_matches(s, "rec_id")


# ---- runs ---------------------------------------------------------------------------------------

LEVELS = ["L2-search", "L3-detail", "L4-toc", "L5-content"]


def results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "recorded_step").select("source_id", "level", F.when(F.col("response_status") == 200, "pass").otherwise("fail").alias("status"))


@query("""WITH w AS (SELECT source_id, level, max(CASE WHEN response_status = 200 THEN 2 ELSE 1 END) AS s FROM recorded_step GROUP BY 1, 2), a AS (SELECT s.source_id, l.level, coalesce(w.s, 0) AS s FROM (SELECT DISTINCT source_id FROM recorded_step) s CROSS JOIN (SELECT unnest(['L2-search', 'L3-detail', 'L4-toc', 'L5-content']) AS level) l LEFT JOIN w ON w.source_id = s.source_id AND w.level = l.level)
    SELECT level, count(*) FILTER (s = 2) AS passed, count(*) FILTER (s = 1) AS failed, count(*) FILTER (s = 0) AS skipped, round(count(*) FILTER (s = 2) / count(*), 6) AS pass_rate FROM a GROUP BY 1""")
def run_levels(spark: SparkSession, d: str) -> DataFrame:
    return R.outcome_counts(results(spark, d), "source_id", "level", "status", LEVELS)


@query("""WITH o AS (SELECT source_id, level, min(CASE WHEN response_status = 200 THEN 1 ELSE 0 END) AS ok, max(CASE WHEN response_status = 200 THEN 1 ELSE 0 END) AS an FROM recorded_step GROUP BY 1, 2), p AS (SELECT source_id, sum(ok) AS ok, sum(an) AS an, sum(1 - ok) AS bad FROM o GROUP BY 1)
    SELECT CASE WHEN ok = 4 AND bad = 0 THEN 'fully' WHEN an > 0 THEN 'partially' ELSE 'failed' END AS verdict, count(*) AS sources FROM p GROUP BY 1""")
def run_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return R.verdicts(results(spark, d), "source_id", "level", "status", 4)


_FORMS = r"""f AS (SELECT rec_id, enabled, bookSourceType, section, unnest(json_keys(section)) AS k FROM (SELECT rec_id, enabled, bookSourceType, unnest([ruleSearch, ruleBookInfo, ruleToc, ruleContent, ruleExplore]) AS section FROM corpus_source) WHERE json_valid(section)),
  r AS (SELECT rec_id, enabled, bookSourceType, json_extract_string(section, '$."' || k || '"') AS r FROM f WHERE json_type(section, '$."' || k || '"') = 'VARCHAR'),
  t AS (SELECT rec_id, enabled, bookSourceType, r, list_filter([CASE WHEN starts_with(lower(r), '@css:') THEN 'css' END, CASE WHEN starts_with(lower(r), '@xpath:') OR starts_with(r, '//') THEN 'xpath' END, CASE WHEN starts_with(lower(r), '@json:') OR contains(r, '$.') OR contains(r, '$[') THEN 'json' END, CASE WHEN starts_with(r, '@js:') OR regexp_matches(r, '(?s)<js>.*?</js>') THEN 'js' END,
    CASE WHEN regexp_matches(r, '\{\{.*?\}\}') THEN 'template' END, CASE WHEN regexp_matches(r, '##.+?##') THEN 'regexSuffix' END, CASE WHEN regexp_matches(r, '[&|]{2}|%%') THEN 'combined' END, CASE WHEN contains(r, '@put') OR contains(r, '@get') THEN 'variables' END], lambda x: x IS NOT NULL) AS own FROM r WHERE r <> ''),
  l AS (SELECT rec_id, enabled, bookSourceType, unnest(CASE WHEN len(own) > 0 THEN own WHEN regexp_matches(r, '\A(?:[.#]|class\.|tag\.|id\.|[a-z][a-z0-9]*[@.#]|.*@(?:text|href|src|html)\z)') THEN ['shorthand'] ELSE ['plain'] END) AS form FROM t)"""


def _forms(spark: SparkSession, d: str) -> DataFrame:
    sections = ["ruleSearch", "ruleBookInfo", "ruleToc", "ruleContent", "ruleExplore"]
    return R.rule_forms(table(spark, d, "corpus_source"), sections, ["rec_id", "enabled", "bookSourceType"])


@query(f"WITH {_FORMS} SELECT DISTINCT rec_id, form FROM l")
def rule_forms(spark: SparkSession, d: str) -> DataFrame:
    """The forms of all rules of a source, each rule looked at by itself."""
    return _forms(spark, d).select("rec_id", "form").distinct()


@query("""SELECT enabled, bookSourceType, count(*) AS sources FROM corpus_source GROUP BY GROUPING SETS ((enabled), (bookSourceType), ())""")
def source_tallies(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "corpus_source")
    return t.groupingSets([[F.col("enabled")], [F.col("bookSourceType")], []], "enabled", "bookSourceType").agg(F.count("*").alias("sources")).select("enabled", "bookSourceType", "sources")


_PLAIN_LEAF = r"""CASE WHEN type = 'VARCHAR' THEN regexp_replace(trim(regexp_replace(atom ->> '$', '[ \t]+', ' ', 'g')), '^(https?://.*?)/+$', '\1') ELSE CASE WHEN type IN ('ARRAY', 'OBJECT') THEN value::VARCHAR ELSE coalesce(atom::VARCHAR, 'null') END END"""


@query(f"""WITH {_VERSION}, pairs AS (SELECT o.export_id AS old_id, n.export_id FROM old o JOIN neu n ON o.series_id = n.series_id AND o.file_no = n.file_no AND o.url = n.url),
  leaves AS (SELECT s.export_id, j.fullkey AS path, {_PLAIN_LEAF} AS value FROM source_export s, json_tree(s.raw) j WHERE j.type NOT IN ('ARRAY', 'OBJECT') OR j.value::VARCHAR IN ('[]', '{{}}')),
  x AS (SELECT p.export_id, l.path, l.value FROM pairs p JOIN leaves l ON l.export_id = p.old_id), y AS (SELECT p.export_id, l.path, l.value FROM pairs p JOIN leaves l ON l.export_id = p.export_id)
  SELECT coalesce(x.export_id, y.export_id) AS export_id, coalesce(x.path, y.path) AS path, CASE WHEN y.path IS NULL THEN 'missing' WHEN x.path IS NULL THEN 'unexpected' ELSE 'value-mismatch' END AS kind, x.value AS expected, y.value AS actual
  FROM x FULL JOIN y ON x.export_id = y.export_id AND x.path = y.path WHERE x.path IS NULL OR y.path IS NULL OR x.value <> y.value""")
def export_path_diff(spark: SparkSession, d: str) -> DataFrame:
    """What differs by path between a source's record in a file and in the file before."""
    old, new = versions(spark, d)
    export = table(spark, d, "source_export").select("export_id", "raw")
    pair = old.select("series_id", "file_no", "url", F.col("export_id").alias("old_id")).join(new.select("series_id", "file_no", "url", "export_id"), ["series_id", "file_no", "url"]).select("old_id", "export_id")
    a = pair.join(export.withColumnsRenamed({"export_id": "old_id"}), "old_id").select("export_id", "raw")
    b = pair.select("export_id").join(export, "export_id")
    return R.diff_paths(R.flatten_json(a, "export_id", "raw"), R.flatten_json(b, "export_id", "raw"), "export_id")


# ---- extraction ---------------------------------------------------------------------------------


@query(r"""SELECT step_id, regexp_extract(response_body, '<h1>([^<]*)</h1>', 1) AS heading, regexp_extract(response_body, '<p>([^<]*)</p>', 1) AS paragraph, regexp_extract(response_body, '<p>([^<]*)</p>', 1) AS by_path, regexp_replace(regexp_extract(response_body, '<h1>([^<]*)</h1>', 1), '[aeiou]', '*', 'g') AS replaced
    FROM (SELECT step_id, coalesce(response_body, '') AS response_body FROM recorded_step)""")
def page_fields(spark: SparkSession, d: str) -> DataFrame:
    """CSS, XPath and a replaced suffix over recorded pages, all rules on one parse."""
    recorded = table(spark, d, "recorded_step")
    rules = {"heading": "tag.h1@text", "paragraph": "@css:html p@text||tag.div@text", "by_path": "//p/text()", "replaced": "h1@text##[aeiou]##*"}
    return X.extract(recorded, "step_id", "response_body", rules).select("step_id", *(F.coalesce(F.get(c, F.lit(0)), F.lit("")).alias(c) for c in rules))


@query(f"""SELECT doc_id, CAST(len(ps) AS INTEGER) AS paragraphs, CAST(len(ps) - 1 AS INTEGER) AS with_id, regexp_extract(t, '<!-- (.*?) -->', 1) AS source FROM (SELECT doc_id, t, string_split(t, '</p>' || chr(10) || '<p id=') AS ps FROM {PAGES} WHERE t IS NOT NULL)""")
def page_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Elements by tag and by attribute of whole pages, and a comment found by a step chain."""
    rules = {"all": "div.c > p@text", "with_id": "p[id=x]@id", "source": [{"kind": "regexExtract", "pattern": r"<!-- (.*?) -->", "group": 1, "first": True}, {"kind": "fallback", "values": [""]}]}
    found = X.extract(pages(spark, d).filter("t is not null"), "doc_id", "t", rules)
    return found.select("doc_id", F.size("all").alias("paragraphs"), F.size("with_id").alias("with_id"), F.get("source", F.lit(0)).alias("source"))


@query(r"""SELECT export_id, json_extract_string(raw, '$.bookSourceName') AS name, json_extract_string(raw, '$.bookSourceUrl') || '|' || json_extract_string(raw, '$.sourceId') AS joined, json_extract_string(raw, '$.bookSourceUrl') AS either, array_to_string(list_sort(json_keys(raw)), ',') AS names FROM source_export""")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    rules = {"name": "$.bookSourceName", "joined": "$.bookSourceUrl&&$.sourceId", "either": "$.noSuchName||$.bookSourceUrl", "names": "$.keys()"}
    found = X.extract(table(spark, d, "source_export"), "export_id", "raw", rules)
    return found.select("export_id", F.get("name", F.lit(0)).alias("name"), F.array_join("joined", "|").alias("joined"), F.get("either", F.lit(0)).alias("either"), F.array_join("names", ",").alias("names"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events""")
def json_native(spark: SparkSession, d: str) -> DataFrame:
    """A plain path, without leaving the engine."""
    return table(spark, d, "events").select("event_id", F.get(X.json_field(F.col("props"), "k"), F.lit(0)).alias("k"))


@query("""SELECT o_orderkey AS order_key, 3 AS line_count, CAST(o_custkey + o_orderkey % 50 + length(o_orderpriority) AS DOUBLE) AS total, CAST(least(o_custkey, o_orderkey % 50, length(o_orderpriority)) AS DOUBLE) AS least_q, CAST(greatest(o_custkey, o_orderkey % 50, length(o_orderpriority)) AS DOUBLE) AS most_q,
    round((o_custkey + o_orderkey % 50 + length(o_orderpriority)) / 3.0, 6) AS mean, CAST(o_orderstatus = 'F' AND o_custkey > 200 AS INTEGER) AS big_f, CAST((o_orderstatus IN ('O', 'P')) AS INTEGER) + 2 AS kept FROM orders""")
def json_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Filters and aggregates of paths over three entries of each order as a JSON text."""
    o = table(spark, d, "orders")
    line = lambda q, f: F.struct(q.cast("bigint").alias("q"), f.alias("f"))
    lines = F.array(line(F.col("o_custkey"), F.col("o_orderstatus")), line(F.col("o_orderkey") % 50, F.lit("P")), line(F.length("o_orderpriority"), F.lit("O")))
    rules = {"line_count": "$.lines.length()", "total": "$.lines[*].q.sum()", "least_q": "$.lines[*].q.min()", "most_q": "$.lines[*].q.max()", "mean": "$.lines[*].q.avg()", "big_f": "$.lines[?(@.f == 'F' && @.q > 200)].q", "kept": "$.lines[?(@.f in ['O','P'])].q"}
    found = X.extract(o.select(F.col("o_orderkey").alias("order_key"), F.to_json(F.struct(lines.alias("lines"))).alias("j")), "order_key", "j", rules)
    number = lambda c: F.get(c, F.lit(0)).cast("double")
    return found.select("order_key", F.get("line_count", F.lit(0)).cast("int").alias("line_count"), *(number(c).alias(c) for c in ("total", "least_q", "most_q")), F.round(number("mean"), 6).alias("mean"), *(F.size(c).alias(c) for c in ("big_f", "kept")))


@query(r"""SELECT rec_id, field, CASE WHEN regexp_matches(rule, '^(?i)(@css:|@@)') THEN 'css' WHEN regexp_matches(rule, '^(?i)@xpath:') THEN 'xpath' WHEN regexp_matches(rule, '^(?i)@json:') OR rule LIKE '$.%' OR rule LIKE '$[%' THEN 'json' WHEN rule LIKE '/%' THEN 'xpath' ELSE 'css' END AS mode
    FROM (SELECT rec_id, k AS field, trim(json_extract_string(ruleSearch, '$.' || k)) AS rule FROM (SELECT rec_id, ruleSearch, unnest(json_keys(ruleSearch)) AS k FROM corpus_source WHERE json_valid(ruleSearch)))""")
def rule_modes(spark: SparkSession, d: str) -> DataFrame:
    """The language each search rule is written in."""
    fields = table(spark, d, "corpus_source").select("rec_id", F.explode(F.from_json("ruleSearch", "map<string,string>")).alias("field", "rule"))
    r = F.trim("rule")
    low = F.lower(r)
    mode = F.when(low.startswith("@css:") | r.startswith("@@"), "css").when(low.startswith("@xpath:"), "xpath").when(low.startswith("@json:") | r.startswith("$.") | r.startswith("$["), "json").when(r.startswith("/"), "xpath").otherwise("css")
    return fields.select("rec_id", "field", mode.alias("mode"))


@query(r"""SELECT rec_id, trim(regexp_extract(searchUrl, '(?s)\A(.*?)(?:,\s*\{[^{].*)?\z', 1)) AS url, coalesce(nullif(upper(regexp_extract(searchUrl, '[''"]?method[''"]?\s*:\s*[''"]?(\w+)', 1)), ''), 'GET') AS method, CASE WHEN rec_id % 3 = 0 THEN 'result + ' || chr(39) || '&n=' || chr(39) || rec_id END AS script FROM corpus_source WHERE searchUrl IS NOT NULL AND regexp_matches(searchUrl, '\S')""")
def request_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every third rule has a script after it, which is split off."""
    script = F.when(F.col("rec_id") % 3 == 0, F.concat("searchUrl", F.lit("@js:result + '&n='"), F.col("rec_id").cast("string"))).otherwise(F.col("searchUrl"))
    return B.requests(table(spark, d, "corpus_source").withColumn("searchUrl", script), "rec_id", "searchUrl").select("rec_id", "url", "method", "script")


@query(r"""SELECT rec_id, replace(replace(replace(searchUrl, '{{key}}', '%E5%89%91%20x'), '{{page}}', '2'), '{{page-1}}', '1') || CASE rec_id % 4 WHEN 0 THEN '/5/<7,8>' WHEN 1 THEN '/3?1-3' WHEN 2 THEN '/<x>/剑 x' ELSE '' END AS url FROM corpus_source WHERE searchUrl IS NOT NULL""")
def request_urls(spark: SparkSession, d: str) -> DataFrame:
    """Rules with lists of pages, of which the first counts, and with names for the pages around."""
    source = table(spark, d, "corpus_source").filter("searchUrl is not null")
    n = F.col("rec_id") % 4
    more = F.when(n == 0, "/<5,6>/<7,8>").when(n == 1, "/{{pagePlus}}?{{pageMinus}}-<3-9>").when(n == 2, "/<x>/{{keyword}}").otherwise("")
    return source.select("rec_id", B.expand_url(F.concat("searchUrl", more), {"key": "剑 x"}, 2).alias("url"))


@query(r"""WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), c AS (SELECT *, sum(CASE WHEN regexp_matches(l, '^\s*diff --git ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l)
  SELECT doc_id, CAST(n - 1 AS INTEGER) AS chapter_index, max(CASE WHEN regexp_matches(l, '^\s*diff --git ') THEN regexp_replace(l, '^\s+|\s+$', '', 'g') END) AS chapter_title FROM c WHERE n > 0 GROUP BY doc_id, n""")
def chapters_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut at heading lines; what stands before the first is dropped."""
    return B.chapters(table(spark, d, "documents"), "doc_id", "text", pattern=r"^diff --git ").select("doc_id", "chapter_index", "chapter_title")


@query(r"""SELECT doc_id, CAST(i AS INTEGER) AS chapter_index FROM (SELECT doc_id, unnest(range(len(ps))) AS i FROM (SELECT doc_id, list_filter(string_split(text, '@@ -'), lambda p: regexp_matches(p, '[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}\x{1C}-\x{1F}]')) AS ps FROM documents WHERE text <> ''))""")
def chapters_by_marker(spark: SparkSession, d: str) -> DataFrame:
    return B.chapters(table(spark, d, "documents"), "doc_id", "text", marker="@@ -").select("doc_id", "chapter_index")


def _xml(c: str) -> Column:
    plain = F.coalesce(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), F.lit(""))
    return F.replace(F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


_ENTRY = f"coalesce(nullif({TRIM('id')}, ''), nullif({TRIM('link')}, ''), nullif({TRIM('title')}, ''))"


@query(f"""SELECT delivery_id, {_ENTRY} AS id, CASE WHEN {_ENTRY} IS NOT NULL THEN nullif({TRIM('link')}, '') END AS link, CASE WHEN {_ENTRY} IS NOT NULL THEN nullif({TRIM('published_at')}, '') END AS published_at, {_ENTRY} IS NULL AS failed FROM rss_entry""")
def feed_rss(spark: SparkSession, d: str) -> DataFrame:
    """Each delivery written as an RSS feed of one item and read back."""
    e = table(spark, d, "rss_entry")
    xml = F.concat(F.lit("<?xml version='1.0'?><rss version='2.0'><channel><title>f</title><item><title>"), _xml("title"), F.lit("</title><guid>"), _xml("id"), F.lit("</guid><link>"), _xml("link"), F.lit("</link><pubDate>"), _xml("published_at"), F.lit("</pubDate></item></channel></rss>"))
    return B.feed_entries(e.select("delivery_id", xml.alias("x")), "delivery_id", "x").select("delivery_id", "id", "link", "published_at", F.col("error").isNotNull().alias("failed"))


@query(f"""SELECT delivery_id, {_ENTRY} AS id, CASE WHEN {_ENTRY} IS NOT NULL THEN nullif(link, '') END AS link FROM rss_entry""")
def feed_atom(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "rss_entry")
    link = F.when(F.coalesce("link", F.lit("")) != "", F.concat(F.lit("<link rel='alternate' href='"), F.replace(_xml("link"), F.lit("'"), F.lit("&apos;")), F.lit("'/>"))).otherwise("")
    xml = F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><title>f</title><entry><title>"), _xml("title"), F.lit("</title><id>"), _xml("id"), F.lit("</id>"), link, F.lit("</entry></feed>"))
    return B.feed_entries(e.select("delivery_id", xml.alias("x")), "delivery_id", "x").select("delivery_id", "id", "link")


@query("""SELECT delivery_id, coalesce(nullif(id, ''), nullif(title, '')) AS id, CASE WHEN coalesce(nullif(id, ''), nullif(title, '')) IS NOT NULL THEN title END AS title, CASE WHEN coalesce(nullif(id, ''), nullif(title, '')) IS NOT NULL THEN published_at END AS published_at FROM rss_entry""")
def feed_json(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "rss_entry")
    text = F.to_json(F.struct(F.lit("f").alias("title"), F.array(F.struct(F.col("id"), F.col("title"), F.col("published_at").alias("date_published"))).alias("items")))
    return B.feed_entries(e.select("delivery_id", text.alias("x")), "delivery_id", "x").select("delivery_id", "id", "title", "published_at")


@query(r"""SELECT delivery_id, CAST(i AS INTEGER) AS pos, nullif(trim(regexp_replace(p, '<[^>]*>', '', 'g')), '') AS title, nullif(regexp_extract(p, '<b>([^<]*)</b>', 1), '') AS bold, 'https://x.test/0' AS url
    FROM (SELECT delivery_id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM (SELECT delivery_id, regexp_extract_all(summary, '(?s)<p>(.*?)</p>', 1) AS ps FROM rss_entry))""")
def item_fields(spark: SparkSession, d: str) -> DataFrame:
    """A list rule and the fields of its items over all summaries; those without a paragraph give no item."""
    return X.items(table(spark, d, "rss_entry"), "delivery_id", "summary", "tag.p", {"title": "tag.p", "bold": "b@text", "url": "https://x.test/{{n}}"}, {"n": "0"})


@query("""SELECT series_id AS key, CAST(row_number() OVER (PARTITION BY series_id ORDER BY first_at, file_no) - 1 AS INTEGER) AS step, CAST(file_no AS VARCHAR) AS url FROM (SELECT series_id, file_no, min(exported_at) AS first_at FROM source_export GROUP BY 1, 2)""")
def page_walk(spark: SparkSession, d: str) -> DataFrame:
    """Each series followed from its first file along links to the next."""
    from pyspark.sql import Window

    f = table(spark, d, "source_export").groupBy("series_id", "file_no").agg(F.min("exported_at").alias("at"))
    w = Window.partitionBy("series_id").orderBy("at", "file_no")
    f = stage(f.select(F.col("series_id").alias("key"), F.col("file_no").cast("string").alias("url"), F.lead("file_no").over(w).cast("string").alias("next_url"), F.row_number().over(w).alias("n")), "page-links")
    return X.follow_pages(f.filter("n = 1").select("key", "url"), f.select("url", "next_url"))


# ---- normalisation in Python stages ---------------------------------------------------------------


@query(r"""SELECT doc_id, md5(x) AS digest, CAST(length(x) AS INTEGER) AS n_chars FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(t), '\A\x{FEFF}', ''), '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\A\n+|\n+\z', '', 'g') AS x FROM """ + DIRTY + ")")
def text_unicode_form(spark: SparkSession, d: str) -> DataFrame:
    """The composed form of all documents, with marks, line ends and empty lines put in order."""
    n = N.normalise_texts(dirty(spark, d), "doc_id", "t", form="NFC")
    return n.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"), "n_chars")


@query()
def chapter_documents(spark: SparkSession, d: str) -> DataFrame:
    """Commits as chapters of their repository, under the first line of their message."""
    t = table(spark, d, "documents").select("doc_id", "repo", F.substring_index("text", "\n", 1).alias("title"), "text")
    return N.chapter_documents(t, "doc_id", "repo", "title", "text").select("doc_id", F.size("paragraphs").alias("paragraphs"), "char_len", "fingerprint", "valid")


_PAD = lambda x: bytes(b ^ x for b in b"key".ljust(64, bytes(1))).hex()


@query(f"""SELECT rec_id, sha256(unhex('{_PAD(0x5C)}') || unhex(sha256(unhex('{_PAD(0x36)}') || encode(bookSourceName)))) AS digest FROM corpus_source""")
def codec_hmac(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_source").select("rec_id", T.hmac_digest(F.col("bookSourceName"), "key").alias("digest"))


@query(f"""WITH {_FORMS} SELECT form, count(*) AS rules, count(DISTINCT rec_id) AS sources, count(DISTINCT rec_id) FILTER (enabled) AS enabled_sources, count(DISTINCT bookSourceType) AS types FROM l GROUP BY 1""")
def rule_form_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many rules and sources use each form."""
    own = F.when(F.col("enabled"), F.col("rec_id"))
    return _forms(spark, d).groupBy("form").agg(F.count("*").alias("rules"), F.countDistinct("rec_id").alias("sources"), F.countDistinct(own).alias("enabled_sources"), F.countDistinct("bookSourceType").alias("types"))


@query("""SELECT subscription_id, count(*) AS entries, count(*) FILTER (NOT coalesce(e.read_flag, FALSE)) AS unread FROM (SELECT subscription_id, summary IS NOT NULL AS read_flag FROM rss_entry) e GROUP BY 1""")
def feed_unread(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "rss_entry").select("subscription_id", F.col("summary").isNotNull().alias("read"))
    return unread_counts(e, "subscription_id")


@query("""SELECT rec_id, (SELECT string_agg(k || '=' || v, '&' ORDER BY k) FROM (VALUES ('name', bookSourceName), ('type', CAST(bookSourceType AS VARCHAR)), ('url', bookSourceUrl)) p(k, v) WHERE v IS NOT NULL AND v <> '') AS payload FROM corpus_source""")
def codec_sign(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("url"), F.col("bookSourceUrl"), F.lit("name"), F.col("bookSourceName"), F.lit("type"), F.col("bookSourceType").cast("string"))
    return table(spark, d, "corpus_source").select("rec_id", T.sign_payload(m).alias("payload"))


# ---- more of the rule engine ---------------------------------------------------------------------

#: A page for every step, null where nothing was recorded: as many entries (0 to 3) as its number says.
_BOOKS_OF = """p AS (SELECT step_id, keyword, CASE WHEN response_body IS NULL THEN 0 ELSE CAST(step_id % 4 AS INT) END AS n, response_body IS NULL AS gone FROM recorded_step),
  k AS (SELECT step_id, keyword, n, gone, list_transform(range(n), lambda k: 'Book ' || (step_id * 10 + k)) AS book, list_transform(range(n), lambda k: (step_id % 7 + k) || ' kB') AS size, list_transform(range(n), lambda k: '/b/' || (step_id * 10 + k)) AS href FROM p)"""


def listed_pages(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("step_id")
    places = F.when(n % 4 > 0, F.sequence(F.lit(0), (n % 4).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    text = lambda c: c.cast("string")
    item = lambda k: F.concat(F.lit('<li class="i'), F.when(k == 0, " first").otherwise(""), F.lit('" data-k="'), text(k), F.lit('"><a href="/b/'), text(n * 10 + k), F.lit('">Book '), text(n * 10 + k), F.lit("</a> <span>"), text(n % 7 + k), F.lit(" kB</span></li>"))
    page = F.concat(F.lit("<html><body><h1>List</h1><ul>"), F.array_join(F.transform(places, item), ""), F.lit("</ul><p>for "), "keyword", F.lit("</p></body></html>"))
    return table(spark, d, "recorded_step").select("step_id", F.when(F.col("response_body").isNotNull(), page).alias("page"))


def _pages_by_rules(spark: SparkSession, d: str, rules: dict) -> DataFrame:
    return X.extract(listed_pages(spark, d), "step_id", "page", rules).select("step_id", *(F.array_join(c, "|").alias(c) for c in rules))


def _of(**columns: str) -> str:
    return f"WITH {_BOOKS_OF} SELECT step_id, " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + " FROM k"


_JOIN = "array_to_string({}, '|')".format
_KW = "CASE WHEN gone THEN '' ELSE 'for ' || keyword END"


@query(_of(either=f"CASE WHEN n > 0 THEN {_JOIN('book')} ELSE {_KW} END", both_parts=f"CASE WHEN gone THEN '' ELSE {_JOIN(f'list_append(href, {_KW})')} END", mixed=_JOIN("flatten(list_transform(range(n), lambda j: [book[j + 1], size[j + 1]]))")))
def rule_combinators(spark: SparkSession, d: str) -> DataFrame:
    """The first branch with a result, all branches, and branches in turn."""
    return _pages_by_rules(spark, d, {"either": "tag.h2@text||class.i@tag.a@text||tag.p@text", "both_parts": "class.i@tag.a@href&&tag.p@text", "mixed": "class.i@tag.a@text%%class.i@tag.span@text"})


@query(_of(every=_JOIN("list_transform(size, lambda x: regexp_replace(x, '[0-9]+', 'N', 'g'))"), first_only=_JOIN("list_transform(book, lambda x: regexp_extract(x, 'k (.)', 1) || '!')"), no_match=_JOIN("list_transform(book, lambda x: CASE WHEN regexp_matches(x, '7{2}') THEN 'x' ELSE '' END)"), literal=_JOIN("list_transform(book, lambda x: replace(x, ' ', '_'))")))
def rule_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """What follows ##: every match, the first match alone, a match that most haven't, and a mark."""
    return _pages_by_rules(spark, d, {"every": "tag.span@text##[0-9]+##N", "first_only": "tag.a@text##k (.)##$1!###", "no_match": "tag.a@text##7{2}##x###", "literal": "tag.a@text## ##_"})


@query(_of(saved="CASE WHEN n > 0 THEN book[1] ELSE '' END", scripted=_JOIN("list_transform(book, lambda x: upper(x) || '/' || length(x))"), between=_JOIN("list_transform(href, lambda x: x || '?from=list')"), unsupported="''", chained=f"CASE WHEN gone THEN '' WHEN n > 0 THEN {_JOIN('list_transform(book, lambda x: x[6:])')} ELSE 'none' END", referred=_JOIN(r"list_transform(book, lambda x: regexp_replace(x, '^(\w+) (\d+)', '\2 \1'))")))
def rule_variables(spark: SparkSession, d: str) -> DataFrame:
    """A value put aside and taken again, scripts, a selector between them, a script that the language
    hasn't, and step chains with groups, fallbacks and references."""
    chain = [{"kind": "css", "selector": "li a"}, {"kind": "regexExtract", "pattern": r"^Book (?P<n>.+)$", "group": "n", "first": True}, {"kind": "fallback", "values": ["none"]}]
    swapped = [{"kind": "xPath", "expression": "//li/a"}, {"kind": "regexReplace", "pattern": r"^(\w+) (\d+)", "replacement": "$2 $1"}]
    rules = {
        "saved": "@put:{\"h\":\"//li[1]/a/text()\"}//a[.='@get:{h}']/text()", "scripted": "tag.a@text<js>result.toUpperCase() + '/' + result.length</js>", "between": "tag.li@html<js>result.trim()</js>tag.a@href<js>result + '?from=' + 'LIST'.toLowerCase()</js>",
        "unsupported": "tag.a@text@js:java.ajax(result)", "chained": chain, "referred": swapped,
    }
    return _pages_by_rules(spark, d, rules)


@query(_of(by_contains=_JOIN("list_filter(book, lambda x: contains(x, '7'))"), by_place="CASE WHEN n > 1 THEN book[2] ELSE '' END", from_end="CASE WHEN n > 0 THEN href[n] ELSE '' END", by_next=_JOIN("book[2:]"), by_not=_JOIN("book[2:]"), less=_JOIN("book[1:2]"), having=_JOIN("book"), attribute=_JOIN("list_transform(range(n), lambda j: CAST(j AS VARCHAR))"), own_text=_JOIN("list_filter(size, lambda x: x LIKE '3%')")))
def css_filters(spark: SparkSession, d: str) -> DataFrame:
    """Selectors with filters by text, by place among those found, by neighbour, by negation and by what
    they hold."""
    rules = {"by_contains": "a:contains(7)@text", "by_place": "class.i.1@tag.a@text", "from_end": "class.i.-1@a@href", "by_next": "li + li a@text", "by_not": "li:not(.first) a@text", "less": "a:lt(2)@text", "having": "li:has(span) a@text", "attribute": "class.i@data-k", "own_text": "span:matchesOwn(^3)@text"}
    return _pages_by_rules(spark, d, rules)


@query(_of(by_place="CASE WHEN n > 1 THEN book[2] ELSE '' END", by_sibling=_JOIN("book[2:]"), counted="CASE WHEN gone THEN '' ELSE CAST(n AS VARCHAR) END", by_function=_KW, united=f"CASE WHEN gone THEN '' ELSE {_JOIN("list_prepend('List', href)")} END", last="CASE WHEN n > 0 THEN href[n] ELSE '' END", by_attribute="CASE WHEN n > 2 THEN size[3] ELSE '' END"))
def xpath_pages(spark: SparkSession, d: str) -> DataFrame:
    rules = {"by_place": "//li[2]/a/text()", "by_sibling": "//li/following-sibling::li/a/text()", "counted": "@XPath:count(//li)", "by_function": "@XPath:normalize-space(//p)", "united": "//h1/text() | //a/@href", "last": "//li[last()]/a/@href", "by_attribute": "//li[@data-k='2']/span/text()"}
    return _pages_by_rules(spark, d, rules)


@query("""SELECT export_id, CAST(len(json_keys(raw)) AS VARCHAR) AS n_fields, CAST(length(json_extract_string(raw, '$.bookSourceName')) AS VARCHAR) AS name_length, json_extract_string(raw, '$.bookSourceName') || '/' || json_extract_string(raw, '$.sourceId') AS joined, json_extract_string(raw, '$.sourceId') || ' (id)' AS templated, '' AS missing FROM source_export""")
def json_functions(spark: SparkSession, d: str) -> DataFrame:
    rules = {"n_fields": "$.length()", "name_length": "$.bookSourceName.length()", "joined": "$.bookSourceName.concat('/', $.sourceId)", "templated": "{$.sourceId} (id)", "missing": "$.a.b[3]..c"}
    found = X.extract(table(spark, d, "source_export"), "export_id", "raw", {k: [{"kind": "jsonPath", "path": v}] if k == "templated" else v for k, v in rules.items()})
    return found.select("export_id", *(F.array_join(c, "|").alias(c) for c in rules))


@query(r"""SELECT rec_id, CASE WHEN s = '' THEN f ELSE s END AS slug FROM (SELECT rec_id, regexp_replace(regexp_replace(lower(bookSourceName), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s, """ + _FNV.format(x="bookSourceName") + """ AS f FROM corpus_source)""")
def text_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_source").select("rec_id", T.slug(F.col("bookSourceName")).alias("slug"))


@query("""SELECT rec_id, coalesce(o.title, b.title) AS title, coalesce(o.url, b.url) AS url FROM (SELECT rec_id, bookSourceName AS title, bookSourceUrl AS url FROM corpus_source) b LEFT JOIN (SELECT rec_id, CASE WHEN rec_id % 2 = 0 THEN upper(bookSourceName) END AS title, bookSourceComment AS url FROM corpus_source) o USING (rec_id)""")
def detail_merge(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a base row overwritten where a second page had a value."""
    s = table(spark, d, "corpus_source")
    base = s.select("rec_id", F.col("bookSourceName").alias("title"), F.col("bookSourceUrl").alias("url"))
    found = s.select("rec_id", F.when(F.col("rec_id") % 2 == 0, F.upper("bookSourceName")).alias("title"), F.col("bookSourceComment").alias("url"))
    return X.merge_fields(base, found, "rec_id", ["title", "url"])


@query("""SELECT delivery_id, CAST(i AS INTEGER) AS pair_index, v[2 * i + 1] AS title, v[2 * i + 2] AS url FROM (SELECT delivery_id, v, unnest(range(len(v) // 2)) AS i FROM (SELECT delivery_id, list_filter([title, link, summary, published_at, author], lambda x: x IS NOT NULL) AS v FROM rss_subscription_item))""")
def toc_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Flat lists of title and url as numbered pairs; an odd last value is dropped."""
    v = F.filter(F.array("title", "link", "summary", "published_at", "author"), lambda x: x.isNotNull())
    p = table(spark, d, "rss_subscription_item").select("delivery_id", F.explode(X.flat_pairs(v)).alias("p"))
    return p.select("delivery_id", F.col("p.index").alias("pair_index"), F.col("p.title").alias("title"), F.col("p.url").alias("url"))


# ---- more of the tables ---------------------------------------------------------------------------


@query("""SELECT rec_id, CASE WHEN lower(regexp_extract(u, '[.]([A-Za-z0-9]+)$', 1)) <> '' THEN lower(regexp_extract(u, '[.]([A-Za-z0-9]+)$', 1)) END AS ext FROM (SELECT delivery_id AS rec_id, regexp_replace(link, '[?#].*$', '') AS u FROM rss_entry)""")
def link_extension(spark: SparkSession, d: str) -> DataFrame:
    u = F.regexp_replace("link", r"[?#].*$", "")
    """What follows the last dot of every link, null where that is no extension or there is no link."""
    return table(spark, d, "rss_entry").select(F.col("delivery_id").alias("rec_id"), T.extension(F.regexp_extract(u, r"([.][A-Za-z0-9]+)$", 1)).alias("ext"))


@query("""SELECT subscription_id, min(first_seen_at) AS first_seen, max(first_seen_at) AS last_seen, count(DISTINCT id) AS ids, count(*) - count(id) AS without_id FROM rss_entry GROUP BY 1""")
def feed_state(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rss_entry").groupBy("subscription_id").agg(F.min("first_seen_at").alias("first_seen"), F.max("first_seen_at").alias("last_seen"), F.countDistinct("id").alias("ids"), (F.count("*") - F.count("id")).alias("without_id"))


@query("""SELECT e.delivery_id FROM rss_entry e WHERE NOT EXISTS (SELECT 1 FROM rss_entry k WHERE k.subscription_id = e.subscription_id AND k.id = e.id AND k.batch_id < e.batch_id)""")
def feed_new_entries(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of the batch in which their entry first came: a refresh of every batch against those before."""
    e = table(spark, d, "rss_entry").select("delivery_id", "subscription_id", "id", "batch_id")
    first = e.filter("id is not null").groupBy("subscription_id", "id").agg(F.min("batch_id").alias("first_batch"))
    return e.join(first, ["subscription_id", "id"], "left").filter("first_batch is null or batch_id = first_batch").select("delivery_id")


@query("""SELECT o.o_orderkey AS book_key, o.o_orderpriority AS source_id, coalesce(c.n, 0) AS cached, 3 + o.o_custkey % 6 AS total, round(coalesce(c.n, 0) / (3 + o.o_custkey % 6), 6) AS share FROM orders o LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) c ON c.l_orderkey = o.o_orderkey""")
def cache_ratio(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_linenumber").alias("n"))
    total = 3 + F.col("o_custkey") % 6
    cached = F.coalesce("n", F.lit(0))
    return table(spark, d, "orders").join(n, "o_orderkey", "left").select(F.col("o_orderkey").alias("book_key"), F.col("o_orderpriority").alias("source_id"), cached.alias("cached"), total.alias("total"), F.round(E.cached_share(cached, total), 6).alias("share"))


@query(f"""WITH {_VERSION} SELECT n.file_no, count(*) AS entries, count(*) FILTER (o.url IS NULL) AS added FROM neu n LEFT JOIN (SELECT DISTINCT file_no, url FROM old) o ON o.file_no = n.file_no AND o.url = n.url GROUP BY 1""")
def update_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per file how many entries it has and how many the file before had not."""
    old, new = versions(spark, d)
    return E.update_counts(new, old, ["file_no"], "url")


@query("""SELECT source_id, level, count(*) AS steps, count(*) FILTER (response_status = 200) AS passed, count(DISTINCT url) AS urls, max(response_status) AS worst FROM recorded_step GROUP BY 1, 2""")
def run_steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "recorded_step").groupBy("source_id", "level").agg(F.count("*").alias("steps"), F.count_if(F.col("response_status") == 200).alias("passed"), F.countDistinct("url").alias("urls"), F.max("response_status").alias("worst"))


@query("""SELECT s.sourceId AS source_id FROM corpus_source s WHERE NOT EXISTS (SELECT 1 FROM recorded_step r WHERE r.source_id = s.sourceId)""")
def run_missing_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources without a recorded run."""
    return R.missing_sources(table(spark, d, "corpus_source").select(F.col("sourceId").alias("source_id")), table(spark, d, "recorded_step"), "source_id")


@query("""SELECT CASE WHEN response_status = 200 THEN 'ok' WHEN response_status = 404 THEN 'missing' WHEN response_status BETWEEN 300 AND 399 THEN 'moved' WHEN response_status BETWEEN 400 AND 499 THEN 'refused' ELSE 'failed' END AS reason, level, count(*) AS steps FROM recorded_step GROUP BY 1, 2""")
def run_reasons(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("response_status")
    reason = F.when(s == 200, "ok").when(s == 404, "missing").when(s.between(300, 399), "moved").when(s.between(400, 499), "refused").otherwise("failed")
    return table(spark, d, "recorded_step").groupBy(reason.alias("reason"), "level").agg(F.count("*").alias("steps"))


@query(r"""SELECT doc_id, CAST(count(*) FILTER (regexp_matches(l, '^第[0-9]+章|^(?i)chapter\s')) AS INTEGER) AS headings FROM (SELECT doc_id, unnest(string_split(CASE WHEN doc_id % 2 = 0 THEN '第' || doc_id || '章 x' || chr(10) || 'body' ELSE 'no' END, chr(10))) AS l FROM documents) GROUP BY 1""")
def chapters_by_heading(spark: SparkSession, d: str) -> DataFrame:
    """Usual headings recognised in texts written from every document's number."""
    n = F.col("doc_id").cast("string")
    t = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("第"), n, F.lit("章 x\nbody"))).otherwise("no").alias("t"))
    c = B.chapters(t, "doc_id", "t")
    return c.groupBy("doc_id").agg(F.count_if(F.col("chapter_title") != "正文").cast("int").alias("headings"))


@query("""SELECT doc_id, '第' || doc_id || '章' AS chapter_title FROM documents""")
def chapters_renumbered(spark: SparkSession, d: str) -> DataFrame:
    """Numerals of either script in headings as digits."""
    digits = F.translate(F.col("doc_id").cast("string"), "0123456789", "零一二三四五六七八九")
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit("第"), digits, F.lit("章\nbody")).alias("t"))
    return B.chapters(t, "doc_id", "t", renumber=True).select("doc_id", "chapter_title")
