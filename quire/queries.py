"""Queries of the general problems, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import deliveries, drift, instants, packed
from quire.session import shared_dir, table
from quire.store import kept_dir

Query = Callable[[SparkSession, str], DataFrame]

PACKED = {"bookSourceGroup": "list", "exploreUrl": "entries"}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.split_packed(table(spark, d, "corpus_source"), "rec_id", PACKED)


def stated_instants(spark: SparkSession, d: str) -> DataFrame:
    """All raw values of the three fields with their zone and the order of slashed dates."""
    step = table(spark, d, "recorded_step")
    header = F.filter(F.map_entries("response_headers"), lambda e: F.lower(F.trim(e["key"])) == "date")
    dates = step.select(F.lit("response_headers.date").alias("field_name"), F.col("step_id").alias("row_key"), F.get(header, F.lit(0))["value"].alias("raw"), F.lit("UTC").alias("zone_name"), F.lit(True).alias("day_first"))
    entry, feed = table(spark, d, "rss_entry"), table(spark, d, "feed_profile")
    # feed_profile is a fixed table; whether it is broadcast is left to the engine, which checks its size
    published = entry.join(feed, "subscription_id", "left").select(F.lit("published_at").alias("field_name"), F.col("delivery_id").alias("row_key"), F.col("published_at").alias("raw"), "zone_name", "day_first")
    source = table(spark, d, "corpus_source")
    updated = source.select(F.lit("lastUpdateTime").alias("field_name"), F.col("rec_id").alias("row_key"), F.col("lastUpdateTime").cast("string").alias("raw"), F.lit("UTC").alias("zone_name"), F.lit(True).alias("day_first"))
    return dates.unionByName(published).unionByName(updated)


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """The list field alone."""
    return packed.split_packed(table(spark, d, "corpus_source"), "rec_id", {"bookSourceGroup": "list"})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Values met in earlier runs are in the kept dictionary; only others are parsed."""
    return instants.normalise_instants(stated_instants(spark, d), kept_dir(spark, "instants"))


def p3_batches(spark: SparkSession, d: str) -> DataFrame:
    """The feed's dates first, then those of all three fields: the second run parses what is new."""
    rows, path = stated_instants(spark, d), f"{shared_dir(spark)}/quire/instants-{uuid.uuid4().hex}"
    instants.extend_dictionary(rows.filter("field_name = 'published_at' and length(trim(raw)) > 0").select(*instants.KEY).dropna(), path)
    return instants.normalise_instants(rows, path)


def p3_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Update times alone: numbers, whatever they count or spell."""
    return instants.normalise_instants(stated_instants(spark, d).filter("field_name = 'lastUpdateTime'"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "source_export")).changes


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    export = table(spark, d, "source_export")
    out = drift.consistent_table(export, drift.schema_changes(export), ["export_id", "series_id", "file_no", "line_no"])
    return out.withColumn("unfit", F.to_json("unfit"))


def p5_versions(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "source_export")).versions


def p5_steps(spark: SparkSession, d: str) -> DataFrame:
    return drift.migration_steps(drift.schema_changes(table(spark, d, "source_export")))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Every step of migration, and every cast that failed, by file and field."""
    export = table(spark, d, "source_export")
    found = drift.schema_changes(export)
    route = drift.routes(found)
    return drift.migration_report(drift.consistent_table(export, found, ["file_no"], route=route), drift.migration_steps(found, route))


MESSAGES = {"rss_entry": ["subscription_id", "id"], "rss_subscription_item": ["source_id", "link"]}


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    out = [deliveries.repeats(table(spark, d, t), keys, ["first_seen_at", "delivery_id"], "delivery_id").select(F.lit(t).alias("table_name"), "delivery_id") for t, keys in MESSAGES.items()]
    return out[0].unionByName(out[1])


def p7_batches(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries admitted in two batches, by the middle of their arrival times, against a store."""
    entry, keys, order = table(spark, d, "rss_entry"), MESSAGES["rss_entry"], ["first_seen_at", "delivery_id"]
    store = f"{shared_dir(spark)}/quire/deliveries-{uuid.uuid4().hex}"
    low, high = entry.agg(F.min("first_seen_at"), F.max("first_seen_at")).first()
    early = F.col("first_seen_at") < ((low or 0) + (high or 0)) // 2
    out = [deliveries.admit(entry.filter(c), name, store, keys, order) for name, c in (("batch-1", early), ("batch-2", ~early))]
    return out[0].unionByName(out[1]).select("delivery_id", "subscription_id", "id", "first_seen_at")


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    return deliveries.deduplicate(table(spark, d, "rss_entry"), MESSAGES["rss_entry"], ["first_seen_at", "delivery_id"])


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_groups": p1_groups, "p3_found": p3_found, "p3_batches": p3_batches, "p3_numbers": p3_numbers, "p5_found": p5_found, "p5_table": p5_table, "p5_versions": p5_versions, "p5_steps": p5_steps, "p5_report": p5_report, "p7_found": p7_found, "p7_kept": p7_kept, "p7_batches": p7_batches}

SQL: dict[str, str] = {
    "p7_found": """
        SELECT 'rss_entry' AS table_name, delivery_id FROM (
          SELECT delivery_id, row_number() OVER (PARTITION BY subscription_id, id ORDER BY first_seen_at, delivery_id) AS n
          FROM rss_entry WHERE id IS NOT NULL AND id <> '' AND subscription_id IS NOT NULL AND subscription_id <> '') WHERE n > 1
        UNION ALL
        SELECT 'rss_subscription_item', delivery_id FROM (
          SELECT delivery_id, row_number() OVER (PARTITION BY source_id, link ORDER BY first_seen_at, delivery_id) AS n
          FROM rss_subscription_item WHERE link IS NOT NULL AND link <> '' AND source_id IS NOT NULL AND source_id <> '') WHERE n > 1""",
    "p7_kept": """
        SELECT * EXCLUDE (n) FROM (
          SELECT *, CASE WHEN id IS NULL OR id = '' OR subscription_id IS NULL OR subscription_id = '' THEN 1
                    ELSE row_number() OVER (PARTITION BY subscription_id, id ORDER BY first_seen_at, delivery_id) END AS n
          FROM rss_entry) WHERE n = 1""",
}

_DRIFT = """
        WITH v AS (SELECT series_id, file_no, lag(file_no) OVER (PARTITION BY series_id ORDER BY first_at, file_no) AS prev_no, first_at
                   FROM (SELECT series_id, file_no, min(exported_at) AS first_at FROM source_export GROUP BY 1, 2)),
        c AS (SELECT series_id, file_no, json_extract_string(raw, '$.sourceId') AS rec, k AS field, json_extract(raw, '$.' || k)::VARCHAR AS val,
                CASE json_type(raw, '$.' || k) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind
              FROM (SELECT *, unnest(json_keys(raw)) AS k FROM source_export)),
        f AS (SELECT DISTINCT series_id, file_no, field, kind FROM c WHERE kind IS NOT NULL),
        j AS (SELECT coalesce(o.file_no, n.file_no) AS file_no, coalesce(o.prev_no, n.prev_no) AS prev_no, coalesce(o.series_id, n.series_id) AS series_id, coalesce(o.field, n.field) AS field, o.kind AS old_kind, n.kind AS new_kind
              FROM (SELECT v.series_id, v.file_no, v.prev_no, f.field, f.kind FROM v JOIN f ON f.series_id = v.series_id AND f.file_no = v.prev_no) o
              FULL JOIN (SELECT v.series_id, v.file_no, v.prev_no, f.field, f.kind FROM v JOIN f ON f.series_id = v.series_id AND f.file_no = v.file_no WHERE v.prev_no IS NOT NULL) n
              ON o.file_no = n.file_no AND o.field = n.field),
        r AS (SELECT DISTINCT series_id, file_no, rec FROM c),
        b AS (SELECT v.series_id, v.file_no, v.prev_no, x.rec FROM v JOIN r x ON x.series_id = v.series_id AND x.file_no = v.file_no JOIN r y ON y.series_id = v.series_id AND y.file_no = v.prev_no AND y.rec = x.rec),
        p AS (SELECT file_no, side, field, kind, proof, row_number() OVER (PARTITION BY file_no, side, kind, proof ORDER BY field) AS turn FROM (
              SELECT j.file_no, CASE WHEN j.new_kind IS NULL THEN 'old' ELSE 'new' END AS side, j.field, coalesce(j.old_kind, j.new_kind) AS kind, string_agg(DISTINCT b.rec || '=' || c.val, '|' ORDER BY b.rec || '=' || c.val) AS proof
              FROM j JOIN b ON b.file_no = j.file_no JOIN c ON c.series_id = j.series_id AND c.rec = b.rec AND c.field = j.field AND c.kind IS NOT NULL AND c.file_no = CASE WHEN j.new_kind IS NULL THEN j.prev_no ELSE j.file_no END
              WHERE j.old_kind IS NULL OR j.new_kind IS NULL GROUP BY 1, 2, 3, 4)),
        m AS (SELECT o.file_no, o.field AS old_field, n.field AS new_field FROM p o JOIN p n ON o.file_no = n.file_no AND o.kind = n.kind AND o.proof = n.proof AND o.turn = n.turn AND o.side = 'old' AND n.side = 'new')"""
_CHANGES = """
        SELECT file_no, 'renamed' AS change_kind, old_field, new_field FROM m
        UNION ALL SELECT file_no, 'retyped', field, field FROM j WHERE old_kind <> new_kind
        UNION ALL SELECT file_no, 'removed', field, '' FROM j WHERE new_kind IS NULL AND NOT EXISTS (SELECT 1 FROM m WHERE m.file_no = j.file_no AND m.old_field = j.field)
        UNION ALL SELECT file_no, 'added', '', field FROM j WHERE old_kind IS NULL AND NOT EXISTS (SELECT 1 FROM m WHERE m.file_no = j.file_no AND m.new_field = j.field)"""
_PRINTS = """
        , k AS (SELECT series_id, file_no, field, string_agg(kind, '|' ORDER BY kind) AS kind FROM f GROUP BY 1, 2, 3),
        g AS (SELECT v.series_id, v.file_no, v.prev_no, v.first_at, md5(coalesce(string_agg(k.field || chr(31) || k.kind, chr(30) ORDER BY k.field), '')) AS fingerprint FROM v LEFT JOIN k USING (series_id, file_no) GROUP BY 1, 2, 3, 4),
        s AS (SELECT *, CASE WHEN fingerprint = lag(fingerprint) OVER (PARTITION BY series_id ORDER BY first_at, file_no) THEN 0 ELSE 1 END AS new FROM g),
        n AS (SELECT series_id, file_no, prev_no, CAST(sum(new) OVER (PARTITION BY series_id ORDER BY first_at, file_no) AS BIGINT) AS version, fingerprint FROM s)"""
#: Spellings of one field that renamings connect; the first is its column. Other fields are spelled one way.
_SPELLINGS = {
    "bookSourceComment": ["book_source_comment"], "bookUrlPattern": ["book_url_pattern", "bookurlpattern"], "concurrentRate": ["requestRate", "concurrent_rate"],
    "exploreScreen": ["exploreFilter", "screen"], "searchUrl": ["searchAddress", "search_url"],
}
_COLUMNS = {
    "string": ["bookSourceComment", "bookSourceName", "bookSourceUrl", "bookUrlPattern", "charset", "concurrentRate", "coverDecode", "exploreScreen", "header", "jsLib", "loginUrl", "rateLimit", "requestHeader", "searchUrl", "sourceId"],
    "BIGINT": ["bookSourceType", "customOrder", "lastUpdateTime", "weight"],
    "BOOLEAN": ["enabled"],
}


def _column(name: str, kind: str) -> str:
    value = "coalesce(" + ", ".join(f"json_extract_string(raw, '$.{n}')" for n in [name, *_SPELLINGS.get(name, [])]) + ")"
    return f"{value if kind == 'string' else f'CAST({value} AS {kind})'} AS {name}"


SQL |= {
    "p5_found": _DRIFT + _CHANGES,
    "p5_versions": _DRIFT + _PRINTS + " SELECT * FROM n",
    "p5_steps": _DRIFT + _PRINTS + f""", a AS ({_CHANGES}),
        e AS (SELECT unnest(map_keys(w)) AS old_name, unnest(map_values(w)) AS column_name FROM (SELECT MAP {{{", ".join(f"'{o}': '{c}'" for c, x in _SPELLINGS.items() for o in x)}}} AS w))
        SELECT n.series_id, n.version, n.file_no, CASE change_kind WHEN 'renamed' THEN 'rename' WHEN 'added' THEN 'default' WHEN 'removed' THEN 'retire' ELSE 'cast' END AS rule,
          CASE change_kind WHEN 'added' THEN new_field ELSE old_field END AS field, CASE change_kind WHEN 'renamed' THEN new_field WHEN 'retyped' THEN coalesce(e.column_name, new_field) ELSE '' END AS target
        FROM a JOIN n USING (file_no) LEFT JOIN e ON a.new_field = e.old_name
        UNION ALL SELECT x.series_id, x.version, x.file_no, 'rename', e.old_name, e.column_name
        FROM (SELECT k.series_id, k.file_no, k.field, n.version, row_number() OVER (PARTITION BY k.series_id, k.field ORDER BY v.first_at, k.file_no) AS nth FROM k JOIN n USING (series_id, file_no) JOIN v USING (series_id, file_no)) x JOIN e ON x.field = e.old_name
        WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM a WHERE a.file_no = x.file_no AND a.change_kind = 'renamed' AND a.new_field = x.field)""",
    "p5_table": "SELECT export_id, series_id, file_no, line_no, " + ", ".join(_column(n, k) for k, names in _COLUMNS.items() for n in names) + ", CAST(NULL AS VARCHAR) AS unfit FROM source_export",
}
SQL["p5_report"] = f"SELECT file_no, rule, field, target, 1::BIGINT AS n FROM ({SQL['p5_steps']})"  # no cast fails there

SQL["p7_batches"] = f"SELECT delivery_id, subscription_id, id, first_seen_at FROM ({SQL['p7_kept']})"
SQL["p3_numbers"] = """
    WITH a AS (SELECT rec_id, lastUpdateTime AS n, CAST(lastUpdateTime AS VARCHAR) AS t FROM corpus_source WHERE lastUpdateTime >= 0),
    b AS (SELECT rec_id, list_filter([n * 1000::HUGEINT, n::HUGEINT, (n // 1000)::HUGEINT, (n // 1000000)::HUGEINT,
      epoch_ms(CASE length(t) WHEN 14 THEN try_strptime(t, '%Y%m%d%H%M%S') WHEN 12 THEN try_strptime(t, '%Y%m%d%H%M') WHEN 8 THEN try_strptime(t, '%Y%m%d') END)::HUGEINT], lambda x: x >= 1420070400000 AND x < 1830297600000) AS ms FROM a)
    SELECT 'lastUpdateTime' AS field_name, rec_id AS row_key, CAST(ms[1] AS BIGINT) AS epoch_ms FROM b WHERE len(ms) > 0"""

_SEP = r",，、､;；|｜/／&＆\t\n\x{0B}\x{0C}\r\x{85}\x{2028}\x{2029}"
_GAP = r" \x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
_CUT = rf"^[{_GAP}\s\x{{0B}}\x{{85}}]+|[{_GAP}\s\x{{0B}}\x{{85}}]+$"
#: Items of the list field: l holds them, e one row each.
LIST_ITEMS = rf"""a AS (SELECT rec_id, bookSourceGroup AS g, regexp_matches(regexp_replace(bookSourceGroup, '"[^"]*"|“[^”]*”', '', 'g'), '[{_SEP}]') AS marked FROM corpus_source),
    b AS (SELECT rec_id, CASE WHEN marked THEN regexp_extract_all(g, '(?:"[^"]*"|“[^”]*”|[^{_SEP}"“])+') ELSE regexp_extract_all(g, '(?:"[^"]*"|“[^”]*”|[^{_SEP}{_GAP}"“])+') END AS i FROM a),
    c AS (SELECT rec_id, list_transform(i, lambda x: regexp_replace(x, '{_CUT}', '', 'g')) AS i FROM b),
    l AS (SELECT rec_id, list_filter(list_transform(i, lambda x: regexp_replace(CASE WHEN regexp_full_match(x, '"(?:[^"]|"")*"') THEN replace(x[2:-2], '""', '"') WHEN regexp_full_match(x, '“[^“”]*”') THEN x[2:-2] ELSE x END, '{_CUT}', '', 'g')), lambda x: x <> '') AS l FROM c),
    e AS (SELECT rec_id, unnest(range(len(l))) AS k, unnest(l) AS i FROM l)"""
SQL["p1_groups"] = f"WITH {LIST_ITEMS} SELECT rec_id, 'bookSourceGroup' AS field_name, CAST(k AS INTEGER) AS pos, i AS item FROM e"
