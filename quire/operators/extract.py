"""Extraction by rules: every rule of a query runs over one parsed document in one Python stage."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.rules import Document, Unsupported, compile_any, complete, substitute
from quire.session import spread, stage

Rule = str | list[dict]


def json_field(c: Column, *names: str) -> Column:
    """A path of plain names without Python: the engine's own JSON reader, as array<string>."""
    value = F.get_json_object(c, "$" + "".join(f"['{n}']" for n in names))
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value))


def _values(plan: object, doc: Document, scope: dict[str, str] | None = None) -> list[str]:
    try:
        return plan.run(doc, scope) if plan else []  # type: ignore[attr-defined]
    except Unsupported:
        return []
    except ValueError:
        return []  # the document isn't what the rule reads, such as JSON


def extract(df: DataFrame, key: str, text: str, rules: dict[str, Rule]) -> DataFrame:
    """key and an array<string> for each rule, in the order found.

    Bad rules fail here, on the driver. Null and empty texts, and texts that a rule can't read, give
    empty arrays. Repeated rows give repeated results. Names of rules must differ from key.
    """
    plans = {name: compile_any(r) for name, r in rules.items()}
    if key in plans:
        raise ValueError(f"a rule is named {key} like the key")
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, " + ", ".join(f"`{n}` array<string>" for n in plans)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list[list[str]]] = {n: [] for n in plans}
            for s in b.column(1).to_pylist():
                doc = Document(s or "")
                for n, p in plans.items():
                    out[n].append(_values(p, doc) if s else [])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.list_(pa.string())) for v in out.values())], [key, *plans])

    return spread(df.select(F.col(f"`{key}`"), F.col(f"`{text}`")), df).mapInArrow(run, schema)


def items(df: DataFrame, key: str, text: str, list_rule: str | None, fields: dict[str, str | tuple[str, str]], variables: dict[str, str] | None = None) -> DataFrame:
    """One row per item of a page: key, pos, and the first value that isn't blank of each field, trimmed.

    list_rule finds the items: a leading - turns their order round, one value that is a JSON array is
    its elements, no rule means the whole text is one item. A field's rule may be (rule, kind), kind
    being text, href or src: what is taken where the rule names no value. Rules with {{...}} are
    templates over the item and the variables. A bare name on a JSON item means $.name.
    """
    turned = bool(list_rule) and list_rule.strip().startswith("-")
    own = list_rule.strip().lstrip("-").strip() if list_rule else None
    if own and not own.startswith(("$", "/", "@")) and own.rpartition("@")[2].lower() not in ("html", "all"):
        own += "@html"
    list_plan = compile_any(own)
    raw = {n: (r if isinstance(r, tuple) else (r, "text")) for n, r in fields.items()}
    plans = {n: None if "{{" in r else compile_any(complete(r, kind)) for n, (r, kind) in raw.items()}
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, pos int, " + ", ".join(f"`{n}` string" for n in fields)
    names = [key, "pos", *fields]

    def one(doc: Document, n: str) -> str | None:
        rule = raw[n][0]
        if plans[n] is None:
            return substitute(rule.partition("##")[0], dict(variables or {}), doc).strip() or None
        if doc.text.lstrip().startswith("{") and rule.replace("_", "").isalnum():
            found = _values(compile_any(f"$.{rule}"), doc)
        else:
            found = _values(plans[n], doc, dict(variables or {}))
        return next((v.strip() for v in found if v.strip()), None)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            pos: list[int] = []
            out: dict[str, list[str | None]] = {n: [] for n in fields}
            for i, s in enumerate(b.column(1).to_pylist()):
                if not s:
                    continue
                found = _values(list_plan, Document(s)) if list_plan else [s]
                if len(found) == 1 and found[0].lstrip().startswith("["):
                    try:
                        found = [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in json.loads(found[0])]
                    except ValueError:
                        pass
                for k, x in enumerate(found[::-1] if turned else found):
                    doc = Document(x)
                    at.append(i)
                    pos.append(k)
                    for n in fields:
                        out[n].append(one(doc, n))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(pos, pa.int32()), *(pa.array(v, pa.string()) for v in out.values())], names)

    return spread(df.select(F.col(f"`{key}`"), F.col(f"`{text}`")), df).mapInArrow(run, schema)


def merge_fields(base: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """base with each field overwritten where a rule found a value."""
    new = found.select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    return base.join(new, key, "left").select(*(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns))


def flat_pairs(values: Column) -> Column:
    """array<struct<index, title, url>> of a flat list title, url, title, url; an odd last value is dropped."""
    n = F.floor(F.size(values) / 2).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("index"), F.get(values, i * 2).alias("title"), F.get(values, i * 2 + 1).alias("url")))


def follow_pages(start: DataFrame, pages: DataFrame, most: int = 50) -> DataFrame:
    """Follows links from page to page: start (key, url) over pages (url, next_url), one row per page met
    (key, step, url). A blank link, a missing page, a page met before or ``most`` pages end a walk. Of
    several links of a page the least counts.

    Links are stored once; jumps over 1, 2, 4 ... pages are joined to each other, and walks grow by
    each of them, so ``most`` pages take its logarithm in joins. A key may begin several walks. A page that a walk meets again has its
    first step there; all that follows is met again too.
    """
    links = pages.filter(F.length(F.trim("url")) > 0).groupBy("url").agg(F.min("next_url").alias("next_url"))
    known = stage(links, "links")
    jump = known.select("url", F.col("next_url").alias("to")).filter(F.length(F.trim("to")) > 0).join(known.select(F.col("url").alias("to")), "to")
    walk = start.select("key", "url").join(known.select("url"), "url").select("key", F.col("url").alias("begin"), F.lit(0).alias("step"), "url")
    span = 1
    while span < most:
        jump = stage(jump.select("url", "to"), f"jump-{span}")
        walk = walk.unionByName(walk.join(jump, "url").select("key", "begin", (F.col("step") + span).alias("step"), F.col("to").alias("url")))
        jump = jump.join(jump.select(F.col("url").alias("to"), F.col("to").alias("further")), "to").select("url", F.col("further").alias("to"))
        span *= 2
    return walk.filter(F.col("step") < most).groupBy("key", "begin", "url").agg(F.min("step").alias("step")).select("key", "step", "url")


def paged_content(start: DataFrame, pages: DataFrame, most: int = 50, between: str = "") -> DataFrame:
    """key, pages (how many), content: what the pages of each walk of follow_pages() hold (pages: url,
    next_url, content), one after the other; nulls are empty. A walk has ``most`` pages at most."""
    text = pages.groupBy("url").agg(F.min(F.struct("next_url", "content")).alias("x")).select("url", F.coalesce("x.content", F.lit("")).alias("content"))
    met = follow_pages(start, pages, most).join(text, "url")
    listed = F.array_sort(F.collect_list(F.struct("step", "content")))
    return met.groupBy("key").agg(F.count("*").alias("pages"), F.array_join(F.transform(listed, lambda x: x["content"]), between).alias("content"))


def paged_rows(start: DataFrame, pages: DataFrame, rows: DataFrame, most: int = 50) -> DataFrame:
    """key, pos and the rows (url, row_index, ...) of all pages of each walk, page by page; pos counts
    from 0 over a walk. Rows of one walk are put in order by one task, on disk."""
    met = follow_pages(start, pages, most).join(rows, "url")
    place = F.row_number().over(Window.partitionBy("key").orderBy("step", "row_index")) - 1
    return met.withColumn("pos", place).select("key", "pos", *(c for c in rows.columns if c != "row_index"))
