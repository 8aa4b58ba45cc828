"""Comparison of runs: canonical values, differences by path, counts of outcomes."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_object(text: str | None) -> str:
    """JSON with keys in order at every level; a text that isn't JSON stands for itself, null for null."""
    if text is None:
        return "\x00"
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (ValueError, RecursionError):
        return "\x01" + text.strip()


def json_digest(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and the SHA-256 of a JSON text in its canonical form: equal values, equal digests, however
    their keys are ordered or spaced. Null gives null."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, digest string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if s is None else hashlib.sha256(sorted_object(s).encode("utf-8", "surrogatepass")).hexdigest() for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [key, "digest"])

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def flatten_json(df: DataFrame, key: str, text: str, volatile: tuple[str, ...] = ()) -> DataFrame:
    """key, path, value of every leaf of a JSON text; lists by index, empty lists and objects are leaves.
    Top-level fields named in volatile are masked; strings lose what spellings differ in. Texts that
    aren't JSON give one row with path $ and the text; null texts none."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, path string, value string"

    def plain(s: str) -> str:
        s = re.sub(r"[ \t]+", " ", s.replace("\r\n", "\n").replace("\r", "\n"))
        s = "\n".join(x.strip() for x in s.split("\n")).strip()
        return s.rstrip("/") if re.match(r"https?://", s) else s

    def leaves(value: object) -> list[tuple[str, str]]:
        out, stack = [], [("$", value)]
        while stack:
            path, v = stack.pop()
            if isinstance(v, dict) and v:
                for k in sorted(v, reverse=True):
                    stack.append((f"{path}.{k}", "<masked>" if path == "$" and k in volatile else v[k]))
            elif isinstance(v, list) and v:
                stack += [(f"{path}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
            else:
                out.append((path, plain(v) if isinstance(v, str) else json.dumps(v)))
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, paths, values = [], [], []
            for i, s in enumerate(b.column(1).to_pylist()):
                if s is None:
                    continue
                try:
                    found = leaves(json.loads(s))
                except (ValueError, RecursionError):
                    found = [("$", plain(s))]
                at += [i] * len(found)
                paths += [p for p, _ in found]
                values += [v for _, v in found]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(paths, pa.string()), pa.array(values, pa.string())], [key, "path", "value"])

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def diff_paths(canonical: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """key, path, kind (missing, unexpected, value-mismatch), expected, actual."""
    a = canonical.withColumnRenamed("value", "expected")
    b = candidate.withColumnRenamed("value", "actual")
    j = a.join(b, [key, "path"], "full_outer")
    kind = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("expected") != F.col("actual"), "value-mismatch")
    return j.withColumn("kind", kind).filter("kind is not null").select(key, "path", "kind", "expected", "actual")


def candidate_totals(canonical: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """candidate, documents, matching, mismatching, absent, differences: how the documents (key, path,
    value) of each candidate (candidate, key, path, value) compare with the canonical ones. A document
    matches if no path differs; one that a candidate hasn't is absent. Documents and candidates are
    paired by their own tables, which list each once."""
    documents = canonical.select(key).distinct()
    have = candidates.select("candidate", key).distinct()
    expected = canonical.withColumnRenamed("value", "expected").join(have, key)
    j = expected.join(candidates.withColumnRenamed("value", "actual"), ["candidate", key, "path"], "full_outer")
    per = j.groupBy("candidate", key).agg(F.count_if(~F.col("expected").eqNullSafe(F.col("actual"))).alias("n"))
    totals = per.groupBy("candidate").agg(F.count_if(F.col("n") == 0).alias("matching"), F.count_if(F.col("n") > 0).alias("mismatching"), F.sum("n").alias("differences"))
    known = have.join(documents, key, "left_semi").groupBy("candidate").agg(F.count("*").alias("__there"))
    n = documents.count()
    return totals.join(known, "candidate", "left").select("candidate", F.lit(n).alias("documents"), "matching", "mismatching", (F.lit(n) - F.coalesce("__there", F.lit(0))).alias("absent"), "differences")


def missing_sources(expected: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """What is expected and wasn't seen."""
    return expected.select(key).join(seen.select(key), key, "left_anti")


def classify(text: Column, labels: dict[str, str]) -> Column:
    """All labels whose pattern is in the text, in the given order."""
    return F.filter(F.array(*(F.when(text.rlike(p), F.lit(k)) for k, p in labels.items())), lambda x: x.isNotNull())


#: Forms of rules, by what is in a rule's text; a rule without any is a shorthand or plain.
FORMS = {
    "css": r"(?i)^@css:", "xpath": r"^(?:(?i)@xpath:|//)", "json": r"^(?i)@json:|\$[.\[]", "js": r"(?s)^@js:|<js>.*?</js>",
    "template": r"\{\{.*?\}\}", "regexSuffix": r"##.+?##", "combined": r"[&|]{2}|%%", "variables": r"@put|@get",
}
SHORTHAND = r"^(?:[.#]|class\.|tag\.|id\.|[a-z][a-z0-9]*[@.#]|.*@(?:text|href|src|html)$)"


def rule_forms(df: DataFrame, sections: list[str], keep: list[str]) -> DataFrame:
    """keep and form, one row for each form of each rule of the sections (columns of JSON objects): every
    rule is looked at by itself. Values that are no texts, and empty ones, are no rules."""
    section = df.select(*keep, F.explode(F.array(*sections)).alias("s")).filter("s is not null")
    field = section.select(*keep, F.explode(F.map_values(F.from_json("s", "map<string,variant>"))).alias("v"))
    rule = field.filter(F.schema_of_variant("v") == "STRING").select(*keep, F.col("v").cast("string").alias("r")).filter("r <> ''")
    own = classify(F.col("r"), FORMS)
    bare = F.array(F.when(F.col("r").rlike(SHORTHAND), "shorthand").otherwise("plain"))
    return rule.select(*keep, F.explode(F.when(F.size(own) > 0, own).otherwise(bare)).alias("form"))


def outcome_counts(results: DataFrame, source: str, level: str, status: str, levels: list[str]) -> DataFrame:
    """Per level, how many sources passed, failed or skipped it (a level without a row is skipped), and
    the pass rate, 0 where there is none. One wide row per source, then one pass of counting."""
    per = results.groupBy(source, level).agg(F.max(F.when(F.col(status) == "pass", 2).otherwise(1)).alias("__s"))
    wide = per.groupBy(source).agg(*(F.max(F.when(F.col(level) == x, F.col("__s"))).alias(f"__l{i}") for i, x in enumerate(levels)))
    long = wide.select(F.explode(F.array(*(F.struct(F.lit(x).alias("level"), F.coalesce(F.col(f"__l{i}"), F.lit(0)).alias("s")) for i, x in enumerate(levels)))).alias("x")).select("x.level", "x.s")
    return long.groupBy("level").agg(
        F.count_if(F.col("s") == 2).alias("passed"), F.count_if(F.col("s") == 1).alias("failed"), F.count_if(F.col("s") == 0).alias("skipped"),
        F.round(F.count_if(F.col("s") == 2) / F.greatest(F.count("*"), F.lit(1)), 6).alias("pass_rate"),
    )


def verdicts(results: DataFrame, source: str, level: str, status: str, levels: int) -> DataFrame:
    """fully: every level passed and none failed; partially: any passed; else failed; counts of each."""
    one = results.groupBy(source, level).agg(F.min(F.col(status) == "pass").alias("__ok"), F.max(F.col(status) == "pass").alias("__any"))
    per = one.groupBy(source).agg(F.count_if("__ok").alias("__n_ok"), F.count_if("__any").alias("__n_any"), F.count_if(~F.col("__ok")).alias("__n_bad"))
    verdict = F.when((F.col("__n_ok") == levels) & (F.col("__n_bad") == 0), "fully").when(F.col("__n_any") > 0, "partially").otherwise("failed")
    return per.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("sources"))
