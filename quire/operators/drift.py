"""Schemas that drift between files: a versioned fingerprint per file, migration steps, one table.

The schema of every file is one row: its fields and their types, in the order of its series. All that
is said about a change is in that row and the one before; only fields that went and came together are
looked up in the records again, as hashes. A series is then walked once: each field belongs to a line
that renamings carry on, and each line has one column of the consistent table, so two fields of one
record never meet in one column.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import free_name, stage

SERIES = ["series_id", "file_no"]
EXACT = 2**53  # up to here a double holds every integer


def record_of(raw: str | None) -> dict | None:
    """The JSON object of a line, None if it is none. Of a name repeated in one object the last counts."""
    try:
        record = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def kind_of(v: object) -> str:
    """string, boolean, array, object, or number with what it takes to hold it exactly."""
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "number:int" if -EXACT <= v <= EXACT else "number:long" if -(2**63) <= v < 2**63 else "number:big"
    return "string" if isinstance(v, str) else "number:real" if isinstance(v, float) else "array" if isinstance(v, list) else "object"


def canonical(v: object) -> str:
    if isinstance(v, float) and v.is_integer() and abs(v) < EXACT:
        v = int(v)
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def shapes(df: DataFrame) -> DataFrame:
    """One row per file: series_id, file_no, at, shape (its fields with each kind met, in order).

    A batch of records sends each (file, field, kind) once; names bound a file's row, not its records.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            met: dict[tuple, None] = {}
            for series, no, at, raw in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                met[series, no, at, None, None] = None  # a file has its place whether or not a field of it is filled
                for name, v in (record_of(raw) or {}).items():
                    if v is not None:
                        met[series, no, at, name, kind_of(v)] = None
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*met, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["series_id", "file_no", "at", "field", "kind"])

    at = F.unix_micros(F.col("exported_at").cast("timestamp"))
    rows = df.select("series_id", "file_no", at.alias("at"), "raw").mapInArrow(run, "series_id string, file_no bigint, at bigint, field string, kind string")
    met = F.collect_set(F.when(F.col("field").isNotNull(), F.struct("field", "kind")))
    return rows.groupBy(*SERIES).agg(F.min("at").alias("at"), F.array_sort(met).alias("shape"))


def files_of(df: DataFrame) -> DataFrame:
    """One row per file with its version, fingerprint, the file before, and what went, came or changed
    its type since. fields has every field with its types joined by |."""
    base = lambda x: F.substring_index(x["kind"], ":", 1)
    kinds = lambda n: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("shape", lambda x: x["field"] == n), base))), "|")
    names = F.array_distinct(F.transform("shape", lambda x: x["field"]))
    file = shapes(df).withColumn("fields", F.transform(names, lambda n: F.struct(n.alias("field"), kinds(n).alias("kind"))))
    text = F.array_join(F.transform("fields", lambda x: F.concat(x["field"], F.lit("\x1f"), x["kind"])), "\x1e")
    order = Window.partitionBy("series_id").orderBy("at", "file_no")  # a series' files, not its records
    file = file.withColumn("fingerprint", F.md5(F.encode(text, "UTF-8")))
    file = file.withColumns({"prev_no": F.lag("file_no").over(order), "prev_fields": F.lag("fields").over(order), "prev_print": F.lag("fingerprint").over(order)})
    file = file.withColumn("version", F.sum(F.when(F.col("prev_print") == F.col("fingerprint"), 0).otherwise(1)).over(order))
    changed = F.col("prev_no").isNotNull() & (F.col("prev_print") != F.col("fingerprint"))
    own, old = F.map_from_entries("fields"), F.map_from_entries("prev_fields")
    name = lambda x: x["field"]
    none = F.array().cast("array<string>")
    gone = F.transform(F.filter("prev_fields", lambda x: ~F.map_contains_key(own, x["field"])), name)
    came = F.transform(F.filter("fields", lambda x: ~F.map_contains_key(old, x["field"])), name)
    retyped = F.transform(F.filter("fields", lambda x: F.map_contains_key(old, x["field"]) & (old[x["field"]] != x["kind"])), name)
    when = lambda c: F.when(changed, c).otherwise(none)
    return file.select(*SERIES, "at", "prev_no", "version", "fingerprint", "shape", "fields", when(gone).alias("gone"), when(came).alias("came"), when(retyped).alias("retyped"))


def evidence(df: DataFrame, files: DataFrame, record_key: str) -> DataFrame:
    """series_id, at_no, record_key, newer, field, a, b: 128 bits of hash of every value whose field went
    or came at file at_no; a row with field null for each record that was there to be compared."""
    pair = files.filter("size(gone) > 0 and size(came) > 0")
    side = lambda no, newer, fields: F.struct(F.col(no).alias("no"), F.col("file_no").alias("at_no"), F.lit(newer).alias("newer"), F.col(fields).alias("fields"))
    wanted = pair.select("series_id", F.explode(F.array(side("file_no", True, "came"), side("prev_no", False, "gone"))).alias("x"))
    wanted = wanted.groupBy("series_id", F.col("x.no").alias("file_no")).agg(F.collect_list(F.struct("x.at_no", "x.newer", "x.fields")).alias("wanted"))  # two at most
    types = {"series_id": pa.string(), "at_no": pa.int64(), "record_key": pa.string(), "newer": pa.bool_(), "field": pa.string(), "a": pa.int64(), "b": pa.int64()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for series, raw, asked in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                record = record_of(raw)
                if record is None or (own := record.get(record_key)) is None:
                    continue
                own = canonical(own)
                for w in asked:
                    out.append((series, w["at_no"], own, w["newer"], None, 0, 0))
                    for f in w["fields"]:
                        if (v := record.get(f)) is not None:
                            h = blake2b(f"{own}\0{kind_of(v).partition(':')[0]}\0{canonical(v)}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                            out.append((series, w["at_no"], own, w["newer"], f, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)))
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))

    rows = df.select(*SERIES, "raw").join(wanted, SERIES).select("series_id", "raw", "wanted")
    return rows.mapInArrow(run, "series_id string, at_no bigint, record_key string, newer boolean, field string, a bigint, b bigint")


def renamings(df: DataFrame, files: DataFrame, record_key: str) -> DataFrame:
    """series_id, file_no, renamed array<struct<old, new>>.

    A field that went and one that came are one field if, over the records in both files, they have the
    same set of (record, type, value), at least one. Sets are compared by their size and 128 bits of
    exclusive-or over hashes of their members; every step is a partial aggregate, so neither a file nor a
    record that repeats without end has to fit one task. Ties among equal fields go by name.
    """
    sums = lambda n: [n.alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")]
    member = evidence(df, files, record_key).distinct()
    per_record = member.groupBy("series_id", "at_no", "record_key", "newer", "field").agg(*sums(F.count("*")))
    both = per_record.groupBy("series_id", "at_no", "record_key").agg(F.min("newer").alias("low"), F.max("newer").alias("high"), F.collect_list(F.struct("newer", "field", "n", "a", "b")).alias("x"))
    cell = both.filter("low <> high").select("series_id", "at_no", F.explode("x").alias("x")).select("series_id", "at_no", "x.*").filter("field is not null")
    proof = cell.groupBy("series_id", "at_no", "newer", "field").agg(*sums(F.sum("n")))
    names = lambda newer: F.array_sort(F.collect_list(F.when(F.col("newer") == newer, F.col("field"))))
    same = proof.groupBy("series_id", "at_no", "n", "a", "b").agg(names(False).alias("old"), names(True).alias("new"))
    n = F.least(F.size("old"), F.size("new"))
    pairs = F.zip_with(F.slice("old", F.lit(1), n), F.slice("new", F.lit(1), n), lambda a, b: F.struct(a.alias("old"), b.alias("new")))
    found = same.filter("size(old) > 0 and size(new) > 0").select("series_id", F.col("at_no").alias("file_no"), F.explode(pairs).alias("p"))
    return found.groupBy(*SERIES).agg(F.array_sort(F.collect_list("p")).alias("renamed"))


@dataclass
class Drift:
    """files: one row per file, with series_id, file_no, prev_no, version, fingerprint, fields, renamed,
    gone, came and retyped."""

    files: DataFrame
    record_key: str

    @property
    def versions(self) -> DataFrame:
        return self.files.select("series_id", "file_no", "prev_no", "version", "fingerprint")

    @property
    def changes(self) -> DataFrame:
        """file_no, change_kind (added, removed, renamed, retyped), old_field, new_field."""
        change = lambda kind, a, b: F.struct(F.lit(kind).alias("change_kind"), a.alias("old_field"), b.alias("new_field"))
        none = F.lit("")
        all_of = F.concat(
            F.transform("renamed", lambda p: change("renamed", p["old"], p["new"])),
            F.transform("removed", lambda f: change("removed", f, none)),
            F.transform("added", lambda f: change("added", none, f)),
            F.transform("retyped", lambda f: change("retyped", f, f)),
        )
        return self.files.select("file_no", F.explode(all_of).alias("x")).select("file_no", "x.*")


def schema_changes(df: DataFrame, record_key: str = "sourceId") -> Drift:
    """Versions of each series' schema and every change between a file and the one before.

    A file's fingerprint is the MD5 of its fields and their types in order of name (of several types in
    one file, all); a version lasts until it changes. See renamings() for what makes two fields one.
    Files of equal time go by file_no. Records without a key count for the schema alone; lines that are
    no JSON objects count for nothing; an empty df gives no version. Other columns of df are ignored.
    """
    files = stage(files_of(df), "drift-files")
    found = renamings(df, files, record_key)
    none = F.array().cast("array<struct<old:string,new:string>>")
    files = files.join(found, SERIES, "left").withColumn("renamed", F.coalesce("renamed", none))
    side = lambda k: F.transform("renamed", lambda p: p[k])
    return Drift(files.withColumns({"removed": F.array_except("gone", side("old")), "added": F.array_except("came", side("new"))}), record_key)


# ---- migration ----------------------------------------------------------------------------------


def roots(files: DataFrame) -> dict[str, str]:
    """Each name that takes part in a renaming → the one name of all that renamings connect: the one in
    most files, then the least. Runs on the driver over distinct names and pairs: schema, not data."""
    pairs = [tuple(r) for r in files.select(F.explode("renamed").alias("p")).select("p.old", "p.new").distinct().collect()]
    n = {r["field"]: r["n"] for r in files.select(F.explode("fields").alias("f")).groupBy("f.field").agg(F.count("*").alias("n")).collect()}
    above: dict[str, str] = {}

    def root(x: str) -> str:
        while above.get(x, x) != x:
            x = above[x]
        return x

    for a, b in sorted(pairs):
        a, b = sorted((root(a), root(b)), key=lambda x: (-n.get(x, 0), x))
        above[b] = a
    return {x: root(x) for x in {n for p in pairs for n in p}}


class Lines:
    """The lines of one series: which field carries each on at present, and which column each has.

    A renaming carries a line on under another name; a field that comes back carries its old line on,
    unless that goes on elsewhere. A new line takes the column of its root if no other line of the series
    has it, else one by its own name: this is a collision, and is reported.
    """

    def __init__(self, root: dict[str, str]):
        self.root = root
        self.column: dict[str, str] = {}  # by the field that carries the line
        self.taken: set[str] = set()

    def step(self, fields: list[str], renamed: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
        """Takes in a file; its steps as (rule, field, target)."""
        steps = [("rename", old, new) for old, new in renamed]
        carried = [(new, self.column.pop(old)) for old, new in renamed if old in self.column]
        self.column.update(carried)
        for f in sorted((f for f in fields if f not in self.column), key=lambda f: (self.root.get(f, f) != f, f)):
            wanted = own = self.root.get(f, f)
            if own in self.taken:
                own = f
                while own in self.taken:
                    own += "_"
                steps.append(("collision", f, own))
            elif own != f:
                steps.append(("rename", f, wanted))
            self.column[f] = own
            self.taken.add(own)
        return steps


PLACED = "array<struct<name:string,column:string,kinds:array<string>>>"
STEPS = "array<struct<rule:string,field:string,target:string>>"


def routes(drift: Drift) -> DataFrame:
    """Per file the column of each of its fields, and the steps that lead to its version.

    Each series is one history, read in order by one task that holds the names of one series; its
    length is the number of its files, and records never go there.
    """
    files = stage(drift.files.select(*SERIES, "at", "version", "shape", "fields", "renamed", "added", "removed", "retyped"), "drift-history")
    root = roots(files)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, series, begun = Lines(root), None, False
        for b in batches:
            placed, steps = [], []
            for r in b.to_pylist():
                if not begun or r["series_id"] != series:
                    lines, series, begun = Lines(root), r["series_id"], True
                fields = [f["field"] for f in r["fields"]]
                own = lines.step(fields, [(p["old"], p["new"]) for p in r["renamed"]])
                own += [("default", f, "") for f in r["added"]] + [("retire", f, "") for f in r["removed"]] + [("cast", f, lines.column[f]) for f in r["retyped"]]
                kinds: dict[str, list[str]] = {}
                for s in r["shape"]:
                    kinds.setdefault(s["field"], []).append(s["kind"])
                placed.append([{"name": f, "column": lines.column[f], "kinds": kinds[f]} for f in fields])
                steps.append([{"rule": a, "field": f, "target": t} for a, f, t in own])
            text = pa.string()
            place = pa.list_(pa.struct([("name", text), ("column", text), ("kinds", pa.list_(text))]))
            step = pa.list_(pa.struct([("rule", text), ("field", text), ("target", text)]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("series_id", "file_no", "version")), pa.array(placed, place), pa.array(steps, step)], [*SERIES, "version", "placed", "steps"])

    history = files.repartition("series_id").sortWithinPartitions("series_id", "at", "file_no")
    return stage(history.mapInArrow(run, f"series_id string, file_no bigint, version bigint, placed {PLACED}, steps {STEPS}"), "drift-routes")


def migration_steps(drift: Drift, route: DataFrame | None = None) -> DataFrame:
    """series_id, version, file_no, rule, field, target: all steps of every series from version to version.

    rename: the field goes on under the target's name; default: it is new, and empty or the caller's
    default in files before; retire: it is gone; cast: its values change type, column target takes them;
    collision: its root's column belongs to another line of the series, so it has column target.
    """
    route = routes(drift) if route is None else route
    return route.select("series_id", "version", "file_no", F.explode("steps").alias("x")).select("series_id", "version", "file_no", "x.*")


def holder(votes: dict[str, int]) -> str:
    """The type of a column: the one in most files, the first in order of ties; numbers in the type that
    holds all of them exactly, which is text for integers beyond a double's beside fractions."""
    base: dict[str, int] = {}
    for k, n in sorted(votes.items()):
        base[k.partition(":")[0]] = base.get(k.partition(":")[0], 0) + n
    best = max(sorted(base), key=lambda k: base[k])
    if best != "number":
        return best
    fine = {k.partition(":")[2] for k in votes if k.startswith("number:")}
    if "big" in fine or {"long", "real"} <= fine:
        return "text"
    return "real" if "real" in fine else "integer"


UNFIT = Ellipsis  # one object in every process


def cast(v: object, to: str) -> object:
    """v in the type of its column, UNFIT where that would change what it says."""
    if to in ("string", "text"):
        return canonical(v)
    if to in ("array", "object"):
        return json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    if to == "boolean":
        return v if isinstance(v, bool) else {"true": True, "1": True, "false": False, "0": False}.get(canonical(v).strip().lower(), UNFIT)
    if isinstance(v, bool | list | dict):
        return UNFIT
    try:
        whole = v if isinstance(v, int) else int(v) if isinstance(v, str) or v.is_integer() else None
    except (ValueError, OverflowError):
        whole = None
    if to == "integer":
        return whole if whole is not None and -(2**63) <= whole < 2**63 else UNFIT
    try:
        x = float(v)
    except (ValueError, OverflowError):
        return UNFIT
    return x if x == x and abs(x) != float("inf") and (whole is None or int(x) == whole) else UNFIT


ARROW = {"integer": pa.int64(), "real": pa.float64(), "boolean": pa.bool_()}
SQL = {"integer": "bigint", "real": "double", "boolean": "boolean"}


def consistent_table(df: DataFrame, drift: Drift, keep: list[str], defaults: dict[str, object] | None = None, route: DataFrame | None = None) -> DataFrame:
    """All records under one schema: each line of renamed fields in one column, and nothing lost.

    Each file goes through the steps of its series, composed per file by routes(): its fields' columns,
    defaults for columns that the file lacks altogether (by column name, null where none is given), and
    casts to the column's type, which is the one in most files (integers stay exact). What can't be cast
    is null there and stands in the last column, ``unfit`` map<string,string>, under its own name; so
    does the text of a line that is no JSON object, under ``$``. Columns keep (of df) come first, then
    fields in order of name; a name that clashes, letter case aside, gets an underscore. Records of no
    file (null series or number) keep their names. Rows are joined to their file's route by file, which
    the engine broadcasts while it is small.
    """
    route = routes(drift) if route is None else route
    votes: dict[str, dict[str, int]] = {}
    for r in route.select(F.explode("placed").alias("p")).select("p.column", F.explode("p.kinds").alias("kind")).groupBy("column", "kind").agg(F.count("*").alias("n")).collect():  # schema, not data
        votes.setdefault(r["column"], {})[r["kind"]] = r["n"]
    kinds = {c: holder(v) for c, v in votes.items()}
    defaults = {c: v for c, v in (defaults or {}).items() if c in kinds}
    taken = {k.lower() for k in keep}
    columns: dict[str, str] = {}
    for f in sorted(kinds):
        c = f
        while c.lower() in taken:
            c += "_"
        taken.add(c.lower())
        columns[f] = c
    unfit = "unfit"
    while unfit in taken:
        unfit += "_"
    filled = {c: cast(v, kinds[c]) for c, v in defaults.items()}
    if bad := [c for c, v in filled.items() if v is UNFIT]:
        raise ValueError(f"defaults that don't fit their columns: {bad}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list] = {f: [None] * b.num_rows for f in kinds}
            left: list[list | None] = [None] * b.num_rows
            n = b.num_columns
            for i, (raw, moved, absent) in enumerate(zip(*(b.column(k).to_pylist() for k in range(n - 3, n)), strict=True)):
                record = record_of(raw)
                if record is None:
                    left[i] = [("$", raw)] if raw else None
                    continue
                for c in absent or ():
                    found[c][i] = filled[c]
                at = {m["name"]: m["column"] for m in moved or ()}
                rest = []
                for name, v in record.items():
                    if v is None:
                        continue
                    c = at.get(name, name)
                    new = cast(v, kinds[c]) if c in kinds else UNFIT
                    if new is UNFIT:
                        rest.append((name, canonical(v)))
                    else:
                        found[c][i] = new
                left[i] = rest or None
            yield pa.RecordBatch.from_arrays([*b.columns[: n - 3], *(pa.array(found[f], ARROW.get(kinds[f], pa.string())) for f in columns), pa.array(left, pa.map_(pa.string(), pa.string()))], [*keep, *columns.values(), unfit])

    moved = F.filter("placed", lambda x: x["name"] != x["column"])
    lacks = F.array(*(F.lit(c) for c in defaults)) if defaults else F.array().cast("array<string>")
    absent = F.filter(lacks, lambda c: ~F.exists("placed", lambda x: x["column"] == c))
    names = [free_name(df, x) for x in ("__moved", "__absent")]
    way = route.select(*(F.col(c).alias(f"__{c}") for c in SERIES), F.transform(moved, lambda x: F.struct(x["name"].alias("name"), x["column"].alias("column"))).alias(names[0]), absent.alias(names[1]))
    same: Column = (F.col("series_id") == F.col("__series_id")) & (F.col("file_no") == F.col("__file_no"))
    source = df.join(way, same, "left").select(*[F.col(f"`{c}`") for c in keep], F.col("raw"), *names)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in source.select(*[F.col(f"`{c}`") for c in keep]).dtypes), *(f"`{c}` {SQL.get(kinds[f], 'string')}" for f, c in columns.items()), f"`{unfit}` map<string,string>"])
    return source.mapInArrow(run, schema)


def migration_report(table: DataFrame, steps: DataFrame, unfit: str = "unfit") -> DataFrame:
    """file_no, rule, field, target, n: every step of migration_steps(), and for each file and field of
    consistent_table() (kept file_no) how many of its values could not be cast (rule cast-failed)."""
    failed = table.select("file_no", F.explode(F.map_keys(F.col(f"`{unfit}`"))).alias("field")).groupBy("file_no", "field").agg(F.count("*").alias("n"))
    failed = failed.select("file_no", F.lit("cast-failed").alias("rule"), "field", F.lit("").alias("target"), "n")
    return steps.select("file_no", "rule", "field", "target", F.lit(1).cast("bigint").alias("n")).unionByName(failed)
