import json
from datetime import datetime

from quire.operators import drift

SCHEMA = "series_id string, file_no bigint, exported_at timestamp, line_no int, raw string, version int"


def lines(*files):
    out = []
    for no, records in enumerate(files, 1):
        out += [("s", no, datetime(2025, 1, no), k, r if isinstance(r, str | None) else json.dumps(r), 0) for k, r in enumerate(records)]
    return out


def changes(spark, *files):
    found = drift.schema_changes(spark.createDataFrame(lines(*files), SCHEMA)).changes
    return {tuple(r)[1:] if len(files) == 2 else tuple(r) for r in found.collect()}


def test_kinds_of_changes(spark):
    a = [{"sourceId": "1", "u": "x", "old": 5, "t": 1, "only": None}, {"sourceId": "2", "u": "y", "old": 6, "t": 2}]
    b = [{"sourceId": "2", "u": "y", "new": 6, "t": "2", "more": [1]}, {"sourceId": "3", "u": "z", "new": 9, "t": "3"}]
    assert changes(spark, a, b) == {("renamed", "old", "new"), ("retyped", "t", "t"), ("added", "", "more")}


def test_not_renamed_if_values_or_types_differ(spark):
    a = [{"sourceId": "1", "p": 1, "q": "z"}, {"sourceId": "2", "p": 2}]
    assert changes(spark, a, [{"sourceId": "1", "r": 1}, {"sourceId": "2", "r": 3}]) == {("removed", "p", ""), ("removed", "q", ""), ("added", "", "r")}
    assert changes(spark, [{"sourceId": "1", "p": 1}], [{"sourceId": "1", "r": "1"}]) == {("removed", "p", ""), ("added", "", "r")}
    # letter case makes another name; null in one and a value in the other isn't equal
    assert changes(spark, [{"sourceId": "1", "Url": "u"}], [{"sourceId": "1", "url": "u"}]) == {("renamed", "Url", "url")}
    assert changes(spark, [{"sourceId": "1", "p": 1}, {"sourceId": "2", "p": None}], [{"sourceId": "1", "r": 1}, {"sourceId": "2", "r": 2}]) == {("removed", "p", ""), ("added", "", "r")}


def test_versions_and_broken_lines(spark):
    f = [{"sourceId": "1", "p": 1}]
    df = spark.createDataFrame(lines(f, f, ["not json", None, "[1]"], f), SCHEMA)
    d = drift.schema_changes(df)
    assert [r.version for r in d.versions.orderBy("file_no").collect()] == [1, 1, 2, 3]
    assert {tuple(r) for r in d.changes.collect()} == {(3, "removed", "p", ""), (3, "removed", "sourceId", ""), (4, "added", "", "p"), (4, "added", "", "sourceId")}
    assert drift.schema_changes(df.limit(0)).changes.count() == 0


def test_ties_between_equal_fields_and_repeated_lines(spark):
    a = [{"sourceId": "1", "a": "v", "b": "v"}] * 2
    b = [{"sourceId": "1", "y": "v", "z": "v"}]
    assert changes(spark, a, b) == {("renamed", "a", "y"), ("renamed", "b", "z")}


def table(spark, df, keep, **options):
    d = drift.schema_changes(df)
    return drift.consistent_table(df, d, keep, **options)


def test_consistent_table(spark):
    files = ([{"sourceId": "1", "searchUrl": "/a", "w": 3, "line_no": "c"}], [{"sourceId": "1", "search_url": "/a", "w": "4"}], [{"sourceId": "1", "search_url": "/a", "w": "x"}], ["broken"])
    df = spark.createDataFrame(lines(*files), SCHEMA)
    out = table(spark, df, ["file_no", "line_no"])
    assert out.columns == ["file_no", "line_no", "line_no_", "search_url", "sourceId", "w", "unfit"]
    got = {r.file_no: (r.search_url, r.w, r.line_no_, r.unfit) for r in out.collect()}
    assert got == {1: ("/a", "3", "c", None), 2: ("/a", "4", None, None), 3: ("/a", "x", None, None), 4: (None, None, None, {"$": "broken"})}


def test_series_that_rename_crosswise_lose_nothing(spark):
    s1 = lines([{"sourceId": "1", "a": "x"}], [{"sourceId": "1", "b": "x"}])
    s2 = [("t", 9, *r[2:]) for r in lines([{"sourceId": "1", "a": "keepA", "b": "keepB"}])]
    s3 = [("u", no + 20, *r) for _, no, *r in lines([{"sourceId": "1", "b": "y"}], [{"sourceId": "1", "a": "y"}])]
    df = spark.createDataFrame(s1 + s2 + s3, SCHEMA)
    got = {(r.series_id, r.file_no): (r.a, r.b) for r in table(spark, df, ["series_id", "file_no"]).collect()}
    assert got == {("s", 1): ("x", None), ("s", 2): ("x", None), ("t", 9): ("keepA", "keepB"), ("u", 21): ("y", None), ("u", 22): ("y", None)}
    steps = {tuple(r)[2:] for r in drift.migration_steps(drift.schema_changes(df)).collect()}
    assert {(2, "rename", "a", "b"), (22, "rename", "b", "a"), (9, "collision", "b", "b")} <= steps


def test_a_name_used_again_for_something_else_is_another_column(spark):
    one = [[{"sourceId": "1", "a": "x"}], [{"sourceId": "1", "b": "x"}], [{"sourceId": "1", "b": "x", "a": "new"}], [{"sourceId": "1", "a": "new"}]]
    df = spark.createDataFrame(lines(*one), SCHEMA)
    got = {r.file_no: (r.a, r.a_) for r in table(spark, df, ["file_no"]).collect()}
    assert got == {1: ("x", None), 2: ("x", None), 3: ("x", "new"), 4: (None, "new")}


def test_numbers_stay_exact_and_failed_casts_are_kept(spark):
    big = 1735689600123456789
    files = ([{"sourceId": "1", "n": big, "m": big, "r": 0.5}], [{"sourceId": "1", "n": 5, "m": 0.25, "r": 2}], [{"sourceId": "1", "n": "not a number", "m": "7", "r": True}], [{"sourceId": "1", "n": " 12", "m": 10**30, "r": "1e3"}])
    df = spark.createDataFrame(lines(*files), SCHEMA)
    d = drift.schema_changes(df)
    route = drift.routes(d)
    out = drift.consistent_table(df, d, ["file_no"], route=route)
    assert dict(out.dtypes)["n"] == "bigint" and dict(out.dtypes)["m"] == "string" and dict(out.dtypes)["r"] == "double"
    got = {r.file_no: (r.n, r.m, r.r, r.unfit) for r in out.collect()}
    assert got == {1: (big, str(big), 0.5, None), 2: (5, "0.25", 2.0, None), 3: (None, "7", None, {"n": "not a number", "r": "true"}), 4: (12, str(10**30), 1000.0, None)}
    report = {tuple(r) for r in drift.migration_report(out, drift.migration_steps(d, route)).collect()}
    assert {(3, "cast-failed", "n", "", 1), (3, "cast-failed", "r", "", 1), (3, "cast", "n", "n", 1)} <= report


def test_defaults_and_rows_of_no_file(spark):
    rows = [*lines([{"sourceId": "1"}], [{"sourceId": "1", "k": None, "w": 2}, {"sourceId": "2", "k": "v"}]), (None, None, None, 0, '{"w": 3, "zz": 1}', 0), ("s", 1, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.file_no, r.k, r.w, str(r.unfit)) for r in table(spark, df, ["file_no"], defaults={"k": "none", "w": 1, "absent": 5}).collect()}
    # a line that is no object gets no default; a record of no file has no file that could lack a field
    assert got == {(1, "none", 1, "None"), (2, None, 2, "None"), (2, "v", None, "None"), (None, None, 3, "None"), (1, None, None, "None")}
    assert table(spark, df.limit(0), ["file_no"]).collect() == []
    clash = df.withColumn("__moved", df.version).withColumn("unfit", df.version)
    assert table(spark, clash, ["file_no", "__moved", "unfit"]).columns[-1] == "unfit_"
