import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import merge as M
from quire.operators import rollup as R
from quire.operators import tables as E
from quire.operators.ordered import previous_max, running
from quire.operators.slices import slices


def test_running_over_partitions(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([None, 1, 2, 5])) for i in range(2000)]
    df = spark.createDataFrame(data, "k bigint, v bigint").repartition(7)
    got = {r.k: (r.row_no, r.total) for r in running(df, [F.desc("k")], F.col("v")).collect()}
    total = 0
    for n, (k, v) in enumerate(sorted(data, reverse=True, key=lambda x: x[0]), 1):
        total += v or 0
        assert got[k] == (n, total)
    assert running(df.limit(0), [F.asc("k")]).count() == 0


def test_previous_max_over_partitions(spark):
    rng = random.Random(6)
    data = [(rng.choice(["hot", "hot", "a", None, "b"]), i, rng.choice([None, *range(50)])) for i in range(1500)]
    df = spark.createDataFrame(data, "k string, n bigint, v bigint").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {r.n: r.before_max for r in previous_max(df, ["k"], [F.asc("n")], "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    most = {}
    for k, n, v in data:
        assert got[n] == most.get(k), n
        if v is not None:
            most[k] = max(most.get(k, v), v)
    assert previous_max(df.limit(0), ["k"], [F.asc("n")], "v").count() == 0


def test_prune_is_the_greedy_loop(spark):
    rng = random.Random(4)
    rows = [("s", str(rng.randrange(5)), i, "x" * rng.randrange(9), rng.randrange(50)) for i in range(300)]
    df = spark.createDataFrame(rows, "source_id string, book_id string, chapter_index int, content string, cached_at bigint")
    kept = {r.chapter_index for r in E.prune_cache(df, 10, 150, 400).collect()}
    left = sorted((r for r in rows if r[4] >= 10), key=lambda r: (r[4], r[0], r[1], r[2]))
    left = left[max(0, len(left) - 150) :]
    while left and sum(len(r[3]) for r in left) > 400:
        left.pop(0)
    assert kept == {r[2] for r in left}


def test_shelf(spark):
    df = spark.createDataFrame([("s", "1", "Öl", "a", 5, "g", 1), ("s", "2", "xyz", "a", 9, "g", 1), ("t", "3", "XYZ", "b", 5, None, 0)], "source_id string, book_id string, title string, author string, added_at bigint, group_name string, sort_index int")
    ids = lambda q: [r.book_id for r in q.collect()]
    assert ids(E.shelf_query(df)) == ["3", "2", "1"] and ids(E.shelf_query(df, descending=True)) == ["1", "2", "3"]
    assert ids(E.shelf_query(df, keyword=" XyZ ", by="added_at", descending=True)) == ["2", "3"]
    assert ids(E.shelf_query(df, source="s", group="g", offset=1, limit=5)) == ["1"] and ids(E.shelf_query(df, keyword=" ")) == ["3", "2", "1"]
    with pytest.raises(ValueError):
        E.shelf_query(df, group=" ")


def test_merge_policies_and_conflicts(spark):
    schema = "collection string, record_id string, updated_at bigint, deleted boolean, revision bigint, device_id string, payload string"
    local = spark.createDataFrame([("c", "a", 5, False, 1, "L", "x"), ("c", "b", 5, True, 1, "L", "x"), ("c", "c", 5, False, 1, "L", "x"), ("c", "d", 5, False, 1, "L", "x"), ("c", "d", 4, False, 9, "L", "y"), ("c", "only", 1, False, 1, "L", "x")], schema)
    remote = spark.createDataFrame([("c", "a", 5, False, 1, "R", "x"), ("c", "b", 6, False, 1, "R", "x"), ("c", "c", 5, False, 2, "R", "y"), ("c", "d", 7, False, 1, "R", "z")], schema)
    got = lambda *a: {r.record_id: (r.side, r.conflict, r.payload) for r in M.merge(local, remote, *a).collect()}
    assert got() == {"a": ("remote", "none", "x"), "b": ("remote", "deleteVsUpdate", "x"), "c": ("remote", "tieBreak", "y"), "d": ("remote", "concurrentUpdate", "z"), "only": ("local", "none", "x")}
    assert got("device", ["L", "R"])["c"] == ("local", "tieBreak", "x") and got("device", ["L"])["c"][0] == "remote"
    assert got("manual")["d"] == (None, "concurrentUpdate", "z") and got("manual")["a"][0] == "remote"
    both = got("keep_both")
    assert both["d#conflict:L:1"] == ("local", "concurrentUpdate", "x") and "b#conflict:L:1" not in both
    assert M.merge(local.limit(0), remote.limit(0)).count() == 0


def test_toc_remap_and_clamp(spark):
    schema = "b string, at int, title string, url string"
    old = spark.createDataFrame([("b", 0, "A", "u1"), ("b", 1, "B", None), ("b", 2, "B", None), ("b", 3, "Gone", "u9"), ("b", 4, "C", "U1#x")], schema)
    new = spark.createDataFrame([("b", 0, "B", ""), ("b", 1, "B", None), ("b", 2, "A2", "u1"), ("b", 3, "New", "n")], schema)
    m = M.remap_toc(old, new, ["b"], "at")
    assert {(r.old_index, r.new_index, r.change) for r in m.collect()} == {(0, 2, "mapped"), (1, 0, "mapped"), (2, 1, "mapped"), (3, None, "removed"), (4, None, "removed"), (None, 3, "inserted")}
    c = {r.old_index: (r.target_index, r.clamped_to) for r in M.clamp_to_survivor(m, ["b"]).collect()}
    assert c[3] == (1, "previous") and c[0] == (2, "same")


def test_journal_retention_and_feeds(spark):
    df = spark.createDataFrame([("g", i, i % 3) for i in range(9)] + [(None, 20, 1)], "g string, id int, t int")
    j = {r.g: (r.kept_id, r.discarded) for r in M.journal(df, ["g"], [F.desc("t"), F.asc("id")], "id").collect()}
    assert j == {"g": (2, 8), None: (20, 0)}
    gone = {r.id for r in M.retention(df, ["g"], [F.desc("t"), F.asc("id")], 4, "t", 2, "id", spark.createDataFrame([(0,)], "id int")).collect()}
    assert gone == {1, 3, 4, 6, 7, 20}
    e = spark.createDataFrame([("f", "a", 1), ("f", "b", 2), ("f", "c", 3), ("h", "z", 1)], "f string, id string, pos int")
    assert {r.id for r in M.before_last_seen(e, ["f"], "pos", spark.createDataFrame([("f", "b"), ("f", "c")], "f string, id string")).collect()} == {"a", "z"}


def test_path_diff_and_counts(spark):
    a = spark.createDataFrame([(1, json.dumps({"x": [1, {"y": " a  b "}], "t": 5, "u": "http://h/"})), (2, None), (3, "no json")], "k int, j string")
    b = spark.createDataFrame([(1, json.dumps({"x": [1, {"y": "a b"}, 2], "t": 6, "u": "http://h"})), (3, "other")], "k int, j string")
    d = R.diff_paths(R.flatten_json(a, "k", "j", ("t",)), R.flatten_json(b, "k", "j", ("t",)), "k")
    assert {tuple(r) for r in d.collect()} == {(1, "$.x[2]", "unexpected", None, "2"), (3, "$", "value-mismatch", "no json", "other")}
    res = spark.createDataFrame([("a", "L1", "pass"), ("a", "L2", "fail"), ("a", "L2", "pass"), ("b", "L1", "fail"), ("c", "L1", "pass"), ("c", "L2", "pass")], "s string, l string, o string")
    assert {r.level: (r.passed, r.failed, r.skipped, r.pass_rate) for r in R.outcome_counts(res, "s", "l", "o", ["L1", "L2"]).collect()} == {"L1": (2, 1, 0, 0.666667), "L2": (2, 0, 1, 0.666667)}
    assert {tuple(r) for r in R.verdicts(res, "s", "l", "o", 2).collect()} == {("fully", 1), ("partially", 1), ("failed", 1)}


def test_text_functions(spark):
    one = lambda f, s: spark.createDataFrame([(s,)], "c string").select(f(F.col("c"))).first()[0]
    assert one(T.normalize_content, "\r\n\na\r\r\r\rb\n") == "a\n\nb"
    assert one(T.normalize_chapter, "﻿ a  \r\n \n\n\n b　\n") == "a\n\n b"
    assert one(T.strip_tags, "<p>a &amp;lt;<b>b</b></p><!-- x --><br/>c<!-- open") == "a &lt;b\nc"
    assert one(lambda c: T.attribute(c, "src"), "<img data-src='n' SRC=\"a b\">") == "a b"
    assert one(T.fnv1a64, "hello") == "a430d84680aabd0b" and one(T.fnv1a64, "") == "cbf29ce484222325"
    assert one(T.utrim, "　 a 　") == "a" and one(T.half_width, "ＡＢ　１") == "AB 1"
    assert one(T.slug, " Hello, World! ") == "hello-world" and one(T.slug, "书") == one(T.fnv1a64, "书")
    assert one(T.redact, "Authorization: Bearer abc.d; token=xy&b") == "Authorization: [REDACTED] [REDACTED]; token=[REDACTED]&b"
    assert one(T.sentences, "A b. C！D") == ["A b.", "C！", "D"]
    assert one(T.encode_component, "a b~'é*") == "a%20b~'%C3%A9*" and one(T.encode_uri, "http://h/a b?q=é") == "http://h/a%20b?q=%C3%A9"
    assert one(T.squeeze, None) is None and one(lambda c: T.digest(c, "sm3"), "x") == ""
    m = spark.createDataFrame([({"b": "2", "a": "1", "c": ""},)], "m map<string,string>")
    assert m.select(T.sign_payload(F.col("m"))).first()[0] == "a=1&b=2"
    rules = [T.ReplaceRule("b", "c", order=2), T.ReplaceRule("a", "b", is_regex=False, order=1), T.ReplaceRule("(", "x", order=0), T.ReplaceRule("c", "!", order=3, exclude="nope")]
    assert one(lambda c: T.replace_rules(c, rules, False, F.lit("Nope")), "ab") == "cc"


def test_slices(spark):
    text = " a\n\n  bc \n é d. e！f"
    df = spark.createDataFrame([(1, text, 9), (2, None, 9), (3, "", 9), (4, "\n \n", 9), (5, text, 9)], "k bigint, t string, pos int")
    got = lambda by: [tuple(r)[1:] for r in slices(df, "k", "t", by).filter("k = 5").orderBy("pos").collect()]
    assert got("line") == [(0, "a", 1, 2), (1, "bc", 6, 8), (2, "é d. e！f", 11, 19)]
    assert got("paragraph") == [(0, "a", 1, 2), (1, "bc \n é d. e！f", 6, 19)]
    assert got("sentence") == [(0, "a\n\n  bc \n é d.", 1, 15), (1, "e！", 16, 18), (2, "f", 18, 19)]
    assert {r.k for r in slices(df, "k", "t").collect()} == {1, 5}
    for r in slices(df, "k", "t", "sentence").collect():
        assert text[r.start_char : r.end_char] == r.slice
    assert slices(df.limit(0), "k", "t").count() == 0


def test_queries_agree_with_their_sql_on_empty_tables(spark, tmp_path):
    """Every registered query gives its columns, and no row, over empty tables."""
    from quire import queries as core
    from quire import reference_queries as ref

    source = "/root/testdata/sf0.001"
    import os

    if not os.path.isdir(source):
        pytest.skip("no test data here")
    for name in os.listdir(source):
        spark.read.parquet(f"{source}/{name}").limit(0).write.parquet(str(tmp_path / name))
    counts = defaultdict(int)
    for name, f in {**core.QUERIES, **ref.QUERIES}.items():
        df = f(spark, str(tmp_path))
        counts[name] = df.count()
        assert df.columns
    assert {k: v for k, v in counts.items() if v and k not in ("run_levels", "source_tallies")} == {}
