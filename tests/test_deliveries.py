from quire.operators.deliveries import admit, deduplicate, keep_first, repeats

SCHEMA = "s string, id string, at bigint, n bigint, __rank int"
DATA = [("a", "x", 2, 1, 0), ("a", "x", 1, 3, 0), ("a", "x", 1, 2, 0), ("b", "x", 5, 4, 0), ("a", None, 1, 5, 0), ("a", None, 1, 6, 0), ("a", "", 1, 7, 0), ("c", "z", None, 8, 0), ("c", "z", 9, 9, 0)]


def test_keep_and_repeats(spark, rows):
    df = spark.createDataFrame(DATA, SCHEMA)
    keys, order = ["s", "id"], ["at", "n"]
    kept = keep_first(df, keys, order)
    assert kept.columns == df.columns and sorted(r.n for r in kept.collect()) == [2, 4, 9]
    assert rows(repeats(df, keys, order, "n")) == [(1,), (3,), (8,)]
    assert sorted(r.n for r in deduplicate(df, keys, order).collect()) == [2, 4, 5, 6, 7, 9]
    stored = spark.createDataFrame([("a", "x"), ("a", "x"), ("q", None)], "s string, id string")
    assert sorted(r.n for r in deduplicate(df, keys, order, stored).collect()) == [4, 5, 6, 7, 9]
    assert repeats(df.limit(0), keys, order, "n").count() == 0
    assert deduplicate(df.limit(0), keys, order).count() == 0


def test_the_hot_message_is_ranked_before_the_shuffle(spark):
    df = spark.range(20_000).selectExpr("'s' as s", "case when id % 3 = 0 then 'hot' else cast(id as string) end as id", "id as at", "id as n")
    kept = keep_first(df, ["s", "id"], ["at", "n"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert repeats(df, ["s", "id"], ["at", "n"], "n").count() == 6666


def test_batches_against_a_store(spark, tmp_path):
    df = spark.createDataFrame(DATA, SCHEMA)
    keys, order, store = ["s", "id"], ["at", "n"], str(tmp_path / "store")
    first, second = df.filter("n <= 4"), df.filter("n > 2")
    take = lambda batch, name: sorted(r.n for r in admit(batch, name, store, keys, order).collect())
    assert take(first, "b1") == [2, 4]
    assert take(second, "b2") == [5, 6, 7, 9]
    assert take(second, "b2") == [5, 6, 7, 9] and take(first, "b1") == [2, 4]  # a job that comes again
    assert take(df, "b3") == [5, 6, 7]  # rows without an identifier are no repeats
    assert take(df.limit(0), "b4") == []
