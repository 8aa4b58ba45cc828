import random

from quire.llm import canonical

ARGS = {"key": "rec_id", "texts": ["name", "url"], "needed": ["url"], "objects": ["rules"]}
SCHEMA = "rec_id bigint, name string, url string, rules string, first_id string, __key string"


def frame(spark, data):
    return spark.createDataFrame([(*d, "z", "z") for d in data], SCHEMA)


def test_equal_and_different(spark, rows):
    data = [
        (5, "Laihon Café", "https://D.test", '{"a":"1","b":"2"}'),
        (3, " LAIHON  CAFÉ...", "HTTPS://d.test#★", '{"b" : "2",\n "a" : "1"}'),
        (4, "laihon café", "https://d.test/", '{"a":"1","b":"3"}'),
        (6, "ｌａｉｈｏｎ café", "https//d.test", '{"a":"1","b":"2"}'),
        (7, "x", None, None), (8, "x", None, None), (9, "x", " ", None), (10, "x", " ", None), (11, "x", "★", None), (12, "x", "★", None),
        (20, "Cafe", "v", None), (21, "Caf\u00e9", "v", None), (22, "cafe\u0301", "v", None),
        (13, None, "u", None), (14, None, "U", None), (15, "", "u", "broken {"), (16, "", "u", " broken {"),
    ]
    assert rows(canonical.hidden_duplicates(frame(spark, data), **ARGS)) == sorted([(21, 22), (3, 5), (3, 6), (13, 14), (15, 16)], key=str)
    copies = dict(map(tuple, canonical.collapse(frame(spark, data), **ARGS).collect()))
    assert copies[3] == 3 and copies[4] == 1 and copies[7] == 1 and copies[13] == 2 and sum(copies.values()) == len(data)
    assert canonical.hidden_duplicates(frame(spark, data).limit(0), **ARGS).count() == 0


def test_runs_over_several_partitions(spark):
    """A group with a third of all rows lies in several partitions, and so do groups at their edges."""
    rng = random.Random(2)
    data = [(i, "n", "hot" if i % 3 == 0 else f"u{rng.randrange(60)}", None) for i in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        got = {tuple(r) for r in canonical.hidden_duplicates(frame(spark, data).repartition(5), **ARGS).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    first, want = {}, set()
    for i, _, u, _ in data:
        if u in first:
            want.add((first[u], i))
        first.setdefault(u, i)
    assert got == want


def test_long_and_repeated(spark):
    long = "é " * 100_000
    data = [(1, long, "u", None), (2, long.upper(), "u", None), (2, long, "u", None)]
    assert sorted(tuple(r) for r in canonical.hidden_duplicates(frame(spark, data), **ARGS).collect()) == [(1, 2), (1, 2)]
