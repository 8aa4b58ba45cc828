from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quire.llm import frequency

SCHEMA = "record bigint, field_name string, term string"


def brute(data, records, least=3, share=0.2):
    occ, held = Counter(), defaultdict(set)
    for r, f, t in data:
        if t is not None:
            occ[f, t] += 1
            held[f, t].add(r)
    mark = lambda n: "rare" if n < least else "common" if n > share * records else None
    return {(f, t, occ[f, t], len(held[f, t]), mark(len(held[f, t]))) for f, t in occ}


def test_against_brute_force(spark, monkeypatch):
    data = [(i // 3, "f" if i % 2 else "g", ["hot", f"t{i % 17}", f"rare{i}", None][i % 4]) for i in range(900)]
    data.sort(key=lambda r: (r[1], r[0]))
    data += [(1000, "f", "hot"), (1000, "f", "hot"), (1000, "f", "")]
    df = spark.createDataFrame(data, SCHEMA).coalesce(1)
    want = brute(data, 400)
    assert {tuple(r) for r in frequency.term_frequencies(df, 400).collect()} == want
    assert frequency.term_frequencies(df.limit(0), 0).count() == 0


def test_blocks_end_within_a_record(spark):
    """A block's end between two rows of one record must not count the record twice."""
    import pyarrow as pa

    class Frame:
        def mapInArrow(self, f, _):
            batches = [pa.record_batch({"r": pa.array([1, 1]), "f": ["a", "a"], "t": ["x", "y"]}), pa.record_batch({"r": pa.array([1, 2]), "f": ["a", "a"], "t": ["x", "x"]})]
            return [r for b in f(batches) for r in zip(*(c.to_pylist() for c in b.columns))]

    old, frequency.BLOCK_TERMS = frequency.BLOCK_TERMS, 1
    try:
        total = Counter()
        for f, t, n, held in frequency.blocks(Frame()):
            total[t, "n"] += n
            total[t, "held"] += held
    finally:
        frequency.BLOCK_TERMS = old
    assert total == {("x", "n"): 3, ("x", "held"): 2, ("y", "n"): 1, ("y", "held"): 1}


def test_many_terms_over_ranges(spark):
    n = 3 * frequency.SPAN + 5
    df = spark.range(n).select(F.col("id").alias("record"), F.lit("f").alias("field_name"), F.concat(F.lit("t"), F.col("id")).alias("term"))
    out = frequency.term_frequencies(df, n)
    assert out.count() == n and out.filter("occurrences = 1 and records = 1 and mark = 'rare'").count() == n


def test_one_width(spark):
    df = spark.createDataFrame([("\uff21\uff22c",), (None,), ("Cafe\u0301",)], "t string")
    assert [r[0] for r in df.select(frequency.one_width("t")).collect()] == ["abc", None, "caf\u00e9"]
