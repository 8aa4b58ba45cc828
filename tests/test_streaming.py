from pyspark.sql import functions as F

from quire.operators.tables import late_updates
from quire.streaming import records


def write(spark, path, rows, schema, parts=3):
    for k in range(parts):
        spark.createDataFrame(rows[k::1][: len(rows)] if parts == 1 else rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(path)


def test_accepted_updates_are_the_batch_form(spark, tmp_path):
    schema = "k string, t bigint, n bigint, p string"
    data = [("ab"[i % 2], (i * 7) % 11, i, f"p{i}") for i in range(60)]
    write(spark, str(tmp_path / "in"), data, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = records.latest_updates(stream, "k", "t", "n", "p").writeStream.format("memory").queryName("accepted").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.key, r.n) for r in spark.table("accepted").collect()}
    df = spark.createDataFrame(data, schema).withColumnsRenamed({"t": "updated_at"})
    late = {(r.k, r.n) for r in late_updates(df, ["k"], "n").collect()}
    assert got == {(k, n) for k, _, n, _ in data} - late and late


def test_refresh_adds_only_what_is_new(spark, tmp_path):
    schema = "s string, id string, at bigint"
    store = str(tmp_path / "store")
    one = spark.createDataFrame([("f", "1", 5), ("f", "1", 4), ("f", None, 1), ("f", "2", 1)], schema)
    assert records.refresh_store(one, store, ["s", "id"], ["at"]) == 2
    assert records.refresh_store(one, store, ["s", "id"], ["at"]) == 0
    two = spark.createDataFrame([("f", "2", 9), ("g", "2", 9)], schema)
    assert records.refresh_store(two, store, ["s", "id"], ["at"]) == 1
    assert sorted(tuple(r) for r in spark.read.parquet(store).collect()) == [("f", "1", 4), ("f", "2", 1), ("g", "2", 9)]


def test_foreach_batch_and_counts(spark, tmp_path):
    schema = "s string, id string, at timestamp, read boolean"
    rows = spark.sql("select 's' s, cast(id % 5 as string) id, timestamp_seconds(id) at, cast(null as boolean) read from range(30)")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    new = []
    q = stream.writeStream.foreachBatch(lambda b, _: new.append(records.refresh_store(b, str(tmp_path / "store"), ["s", "id"], ["at"]))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(new) == 5 and spark.read.parquet(str(tmp_path / "store")).count() == 5
    u = records.unread_counts(rows.withColumn("read", F.col("id") == "0"), "s").first()
    assert (u.entries, u.unread) == (30, 24)


def test_first_arrivals(spark, tmp_path):
    schema = "s string, id string, at timestamp"
    spark.sql("select 's' s, case when id % 5 = 4 then null else cast(id % 5 as string) end id, timestamp_seconds(id) at from range(30)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = records.first_arrivals(stream, ["s", "id"], "at", "1 hour").writeStream.format("memory").queryName("first").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("first").count() == 4
