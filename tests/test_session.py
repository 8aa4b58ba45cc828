import importlib.util
from pathlib import Path

from quire.session import RANGE, free_name, ranges, shared_dir, spread, stage, sweep, table


def test_stored_tables_lie_in_the_shared_folder(spark):
    assert shared_dir(spark) == spark.sparkContext.getCheckpointDir()
    out = stage(spark.range(3), "probe")
    assert out.count() == 3 and all(shared_dir(spark).split("/")[-1] in f and "/quire/probe-" in f for f in out.inputFiles())


def test_spread_moves_only_small_inputs(spark):
    few, many = spark.range(100).coalesce(1), spark.range(10**9)
    assert spread(few, few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(many, many) is many
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ranges(few) == own and ranges(many) == 8 * 10**9 // RANGE + 1
    assert free_name(spark.range(1).toDF("ID"), "id") == "id_"


def test_entry(spark):
    root = Path(__file__).resolve().parent.parent
    spec = importlib.util.spec_from_file_location("entry_under_test", root / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "p1_found" in entry.queries()
    if Path("/root/testdata/sf0.001").exists():
        assert entry.entry(spark).columns == ["rec_id", "field_name", "pos", "item"]
        assert table(spark, "/root/testdata/sf0.001", "region").count() == 5


def test_swept_tables_are_gone(spark):
    files = stage(spark.range(3), "swept").inputFiles()
    assert all(Path(f.removeprefix("file://")).exists() for f in files)
    sweep(spark)
    assert files and not any(Path(f.removeprefix("file://")).exists() for f in files)
