"""Session helpers: shared folder, lineage cuts, small-file parallelism."""

from askbatch.session import checkpoint_dir, checkpointed, ensure_parallelism


def test_lineage_cut_reads_a_table_in_the_shared_folder(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS x").filter("id % 3 = 0")
    cut = checkpointed(df)
    files = cut.inputFiles()
    assert files and all(checkpoint_dir(spark).rstrip("/").split(":")[-1] in f for f in files)
    assert sorted(r.id for r in cut.collect()) == sorted(r.id for r in df.collect())
    # the plan of the cut frame starts at the written table, not at range()
    assert "Range" not in cut._jdf.queryExecution().optimizedPlan().toString()


def test_parallelism_only_for_under_split_scans(spark):
    one = spark.range(10).coalesce(1)
    assert ensure_parallelism(one, 4).rdd.getNumPartitions() == 4
    many = spark.range(10).repartition(8)
    assert ensure_parallelism(many, 4).rdd.getNumPartitions() == 8


def test_broadcast_check_counts_bytes_not_only_rows(spark):
    from askbatch.session import fits_broadcast
    few_long = spark.createDataFrame([("x" * 100_000,)] * 20, "s string")
    assert fits_broadcast(few_long, max_rows=1000, max_bytes=10 << 20)
    assert not fits_broadcast(few_long, max_rows=1000, max_bytes=1 << 20)
    assert not fits_broadcast(few_long, max_rows=10, max_bytes=10 << 20)
    assert not fits_broadcast(few_long, max_rows=0)
