"""Global row numbering, caps, previews and chunk manifests."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import chunks

from conftest import SF001

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def test_row_index_equals_row_number(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    ours = chunks.with_row_index(li, KEYS, num_partitions=7)
    ref = li.withColumn("row_index", F.row_number().over(Window.orderBy(*KEYS)) - 1)
    assert ours.select(*KEYS, "row_index").exceptAll(ref.select(*KEYS, "row_index")).count() == 0
    assert ours.count() == li.count()


def test_row_cap_and_preview(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    capped = chunks.scan_row_cap(li, 1234, order_by=KEYS)
    first = li.orderBy(*KEYS).limit(1234)
    assert capped.count() == 1234 and capped.exceptAll(first).count() == 0
    assert chunks.scan_row_cap(li, 10).count() == 10
    prev = chunks.batch_preview(li, KEYS, batch_size=500, max_batches=3)
    got = {r["batch"]: r["n"] for r in prev.groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 500, 2: 500, 3: 500}


def test_chunk_manifest_invariants(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    n = li.count()
    rows = chunks.chunk_manifest(li, 7000).orderBy("chunk").collect()
    assert [r["chunk"] for r in rows] == list(range(1, len(rows) + 1))
    assert sum(r["rows"] for r in rows) == n
    assert rows[-1]["rows_total"] == n
    assert all(r["rows"] == 7000 for r in rows[:-1]) and 0 < rows[-1]["rows"] <= 7000
    assert all(r["n_columns"] == len(li.columns) for r in rows)
    empty = li.where("false")
    assert chunks.chunk_manifest(empty, 10).count() == 0


def test_row_cap_with_null_keys(spark):
    rows = [(None, 1), (None, None), (1, None), (1, 2), (2, 1), (None, 3), (3, 3), (0, 5)]
    df = spark.createDataFrame(rows, "a int, b int")
    want = sorted(rows, key=lambda r: tuple((v is not None, v or 0) for v in r))
    for n in range(1, len(rows) + 1):
        got = [tuple(r) for r in chunks.scan_row_cap(df, n, order_by=["a", "b"]).collect()]
        assert sorted(got, key=repr) == sorted(want[:n], key=repr), n


def test_row_index_balances_a_hot_key(spark):
    # A third of the rows share one key value (and are identical copies).
    hot = spark.range(3000).selectExpr("CASE WHEN id < 1000 THEN 7 ELSE id END AS k", "'x' AS v")
    idx = chunks.with_row_index(hot, ["k"], num_partitions=6)
    assert sorted(r[0] for r in idx.select("row_index").collect()) == list(range(3000))
    ranks = idx.where("k = 7").agg(F.min("row_index"), F.max("row_index")).collect()[0]
    assert tuple(ranks) == (0, 999)  # the 1,000 copies sort first (all other keys are >= 1000)
    ranged = chunks.range_sorted(hot, ["k"], num_partitions=6)
    sizes = [r["n"] for r in ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 5 and max(sizes) < 1000  # the hot key is cut across partitions


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3)), min_size=1, max_size=60),
       st.integers(1, 7))
def test_row_index_matches_sorted_positions(spark, rows, parts):
    df = spark.createDataFrame(rows, "a int, b int")
    got = sorted((r["a"], r["b"], r["row_index"]) for r in
                 chunks.with_row_index(df, ["a", "b"], num_partitions=parts).collect())
    want = sorted(rows)
    # Positions are 0..n-1 and follow the key order (ties take any order).
    assert sorted(g[2] for g in got) == list(range(len(rows)))
    by_index = [g[:2] for g in sorted(got, key=lambda g: g[2])]
    assert by_index == want


def test_row_cap_with_ties_at_the_edge(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d"), (0, "e")], "k int, v string")
    for n, want_keys in [(1, [0]), (2, [0, 1]), (3, [0, 1, 1]), (4, [0, 1, 1, 1]), (5, [0, 1, 1, 1, 2])]:
        got = sorted(r["k"] for r in chunks.scan_row_cap(df, n, order_by=["k"]).collect())
        assert got == want_keys, n



def test_batches_in_file_order(spark, tmp_dir):
    from quire.sources.files import FILE_POSITION, read_csv, with_file_position

    folder = f"{tmp_dir}/csvs"
    import os
    os.makedirs(folder)
    values = [f"v{i:04d}" for i in range(2500)]
    # Two files; the second holds the later lines.
    for name, chunk in (("a.csv", values[:1300]), ("b.csv", values[1300:])):
        with open(f"{folder}/{name}", "w") as f:
            f.write("v\n" + "\n".join(chunk) + "\n")
    prev = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")  # many splits per file
    try:
        df = with_file_position(read_csv(spark, folder, schema="v string", null_tokens=[]))
        prev_rows = chunks.batch_preview(df, FILE_POSITION, batch_size=100, max_batches=7).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", prev)
    got = sorted((r["row_index"], r["batch"], r["v"]) for r in prev_rows)
    assert [g[2] for g in got] == values[:700]
    assert [g[1] for g in got] == [i // 100 + 1 for i in range(700)]


def _tasks(spark, run):
    """Tasks of the jobs that ``run`` starts."""
    spark.sparkContext.setJobGroup("count-tasks", "")
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("count-tasks"))
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    jobs = set(tracker.getJobIdsForGroup("count-tasks")) - before
    stages = {s for j in jobs for s in tracker.getJobInfo(j).stageIds}
    return sum(tracker.getStageInfo(s).numCompletedTasks for s in stages), out


def _numbered_files(spark, tmp_dir):
    """Six CSV files of 3,000 rows; sizes differ so that scan order is not file order."""
    for i in range(6):
        rows = spark.range(i * 3000, i * 3000 + 3000, 1, 1).selectExpr("id", f"repeat('x', {10 + 7 * i}) AS pad")
        path = f"{tmp_dir}/in/f{i}"
        rows.write.option("header", "true").csv(path)
    return spark.read.schema("id long, pad string").option("header", "true").csv([f"{tmp_dir}/in/f{i}" for i in range(6)])


def test_a_small_preview_reads_one_split(spark, tmp_dir):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = _numbered_files(spark, tmp_dir)
        assert df.rdd.getNumPartitions() > 12
        tasks, got = _tasks(spark, lambda: chunks.batch_preview_file_order(df, batch_size=5, max_batches=4))
        assert tasks == 1
        assert [(r["id"], r["row_index"], r["batch"]) for r in got.collect()] == [(i, i, i // 5 + 1) for i in range(20)]
        tasks, head = _tasks(spark, lambda: chunks.head_of_files(df, 4000))
        assert [r["id"] for r in head.collect()] == list(range(4000)) and tasks < df.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_large_preview_opens_leading_files_only(spark, tmp_dir):
    df = _numbered_files(spark, tmp_dir)
    got = chunks.batch_preview_file_order(df, batch_size=2500, max_batches=5)
    assert sorted((r["id"], r["row_index"], r["batch"]) for r in got.collect()) == [(i, i, i // 2500 + 1) for i in range(12500)]
    rows, offsets = chunks._leading_files(df, 3001)
    assert len({f for f, _, _ in offsets}) == 2 and len(rows.inputFiles()) == 6
    assert rows.select("_file").distinct().count() == 2
    capped = chunks.batch_preview_file_order(df, batch_size=50_000, max_batches=50, row_cap=11_000)
    assert capped.count() == 11_000 and capped.selectExpr("max(id)").first()[0] == 10_999


def test_heads_of_empty_inputs(spark, tmp_dir):
    spark.range(0).write.parquet(f"{tmp_dir}/none")
    none = spark.read.schema("id long").parquet(f"{tmp_dir}/none")
    assert chunks.head_of_files(none, 5).count() == 0
    assert chunks.batch_preview_file_order(none).count() == 0
    assert chunks.batch_preview_file_order(none, batch_size=2, max_batches=2).count() == 0


def test_nth_key_by_rank_selection(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    rows = [(None if rng.random() < 0.05 else int(rng.integers(0, 40)) if rng.random() < 0.5 else int(rng.integers(0, 10 ** 6)),
             None if rng.random() < 0.1 else float(rng.integers(0, 5)), "s" * int(rng.integers(0, 3))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a long, b double, c string").repartition(5).cache()
    keys = ["a", "b", "c"]
    want = sorted(rows, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r[:2]) + (r[2],))
    for n in (1, 2, 700, 1500, 2999, 3000):
        key, below, upto = chunks.nth_key(df, n, keys, sample=64)
        assert key == want[n - 1]
        assert (below, upto) == (want.index(key), len(want) - want[::-1].index(key))
    assert chunks.nth_key(df, 3001, keys) is None and chunks.nth_key(df, 0, keys) is None
    hot = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k")
    assert chunks.nth_key(hot, 900, ["k"], sample=100)[0] == (7,)
    for n in (3, 900, 2500):
        got = chunks.scan_row_cap(hot, n, order_by=["k"])
        assert got.count() == n
        assert [r["k"] for r in got.orderBy("k").collect()] == [r["k"] for r in hot.orderBy("k").limit(n).collect()]


def test_row_cap_has_no_range_exchange(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    order = KEYS + ["l_quantity", "l_extendedprice"]
    plan = chunks.scan_row_cap(li, 25_000, order_by=order)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Sort" not in plan and "PushedFilters: [Or(IsNull(l_orderkey)" in plan
