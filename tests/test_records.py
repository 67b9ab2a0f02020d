"""CSV records with line breaks in cells, against Python's csv module."""

import csv

import pytest

from quire.operators import chunks, sections
from quire.plans.convert import csv_to_parquet
from quire.sources import read_csv_records

NASTY = ["plain", "a\nb", "a\rb", "a\r\nb", 'say "x"', ",", "", "\n", 'q"\n"q', " padded ", "é\n\nü"]


def _write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator=end).writerows(rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_cells_with_line_breaks(spark, tmp_dir, end):
    rows = [[str(i), c, NASTY[-1 - i]] for i, c in enumerate(NASTY)]
    _write(f"{tmp_dir}/a.csv", [["id", "x", "y"], *rows], end)
    got = read_csv_records(spark, f"{tmp_dir}/a.csv")
    assert got.columns == ["id", "x", "y"]
    assert [list(r) for r in got.collect()] == [[c or None for c in r] for r in rows]  # empty cells are null


def test_quoted_cell_over_several_splits_keeps_order(spark, tmp_dir):
    rows = [[str(i), ("long\n" * 900 if i == 7 else f"l{i}\nr")] for i in range(60)]
    _write(f"{tmp_dir}/a.csv", [["id", "x\ny"], *rows])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        df = read_csv_records(spark, f"{tmp_dir}/a.csv", schema="id int, x string")
        assert [(r["id"], r["x"]) for r in df.collect()] == [(int(a), b) for a, b in rows]
        csv_to_parquet(spark, f"{tmp_dir}/a.csv", f"{tmp_dir}/out")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    back = spark.read.parquet(f"{tmp_dir}/out")
    assert sorted(tuple(r) for r in back.collect()) == sorted(map(tuple, rows))


def test_quotes_inside_unquoted_cells_open_nothing(spark, tmp_dir):
    rows = ['1,5" pipe', '2,"a\nb"', '3,6" and 7" pipe', '4,"say ""x""\n"', '5,8"', '6,""', '7,9" ""', *(f'{i},{i}" x' for i in range(8, 200))]
    with open(f"{tmp_dir}/a.csv", "w", newline="") as f:
        f.write("\n".join(["id,x", *rows]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "64"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = [tuple(r) for r in read_csv_records(spark, f"{tmp_dir}/a.csv", schema="id int, x string").collect()]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert [i for i, _ in got] == list(range(1, 200))
        assert [x for _, x in got[:7]] == ['5" pipe', "a\nb", '6" and 7" pipe', 'say "x"\n', '8"', None, '9" ""']


def test_files_must_share_their_header(spark, tmp_dir):
    _write(f"{tmp_dir}/a.csv", [["x", "y"], ["1", "2"]])
    _write(f"{tmp_dir}/b.csv", [["x", "y"], ["3", "4"]])
    assert [tuple(r) for r in read_csv_records(spark, tmp_dir).collect()] == [("1", "2"), ("3", "4")]
    _write(f"{tmp_dir}/c.csv", [["y", "x"], ["20", "10"]])
    with pytest.raises(Exception, match="another header"):
        read_csv_records(spark, tmp_dir).count()


def test_null_tokens_and_types(spark, tmp_dir):
    _write(f"{tmp_dir}/a.csv", [["n", "t"], ["1", "#NULL!"], ["NA", "b"], ["x", "NA"]])
    one = read_csv_records(spark, f"{tmp_dir}/a.csv", schema="n int, t string")
    assert [tuple(r) for r in one.collect()] == [(1, None), (None, "b"), (None, "NA")]
    two = read_csv_records(spark, f"{tmp_dir}/a.csv", schema="n int, t string", null_tokens=["#NULL!", "NA"])
    assert two.schema == one.schema
    assert [tuple(r) for r in two.collect()] == [(1, None), (None, "b"), (None, None)]


def test_empty_and_header_only_files(spark, tmp_dir):
    _write(f"{tmp_dir}/a.csv", [["n", "t"]])
    got = read_csv_records(spark, f"{tmp_dir}/a.csv")
    assert got.columns == ["n", "t"] and got.count() == 0


def test_file_order_without_a_sort(spark, tmp_dir):
    df = spark.range(5000).selectExpr("5000 - id AS k", "id AS v")
    df.repartitionByRange(3, "v").sortWithinPartitions("v").write.parquet(f"{tmp_dir}/t")
    src = spark.read.parquet(f"{tmp_dir}/t")
    indexed = chunks.with_file_index(src)
    assert indexed.where("row_index != v").count() == 0 and indexed.count() == 5000
    assert "rangepartitioning" not in indexed._jdf.queryExecution().toString().lower()
    some = chunks.batch_preview_file_order(src, batch_size=100, max_batches=3, row_cap=250)
    assert sorted((r["v"], r["batch"]) for r in some.collect()) == [(i, i // 100 + 1) for i in range(250)]
    assert [r["v"] for r in sections.section_head(src, ["k"], ["v"], 3, file_order=True).collect()] == [0, 1, 2]
    assert [r["k"] for r in sections.section_head(src, ["k"], ["v"], 3).collect()] == [1, 2, 3]


def test_an_open_quote_is_an_error(spark, tmp_dir):
    with open(f"{tmp_dir}/a.csv", "w") as f:
        f.write('id,x\n1,ok\n2,"never closed\n' + "".join(f"{i},line\n" for i in range(3, 400)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "256"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            with pytest.raises(Exception, match="more than 1000 characters"):
                read_csv_records(spark, f"{tmp_dir}/a.csv", max_record=1000).count()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_no_line_is_exchanged(spark, tmp_dir, monkeypatch):
    from quire.sources import records

    rows = [[str(i), f"first {i}\nsecond, \"quoted\"\n\nlast"] for i in range(2000)]
    _write(f"{tmp_dir}/a.csv", [["id", "x"], *rows])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        df = read_csv_records(spark, f"{tmp_dir}/a.csv")
        assert [list(r) for r in df.collect()] == rows
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hash" not in plan and "Exchange range" not in plan
        # Rests longer than the first pass keeps are read again.
        monkeypatch.setattr(records, "MAX_REST", 0)
        found = records.read_records(spark, f"{tmp_dir}/a.csv").orderBy("file", "block", "seq").collect()
        assert [r["record"].split(",", 1)[0].strip('"') for r in found] == ["id", *(r[0] for r in rows)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
