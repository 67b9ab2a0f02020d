"""Codebook parsing: the line table of the value-label rules, order across
file splits, and decoding."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError

from quire.operators import labels
from quire.sources.files import read_lines


def write(tmp_dir, name, text):
    path = os.path.join(tmp_dir, name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def parse(spark, path, mode="strict"):
    return [tuple(r) for r in labels.read_value_labels(spark, path, mode).collect()]


def test_line_rules(spark, tmp_dir):
    text = '\n'.join([
        '0 orphan',            # value before any heading
        '"yesno":',
        '1 Yes',
        '2-No',
        '10 - Foo',
        '-1 Refused',
        '  3   padded  ',
        '"q": ',
        '1 "quoted" value',
    ]) + '\n'
    got = parse(spark, write(tmp_dir, "cb.txt", text))
    assert got == [
        (None, "0", "orphan"),
        ("yesno", "1", "Yes"),
        ("yesno", "2", "No"),
        ("yesno", "10", "- Foo"),
        ("yesno", "", "1 Refused"),
        ("yesno", "3", "  padded"),
        ("q", "1", "quoted value"),
    ]


def test_strict_rejects_unsplittable(spark, tmp_dir):
    path = write(tmp_dir, "bad.txt", '"h":\n1 ok\n\nFoo\n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        parse(spark, path, "strict")
    assert parse(spark, path, "permissive") == [("h", "1", "ok")]
    rejected = [r["line"] for r in labels.rejected_label_lines(read_lines(spark, path)).collect()]
    assert sorted(rejected) == ["", "Foo"]


def test_python_line_breaks(spark, tmp_dir):
    # \r\n, \r, \x0b and   all end lines for Python's splitlines.
    path = write(tmp_dir, "br.txt", '"a":\r\n1 x\r2 y\x0b3 z 4 w\n')
    assert parse(spark, path) == [("a", "1", "x"), ("a", "2", "y"), ("a", "3", "z"), ("a", "4", "w")]


def test_heading_carried_across_splits(spark, tmp_dir):
    lines = []
    for h in range(6):
        lines.append(f'"set{h}":')
        lines += [f"{i} value number {i} of set {h}" for i in range(400)]
    path = write(tmp_dir, "big.txt", "\n".join(lines) + "\n")
    prev = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        blocks = read_lines(spark, path).select("block").distinct().count()
        got = labels.read_value_labels(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", prev)
    assert blocks > 10
    assert len(got) == 6 * 400
    for r in got:
        assert r["value"].endswith(f"of set {r['vallab'][3:]}")


def test_decode_labels(spark):
    book = spark.createDataFrame([("yn", "1", "Yes"), ("yn", "2", "No"), ("other", "1", "X")],
                                 "vallab string, code string, value string")
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 9), (4, None)], "id int, answer int")
    got = {r["id"]: r["answer_label"] for r in labels.decode_labels(df, "answer", book, "yn").collect()}
    assert got == {1: "Yes", 2: "No", 3: None, 4: None}


def test_signed_codes(spark, tmp_dir):
    path = write(tmp_dir, "signed.txt", '"r":\n-1 Refused\n1-Yes\n10 - Foo\n-2-Unknown\n')
    got = [tuple(r) for r in labels.read_value_labels(spark, path, signed_codes=True).collect()]
    assert got == [("r", "-1", "Refused"), ("r", "1", "Yes"), ("r", "10", "- Foo"), ("r", "-2", "Unknown")]


def test_decode_columns(spark):
    book = spark.createDataFrame([("yn", "1", "Yes"), ("yn", "2", "No"), ("sex", "1", "Male"),
                                  ("sex", "2", "Female"), ("unused", "1", "X")],
                                 "vallab string, code string, value string")
    df = spark.createDataFrame([(1, 1, 2), (2, 2, 1), (3, 3, None)], "id int, q1 int, s int")
    mapping = {"q1": "yn", "s": "sex"}
    want = {1: ("Yes", "Female"), 2: ("No", "Male"), 3: (None, None)}
    out = labels.decode_columns(df, mapping, book)
    got = {r["id"]: (r["q1_label"], r["s_label"]) for r in out.collect()}
    assert got == want
    assert out.columns[:3] == ["id", "q1", "s"]


def _model(text):
    """The line rules, line by line in Python (the spec the parser follows)."""
    import re
    out, current = [], None
    for line in text.splitlines():
        line = line.replace('"', "").strip()
        if line.endswith(":"):
            current = line[:-1]
            continue
        parts = re.split(r"[- ]", line, maxsplit=1)
        if len(parts) == 2:
            out.append((current, parts[0], parts[1]))
    return out


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_WORD = st.text(alphabet="abcXYZ019 -\"'", min_size=0, max_size=8)
_LINE = st.one_of(
    st.builds(lambda w: f'"{w}":', _WORD),
    st.builds(lambda w: f"  {w}:  ", _WORD),
    st.builds(lambda c, sep, v: f"{c}{sep}{v}", st.integers(-5, 99), st.sampled_from([" ", "-", " - ", "  "]), _WORD),
    _WORD,
)


@settings(max_examples=15, deadline=None)
@given(st.lists(_LINE, min_size=1, max_size=30), st.sampled_from(["\n", "\r\n", "\r"]))
def test_parse_matches_line_model(spark, lines, newline):
    import tempfile
    text = newline.join(lines) + newline
    path = tempfile.mkdtemp(prefix="quire-cb-") + "/cb.txt"
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    got = labels.parse_value_labels(read_lines(spark, path), "permissive", keep_position=True)
    got = [(r["vallab"], r["code"], r["value"]) for r in got.orderBy("file", "block", "seq", "sub").collect()]
    assert got == _model(text)


def test_strict_fails_on_count_and_signed_rejects(spark):
    lines = spark.createDataFrame([("f", 0, 0, 0, "h:"), ("f", 0, 1, 0, "1 one"), ("f", 0, 2, 0, "-1")],
                                  "file string, block long, seq long, sub long, line string")
    with pytest.raises(Exception, match="no code separator"):
        labels.parse_value_labels(lines, signed_codes=True).count()
    kept = labels.parse_value_labels(lines, mode="permissive", signed_codes=True).count()
    assert kept + labels.rejected_label_lines(lines, signed_codes=True).count() == 2


def test_conflicting_codes_are_an_error(spark):
    book = spark.createDataFrame([("v", "1", "a"), ("v", "1", "b")], "vallab string, code string, value string")
    with pytest.raises(Exception, match="two labels"):
        labels.decode_labels(spark.createDataFrame([(1,)], "x int"), "x", book, "v").collect()


def test_five_hundred_coded_columns_by_one_join(spark):
    names = [f"q{i}" for i in range(500)]
    df = spark.range(40).select("id", *(((F.col("id") + i) % 4).alias(n) for i, n in enumerate(names)))
    df = df.withColumn("q7", F.when(F.col("id") < 20, F.col("q7")))
    book = spark.createDataFrame([(f"v{k}", str(c), f"label {k} {c}") for k in range(5) for c in range(3)], "vallab string, code string, value string")
    out = labels.decode_columns(df, {n: f"v{i % 5}" for i, n in enumerate(names)}, book)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    got = {r["id"]: r for r in out.select("id", "q0", "q0_label", "q7", "q7_label", "q499_label").collect()}
    assert len(got) == 40 and len(out.columns) == 1001
    for i, r in got.items():
        assert r["q0"] == i % 4 and r["q0_label"] == (f"label 0 {i % 4}" if i % 4 < 3 else None)
        want = (i + 7) % 4 if i < 20 else None
        assert r["q7"] == want and r["q7_label"] == (f"label 2 {want}" if want is not None and want < 3 else None)
        assert r["q499_label"] == (f"label 4 {(i + 499) % 4}" if (i + 499) % 4 < 3 else None)


def test_a_clash_fails_counts_and_projections(spark):
    book = spark.createDataFrame([("v", "1", "a"), ("v", "1", "b"), ("v", "2", "c")], "vallab string, code string, value string")
    df = spark.createDataFrame([(1, 1), (2, 2)], "id int, c int")
    for out in (labels.decode_labels(df, "c", book, "v"), labels.decode_columns(df, {"c": "v"}, book)):
        for run in (out.count, out.select("id").collect, out.collect):
            with pytest.raises(Exception, match="two labels"):
                run()
    assert labels.decode_labels(df.where("c = 2"), "c", book, "v").count() == 1
    empty = labels.decode_columns(df.where("false"), {"c": "v"}, book.where("vallab = 'none'"))
    assert empty.columns == ["id", "c", "c_label"] and empty.count() == 0


def test_labels_and_rejects_in_one_table(spark, tmp_dir):
    path = write(tmp_dir, "mixed.txt", "lost\nsex:\n1 Male\nbad\n2 Female\n\n")
    got = labels.load_value_labels(read_lines(spark, path), f"{tmp_dir}/labels")
    assert (got.n_labels, got.n_rejected) == (2, 3)
    assert sorted(tuple(r) for r in got.labels.collect()) == [("sex", "1", "Male"), ("sex", "2", "Female")]
    assert sorted((r["vallab"] or "", r["line"]) for r in got.rejects.collect()) == [("", "lost"), ("sex", ""), ("sex", "bad")]
