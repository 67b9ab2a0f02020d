"""Section maps, prefix rules, pruned projections and wide tables."""

import pytest

from quire.operators import clean, sections
from quire.plans.survey import SECTION_RANGES, SURVEY_KEYS, survey_prefix_rules

from conftest import SF001


def memberships(spark, names, rules):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    out = {}
    for r in sections.sections_by_prefix(df, rules).collect():
        out.setdefault(r["name"], set()).add(r["section"])
    return out


def test_survey_prefix_rules(spark):
    names = ["D5", "D1A__1", "RESPONDENT", "Sex", "NHM", "Latitude", "secB1", "D13_7", "E1iA",
             "A07", "county", "Interview_Status", "K1", "M12_6"]
    got = memberships(spark, names, survey_prefix_rules())
    assert got["D5"] == {"D1", "D"}
    assert got["D1A__1"] == {"D1"}
    assert got["RESPONDENT"] == {"A", "R"}
    assert got["Sex"] == {"A", "ST"}
    assert got["NHM"] == {"A", "N"}
    assert got["Latitude"] == {"L"}
    assert "secB1" not in got
    assert got["D13_7"] == {"D1"}
    assert got["E1iA"] == {"E"}
    assert got["A07"] == {"A"} and got["county"] == {"A"}
    assert got["Interview_Status"] == {"I"}
    assert got["K1"] == {"KM"} and got["M12_6"] == {"KM"}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r["name"] for r in sections.unmatched_by_prefix(df, survey_prefix_rules()).collect()] == ["secB1"]


def test_ranges_and_coverage():
    cols = ["k1", "k2", "a1", "a2", "b1", "x", "c1", "c2"]
    smap = sections.sections_from_ranges(cols, [("A", "a1", "a2"), ("B", "b1", "b1"), ("C", "c1", "c2"),
                                                ("AB", "a2", "b1")])
    assert smap == {"A": ["a1", "a2"], "B": ["b1"], "C": ["c1", "c2"], "AB": ["a2", "b1"]}
    cov = sections.coverage(cols, smap, ["k1", "k2"])
    assert cov["unassigned"] == ["x"]
    assert cov["multi_assigned"] == ["a2", "b1"]
    with pytest.raises(KeyError):
        sections.sections_from_ranges(cols, [("Z", "nope", "x")])


def test_a_moved_column_is_an_error(spark):
    ranges, widths = [("A", "a1", "a2"), ("B", "b1", "b1")], {"A": 2, "B": 1}
    assert sections.sections_from_ranges(["k", "a1", "a2", "b1"], ranges, widths=widths, disjoint=True) == {"A": ["a1", "a2"], "B": ["b1"]}
    with pytest.raises(ValueError, match="section A has 3"):
        sections.sections_from_ranges(["k", "a1", "b1", "a2"], ranges, widths=widths)
    with pytest.raises(ValueError, match="several sections"):
        sections.sections_from_ranges(["k", "a2", "a1", "b1"], [("A", "a1", "a1"), ("B", "a2", "b1")], disjoint=True)
    rows = sections.section_widths(spark, ["k", "a1", "b1", "a2"], [*ranges, ("C", "a2", "a1"), ("D", "x", "b1")], widths | {"C": 1, "D": 1})
    assert [(r["section"], r["found"], r["status"]) for r in rows.orderBy("run").collect()] == [
        ("A", 3, "moved"), ("B", 1, "ok"), ("C", -1, "reversed"), ("D", None, "missing")]
    cover = sections.section_coverage(spark, ["k", "a1", "b1", "a2", "z"], ranges, ["k"]).orderBy("position").collect()
    assert [(r["name"], r["sections"], r["status"]) for r in cover] == [
        ("k", 0, "key"), ("a1", 1, "ok"), ("b1", 2, "doubled"), ("a2", 1, "ok"), ("z", 0, "uncovered")]


def test_survey_widths_add_up():
    from quire.plans.survey import SECTION_RANGES, SECTION_WIDTHS

    assert [s for s, _, _ in SECTION_RANGES] == list(SECTION_WIDTHS) and sum(SECTION_WIDTHS.values()) == 3799


def test_survey_ranges_are_contiguous_and_disjoint():
    # A synthetic header that follows the survey's order at the boundaries.
    assert len(SECTION_RANGES) == 33
    assert len({s for s, _, _ in SECTION_RANGES}) == 33
    assert SURVEY_KEYS == ["interview__key", "interview__id"]


def test_project_section_prunes_scan(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    df = sections.project_section(li, ["l_orderkey", "l_linenumber"], ["l_tax", "l_quantity"])
    assert df.columns == ["l_orderkey", "l_linenumber", "l_tax", "l_quantity"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    read_schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "l_shipdate" not in read_schema and "l_extendedprice" not in read_schema
    assert all(c in read_schema for c in df.columns)


def test_split_and_rejoin_round_trip(spark):
    cust = spark.read.parquet(f"{SF001}/customer.parquet")
    smap = {"place": ["c_name", "c_nationkey"], "money": ["c_acctbal", "c_mktsegment"]}
    parts = sections.split_sections(cust, ["c_custkey"], smap)
    joined = parts["place"].join(parts["money"], "c_custkey").select(*cust.columns)
    assert joined.exceptAll(cust).count() == 0 and cust.exceptAll(joined).count() == 0


def test_wide_table(spark, tmp_dir):
    width = 3816
    names = ["interview__key", "interview__id"] + [f"V{i}" for i in range(width - 2)]
    exprs = ["concat('k', id) AS interview__key", "cast(id AS string) AS interview__id"]
    exprs += [f"CASE WHEN id % 7 = 0 THEN NULL ELSE (id * {i % 13}) % 5 END AS V{i}" for i in range(width - 2)]
    wide = spark.range(50).selectExpr(*exprs)
    assert wide.columns == names
    text = clean.stringify_cells(wide)
    path = f"{tmp_dir}/wide"
    text.write.parquet(path)
    back = spark.read.parquet(path)
    assert len(back.columns) == width
    smap = sections.sections_from_ranges(names, [("S1", "V0", "V569"), ("S2", "V570", "V3813")])
    head = sections.section_head(back, ["interview__key", "interview__id"], smap["S1"], 5)
    plan = head._jdf.queryExecution().executedPlan().toString()
    assert "V570" not in plan.split("ReadSchema: ")[1].split("\n")[0]
    rows = head.collect()
    assert len(rows) == 5 and len(rows[0]) == 572
    assert rows[0]["V0"] == ""  # id 0: 0 % 7 == 0 -> null -> ''


def test_section_sizes_plus_unassigned_equal_width():
    cols = ["interview__key", "interview__id"] + [f"X{i}" for i in range(40)]
    ranges = [("s1", "X0", "X9"), ("s2", "X10", "X24"), ("s3", "X30", "X39")]
    smap = sections.sections_from_ranges(cols, ranges)
    cov = sections.coverage(cols, smap, ["interview__key", "interview__id"])
    assert sum(len(v) for v in smap.values()) + len(cov["unassigned"]) + 2 == len(cols)
    assert cov["unassigned"] == [f"X{i}" for i in range(25, 30)] and cov["multi_assigned"] == []


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_NAME = st.text(alphabet="ABDRS1_x", min_size=1, max_size=5)
_RULE = st.tuples(st.sampled_from(["s1", "s2", "s3"]), st.sampled_from(["prefix", "name", "exclude"]),
                  st.text(alphabet="ABDRS1_", min_size=1, max_size=3))


@settings(max_examples=10, deadline=None)
@given(st.lists(_NAME, min_size=1, max_size=25, unique=True), st.lists(_RULE, min_size=1, max_size=8))
def test_prefix_sections_match_model(spark, names, rules):
    def model(name):
        out = set()
        for sec in {r[0] for r in rules}:
            inc = any(name.startswith(p) for s, k, p in rules if s == sec and k == "prefix") or \
                any(name == p for s, k, p in rules if s == sec and k == "name")
            exc = any(name.startswith(p) for s, k, p in rules if s == sec and k == "exclude")
            if inc and not exc:
                out.add(sec)
        return out

    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {}
    for r in sections.sections_by_prefix(df, rules).collect():
        got.setdefault(r["name"], set()).add(r["section"])
    assert got == {n: model(n) for n in names if model(n)}


def test_show_section_heads(spark, capsys):
    from quire.plans.convert import show_section_heads

    cust = spark.read.parquet(f"{SF001}/customer.parquet")
    show_section_heads(cust, ["c_custkey"], {"place": ["c_name", "c_nationkey"], "money": ["c_acctbal"]}, 3)
    out = capsys.readouterr().out
    assert "-- section place (2 columns)" in out and "-- section money (1 columns)" in out
    assert "Customer#000000000" in out
