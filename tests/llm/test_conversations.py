"""Conversation repair against a shortest-path version, and on edge cases."""

from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from .brute import conversation, damaged, digest
from conftest import SF001
from quire.llm import conversation_repair as repair

DDL = "conv_id long, turn long, role string, text string, key string, pos long, kind int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], DDL)


def check(got, rows, faults):
    found = {r["conv_id"]: tuple(r)[1:] for r in got}
    convs = damaged(rows) if faults else {}
    if not faults:
        for c, t, role, text in rows:
            convs.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    assert len(got) == len(found) == len(convs)
    for c, mine in convs.items():
        want, made = conversation(mine)
        assert found[c] == (*want, digest(made)), (c, mine)


def edge_rows(rng):
    texts = ["Hello there.", "No end", "", " \t", "What? ", None, "Yes!", "x" * 5000 + ".", "end. "]
    roles = ["user", "assistant", "system", "tool", None, "", "u"]
    rows = [(int(c), None if rng.random() < 0.1 else int(rng.integers(0, 8)), roles[rng.integers(0, len(roles) - 3 * (rng.random() < 0.7))],
             texts[rng.integers(0, len(texts))]) for c in rng.integers(0, 60, 300)]
    return rows + [(None, 1, "user", "Hi."), (None, None, "assistant", "Hi."), (77, 0, "system", "Only."), (78, None, None, None)] + [(79, 3, "user", "Same.")] * 4


@pytest.mark.parametrize("faults", [False, True])
def test_repair_equals_shortest_path(spark, faults):
    rows = edge_rows(np.random.default_rng(int(faults)))
    check(repair.repair(frame(spark, rows), damaged=faults).collect(), rows, faults)


def test_long_conversations_are_cut_and_folded(spark):
    rng = np.random.default_rng(3)
    rows = [(int(c), t, ["user", "assistant", "system"][rng.integers(0, 3)], f"{rng.integers(0, 40)}{'.' * int(rng.integers(0, 2))}")
            for c, n in enumerate([70, 33, 8, 1, 2]) for t in range(n)]
    check(repair.repair(frame(spark, rows), piece_bits=2, fold=2).collect(), rows, False)


def test_query_on_the_whole_table(spark):
    table = pq.read_table(f"{SF001}/conversations.parquet").select(["conv_id", "turn", "role", "text"])
    check(repair.query(spark, SF001).collect(), [tuple(r.values()) for r in table.to_pylist()], True)


def test_repaired_rows(spark):
    rows = edge_rows(np.random.default_rng(5))
    got = {}
    for r in sorted(repair.repaired(frame(spark, rows)).collect(), key=lambda r: r["place"]):
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    for c, mine in convs.items():
        assert got.get(c, []) == conversation(mine)[1]


def test_empty_table(spark):
    assert repair.repair(frame(spark, []), damaged=True).count() == 0


def test_re_pair_spells_the_input_and_leaves_no_repeat(rng=np.random.default_rng(6)):
    for n, top in ((0, 3), (1, 3), (2, 1), (3, 1), (9, 1), (500, 2), (4000, 16), (3000, 1)):
        symbols, ends = rng.integers(0, top, n), rng.random(n) < 0.05
        if n:
            ends[-1] = True
        seq, stops, rules = repair.re_pair(symbols, ends, 16)

        def spell(s):
            return [s] if s < 16 else spell(rules[s - 16][0]) + spell(rules[s - 16][1])
        assert sum((spell(s) for s in seq.tolist()), []) == symbols.tolist() and stops.sum() == ends.sum()
        last, count = {}, Counter()
        for i in range(len(seq) - 1):
            p = (seq[i], seq[i + 1])
            if not stops[i] and last.get(p, -2) < i - 1:
                count[p] += 1
                last[p] = i
        assert not count or max(count.values()) < 2


def test_products_are_shared_by_rules(rng=np.random.default_rng(7)):
    letters = "".join(chr(65 + int(x)) for x in rng.integers(0, 16, 40))
    whole = next(repair.solve_block(["=" + letters]))
    parts = {r[0]: r for r in repair.solve_block(["+" + letters[:20], "+" + letters[20:], "=" + letters])}
    assert parts["=" + letters] == whole
    m = repair.IDENTITY[:4]
    for cut in ("+" + letters[:20], "+" + letters[20:]):
        m = repair.product(m, [None if c < 0 else (c, repair.Rope(t)) for c, t in zip(parts[cut][6], parts[cut][7])])
    m = repair.product(m, repair.INSERTS)
    assert [e and (e[0], e[1].spell()) for e in m] == [None if c < 0 else (c, t) for c, t in zip(whole[6], whole[7])]
