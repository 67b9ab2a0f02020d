"""Cheapest repair of conversations by a grammar-compressed dynamic program.

The rows of a conversation become symbols (role initial and first fault), cut
into pieces of bounded length. Distinct pieces are put into blocks; Re-Pair names
the repeated pairs of a block, and each symbol, then each rule, gets one min-plus
transfer matrix over the states of the wanted role pattern. An entry is the least
cost and a rope of the edits, the product of the two symbols of the rule, made
once and shared by every conversation in which the rule occurs. Pieces join back
to their conversations, those of a long conversation are multiplied in rounds,
and the edits are applied to the rows in one pass that holds a batch at a time.

States: 0 nothing kept yet, 1 after the system row, 2 after a user row, 3 after
an assistant row; 0 and 3 may end. Two edit texts of one cost between two states
never begin one another (that would be an insert for nothing), so the ASCII-least
text of a product is the product of the ASCII-least texts.

Scale: rows are ordered by a range sort without their texts, so a conversation
with a third of all rows is many partitions; faults, pieces and grammars never
need a whole conversation. Only the digest of a repaired conversation, which is
sequential by its definition, reads the rows of one conversation in one task, as
a stream.

Defined results: null conv_id is a conversation of its own; null roles and texts
are one blank; rows of equal turn are ordered by role, then by the SHA-256 of
their text; repeated rows are duplicates of the first; an empty table gives no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batched, joined_back, materialize, on_workers, read_table

#: Rows of a piece (as a power of two) and pieces multiplied at a time.
PIECE_BITS, FOLD = 12, 64
#: Symbols of a grammar block.
BLOCK_SYMBOLS = 1 << 16
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
STATES = 4
INITIALS, FAULTS = "suax", ("", "blank", "duplicate", "truncated")
LEGAL = {"su", "ua", "au"}
_SPACE = "' \\t\\n\\u000B\\f\\r'"
_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_SOLVED = f"key string, count long, {', '.join(f'{c} long' for c in _COUNTS)}, ends string, costs array<long>, audits array<string>"


def named(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, nulls in the last two as one blank."""
    on_workers(rows.sparkSession)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that crc32 of ``conv_id:turn`` modulo 20 asks for: 0
    drops the row, 1 empties it, 2 takes its ends of sentence, 3 repeats it, 4
    makes it a user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = named(conversations).withColumn("_kind", F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20)
    times = F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1)
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


class Rope:
    """A text as a tree of its parts, spelt when it is needed."""

    __slots__ = ("parts", "text")

    def __init__(self, text: str | None, parts: tuple | None = None):
        self.text, self.parts = text, parts

    def __add__(self, other: Rope) -> Rope:
        return Rope(None, (self, other))

    def spell(self) -> str:
        if self.text is None:
            out, todo = [], [self]
            while todo:
                r = todo.pop()
                if r.text is not None:
                    out.append(r.text)
                else:
                    todo += r.parts[::-1]
            self.text, self.parts = "".join(out), None
        return self.text


def better(a: tuple | None, b: tuple | None) -> tuple | None:
    """The entry of least cost, then of ASCII-least edits."""
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if a[1].spell() <= b[1].spell() else b


def product(a: list, b: list) -> list:
    """Min-plus product of matrices as flat lists; ``a`` may have fewer rows."""
    out: list = [None] * len(a)
    for i in range(0, len(a), STATES):
        for k in range(STATES):
            left = a[i + k]
            if left is not None:
                for j in range(STATES):
                    right = b[STATES * k + j]
                    if right is not None:
                        have, cost = out[i + j], left[0] + right[0]
                        if have is None or cost <= have[0]:
                            out[i + j] = better(have, (cost, left[1] + right[1]))
    return out


def _steps(edits: list[tuple[int, int, int, str]]) -> list:
    out: list = [None] * STATES ** 2
    for a, b, cost, text in edits:
        out[STATES * a + b] = better(out[STATES * a + b], (cost, Rope(text)))
    return out


#: Any inserts between two rows (going round once more never pays), and none.
_NONE = [(s, s, 0, "") for s in range(STATES)]
_TO_USER, _TO_ASSISTANT = [(s, 2) for s in (0, 1, 3)], [(2, 3)]
INSERTS = product(*[_steps(_NONE + [(a, b, INSERT, "I") for a, b in _TO_USER + _TO_ASSISTANT])] * 2)
IDENTITY = _steps(_NONE)


def symbol_matrix(initial: str, fault: str) -> list:
    """Inserts before a row, then its own edit."""
    edits = [(s, s, DELETE, "D") for s in range(STATES)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        kept = {"s": [(0, 1)], "u": _TO_USER, "a": _TO_ASSISTANT, "x": []}[initial]
        edits += [(a, b, more, "K") for a, b in kept]
        edits += [(a, b, REROLE + more, "R") for a, b in _TO_USER + _TO_ASSISTANT]
    return product(INSERTS, _steps(edits))


SYMBOLS = [symbol_matrix(i, f) for i in INITIALS for f in FAULTS]


def _apart(places: np.ndarray) -> np.ndarray:
    """Sorted places of one pair without overlaps, from the left of each run."""
    if not len(places):
        return places
    at = np.arange(len(places))
    begin = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(places) > 1]), at, 0))
    return places[(at - begin) % 2 == 0]


def re_pair(symbols: np.ndarray, ends: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Name repeated pairs until none is left that occurs twice without overlap.
    Pairs never cross an end. Returns the sequence, its ends and the rules; rule r
    is symbol ``first + r``. A round takes the pairs at least half as frequent as
    the most frequent one where they do not overlap a more frequent one of them,
    or, if that repeats none, the first pair by frequency that can be repeated."""
    seq, ends, rules = symbols.astype(np.int64), ends.copy(), []
    while len(seq) > 1:
        base = first + len(rules)
        pair = np.where(ends[:-1], -1, seq[:-1] * base + seq[1:])
        value, where, count = np.unique(pair, return_inverse=True, return_counts=True)
        count[value < 0] = 0
        if count.max() < 2:
            break
        order = np.argsort(-count, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        rank = np.where(count[where] * 2 > count.max(), place[where], len(order))
        around = np.concatenate([[len(order)], rank, [len(order)]])
        wins = (rank < len(order)) & (rank <= around[:-2]) & (rank <= around[2:])
        places = _apart(np.flatnonzero(wins))
        chosen, uses = np.unique(where[places], return_counts=True)
        if not len(uses) or uses.max() < 2:
            tries = (_apart(np.flatnonzero(where == i)) for i in order if count[i] > 1)
            places = next((p for p in tries if len(p) > 1), None)
            if places is None:
                break
            chosen, uses = np.unique(where[places], return_counts=True)
        chosen = chosen[uses > 1]
        places = places[np.isin(where[places], chosen)]
        named = np.searchsorted(chosen, where[places])
        pairs = value[chosen]
        rules += zip((pairs // base).tolist(), (pairs % base).tolist())
        seq[places] = base + named
        ends[places] = ends[places + 1]
        left = np.ones(len(seq), bool)
        left[places + 1] = False
        seq, ends = seq[left], ends[left]
    return seq, ends, rules


def solve_block(keys: list[str]) -> Iterator[tuple]:
    """Results of the pieces ``=symbols`` (a whole conversation: one row of the
    matrix, from the start, inserts at the end included) or ``+symbols`` (part
    of one: the whole matrix)."""
    texts = [k[1:].encode() for k in keys]
    data = np.frombuffer(b"".join(texts), np.uint8) - 65
    ends = np.zeros(len(data), bool)
    ends[np.cumsum([len(t) for t in texts]) - 1] = True
    seq, ends, rules = re_pair(data, ends, len(SYMBOLS))
    matrices = list(SYMBOLS)
    for a, b in rules:
        matrices.append(product(matrices[a], matrices[b]))
    stops = np.flatnonzero(ends) + 1
    for key, lo, hi in zip(keys, [0, *stops[:-1]], stops):
        whole = key[0] == "="
        m = IDENTITY[:STATES] if whole else IDENTITY
        for s in seq[lo:hi].tolist():
            m = product(m, matrices[s])
        if whole:
            m = product(m, INSERTS)
        codes = [ord(c) - 65 for c in key[1:]]
        faults = [c % len(FAULTS) for c in codes]
        heads = "".join(INITIALS[c // len(FAULTS)] for c in codes)
        illegal = sum(heads[i:i + 2] not in LEGAL for i in range(len(heads) - 1))
        yield (key, *(faults.count(f) for f in (1, 2, 3)), illegal, heads[0] + heads[-1],
               [-1 if e is None else e[0] for e in m], [None if e is None else e[1].spell() for e in m])


_SOLVED_ARROW = pa.schema([("key", pa.string()), ("count", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("ends", pa.string()),
                           ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        keys: list[str] = []
        counts: list[int] = []
        size = 0
        for b in batches:
            for key, n in zip(b.column("key").to_pylist(), b.column("count").to_pylist()):
                keys.append(key)
                counts.append(n)
                size += len(key)
                if size >= BLOCK_SYMBOLS:
                    yield from ((r[0], c, *r[1:]) for r, c in zip(solve_block(keys), counts))
                    keys, counts, size = [], [], 0
        if keys:
            yield from ((r[0], c, *r[1:]) for r, c in zip(solve_block(keys), counts))
    return batched(rows(), _SOLVED_ARROW, 256)


def _multiplied(fold: int):
    def multiplied(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The pieces of one conversation and group, in order, as one piece."""
        rows = rows.sort_values("at")
        m, counts, head = IDENTITY, dict.fromkeys(_COUNTS, 0), ""
        for r in rows.itertuples():
            m = product(m, [None if c < 0 else (c, Rope(t)) for c, t in zip(r.costs, r.audits)])
            for c in _COUNTS:
                counts[c] += getattr(r, c)
            counts["illegal"] += bool(head) and head[-1] + r.ends[0] not in LEGAL
            head = head[:1] + r.ends[1] if head else r.ends
        parts, group = int(rows["parts"].iloc[0]), int(rows["at"].iloc[0]) // fold
        if parts <= fold:  # the whole conversation
            m = product(product(IDENTITY[:STATES], m), INSERTS)
        return pd.DataFrame([{"conv_id": rows["conv_id"].iloc[0], "at": group, "parts": -(-parts // fold), **counts, "ends": head,
                              "costs": [-1 if e is None else e[0] for e in m], "audits": [None if e is None else e[1].spell() for e in m]}])
    return multiplied


def ordered(rows: DataFrame) -> DataFrame:
    """Written table of rows (of ``named``) without texts, in the order of their
    conversations: ``pos`` rises with conv_id, turn, role and digest of the text."""
    bare = F.expr(f"trim(TRAILING {_SPACE} FROM text)")
    initial = F.substring("role", 1, 1)
    lean = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"),
                       F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
                       (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]
    # The row id cuts blocks of equal rows across partitions.
    keyed = lean.withColumn("_tie", F.monotonically_increasing_id())
    keyed = keyed.repartitionByRange(*order, F.col("_tie")).sortWithinPartitions(*order, "_tie")
    return materialize(keyed.drop("_tie").withColumn("pos", F.monotonically_increasing_id()), "conversation-rows")


def pieces(rows: DataFrame, piece_bits: int = PIECE_BITS) -> DataFrame:
    """Written table of pieces of ``ordered`` rows: conv_id, at (from 0), parts
    (pieces of the conversation) and key, the symbols."""
    same = rows.where(~F.col("blank")).groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(
        F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = rows.join(same, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    fault = F.when(F.col("blank"), 1).when(F.col("pos") > F.col("first"), 2).when(F.col("truncated"), 3).otherwise(0)
    letter = F.char(65 + F.col("initial") * len(FAULTS) + fault)
    piece = F.shiftright("pos", piece_bits)
    got = marked.select("conv_id", piece.alias("piece"), F.struct("pos", letter.alias("letter")).alias("s"))
    got = got.groupBy("conv_id", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["letter"]), "").alias("key"))
    mine = Window.partitionBy("conv_id")
    got = got.withColumn("parts", F.count("*").over(mine)).withColumn("at", F.row_number().over(mine.orderBy("piece")).cast("long") - 1)
    return materialize(got.select("conv_id", "at", "parts", F.concat(F.when(F.col("parts") == 1, "=").otherwise("+"), "key").alias("key")), "pieces")


def solve(cut: DataFrame, fold: int = FOLD) -> DataFrame:
    """Per conversation of ``pieces``: conv_id, fault counts, cost and audit."""
    keys = materialize(cut.groupBy("key").agg(F.count("*").alias("count")), "keys")
    keys = keys.repartition("key")  # blocks of about the same size for every task
    table = materialize(keys.mapInArrow(_solved, _SOLVED), "solved")
    each = materialize(joined_back(cut, table, "key", "count").drop("key"), "each")
    done, left = each.where("parts = 1"), each.where("parts > 1")
    while not left.isEmpty():
        group = F.expr(f"at div {fold}")
        left = materialize(left.groupBy("conv_id", group.alias("g")).applyInPandas(_multiplied(fold), each.schema), "folded")
        done, left = done.unionByName(left.where("parts = 1")), left.where("parts > 1")
    # From the start to either end: nothing kept (0) or an assistant's row (3).
    end = lambda s: F.when(F.col("costs")[s] >= 0, F.struct(F.col("costs")[s].alias("cost"), F.col("audits")[s].alias("audit")))
    best = F.least(end(0), end(3))
    return done.select("conv_id", *_COUNTS, best["cost"].alias("cost"), best["audit"].alias("audit"))


def report(rows: DataFrame, conversations: DataFrame, piece_bits: int = PIECE_BITS, fold: int = FOLD) -> DataFrame:
    """One row (_REPORT) for each conv_id of ``conversations``, of its ``rows`` (of ``named``)."""
    lean = ordered(rows)
    turns = lean.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    solved = solve(pieces(lean, piece_bits), fold)
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    both = every.unionByName(turns, True).unionByName(solved, True)
    zero = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", *_COUNTS, "cost")]
    return both.groupBy("conv_id").agg(*zero, F.coalesce(F.max("audit"), F.lit("")).alias("audit"))


def apply_edits(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of a conversation after its edits; holds one row at a time."""
    at, state = 0, 0

    def made() -> str:
        nonlocal state
        state = 3 if state == 2 else 2
        return "assistant" if state == 3 else "user"

    for role, text in rows:
        while audit[at] == "I":
            at += 1
            yield made(), ""
        edit, at = audit[at], at + 1
        if edit == "K":
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            yield role, text
        elif edit == "R":
            yield made(), text
    for _ in audit[at:]:
        yield made(), ""


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """(report row, its conversation's rows) from a partition in which the report
    row comes first. The rows must be used up before the next is asked for."""
    def flat():
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("head", "role", "text")]
            yield from zip(*cols)

    stream, nxt = flat(), None
    nxt = next(stream, None)

    def mine():
        nonlocal nxt
        while nxt is not None and nxt[0] is None:
            yield nxt[1], nxt[2]
            nxt = next(stream, None)

    while nxt is not None:
        head, nxt = nxt[0], next(stream, None)
        yield head, mine()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _REPORT.split(", ")]
    schema = pa.schema([*((c, pa.string() if c == "audit" else pa.int64()) for c in names), ("repaired_sha256", pa.string())])

    def out():
        for head, rows in _merged(batches):
            digest, lead = hashlib.sha256(), b""
            for role, text in apply_edits(head["audit"], rows):
                digest.update(lead + f"{role}:".encode())
                digest.update(text.encode())
                lead = b"\n"
            yield (*(head[c] for c in names), digest.hexdigest())
    return batched(out(), schema)


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    return batched(((head["conv_id"], i, r, t) for head, rows in _merged(batches) for i, (r, t) in enumerate(apply_edits(head["audit"], rows))), schema, 1024)


def _streamed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each report row of ``found`` followed by the rows of its conversation, in order."""
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.struct(*found.columns).alias("head"))
    body = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    both = heads.unionByName(body, True).repartition("conv_id")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "kind", "turn", "role", "digest")]
    return both.sortWithinPartitions(*order).select("head", "role", "text")


def repair(conversations: DataFrame, damaged: bool = False, piece_bits: int = PIECE_BITS, fold: int = FOLD) -> DataFrame:
    """The report of each conversation and the digest of its repaired rows;
    ``damaged`` puts the faults of ``damage`` in first. Pieces have up to
    2 ** piece_bits rows, ``fold`` of them are multiplied at a time."""
    rows = damage(conversations) if damaged else named(conversations)
    found = report(rows, conversations, piece_bits, fold)
    return _streamed(rows, found).mapInArrow(_digests, f"{_REPORT}, repaired_sha256 string")


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text."""
    rows = named(conversations)
    return _streamed(rows, report(rows, conversations)).mapInArrow(_rewritten, "conv_id long, place long, role string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(read_table(spark, sf_dir, "conversations"), damaged=True)
