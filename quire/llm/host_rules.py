"""Host-level quality rules, in DataFrame operations only.

Every document is measured by rules; the share of failing documents of a host
(the ``source`` column) is shrunk towards the mean of all hosts with a beta
prior whose strength is fitted to the spread between hosts, and the verdict on
a host is joined back: documents of a host judged bad must pass the strict
rules as well, all others only the base rule.

Defined results: a null or empty text has no words and fails the base rule; a
null host is a host of its own; windows are compared by 64-bit hashes within
one text; rows with equal or null doc_id are measured one by one; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Strict rules, for documents of bad hosts: percent of symbols in the word
#: characters, and of duplicate lines in the words.
MOST_SYMBOLS, MOST_DUP_LINES = 20, 10
#: A host is bad when its shrunk failure rate exceeds this.
BAD_RATE = 0.5
#: Parts a host's documents are spread over when the verdicts are joined back.
SALTS = 32


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, host and the counts of the rules."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), text.alias("text"))
    words = F.array_remove(F.split(F.translate("text", SPACES[1:], " " * (len(SPACES) - 1)), " "), "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    d = d.select("doc_id", "host", words.alias("words"), lines.alias("lines"),
                 F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
                 (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"))
    n = F.size("words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
    d = d.select("doc_id", "host", "word_chars", "n_symbols", n.cast("long").alias("n_words"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.coalesce(windows, F.array().cast("array<bigint>")).alias("windows"))
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    return d.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    F.when(some, _covered(F.col("windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more: sort (hash, place), keep those
    equal to a neighbour, and add up how far each reaches beyond the one before."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.element_at(F.transform(F.array(placed), lambda s: _reach(
        F.array_sort(F.transform(F.filter(s, lambda x, k: _same(s, x, k - 1) | _same(s, x, k + 1)), lambda x: x["i"])))), 1)


def _same(s: Column, x: Column, k: Column) -> Column:
    return F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))


def _reach(places: Column) -> Column:
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(places, start, lambda a, i: F.struct(
        (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])


def with_rules(measured: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``strict_failed``."""
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    strict = (100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("word_chars")) | (100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_words"))
    return measured.withColumn("base_failed", base).withColumn("strict_failed", base | strict)


def host_rates(ruled: DataFrame) -> DataFrame:
    """Per host: documents, failures, and the failure rate shrunk by the beta
    prior with the mean and spread of all hosts (method of moments)."""
    # One row per host comes out, after partial sums in every task.
    hosts = materialize(ruled.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("strict_failed").cast("long")).alias("n_failed")), "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    t = hosts.agg(F.count("*").alias("k"), F.sum("n_docs").alias("n"), F.sum("n_failed").alias("x"), F.var_pop(rate).alias("v"),
                  F.avg(1 / F.col("n_docs")).alias("inverse")).first()
    mean = (t["x"] or 0) / t["n"] if t["n"] else 0.0
    noise = mean * (1 - mean) * (t["inverse"] or 0.0)  # of a rate, from its host's few documents
    between = max((t["v"] or 0.0) - noise, 1e-6)
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)
    return hosts.withColumn("rate", (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength))


def judge(docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed``, the host's ``host_rate`` and the verdict ``kept``."""
    ruled = materialize(with_rules(measure(docs)), "rules")
    # Every host's row is there once per salt, so no task gets all rows of a large host.
    rates = host_rates(ruled).select("host", F.col("rate").alias("host_rate")).withColumn(
        "salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    salted = ruled.withColumn("salt", F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(SALTS)).cast("int"))
    r, h = salted.alias("r"), rates.alias("h")
    both = r.join(h, F.col("r.host").eqNullSafe(F.col("h.host")) & (F.col("r.salt") == F.col("h.salt")))
    kept = ~F.col("base_failed") & ~((F.col("host_rate") > BAD_RATE) & F.col("strict_failed"))
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       kept.alias("kept"), F.round("host_rate", 9).alias("host_rate"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))
